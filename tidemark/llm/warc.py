"""WARC archives: whole-file gzip in, one gzip member a record and an offset index out.

The normaliser inflates each archive's stream once, rewrites every record as its own member
and writes a sidecar of offsets beside it, so a reader can fetch any record alone. Payloads
never shuffle: what is dealt out is (archive, record number, page, digest), from which each
archive learns the records that another one's payload already answers. Those become revisits
while they are rewritten.

Files go to the shared folder through pyarrow's file systems, under a name of their own until
they are whole, so a task that runs twice leaves one good file.
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import fresh_path, written

_CHUNK = 1 << 20
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORDS = "archive string, nth long, page_id long, digest string, bytes long"
READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, archive string, offset long"


def _place(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


@contextmanager
def _whole_file(uri: str):
    """A file that appears under its name when it is complete."""
    system, path = _place(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    own = f"{path}.{TaskContext.get().taskAttemptId() if TaskContext.get() else 0}.part"
    with system.open_output_stream(own, compression=None) as f:
        yield f
    if system.get_file_info(path).type.name != "NotFound":
        system.delete_file(path)  # of an attempt before; not every store moves onto a file
    system.move(own, path)


def _header(fields: list[tuple[str, object]]) -> bytes:
    lines = [f"{k}: {re.sub(r'[\x00-\x1f\x7f]', lambda m: f'%{ord(m[0]):02X}', str(v))}" for k, v in fields if v is not None]
    return "\r\n".join(["WARC/1.1", *lines, "", ""]).encode("utf-8", "surrogatepass")


def _page_uri(page_id: int | None, archive: str, nth: int) -> str:
    return f"<urn:page:{page_id}>" if page_id is not None else f"<urn:record:{archive.rpartition('/')[2]}:{nth}>"


def write_archives(pages: DataFrame, folder: str, date: str, most_bytes: int = 1 << 28, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Archives of response records, each file one gzip stream. A row for each record: RECORDS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        rest = ((i, u, h) for b in batches for i, u, h in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)))
        page = next(rest, None)
        while page:
            archive = f"{folder}/{part:06d}-{number:04d}.warc.gz"
            number, rows, size = number + 1, [], 0
            with _whole_file(archive) as f:
                deflate = zlib.compressobj(1, zlib.DEFLATED, 31)
                while page and size < most_bytes:
                    page_id, url, html = page
                    payload = html.as_py() or b""
                    digest = hashlib.sha256(payload).hexdigest()
                    head = [("WARC-Type", "response"), ("WARC-Record-ID", _page_uri(page_id, archive, len(rows))), ("WARC-Date", date), ("WARC-Target-URI", url), ("X-Page-ID", page_id)]
                    head += [("WARC-Payload-Digest", f"sha256:{digest}"), ("X-Payload-Length", len(payload)), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(_HTTP) + len(payload))]
                    for piece in (_header(head), _HTTP, payload, b"\r\n\r\n"):
                        f.write(deflate.compress(piece))
                    rows.append((archive, len(rows), page_id, digest, len(payload)))
                    size += len(payload)
                    page = next(rest, None)
                f.write(deflate.flush())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64()))], [x.split()[0] for x in RECORDS.split(", ")])

    rows = pages.select(F.col(id_col).cast("long"), F.col(url_col).cast("string"), F.col(html_col).cast("string").cast("binary").alias("html"))
    return rows.mapInArrow(run, RECORDS)


class _Inflated:
    """An archive's bytes, inflated once as they are read, whatever its gzip members are."""

    def __init__(self, f) -> None:
        self.file, self.left, self.inflate = f, b"", zlib.decompressobj(31)
        self.raw = b""

    def _more(self) -> bool:
        while True:
            if self.inflate.eof:
                self.raw = self.inflate.unused_data or self.raw
                if not self.raw:
                    self.raw = self.file.read(_CHUNK)
                if not self.raw:
                    return False
                self.inflate = zlib.decompressobj(31)
            data = self.raw or self.file.read(_CHUNK)
            if not data:
                raise EOFError("the archive ends inside a gzip stream")
            out = self.inflate.decompress(data, _CHUNK)
            self.raw = self.inflate.unconsumed_tail
            if out:
                self.left += out
                return True

    def head(self) -> bytes | None:
        """Up to and with the empty line that ends a header; None at the end."""
        while (at := self.left.find(b"\r\n\r\n")) < 0:
            if not self._more():
                if self.left.strip():
                    raise EOFError("the archive ends inside a record's header")
                return None
        out, self.left = self.left[: at + 4], self.left[at + 4 :]
        return out

    def take(self, n: int) -> Iterator[bytes]:
        while n:
            if not self.left and not self._more():
                raise EOFError("the archive ends inside a record")
            piece, self.left = self.left[:n], self.left[n:]
            n -= len(piece)
            yield piece


def _fields(head: bytes) -> list[tuple[str, str]]:
    version, *lines = head.decode("utf-8", "surrogatepass").strip("\r\n").split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError(f"no WARC record: {version[:40]!r}")
    return [(k, v.strip()) for k, _, v in (x.partition(":") for x in lines)]


def normalise_archive(source: str, target: str, revisits: dict[int, int]) -> int:
    """Rewrite an archive with a gzip member for each record and, beside it, `.index` of offsets.

    Records numbered in `revisits` keep their headers and lose their payload; they refer to
    the page given there. Payloads pass through in pieces. The index has a JSON line for each
    record. Returns the number of records.
    """
    system, path = _place(source)
    lines: list[str] = []
    with system.open_input_stream(path, compression=None) as f, _whole_file(target) as out:
        stream, offset = _Inflated(f), 0
        while (head := stream.head()) is not None:
            fields = _fields(head)
            known = dict(fields)
            length, first = int(known["Content-Length"]), revisits.get(len(lines))
            body = stream.take(length)
            if first is not None:
                block = b""
                for piece in body:  # what follows the HTTP header is left out
                    if b"\r\n\r\n" not in block:
                        block += piece
                block = block[: block.index(b"\r\n\r\n") + 4]
                new = {"WARC-Type": "revisit", "Content-Length": str(len(block))}
                fields = [(k, new.get(k, v)) for k, v in fields] + [("WARC-Profile", _PROFILE), ("WARC-Refers-To", f"<urn:page:{first}>")]
                head, body = _header(fields), iter([block])
            deflate, wrote = zlib.compressobj(6, zlib.DEFLATED, 31), 0
            for pieces in ([head], body, [b"\r\n\r\n"]):
                for piece in pieces:
                    wrote += out.write(part) if (part := deflate.compress(piece)) else 0
            wrote += out.write(deflate.flush())
            if b"".join(stream.take(4)) != b"\r\n\r\n":
                raise ValueError(f"record {len(lines)} of {source} is longer than it says")
            lines.append(json.dumps({"offset": offset, "length": wrote, "id": known["WARC-Record-ID"], "type": "revisit" if first is not None else known["WARC-Type"], "uri": known.get("WARC-Target-URI"), "digest": known.get("WARC-Payload-Digest")}))
            offset += wrote
    with _whole_file(f"{target}.index") as out:
        out.write("".join(x + "\n" for x in lines).encode())
    return len(lines)


def read_record(f, offset: int, length: int) -> tuple[dict[str, str], bytes]:
    """The header fields and the payload of the record that has this gzip member."""
    f.seek(offset)
    whole = zlib.decompress(f.read(length), 31)
    at = whole.index(b"\r\n\r\n") + 4
    fields = dict(_fields(whole[:at]))
    block = whole[at : at + int(fields["Content-Length"])]
    return fields, block[block.index(b"\r\n\r\n") + 4 :]


def read_archives(archives: DataFrame) -> DataFrame:
    """archives(archive) with sidecars -> READ: a row for each record, fetched by its offset.

    Payloads of responses are hashed again; one that differs from its header is an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        for archive in (x for b in batches for x in b.column(0).to_pylist()):
            system, path = _place(archive)
            with system.open_input_stream(f"{path}.index", compression=None) as f:
                index = [json.loads(x) for x in f.read().splitlines()]
            with system.open_input_file(path) as f:
                for at in range(0, len(index), 1000):
                    rows = []
                    for x in index[at : at + 1000]:
                        fields, payload = read_record(f, x["offset"], x["length"])
                        digest, n = fields["WARC-Payload-Digest"].partition(":")[2], int(fields["X-Payload-Length"])
                        if fields["WARC-Type"] == "response" and (len(payload), hashlib.sha256(payload).hexdigest()) != (n, digest):
                            raise ValueError(f"the payload at {x['offset']} of {archive} isn't what its header says")
                        page, first = fields.get("X-Page-ID"), fields.get("WARC-Refers-To")
                        rows.append((int(page) if page else None, n, digest, fields["WARC-Type"], int(first.strip("<>").rpartition(":")[2]) if first else None, fields.get("WARC-Target-URI"), archive, x["offset"]))
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], [x.split()[0] for x in READ.split(", ")])

    return archives.select("archive").mapInArrow(run, READ)


def _one_task_each(archives: DataFrame, most: int = 20_000) -> DataFrame:
    """A task for each archive; beyond `most` archives a task has several, one after the other."""
    return archives.repartitionByRange(max(1, min(most, archives.count())), "archive")


def crawl_archives(pages: DataFrame, least: int = 100, date: str = "1970-01-01T00:00:00Z", id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write pages as WARC archives, normalise them and read them back: a row for each page (READ).

    Of pages with equal payloads of at least `least` bytes the one with the smallest page_id
    is the response and the others revisit it; smaller payloads are all responses. A null html
    is an empty payload. Rows that repeat the response's page_id and payload are responses
    too. A page without an id never is what others refer to; where none of a payload's pages
    has an id, all are responses. Control characters in URLs are percent-encoded, a null URL
    is left out, and an empty table gives no rows.

    The normalised archives with their `.index` files stay in the shared folder (column
    archive); the streams they were made from are deleted once all are rewritten.
    """
    spark = pages.sparkSession
    folder = fresh_path(spark, "warc")
    records = written(write_archives(pages, f"{folder}/streams", date, 1 << 28, id_col, url_col, html_col), "records")
    groups = written(
        records.where(F.col("bytes") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "first"),
        "payloads",
    )
    again = records.join(groups, "digest").where(F.col("page_id").isNull() | (F.col("page_id") != F.col("first"))).where(F.col("first").isNotNull())
    revisits = again.groupBy("archive").agg(F.collect_list(F.struct("nth", "first")).alias("revisits"))
    sources = written(records.select("archive").distinct().join(revisits, "archive", "left"), "streams")

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for source, revisits in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                target = f"{folder}/archives/{source.rpartition('/')[2]}"
                n = normalise_archive(source, target, {x["nth"]: x["first"] for x in revisits or ()})
                yield pa.RecordBatch.from_arrays([pa.array([target]), pa.array([n], pa.int64())], ["archive", "records"])

    archives = written(_one_task_each(sources).select("archive", "revisits").mapInArrow(rewrite, "archive string, records long"), "archives")
    streams = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/streams")
    streams.getFileSystem(spark._jsc.hadoopConfiguration()).delete(streams, True)
    return read_archives(_one_task_each(archives))
