"""An append-only table with a commit log: appends are atomic, idempotent by key, and safe beside each other.

Tasks write Parquet files that nobody sees. The driver's commit publishes one manifest, a JSON file whose name is
the next version; whoever is second to a version fails and starts over from the newer table. A
manifest has a filter of each file's keys, so an append reads only the files that may hold one of its own.
"""

from __future__ import annotations

import base64
import json
import os
import uuid
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from tidemark.sources.io import exists

#: Bits of a key filter: a file of up to some ten thousand rows leaves most of them unset.
BITS = 1 << 18
HASH = "__key_hash"
_MANIFEST = "version long, schema string, key array<string>, files array<struct<file: string, rows: long, filter: string>>"


class ConcurrentAppend(Exception):
    """Another append has published this version."""


@dataclass
class _File(WriterCommitMessage):
    file: str
    rows: int
    filter: str


def _place(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _packed(places: np.ndarray) -> str:
    bits = np.zeros(BITS, np.uint8)
    bits[places] = 1
    return base64.b64encode(zlib.compress(np.packbits(bits).tobytes(), 6)).decode()


def _places(hashes: np.ndarray) -> np.ndarray:
    return (hashes.astype(np.int64).view(np.uint64) >> np.uint64(64 - 18)).astype(np.int64)


def _overlap(a: str, b: bytes) -> bool:
    return bool((np.frombuffer(zlib.decompress(base64.b64decode(a)), np.uint8) & np.frombuffer(b, np.uint8)).any())


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict, schema: StructType) -> None:
        self.path, self.version, self.key = options["path"].rstrip("/"), int(options["version"]), json.loads(options["key"])
        self.schema = StructType([f for f in schema.fields if f.name != HASH]).json()

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _File:
        import pyarrow.parquet as pq

        system, root = _place(self.path)
        name, rows, seen, out = f"data/{uuid.uuid4().hex}.parquet", 0, [], None
        system.create_dir(f"{root}/data", recursive=True)
        for batch in iterator:
            if batch.num_rows:
                seen.append(np.unique(_places(batch.column(batch.schema.get_field_index(HASH)).to_numpy(zero_copy_only=False))))
                table = pa.Table.from_batches([batch]).drop_columns([HASH])
                out = out or pq.ParquetWriter(f"{root}/{name}", table.schema, filesystem=system)
                out.write_table(table)
                rows += batch.num_rows
        if out is None:
            return _File("", 0, "")
        out.close()
        return _File(name, rows, _packed(np.concatenate(seen)))

    def commit(self, messages: list[_File | None]) -> None:
        files = [{"file": m.file, "rows": m.rows, "filter": m.filter} for m in messages if m and m.rows]
        system, root = _place(self.path)
        if not files and self.version > 1:
            return
        system.create_dir(f"{root}/commits", recursive=True)
        own, to = f"{root}/commits/.{uuid.uuid4().hex}", f"{root}/commits/{self.version:012d}.json"
        with system.open_output_stream(own, compression=None) as f:
            f.write(json.dumps({"version": self.version, "schema": self.schema, "key": self.key, "files": files}).encode())
        try:
            if system.type_name == "local":
                os.link(own, to)  # fails where the name is taken, unlike a rename
                os.remove(own)
            else:
                system.move(own, to)  # HDFS doesn't move onto a file
        except OSError as e:
            system.delete_file(own)
            self.abort(messages)
            raise ConcurrentAppend(f"version {self.version} is taken") from e

    def abort(self, messages: list[_File | None]) -> None:
        system, root = _place(self.path)
        for m in messages:
            if m and m.file and system.get_file_info(f"{root}/{m.file}").type.name == "File":
                system.delete_file(f"{root}/{m.file}")


class LedgerSource(DataSource):
    """spark.dataSource format `tidemark_ledger`, which only writes; read with read_ledger."""

    @classmethod
    def name(cls) -> str:
        return "tidemark_ledger"

    def writer(self, schema: StructType, overwrite: bool) -> _Writer:
        if overwrite:
            raise ValueError("a ledger is appended to, never overwritten")
        return _Writer(dict(self.options), schema)


def _log(spark: SparkSession, path: str) -> DataFrame | None:
    """The manifests as a table, or none before the first commit."""
    found = f"{path.rstrip('/')}/commits/*.json"
    return spark.read.schema(_MANIFEST).json(found) if exists(spark, found) else None


def version(spark: SparkSession, path: str) -> int:
    log = _log(spark, path)
    return 0 if log is None else log.agg(F.max("version")).first()[0]


def read_ledger(spark: SparkSession, path: str, schema: StructType | str, as_of: int | None = None, files: Sequence[str] | None = None) -> DataFrame:
    """The rows of all commits up to version as_of, or of some of their files. Uncommitted files are never read."""
    log = _log(spark, path)
    if files is None:
        if log is None:
            return spark.createDataFrame([], schema)
        log = log if as_of is None else log.where(F.col("version") <= as_of)
        files = [r.file for r in log.select(F.explode("files.file").alias("file")).collect()]
    root = path.rstrip("/")
    return spark.read.schema(schema).parquet(*[f"{root}/{f}" for f in files]) if files else spark.createDataFrame([], schema)


def may_hold(spark: SparkSession, path: str, hashes: DataFrame, upto: int) -> list[str]:
    """Files up to a version whose filters share a bit with the keys of `hashes`.

    What is sent to the tasks is one filter of BITS bits, whatever the number of keys; the manifests' filters are
    compared where they are read, and names of files come back.
    """
    log = _log(spark, path)
    if log is None:
        return []
    places = hashes.select(F.shiftrightunsigned(HASH, 64 - 18).alias("p")).distinct().collect()  # BITS at most
    bits = np.zeros(BITS, np.uint8)
    bits[[r.p for r in places]] = 1
    wanted = np.packbits(bits).tobytes()

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array([_overlap(x, wanted) for x in b.column(1).to_pylist()], pa.bool_())).select(["file"])

    listed = log.where(F.col("version") <= upto).select(F.inline("files")).select("file", "filter")
    return sorted(r.file for r in listed.mapInArrow(kept, "file string").collect())


def append(df: DataFrame, path: str, key: Sequence[str], tries: int = 10) -> int:
    """Append the rows whose key the ledger doesn't have, one for each key; returns the version that then holds them.

    Null keys are keys; of rows that repeat a key the one with the smallest hash of all columns is taken. Appending again
    changes nothing. A writer that loses the race for a version reads what the winner wrote and tries again. A
    write that fails or is killed leaves no row. Column types must be the same at every append.
    """
    spark = df.sparkSession
    # A thread of its own has no active session, and without one the JVM doesn't look for Python sources.
    spark._jvm.org.apache.spark.sql.classic.SparkSession.setActiveSession(spark._jsparkSession)
    spark.dataSource.register(LedgerSource)
    cols = [F.col(f"`{c}`") for c in df.columns]
    with_hash = lambda x: x.withColumn(HASH, F.xxhash64(*[y for c in key for y in (F.col(f"`{c}`").isNull(), F.col(f"`{c}`"))]))
    one = df.groupBy(*[F.col(f"`{c}`") for c in key]).agg(F.min_by(F.struct(*cols), F.xxhash64(*cols)).alias("__row")).select("__row.*")
    for _ in range(tries):
        now = version(spark, path)
        new = with_hash(one)
        files = may_hold(spark, path, new, now)
        if files:
            held = read_ledger(spark, path, df.schema, files=files).select(*[F.col(f"`{c}`").alias(f"__k{i}") for i, c in enumerate(key)]).distinct()
            same = F.lit(True)
            for i, c in enumerate(key):
                same = same & F.col(f"`{c}`").eqNullSafe(F.col(f"__k{i}"))
            new = new.join(held, same, "left_anti")
        try:
            new.write.format("tidemark_ledger").mode("append").option("path", path).option("version", now + 1).option("key", json.dumps(list(key))).save()
            return version(spark, path)
        except Exception as e:
            if "ConcurrentAppend" not in str(e):
                raise
    raise ConcurrentAppend(f"{tries} others were faster")
