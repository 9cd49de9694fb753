import gzip
import hashlib
import json
import zlib

import pytest

from tidemark.llm import warc as W

SCHEMA = "page_id long, url string, html string, digest string, nth long"


def brute(pages):
    out = []
    for i, _, html, *_ in pages:
        p = (html or "").encode()
        same = [j for j, _, h, *_ in pages if (h or "").encode() == p and j is not None]
        first = min(same, default=None)
        again = len(p) >= 100 and first is not None and i != first
        out.append((i, len(p), hashlib.sha256(p).hexdigest(), "revisit" if again else "response", first if again else None))
    return out


def test_against_brute_force(spark):
    long = "<p>" + "é word\r\n\r\n" * 40_000 + "</p>"
    pages = [(i, f"http://x/{i}", f"<html>{'page' * 30}{i % 7}</html>", "d", 1) for i in range(60)]
    pages += [(100, None, None, None, None), (101, "http://x/\r\nEvil: 1", "", None, None), (102, "u", "short", None, None), (103, "u", "short", None, None)]
    pages += [(104, "u", long, None, None), (99, "u", long, None, None), (None, "u", long, None, None), (None, "u", "y" * 200, None, None), (99, "u", long, None, None)]
    df = spark.createDataFrame(pages, SCHEMA).repartition(3)
    rows = W.crawl_archives(df).collect()
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows]
    assert sorted(got, key=repr) == sorted(brute(pages), key=repr)
    assert next(r.url for r in rows if r.page_id == 101) == "http://x/%0D%0AEvil: 1"
    assert W.crawl_archives(spark.createDataFrame([], SCHEMA)).collect() == []


def record(i, payload):
    head = f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{i}>\r\nX-Page-ID: {i}\r\nX-Payload-Length: {len(payload)}\r\nWARC-Payload-Digest: sha256:{hashlib.sha256(payload).hexdigest()}\r\n"
    block = b"HTTP/1.1 200 OK\r\n\r\n" + payload
    return head.encode() + f"Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


@pytest.mark.parametrize("members", [1, 2])
def test_members_and_index(tmp_path, members):
    payloads = [b"", b"a\r\n\r\nb" * 500, bytes(range(256)) * 9000, b"z"]
    records = [record(i, p) for i, p in enumerate(payloads)]
    source = tmp_path / "in.warc.gz"
    whole = b"".join(records)
    source.write_bytes(gzip.compress(whole) if members == 1 else gzip.compress(whole[:777]) + gzip.compress(whole[777:]))
    target = f"{tmp_path}/out/o.warc.gz"
    assert W.normalise_archive(str(source), target, {}) == 4
    data = open(target, "rb").read()
    assert gzip.decompress(data) == whole
    index = [json.loads(x) for x in open(f"{target}.index")]
    assert [zlib.decompress(data[x["offset"] : x["offset"] + x["length"]], 31) for x in index] == records
    with open(target, "rb") as f:
        assert [W.read_record(f, x["offset"], x["length"])[1] for x in index] == payloads


def test_cut_archives_are_errors(tmp_path):
    good = gzip.compress(record(1, b"x" * 500))
    for bad in (good[:-60], gzip.compress(record(1, b"x" * 500)[:-30]), gzip.compress(b"no archive\r\n\r\n")):
        (tmp_path / "bad.gz").write_bytes(bad)
        with pytest.raises((EOFError, ValueError)):
            W.normalise_archive(str(tmp_path / "bad.gz"), f"{tmp_path}/o.gz", {})
