"""Co-bucketed files against a plain version that reads every file that is left."""

import collections
import hashlib
import random
import tempfile
import zlib
from pathlib import Path

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tidemark.llm.cobucket import co_bucketed, key_bucket
from tidemark.llm.queries import op13_cobucket

SF = "/root/testdata/sf0.001"


def order(row, names, key):
    rest = [row[key], *[row[c] for c in names if c != key]]
    return [(x is not None, x.encode() if isinstance(x, str) else x) if x is not None else (False,) for x in rest]


def sha(parts):
    return hashlib.sha256(",".join(parts).encode()).hexdigest()


def brute(tables, key, buckets, numbers):
    """{(table, bucket): (ids hash, lineage hash, rows, joined, rewritten, sorted rows)}"""
    ids = {r[key] for r in tables[0][2]} - {None}
    crc = lambda x: zlib.crc32(f"line{x}".encode()) % buckets
    out, of = {}, {}
    for nth, (name, names, rows) in enumerate(tables):
        final, start = collections.defaultdict(list), collections.defaultdict(list)
        for r in rows:
            b = buckets + 1 if r[key] is None else buckets if nth and r[key] not in ids else crc(r[key])
            s = numbers[nth](r, buckets + 1 if r[key] is None else crc(r[key]))
            final[b].append((s, r))
            start[s].append(b)
        for b, found in final.items():
            n = collections.Counter(s for s, _ in found)
            stays = len(n) == 1 and set(start[min(n)]) == {b}
            have = sorted((r for _, r in found), key=lambda r: order(r, names, key))
            out[name, b] = [sha("" if r[key] is None else str(r[key]) for r in have), sha(f"{s}:{n[s]}" for s in sorted(n)), len(have), 0, not stays, have]
            of[nth, b] = collections.Counter(r[key] for r in have)
    for (nth, b), n in of.items():
        if b < buckets and (1 - nth, b) in of:
            out[tables[nth][0], b][3] = sum(c * of[1 - nth, b][k] for k, c in n.items())
    return {k: tuple(v) for k, v in out.items()}


def held(df, folder, tables, key, want):
    got = {(r.table_name, r.bucket): r for r in df.collect()}
    assert set(got) == set(want)
    names = {t[0]: t[1] for t in tables}
    paths = set()
    for k, r in got.items():
        path = r.path.removeprefix("file:").replace("//", "/")
        paths.add(Path(path).resolve())
        table = pq.ParquetFile(path).read()
        assert (r.ids_sha256, r.lineage_sha256, r.n_rows, r.n_joined, r.rewritten) == want[k][:5]
        assert table.column_names == names[k[0]] == r.columns.split(",")
        assert [order(x, names[k[0]], key) for x in table.to_pylist()] == [order(x, names[k[0]], key) for x in want[k][5]]
    left = {p.resolve() for p in Path(folder).rglob("*.parquet")}
    assert left == paths


def awkward():
    rng = random.Random(3)
    left = [{"id": i, "v": rng.choice([None, 1.5, -2.0]), "file": rng.choice(["b", "é", "Z", None, ""])} for i in range(60)]
    left += [{"id": 7, "v": 0.5, "file": "x"}] * 3 + [{"id": None, "v": 1.0, "file": "n"}] * 2
    right = [{"bucket": rng.choice(["ß", "a", "", None]), "id": rng.choice([7, 7, 7, None, *range(80)]), "k": rng.choice([None, *range(9)]), "digit": "y" * rng.choice([0, 1, 5000])} for _ in range(400)]
    return left, right + right[:50]


@pytest.mark.parametrize("fanout", [22, 3])
def test_files_of_awkward_rows(spark, fanout):
    left, right = awkward()
    a = spark.createDataFrame([(r["id"], r["v"], r["file"]) for r in left], "id long, v double, file string")
    b = spark.createDataFrame([(r["bucket"], r["id"], r["k"], r["digit"]) for r in right], "bucket string, id long, k long, digit string")
    folder = tempfile.mkdtemp()
    number = F.coalesce(key_bucket(F.col("k"), 20), F.lit(0))
    got = co_bucketed(a, b, "id", f"file://{folder}", 20, left_number=lambda x: F.when(x % 3 == 1, x - 1).otherwise(x), right_number=number, names=("l", "r"), fanout=fanout)
    tables = [("l", a.columns, left), ("r", b.columns, right)]
    numbers = [lambda r, x: x - (x % 3 == 1), lambda r, x: 0 if r["k"] is None else zlib.crc32(str(r["k"]).encode()) % 20]
    want = brute(tables, "id", 20, numbers)
    assert any(not v[4] for v in want.values()) and any(v[4] for v in want.values())
    held(got, folder, tables, "id", want)


def test_files_that_fit_under_another_number(spark):
    a = spark.createDataFrame([(i,) for i in (1, 2, None)], "id long")
    b = spark.createDataFrame([(1, 5), (1, 5), (9, 6), (None, 7)], "id long, of long")
    folder = tempfile.mkdtemp()
    got = co_bucketed(a, b, "id", f"file://{folder}", 4, right_number=F.col("of"), left_number=lambda x: F.lit(0), names=("l", "r"))
    rows = [{"id": 1, "of": 5}, {"id": 1, "of": 5}, {"id": 9, "of": 6}, {"id": None, "of": 7}]
    tables = [("l", ["id"], [{"id": i} for i in (1, 2, None)]), ("r", ["id", "of"], rows)]
    held(got, folder, tables, "id", brute(tables, "id", 4, [lambda r, x: 0, lambda r, x: r["of"]]))


def test_empty_tables(spark):
    a, b = spark.createDataFrame([], "id long, v string"), spark.createDataFrame([(3, "x")], "id long, w string")
    assert co_bucketed(a, a, "id", f"file://{tempfile.mkdtemp()}", 4).collect() == []
    assert [(r.table_name, r.bucket, r.n_rows, r.n_joined) for r in co_bucketed(a, b, "id", f"file://{tempfile.mkdtemp()}", 4).collect()] == [("right", 4, 1, 0)]
    assert [(r.table_name, r.n_rows) for r in co_bucketed(b, a, "id", f"file://{tempfile.mkdtemp()}", 4).collect()] == [("left", 1)]


def test_query(spark):
    df = op13_cobucket(spark, SF)
    folder = df.first().path.split("/sale", 1)[0].removeprefix("file:").replace("//", "/")
    read = lambda n: (n, pq.read_schema(f"{SF}/{n}.parquet").names, pq.read_table(f"{SF}/{n}.parquet").to_pylist())
    tables = [read("sales"), read("sale_lines")]
    numbers = [lambda r, x: x - (x % 3 == 1), lambda r, x: 0 if r["item_id"] is None else zlib.crc32(str(r["item_id"]).encode()) % 300]
    held(df, folder, tables, "sale_id", brute(tables, "sale_id", 300, numbers))
