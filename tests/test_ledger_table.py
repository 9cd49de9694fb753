"""The table with a commit log: idempotent, atomic, safe under concurrent writers, and what an append reads."""

import threading
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tidemark.sources import ledger_table as L

SCHEMA = "a long, b string, v double"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_appending_again_changes_nothing(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    rows = [(1, "x", 1.0), (1, None, 2.0), (None, None, 3.0), (2, "y", 4.0), (2, "y", 5.0)]
    assert L.append(frame(spark, rows), path, ["a", "b"]) == 1
    assert L.append(frame(spark, rows), path, ["a", "b"]) == 1
    assert L.append(frame(spark, [(2, "y", 9.0), (3, "", 6.0)]), path, ["a", "b"]) == 2
    got = L.read_ledger(spark, path, SCHEMA).collect()
    assert len(got) == 5 and {(r.a, r.b) for r in got} == {(1, "x"), (1, None), (None, None), (2, "y"), (3, "")}
    assert {r.v for r in got if r.a == 2} <= {4.0, 5.0}
    assert L.read_ledger(spark, path, SCHEMA, as_of=1).count() == 4
    assert L.append(frame(spark, []), f"{path}2", ["a"]) == 1 and L.read_ledger(spark, f"{path}2", SCHEMA).collect() == []


def test_writers_beside_each_other_leave_no_duplicate(spark, tmp_path):
    path, failed = f"file://{tmp_path}/t", []

    def write(n):
        try:
            L.append(spark.range(40).select((F.col("id") + n * 10).alias("a"), F.lit("k").alias("b"), F.lit(float(n)).alias("v")), path, ["a", "b"])
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    threads = [threading.Thread(target=write, args=(n,)) for n in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert failed == [], [str(e) for e in failed]
    got = [r.a for r in L.read_ledger(spark, path, SCHEMA).collect()]
    assert sorted(got) == list(range(70))
    listed = {f for r in L._log(spark, path).collect() for f in (x.file for x in r.files)}
    assert {f"data/{p.name}" for p in Path(f"{tmp_path}/t/data").glob("*.parquet")} == listed


def test_second_to_a_version_fails_and_cleans_up(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    L.append(frame(spark, [(1, "x", 1.0)]), path, ["a"])
    late = frame(spark, [(2, "x", 1.0)]).withColumn(L.HASH, F.xxhash64("a"))
    with pytest.raises(Exception, match="ConcurrentAppend"):
        late.write.format("tidemark_ledger").mode("append").option("path", path).option("version", 1).option("key", '["a"]').save()
    assert L.read_ledger(spark, path, SCHEMA).count() == 1 and len(list(Path(f"{tmp_path}/t/data").glob("*.parquet"))) == 1


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    L.append(frame(spark, [(1, "x", 1.0)]), path, ["a"])
    bad = spark.range(2000).repartition(4).select(F.col("id").alias("a"), F.lit("b").alias("b"), F.when(F.col("id") == 1234, F.raise_error(F.lit("stop")).cast("double")).otherwise(F.lit(0.0)).alias("v"))
    with pytest.raises(Exception, match="stop"):
        L.append(bad, path, ["a"])
    assert L.version(spark, path) == 1 and L.read_ledger(spark, path, SCHEMA).count() == 1
    assert L.append(frame(spark, [(5, "x", 1.0)]), path, ["a"]) == 2


def test_an_append_reads_only_files_that_may_hold_its_keys(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    for n in range(4):
        L.append(frame(spark, [(100 * n + i, "x", 0.0) for i in range(5)]).coalesce(1), path, ["a"])
    keys = frame(spark, [(203, "x", 0.0), (777, "x", 0.0)]).withColumn(L.HASH, F.xxhash64(F.col("a").isNull(), "a"))
    files = L.may_hold(spark, path, keys, 4)
    assert len(files) == 1 and {r.a for r in L.read_ledger(spark, path, SCHEMA, files=files).collect()} == {200, 201, 202, 203, 204}
    assert len(L.may_hold(spark, path, keys, 2)) == 0


def test_ledger_append_query(spark):
    import pyarrow.parquet as pq

    from tidemark.plans.ledger_queries import ledger_append

    sf = "/root/testdata/sf0.001"
    ids = {r["sale_id"] for r in pq.read_table(f"{sf}/sales.parquet", columns=["sale_id"]).to_pylist()}
    want = {i: 1 if i is None or i % 3 == 0 else 2 for i in ids if i is None or i % 3 == 0 or i % 2 == 0}
    got = ledger_append(spark, sf).collect()
    assert len(got) == len(want) and {r.sale_id: r.version for r in got} == want
