"""Segmented scans against plain windows, and how long keys are dealt out."""

import random
from decimal import Decimal

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import scan as S
from tidemark.operators.scan import Series, scanned


def rows(spark, seed, n=600):
    rng = random.Random(seed)
    keys = [*["hot"] * 12, "a", "b", None, None]
    data = [(rng.choice(keys), rng.choice([None, *range(40)]), i, rng.choice([None, 1, 2, 5, -3]), rng.choice([None, "x", "y", "zz"])) for i in range(n)]
    return spark.createDataFrame(data, "k string, t int, id long, v long, s string").repartition(3)


def scans():
    return {
        "sum_in": S.total(F.col("v")), "sum_ex": S.total(F.col("v"), False), "n": S.number(), "max_in": S.most(F.col("v")), "max_ex": S.most(F.col("v"), False),
        "last_in": S.last(F.col("s")), "last_ex": S.last(F.col("s"), False), "lag1": S.shifted(F.col("s")), "lag4": S.shifted(F.col("v"), 4), "lead1": S.shifted(F.col("v"), -1), "lead3": S.shifted(F.col("s"), -3),
    }


def windows(df, key, order):
    w = Window.partitionBy(*(key or (F.lit(0),))).orderBy(*order)
    upto, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    return df.select(
        "*", F.sum("v").over(upto).alias("sum_in"), F.sum("v").over(before).alias("sum_ex"), F.row_number().over(w).alias("n"), F.max("v").over(upto).alias("max_in"), F.max("v").over(before).alias("max_ex"),
        F.last("s", True).over(upto).alias("last_in"), F.last("s", True).over(before).alias("last_ex"), F.lag("s").over(w).alias("lag1"), F.lag("v", 4).over(w).alias("lag4"), F.lead("v").over(w).alias("lead1"), F.lead("s", 3).over(w).alias("lead3"),
    )


@pytest.mark.parametrize("key, segment_rows", [(("k",), 7), (("k",), 10_000), ((), 150), (("k", "s"), 1)])
def test_segments_give_what_windows_give(spark, key, segment_rows, monkeypatch):
    monkeypatch.setattr(S, "LEAST_BYTES", 0)
    df = rows(spark, segment_rows)
    got = scanned(df, Series(key, ("t", "id"), segment_rows), scans())
    want = windows(df, key, ["t", "id"])
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.select(*got.columns).collect()))
    if key == ("k",):
        assert (S._cuts(df, Series(key, ("t", "id"), segment_rows)) is None) == (segment_rows == 10_000)


def test_one_key_is_many_tasks(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", 32)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        df = spark.range(1_000_000).select(F.lit("one").alias("k"), (F.col("id") * 7919 % 1_000_003).alias("t"), F.col("id").alias("v"))
        got = scanned(df, Series(("k",), ("t",), 50_000), {"total": S.total(F.col("v")), "n": S.number()})
        tasks = got.groupBy(F.spark_partition_id().alias("task")).agg(F.count("total").alias("count"), F.max("n")).collect()
        assert len(tasks) >= 8 and max(r["count"] for r in tasks) < 300_000
        last = got.orderBy(F.desc("t")).first()
        assert (last.n, last.total) == (1_000_000, 999_999 * 500_000)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_empty_and_short(spark, monkeypatch):
    monkeypatch.setattr(S, "LEAST_BYTES", 0)
    df = rows(spark, 1)
    assert scanned(df.limit(0), Series(("k",), ("t", "id"), 1), scans()).collect() == []
    with pytest.raises(ValueError):
        S.shifted(F.col("v"), 0)


def same(a, b, near=False):
    key = lambda r: tuple((x is None, round(x, 7) if near and isinstance(x, float) else x) for x in r)
    assert sorted(map(repr, map(key, a.collect()))) == sorted(map(repr, map(key, b.select(*a.columns).collect())))


def polls(spark):
    rng = random.Random(8)
    rows = []
    for i in range(300):
        seen = 1_704_067_200 + i * 3600
        price = Decimal(rng.choice([100, 100, 100, 101, 102]))
        rows.append((rng.choice(["hot"] * 5 + ["b"]), i, price, rng.choice(["VALID"] * 6 + ["QUARANTINED"]), seen - rng.choice([0, 3600, 86_400, -60]) if rng.random() < 0.8 else None, seen, rng.choice(["x", None]), rng.random() < 0.1, rng.random() < 0.7, rng.random() < 0.4, rng.random() < 0.1))
    df = spark.createDataFrame(rows, "k string, row_id int, price decimal(14,2), status string, p long, o long, raw_time string, in_memory boolean, benchmark boolean, clock_only boolean, closed boolean")
    return df.withColumn("published", F.timestamp_seconds("p")).withColumn("observed", F.timestamp_seconds("o")).drop("p", "o")


def test_operators_over_segments(spark, monkeypatch):
    """Revisions, audits, dispositions, ridge sums and as-of joins: cut series give what whole ones give."""
    from tidemark.operators import forecast, ledger, series
    from tidemark.operators.asof import asof_join

    df = rows(spark, 3).withColumn("x", F.col("v") * 0.5 + F.sin("id")).withColumn("y", F.cos("id")).cache()
    sig, explicit = F.coalesce("s", F.lit("none")), F.col("v").isNotNull()
    p = polls(spark).cache()
    left, right = df.select("k", "t", "id"), df.select("k", F.col("t").alias("rt"), F.col("id").alias("rid"), "s")

    def results(n):
        yield series.revision_chain(df.where("v IS NOT NULL"), ["k"], ["t", "id"], "v", "id", segment_rows=n), False
        yield series.sequence_audit(df, ["k"], ["t", "id"], explicit, sig, F.col("id") % 7 == 0, F.col("id") % 3 == 0, segment_rows=n), False
        yield ledger.disposed(p, ["k"], segment_rows=n), False
        yield forecast.ridge_one(df, Series(("k",), ("t", "id"), n), "x", "y", 3).select("id", "n_train", "prediction"), True
        yield forecast.ridge_many(df, Series(("k",), ("t", "id"), n), ["x", "v"], "y", 3).select("id", "n_train", "prediction", "up_score"), True
        yield asof_join(left, right, ["k"], "t", "rt", ["rid", "s"], strict=True, tie=["rid"], segment_rows=n), False
        yield asof_join(left, right, [], "t", "rt", ["rid"], tie=["rid"], segment_rows=n), False

    whole = list(results(10**9))
    monkeypatch.setattr(S, "LEAST_BYTES", 0)
    for (a, near), (b, _) in zip(results(40), whole, strict=True):
        same(a, b, near)


def test_ties_of_an_asof_join_have_their_own_order(spark):
    from tidemark.operators.asof import asof_join

    left = spark.createDataFrame([(1, 10)], "k int, t int")
    for kind, ids, wins in (("long", [9, 10, None], 10), ("long", [-9, -10, -2], -2), ("double", [1.5, 10.25, 9.75], 10.25), ("string", ["9", "10"], "9"), ("decimal(9,2)", [Decimal("9.50"), Decimal("10.00")], Decimal("10.00"))):
        right = spark.createDataFrame([(1, 5, i) for i in ids], f"k int, rt int, seq {kind}")
        for more in ({}, {"chunk_seconds": 3}, {"segment_rows": 1}):
            if "chunk_seconds" in more:
                l, r = left.withColumn("t", F.timestamp_seconds("t")), right.withColumn("rt", F.timestamp_seconds("rt"))
            else:
                l, r = left, right
            assert [x.seq for x in asof_join(l, r, ["k"], "t", "rt", ["seq"], tie=["seq"], **more).collect()] == [wins]


def test_intermediate_tables_are_the_applications_own(spark):
    from tidemark.sources import io

    kept = io.materialised(spark.range(3))
    assert spark.sparkContext.applicationId in io.scratch(spark) and kept.count() == 3
    assert io.exists(spark, io.scratch(spark))
    io.purge(spark)
    assert not io.exists(spark, io.scratch(spark))


def test_hindsight_ranks(spark, monkeypatch):
    """Distinct times after the origin and up to generation; nulls and reversed times know nothing, cut or not."""
    from tidemark.operators import state

    rng = random.Random(2)
    pubs = [(rng.choice(["hot", "hot", "b", None]), rng.choice([None, *range(60)])) for _ in range(150)]
    asks = [(i, rng.choice(["hot", "hot", "b", "c", None]), rng.choice([None, *range(60)]), rng.choice([None, *range(60)]), rng.randint(1, 3)) for i in range(120)]
    p = spark.createDataFrame(pubs, "k string, ts int")
    f = spark.createDataFrame(asks, "id long, k string, origin_ts int, generated_ts int, h int")
    want = {i: len({t for c, t in pubs if c == k and t is not None and o < t <= g}) if None not in (k, o, g) and g > o else 0 for i, k, o, g, _ in asks}
    for rows in (10**9, 20):
        if rows == 20:
            monkeypatch.setattr(S, "LEAST_BYTES", 0)
        got = state.insert_violations(f, p, ["k"], segment_rows=rows).collect()
        assert {r.id: r.known_after for r in got} == want and len(got) == len(asks)
        for r in got:
            early = None not in (r.origin_ts, r.generated_ts) and r.generated_ts < r.origin_ts
            assert r.violation == ("GENERATED_BEFORE_ORIGIN" if early else "HINDSIGHT" if want[r.id] >= r.h else None)
