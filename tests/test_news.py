"""Category features against a count of all pairs, and how their work grows."""

import math
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import news

T0 = datetime(2024, 3, 1)
ARTICLES = "published timestamp, score double, primary string, supporting array<string>, us double, geopolitical double, india double, is_gold boolean"


def articles(n, rng):
    kinds = [c for k, *_ in news.CATEGORY_FEATURES.values() for c in k]
    pick = lambda: rng.choice(kinds)
    return [
        (None if i % 41 == 7 else T0 + timedelta(minutes=rng.randrange(4000)), None if i % 9 == 0 else math.inf if i == 11 else math.nan if i == 13 else rng.uniform(-1e6, 1e6) if i % 2 else rng.random(), None if i % 13 == 0 else pick(),
         None if i % 17 == 0 else [pick(), pick()], rng.random(), rng.random(), None if i % 5 == 0 else rng.random(), rng.choice([True, False, None]))
        for i in range(n)
    ]


@pytest.mark.parametrize("segment_rows", [1_000_000, 20])
def test_category_features_against_all_pairs(spark, segment_rows, monkeypatch):
    from tidemark.operators import scan

    monkeypatch.setattr(scan, "LEAST_BYTES", 0)
    rng = random.Random(3)
    told = articles(300, rng)
    events = [(i, None if i == 5 else T0 + timedelta(minutes=rng.randrange(-10, 5000))) for i in range(80)]
    events += [(None, T0 + timedelta(minutes=900)), *[(100 + i, told[i][0] + timedelta(minutes=d)) for i in (1, 2) for d in (0, 1440)], *[(110 + i, told[i][0] + timedelta(minutes=1440, microseconds=1)) for i in (1, 2)]]
    want = {}
    for i, at in events:
        if i is None:
            continue
        near = [a for a in told if at and a[0] and timedelta(0) <= at - a[0] <= timedelta(days=1)]
        want[i] = want.get(i, []) + near  # rows that repeat an id share their articles
    df = spark.createDataFrame(events, "id long, t timestamp")
    got = news.category_features(df, spark.createDataFrame(told, ARTICLES), "id", "t", segment_rows=segment_rows).collect()
    assert sorted(str(r.id) for r in got) == sorted(str(i) for i, _ in events)

    def mean(rows):
        scores = [a[1] for a in rows if a[1] is not None]
        return sum(scores) / len(scores) if scores else None

    def like(x, y):
        return x is y if x is None or y is None else x == y or math.isnan(x) and math.isnan(y) or abs(x - y) < 1e-4

    for r in got:
        near = want.get(r.id, [])
        gold = [a for a in near if a[7]]
        assert (r.articles, r.gold_count) == (len(near), len(gold)) and like(r.gold_mean, mean(gold)), r
        for name, (kinds, dimension, least, wants_mean) in news.CATEGORY_FEATURES.items():
            at = {None: None, "us": 4, "geopolitical": 5, "india": 6}[dimension]
            of = [a for a in near if a[2] in kinds or set(a[3] or ()) & set(kinds) or at and a[at] is not None and a[at] >= least]
            assert r[f"{name}_count"] == len(of), (r, name)
            assert not wants_mean or like(r[f"{name}_mean"], mean(of)), (r, name)


def test_category_features_pair_nothing(spark):
    """The largest number of rows that any join or generator of the plan makes is that of the rows, twice each."""
    rng = random.Random(4)
    n = 400
    told = spark.createDataFrame([(T0, *a[1:]) for a in articles(n, rng)], ARTICLES)
    df = spark.range(n).select("id", F.lit(T0).alias("t"))
    out = news.category_features(df, told, "id", "t")
    assert {r.articles for r in out.collect()} == {n}
    plan, seen = [out._jdf.queryExecution().executedPlan()], []
    while plan:
        p = plan.pop()
        name = p.nodeName()
        if name.startswith("AdaptiveSparkPlan"):
            plan.append(p.executedPlan())
            continue
        if "QueryStage" in name:
            plan.append(p.plan())
            continue
        if "numOutputRows" in (keys := str(p.metrics().keys())) and keys:
            seen.append(p.metrics().apply("numOutputRows").value())
        kids = p.children()
        plan += [kids.apply(i) for i in range(kids.size())]
    assert seen and max(seen) <= 4 * n
