"""Items against stored headlines: a comparison of all with all, and rows that grow with headlines and not with pairs of them."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import stories

T0 = datetime(2024, 1, 1)
ITEMS, KNOWN, STORED = "row_id long, url string, title string, ts timestamp", "url string, cluster_id string", "row_id long, cluster_id string, title string, ts timestamp"


def told(spark, rows):
    """What texts are compared by: key, words of the key, telling tokens, direction."""
    df = spark.createDataFrame([(r,) for r in rows], "t string").distinct().withColumn("s", F.coalesce("t", F.lit("")))
    tells, way = T.telling(T.token_set(F.col("s")))
    df = df.select("t", T.cluster_key(F.col("s")).alias("key"), T.key_set(T.cluster_key(F.col("s"))).alias("small"), tells.alias("tells"), way.alias("way"))
    return {r.t: (r.key, frozenset(r.small), tuple(r.tells), r.way) for r in df.collect()}


def by_pairs(items, stored, said, hours, least):
    out = {}
    for i, _, title, ts in items:
        (key, small, tells, way), best = said[title], None
        for _, c, title2, ts2 in stored:
            key2, small2, tells2, way2 = said[title2]
            if ts is None or ts2 is None or abs(ts - ts2) > timedelta(hours=hours) or tells != tells2 or way * way2 < 0:
                continue
            score = 1.0 if key == key2 else len(small & small2) / len(small | small2) if small and small2 else 0.0
            if score >= least and (best is None or (score, ts2) > best[:2] or (score, ts2) == best[:2] and c < best[2]):
                best = (score, ts2, c)
        out[i] = best and best[2]
    return out


def texts(rng, n):
    """Headlines of one to eight words, some without any token and of one to ten words, each with near copies."""
    words = "metal market quiet traders wait mint bazaar buyers x gold rises falls 12 Gold, in".split()
    bare = "the ... of !? and -- in to the-of (or) ## by with".split()
    pool = [" ".join(rng.choice(w) for _ in range(rng.randint(1, most))) for w, most, k in ((words, 8, 16), (bare, 10, 10)) for _ in range(k)]
    out = []
    for _ in range(n):
        w = rng.choice(pool).split()
        if rng.random() < 0.6:
            w[rng.randrange(len(w))] = rng.choice(words if w[0] in words else bare)
        out.append(rng.choice([" ".join(w), "  ".join(w), " ".join(w) + " - Wire", None, " "]) if rng.random() < 0.3 else " ".join(w))
    return out


@pytest.mark.parametrize(("seed", "hours", "least"), [(1, 36, 0.70), (2, 60, 0.50), (3, 24, 0.80)])
def test_stored_clusters_against_all_pairs(spark, seed, hours, least):
    rng = random.Random(seed)
    at = lambda: None if rng.random() < 0.03 else T0 + timedelta(hours=rng.randrange(120), microseconds=rng.choice([0, 0, 1]))
    items = [(i, f"u{i}", t, at()) for i, t in enumerate(texts(rng, 220))]
    stored = [(i, f"c{i}", t, at()) for i, t in enumerate(texts(random.Random(seed), 220))]
    got = stories.resolved(spark.createDataFrame(items, ITEMS), spark.createDataFrame([("u7", "s7")], KNOWN), spark.createDataFrame(stored, STORED), hours, least).collect()
    want = by_pairs(items, stored, told(spark, [t for _, _, t, _ in items + stored]), hours, least)
    assert {r.row_id: (r.cluster_id, r.how) for r in got} == {i: ("s7", "URL") if i == 7 else (c, "MATCH" if c else "NEW") for i, c in want.items()}
    assert len(got) == len(items) and sum(c is not None for c in want.values()) > 60


def test_near_copies_look_as_often_however_many_are_stored(spark, monkeypatch):
    """n items and n stored headlines of one group of near copies, each another by one word: n times the same number of looks."""
    looks, real = [], stories.asof_join

    def counted(left, right, *args):
        looks.append((left.count(), right.count()))
        return real(left, right, *args)

    monkeypatch.setattr(stories, "asof_join", counted)
    for n in (60, 240):
        items = spark.createDataFrame([(i, f"u{i}", f"mint says metal traders wait new{'abc'[i % 3] * (i + 2)}", T0 + timedelta(minutes=i)) for i in range(n)], ITEMS)
        stored = spark.createDataFrame([(i, f"c{i}", f"mint says metal traders wait old{'xyz'[i % 3] * (i + 2)}", T0 + timedelta(seconds=i)) for i in range(n)], STORED)
        got = stories.resolved(items, spark.createDataFrame([], KNOWN), stored).collect()
        assert {(r.cluster_id, r.how) for r in got} == {(f"c{n - 1}", "MATCH")}
    assert looks[1][0] <= 4 * looks[0][0] and looks[1][1] <= 4 * looks[0][1] and looks[0][0] <= 14 * 60


def test_loose_headlines_squeeze_to_normal_ones(spark):
    ws = [" ", "  ", "\t", " \n ", " ", "\x0b"]
    rng = random.Random(5)
    rows = ["".join(rng.choice(["Gold", "ΟΔΟΣ", "Σ", "İI", "K", "rises", "-", "|", "Reuters", "12%", "É"]) + rng.choice(ws) for _ in range(rng.randint(0, 9))) for _ in range(300)]
    n, w = T.normal_headline(F.col("t")), T.loose_headline(F.col("t"))
    df = spark.createDataFrame([(r,) for r in rows], "t string").select(n.alias("n"), T.squeezed(w).alias("s"), T.tokens(n).alias("a"), T.tokens(w).alias("b"))
    assert all(r.n == r.s and r.a == r.b for r in df.collect())
