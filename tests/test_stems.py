"""Stems of long texts are looked for in their first characters, with the same outcome as in the whole."""

import random

from tidemark.functions import text as T


def test_stem_of_a_head_is_that_of_the_whole(spark):
    rng = random.Random(7)
    words = ["gold", "may", "mayor", "a-b-c", "12.5%", "x9y", "the", "$1,200", "friday", "today's", "und", "...", "märz", "monday-may"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(40))) for _ in range(300)]
    df = spark.createDataFrame([(t,) for t in texts], "n string")
    rows = df.select(T.stem_of("n", 10**6).alias("whole"), *[T.stem_of("n", h).alias(f"h{h}") for h in (1, 20, 45, 46, 47, 60, 90)]).collect()
    assert all(len(set(r)) == 1 for r in rows) and len({r.whole for r in rows}) > 100


def test_texts_are_cut_into_words_once(spark):
    """The plan behind story clusters normalises a text in one place."""
    from tidemark.operators import stories

    df = spark.createDataFrame([(1, "Gold rises", None)], "id long, t string, ts timestamp")
    plan = stories._described(df, "t", "ts", "id", ())._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("[-|–—]") == 1
