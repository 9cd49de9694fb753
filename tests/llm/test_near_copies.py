import itertools
import random

import corpus_pipeline as C
from tidemark.llm import near_copies as N

from .cases import SCHEMA, documents, texts


def brute_set(text, width=5):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    return frozenset(" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))) if words else frozenset()


def brute_kept(rows):
    """Sets of each group's smallest id."""
    sets = [brute_set(t) for _, t, *_ in rows]
    group = list(range(len(rows)))
    for a, b in itertools.combinations(range(len(rows)), 2):
        x, y = sets[a], sets[b]
        if group[a] != group[b] and (x == y or len(x & y) / len(x | y) >= 0.8):
            group = [group[a] if g == group[b] else g for g in group]
    least = {}
    for (i, *_), g in zip(rows, group):
        least[g] = min(least.get(g, (True, 0)), (i is None, i or 0))
    return sorted(least.values())


def variants():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(3000)]
    passage = [rng.choice(words) for _ in range(60)]
    out = []
    for i in range(20):  # pairs with two to seven changed words: similarity about 0.7 to 0.9
        base = [rng.choice(words) for _ in range(200)]
        other = list(base)
        for at in range(2 + i % 6):
            other[20 + 25 * at] = "new"
        out += [base, other]
    chain = [rng.choice(words) for _ in range(300)]
    for i in range(60):  # each like its neighbours, the ends unlike
        chain = [*chain[8:], *(rng.choice(words) for _ in range(8))]
        out.append(chain)
    out += [passage + [rng.choice(words) for _ in range(60)] for _ in range(60)]  # a common passage is no copy
    return [(10_000 + i, " ".join(w), "en", "a") for i, w in enumerate(out)]


def test_stage_against_brute_force(spark):
    rows = texts() + variants()
    near = dict(C.STAGES)["simhash_near_dedup"](spark, documents(spark, rows), "")
    assert near.columns == documents(spark).columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in near.collect()) == brute_kept(rows)
    assert N.one_of_near(spark.createDataFrame([], SCHEMA)).collect() == []


def test_larger_buckets(spark, monkeypatch):
    monkeypatch.setattr(N, "SMALL", 2)
    rows = texts() + variants()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in N.one_of_near(documents(spark, rows)).collect()) == brute_kept(rows)


def test_blocks(spark, monkeypatch):
    """Buckets over SMALL in several blocks on either side, by number and by size."""
    monkeypatch.setattr(N, "SMALL", 1)
    rows = texts() + variants()
    for block, hashes in ((7, 10**9), (10**9, 2_000)):
        monkeypatch.setattr(N, "BLOCK", block)
        monkeypatch.setattr(N, "BLOCK_HASHES", hashes)
        assert sorted((r.doc_id is None, r.doc_id or 0) for r in N.one_of_near(documents(spark, rows)).collect()) == brute_kept(rows)


def test_shared_counts():
    import numpy as np

    rng = random.Random(6)
    sets = [np.array(sorted(rng.sample(range(5_000), rng.randint(0, 900))), np.int64) for _ in range(30)]
    got = N.shared_counts(sets[:12], sets[12:])
    assert got.tolist() == [[len(set(a.tolist()) & set(b.tolist())) for b in sets[12:]] for a in sets[:12]]


def test_rows_that_differ_in_other_columns(spark):
    rows = [(1, "one two three four five six", "en", s) for s in "bcadb"]
    kept = {N.one_of_near(documents(spark, some)).collect()[0].source for some in (rows, rows[::-1], rows[2:] + rows[:2])}
    assert len(kept) == 1


def test_fingerprints_bring_copies_together_without_bands(spark):
    """SimHash's own step: texts whose fingerprints are equal or within two bits meet, and whole sets decide."""
    from pyspark.sql import functions as F

    from tidemark.llm import simhash

    rng = random.Random(8)
    base = [f"word{rng.randrange(5000)}" for _ in range(900)]
    told = [" ".join(base), " ".join([*base[:-1], "other"]), " ".join(["first", *base[1:]]), " ".join(f"else{rng.randrange(5000)}" for _ in range(900))]
    fps = [simhash.majority([N.shingles(t.encode())]) for t in told]
    assert all(0 <= (fps[0] ^ f).bit_count() <= simhash.RADIUS for f in fps[:3])
    docs = spark.createDataFrame(list(enumerate(told)), "doc_id long, text string")
    rows = docs.select("doc_id", *N.row_key("doc_id", "text"), F.col("text").cast("binary").alias("text"))
    nodes = rows.mapInArrow(N._signatures, "doc_id long, k1 long, k2 long, node long, n int, bands array<long>, fp long").withColumn("bands", F.array().cast("array<long>"))
    of, roots = {r.node: r.doc_id for r in nodes.collect()}, N._roots(docs, nodes, "doc_id", "text").collect()
    assert {of[r.node] for r in roots} == {0, 1, 2} and len({r.root for r in roots}) == 1
