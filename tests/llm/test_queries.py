"""Queries with SQL against it, and the pipeline's stages against plain versions."""

import collections

import pytest

import corpus_pipeline as C
from tests.oracle import difference, tables
from tidemark.llm.mixing import mix
from tidemark.llm.queries import ORACLES, QUERIES

from .cases import SCHEMA, documents, texts
from .test_simhash import brute_components, brute_fingerprint

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, name):
    assert difference(QUERIES[name](spark, SF), ORACLES[name], tables(SF)) == ""


def key(rows):
    return sorted(map(repr, rows))


def test_awkward_rows_of_exact_dedup(spark):
    from tidemark.llm.exact_dedup import exact_dedup

    rows = texts()
    strip = lambda t: "".join(c for c in t or "" if c not in " \t\n\x0b\x0c\r")
    groups = collections.defaultdict(list)
    for i, t, *_ in rows:
        groups[strip(t)].append((-len(t or ""), i is None, i))
    for support in (0.001, 0.2):  # with and without groups split off
        got = exact_dedup(documents(spark, rows), support).collect()
        want = [(i, min(groups[strip(t)])[2], len(groups[strip(t)])) for i, t, *_ in rows]
        assert key((r.doc_id, r.keep_id, r.group_size) for r in got) == key(want)
        assert sum(r.kept for r in got) == len(groups)
    assert exact_dedup(spark.createDataFrame([], SCHEMA)).collect() == []


def brute_lines(rows, least=10):
    k = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    seen = collections.defaultdict(set)
    for i, t, *_ in rows:
        for x in (t or "").split("\n"):
            seen[k(x)].add((i, t))
    drop = {x for x, docs in seen.items() if x and len(docs) >= least}
    return [(i, t, "\n".join(x for x in (t or "").split("\n") if k(x) not in drop)) for i, t, *_ in rows]


def test_frequent_values_below_one_summarys_support(spark):
    """Every value above the share is named, whether it is above what one summary can see or not."""
    from pyspark.sql import functions as F

    from tidemark.llm.shared import frequent

    # one value has half of all rows, twenty have 60 each (a share of 3e-5), the others one each
    rows = spark.range(2_000_000).select(F.when(F.col("id") % 2 == 0, F.lit(-1)).when(F.col("id") < 2400, F.col("id") % 40 - 100).otherwise(F.col("id")).alias("v"))
    found = {r.v for r in frequent(rows, "v", 2e-5).collect()}
    assert {-1, *range(-99, -59, 2)} <= found and len(found) <= 2 / 2e-5


@pytest.mark.parametrize("support", [1e-5, 0.001, 0.05])
def test_awkward_rows_of_line_dedup(spark, support):
    from tidemark.llm.line_dedup import line_dedup

    rows = texts()
    got = line_dedup(documents(spark, rows), support=support).collect()
    assert key((r.doc_id, r.text, r.kept_text) for r in got) == key(brute_lines(rows))
    assert all(r.n_lines == len((r.text or "").split("\n")) and r.key == "z" for r in got)
    assert line_dedup(spark.createDataFrame([], SCHEMA)).collect() == []


def brute_targets(sizes, weights=(1, 2, 3), most=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        rest, left = total - sum(fixed.values()), sum(w[s] for s in names if s not in fixed)
        over = [s for s in names if s not in fixed and w[s] * rest / left > most * sizes[s]] if left else []
        if not over:
            return {s: fixed.get(s, w[s] * rest / left if left else 0) for s in names}
        fixed |= {s: most * sizes[s] for s in over}


def test_awkward_rows_of_mixing(spark):
    rows = texts()
    got = mix(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    by = collections.defaultdict(list)
    for r in got:
        by[r.source].append(r)
    sizes = {s: sum(r.size for r in x) for s, x in by.items()}
    want = brute_targets(sizes)
    for s, x in by.items():
        assert x[0].target == pytest.approx(want[s]) and x[0].source_size == sizes[s]
        assert sum(r.taken for r in x) == int(x[0].target + 1e-9) and all(0 <= r.taken <= 3 * r.size for r in x)
    assert key(got) == key(mix(documents(spark, rows).repartition(7)).collect())
    assert mix(spark.createDataFrame([], SCHEMA)).collect() == []


def test_pipeline_stages(spark):
    docs = documents(spark).cache()
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in docs.collect()]
    kept = C.lines(spark, docs, "")
    assert kept.columns == docs.columns
    want = {(i, t): k for i, t, k in brute_lines(rows)}
    assert key((r.doc_id, r.text) for r in kept.collect()) == key((i, None if t is None else want[i, t]) for i, t, *_ in rows)

    near = C.near_duplicates(spark, docs, "")
    assert near.columns == docs.columns
    parts = brute_components([(i, brute_fingerprint(t)) for i, t, *_ in rows])
    ids = [c for _, _, c in parts]
    got = near.collect()
    fps = {brute_fingerprint(r.text): r.doc_id for r in got}
    assert len(got) == len(fps) and all(i in ids for i in fps.values())
    named = {fp: c for _, fp, c in parts}
    assert all(named[fp] == i for fp, i in fps.items())
    assert {(c, tuple(sorted(fp for _, fp, d in parts if d == c))) for c in ids if c is not None and ids.count(c)} and len(got) >= len(set(ids))

    mixed = C.mix(spark, docs, "")
    assert mixed.columns == docs.columns
    times = collections.Counter((r.doc_id, r.text, r.source) for r in mixed.collect())
    taken = collections.defaultdict(int)
    for r, t in zip(*(sorted(x, key=repr) for x in ([(r.doc_id, r.source, r.size, r.taken) for r in mix(docs).collect()], [()] * len(rows)))):
        taken[r[0], r[1]] += 0 if not r[2] else (2 * r[3] + r[2]) // (2 * r[2])
    assert {k: v for k, v in taken.items() if v} == dict(sum((collections.Counter({(i, s): n}) for (i, _, s), n in times.items()), collections.Counter()))


def test_pipeline_run(spark):
    out = C.run(spark, SF)
    assert out.count() > 0 and "ids_crc32" in out.columns


def test_empty_tables_and_stages(spark):
    """Every stage makes an empty table of the same columns of one."""
    import corpus_pipeline as C

    empty = spark.createDataFrame([], SCHEMA)
    for name, stage in C.STAGES:
        out = stage(spark, empty, "")
        assert out.count() == 0
        if name != C.STAGES[-1][0]:
            assert out.columns == empty.columns


def test_mixed_rows_against_a_plain_pass(spark):
    """Every source is read in the order of its keys until its budget is used up; reruns agree."""
    import hashlib

    from tidemark.llm.mixing import mixed

    rows = texts()
    runs = [mixed(documents(spark, some).repartition(n)).collect() for some, n in ((rows, 1), (rows[::-1], 3))]
    assert key((r.doc_id, r.text, r.source) for r in runs[0]) == key((r.doc_id, r.text, r.source) for r in runs[1])
    size = lambda t: len([w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in t or "").split(" ") if w])
    sizes = collections.Counter()
    for _, t, _, source in rows:
        sizes[source] += size(t)
    targets = brute_targets(sizes)
    want = collections.Counter()
    for source in sizes:
        mine = sorted((hashlib.md5(f"mix:{'null' if i is None else i}".encode()).hexdigest(), i is None, i or 0, size(t), t) for i, t, _, s in rows if s == source)
        passes, rest = divmod(int(targets[source] + 1e-9), sizes[source]) if sizes[source] else (0, 0)
        for _, none, i, n, t in mine:
            part = max(0, min(n, rest))
            rest -= part
            want[(None if none else i, n, source)] += passes + (2 * part >= n) if n else 0
    got = collections.Counter((r.doc_id, size(r.text), r.source) for r in runs[0])
    assert {k: v for k, v in want.items() if v} == dict(got)
