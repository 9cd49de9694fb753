import math

import numpy as np
import pytest

from tidemark.llm import ann as A

SCHEMA = "vec_id long, embedding array<float>, label int, score double, rank int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, None, 1) for i, v in rows], SCHEMA)


def brute(rows, k=20, every=20):
    ok = {}
    dims = max((len(v) for _, v in rows if v), default=0)
    for i, v in rows:
        if i is not None and v and len(v) == dims and all(x is not None and math.isfinite(x) for x in v) and any(v):
            v = [float(np.float32(x)) for x in v]
            ok[i] = min(ok.get(i, v), v)
    out = {}
    for i, q in ok.items():
        if i % every == 0:
            all_ = sorted((-math.fsum(a * b for a, b in zip(q, v)), j) for j, v in ok.items() if j != i)
            out[i] = [(j, -s) for s, j in all_[:k]]
    return out


def result(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


@pytest.mark.parametrize("shard_rows,query_rows", [(65_536, 4096), (100, 7)])
def test_recall_and_exact_scores(spark, shard_rows, query_rows):
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((12, 16))
    x = centres[rng.integers(0, 12, 1500)] * 0.5 + rng.standard_normal((1500, 16)) * rng.uniform(0.2, 3, (1500, 1))
    x[100:600] = x[100]  # one bucket holds a third of all rows
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(x)]
    want, got = brute(rows), result(A.nearest(frame(spark, rows), shard_rows=shard_rows, query_rows=query_rows))
    assert got.keys() == want.keys()
    scores = dict(rows)
    for q, found in got.items():
        assert len(found) == 20 and q not in dict(found)
        for j, s in found:
            assert s == pytest.approx(math.fsum(float(np.float32(a)) * float(np.float32(b)) for a, b in zip(scores[q], scores[j])), rel=1e-12)
        assert found == sorted(found, key=lambda x: (-x[1], x[0]))
    assert np.mean([len({j for j, _ in want[q]} & {j for j, _ in got[q]}) / 20 for q in want]) >= 0.9


def test_all_candidates_of_a_few_rows(spark):
    rng = np.random.default_rng(6)
    for n in (15, 21, 22, 40):
        rows = [(20 * i, rng.standard_normal(8).astype(np.float32).tolist()) for i in range(n)]
        got = result(A.nearest(frame(spark, rows), recall=0.1))
        assert all(len(found) == min(20, n - 1) for found in got.values()) and len(got) == n


def test_awkward_rows(spark):
    v = [1.0, 0.5, -2.0]
    rows = [(0, v), (1, v), (2, [0.0, 0.0, 0.0]), (3, None), (4, [1.0, None, 2.0]), (5, [math.nan, 1.0, 1.0]), (6, [math.inf, 1.0, 1.0]), (7, [1.0]), (20, [-1.0, 2.0, 3.0]), (None, v), (8, []), (40, [0.1, 0.2, 0.3])]
    assert result(A.nearest(frame(spark, rows))) == {q: [(j, pytest.approx(s)) for j, s in f] for q, f in brute(rows).items()}
    assert A.nearest(frame(spark, [])).collect() == []
    assert A.nearest(frame(spark, [(0, v)])).collect() == []


def test_rows_that_repeat_an_id_are_candidates_each(spark):
    rows = [(0, [1.0, 0.0, 0.0]), (1, [5.0, 0.0, 0.0]), (1, [9.0, 0.0, 0.0]), (2, [2.0, 0.0, 0.0]), (2, [2.0, 0.0, 0.0]), (20, [0.0, 3.0, 0.0]), (20, [0.0, 4.0, 0.0])]
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in A.nearest(frame(spark, rows)).collect())
    assert got[:6] == [(0, 1, 1, 9.0), (0, 2, 1, 5.0), (0, 3, 2, 2.0), (0, 4, 2, 2.0), (0, 5, 20, 0.0), (0, 6, 20, 0.0)]
    assert [g for g in got if g[0] == 20 and g[1] == 1] == [(20, 1, 20, 12.0)] * 2 and len(got) == 18


def test_recall_beside_tight_groups(spark):
    rng = np.random.default_rng(8)
    x = rng.standard_normal((4000, 32))
    centres = rng.standard_normal((20, 32))
    tight = rng.random(4000) < 0.7
    x[tight] = centres[rng.integers(0, 20, tight.sum())] + 1e-4 * rng.standard_normal((tight.sum(), 32))
    x = x.astype(np.float32)
    got = result(A.nearest(frame(spark, [(i, v.tolist()) for i, v in enumerate(x)])))
    share = {True: [], False: []}
    for q, found in got.items():
        scores = x.astype(float) @ x[q].astype(float)
        scores[q] = -np.inf
        share[bool(tight[q])].append(len(set(np.argsort(-scores)[:20].tolist()) & {j for j, _ in found}) / 20)
    assert np.mean(share[False]) >= 0.9 and np.mean(share[True]) >= 0.9


@pytest.mark.parametrize("norms", ["half noise", "log-normal"])
def test_recall_on_uneven_data(spark, norms):
    rng = np.random.default_rng(9)
    n = 12_000
    x = rng.standard_normal((n, 32))
    if norms == "half noise":
        groups = rng.standard_normal((60, 32))
        x[::2] = 3 * groups[rng.integers(0, 60, n // 2)] + 0.4 * rng.standard_normal((n // 2, 32))
    else:
        x *= rng.lognormal(0, 1, (n, 1))
        x[7] *= 100
    x = x.astype(np.float32)
    got = result(A.nearest(frame(spark, [(i, v.tolist()) for i, v in enumerate(x)])))
    share = []
    for q, found in got.items():
        scores = x.astype(float) @ x[q].astype(float)
        scores[q] = -np.inf
        share.append(len(set(np.argsort(-scores)[:20].tolist()) & {j for j, _ in found}) / 20)
    assert np.mean(share) >= 0.95 and np.mean(np.array(share) < 0.9) < 0.2
