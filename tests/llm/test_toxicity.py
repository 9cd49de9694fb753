"""Subword toxicity: n-grams and gradients against plain versions, accuracy on documents never learned from."""

import random
import zlib

import numpy as np
import pytest

from tidemark.llm import toxicity as T
from tidemark.llm.queries import op12_toxicity

from .cases import SCHEMA, documents


def plain_grams(text):
    c = ["\0", *[x if x.isalnum() else "\0" for x in text.lower()], "\0"]
    out = []
    for n in range(T.LEAST, T.MOST + 1):
        for i in range(len(c) - n + 1):
            g = c[i : i + n]
            if "\0" not in g[1:-1]:
                h = ord(g[0])
                for x in g[1:]:
                    h = (h * 0x100000001B3 + ord(x)) % 2**64
                out.append(((h ^ n) * 0x9E3779B97F4A7C15 % 2**64) >> (64 - T.BITS))
    return out


@pytest.mark.parametrize("text", ["", "a", "Ab", "two words", "É1ß-x\n\nlong-ish wörds, 99!", "𝒳𝒴 z", " . "])
def test_ngrams(text):
    found = [x for _, b, v in T._pieces(T._codes(text)) for x in b[v].tolist()]
    assert sorted(found) == sorted(plain_grams(text))


def test_long_texts_are_read_whole_and_by_pieces(monkeypatch):
    weights = np.random.default_rng(1).standard_normal(1 << T.BITS).astype(np.float32)
    rng = random.Random(2)
    texts = ["".join(rng.choice("abcé .\n") for _ in range(n)) for n in (0, 3, 5000, 40, 20_000)]
    want = [(sum(float(weights[b]) for b in plain_grams(t)), len(plain_grams(t))) for t in texts]
    for piece in (T._PIECE, 64, 7):
        monkeypatch.setattr(T, "_PIECE", piece)
        total, number = T._sums(texts, weights)
        assert number.tolist() == [n for _, n in want]
        assert np.allclose(total, [s for s, _ in want], atol=1e-3)


def test_gradients():
    rng = np.random.default_rng(0)
    dense = rng.random((5, 7)) * (rng.random((5, 7)) < 0.6)
    dense[2] = 0
    r, c = np.nonzero(dense)
    x = T._Sparse(r.astype(np.int32), c.astype(np.int32), dense[r, c].astype(np.float32), 5)
    y, w = np.array([0, 1, 1, 0, 1]), np.full(5, 0.2, np.float32)
    params = [rng.standard_normal((7, 3)), rng.standard_normal((3, 2)), rng.standard_normal(2)]

    def loss(v, layer, b):
        z = dense @ v @ layer + b
        p = np.exp(z) / np.exp(z).sum(1, keepdims=True)
        return -(w * np.log(p[np.arange(5), y])).sum() + 0.05 * ((v**2).sum() + (layer**2).sum())

    value, *grads = T.loss_and_gradients(x, y, w, *params, 0.1)
    assert abs(value - loss(*params)) < 1e-4
    for k, g in enumerate(grads):
        for i in np.ndindex(params[k].shape):
            up, down = [p.copy() for p in params], [p.copy() for p in params]
            up[k][i] += 1e-5
            down[k][i] -= 1e-5
            assert abs((loss(*up) - loss(*down)) / 2e-5 - g[i]) < 1e-3


def made(rng, n, bad):
    words = [a + b + c for a in "ka lo mi ne tu".split() for b in "ra so vel dim".split() for c in "n st el".split()]
    out = [rng.choice(words) for _ in range(n)]
    for b in bad:
        out.insert(rng.randrange(len(out)), b)
    return " ".join(out)


def test_unseen_misspellings():
    rng = random.Random(4)
    bad = ["horrible", "disgraceful", "scoundrel"]
    texts = [made(rng, rng.randint(20, 60), [rng.choice(bad) for _ in range(3)] if i % 3 == 0 else []) for i in range(600)]
    m = T.train(texts, [int(i % 3 == 0) for i in range(600)])
    score = lambda t: 1 / (1 + np.exp(-(T._sums([t], m.weights)[0] / max(1, T._sums([t], m.weights)[1][0]) + m.bias)))[0]
    wrong = ["horible", "disgracefull", "scoundrell", "horriblle", "scoundral", "disgraceful1"]
    assert sum(score(made(rng, 40, rng.sample(wrong, 3))) >= 0.3 for _ in range(50)) >= 48
    assert sum(score(made(rng, 40, [])) >= 0.3 for _ in range(100)) <= 3


def test_without_both_labels():
    assert T.train([], []).weights.any() == 0
    m = T.train(["a b", "c"], [0, 0], 0.0)
    assert not m.weights.any() and m.bias < -10
    assert T.train(["aaa", "bbb"], [1, 0], 0.5).bias == 0


def test_awkward_rows(spark):
    docs = documents(spark)
    labels = docs.selectExpr("doc_id", "CAST(doc_id % 2 AS INT) AS toxic")
    model = T.fit(docs, labels.union(labels))
    out = T.predict(docs, model).collect()
    assert len(out) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) and r.key == "z" for r in out)
    nothing = {r.score for r in out if r.doc_id in (200, 201, 202, 203)}
    assert len(nothing) == 1
    assert T.predict(docs.limit(0), model).collect() == []
    clash = T.predict(docs.selectExpr("doc_id", "text", "'x' AS Score", "doc_id AS `we``ird.name`"), model)
    assert clash.columns == ["doc_id", "we`ird.name", "score", "predicted"] and clash.count() == len(out)
    empty = T.fit(spark.createDataFrame([], SCHEMA), labels.limit(0))
    assert not empty.weights.any()


def test_query_on_documents_held_out(spark):
    sf = "/root/testdata/sf0.1"
    got = {r.doc_id: r for r in op12_toxicity(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert len(got) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    truth = [(got[r.doc_id].predicted, r.toxic) for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if got[r.doc_id].held_out]
    hit = sum(p and t for p, t in truth)
    assert hit / sum(t for _, t in truth) >= 0.85 and hit / sum(p for p, _ in truth) >= 0.75
