import math
import random
from collections import Counter, defaultdict

import numpy as np

from tidemark.llm import langid as L

from .cases import SCHEMA, documents, texts


def brute_model(words):
    """Interpolated Kneser-Ney in plain dictionaries."""
    pad = " " * (L.ORDER - 1)
    top = Counter()
    for w, n in words.items():
        s = f"{pad}{w} "
        for i in range(L.ORDER - 1, len(s)):
            top[s[i - L.ORDER + 1 : i + 1]] += n
    levels = {L.ORDER: top}
    for k in range(L.ORDER - 1, 0, -1):
        levels[k] = Counter(g[1:] for g in levels[k + 1])
    stats = {}
    for k, c in levels.items():
        n1, n2 = sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values())
        d = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
        total, taken = defaultdict(float), defaultdict(float)
        for g, v in c.items():
            total[g[:-1]] += v
            taken[g[:-1]] += min(d, v)
        stats[k] = c, d, total, taken

    def p(g):
        if not g:
            return 1 / L._UNSEEN
        c, d, total, taken = stats[len(g)]
        if g[:-1] not in total:
            return p(g[1:])
        return max(c[g] - d, 0) / total[g[:-1]] + taken[g[:-1]] / total[g[:-1]] * p(g[1:])

    def score(w):
        s = f"{pad}{w} "
        return sum(math.log2(p(s[i - L.ORDER + 1 : i + 1])) for i in range(L.ORDER - 1, len(s)))

    return score


def test_probabilities_against_plain_dictionaries():
    rng = random.Random(2)
    words = Counter("".join(rng.choice("abcdé") for _ in range(rng.randint(1, 7))) for _ in range(300))
    asked = [*list(words)[:40], "zzz", "abz", "a", "éé", "aaaaaaaaaa"]
    want, got = brute_model(words), L.log_probability(L.train(words), asked)
    assert np.allclose(got, [want(w) for w in asked])


def test_letters():
    assert L.letters("Ab ab, c3d ½ x½y _z_") == Counter({"ab": 2, "c": 1, "d": 1, "xy": 1, "z": 1})


def test_held_out_accuracy_and_rejection(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").selectExpr("*", "crc32(cast(doc_id as string)) % 4 = 2 AS held")
    models = L.fit(docs.where("not held"))
    rows = L.predict(docs, models).collect()
    held = [r for r in rows if r.held and len(r.text) > 20]
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.97
    assert np.mean([r.rejected for r in rows]) < 0.01
    junk = spark.createDataFrame([("qzxj wkvq xxqz jjzk qpwz zzxq vvkw " * 20,), ("12 34 ...",), (None,)], "text string")
    assert all(r.rejected for r in L.predict(junk, models).collect())


def test_awkward_rows(spark):
    docs = documents(spark)
    models = L.fit(docs)
    rows = L.predict(docs, models).collect()
    assert len(rows) == len(texts()) and rows[0].key == "z"
    for r in rows:
        assert 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or ""))
        assert r.lang_pred in ("und", "en", "fr")
    empty = spark.createDataFrame([], SCHEMA)
    assert L.fit(empty) == {} and L.predict(empty, {}).count() == 0
    assert {r.lang_pred for r in L.predict(docs, {}).collect()} == {"und"}
    kept = L.predict(docs, models, accepted_only=True)
    assert kept.columns == docs.columns and kept.count() == sum(not r.rejected for r in rows)


def test_predictions_against_dictionaries(spark):
    """The language of whole texts is that of the least cross-entropy by plain dictionaries."""
    rng = random.Random(8)
    alphabets = {"aa": "abcde ", "bb": "cdefg ", "cc": "efgha "}
    text = lambda k, n: "".join(rng.choice(alphabets[k]) for _ in range(n))
    rows = [(i, text(k, rng.randint(40, 200)), k) for i, k in enumerate(list(alphabets) * 25)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    fitted = L.fit(docs)
    plain = {}
    for k in alphabets:
        words = Counter()
        for _, t, lang in rows:
            if lang == k:
                words.update(L.letters(t))
        plain[k] = brute_model(words)
    asked = [(i, text(rng.choice("abc") * 2, 60) + text(rng.choice("abc") * 2, rng.randint(0, 300))) for i in range(40)]
    got = {r.doc_id: r for r in L.predict(spark.createDataFrame(asked, "doc_id long, text string"), fitted).collect()}
    for i, t in asked:
        found = L.letters(t)
        n = sum((len(w) + 1) * c for w, c in found.items())
        bits = {k: -sum(score(w) * c for w, c in found.items()) / n for k, score in plain.items()}
        assert got[i].lang_pred == min(bits, key=bits.get) and math.isclose(got[i].bits, min(bits.values()), rel_tol=1e-9)


def test_many_languages_and_wrong_labels(spark):
    rng = random.Random(3)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(5))
    rows = [(i, " ".join(word(f"{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}xyz") for _ in range(30)), f"l{i:03}") for i in range(600)]
    assert len(L.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4), most_rows=1)) == 600
    # A few wrong labels leave the bound where it was: texts of no language still go.
    good = [(i, " ".join(word("aeinrst") for _ in range(60)), "en") for i in range(200)]
    junk = [(1000 + i, " ".join(word("qxzjkw") for _ in range(60)), "en") for i in range(4)]
    fitted = L.fit(spark.createDataFrame(good + junk, "doc_id long, text string, lang string"))
    asked = spark.createDataFrame([("щюя " * 60,), (" ".join(word("aeinrst") for _ in range(60)),)], "text string")
    assert [r.rejected for r in L.predict(asked, fitted).collect()] == [True, False]
    # The bound on characters keeps the first document of a language, however long.
    long = [(1, "abc " * 5_000, "aa"), (2, "xyz " * 5_000, "aa")]
    assert set(L.fit(spark.createDataFrame(long, "doc_id long, text string, lang string"), most_chars=100)) == {"aa"}
