"""Language ID by interpolated Kneser-Ney character models, one for each language.

A model reads a word at a time: lower-cased letters between word boundaries, with up to
ORDER - 1 characters of context inside the word. So a word's log probability is its own and
is looked up once while it is cached; a text's is the sum over its words. Each order is two
sorted arrays of 64-bit hashes: n-grams with their discounted probabilities and contexts with
their interpolation weights.

The language with the least cross-entropy per character wins. Rejection is calibrated on
documents held out from each model's counts.
"""

from __future__ import annotations

import pickle
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import columns, written

ORDER = 5
WORD = re.compile(r"[^\W\d_]+")
UNDETERMINED = "und"
_PRIME = np.uint64(0x9E3779B97F4A7C15)
#: A character that no model has seen is one of so many.
_UNSEEN = 5_000


def letters(text: str) -> Counter:
    """Words of letters, lower-cased, with their numbers."""
    found = Counter(WORD.findall(text.lower()))
    for w in [w for w in found if not w.isalpha()]:  # number signs such as ½ count as word characters
        n, w = found.pop(w), "".join(c for c in w if c.isalpha())
        if w:
            found[w] += n
    return found


def _grams(words: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
    """Hashes of the n-grams that end at each predicted character, by order, and each one's word.

    Entry 0 is the empty n-gram; the context of an n-gram is the entry before it, one back.
    """
    pad = " " * (ORDER - 1)
    text = "".join(f"{pad}{w} " for w in words)
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + ORDER
    word = np.repeat(np.arange(len(words)), lengths)
    inside = np.arange(len(codes)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    hashes = [np.zeros(len(codes), np.uint64)]
    with np.errstate(over="ignore"):
        for _ in range(ORDER):
            before = np.concatenate([hashes[-1][:1] * 0, hashes[-1][:-1]])
            hashes.append((before + codes) * _PRIME)
    predicted = inside >= ORDER - 1
    contexts = [np.concatenate([h[:1] * 0, h[:-1]])[predicted] for h in hashes]
    return [h[predicted] for h in hashes] + contexts, word[predicted]


def train(words: Counter) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """By order from 1: n-grams, discounted probabilities, contexts, weights of the lower order."""
    names = list(words)
    found, word = _grams(names)
    grams, contexts = found[: ORDER + 1], found[ORDER + 1 :]
    times = np.fromiter(words.values(), np.float64, len(words))[word]
    model = []
    for k in range(ORDER, 0, -1):
        keys, first, which = np.unique(grams[k], return_index=True, return_inverse=True)
        if k == ORDER:
            count = np.bincount(which, times)
        else:  # of how many different longer n-grams it is the end
            longer, one = np.unique(grams[k + 1], return_index=True)
            count = np.bincount(which[one], minlength=len(keys)).astype(np.float64)
        once, twice = (count == 1).sum(), (count == 2).sum()
        discount = once / (once + 2 * twice) if once and twice else 0.5
        held, of = np.unique(contexts[k - 1][first], return_inverse=True)
        total, kinds = np.bincount(of, count), np.bincount(of)
        model.append((keys, (count - np.minimum(discount, count)) / total[of], held, np.bincount(of, np.minimum(discount, count)) / total))
    return model[::-1]


def log_probability(model: list, words: list[str]) -> np.ndarray:
    """Base-2 log probability of each word with its closing boundary."""
    found, word = _grams(words)
    grams, contexts = found[: ORDER + 1], found[ORDER + 1 :]
    p = np.full(len(word), 1 / _UNSEEN)
    for k, (keys, share, held, weight) in enumerate(model, 1):
        i = np.minimum(np.searchsorted(held, contexts[k - 1]), len(held) - 1)
        w = np.where(held[i] == contexts[k - 1], weight[i], 1.0)
        i = np.minimum(np.searchsorted(keys, grams[k]), len(keys) - 1)
        p = np.where(keys[i] == grams[k], share[i], 0.0) + w * p
    return np.bincount(word, np.log2(p), minlength=len(words))


def _entropy(model: list, found: Counter) -> tuple[float, int]:
    """Cross-entropy in bits a character, and characters (each word's boundary counts)."""
    n = sum((len(w) + 1) * c for w, c in found.items())
    bits = -(log_probability(model, list(found)) * np.fromiter(found.values(), np.float64, len(found))).sum()
    return bits / max(n, 1), n


def _fit(texts: list[str]) -> bytes:
    """A model with its rejection bound: most + slack / sqrt(characters).

    `most` lies 2.5 bits a character above the level of the documents held out, or a quarter above
    19 of 20 of the longer ones if that is more; the slack clears 19 of 20 short ones twice. So a
    few mislabelled documents do not lift the bound.
    """
    docs = [c for c in map(letters, texts) if c]
    seen, apart = Counter(), []
    for i, c in enumerate(docs):
        if i % 5:
            seen.update(c)
        else:
            apart.append(c)
    most = slack = np.inf
    if seen and apart:
        tried = train(seen)
        held = np.array([_entropy(tried, c) for c in apart])
        level = np.median(np.repeat(held[:, 0], np.maximum(1, held[:, 1] // 100).astype(int)))
        wide = held[:, 1] >= 100
        most = max(level + 2.5, 1.25 * np.quantile(held[wide, 0], 0.95) if wide.any() else 0.0)
        slack = max(10.0, 2 * np.quantile((held[:, 0] - most) * np.sqrt(held[:, 1]), 0.95))
    for c in apart:
        seen.update(c)
    return pickle.dumps((train(seen) if seen else None, float(most), float(slack)))


class Models:
    """The languages' models, and the scores of the words met, cached up to a bound."""

    def __init__(self, fitted: dict[str, bytes], most_cached: int = 200_000) -> None:
        loaded = {k: pickle.loads(v) for k, v in sorted(fitted.items())}
        loaded = {k: v for k, v in loaded.items() if v[0]}
        self.languages = list(loaded)
        self.models = [m for m, _, _ in loaded.values()]
        self.most = np.array([x for _, x, _ in loaded.values()])
        self.slack = np.array([x for _, _, x in loaded.values()])
        self.bound, self.rows = most_cached, {}
        self.scores = np.zeros((0, len(self.languages)))

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, float | None, bool]]:
        """language, score, bits a character, rejected."""
        found = [letters(t) if t else Counter() for t in texts]
        if not self.languages:
            return [(UNDETERMINED, 0.0, None, not c) for c in found]
        new = list(set().union(*found).difference(self.rows)) if found else []
        if len(self.rows) + len(new) > self.bound:
            self.rows, self.scores = {}, self.scores[:0]
            new = list(set().union(*found))
        for i in range(0, len(new), 50_000):
            part = new[i : i + 50_000]
            self.scores = np.concatenate([self.scores, np.stack([log_probability(m, part) for m in self.models], axis=1)])
            for w in part:
                self.rows[w] = len(self.rows)
        out = []
        for c in found:
            if not c:
                out.append((UNDETERMINED, 0.0, None, True))
                continue
            times = np.fromiter(c.values(), np.float64, len(c))
            n = float((np.fromiter(map(len, c), np.float64, len(c)) + 1) @ times)
            bits = -(times @ self.scores[np.fromiter(map(self.rows.__getitem__, c), np.int64, len(c))]) / n
            best = int(np.argmin(bits))
            share = 1 / np.exp2(-(bits - bits[best]) * min(n, 40.0)).sum()
            out.append((self.languages[best], float(share), float(bits[best]), bool(bits[best] > self.most[best] + self.slack[best] / np.sqrt(n))))
        return out


def fit(docs: DataFrame, most_rows: int = 400, most_chars: int = 4_000_000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, bytes]:
    """Models by language, of every language there is, from at most `most_rows` documents of each and,
    beyond the first of these, at most `most_chars` characters.

    The sample is those of smallest xxhash64(id), text: whole texts of rows with a text and a
    language; repeated rows count as often as they are there. What reaches the driver is the
    models, whose size these bounds limit for each language. Null texts and languages are left
    out, texts without letters teach nothing, and an empty table gives no models.
    """
    docs = docs.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(F.col(id_col)).alias("at"))
    docs = docs.where(F.col("text").isNotNull())
    # First a share of the hashes that holds a little more than enough, then exactly enough.
    # A written table's size is known, so its join broadcasts it only if it is small.
    counts = written(docs.groupBy("lang").count(), "languages")
    near = F.least(F.lit(1.0), F.lit(1.5 * most_rows) / F.col("count"))
    first = docs.join(counts, "lang").where((F.col("at").cast("double") / float(2**64) + 0.5) <= near)
    order = Window.partitionBy("lang").orderBy("at", "text")
    chars = F.sum(F.length("text")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    sample = first.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= most_rows)
    sample = sample.withColumn("chars", chars).where((F.col("nth") == 1) | (F.col("chars") <= most_chars)).select("lang", "text", "nth")

    def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"lang": [key[0]], "model": [_fit(rows.sort_values("nth")["text"].tolist())]})

    return {r.lang: bytes(r.model) for r in sample.groupBy("lang").applyInPandas(one, "lang string, model binary").collect()}


def predict(docs: DataFrame, fitted: dict[str, bytes], text_col: str = "text", keep: list[str] | None = None, accepted_only: bool = False) -> DataFrame:
    """The columns in `keep` (default: all), with lang_pred, score (0 to 1), bits and rejected,
    which replace columns of these names.

    lang_pred is a learned language, or `und` with score 0 (and rejected) where the text is
    null or has no letter; ties go to the first language by name. bits is the cross-entropy
    per character. Only the text is read. Whole texts count, however long, and every row is
    judged by itself, repeated ones too. An empty table gives no rows; with nothing learned
    every row is `und`, and only rows without letters are rejected. With accepted_only rejected rows and the added columns go.
    """
    from pyspark.sql.types import StructType

    added = () if accepted_only else ("lang_pred", "score", "bits", "rejected")
    names = [n for n in (docs.columns if keep is None else keep) if n not in added]
    rows = docs.select(*columns(names), F.col(text_col).cast("string").alias("text to judge"))
    kept = StructType([rows.schema[c] for c in names])
    out = kept if accepted_only else StructType([*kept.fields]).add("lang_pred", "string").add("score", "double").add("bits", "double").add("rejected", "boolean")
    shared = docs.sparkSession.sparkContext.broadcast(fitted)
    fields = [pa.string(), pa.float64(), pa.float64(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = Models(shared.value)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                said = models.predict(b.column(b.num_columns - 1).to_pylist())
                columns = b.columns[:-1]
                if accepted_only:
                    yield pa.RecordBatch.from_arrays(columns, list(out.names)).filter(pa.array([not x[3] for x in said]))
                else:
                    yield pa.RecordBatch.from_arrays([*columns, *(pa.array(c, k) for c, k in zip(zip(*said), fields))], list(out.names))

    return rows.mapInArrow(run, out)
