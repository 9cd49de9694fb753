"""Toxicity by a bag of subwords: character n-grams' vectors, averaged, into a linear softmax.

Vectors and softmax are trained together in numpy on the driver, from a bounded sample of labelled
documents. A misspelt word that was never seen shares most of its n-grams with the words it
stands for. Only the product of the two layers, a weight for each n-gram's bucket, goes to the
tasks, and texts are scored where they lie, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from .shared import columns

LEAST, MOST, BITS = 3, 5, 18
_PIECE = 1 << 20
_PRIME, _MIX = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)
#: 1 where a character of the basic plane belongs to a word; characters beyond it all do.
_WORD = np.array([chr(i).isalnum() for i in range(1 << 16)])


@dataclass
class Model:
    """Weights by n-gram bucket (vectors times softmax, label 1 against 0), a bias, and what calibrates them."""

    weights: np.ndarray
    bias: float


def _codes(text: str) -> np.ndarray:
    """Lower-case code points, 0 for whatever is no letter or digit, with a 0 at either end."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    out = np.zeros(len(c) + 2, np.uint64)
    out[1:-1] = np.where(_WORD[np.minimum(c, 0xFFFF)] | (c > 0xFFFF), c, 0)
    return out


def _pieces(codes: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first place, buckets, whether the place has an n-gram) for each length and stretch.

    An n-gram lies in one word; its first and last character may be the gaps around it.
    """
    for start in range(0, len(codes), _PIECE):
        c = codes[start : start + _PIECE + MOST - 1]
        inside, h = c != 0, c
        valid = None
        for n in range(2, MOST + 1):
            h = h[: len(h) - 1] * _PRIME + c[n - 1 :]
            if n > 2:
                valid = inside[1 : len(c) - n + 2] if valid is None else valid[: len(h)] & inside[n - 2 : n - 2 + len(h)]
            if n >= LEAST and len(h):
                own = min(len(h), _PIECE)
                yield start, (((h[:own] ^ np.uint64(n)) * _MIX) >> np.uint64(64 - BITS)).astype(np.int32), valid[:own]


def _sums(texts: list[str], weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each text the sum of its n-grams' weights and their number."""
    codes = [_codes(t) for t in texts]
    ends = np.cumsum([len(c) for c in codes])
    total, number = np.zeros(len(texts)), np.zeros(len(texts))
    if len(texts):
        for start, bucket, valid in _pieces(np.concatenate(codes)):
            at = np.nonzero(valid)[0]
            of = np.searchsorted(ends, at + start, "right")
            total += np.bincount(of, weights[bucket[at]], len(texts))
            number += np.bincount(of, minlength=len(texts))
    return total, number


def _matrix(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, buckets and shares of n-grams, one entry for each text and distinct bucket."""
    rows, cols, vals = [], [], []
    for i, t in enumerate(texts):
        found = [b[v] for _, b, v in _pieces(_codes(t))]
        if found and (n := sum(map(len, found))):
            col, count = np.unique(np.concatenate(found), return_counts=True)
            rows.append(np.full(len(col), i, np.int32))
            cols.append(col)
            vals.append((count / n).astype(np.float32))
    join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
    return join(rows, np.int32), join(cols, np.int32), join(vals, np.float32)


def _summed(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, starts) if len(values) else np.zeros(0, np.float32)


class _Sparse:
    """X (texts by n-grams) for products from either side."""

    def __init__(self, rows: np.ndarray, cols: np.ndarray, vals: np.ndarray, n: int) -> None:
        self.n, self.rows, self.cols, self.vals = n, rows, cols, vals
        self.have, self.starts = np.unique(rows, return_index=True)
        order = np.argsort(cols, kind="stable")
        self.t_rows, self.t_vals = rows[order], vals[order]
        self.m, self.t_starts = np.unique(cols[order], return_index=True)

    def dot(self, v: np.ndarray) -> np.ndarray:
        out = np.zeros(self.n, np.float32)
        out[self.have] = _summed(self.vals * v[self.cols], self.starts)
        return out

    def t_dot(self, v: np.ndarray, size: int) -> np.ndarray:
        out = np.zeros(size, np.float32)
        out[self.m] = _summed(self.t_vals * v[self.t_rows], self.t_starts)
        return out


def loss_and_gradients(x: _Sparse, y: np.ndarray, w: np.ndarray, vectors: np.ndarray, layer: np.ndarray, bias: np.ndarray, decay: float) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """Weighted cross-entropy of the softmax, and its gradients by vectors (n-grams x size), layer (size x 2) and bias."""
    both = vectors @ layer
    z = np.stack([x.dot(both[:, k]) for k in range(2)], 1) + bias
    z -= z.max(1, keepdims=True)
    p = np.exp(z)
    p /= p.sum(1, keepdims=True)
    loss = -(w * np.log(np.maximum(p[np.arange(len(y)), y], 1e-12))).sum() + decay / 2 * ((vectors**2).sum() + (layer**2).sum())
    g = p
    g[np.arange(len(y)), y] -= 1
    g *= w[:, None]
    back = np.stack([x.t_dot(np.ascontiguousarray(g[:, k]), len(vectors)) for k in range(2)], 1)
    return float(loss), back @ layer.T + decay * vectors, vectors.T @ back + decay * layer, g.sum(0)


def train(texts: list[str], labels: list[int], prior: float | None = None, size: int = 8, rounds: int = 120, rate: float = 0.05, scale: float = 100.0, decay: float = 2e-4, seed: int = 0) -> Model:
    """Fit by Adam on all texts at once, both classes with the same weight; every fifth text calibrates.

    prior: the share of label 1 where the model is used (default: that of labels). Without texts of
    both labels every text gets the prior. Shares of n-grams are multiplied by `scale`, so that few words
    in a long text can decide. N-grams of a single text have no vector.
    """
    y = np.array(labels, np.int64)
    prior = float(np.mean(y)) if prior is None and len(y) else prior or 0.0
    odds = lambda q: float(np.log(np.clip(q, 1e-6, 1 - 1e-6)) - np.log1p(-np.clip(q, 1e-6, 1 - 1e-6)))
    weights = np.zeros(1 << BITS, np.float32)
    held = np.zeros(len(y), bool)
    for k in (0, 1):  # every fifth of either label
        held[np.nonzero(y == k)[0][4::5]] = True
    if len(y) == 0 or not 0 < y[~held].mean() < 1:
        return Model(weights, odds(prior))
    rows, cols, vals = _matrix(texts)
    fit = ~held[rows]
    often = np.bincount(cols[fit], minlength=1 << BITS) > 1
    if not often.any():
        return Model(weights, odds(prior))
    keep, own = often[cols], np.cumsum(often) - 1
    rows, cols, vals = rows[keep], own[cols[keep]].astype(np.int32), vals[keep] * np.float32(scale)
    at = np.cumsum(~held) - 1
    fit = ~held[rows]
    x = _Sparse(at[rows[fit]].astype(np.int32), cols[fit], vals[fit], int((~held).sum()))
    mine = y[~held]
    w = np.where(mine == 1, 0.5 / (mine == 1).sum(), 0.5 / (mine == 0).sum()).astype(np.float32)
    rng = np.random.default_rng(seed)
    params = [(rng.standard_normal((int(often.sum()), size)) * 0.01).astype(np.float32), (rng.standard_normal((size, 2)) * 0.3).astype(np.float32), np.zeros(2, np.float32)]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, rounds + 1):
        _, *grads = loss_and_gradients(x, mine, w, *params, decay)
        for p, g, m, v in zip(params, grads, first, second):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    both = params[0] @ params[1]
    weights[often] = (both[:, 1] - both[:, 0]) * scale
    bias = float(params[2][1] - params[2][0])
    # Platt's scaling on the texts held back, at the prior's odds.
    rest = np.nonzero(held)[0]
    slope, shift = 1.0, odds(prior)
    if 0 < y[rest].mean() < 1 if len(rest) else False:
        total, number = _sums([texts[i] for i in rest], weights)
        slope, shift = _platt(total / np.maximum(number, 1) + bias, y[rest], prior)
    return Model(weights * np.float32(slope), bias * slope + shift)


def _platt(z: np.ndarray, y: np.ndarray, prior: float) -> tuple[float, float]:
    """Slope and shift of a logistic curve through z, the labels weighted to the prior and smoothed by one text each."""
    w = np.where(y == 1, prior / (y == 1).sum(), (1 - prior) / (y == 0).sum()) * len(y)
    ones, zeros = (y == 1).sum(), (y == 0).sum()
    target = np.where(y == 1, (ones + 1) / (ones + 2), 1 / (zeros + 2))
    centre, width = z.mean(), z.std() + 1e-9
    u = np.stack([(z - centre) / width, np.ones_like(z)], 1)
    beta = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(u @ beta, -30, 30)))
        h = (u * (w * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ u + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, u.T @ (w * (target - p)) - 1e-3 * beta)
        beta += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    slope = max(beta[0] / width, 0.0)
    return float(slope), float(beta[1] - slope * centre)


def fit(documents: DataFrame, labels: DataFrame, label_col: str = "toxic", most_rows: int = 1_500, most_chars: int = 200_000, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """A model from at most most_rows documents of either label, drawn by a hash of their ids.

    Longer documents than most_chars aren't learned from (their texts go to the driver). Null labels and
    ids, labels of no document and null texts are left out; labels other than 0 count as 1, and a
    document labelled twice counts twice. The ids drawn are broadcast: 2 x most_rows.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), (F.col(label_col) != 0).cast("int").alias("y"))
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    order = [F.xxhash64(F.lit("fit"), "id"), F.col("id")]
    drawn = known.where("y = 1").orderBy(*order).limit(most_rows).union(known.where("y = 0").orderBy(*order).limit(most_rows))
    found = documents.where(F.length(text_col) <= most_chars).select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    rows = found.join(F.broadcast(drawn), F.col("doc") == F.col("id")).select("doc", "y", "text").collect()
    rows.sort(key=lambda r: (r["doc"], r["y"], r["text"]))
    share = counts.get(1, 0) / max(1, sum(counts.values()))
    return train([r["text"] for r in rows], [r["y"] for r in rows], share)


def predict(documents: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """documents without the text, with score (0 to 1) and predicted (1 from `threshold` on).

    Null texts count as empty; a text without letters or digits gets the model's score for no
    evidence. Texts of any length are read whole, in stretches. Repeated rows are scored each, an
    empty table gives none, and columns named score or predicted are replaced.
    """
    spark = documents.sparkSession
    sent = spark.sparkContext.broadcast(model)
    keep = [c for c in documents.columns if c != text_col and c.lower() not in ("score", "predicted")]
    fields = [f for f in documents.schema.fields if f.name in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in batches:
            column = b.column(len(keep))
            total, number = np.zeros(len(column)), np.zeros(len(column))
            texts, lo = [t or "" for t in column.to_pylist()], 0
            while lo < len(texts):  # a few texts at a time, or one long one
                hi, chars = lo + 1, len(texts[lo])
                while hi < len(texts) and chars + len(texts[hi]) <= _PIECE:
                    chars += len(texts[hi])
                    hi += 1
                total[lo:hi], number[lo:hi] = _sums(texts[lo:hi], m.weights)
                lo = hi
            score = 1 / (1 + np.exp(-np.clip(total / np.maximum(number, 1) + m.bias, -500, 500)))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(score), pa.array((score >= threshold).astype(np.int32))], [*keep, "score", "predicted"])

    read = documents.select(*[c.alias(f"c{i}") for i, c in enumerate(columns([*keep, text_col]))])  # whatever characters names have
    return read.mapInArrow(run, StructType([*fields, StructField("score", DoubleType()), StructField("predicted", IntegerType())]))
