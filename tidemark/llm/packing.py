"""Order-preserving packing by dynamic programming.

Each partition's documents form one token stream in their stored order; texts never shuffle.
Windows of at most `size` tokens are cut at document or sentence ends so that padding plus
penalties is least. With p the cut positions and f the least cost up to a cut,

    f(j) = penalty(j) + size - p(j) + min over p(i) >= p(j) - size of f(i) + p(i)

is a sliding-window minimum, kept in a monotone queue: linear in the number of cuts. Windows
whose length is a power of two need no padding and are tried too, at a charge for being short.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import body
from .tokens import default_vocabulary, tokens

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def best_cuts(cuts: np.ndarray, penalty: np.ndarray, size: int, short: int) -> list[int]:
    """The chosen ones of the cut positions (ascending, cuts[0] = 0, gaps of at most size)."""
    p = cuts.tolist()
    pen = penalty.tolist()
    source, target = [], []
    for s in (1 << k for k in range(size.bit_length() - 1)):
        i = np.searchsorted(cuts, cuts - s)
        j = np.flatnonzero((cuts >= s) & (cuts[np.minimum(i, len(cuts) - 1)] == cuts - s))
        source.append(i[j])
        target.append(j)
    target = np.concatenate(target)
    order = np.argsort(target, kind="stable")
    source = np.concatenate(source)[order].tolist()
    until = np.searchsorted(target[order], np.arange(len(p)), side="right").tolist()
    whole = size & (size - 1) == 0
    f = [0] * len(p)
    back = [0] * len(p)
    queue: deque[tuple[int, int, int]] = deque([(0, 0, 0)])  # (f + p, p, index), rising
    at = until[0]
    for j in range(1, len(p)):
        here = p[j]
        least = here - size
        while queue[0][1] < least:
            queue.popleft()
        best, _, i = queue[0]
        best += size - here
        while at < until[j]:
            k = source[at]
            if whole and f[k] + short < best:
                best, i = f[k] + short, k
            at += 1
        best += pen[j]
        f[j] = best
        back[j] = i
        best += here
        while queue and queue[-1][0] >= best:
            queue.pop()
        queue.append((best, here, j))
    chosen = [len(p) - 1]
    while chosen[-1]:
        chosen.append(back[chosen[-1]])
    return [p[i] for i in reversed(chosen)]


class Packer:
    """Packs a stream of (doc_id, ids), block by block; a block's last window goes on into the next."""

    def __init__(self, ends: np.ndarray, size: int, block: int, sentence: int, hard: int, short: int, first_sequence: int) -> None:
        self.ends, self.size, self.block, self.short = ends, size, block, short
        self.sentence, self.hard = sentence, hard
        self.sequence = first_sequence
        self.parts: list[tuple[int | None, int, int, np.ndarray]] = []  # doc_id, start, doc_tokens, ids
        self.held = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> Iterator[tuple]:
        self.parts.append((doc_id, 0, len(ids), ids))
        self.held += len(ids)
        if self.held >= self.block:
            yield from self.flush(False)

    def flush(self, last: bool = True) -> Iterator[tuple]:
        if not self.parts:
            return
        ids = np.concatenate([x[3] for x in self.parts])
        starts = np.cumsum([0] + [len(x[3]) for x in self.parts])
        cost = np.full(len(ids) + 1, -1)
        cost[1:][self.ends[np.minimum(ids, len(self.ends) - 1)]] = self.sentence
        cost[starts] = 0
        cuts = np.flatnonzero(cost >= 0)
        wide = np.flatnonzero(np.diff(cuts) > max(1, self.size // 16))
        for a, b in zip(cuts[wide], cuts[wide + 1]):  # no sentence end for long
            step = max(1, self.size // 64)
            cost[np.arange(a + step, b, step)] = self.hard
        cuts = np.flatnonzero(cost >= 0)
        windows = best_cuts(cuts, cost[cuts], self.size, self.short)
        if not last:
            windows = windows[:-1] if len(windows) > 2 else windows[:1]
        stop = windows[-1]
        edges = np.unique(np.concatenate([starts[starts <= stop], windows]))
        part = np.searchsorted(starts, edges[:-1], side="right") - 1
        window = np.searchsorted(windows, edges[:-1], side="right") - 1
        raw = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
        for a, b, k, w in zip(edges[:-1].tolist(), edges[1:].tolist(), part.tolist(), window.tolist()):
            doc_id, start, n, _ = self.parts[k]
            yield doc_id, start + a - int(starts[k]), b - a, zlib.crc32(raw[4 * a : 4 * b]), n, self.sequence + w, a - windows[w], ids[a:b]
        self.sequence += len(windows) - 1
        k = int(np.searchsorted(starts, stop, side="right")) - 1
        rest = self.parts[k:] if k < len(self.parts) else []
        if rest and (gone := stop - int(starts[k])):
            doc_id, start, n, own = rest[0]
            rest[0] = (doc_id, start + gone, n, own[gone:])
        self.parts, self.held = rest, len(ids) - stop


def pack(
    docs: DataFrame, size: int = 2048, end_id: int = 1, vocabulary: str | None = None, block: int = 1 << 18, sentence: int = 4, hard: int = 64, short: int = 128, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids).

    A document is its text's ids and then end_id, so null and empty texts have one id. Every
    id lies in one piece; a sequence's pieces are gapless from offset 0. Cuts inside a
    document cost `sentence` at a sentence end and `hard` in a stretch that has none for a
    sixteenth of a window; a window of a power of two below `size` costs `short`. Cuts are chosen over blocks of about `block`
    tokens, which bounds memory; the last window of a block is chosen again with the next.
    Repeated rows and null ids are documents of their own. An empty table gives no rows. Each
    partition is a stream of its own: a table that is split otherwise gives other sequences.
    """
    path = vocabulary or default_vocabulary()
    names = [x.split()[0] for x in SCHEMA.split(", ")] + ["ids"] * with_ids
    kinds = [pa.int64()] * 7 + [pa.list_(pa.int64())] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens(path)
        packer = Packer(encode.ends, size, block, sentence, hard, short, TaskContext.get().partitionId() << 40)

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows))
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

        rows: list[tuple] = []
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
                rows += packer.add(doc_id, np.append(encode.ids(text.as_py()), np.uint32(end_id)))
                if len(rows) >= 10_000:
                    yield batch(rows)
                    rows = []
        rows += packer.flush()
        if rows:
            yield batch(rows)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), body(text_col).alias("text")).mapInArrow(run, SCHEMA + ", ids array<long>" * with_ids)
