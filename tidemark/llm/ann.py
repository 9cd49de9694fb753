"""Nearest neighbours by largest inner product: multiprobe p-stable hashing, exact reranking.

Rows are split by norm into ranges, each within a factor of two. A range's vectors become points
of a unit sphere in one more dimension, where the nearest point has the largest inner product.
Each table hashes a point to k cells floor((a x + b) / width), a normal and b uniform; cells
beyond +-CELLS / 2 belong to the outermost. For a neighbour at cosine c of a query, a x is normal
with mean c (a q) and variance 1 - c^2, so the chance that it lies in a bucket is known. Buckets
are visited in that order until their chances in all tables make the wanted recall.

c is a query's own: the inner product that its k-th neighbour reaches at least, over the range's
largest norm; a range that cannot reach it is not visited. That product comes from a bounded
sample first; each query then visits its likeliest buckets, and what it finds there tells what
the second, whole visit must reach.

Every row is indexed. Buckets of all tables are laid out over shards of about `shard_rows` rows,
large buckets over several. Queries go in blocks of about `query_rows`, by the bucket that they
lie in themselves, and rows go only to the blocks that ask for their shard; a task compares one
block with one shard, bucket by bucket, and returns the best of it for each query. Then
candidates of all tables are merged.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import written

CELLS = 4


def _normal_cdf(z: np.ndarray) -> np.ndarray:
    """To 1.5e-7: the rational approximation of the error function."""
    x = np.abs(z) / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * x)
    tail = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * np.exp(-x * x)
    return np.where(z < 0, tail / 2, 1 - tail / 2)


class Hashes:
    """The tables of every norm range; a code numbers a range, a table and a bucket."""

    def __init__(self, dims: int, mosts: list[float], tables: int, functions: int, width: float, seed: int) -> None:
        rng = np.random.default_rng(seed)
        self.dims, self.mosts, self.tables, self.functions = dims, np.array(mosts), tables, functions
        self.a = rng.standard_normal((tables, functions, dims + 1))
        self.b = rng.uniform(-width / 2, width / 2, (tables, functions))
        self.edges = (np.arange(1, CELLS) - CELLS / 2) * width
        self.buckets = CELLS**functions
        self.codes = len(mosts) * tables * self.buckets

    def first(self, r: int, t: int) -> int:
        return (r * self.tables + t) * self.buckets

    def _bucket(self, points: np.ndarray, t: int) -> np.ndarray:
        cells = np.searchsorted(self.edges, points @ self.a[t].T + self.b[t], side="right")
        out = np.zeros(len(points), np.int64)
        for f in range(self.functions):
            out = out * CELLS + cells[:, f]
        return out

    def row_codes(self, x: np.ndarray) -> np.ndarray:
        """A code for each row and table."""
        norm = np.sqrt((x * x).sum(axis=1))
        r = np.clip(np.searchsorted(-self.mosts, -norm, side="right") - 1, 0, len(self.mosts) - 1)
        unit = x / self.mosts[r][:, None]
        points = np.column_stack([unit, np.sqrt(np.maximum(0, 1 - (unit * unit).sum(axis=1)))])
        return np.stack([(r * self.tables + t) * self.buckets + self._bucket(points, t) for t in range(self.tables)], axis=1)

    def queries(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([x / np.linalg.norm(x, axis=1)[:, None], np.zeros(len(x))])

    def home(self, points: np.ndarray) -> np.ndarray:
        """The bucket of the first table that a query lies in itself."""
        return self._bucket(points, 0)

    def probes(self, point: np.ndarray, reached: float, recall: float, filled: np.ndarray, least: int) -> np.ndarray:
        """The codes to visit for neighbours of a product (by the unit query) of `reached` or more.

        At least buckets of the first table that have `least` rows (filled: their numbers by code).
        """
        wanted, out, rest = 1 - (1 - recall) ** (1 / self.tables), [], []
        held = 0
        for r, most in enumerate(self.mosts):
            cosine = min(max(reached, 0.0) / most, 1 - 1e-9)
            spread = math.sqrt(max(1e-12, 1 - cosine * cosine))
            for t in range(self.tables):
                mean = cosine * (self.a[t] @ point) + self.b[t]
                below = _normal_cdf((self.edges[None, :] - mean[:, None]) / spread)
                chance = np.diff(np.column_stack([np.zeros(len(below)), below, np.ones(len(below))]))
                whole = chance[0]
                for f in range(1, self.functions):
                    whole = (whole[:, None] * chance[f][None, :]).ravel()
                order = np.argsort(-whole, kind="stable")
                # A little more than the range's largest norm, for products that were rounded.
                stop = 0 if reached > most * (1 + 1e-9) else int(np.searchsorted(np.cumsum(whole[order]), wanted)) + 1
                out.append(self.first(r, t) + order[:stop])
                if t == 0:
                    held += int(filled[out[-1]].sum())
                    rest.append((self.first(r, 0) + order[stop:], whole[order[stop:]]))
        if held < least:
            codes, chances = (np.concatenate([x[n] for x in rest]) for n in (0, 1))
            codes = codes[np.argsort(-chances, kind="stable")]
            out.append(codes[: int(np.searchsorted(np.cumsum(filled[codes]), least - held)) + 1])
        return np.concatenate(out)


def _matrix(raw, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(raw), np.float64).reshape(-1, dims)


def _usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id, vec_id, vec (doubles), norm: the rows that take part, numbered by vec_id and then vector."""
    vec = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), vec.alias("vec")).where(F.col("vec_id").isNotNull() & F.col("vec").isNotNull() & (F.size("vec") > 0))
    rows = rows.where(finite).withColumn("norm", F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x))).where(F.col("norm") > 0)
    # Numbers rise with vec_id, so that ties by number are ties by vec_id.
    return rows.repartitionByRange("vec_id").sortWithinPartitions("vec_id", "vec").select(F.monotonically_increasing_id().alias("id"), "vec_id", "vec", "norm")


def nearest(
    vectors: DataFrame, k: int = 20, every: int = 20, recall: float = 0.95, tables: int = 4, functions: int = 6, width: float = 0.8, sample_rows: int = 8192, shard_rows: int = 65_536, query_rows: int = 16_384, ranges: int = 10, seed: int = 1, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest found of each query, nearest first.

    Queries are the rows whose id is divisible by `every`; candidates are all rows but the
    query's own. score is the inner product of the original vectors in double precision; ties
    go to the smaller id. A query visits at least k + 1 rows, or all if there are fewer.
    Rows with a null id, and vectors that are null, empty, zero or hold null or non-finite
    components, take no part; nor do vectors of another length than most have. Rows that
    repeat an id are rows of their own, each a candidate for the others, and each a query where its id is
    one. An empty table gives no rows.

    `recall` is the wanted share of true neighbours under the model above. What a query's k-th
    neighbour reaches is taken from `sample_rows` rows (bounded) and from the rows that its
    likeliest buckets hold; both are no nearer than the k-th of all rows, so the share found is
    larger rather than smaller. The last of `ranges` norm ranges has all smaller norms too.
    """
    spark = vectors.sparkSession
    out = "query_id long, rank int, vec_id long, score double"
    rows = written(_usable(vectors, id_col, vector_col), "vectors")
    sizes = rows.groupBy(F.size("vec").alias("dims")).agg(F.count(F.lit(1)).alias("n"), F.max("norm").alias("most")).orderBy(F.desc("n"), "dims").first()
    if sizes is None:
        return spark.createDataFrame([], out)
    dims, total = sizes.dims, sizes.n
    rows = rows.where(F.size("vec") == dims)
    halvings = F.least(F.greatest(F.floor(F.log2(F.lit(sizes.most) / F.col("norm"))), F.lit(0)), F.lit(ranges - 1)).cast("int")
    tops = rows.groupBy(halvings.alias("r")).agg(F.max("norm").alias("most")).orderBy(F.desc("most")).collect()  # `ranges` rows at most
    hashes = Hashes(dims, [t.most * (1 + 1e-12) for t in tops], tables, functions, width, seed)

    near = F.xxhash64("id").cast("double") / float(2**64) + 0.5 <= 1.2 * sample_rows / total
    taken = rows.where(near).orderBy(F.xxhash64("id"), "id").limit(sample_rows).select("id", "vec").collect()
    sampled = spark.sparkContext.broadcast((np.array([r.id for r in taken], np.int64), np.array([r.vec for r in taken], float).reshape(-1, dims)))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
                codes = pa.array(list(hashes.row_codes(x).astype(np.int32)), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([v.tobytes() for v in x]), codes, b.column(2)], ["id", "vec", "codes", "vec_id"])

    indexed = written(rows.select("id", "vec", "vec_id").mapInArrow(index, "id long, vec binary, codes array<int>, vec_id long"), "index")
    # ranges x tables x CELLS^functions buckets at most, whatever the rows: laid out over shards by their sizes.
    counts = indexed.select(F.explode("codes").alias("code")).groupBy("code").count().collect()
    homes, parts_of, filled_of, own_bit = (np.full(hashes.codes, x, np.int64) for x in (-1, 0, 0, 0))
    shard, filled, bit, shard_codes = 0, 0, 0, [[]]
    for code, n in sorted(map(tuple, counts)):
        parts = max(1, round(n / shard_rows))
        if filled and filled + n > shard_rows:
            shard, filled, bit = shard + 1, 0, 0
            shard_codes.append([])
        homes[code], parts_of[code], filled_of[code], own_bit[code] = shard, parts, n, bit
        shard_codes[shard].append(code)
        if parts > 1:
            shard_codes += [[code] for _ in range(parts - 1)] + [[]]
            shard, filled, bit = shard + parts, 0, 0
        else:
            filled, bit = filled + n, bit + 1
    shared = spark.sparkContext.broadcast((homes, parts_of, filled_of, own_bit, [np.array(c, np.int64) for c in shard_codes]))

    def asking(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each query with the product that its k-th neighbour in the sample reaches, and its own bucket."""
        names, points = sampled.value
        for whole in batches:
            for b in (whole.slice(i, 128) for i in range(0, whole.num_rows, 128)):
                x = _matrix(b.column(1).to_pylist(), dims)
                reached = np.full(len(x), -np.inf)
                if len(points) > k + 1:
                    found = x @ points.T
                    found[np.equal.outer(b.column(0).to_numpy(), names)] = -np.inf
                    reached = np.partition(found, -k, axis=1)[:, -k] / np.linalg.norm(x, axis=1)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(hashes.home(hashes.queries(x))), pa.array(reached), pa.array(np.linalg.norm(x, axis=1))], ["query", "vec", "home", "reached", "norm"])

    asked = written(indexed.where(F.col("vec_id") % every == 0).select("id", "vec").mapInArrow(asking, "query long, vec binary, home long, reached double, norm double"), "queries")
    at, place = 0, {}  # home -> its first block and how many it has: as many rows as a table has buckets
    for home, n in asked.groupBy("home").count().orderBy("home").collect():
        place[home] = (at // query_rows, max(1, math.ceil(n / query_rows)))
        at += max(n, (place[home][1] - 1) * query_rows + 1)

    def ask(batches: Iterator[pa.RecordBatch], buckets: int | None) -> Iterator[pa.RecordBatch]:
        """Rows for each query and shard that has buckets to visit: the `buckets` likeliest of a table, or all that recall asks for."""
        homes, parts_of, filled_of, own_bit, shard_codes = shared.value
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
        for whole in batches:
            for b in (whole.slice(i, 128) for i in range(0, whole.num_rows, 128)):
                ids, raws = b.column(0).to_pylist(), b.column(1).to_pylist()
                made = []
                for query, raw, point, home, reached in zip(ids, raws, hashes.queries(_matrix(raws, dims)), b.column(2).to_pylist(), b.column(3).to_pylist()):
                    codes = hashes.probes(point, reached, recall if buckets is None else 1e-9, filled_of, k + 1)
                    codes = codes[homes[codes] >= 0]
                    first, blocks = place[home]
                    block = first + query // every % blocks
                    n = parts_of[codes]
                    codes, shards = np.repeat(codes, n), np.repeat(homes[codes], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    order = np.argsort(shards, kind="stable")
                    names, starts = np.unique(shards[order], return_index=True)
                    for s, x in zip(names.tolist(), np.split(codes[order], starts[1:])):
                        bits = np.zeros(len(shard_codes[s]), np.uint8)
                        bits[own_bit[x] if len(bits) > 1 else 0] = 1
                        made.append((s, block, query, raw, np.packbits(bits).tobytes()))
                if made:
                    yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*made), kinds)], ["shard", "block", "query", "vec", "codes"])

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        homes, parts_of, *_ = shared.value
        for whole in batches:
            for b in (whole.slice(i, 4096) for i in range(0, whole.num_rows, 4096)):
                codes = b.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                ids = np.repeat(b.column(0).to_numpy(), tables)
                at = homes[codes] + ids % parts_of[codes]
                vec = b.column(1).take(pa.array(np.repeat(np.arange(b.num_rows), tables)))
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(codes.astype(np.int32)), pa.array(ids), vec], ["shard", "code", "id", "vec"])

    laid = indexed.mapInArrow(lay, "shard long, code int, id long, vec binary")
    none = pd.DataFrame({"query": np.array([], np.int64), "ids": np.array([], object), "scores": np.array([], object)})

    def compare(key: tuple, rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(asked):
            return none
        x, ids, code = _matrix(rows["vec"], dims), rows["id"].to_numpy(), rows["code"].to_numpy()
        order = np.argsort(code, kind="stable")
        x, ids, code = x[order], ids[order], code[order]
        starts = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
        stops = np.append(starts[1:], len(code))
        q, names = _matrix(asked["vec"], dims), asked["query"].to_numpy()
        visits = np.frombuffer(b"".join(asked["codes"]), np.uint8).reshape(len(asked), -1)
        bits = np.searchsorted(shared.value[4][int(key[0])], code[starts])
        # The best so far, and for each query the score that its k-th best has reached.
        found = np.array([], np.int64), np.array([], np.int64), np.array([])
        reached, hits, held = np.full(len(asked), -np.inf), [], 0

        def settle() -> None:
            nonlocal found, held
            who, row = (np.concatenate([h[n] for h in hits]) if hits else np.array([], np.int64) for n in (0, 1))
            other = ids[row] != names[who]
            who, row = who[other], row[other]
            exact = [(x[row[i : i + 8192]] * q[who[i : i + 8192]]).sum(axis=1) for i in range(0, len(row), 8192)]
            who, near, exact = np.concatenate([found[0], who]), np.concatenate([found[1], ids[row]]), np.concatenate([found[2], *exact])
            # Nearest first within each query; a row that several tables found counts once.
            order = np.lexsort((near, -exact, who))
            who, near, exact = who[order], near[order], exact[order]
            new = np.append(True, (who[1:] != who[:-1]) | (near[1:] != near[:-1]))[: len(who)]
            who, near, exact = who[new], near[new], exact[new]
            nth = np.arange(len(who)) - np.searchsorted(who, who)
            last = nth == k - 1
            # A product's last digits depend on its shape, so a little less than the k-th passes too.
            reached[who[last]] = exact[last] - 1e-9 * (1 + np.abs(exact[last]))
            best = nth < k
            found, held = (who[best], near[best], exact[best]), 0
            hits.clear()

        for a, b, bit in zip(starts.tolist(), stops.tolist(), bits.tolist()):
            all_who = np.flatnonzero(visits[:, bit >> 3] & (128 >> (bit & 7)))
            step = max(1, 4_000_000 // (b - a))
            for who in (all_who[i : i + step] for i in range(0, len(all_who), step)):
                row, col = np.nonzero(x[a:b] @ q[who].T >= reached[who])
                if len(row):
                    hits.append((who[col], row + a))
                    held += len(row)
                    if held > 100_000:
                        settle()
        settle()
        who, near, exact = found
        begins = np.flatnonzero(np.append(True, who[1:] != who[:-1])[: len(who)])
        made = [(names[who[a]], near[a:b], exact[a:b]) for a, b in zip(begins, np.append(begins[1:], len(who)))]
        return pd.DataFrame(made, columns=none.columns) if made else none

    def visited(queries: DataFrame, buckets: int | None) -> DataFrame:
        """query, vec_id, score: the best of each shard for each query."""
        wanted = written(queries.mapInArrow(lambda b: ask(b, buckets), "shard long, block int, query long, vec binary, codes binary"), "asked")
        pairs = written(wanted.select("shard", "block").distinct(), "pairs")
        parts = laid.join(pairs, "shard").groupBy("shard", "block").cogroup(wanted.groupBy("shard", "block")).applyInPandas(compare, "query long, ids array<long>, scores array<double>")
        return parts.select("query", F.inline(F.arrays_zip(F.col("ids").alias("vec_id"), F.col("scores").alias("score")))).distinct()

    nth = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    if total > sample_rows:
        # What the likeliest bucket of each range and table has reaches more than the sample, as the rows grow in number.
        kth = visited(asked, 1).withColumn("nth", nth).where(F.col("nth") == k).select("query", F.col("score").alias("kth"))
        kth = written(kth, "reached")
        asked = asked.join(kth, "query", "left").select("query", "vec", "home", F.greatest("reached", F.col("kth") / F.col("norm")).alias("reached"))
    found = visited(asked, None).withColumn("rank", nth).where(F.col("rank") <= k).select("query", "rank", F.col("vec_id").alias("row"), "score")
    names = indexed.select("id", "vec_id")
    queries = names.where(F.col("vec_id") % every == 0).select(F.col("id").alias("query"), F.col("vec_id").alias("query_id"))
    return found.join(queries, "query").join(names, F.col("row") == F.col("id")).select("query_id", "rank", "vec_id", "score")
