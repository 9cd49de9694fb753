"""SimHash near-dedup by covering locality-sensitive hashing.

Texts become 64-bit fingerprints, read once; only (id, fingerprint) goes on. Fingerprints
link at RADIUS or fewer differing bits. For radius r every bit gets a vector of r + 1 bits;
each of the 2^(r+1) - 1 non-zero directions masks the bits whose vector has odd product with
it. At most r differing bits span at most r dimensions, so some direction is orthogonal to
all of them and its table has both fingerprints in one bucket: no pair is missed.

Equal fingerprints are one node, so copies never pair. Buckets of a few nodes are compared in
place. Nodes of larger buckets are dealt out to the values within one bit of them instead: two
nodes within two bits meet at some value, a value has at most 65 nodes, and a star links them,
so work stays linear however large a bucket is. Components come from min-label hooking with
pointer jumping; every round is a table in the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import body, one_row_each, row_key, written

RADIUS = 2
BITS = 64
SEED = 42
#: Buckets of up to so many nodes are compared pair by pair, larger ones by neighbour values. Both find
#: every pair within RADIUS or a path of such pairs, so the components don't depend on this number.
SMALL = 16


def covering_masks(radius: int = RADIUS, bits: int = BITS) -> list[int]:
    """The 2^(radius+1) - 1 masks, as signed 64-bit numbers."""
    vectors = [1 + i % (2 ** (radius + 1) - 1) for i in range(bits)]
    masks = [sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() % 2) for v in range(1, 2 ** (radius + 1))]
    return [m - (m >> 63 << 64) for m in masks]


def majority(chunks: Iterable[np.ndarray]) -> int:
    """The bits that are set in over half of all hashes; zero without hashes."""
    ones, n = np.zeros(BITS, np.int64), 0
    for h in chunks:
        ones += np.unpackbits(h.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
        n += len(h)
    return sum(1 << int(i) for i in np.flatnonzero(2 * ones > n))


def fingerprint(text: bytes, width: int = 3) -> int:
    """SimHash of word shingles of UTF-8 text, repeats included; zero without words."""
    import xxhash

    words = text.lower().split()  # of bytes: A-Z and ASCII white space only
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(islice(words, i, None) for i in range(width)))) if len(words) >= width else iter([b" ".join(words)])
    digest = xxhash.xxh64_intdigest

    def chunks() -> Iterator[np.ndarray]:
        while len(h := np.fromiter((digest(s, SEED) for s in islice(shingles, 1 << 14)), np.uint64)):
            yield h

    return majority(chunks())


def fingerprints(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text", carry: list[Column] | None = None) -> DataFrame:
    """doc_id, the carried bigint columns and fp (signed): a row for each input row, null texts as empty."""
    ids = docs.select(F.col(id_col).cast("long").alias("doc_id"), *(carry or []))
    names = [*ids.columns, "fp"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(t.as_py(), width) for t in b.column(len(names) - 1)), np.uint64, len(b))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(fps.view(np.int64))], names)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), *(carry or []), body(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, ", ".join(f"{n} long" for n in names))


def hamming_links(nodes: DataFrame) -> DataFrame:
    """nodes(fp), distinct -> a, b: links whose components are those of all pairs within RADIUS.

    Each row is a pair within RADIUS bits, a < b.
    """
    tables = F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for t, m in enumerate(covering_masks())])
    entries = nodes.select("fp", F.inline(tables))
    shared = written(entries.groupBy("t", "key").count().where("count > 1"), "buckets")
    members = written(entries.join(shared, ["t", "key"]).select("t", "key", "fp", F.col("count").alias("n")), "members")
    pairs = F.flatten(
        F.transform(
            "near",
            lambda x: F.transform(F.filter("near", lambda y: (y > x) & (F.bit_count(x.bitwiseXOR(y)) <= RADIUS)), lambda y: F.struct(x.alias("a"), y.alias("b"))),
        )
    )
    few = members.where(F.col("n") <= SMALL).groupBy("t", "key").agg(F.collect_list("fp").alias("near")).select(F.inline(pairs))
    one_bit = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit((1 << i) - (1 << 64 if i == 63 else 0))) for i in range(BITS)])
    many = (
        members.where(F.col("n") > SMALL)
        .select("fp")
        .distinct()
        .select("fp", F.explode(one_bit).alias("value"))
        .groupBy("value")
        .agg(F.array_sort(F.collect_list("fp")).alias("near"))
        .where(F.size("near") > 1)
        .select(F.get("near", F.lit(0)).alias("a"), F.explode(F.slice("near", 2, BITS + 1)).alias("b"))
    )
    return few.unionByName(many).distinct()


def connected(links: DataFrame) -> DataFrame:
    """links(a, b) -> node, root: every linked node with the smallest node that it reaches."""
    both = written(links.select(F.inline(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v"))))), "links")
    roots = written(both.groupBy(F.col("u").alias("node")).agg(F.least(F.col("u"), F.min("v")).alias("root")), "roots")
    total = None
    while total != (total := roots.agg(F.sum(F.col("root").cast("decimal(38,0)"))).first()[0]):
        near = both.join(roots, F.col("v") == F.col("node")).groupBy("u").agg(F.min("root").alias("seen"))
        step = roots.join(near, F.col("node") == F.col("u")).withColumn("new", F.least("root", "seen"))
        # A node's old root follows the smallest of what its members have seen.
        told = F.array(F.struct(F.col("node").alias("at"), F.col("new").alias("up")), F.struct(F.col("root").alias("at"), F.col("new").alias("up")))
        parents = written(step.select(F.inline(told)).groupBy("at").agg(F.min("up").alias("up")), "parents")
        above = parents.select(F.col("at").alias("mid"), F.col("up").alias("root"))
        roots = written(parents.join(above, F.col("up") == F.col("mid")).select(F.col("at").alias("node"), "root"), "roots")
    return roots


def near_duplicates(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: doc_id, fp (signed 64-bit), component_id.

    A-Z is lower-cased; words are runs without ASCII white space; texts of fewer than `width`
    words are one shingle, and null, empty and blank texts have fingerprint zero, which links
    like any other. component_id is the smallest doc_id reachable over links of RADIUS or
    fewer differing bits. Rows with a null id take part and get their component's id; they
    never name it, unless all ids there are null (then it is null). Repeated rows are copies.
    An empty table gives no rows.
    """
    return _near(docs, width, id_col, text_col, []).select("doc_id", "fp", "component_id")


def _near(docs: DataFrame, width: int, id_col: str, text_col: str, carry: list[Column]) -> DataFrame:
    rows = written(fingerprints(docs, width, id_col, text_col, carry), "fingerprints")
    nodes = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "nodes")
    roots = connected(hamming_links(nodes.select("fp")))
    placed = written(nodes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root")), "placed")
    ids = written(placed.groupBy("root").agg(F.min("least_id").alias("component_id")), "components")
    named = written(placed.join(ids, "root").select("fp", "root", "component_id"), "named")
    return rows.join(named, "fp")


def one_of_each(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input's rows and columns, of each component the row of the smallest id only.

    Ids that are null come last; where one id has several texts in a component, or rows
    repeat, exactly one row stays, of rows that differ in other columns only the one of the
    smallest hash. An empty table gives no rows.
    """
    near = _near(docs, width, id_col, text_col, row_key(id_col, text_col))
    winner = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k1", "k2")).alias("w")
    stay = near.groupBy("root").agg(winner).select("w.k1", "w.k2")
    return one_row_each(docs, stay, id_col, text_col)


def hex64(c: Column) -> Column:
    """A 64-bit number as 16 lower-case hex digits."""
    return F.lpad(F.lower(F.hex(c)), 16, "0")
