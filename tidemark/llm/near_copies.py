"""Near copies by SimHash and the Jaccard similarity of word shingles: operator 8's steps, then bands, whole sets decide.

A text is the set of its shingles' 64-bit hashes; equal sets are one node. Nodes have SimHash fingerprints of
their sets, which meet by operator 8's method: equal ones, and by covering masks those within two bits. Pairs whose
whole sets have the similarity link, and components are what the next step starts from.

Two bits are not all of it: of a pair at 0.8 about 10 of 64 bits differ and up to 17, for which covering masks would
number 2^18. So what SimHash left apart meets in bands of MinHash values too, with the same nodes, buckets and components.
Each of BANDS bands hashes ROWS minima, so a pair of similarity s shares a bucket with chance 1 - (1 - s^ROWS)^BANDS:
0.9999 at 0.8, more above. What shares a bucket is decided by whole sets, so no pair below the
threshold links, and no pair that shares a bucket is passed over:

* Each round, all nodes of a bucket meet one leader, and buckets whose nodes are then one component
  are done. Large groups of near copies end here, at a row for each node. Rounds go on while they
  halve what lies outside its bucket's largest component.
* Of the buckets left, those of up to SMALL nodes pair across components.
* Larger ones are compared in blocks of about BLOCK nodes: a task holds one block of the nodes outside
  the largest component and one of all nodes, and returns links that join components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import body, one_row_each, row_key, written
from .simhash import SEED, connected, hamming_links, majority

WIDTH = 5
SIMILARITY = 0.8
ROWS, BANDS = 6, 30
#: Buckets of up to so many nodes are compared pair by pair, larger ones in blocks. Either way is exact.
SMALL = 16
BLOCK = 512
#: Hashes that a block may hold; longer texts make smaller blocks.
BLOCK_HASHES = 2_000_000

_RNG = np.random.default_rng(SEED)
_XOR, _TIMES = (_RNG.integers(0, 2**64, (1, ROWS * BANDS), np.uint64) for _ in range(2))
_TIMES |= np.uint64(1)


def shingles(text: bytes, width: int = WIDTH) -> np.ndarray:
    """Distinct hashes of the word shingles of UTF-8 text, sorted; none without words."""
    import xxhash

    words = text.lower().split()  # of bytes: A-Z and ASCII white space only
    digest = xxhash.xxh64_intdigest
    found = {digest(b" ".join(words[i : i + width]), SEED) for i in range(max(1, len(words) - width + 1))} if words else ()
    return np.sort(np.fromiter(found, np.uint64, len(found)))


def bands(hashes: np.ndarray) -> list[int]:
    """A signed 64-bit key for each band; none for the empty set."""
    import xxhash

    if not len(hashes):
        return []
    least = np.full(ROWS * BANDS, 2**64 - 1, np.uint64)
    for i in range(0, len(hashes), 1024):
        np.minimum(least, ((hashes[i : i + 1024, None] ^ _XOR) * _TIMES).min(axis=0), out=least)
    keys = [xxhash.xxh64_intdigest(x.tobytes(), t) for t, x in enumerate(least.reshape(BANDS, ROWS))]
    return np.array(keys, np.uint64).view(np.int64).tolist()


def _node(hashes: np.ndarray) -> int:
    import xxhash

    return _signed(xxhash.xxh64_intdigest(hashes.tobytes(), SEED))


def _signed(n: int) -> int:
    return n - (n >> 63 << 64)


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        made = [(_node(s), len(s), bands(s), _signed(majority([s]))) for s in (shingles(t.as_py()) for t in b.column(3))]
        if made:
            yield pa.RecordBatch.from_arrays([*b.columns[:3], *(pa.array(c, k) for c, k in zip(zip(*made), (pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.int64())))], ["doc_id", "k1", "k2", "node", "n", "bands", "fp"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for b in (whole.slice(i, 256) for i in range(0, whole.num_rows, 256)):
            made = [s.view(np.int64) for s in (shingles(t.as_py()) for t in b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, pa.list_(pa.int64()))], ["node", "hashes"])


def _similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b: those pairs whose sets have at least SIMILARITY."""
    whole = pairs.join(sets.select(F.col("node").alias("a"), F.col("hashes").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("hashes").alias("y")), "b")
    shared = F.size(F.array_intersect("x", "y"))
    return whole.where(shared / (F.size("x") + F.size("y") - shared) >= SIMILARITY).select("a", "b")


def _near_sizes(pairs: DataFrame) -> DataFrame:
    """a, b: distinct, smaller first, without those whose sizes n, m rule the similarity out."""
    pairs = pairs.where(F.least("n", "m") / F.greatest("n", "m") >= SIMILARITY)
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _by_fingerprint(nodes: DataFrame) -> DataFrame:
    """a, b: pairs of nodes that SimHash brings together: each fingerprint's first node with its others, and with the first of those within two bits."""
    firsts = written(nodes.groupBy("fp").agg(F.min(F.struct("node", "n")).alias("lead")), "fingerprints")
    same = nodes.join(firsts, "fp").where(F.col("lead.node") != F.col("node")).select(F.col("lead.node").alias("a"), F.col("lead.n").alias("n"), F.col("node").alias("b"), F.col("n").alias("m"))
    of = lambda side, node, n: firsts.select(F.col("fp").alias(side), F.col("lead.node").alias(node), F.col("lead.n").alias(n))
    near = hamming_links(firsts.select("fp")).select(F.col("a").alias("x"), F.col("b").alias("y"))
    return _near_sizes(same.unionByName(near.join(of("x", "a", "n"), "x").join(of("y", "b", "m"), "y").select("a", "n", "b", "m")))


def _placed(members: DataFrame, roots: DataFrame) -> tuple[DataFrame, int]:
    """Members of the buckets that have several components, with these and the bucket's size; and how many lie outside its largest one."""
    named = members.drop("root", "size").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    several = named.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("size")).where("low < high").select("key", "size")
    members = written(named.join(several, "key"), "members")
    per_root = members.groupBy("key", "root").count().groupBy("key").agg((F.sum("count") - F.max("count")).alias("apart"))
    return members, per_root.agg(F.coalesce(F.sum("apart"), F.lit(0))).first()[0]


def _led(members: DataFrame, nth: int) -> DataFrame:
    """Each bucket's leader of this round with the members of other components."""
    at = F.xxhash64(F.lit(nth), "node")
    lead = members.groupBy("key").agg(F.min(F.struct(at.alias("at"), "node", "n", "root")).alias("lead"))
    met = members.join(lead, "key").where(F.col("lead.root") != F.col("root"))
    return _near_sizes(met.select(F.col("lead.node").alias("a"), F.col("lead.n").alias("n"), F.col("node").alias("b"), F.col("n").alias("m")))


def _crossed(members: DataFrame) -> DataFrame:
    """All pairs of a bucket across its components."""
    pair = lambda x, y: F.struct(x["node"].alias("a"), x["n"].alias("n"), y["node"].alias("b"), y["n"].alias("m"))
    across = F.flatten(F.transform("near", lambda x: F.transform(F.filter("near", lambda y: (y["node"] > x["node"]) & (y["root"] != x["root"])), lambda y: pair(x, y))))
    return _near_sizes(members.groupBy("key").agg(F.collect_list(F.struct("node", "n", "root")).alias("near")).select(F.inline(across)))


def shared_counts(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """How many hashes each of a's sets shares with each of b's."""
    sizes = [len(x) for x in (*a, *b)]
    owner = np.repeat(np.arange(len(sizes)), sizes)
    _, code, times = np.unique(np.concatenate([*a, *b, np.array([], np.int64)]), return_inverse=True, return_counts=True)
    owner, code = owner[times[code] > 1], code[times[code] > 1]
    _, code = np.unique(code, return_inverse=True)
    order = np.argsort(code, kind="stable")
    owner, code = owner[order], code[order]
    out = np.zeros((len(a), len(b)), np.float32)  # exact up to 2^24 hashes
    for first in range(0, int(code[-1]) + 1 if len(code) else 0, 2048):
        i, j = np.searchsorted(code, [first, first + 2048])
        held = np.zeros((len(sizes), 2048), np.float32)
        held[owner[i:j], code[i:j] - first] = 1
        out += held[: len(a)] @ held[len(a) :].T
    return out


def _joining(key: tuple, some: pd.DataFrame, every: pd.DataFrame) -> pd.DataFrame:
    """Links between the components of two blocks, as many as join what can be joined."""
    links: list[tuple[int, int]] = []
    if len(some) and len(every):
        a, b = [np.asarray(x, np.int64) for x in some["hashes"]], [np.asarray(x, np.int64) for x in every["hashes_"]]
        both = shared_counts(a, b)
        either = np.add.outer([len(x) for x in a], [len(x) for x in b]) - both
        near = (both / either >= SIMILARITY) & (some["root"].to_numpy()[:, None] != every["root_"].to_numpy()[None, :])
        up: dict[int, int] = {}

        def top(x: int) -> int:
            while x in up:
                x = up[x]
            return x

        for i, j in np.argwhere(near).tolist():
            p, q = top(int(some["root"].iat[i])), top(int(every["root_"].iat[j]))
            if p != q:
                up[max(p, q)] = min(p, q)
                links.append((int(some["node"].iat[i]), int(every["node_"].iat[j])))
    return pd.DataFrame(links, columns=["a", "b"]).astype("int64")


def _blocked(members: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b: links that join the components of each bucket, by comparing blocks of its whole sets."""
    by_root = members.groupBy("key", "root").agg(F.count(F.lit(1)).alias("count"), F.sum("n").alias("hashes"))
    sizes = by_root.groupBy("key").agg(F.max_by("root", F.struct("count", "root")).alias("major"), F.max(F.struct("count", "root", "hashes")).alias("most"), F.sum("count").alias("count"), F.sum("hashes").alias("hashes"))
    blocks = lambda count, hashes: F.greatest(F.lit(1), F.ceil(count / BLOCK), F.ceil(hashes / BLOCK_HASHES)).cast("int")
    sizes = sizes.select("key", "major", blocks(F.col("count"), F.col("hashes")).alias("n_all"), blocks(F.col("count") - F.col("most.count"), F.col("hashes") - F.col("most.hashes")).alias("n_some"))
    rows = members.join(sizes, "key").select("key", "node", "root", "n_all", "n_some", (F.col("root") != F.col("major")).alias("minor"))
    rows = rows.join(sets, "node")
    own = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    to = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    some = rows.where("minor").select("key", own("n_some").alias("i"), to("n_all").alias("j"), "node", "root", "hashes")
    same = [F.col(c).alias(f"{c}_") for c in ("key", "node", "root", "hashes")]  # new columns, so that the sides differ
    every = rows.select(*same, to("n_some").alias("i_"), own("n_all").alias("j_"))
    return some.groupBy("key", "i", "j").cogroup(every.groupBy("key_", "i_", "j_")).applyInPandas(_joining, "a long, b long").distinct()


def _roots(docs: DataFrame, nodes: DataFrame, id_col: str, text_col: str) -> DataFrame | None:
    """node, root: every linked node with its component's smallest node; None without links."""
    entries = nodes.select("node", "n", F.explode("bands").alias("key"))
    met = written(entries.groupBy("key").count().where("count > 1").select("key"), "buckets")
    members = written(entries.join(met, "key"), "members")
    pairs = written(_by_fingerprint(nodes), "pairs")
    of = members.select("node").union(pairs.select("a")).union(pairs.select("b")).distinct().join(nodes.select("node", "k1", "k2"), "node")
    texts = docs.select(*row_key(id_col, text_col), body(text_col).cast("binary").alias("text"))
    texts = texts.join(of.hint("shuffle_hash"), ["k1", "k2"]).dropDuplicates(["node"]).select("node", "text")
    sets = written(texts.mapInArrow(_sets, "node long, hashes array<long>"), "sets")
    links = written(_similar(pairs, sets), "links")
    roots = connected(links)
    members, apart = _placed(members, roots)
    nth = 0
    while apart:
        new = written(_similar(_led(members, nth), sets), "links")
        if new.isEmpty():
            break
        links = links.unionByName(new)
        roots = connected(links)
        before = apart
        members, apart = _placed(members, roots)
        if 2 * apart > before:
            break
        nth += 1
    if apart:
        small = _similar(_crossed(members.where(F.col("size") <= SMALL)), sets)
        large = _blocked(members.where(F.col("size") > SMALL), sets)
        links = links.unionByName(written(small.unionByName(large), "links"))
        roots = connected(links)
    return None if links.isEmpty() else roots


def one_of_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input's rows and columns, of each group of near copies the row of the smallest id only.

    Texts link at a Jaccard similarity of SIMILARITY or more of their sets of WIDTH-word shingles;
    groups are the components. A-Z is lower-cased, words are runs without ASCII white space, and
    a text of fewer words is one shingle. Null, empty and blank texts are one group. Ids that are
    null come last; where one id has several texts in a group, or rows repeat, exactly one row
    stays, of rows that differ in other columns only the one of the smallest hash. An empty table
    gives no rows.
    """
    ids = docs.select(F.col(id_col).cast("long").alias("doc_id"), *row_key(id_col, text_col), body(text_col).cast("binary").alias("text"))
    rows = written(ids.mapInArrow(_signatures, "doc_id long, k1 long, k2 long, node long, n int, bands array<long>, fp long"), "signatures")
    winner = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k1", "k2")).alias("w")
    # Equal sets have equal bands and fingerprints: those of any row do.
    nodes = written(rows.groupBy("node").agg(winner, F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("fp").alias("fp")).select("node", "n", "bands", "fp", "w", "w.k1", "w.k2"), "nodes")
    best = nodes.select("node", "w")
    if (roots := _roots(docs, nodes, id_col, text_col)) is not None:
        best = best.join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("node")).agg(F.min("w").alias("w"))
    stay = best.select("w.k1", "w.k2")
    return one_row_each(docs, stay, id_col, text_col)
