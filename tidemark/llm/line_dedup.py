"""Line dedup over range-partitioned line hashes, with DataFrame functions only.

Lines become (row key, position, 128-bit hash of the line's key); texts take no part in the search.
The hashes are range-partitioned and sorted by hash, document and position, and one pass over
that order marks a hash's first occurrence in each document, whose number decides. What
comes back to a document is its drop runs, a run-length keep bitmap, not text. `drop_runs` ends
there. To apply the runs, `line_dedup` moves each text once to the join with its runs: nearly
every document may have some, so neither side has a size that a broadcast could rely on.

A line found in a large share of all rows would make one range hot. Misra-Gries finds such
hashes first: those with more than `support` of all rows or, beyond a billion lines, more than a
million rows, but a million hashes at most (16 bytes each). They are verified exactly and broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import SPACES, ascii_lower, body, columns, frequent, row_key, written

#: A document's identity: rows that repeat both id and text are one document.
ROW = ["k1", "k2"]
LINE = ["h1", "h2"]


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def drop_runs(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, support: float = 0.001, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Keep bitmaps as runs of dropped lines: k1, k2, runs array<struct<start, len>>, ascending.

    A line's key is the line without ASCII white space at its ends and with A-Z lower-cased;
    keys of at least `min_chars` code points in at least `min_docs` documents are dropped
    everywhere. A document is an id with a text: two texts under one id are two documents, and
    rows that repeat both are one. Documents that drop nothing have no row.
    """
    rows = written(
        docs.select(*row_key(id_col, text_col), F.posexplode(_lines(ascii_lower(body(text_col)))).alias("pos", "line"))
        .select(*ROW, "pos", F.btrim("line", F.lit(SPACES)).alias("key"))
        .where(F.length("key") >= min_chars)
        .select(*ROW, "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2")),
        "line-hashes",
    )
    support = max(1e-6, min(support, 1_000_000 / max(1, rows.count())))
    hot = written(
        rows.join(F.broadcast(frequent(rows, "h1", support)), "h1")
        .select(*LINE, *ROW)
        .distinct()
        .groupBy(*LINE)
        .count()
        .where(F.col("count") >= min_docs)
        .select(*LINE),
        "hot-lines",
    )
    same = Window.partitionBy(*LINE)
    streamed = same.orderBy(*ROW, "pos")
    cold = (
        rows.join(F.broadcast(hot), LINE, "left_anti")
        .repartitionByRange(*LINE)
        .sortWithinPartitions(*LINE, *ROW, "pos")
        .withColumn("before", F.lag(F.struct(*ROW)).over(streamed))
        .withColumn("first", F.col("before").isNull() | (F.col("before") != F.struct(*ROW)))
        .withColumn("n_docs", F.sum(F.col("first").cast("long")).over(same))
        .where(F.col("n_docs") >= min_docs)
    )
    dropped = cold.select(*ROW, "pos").unionByName(rows.join(F.broadcast(hot), LINE).select(*ROW, "pos"))
    inside = Window.partitionBy(*ROW).orderBy("pos")
    return (
        dropped.repartition(*[F.col(c) for c in ROW])
        .distinct()
        .withColumn("island", F.col("pos") - F.row_number().over(inside))
        .groupBy(*ROW, "island")
        .agg(F.min("pos").alias("start"), F.count(F.lit(1)).cast("int").alias("len"))
        .groupBy(*ROW)
        .agg(F.sort_array(F.collect_list(F.struct("start", "len"))).alias("runs"))
    )


def line_dedup(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, support: float = 0.001, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The input's columns (or those in `keep`), with kept_text, n_lines (before) and n_dropped,
    which replace columns of these names.

    Null and empty texts are one empty line, which has no key and stays. A document may lose
    all its lines; its kept_text is then empty. Repeated rows (same id and text) count as one
    document and are treated alike. Line order and the lines that stay are unchanged, and an
    empty table gives no rows.
    """
    added = ("kept_text", "n_lines", "n_dropped")
    names = [n for n in (docs.columns if keep is None else keep) if n not in added]
    return _deduped(docs, names, min_docs, min_chars, support, id_col, text_col).select("row.*", *added)


def without_shared_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, support: float = 0.001, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input's rows and columns, the text without its dropped lines.

    A null text stays null, an empty one empty, and a text may lose all its lines. Repeated rows
    are treated alike, and an empty table gives no rows.
    """
    rest = [n for n in docs.columns if n != text_col]
    out = _deduped(docs, rest, min_docs, min_chars, support, id_col, text_col)
    text = F.when(~F.col("none"), F.col("kept_text"))
    return out.select(*[(text if n == text_col else F.col("row").getField(n)).alias(n) for n in docs.columns])


def _deduped(docs: DataFrame, names: list[str], min_docs: int, min_chars: int, support: float, id_col: str, text_col: str) -> DataFrame:
    """row (a struct of the named columns), none (no text), kept_text, n_lines, n_dropped."""
    runs = drop_runs(docs, min_docs, min_chars, support, id_col, text_col)
    # The split lines pass the exchange as an array, so no later expression splits again.
    whole = docs.select(F.struct(*columns(names)).alias("row"), F.col(text_col).isNull().alias("none"), *row_key(id_col, text_col), _lines(body(text_col)).alias("lines"))
    joined = whole.join(runs.hint("shuffle_hash"), ROW, "left")
    stays = F.flatten(
        F.transform(
            F.sequence(F.lit(0), F.size("runs")),
            lambda i: F.slice(
                "lines",
                _end(i) + 1,
                F.when(i < F.size("runs"), F.get("runs", i)["start"]).otherwise(F.size("lines")) - _end(i),
            ),
        )
    )
    return joined.select(
        "row",
        "none",
        F.array_join(F.when(F.col("runs").isNull(), F.col("lines")).otherwise(stays), "\n").alias("kept_text"),
        F.size("lines").cast("long").alias("n_lines"),
        F.coalesce(F.aggregate("runs", F.lit(0).cast("long"), lambda a, r: a + r["len"]), F.lit(0).cast("long")).alias("n_dropped"),
    )


def _end(i: Column) -> Column:
    """Where the i-th kept stretch begins: behind the drop run before it."""
    before = F.get("runs", i - 1)
    return F.when(i == 0, F.lit(0)).otherwise(before["start"] + before["len"])
