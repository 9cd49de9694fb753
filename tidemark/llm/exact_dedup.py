"""Exact dedup by heavy-hitter split, with DataFrame functions only.

Misra-Gries finds the digests that hold more than `support` of the rows. Their winners are
verified by exact counts with map-side combining, number 1 / support at most, and are
broadcast, so that members of hot groups never shuffle. Every other group holds at most
`support` of the rows and goes through one ordinary shuffle of narrow rows. Texts are read
once; only (id, length, digest) moves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import SPACES, body, frequent, written


def exact_dedup(docs: DataFrame, support: float = 0.001, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after deleting ASCII white space. The row with the most
    code points stays, then the smallest id; a null id comes last. Null texts count as
    empty, so all empty, blank and null texts are one group. Rows that repeat the winner's
    id and length are copies of it: one of them stays. An empty table gives no rows, and
    columns other than the id and the text are not read.
    """
    text = body(text_col)
    rows = written(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.length(text).cast("long").alias("n"),
            F.sha2(F.translate(text, SPACES, "").cast("binary"), 256).alias("digest"),
            F.monotonically_increasing_id().alias("uid"),
        ),
        "digests",
    )
    # Smallest first: the longest text, then an id before none, then the smallest id. Rows that are equal
    # in all of these have the same result, so the number that the written table gives them may decide.
    best = F.struct((-F.col("n")).alias("n"), F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), "uid")
    hot = written(
        rows.join(F.broadcast(frequent(rows, "digest", support)), "digest")
        .groupBy("digest")
        .agg(F.min(best).alias("best"), F.count(F.lit(1)).alias("group_size"))
        .where("group_size > 1"),
        "hot-digests",
    )
    hot_rows = rows.join(F.broadcast(hot), "digest")
    group = Window.partitionBy("digest")
    cold_rows = (
        rows.join(F.broadcast(hot.select("digest")), "digest", "left_anti")
        .withColumn("best", F.min(best).over(group))
        .withColumn("group_size", F.count(F.lit(1)).over(group))
    )
    out = ["doc_id", F.col("best.id").alias("keep_id"), "group_size", (F.col("uid") == F.col("best.uid")).alias("kept"), F.col("digest").alias("text_sha256")]
    return hot_rows.select(*out).unionByName(cold_rows.select(*out))
