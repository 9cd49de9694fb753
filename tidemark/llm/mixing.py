"""Mixing sources to target weights, with DataFrame functions only.

Every document gets a hash-random key. Within its source it lies in one of many equal key
ranges; range totals are summed first, their running sums are taken over the few ranges, and
each range then continues from its own offset. So no source, however large, is ordered in
one task. A source's budget is cut exactly where its running sum reaches it; a budget above
the source's size takes whole passes first.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import body, columns, row_hash, written

WORD = r"[^\x20\x09-\x0D]+"


def source_targets(sizes: DataFrame, weights: Sequence[int] = (1, 2, 3), most: int = 3) -> DataFrame:
    """source, source_size -> also weight, target. One row for each source, null last.

    The weights repeat along the sources by code point. All sizes are shared by weight; a
    target stops at `most` times its source's size and the excess is reshared among the
    others until none is above. Ordered by cap / weight, the capped sources come first, so
    running sums find the level at which the others share the rest. One task orders the sources:
    this is for as many as fit there, some millions of narrow rows.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), F.col("nth"))
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    after = by_level.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    weight = F.get(F.array(*[F.lit(w).cast("long") for w in weights]), ((F.col("nth") - 1) % len(weights)).cast("int"))
    return (
        sizes.withColumn("nth", F.row_number().over(by_name))
        .withColumn("weight", weight)
        .withColumn("cap", F.col("source_size") * most)
        .withColumn("rest", F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("left", F.sum("weight").over(after))
        .withColumn("open", F.col("rest") * F.col("weight") <= F.col("cap") * F.col("left"))
        .withColumn("first", F.min(F.when(F.col("open"), F.struct(F.col("cap") / F.col("weight"), "nth", "rest", "left"))).over(everything))
        .withColumn("opened", F.struct(F.col("cap") / F.col("weight"), "nth", "rest", "left") >= F.col("first"))
        .withColumn("target", F.when(F.col("opened"), F.col("weight") * F.col("first.rest") / F.col("first.left")).otherwise(F.col("cap").cast("double")))
        .select("source", "source_size", "weight", "target")
    )


def mix(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), most: int = 3, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row for each input row: doc_id, source, size, source_size, target, taken.

    size is the number of words (null text: 0); taken is how many words the mix takes of the
    document, passes counted: whole passes over its source, then the share of one more that
    lies below the budget. The sum of a source's taken words is its target rounded down. The
    order is md5(seed:id), then id, then size, so reruns agree; repeated rows are rows of
    their own, rows with a null id are ordered by size only, a null source is a source, and
    an empty table gives no rows.
    """
    rows, starts = _placed(docs, weights, most, seed, id_col, text_col, source_col, False)
    inside = Window.partitionBy("source", "slot").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        rows.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .withColumnsRenamed({"source": "s", "slot": "l"})
        .join(starts, F.col("s").eqNullSafe(F.col("source")) & (F.col("l") == F.col("slot")))
    )
    budget = F.floor("target")
    passes = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    rest = budget - passes * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("slot_start") - F.col("inside")))
    return placed.select("doc_id", "source", "size", "source_size", "target", (passes * F.col("size") + part).cast("long").alias("taken"))


def mixed(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), most: int = 3, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The input's rows and columns as the mix takes them: a row for each time it is taken.

    A document of which the mix takes a part is there once more if that is half or more of
    it, so a source's words come within a document of its target. Others are not there; nor are
    documents without words. Rows that agree in id and size are ordered by a hash of all their
    columns, so reruns agree; rows that are equal in every column are interchangeable. A null
    source is a source, and an empty table gives no rows.

    Texts do not move: each source is cut at one place of its order, and every row compares its
    own place with that. Sources are a table of their own, which the optimiser broadcasts if it
    is small.
    """
    rows, starts = _placed(docs, weights, most, seed, id_col, text_col, source_col, True)
    # The slot in which a source's budget ends, and in it the place: the last row that is still taken from.
    budget = F.floor("target")
    passes = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    ends = starts.withColumn("passes", passes).withColumn("rest", budget - F.col("passes") * F.col("source_size"))
    cut_slot = ends.where((F.col("slot_start") < F.col("rest")) & (F.col("rest") <= F.col("slot_start") + F.col("slot_size")))
    at = F.struct("key", "id", "size", "h")
    there = rows.withColumnsRenamed({"source": "s", "slot": "l"}).join(cut_slot, F.col("s").eqNullSafe(F.col("source")) & (F.col("l") == F.col("slot")))
    equal = there.withColumn("id", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")).groupBy("source", "slot_start", "rest", at.alias("at")).agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("source").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    words = F.col("n") * F.col("at.size")
    left = F.col("rest") - F.col("slot_start") - F.coalesce(F.sum(words).over(before), F.lit(0))
    cuts = equal.withColumn("left", left).where((F.col("left") > 0) & (F.col("left") <= words))
    # Of the rows that are equal at the cut so many are taken in the last pass.
    last = F.floor((2 * F.col("left") + F.col("at.size")) / (2 * F.col("at.size")))
    cuts = cuts.select(F.col("source").alias("of"), "at", "n", last.alias("last"))
    per_source = ends.select("source", "passes").distinct()
    plan = written(per_source.join(cuts, F.col("source").eqNullSafe(F.col("of")), "left").select(F.col("source").alias("of"), "passes", F.col("at").alias("cut"), "n", "last"), "cuts")

    mine = [F.struct(*columns(docs.columns)).alias("row"), F.col(source_col).alias("own source"), _place(docs, seed, id_col, text_col).alias("at")]
    placed = docs.select(*mine).join(plan, F.col("own source").eqNullSafe(F.col("of")) & (F.col("at.size") > 0))
    whole = F.coalesce((F.col("at") < F.col("cut")).cast("int"), F.lit(0))
    apart = F.coalesce(F.col("at") == F.col("cut"), F.lit(False))
    plain = placed.where(~apart).withColumn("times", (F.col("passes") + whole).cast("int")).where("times > 0")
    # One row stands for all that are equal at a cut.
    equal = placed.where(apart).groupBy("of", "passes", "n", "last").agg(F.min_by("row", "at").alias("row")).withColumn("times", (F.col("passes") * F.col("n") + F.col("last")).cast("int")).where("times > 0")
    both = plain.select("row", "times").unionByName(equal.select("row", "times"))
    return both.select("row", F.explode(F.sequence(F.lit(1), F.col("times")))).select("row.*")


def _place(docs: DataFrame, seed: str, id_col: str, text_col: str) -> Column:
    """Where a row stands in its source: by the key of its id, then id, size and the hash of all its columns."""
    id_ = F.col(id_col)
    size = F.regexp_count(body(text_col), F.lit(WORD)).cast("long")
    return F.struct(_key(seed, id_col).alias("key"), F.struct(id_.isNull().alias("none"), id_.alias("doc_id")).alias("id"), size.alias("size"), row_hash(docs).alias("h"))


def _key(seed: str, id_col: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))))


def _placed(docs: DataFrame, weights: Sequence[int], most: int, seed: str, id_col: str, text_col: str, source_col: str, hashed: bool) -> tuple[DataFrame, DataFrame]:
    """Narrow rows (doc_id, source, size, h if hashed, key, slot), and for each source and slot where it starts."""
    rows = written(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.col(source_col).alias("source"),
            F.regexp_count(body(text_col), F.lit(WORD)).cast("long").alias("size"),
            *([row_hash(docs).alias("h")] if hashed else []),
            _key(seed, id_col).alias("key"),
        ),
        "sizes",
    )
    # About as many ranges in a source as rows in a range: both grow with the root of the rows.
    digits = max(1, math.ceil(math.log(max(rows.count(), 1) ** 0.5, 16)))
    rows = rows.withColumn("slot", F.substring("key", 1, digits))
    slots = written(rows.groupBy("source", "slot").agg(F.sum("size").alias("slot_size")), "slots")
    targets = source_targets(slots.groupBy("source").agg(F.sum("slot_size").alias("source_size")), weights, most)
    ahead = Window.partitionBy("source").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    starts = written(
        slots.withColumn("slot_start", F.coalesce(F.sum("slot_size").over(ahead), F.lit(0)))
        .withColumnRenamed("source", "s")
        .join(targets, F.col("s").eqNullSafe(F.col("source")))
        .select("source", "slot", "slot_start", "slot_size", "source_size", "target"),
        "slot-starts",
    )
    return rows, starts
