"""As-of joins: each left row with the latest right row at or before its time.

A union, one shuffle by key and one sorted pass: no range comparison of rows with rows. The
right side's rows sort before the left's at equal times (`<=`), or behind them (`<`).

A key with very many rows, or a join without keys, is cut by the segmented scan. It can also be cut
into fixed stretches of time: each stretch is a partition of its own, and the last right row before it
is carried in as its first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.scan import SEGMENT_ROWS, Series, last, scanned


def asof_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    left_ts: str,
    right_ts: str,
    take: Sequence[str],
    strict: bool = False,
    lookback: str | None = None,
    tolerance: str | None = None,
    prefix: str = "",
    how: str = "left",
    tie: Sequence[str] = (),
    chunk_seconds: int | None = None,
    segment_rows: int = SEGMENT_ROWS,
) -> DataFrame:
    """All left columns, and `take` of the matched right row (null without a match).

    lookback: match at or before left time minus this interval. tolerance: a match older than
    this before that point becomes null (its exact age still matches). tie: right columns that
    order rows of one time by their own types, nulls first; the last wins. Rows with a null time
    match nothing. A key of more than segment_rows rows is cut into segments; chunk_seconds cuts each
    key's rows into stretches of that length instead, without looking at their number.
    """
    names = left.columns
    at = F.col(left_ts) - F.expr(f"interval {lookback}") if lookback else F.col(left_ts)
    got = F.struct(F.col(right_ts).alias("ts"), *[F.col(c) for c in take])
    nothing = F.lit(None).cast(right.select(got.alias("g")).schema["g"].dataType)
    order = F.struct(*tie) if tie else F.lit(None).cast("string")
    untied = F.lit(None).cast(right.select(order.alias("o")).schema["o"].dataType)
    rows = left.select(*on, at.alias("at"), F.lit(0 if strict else 1).alias("side"), untied.alias("nth"), F.struct(*names).alias("row"), nothing.alias("got"))
    empty = F.lit(None).cast(rows.schema["row"].dataType)
    found = right.where(F.col(right_ts).isNotNull()).select(*on, F.col(right_ts).alias("at"), F.lit(1 if strict else 0).alias("side"), order.alias("nth"), empty.alias("row"), got.alias("got"))
    both = rows.unionByName(found)
    if chunk_seconds:
        both = both.withColumn("chunk", F.floor(F.unix_seconds(F.col("at").cast("timestamp")) / chunk_seconds))
        both = both.unionByName(_carried(both, on))
        w = Window.partitionBy(*on, "chunk").orderBy("at", "side", "nth").rowsBetween(Window.unboundedPreceding, 0)
        both = both.withColumn("got", F.last("got", ignorenulls=True).over(w))
    else:
        both = scanned(both.withColumnRenamed("got", "own"), Series(tuple(on), ("at", "side", "nth"), segment_rows), {"got": last(F.col("own"))})
    both = both.where(F.col("row").isNotNull())
    ok = F.col("at").isNotNull() & F.col("got").isNotNull()
    if tolerance:
        ok = ok & (F.col("got.ts") >= F.col("at") - F.expr(f"interval {tolerance}"))
    if how == "inner":
        both = both.where(ok)
    return both.select("row.*", *[F.when(ok, F.col(f"got.{c}")).alias(prefix + c) for c in take])


def _carried(both: DataFrame, on: Sequence[str]) -> DataFrame:
    """For each stretch, the last right row of the stretches before it, as a right row without a time."""
    last = both.groupBy(*on, "chunk").agg(F.max_by("got", F.when(F.col("got").isNotNull(), F.struct("at", "nth"))).alias("last"))
    earlier = Window.partitionBy(*(list(on) or [F.lit(0)])).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.withColumn("got", F.last("last", ignorenulls=True).over(earlier)).where(F.col("got").isNotNull() & F.col("chunk").isNotNull())
    kinds = both.schema
    return carried.select(*on, F.lit(None).cast(kinds["at"].dataType).alias("at"), F.lit(-1).alias("side"), F.lit(None).cast(kinds["nth"].dataType).alias("nth"), F.lit(None).cast(kinds["row"].dataType).alias("row"), "got", "chunk")


def returns(base: Column, now: Column) -> Column:
    """Percent change, null where either is null or the base is 0."""
    return F.try_divide(now - base, base) * 100
