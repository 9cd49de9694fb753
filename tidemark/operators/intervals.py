"""Interval joins through time buckets, so that equal keys and not comparisons pair the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def micros(c: str) -> Column:
    """Microseconds since the epoch, of timestamps with or without a zone (UTC)."""
    return F.unix_micros(F.col(c).cast("timestamp"))


def interval_join(left: DataFrame, right: DataFrame, on: Sequence[str], left_ts: str, right_ts: str, seconds: int, closed_end: bool = True, how: str = "inner") -> DataFrame:
    """Pairs with right time in [left time - seconds, left time], or without its end.

    Right rows go to the bucket of their time and the next one; `seconds` wide buckets mean
    that a left row's own bucket has all its partners. Columns on both sides must differ
    except `on`, which comes from the left.
    """
    width = seconds * 1_000_000
    a = left.withColumn("_at", micros(left_ts)).withColumn("_bucket", F.floor(F.col("_at") / width))
    b = right.withColumn("_then", micros(right_ts))
    b = b.withColumn("_bucket", F.explode(F.array(F.floor(F.col("_then") / width), F.floor(F.col("_then") / width) + 1)))
    for c in on:
        b = b.withColumnRenamed(c, f"_{c}")
    cond = a["_bucket"] == b["_bucket"]
    for c in on:
        cond = cond & (a[c] == b[f"_{c}"])
    cond = cond & (b["_then"] >= a["_at"] - width) & ((b["_then"] <= a["_at"]) if closed_end else (b["_then"] < a["_at"]))
    return a.join(b, cond, how).drop(a["_bucket"]).drop(b["_bucket"]).drop("_at", "_then", *[f"_{c}" for c in on])
