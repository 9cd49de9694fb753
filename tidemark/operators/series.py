"""Operators over ordered series: targets, lags, returns, gaps, dedup, revisions, sequence audit.

Time here counts publications, not clock time. Every order ends in a unique column.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from tidemark.operators.scan import SEGMENT_ROWS, Series, most, number, scanned, shifted, total


def ordered(key: Sequence[str], order: Sequence[str]) -> WindowSpec:
    return Window.partitionBy(*key).orderBy(*order)


def next_target(df: DataFrame, w: WindowSpec, ts: str, value: str) -> DataFrame:
    """The next event's time and value, the change to it, in percent, and its direction; null at the end."""
    change = F.col("next_value") - F.col(value)
    return (
        df.withColumn("next_time", F.lead(ts).over(w))
        .withColumn("next_value", F.lead(value).over(w))
        .withColumn("target_change", change)
        .withColumn("target_change_pct", F.try_divide(change, F.col(value)) * 100)
        .withColumn("target_direction", F.when(change > 0, "UP").when(change < 0, "DOWN").when(change == 0, "FLAT"))
    )


def changes(df: DataFrame, w: WindowSpec, value: str) -> DataFrame:
    before = F.lag(value).over(w)
    return df.withColumn("change", F.col(value) - before).withColumn("change_pct", F.try_divide(F.col(value) - before, before) * 100)


def log_returns(df: DataFrame, w: WindowSpec, value: str, lags: Sequence[int] = (1, 3, 5), vol: int = 5) -> DataFrame:
    """ret_k: log return over k publications, 0.0 on a short history; vol_n: the population standard
    deviation of the last n step returns, 0.0 with fewer than two."""
    for k in lags:
        before = F.lag(value, k).over(w)
        df = df.withColumn(f"ret_{k}", F.coalesce(F.when((before > 0) & (F.col(value) > 0), F.ln(F.col(value) / before)), F.lit(0.0)))
    one = F.lag(value).over(w)
    df = df.withColumn("_step", F.when((one > 0) & (F.col(value) > 0), F.ln(F.col(value) / one)))
    last = w.rowsBetween(1 - vol, 0)
    sd = F.when(F.count("_step").over(last) >= 2, F.stddev_pop("_step").over(last)).otherwise(0.0)
    return df.withColumn(f"vol_{vol}", sd).drop("_step")


def forward_return(df: DataFrame, w: WindowSpec, value: str, h: int) -> DataFrame:
    return df.withColumn(f"fwd_{h}", F.ln(F.lead(value, h).over(w) / F.col(value)))


def previous_mean(df: DataFrame, w: WindowSpec, value: str, n: int = 3) -> DataFrame:
    """Mean of the n rows before; the value itself on the first n rows."""
    mean = F.avg(value).over(w.rowsBetween(-n, -1))
    return df.withColumn(f"sma_{n}", F.when(F.row_number().over(w) > n, mean).otherwise(F.col(value)))


def gaps(df: DataFrame, w: WindowSpec, ts: str, stale_minutes: float = 180) -> DataFrame:
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    gap = (micros - F.lag(micros).over(w)) / 60_000_000.0
    return df.withColumn("gap_minutes", gap).withColumn("is_stale", F.coalesce(gap > stale_minutes, F.lit(False)))


def keep_one(df: DataFrame, key: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """Of rows equal in `key`, the first in `order`."""
    nth = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return df.withColumn("_nth", nth).where("_nth = 1").drop("_nth")


def duplicates_flagged(df: DataFrame, key: Sequence[str], order: Sequence[Column | str], name: str = "is_duplicate") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*key).orderBy(*order)) > 1)


def revision_chain(df: DataFrame, publication: Sequence[str], order: Sequence[str], value: str, row_id: str, least: float = 0.001, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """Ledger rows: the first of each publication and each later one that differs from the row
    before by more than `least`, with revision_number, supersedes and kind."""
    s = Series(tuple(publication), tuple(order), segment_rows)
    changed = scanned(df, s, {"_before": shifted(F.col(value))}).where(F.col("_before").isNull() | (F.abs(F.col(value) - F.col("_before")) > least)).drop("_before")
    numbered = scanned(changed, s, {"revision_number": number(), "supersedes": shifted(F.col(row_id))})
    return numbered.withColumn("revision_number", F.col("revision_number").cast("int")).withColumn("kind", F.when(F.col("revision_number") == 1, "ORIGINAL").otherwise("CORRECTION"))


def revisions_asof(ledger: DataFrame, publication: Sequence[str], observed: str, revision: str, value: str, as_of: Column) -> DataFrame:
    """Of each publication known at `as_of`: the latest revision's value, the first one's arrival,
    and the later of both arrivals, from when the value was available."""
    return (
        ledger.where(F.col(observed) <= as_of)
        .groupBy(*publication)
        .agg(F.max_by(value, revision).alias("value"), F.min_by(observed, revision).alias("first_arrival"), F.max_by(observed, revision).alias("last_arrival"))
        .withColumn("available_at", F.greatest("first_arrival", "last_arrival"))
    )


def carryovers(df: DataFrame, w: WindowSpec, clock: Column, value: str) -> DataFrame:
    """Rows that show the value and the clock of the row before, on a later day."""
    return df.withColumn("_clock", clock).withColumn(
        "is_carryover", F.coalesce((F.lag(value).over(w) == F.col(value)) & (F.lag("_clock").over(w) == F.col("_clock")), F.lit(False))
    ).drop("_clock")


def sequence_audit(df: DataFrame, key: Sequence[str], order: Sequence[str], explicit: Column, signature: Column, sunday: Column, published_sunday: Column, require_explicit: bool = False, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """A status for each polled row, and the sequence number of the eligible ones (-1 otherwise).

    MISSING without an explicit date where one is required; DUPLICATE_POLL for an explicit
    signature accepted before; STALE_CARRYOVER for the signature of the row before, or an
    explicit row seen on a Sunday for another day; UNCERTAIN for a bare clock on a Sunday; else
    VALID (explicit) or INFERRED. The last two are eligible.
    """
    s = Series(tuple(key), tuple(order), segment_rows)
    df = scanned(df.withColumn("_sig", signature).withColumn("_explicit", explicit), s, {"_was": shifted(F.col("_sig"))}).withColumn("_same", F.coalesce(F.col("_was") == F.col("_sig"), F.lit(False)))
    stale_sunday = F.col("_explicit") & sunday & ~published_sunday
    missing = F.lit(require_explicit) & ~F.col("_explicit")
    # An explicit row is accepted unless a rule below refuses it; later equal ones are duplicates.
    accepts = F.col("_explicit") & ~F.col("_same") & ~stale_sunday
    df = scanned(df.withColumn("_accepts", accepts.cast("int")), Series((*key, "_sig"), tuple(order), segment_rows), {"_earlier": most(F.col("_accepts"), inclusive=False)})
    earlier = F.coalesce("_earlier", F.lit(0))
    status = (
        F.when(missing, "MISSING")
        .when(F.col("_explicit") & (earlier == 1), "DUPLICATE_POLL")
        .when(F.col("_same"), "STALE_CARRYOVER")
        .when(~F.col("_explicit") & sunday, "UNCERTAIN")
        .when(stale_sunday, "STALE_CARRYOVER")
        .when(F.col("_explicit"), "VALID")
        .otherwise("INFERRED")
    )
    df = df.withColumn("status", status).withColumn("is_eligible", F.col("status").isin("VALID", "INFERRED"))
    df = scanned(df, s, {"_so_far": total(F.col("is_eligible").cast("int"))})
    return df.withColumn("sequence_index", F.when(F.col("is_eligible"), F.col("_so_far") - 1).otherwise(-1)).drop("_sig", "_explicit", "_was", "_same", "_accepts", "_earlier", "_so_far")
