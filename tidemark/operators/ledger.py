"""The observation ledger: what becomes of each polled rate, and what a stored ledger refuses.

Quarantine needs no history, so all that does is scans over the rows that pass.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.scan import SEGMENT_ROWS, Series, last, number, scanned, shifted

#: What counts as another price.
LEAST = "0.001"


def disposed(polls: DataFrame, key: Sequence[str], row_id: str = "row_id", zone: str = "Asia/Kolkata", segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """Adds disposition, reason, previous_price, change, change_pct, kind, revision, supersedes, is_inserted.

    polls: price decimal(14,2), status (of validation), published, observed, raw_time, in_memory,
    benchmark, clock_only, closed. A row is QUARANTINED by its validation, by a publication after
    its observation (no tolerance) or by a source time that gave none. Others are IN_MEMORY, or NEW,
    CHANGED or UNCHANGED against the row before of their key. Changes are exact decimals, half up.

    A benchmark's publication goes to the ledger once as ORIGINAL and again as CORRECTION, with
    the row it supersedes, whenever its price differs; a bare clock that repeats the clock of an earlier
    day at the same price, or comes from a closed market, is a CARRYOVER and quarantined. Other
    rates go to the ledger when they change.
    """
    future = F.col("published") > F.col("observed")
    lost = F.col("raw_time").isNotNull() & F.col("published").isNull()
    reason = F.when(F.col("status").isin("QUARANTINED", "INVALIDATED"), "validation").when(future, "future publication").when(lost, "source time without a date")
    x = polls.withColumn("reason", reason)
    kept = F.col("reason").isNull() & ~F.col("in_memory")
    by = lambda *more: Series((*key, *more), ("observed", row_id), segment_rows)
    x = scanned(x.withColumn("_kept", kept), by("_kept"), {"_prior": shifted(F.col("price"))}).withColumn("previous_price", F.when(kept, F.col("_prior")))
    delta = (F.col("price") - F.col("previous_price")).cast("decimal(14,2)")
    differs = F.abs(F.col("price") - F.col("previous_price")) > F.lit(LEAST).cast("decimal(6,3)")
    changed = F.col("previous_price").isNull() | differs
    what = F.when(F.col("reason").isNotNull(), "QUARANTINED").when(F.col("in_memory"), "IN_MEMORY").when(F.col("previous_price").isNull(), "NEW").when(differs, "CHANGED").otherwise("UNCHANGED")
    x = x.withColumn("disposition", what).withColumn("change", F.when(differs, delta)).withColumn("change_pct", F.when(differs & (F.col("previous_price") > 0), (delta / F.col("previous_price") * 100).cast("decimal(12,4)")))
    # Publications of benchmarks.
    published = kept & F.col("benchmark") & F.col("published").isNotNull()
    x = scanned(x.withColumn("_pub", published), by("published", "_pub"), {"_nth": number()}).withColumn("_first", published & (F.col("_nth") == 1))
    shut = F.col("_first") & F.col("clock_only") & F.col("closed")
    local = F.from_utc_timestamp(F.col("published").cast("timestamp"), zone)
    x = scanned(x.withColumn("_seen", F.when(F.col("_first") & ~shut, local)), by("_kept"), {"_before": last(F.col("_seen"), inclusive=False)})
    same_clock = (F.date_format("_before", "HH:mm") == F.date_format(local, "HH:mm")) & (F.to_date("_before") < F.to_date(local))
    carried = F.col("_first") & F.col("clock_only") & (F.col("closed") | ~changed & F.coalesce(same_clock, F.lit(False)))
    x = x.withColumn("_carried", carried)
    # Revisions: rows of a publication that are not carried over and differ from the one before.
    x = x.withColumn("_in", published & ~F.col("_carried"))
    x = scanned(x, by("published", "_in"), {"_was": shifted(F.col("price"))})
    x = x.withColumn("_revised", F.col("_in") & (F.col("_was").isNull() | (F.abs(F.col("price") - F.col("_was")) > F.lit(LEAST).cast("decimal(6,3)"))))
    x = scanned(x, by("published", "_revised"), {"_rev": number(), "_over": shifted(F.col(row_id))})
    inserted = F.when(F.col("benchmark") & F.col("published").isNotNull(), F.col("_revised")).otherwise(kept & ~F.col("benchmark") & changed)
    x = x.withColumn("revision", F.when(F.col("_revised"), F.col("_rev").cast("int"))).withColumn("supersedes", F.when(F.col("_revised"), F.col("_over"))).withColumn("is_inserted", inserted)
    x = x.withColumn("kind", F.when(F.col("_carried"), "CARRYOVER").when(F.col("revision") > 1, "CORRECTION").when(F.col("is_inserted"), "ORIGINAL"))
    return x.drop("_kept", "_prior", "_pub", "_nth", "_first", "_seen", "_before", "_carried", "_in", "_was", "_revised", "_rev", "_over")


def merged_latest(latest: DataFrame, changes: DataFrame, key: Sequence[str]) -> DataFrame:
    """Latest rows with the columns that a change of their key brings; other columns and rows as they are."""
    brought = [c for c in changes.columns if c not in key]
    b = changes.select(*key, F.struct(*brought).alias("_new"))
    new = lambda c: F.when(F.col("_new").isNotNull(), F.col("_new").getField(c)).otherwise(F.col(c)).alias(c)
    return latest.join(b, list(key), "left").select(*[new(c) if c in brought else F.col(c) for c in latest.columns])


def insert_faults(forecasts: DataFrame, publications: DataFrame, arms: Sequence[str], modes: Sequence[str]) -> DataFrame:
    """Forecast rows with an array of the insert rules that they break, in order; those without are left out.

    forecasts: id, mode, arm, h, origin_id, origin_ts, origin_price, known_at, generated_ts;
    publications: pub_id, ts, price, valid. The rules: a mode and an arm that exist, a positive
    horizon, an origin that is a valid publication with the time and price that the forecast says,
    knowledge not after generation, and generation not before the origin.
    """
    p = publications.select(F.col("pub_id").alias("origin_id"), F.col("ts").alias("_ts"), F.col("price").alias("_price"), F.col("valid").alias("_valid"))
    x = forecasts.join(p, "origin_id", "left")
    no = lambda c: ~F.coalesce(c, F.lit(False))
    rules = (
        ("mode", no(F.col("mode").isin(*modes))), ("arm", no(F.col("arm").isin(*arms))), ("horizon", no(F.col("h") > 0)), ("origin", no(F.col("_valid"))),
        ("origin time", no(F.col("origin_ts") == F.col("_ts"))), ("origin price", no(F.abs(F.col("origin_price") - F.col("_price")) <= 0.001)), ("hindsight", no((F.col("known_at") <= F.col("generated_ts")) & (F.col("generated_ts") >= F.col("origin_ts")))),
    )
    faults = F.filter(F.array(*[F.when(c, name) for name, c in rules]), lambda f: f.isNotNull())
    return x.withColumn("faults", faults).where(F.size("faults") > 0).select(*forecasts.columns, "faults")


def append_only_violations(before: DataFrame, after: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows of a ledger that a later state of it lacks (DELETED) or holds otherwise (UPDATED); new ones are no fault."""
    from tidemark.operators.state import rows_diff

    diff = rows_diff(before, after, key).where("diff <> 'ADDED'")
    return diff.select(*key, F.when(F.col("diff") == "REMOVED", "DELETED").otherwise("UPDATED").alias("violation"))


def valid_only(df: DataFrame, status: str = "status", include_quarantined: bool = False) -> DataFrame:
    """Rows that are valid or suspect, or all on demand."""
    return df if include_quarantined else df.where(F.col(status).isin("VALID", "SUSPECT"))


def authoritative(rate_type: Column, source: Column, status: Column, published: Column, observed: Column, precision: Column, price: Column, wanted_type: str, wanted_source: str) -> Column:
    """Whether an observation belongs to the official series: its type and source, valid, priced, and
    published with a full time that is not after its observation."""
    return F.coalesce((rate_type == wanted_type) & (source == wanted_source) & (status == "VALID") & published.isNotNull() & (published <= observed) & (precision == "FULL") & (price > 0), F.lit(False))
