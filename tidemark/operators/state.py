"""Latest states, overlays, diffs, guards and audits of append-only ledgers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.scan import SEGMENT_ROWS, Series, scanned, total


def latest(df: DataFrame, key: Sequence[str], order: Sequence[str], take: Sequence[str]) -> DataFrame:
    """Of each key, `take` of the row that is last in `order`: one aggregate, combined map-side."""
    return df.groupBy(*key).agg(F.max_by(F.struct(*take), F.struct(*order)).alias("_last")).select(*key, "_last.*")


def latest_with_previous(df: DataFrame, key: Sequence[str], order: Sequence[Column], value: str) -> DataFrame:
    """The latest row of each key with the value before it and the change."""
    w = Window.partitionBy(*key).orderBy(*order)
    two = df.withColumn("previous", F.lead(value).over(w)).withColumn("_nth", F.row_number().over(w)).where("_nth = 1").drop("_nth")
    return two.withColumn("change", F.col(value) - F.col("previous")).withColumn("change_pct", F.try_divide(F.col(value) - F.col("previous"), F.col("previous")) * 100)


def overlay(stored: DataFrame, cached: DataFrame, key: Sequence[str]) -> DataFrame:
    """Stored rows, replaced by cached ones of the same key, and the cached rows of new keys."""
    rest = [c for c in stored.columns if c not in key]
    a, b = stored.select(*key, F.struct(*rest).alias("_a")), cached.select(*key, F.struct(*rest).alias("_b"))
    return a.join(b, list(key), "full").withColumn("_row", F.coalesce("_b", "_a")).select(*key, "_row.*", F.col("_b").isNotNull().alias("from_cache"))


def rows_diff(before: DataFrame, after: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys whose rows differ, nulls equal to nulls: ADDED, REMOVED or CHANGED."""
    rest = [c for c in before.columns if c not in key]
    a = before.select(*key, F.to_json(F.struct(*rest), {"ignoreNullFields": "false"}).alias("_a"))
    b = after.select(*key, F.to_json(F.struct(*rest), {"ignoreNullFields": "false"}).alias("_b"))
    kind = F.when(F.col("_a").isNull(), "ADDED").when(F.col("_b").isNull(), "REMOVED").otherwise("CHANGED")
    return a.join(b, list(key), "full").where(~F.col("_a").eqNullSafe(F.col("_b"))).select(*key, kind.alias("diff"))


def new_rows(candidates: DataFrame, ledger: DataFrame, key: Sequence[str]) -> DataFrame:
    """Candidates whose key the ledger doesn't have: appending them twice changes nothing."""
    return candidates.join(ledger.select(*key).distinct(), list(key), "left_anti")


def duplicate_keys(df: DataFrame, key: Sequence[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def complete(targets: DataFrame, rates: DataFrame, key: str) -> DataFrame:
    """Every target with its rate, or a row that says there is none."""
    return targets.join(rates, key, "left").withColumn("is_available", F.col("rate").isNotNull())


def known_after(forecasts: DataFrame, publications: DataFrame, on: Sequence[str], segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """forecasts with known_after: the distinct times of publications after origin_ts and up to generated_ts.

    A count up to a time is a rank, and the number between two times the difference of their ranks. So
    both sides are put in one order of time, publications before lookups of the same time, and one scan ranks
    them: no forecast meets a publication. Columns: id (unique), origin_ts, generated_ts; publications:
    ts. A null key or time, or generation at or before the origin, knows nothing.
    """
    row = F.struct(*forecasts.columns)
    none = F.lit(None).cast(forecasts.select(row.alias("r")).schema["r"].dataType)
    published = publications.where(F.col("ts").isNotNull()).select(*on, F.col("ts").alias("at")).distinct().select(*on, "at", F.lit(0).alias("side"), none.alias("row"))
    looks = forecasts.select(*on, F.explode(F.array(F.struct(F.col("origin_ts").alias("at"), F.lit(1).alias("side")), F.struct(F.col("generated_ts").alias("at"), F.lit(2).alias("side")))).alias("look"), row.alias("row"))
    both = published.unionByName(looks.select(*on, "look.*", "row"))
    ranked = scanned(both, Series(tuple(on), ("at", "side"), segment_rows), {"rank": total((F.col("side") == 0).cast("long"))}).where("side > 0")
    of = lambda side: F.max(F.when(F.col("side") == side, F.col("rank")))
    counted = ranked.groupBy("row.id").agg(F.first("row").alias("row"), (of(2) - of(1)).alias("known"))
    keyed = F.lit(True)
    for c in on:
        keyed = keyed & F.col(f"row.{c}").isNotNull()
    return counted.select("row.*", F.when(keyed & (F.col("row.generated_ts") > F.col("row.origin_ts")), F.col("known")).otherwise(F.lit(0)).cast("long").alias("known_after"))


def insert_violations(forecasts: DataFrame, publications: DataFrame, on: Sequence[str], segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """Forecasts made before their origin, or when h publications after the origin were known.

    Columns: id, origin_ts, generated_ts, h; publications: ts. A rank by hindsight counts distinct
    publications after the origin and at or before generation.
    """
    out = known_after(forecasts, publications, on, segment_rows)
    reason = F.when(F.col("generated_ts") < F.col("origin_ts"), "GENERATED_BEFORE_ORIGIN").when(F.col("known_after") >= F.col("h"), "HINDSIGHT")
    return out.withColumn("violation", reason)


def guarded(forecasts: DataFrame, publications: DataFrame, stored: DataFrame, on: Sequence[str], identity: Sequence[str], mode: str = "PROSPECTIVE", segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """What becomes of each candidate for a ledger of forecasts: adds known_after and outcome.

    Candidates: id, mode, target_id, origin_ts, origin_published, generated_ts, h and the identity columns. The first rule
    that one breaks is its outcome: MODE, TARGET_KNOWN (a forecast that names its target), TIMES
    (generated before the origin, or a time is missing), HINDSIGHT (h later publications were known). Of the rest those that
    the ledger has, by identity with the origin's time or with its publication, are STORED, and of several with
    one identity and time the first by id is INSERTED, the others REPEATED. Null identity parts equal each other.
    """
    x = insert_violations(forecasts, publications, on, segment_rows).drop("violation")
    broken = (
        F.when(~F.col("mode").eqNullSafe(mode), "MODE").when(F.col("target_id").isNotNull(), "TARGET_KNOWN")
        .when(F.col("generated_ts").isNull() | F.col("origin_ts").isNull() | (F.col("generated_ts") < F.col("origin_ts")), "TIMES").when(F.col("known_after") >= F.col("h"), "HINDSIGHT")
    )
    x = x.withColumn("_broken", broken)
    for at, name in (("origin_ts", "_same"), ("origin_published", "_published")):
        held = stored.where(F.col("mode") == mode).select(*[F.col(c).alias(f"_{c}") for c in (*identity, at)]).where(F.col(f"_{at}").isNotNull()).distinct().withColumn(name, F.lit(True))
        same = F.col(at) == F.col(f"_{at}")
        for c in identity:
            same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
        x = x.join(held, same, "left").drop(*[f"_{c}" for c in (*identity, at)])
    # Two candidates with one identity: a minimum by identity, combined map-side.
    fresh = F.col("_broken").isNull() & F.col("_same").isNull() & F.col("_published").isNull()
    by = [*identity, "origin_ts"]
    first = x.where(fresh).groupBy(*[F.col(c).alias(f"_{c}") for c in by]).agg(F.min("id").alias("_first"))
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    x = x.join(first, same, "left").drop(*[f"_{c}" for c in by])
    outcome = F.coalesce(F.col("_broken"), F.when(F.col("_same").isNotNull() | F.col("_published").isNotNull(), "STORED"), F.when(F.col("id") == F.col("_first"), "INSERTED").otherwise("REPEATED"))
    return x.withColumn("outcome", outcome).drop("_broken", "_same", "_published", "_first")


def snapshots_to_store(accepted: DataFrame, stored: DataFrame, key: Sequence[str]) -> DataFrame:
    """One row for each snapshot of the accepted forecasts that isn't stored yet."""
    return new_rows(accepted.select(*key).distinct(), stored, key)


def mature(series: DataFrame, key: Sequence[str], order: Sequence[str], horizons: Sequence[int], generated: str = "generated_ts") -> DataFrame:
    """A row for each origin and horizon whose h-th later publication exists and came after generation."""
    w = Window.partitionBy(*key).orderBy(*order)
    out = None
    for h in horizons:
        at = series.withColumn("h", F.lit(h)).withColumn("target_ts", F.lead("ts", h).over(w)).withColumn("target_value", F.lead("value", h).over(w))
        at = at.where(F.col("target_ts").isNotNull() & (F.col("target_ts") > F.col(generated)))
        out = at if out is None else out.unionByName(at)
    return out
