"""News features of events: categories over a day, labels that were available, reviews against a reference."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.intervals import micros
from tidemark.operators.scan import SEGMENT_ROWS, Series, scanned, total

#: Feature -> categories, dimension that counts too, its least score, whether a mean is wanted.
CATEGORY_FEATURES = {
    "fed": (("US_FED_MONETARY_POLICY",), "us", 0.5, True),
    "geopolitical": (("GEOPOLITICS", "TRADE_TARIFFS", "SANCTIONS"), "geopolitical", 0.4, True),
    "india": (("INDIA_RBI", "INDIA_MACRO", "INDIA_INFLATION", "INDIA_FX", "INDIA_BULLION", "INDIA_GOLD_DEMAND", "INDIA_POLICY"), "india", 0.4, True),
    "rbi": (("INDIA_RBI",), None, None, False),
    "usd": (("US_DOLLAR", "GLOBAL_FX"), None, None, True),
    "treasury": (("US_TREASURY_YIELDS",), None, None, False),
    "oil": (("OIL_ENERGY",), None, None, False),
    "china": (("CHINA_GOLD", "CHINA_MACRO"), None, None, False),
    "central_bank_gold": (("CENTRAL_BANK_GOLD",), None, None, False),
    "financial_risk": (("GLOBAL_FINANCIAL_RISK",), None, None, False),
}


def category_features(events: DataFrame, articles: DataFrame, event_id: str, event_ts: str, seconds: int = 86_400, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """A row for each event: counts of ten kinds of articles of the day before it, means of five, the gold mean and ratio.

    articles: published, score, primary, supporting (array), us, geopolitical, india, is_gold. An article
    is of a kind by its primary or a supporting category or by the dimension's score. Means without
    articles are null, never zero; counts are zero.

    No event meets its articles one by one. Time is cut into stretches as long as the window, so a window is the
    end of one stretch and the beginning of the next: a running sum from behind and one from the front, looked up
    once each and added. Nothing is subtracted, so other articles' scores leave no trace in a sum. Work grows
    with articles and events, however many of them a day has.
    """
    width = seconds * 1_000_000
    is_of, means = {"articles": F.lit(True), "gold": F.col("is_gold")}, ["gold"]
    for name, (kinds, dimension, least, mean) in CATEGORY_FEATURES.items():
        is_it = F.col("primary").isin(*kinds) | F.arrays_overlap("supporting", F.array(*map(F.lit, kinds)))
        is_of[name] = is_it | (F.col(dimension) >= least) if dimension else is_it
        means += [name] if mean else []
    bits = F.lit(0)
    for i, c in enumerate(is_of.values()):
        bits = bits + F.when(c, 1 << i).otherwise(0)

    def sides(end: Column, begin: Column) -> Column:
        """Where a row stands in its stretch from the front, and from behind."""
        stretch = lambda c: c - F.pmod(c, F.lit(width))
        return F.inline(F.array(F.struct(F.lit(1).alias("way"), stretch(end).alias("stretch"), end.alias("pos")), F.struct(F.lit(-1).alias("way"), stretch(begin).alias("stretch"), (-begin).alias("pos"))))

    then, at = micros("published"), micros(event_ts)
    told = articles.select(then.alias("_then"), bits.alias("bits"), F.col("score").cast("double").alias("score")).where("_then IS NOT NULL")
    told = told.select(F.lit(None).cast(events.schema[event_id].dataType).alias("id"), "bits", "score", F.lit(0).alias("asks"), sides(F.col("_then"), F.col("_then")))
    asked = events.select(F.col(event_id).alias("id"), at.alias("_at")).where("_at IS NOT NULL")
    asked = asked.select("id", F.lit(None).cast("int").alias("bits"), F.lit(None).cast("double").alias("score"), F.lit(1).alias("asks"), sides(F.col("_at"), F.col("_at") - width))
    sums = {}
    for i, name in enumerate(is_of):
        it = F.col("bits").bitwiseAND(F.lit(1 << i)) != 0
        sums[f"{name}_count"] = F.when(it, 1)
        if name in means:
            sums |= {f"{name}_scored": F.when(it & F.col("score").isNotNull(), 1), f"{name}_sum": F.when(it, F.col("score"))}
    # Articles of one time stand before those who ask, so ties count on either side.
    run = scanned(told.unionByName(asked), Series(("way", "stretch"), ("pos", "asks"), segment_rows), {n: total(c) for n, c in sums.items()})
    by = run.where("asks = 1").groupBy(F.col("id").alias(event_id)).agg(*[F.sum(n).alias(n) for n in sums])
    out = [F.coalesce("articles_count", F.lit(0)).alias("articles")]
    for name in list(is_of)[1:]:
        out.append(F.coalesce(f"{name}_count", F.lit(0)).alias(f"{name}_count"))
        if name in means:
            out.append(F.round(F.col(f"{name}_sum") / F.col(f"{name}_scored"), 4).alias(f"{name}_mean"))
    whole = events.select(event_id).join(by, event_id, "left").select(event_id, *out)
    return whole.withColumn("gold_ratio", F.when(F.col("articles") > 0, F.round(F.col("gold_count") / F.col("articles"), 4)))


def available_labels(articles: DataFrame, labels: DataFrame, cutoff: Column) -> DataFrame:
    """Articles with the labels of their cluster that could be known at `cutoff`.

    Seven conditions: the article verified and seen by then; the label available and created by
    then, available no earlier than the article was seen, and meant for features.
    """
    a = articles.where((F.col("provenance") == "VERIFIED_SOURCE") & F.col("first_seen").isNotNull() & (F.col("first_seen") <= cutoff))
    b = labels.where((F.col("available_at") <= cutoff) & (F.col("created_at") <= cutoff) & F.col("feature_eligible"))
    return a.join(b, "cluster_id").where(F.col("available_at") >= F.col("first_seen"))


def with_reference(sheet: DataFrame, reference: DataFrame, key: str, column: str, classes: Sequence[str], default: str = "UNKNOWN") -> DataFrame:
    """The sheet's value, else the reference's, else the default; what is no class counts as the default."""
    ref = reference.select(key, F.col(column).alias("_ref"))
    text = lambda c: F.nullif(F.btrim(F.col(c)), F.lit(""))
    value = F.upper(F.coalesce(text(column), text("_ref"), F.lit(default)))
    return sheet.join(ref, key, "left").withColumn(column, F.when(value.isin(*classes), value).otherwise(default)).drop("_ref")


def weighted_accuracy(df: DataFrame, true: str, predicted: str, weight: str) -> DataFrame:
    """One row: accuracy, accuracy by weight, and how often the class PRICE_REPORT was right where it was said."""
    right = F.col(true) == F.col(predicted)
    said = F.col(predicted) == "PRICE_REPORT"
    return df.agg(
        F.avg(right.cast("double")).alias("accuracy"), F.try_divide(F.sum(F.when(right, F.col(weight)).otherwise(0.0)), F.sum(weight)).alias("weighted_accuracy"),
        F.try_divide(F.sum((right & said).cast("double")), F.sum(said.cast("double"))).alias("price_report_precision"),
    )
