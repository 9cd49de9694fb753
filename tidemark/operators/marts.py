"""Dashboards: portfolio, alerts, city spreads, signal consensus, review metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def portfolio(holdings: DataFrame, rates: DataFrame) -> DataFrame:
    """Totals by metal of holdings(metal, grams, cost) at rates(metal, rate), shares of the whole.

    A metal without a rate is worth 0 and says so. Costs that are unknown (null or 0) are left
    out of the cost; without a known cost or a rate there is no profit.
    """
    by = holdings.join(rates, "metal", "left").groupBy("metal").agg(
        F.sum("grams").alias("grams"), F.sum(F.when(F.col("cost") > 0, F.col("cost"))).alias("cost"),
        F.sum(F.col("grams") * F.coalesce("rate", F.lit(0))).alias("value"), F.max(F.col("rate").isNotNull()).alias("valuation_available"),
    )
    total = by.agg(F.sum("value").alias("total"))
    return by.crossJoin(F.broadcast(total)).select(
        "metal", "grams", "cost", "value", "valuation_available",
        (F.try_divide(F.col("value"), F.col("total")) * 100).alias("allocation_pct"),
        F.when(F.col("valuation_available"), F.col("value") - F.col("cost")).alias("pnl"),
    )


def alerts(rules: DataFrame, state: DataFrame) -> DataFrame:
    """Each rule(kind, threshold) against the one-row state; thresholds are inclusive, and a rule of
    an unknown kind or without data never triggers."""
    k, t = F.col("kind"), F.col("threshold")
    hit = (
        F.when(k == "PRICE_ABOVE", F.col("price") >= t).when(k == "PRICE_BELOW", F.col("price") <= t)
        .when(k == "PREMIUM_ABOVE", F.col("premium") >= t).when(k == "DAILY_CHANGE_PCT", F.abs("change_pct") >= t)
    )
    return rules.crossJoin(F.broadcast(state)).withColumn("triggered", F.coalesce(hit, F.lit(False)))


def spreads(rates: DataFrame, name: str, value: str, base: Column) -> DataFrame:
    """Each place's difference from the base place's value: amount, percent, basis points."""
    b = rates.where(base).select(F.col(value).alias("base_value")).limit(1)
    diff = F.col(value) - F.col("base_value")
    return rates.crossJoin(F.broadcast(b)).select(name, value, diff.alias("spread"), F.round(F.try_divide(diff, F.col("base_value")) * 100, 3).alias("spread_pct"), F.round(F.try_divide(diff, F.col("base_value")) * 10_000, 1).alias("spread_bps"))


def ranked_discount(df: DataFrame, group: Sequence[str], rank: Sequence[Column], source: str, driver: str, weight: str) -> DataFrame:
    """weight / sqrt(n) / sqrt(k): n-th item of its source and k-th of its driver, in rank order."""
    g = Window.partitionBy(*group, source).orderBy(*rank)
    d = Window.partitionBy(*group, driver).orderBy(*rank)
    n, k = F.row_number().over(g), F.row_number().over(d)
    return df.withColumn("source_nth", n).withColumn("driver_nth", k).withColumn("discounted", F.col(weight) / F.sqrt("source_nth") / F.sqrt("driver_nth"))


def consensus(df: DataFrame, group: Sequence[str], direction: str, weight: str) -> DataFrame:
    """Weights by direction (three places), the overall signal and its confidence; fewer than two
    clusters are insufficient."""
    side = lambda name: F.round(F.sum(F.when(F.col(direction) == name, F.col(weight)).otherwise(0.0)), 3)
    mixed = F.round(F.sum(F.when(~F.col(direction).isin("BULLISH", "BEARISH"), F.col(weight)).otherwise(0.0)), 3)
    w = df.groupBy(*group).agg(side("BULLISH").alias("bull"), side("BEARISH").alias("bear"), mixed.alias("mixed"), F.count(F.lit(1)).alias("clusters"))
    total, gap = F.col("bull") + F.col("bear"), F.abs(F.col("bull") - F.col("bear"))
    spread = gap / F.greatest(total, F.lit(0.001))
    signal = (
        F.when(F.col("clusters") < 2, "INSUFFICIENT_NEWS")
        .when((F.col("bull") >= 0.35) & (F.col("bear") >= 0.35) & (spread < 0.30), "MIXED")
        .when((F.col("bull") >= 1.25 * F.col("bear")) & (F.col("bull") >= 0.35), "BULLISH")
        .when((F.col("bear") >= 1.25 * F.col("bull")) & (F.col("bear") >= 0.35), "BEARISH")
        .when((spread < 0.2) & (total > 0.35), "MIXED")
        .otherwise("NEUTRAL")
    )
    w = w.withColumn("signal", signal)
    sure = F.when((F.col("clusters") >= 5) & (spread >= 0.6) & F.col("signal").isin("BULLISH", "BEARISH"), "HIGH").when((F.col("clusters") >= 3) & (spread >= 0.3), "MEDIUM").otherwise("LOW")
    return w.withColumn("confidence", sure)


def confusion(df: DataFrame, true: str, predicted: str) -> DataFrame:
    return df.groupBy(F.col(true).alias("label"), F.col(predicted).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


def class_scores(matrix: DataFrame) -> DataFrame:
    """Precision, recall and F1 of each label of a confusion matrix."""
    hit = matrix.where("label = predicted").select("label", F.col("n").alias("tp"))
    real = matrix.groupBy("label").agg(F.sum("n").alias("support"))
    said = matrix.groupBy(F.col("predicted").alias("label")).agg(F.sum("n").alias("said"))
    out = real.join(said, "label", "full").join(hit, "label", "left").withColumn("tp", F.coalesce("tp", F.lit(0)))
    out = out.withColumn("precision", F.try_divide(F.col("tp").cast("double"), F.col("said"))).withColumn("recall", F.try_divide(F.col("tp").cast("double"), F.col("support")))
    return out.withColumn("f1", F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))).select("label", "support", "precision", "recall", "f1")


def kappa(matrix: DataFrame) -> DataFrame:
    """Accuracy and Cohen's kappa of a confusion matrix, one row."""
    total = F.sum("n").over(Window.partitionBy())
    m = matrix.withColumn("total", total).withColumn("row", F.sum("n").over(Window.partitionBy("label"))).withColumn("col", F.sum("n").over(Window.partitionBy("predicted")))
    agree = F.sum(F.when(F.col("label") == F.col("predicted"), F.col("n")).otherwise(0)) / F.first("total")
    rows, cols = m.select("label", "row", "total").distinct(), m.select(F.col("predicted").alias("label"), "col").distinct()
    chance = rows.join(cols, "label").agg(F.coalesce(F.sum(F.col("row") * F.col("col")), F.lit(0)).alias("both"), F.first("total").alias("t"))
    base = m.agg(agree.alias("accuracy"), F.first("total").alias("n"))
    pe = F.coalesce(F.col("both") / (F.col("n") * F.col("n")), F.lit(0.0))
    return base.crossJoin(chance).select("n", "accuracy", F.try_divide(F.col("accuracy") - pe, 1 - pe).alias("kappa"))


def stratum_weights(population: DataFrame, sample: DataFrame, stratum: str) -> DataFrame:
    """Inverse sampling weights: share in the population over share in the sample."""
    def share(df: DataFrame, name: str) -> DataFrame:
        by = df.groupBy(stratum).agg(F.count(F.lit(1)).alias(f"{name}_n"))
        return by.withColumn(f"{name}_share", F.col(f"{name}_n") / F.sum(f"{name}_n").over(Window.partitionBy()))

    return share(population, "population").join(share(sample, "sample"), stratum).withColumn("weight", F.col("population_share") / F.col("sample_share"))
