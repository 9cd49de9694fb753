"""Expanding-window ridge forecasts, their evaluation, and the Diebold-Mariano test.

A row's training set is every earlier pair whose target was known: rows up to h before it. Sums
over that window are enough to fit a ridge model, so a forecast needs no loop over refits; one
Arrow function solves all rows of a batch at once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from tidemark.operators.scan import Series, has_long_keys, number, scanned, shifted, total
from tidemark.sources.io import materialised

ALPHA = 5.0
#: Neutral band of a log return, smallest residual scale, bounds of a prediction and of a probability.
NEUTRAL, LEAST_SCALE, MOST_RETURN, LEAST_SURE = 0.0005, 0.004, 0.10, 0.05


def direction(lr: Column, neutral: float = NEUTRAL) -> Column:
    return F.when(lr > neutral, "UP").when(lr < -neutral, "DOWN").when(lr.isNotNull(), "NEUTRAL").otherwise("UNAVAILABLE")


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.lit(-12.0), F.least(F.lit(12.0), x))))


def _numbered(df: DataFrame, w: WindowSpec | Series) -> DataFrame:
    """df with _nth, from 0."""
    if isinstance(w, Series):
        return scanned(df, w, {"_nth": number()}).withColumn("_nth", F.col("_nth") - 1)
    return df.withColumn("_nth", F.row_number().over(w) - 1)


def _ahead(df: DataFrame, w: WindowSpec | Series, value: str, h: int, name: str) -> DataFrame:
    return scanned(df, w, {name: shifted(F.col(value), -h)}) if isinstance(w, Series) else df.withColumn(name, F.lead(value, h).over(w))


def _past_sums(df: DataFrame, w: WindowSpec | Series, h: int, values: dict[str, Column]) -> DataFrame:
    """df with a column for each value: its sum over the rows up to h before."""
    if isinstance(w, Series) and has_long_keys(df, w):
        moved = scanned(df, w, {"_moved": shifted(F.struct(*[v.alias(n) for n, v in values.items()]), h)})
        return scanned(moved, w, {n: total(F.col("_moved")[n]) for n in values}).drop("_moved")
    past = (w.window() if isinstance(w, Series) else w).rowsBetween(Window.unboundedPreceding, -h)
    return df.select("*", *[F.sum(v).over(past).alias(n) for n, v in values.items()])


def ridge_one(df: DataFrame, w: WindowSpec | Series, x: str, y: str, h: int, start: int = 5, least: int = 10, alpha: float = ALPHA) -> DataFrame:
    """Adds n_train and prediction of a ridge model on one standardised feature, in closed form."""
    df = _numbered(df, w).withColumn("_ok", (F.col("_nth") >= start) & F.col(x).isNotNull() & F.col(y).isNotNull())
    s = lambda c: F.when(F.col("_ok"), c)
    df = _past_sums(df, w, h, {"_n": s(F.lit(1)), "_sx": s(F.col(x)), "_sy": s(F.col(y)), "_sxx": s(F.col(x) * F.col(x)), "_sxy": s(F.col(x) * F.col(y))})
    df = df.withColumn("n_train", F.coalesce("_n", F.lit(0).cast("long"))).withColumn("_x", F.col("_sx") / F.col("_n")).withColumn("_y", F.col("_sy") / F.col("_n"))
    df = df.withColumn("_xx", F.col("_sxx") / F.col("_n") - F.col("_x") * F.col("_x")).withColumn("_xy", F.col("_sxy") / F.col("_n") - F.col("_x") * F.col("_y"))
    slope = F.when(F.col("_xx") > 1e-24, F.col("n_train") * F.col("_xy") / (F.col("_xx") * (F.col("n_train") + alpha))).otherwise(0.0)
    return df.withColumn("prediction", F.when(F.col("n_train") >= least, F.col("_y") + (F.col(x) - F.col("_x")) * slope)).drop("_nth", "_ok", "_n", "_sx", "_sy", "_sxx", "_sxy", "_x", "_y", "_xx", "_xy")


def _solve(n: np.ndarray, sx: np.ndarray, sxx: np.ndarray, sy: np.ndarray, sxy: np.ndarray, syy: np.ndarray, x: np.ndarray, least: int, alpha: float) -> tuple[np.ndarray, np.ndarray]:
    """Predictions and the share of probability above zero, of all rows at once."""
    ok = n >= least
    size = np.where(ok, n, 1.0)
    mean, y = sx / size[:, None], sy / size
    cov = sxx / size[:, None, None] - mean[:, :, None] * mean[:, None, :]
    scale = np.sqrt(np.maximum(np.einsum("ikk->ik", cov), 0))
    used = scale > 1e-12
    inverse = np.where(used, 1 / np.where(used, scale, 1), 0.0)
    z = (x - mean) * inverse
    gram = cov * inverse[:, :, None] * inverse[:, None, :] * size[:, None, None]
    cross = (sxy / size[:, None] - mean * y[:, None]) * inverse * size[:, None]
    weights = np.linalg.solve(gram + alpha * np.eye(x.shape[1]), cross[:, :, None])[:, :, 0]
    out = np.clip(y + (z * weights).sum(1), -MOST_RETURN, MOST_RETURN)
    # The centred model's residuals sum to zero, so their variance needs only these sums.
    rss = np.maximum(syy - size * y * y - 2 * (weights * cross).sum(1) + np.einsum("ij,ijk,ik->i", weights, gram, weights), 0)
    sd = np.maximum(LEAST_SCALE, np.sqrt(rss / np.maximum(size - 1, 1)))
    up = np.clip(1 / (1 + np.exp(-np.clip(out / sd, -12, 12))), LEAST_SURE, 1 - LEAST_SURE)
    return np.where(ok, out, np.nan), np.where(ok, up, np.nan)


def ridge_many(df: DataFrame, w: WindowSpec | Series, xs: Sequence[str], y: str, h: int, start: int = 5, least: int = 10, alpha: float = ALPHA, usable: Column | None = None) -> DataFrame:
    """Adds n_train, prediction and up_score of a ridge model on standardised features.

    Features without variance are left out, the intercept is free, predictions stay within
    MOST_RETURN and the score within LEAST_SURE of 0 and 1. usable: rows that train and forecast.
    """
    k = len(xs)
    can = F.lit(True) if usable is None else F.coalesce(usable, F.lit(False))
    known = can
    for c in (*xs,):
        known = known & F.col(c).isNotNull()
    df = (df if "_nth" in df.columns else _numbered(df, w)).withColumn("_can", known).withColumn("_ok", known & (F.col("_nth") >= start) & F.col(y).isNotNull())
    terms = [F.lit(1.0), F.col(y), F.col(y) * F.col(y), *[F.col(a) for a in xs], *[F.col(a) * F.col(y) for a in xs], *[F.col(xs[i]) * F.col(xs[j]) for i in range(k) for j in range(i, k)]]
    names = [f"_s{i}" for i in range(len(terms))]
    df = _past_sums(df, w, h, {n: F.when(F.col("_ok"), c.cast("double")) for n, c in zip(names, terms)})

    @F.arrow_udf("prediction double, up_score double")
    def solve(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for sums, x in batches:
            # Lists of one length, side by side in memory: no object for each row.
            m, now = (c.flatten().to_numpy(zero_copy_only=False).reshape(len(c), -1) for c in (sums, x))
            sxx = np.zeros((len(m), k, k))
            at = 3 + 2 * k
            for i in range(k):
                for j in range(i, k):
                    sxx[:, i, j] = sxx[:, j, i] = m[:, at]
                    at += 1
            p, up = _solve(m[:, 0], m[:, 3 : 3 + k], sxx, m[:, 1], m[:, 3 + k : 3 + 2 * k], m[:, 2], np.nan_to_num(now), least, alpha)
            yield pa.StructArray.from_arrays([pa.array(p), pa.array(up)], ["prediction", "up_score"])

    df = df.withColumn("_sums", F.array(*[F.coalesce(n, F.lit(0.0)) for n in names])).drop(*names).withColumn("_x", F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in xs]))
    df = df.withColumn("_r", solve("_sums", "_x")).withColumn("n_train", F.get("_sums", F.lit(0)).cast("int"))
    keep = lambda c: F.when(F.col("_can") & ~F.isnan(F.col(f"_r.{c}")), F.col(f"_r.{c}"))
    return df.withColumn("prediction", keep("prediction")).withColumn("up_score", keep("up_score")).drop("_sums", "_x", "_r", "_nth", "_ok", "_can")


def arms(df: DataFrame, w: WindowSpec | Series, value: str, price: Sequence[str], news: Sequence[str], covered: str, horizons: Sequence[int]) -> DataFrame:
    """Four forecasts of each origin and horizon: NO_CHANGE, PRICE_ONLY, NEWS_ONLY and HYBRID.

    Columns are those of df with h, actual, arm, status, prediction, up_score, price and direction.
    News arms train and forecast on covered origins only; coverage is judged before sample size.
    Origins with their numbers and targets are a table that all arms read, so what they come from is worked out once.
    """
    out, names = None, df.columns
    df = _numbered(materialised(df), w)
    for h in horizons:
        df = _ahead(df, w, value, h, f"_then{h}")
    df = materialised(df)
    for h in horizons:
        base = df.select(*[F.col(f"`{c}`") for c in names], F.lit(h).alias("h"), F.ln(F.col(f"_then{h}") / F.col(value)).alias("actual"), "_nth")
        has = F.coalesce(F.col(covered), F.lit(False))
        for arm, xs, usable in (("NO_CHANGE", (), None), ("PRICE_ONLY", price, None), ("NEWS_ONLY", news, has), ("HYBRID", (*price, *news), has)):
            if xs:
                part = ridge_many(base, w, xs, "actual", h, usable=usable)
                missing = F.lit(False) if usable is None else ~has
                status = F.when(missing, "NEWS_UNAVAILABLE").when(F.col("prediction").isNull(), "INSUFFICIENT_SAMPLE").otherwise("OK")
                part = part.withColumn("status", status)
            else:
                part = base.drop("_nth").withColumn("n_train", F.lit(0)).withColumn("prediction", F.lit(0.0)).withColumn("up_score", F.lit(0.5)).withColumn("status", F.lit("OK"))
            part = part.withColumn("arm", F.lit(arm)).withColumn("price", F.round(F.col(value) * F.exp("prediction"), 2)).withColumn("direction", direction(F.col("prediction")))
            out = part if out is None else out.unionByName(part)
    return out


def errors(df: DataFrame, value: str) -> DataFrame:
    """Adds absolute and squared errors, hits and the Brier term of forecasts with an outcome."""
    up = (F.col("actual") > 0).cast("double")
    df = df.where(F.col("actual").isNotNull() & F.col("prediction").isNotNull())
    return (
        df.withColumn("abs_error", F.abs(F.col("prediction") - F.col("actual")))
        .withColumn("sq_error", (F.col("prediction") - F.col("actual")) * (F.col("prediction") - F.col("actual")))
        .withColumn("abs_amount", F.abs(F.col(value) * F.exp("prediction") - F.col(value) * F.exp("actual")))
        .withColumn("hit", (direction(F.col("prediction")) == direction(F.col("actual"))).cast("double"))
        .withColumn("brier", (F.col("up_score") - up) * (F.col("up_score") - up))
    )


def metrics(df: DataFrame, by: Sequence[str], least: int = 30) -> DataFrame:
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg("abs_error").alias("mae"), F.sqrt(F.avg("sq_error")).alias("rmse"), F.avg("abs_amount").alias("mae_amount"), F.avg("hit").alias("accuracy"), F.avg("brier").alias("brier"),
    ).withColumn("status", F.when(F.col("n") >= least, "OK").otherwise("PRELIMINARY"))


def paired(df: DataFrame, origin: Sequence[str], arm: str, n_arms: int) -> DataFrame:
    """Rows of the origins that all arms have."""
    both = df.groupBy(*origin).agg(F.count_distinct(arm).alias("_n")).where(F.col("_n") == n_arms).drop("_n")
    return df.join(both, list(origin), "left_semi")


def not_overlapping(df: DataFrame, index: str, h: Column, start: int = 5) -> DataFrame:
    """Every h-th origin from the first, so that targets do not overlap."""
    return df.where((F.col(index) - start) % h == 0)


def _beta_fraction(a: float, b: float, x: float) -> float:
    """The continued fraction of the incomplete beta function, by the modified Lentz method."""
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 400):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        for t in (even, odd):
            d, c = 1 + t * d, 1 + t / c
            d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
            out *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return out


def t_two_sided(t: float, df: float) -> float:
    """P(|T| >= |t|) of Student's distribution: the regularised incomplete beta function."""
    if not (math.isfinite(t) and df > 0):
        return math.nan
    x, a, b = df / (df + t * t), df / 2, 0.5
    if x >= 1:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) if x > 0 else 0.0
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def diebold_mariano(df: DataFrame, by: Sequence[str], order: Sequence[str], a: str, b: str, h: int = 1, least: int = 20) -> DataFrame:
    """Of each group: n, mean loss difference a - b, statistic and status; see with_p_values.

    Bartlett weights up to lag h - 1, the small-sample factor, and gates in this order: too few,
    not finite, identical, constant, no variance.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    d = df.withColumn("_d", F.col(a) - F.col(b))
    finite = ~(F.isnan("_d") | (F.abs("_d") == float("inf")) | F.col("_d").isNull())
    d = d.withColumn("_mean", F.avg("_d").over(Window.partitionBy(*by))).withColumn("_c", F.col("_d") - F.col("_mean"))
    for lag in range(1, h):
        d = d.withColumn(f"_l{lag}", F.col("_c") * F.lag("_c", lag).over(w))
    g = d.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.min(finite).alias("_finite"), F.avg("_d").alias("mean_difference"), F.max(F.abs("_d")).alias("_most"), F.stddev_pop("_d").alias("_sd"),
        (F.sum(F.col("_c") * F.col("_c")) / F.count(F.lit(1))).alias("_v"), *[(2 * (1 - lag / h) * F.sum(f"_l{lag}") / F.count(F.lit(1))).alias(f"_v{lag}") for lag in range(1, h)],
    )
    n = F.col("n")
    g = g.withColumn("_lrv", sum([F.col(f"_v{lag}") for lag in range(1, h)], F.col("_v"))).withColumn("_factor", (n + 1 - 2 * h + h * (h - 1) / n) / n)
    status = (
        F.when(n < least, "INSUFFICIENT_SAMPLE").when(~F.col("_finite"), "NOT_FINITE").when(F.col("_most") < 1e-12, "IDENTICAL")
        .when(F.col("_sd") < 1e-12, "CONSTANT").when((F.col("_lrv") <= 1e-18) | (F.col("_factor") <= 0), "NO_VARIANCE").otherwise("COMPUTED")
    )
    g = g.withColumn("status", status)
    stat = F.round(F.col("mean_difference") / F.sqrt(F.col("_lrv") / n) * F.sqrt("_factor"), 4)
    return g.withColumn("statistic", F.when(F.col("status") == "COMPUTED", stat)).select(*by, "n", "mean_difference", "statistic", "status")


def with_p_values(df: DataFrame, statistic: str = "statistic", n: str = "n") -> DataFrame:
    """Adds the two-sided p-value of the statistic with n - 1 degrees of freedom."""

    @F.pandas_udf("double")
    def p(t: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(x) else round(t_two_sided(float(x), float(k) - 1), 6) for x, k in zip(t, n)], dtype="float64")

    return df.withColumn("p_value", p(F.col(statistic), F.col(n)))


def fit_trees(df: DataFrame, xs: Sequence[str], label: str, order: str, share: float = 0.8, least: int = 50, trees: int = 300, depth: int = 4):
    """A boosted regressor on the first `share` of rows in order, and its RMSE on the rest; None below `least` rows."""
    from pyspark.ml.evaluation import RegressionEvaluator
    from pyspark.ml.regression import GBTRegressor

    split = _early_and_late(df, xs, label, order, share, least)
    if split is None:
        return None
    model = GBTRegressor(labelCol=label, maxIter=trees, maxDepth=depth, seed=1).fit(split[0])
    return model, RegressionEvaluator(labelCol=label).evaluate(model.transform(split[1]))


def fit_classes(df: DataFrame, xs: Sequence[str], label: str, order: str, share: float = 0.8, least: int = 50, trees: int = 300, depth: int = 4):
    """A forest of classes (0, 1, 2 ...) on the first `share` of rows in order, and its accuracy on the rest; None below `least` rows."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator

    split = _early_and_late(df, xs, label, order, share, least)
    if split is None:
        return None
    model = RandomForestClassifier(labelCol=label, numTrees=trees, maxDepth=depth, seed=1).fit(split[0])
    return model, MulticlassClassificationEvaluator(labelCol=label, metricName="accuracy").evaluate(model.transform(split[1]))


def _early_and_late(df: DataFrame, xs: Sequence[str], label: str, order: str, share: float, least: int) -> tuple[DataFrame, DataFrame] | None:
    from pyspark.ml.feature import VectorAssembler

    df = df.dropna(subset=[*xs, label])
    if df.count() < least:
        return None
    cut = df.select(F.unix_micros(F.col(order).cast("timestamp")).alias("t")).approxQuantile("t", [share], 0.001)[0]
    rows = VectorAssembler(inputCols=list(xs), outputCol="features").transform(df)
    early = F.unix_micros(F.col(order).cast("timestamp")) <= cut
    return rows.where(early), rows.where(~early)


def delta_ridge(df: DataFrame, key: Sequence[str], order: Sequence[str], feature: str, target: str, alpha: float = 5.0, least: int = 15) -> DataFrame:
    """Adds predicted: the ridge forecast of the change `target`, fitted on the rows before with a known change.

    One standardised feature, missing ones as zero, a spread under 1e-6 as one, the intercept free and
    nothing clamped; null before `least` rows. Window sums do it, so a fit costs nothing extra.
    """
    x, y = F.coalesce(F.col(feature), F.lit(0.0)), F.col(target)
    w = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    known = lambda c: F.sum(F.when(y.isNotNull(), c)).over(w)
    n, sx, sy, sxx, sxy = known(F.lit(1.0)), known(x), known(y), known(x * x), known(x * y)
    mean = sx / n
    variance = F.greatest(sxx / n - mean * mean, F.lit(0.0))
    sd = F.when(F.sqrt(variance) < 1e-6, 1.0).otherwise(F.sqrt(variance))
    weight = (sxy - mean * sy) / sd / (n * variance / (sd * sd) + alpha)
    return df.withColumn("predicted", F.when(n >= least, sy / n + weight * (x - mean) / sd))


def walk_forward_summary(df: DataFrame, group: Sequence[str], actual: str, predicted: str, flat: float = 5.0) -> DataFrame:
    """Errors and directions of forecast changes by group: mae, rmse, error_std, max_error, directional_pct, brier.

    A flat outcome counts as met by a forecast of less than `flat`; the Brier figure is a function of
    hits and misses only.
    """
    a, p = F.col(actual), F.col(predicted)
    hit = ((F.signum(a) == F.signum(p)) | ((a == 0) & (F.abs(p) < flat))).cast("double")
    x = df.where(p.isNotNull() & a.isNotNull()).withColumn("_e", F.round(F.abs(a - p), 2)).withColumn("_hit", hit)
    return x.groupBy(*group).agg(
        F.round(F.avg("_e"), 2).alias("mae"), F.round(F.sqrt(F.avg(F.col("_e") * F.col("_e"))), 2).alias("rmse"), F.round(F.stddev_pop("_e"), 2).alias("error_std"), F.max("_e").alias("max_error"),
        F.round(F.avg("_hit") * 100, 1).alias("directional_pct"), F.round(F.avg((1 - F.col("_hit")) * (1 - F.col("_hit")) * 0.25 + 0.15), 4).alias("brier"), F.count(F.lit(1)).alias("folds"),
    )


def readiness(samples: DataFrame, group: Sequence[str], needed: int) -> DataFrame:
    """Whether a group has samples enough for a model, and how far it is."""
    n = samples.groupBy(*group).agg(F.count(F.lit(1)).alias("samples"))
    return n.withColumn("is_ready", F.col("samples") >= needed).withColumn("progress_pct", F.round(F.col("samples") / needed * 100, 1)).withColumn("status", F.when(F.col("is_ready"), "READY").otherwise("EXPERIMENTAL_DATA_COLLECTION"))
