"""Forecasts of each user's event values and their evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import forecast as R
from tidemark.operators import series as S
from tidemark.operators.scan import Series
from tidemark.plans.base import query, table


SERIES = Series(("user_id",), ("ts", "event_id"))


def _w():
    return SERIES.window()


#: The same window in SQL.
_SQL = "(PARTITION BY user_id ORDER BY ts, event_id"


def _series(spark, sf):
    df = table(spark, sf, "events").drop("props").where("value > 0").withColumn("idx", F.row_number().over(_w()) - 1)
    return S.log_returns(df, _w(), "value")


_BASE = f"""e AS (SELECT *, row_number() OVER {_SQL}) - 1 AS idx, coalesce(ln(value / lag(value) OVER {_SQL})), 0) AS x, ln(lead(value) OVER {_SQL}) / value) AS y FROM events WHERE value > 0),
    t AS (SELECT *, CASE WHEN idx >= 5 AND y IS NOT NULL THEN 1 END AS ok FROM e),
    s AS (SELECT *, count(ok) OVER w AS n, sum(x * ok) OVER w AS sx, sum(y * ok) OVER w AS sy, sum(x * x * ok) OVER w AS sxx, sum(x * y * ok) OVER w AS sxy FROM t WINDOW w AS {_SQL} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    p AS (SELECT *, sy / n AS my, sx / n AS mx, sxx / n - (sx / n) * (sx / n) AS vx, sxy / n - (sx / n) * (sy / n) AS cxy FROM s),
    f AS (SELECT event_id, user_id, ts, value, idx, y, n, CASE WHEN n >= 10 THEN my + (x - mx) * CASE WHEN vx > 1e-24 THEN n * cxy / (vx * (n + 5)) ELSE 0 END END AS prediction FROM p)"""


@query(f"WITH {_BASE} SELECT event_id, n AS n_train, round(prediction, 6) AS prediction FROM f")
def ridge_univariate(spark, sf):
    df = S.forward_return(_series(spark, sf), _w(), "value", 1)
    return R.ridge_one(df, SERIES, "ret_1", "fwd_1", 1).select("event_id", "n_train", F.round("prediction", 6).alias("prediction"))


def _arms(spark, sf):
    df = _series(spark, sf)
    per = df.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).cast("double").alias("n_clusters"), F.avg(F.when(F.col("event_type") == "view", 1.0).when(F.col("event_type") == "click", -1.0).otherwise(0.0)).alias("net_impact"), F.avg((F.col("event_type") == "error").cast("double")).alias("unknown_share"))
    per = per.withColumnRenamed("user_id", "u").withColumn("day", F.date_add("day", 1))
    df = df.join(per, (F.col("user_id") == F.col("u")) & (F.to_date("ts") == F.col("day")), "left").drop("u", "day")
    price, news = ["ret_1", "ret_3", "ret_5", "vol_5"], ["n_clusters", "net_impact", "unknown_share"]
    return R.arms(df.withColumn("covered", F.col("n_clusters").isNotNull()), SERIES, "value", price, news, "covered", [1, 3])


@query()
def ridge_multi_arms(spark, sf):
    return _arms(spark, sf).select("event_id", "h", "arm", "status", "n_train", "prediction", "up_score", "price", "direction")


_TWO = f"""{_BASE}, a AS (SELECT event_id, user_id, ts, idx, value, y AS actual, 'NO_CHANGE' AS arm, 0.0::DOUBLE AS prediction FROM f UNION ALL SELECT event_id, user_id, ts, idx, value, y, 'RIDGE', prediction FROM f),
    g AS (SELECT *, abs(prediction - actual) AS abs_error, (prediction - actual) * (prediction - actual) AS sq_error, abs(value * exp(prediction) - value * exp(actual)) AS abs_amount,
        ((CASE WHEN prediction > 0.0005 THEN 1 WHEN prediction < -0.0005 THEN -1 ELSE 0 END) = (CASE WHEN actual > 0.0005 THEN 1 WHEN actual < -0.0005 THEN -1 ELSE 0 END))::INT AS hit FROM a WHERE actual IS NOT NULL AND prediction IS NOT NULL)"""


def _two(spark, sf):
    df = S.forward_return(_series(spark, sf), _w(), "value", 1)
    ridge = R.ridge_one(df, SERIES, "ret_1", "fwd_1", 1).withColumn("actual", F.col("fwd_1"))
    cols = ["event_id", "user_id", "ts", "idx", "value", "actual"]
    a = ridge.select(*cols, F.lit("NO_CHANGE").alias("arm"), F.lit(0.0).alias("prediction"))
    b = ridge.select(*cols, F.lit("RIDGE").alias("arm"), "prediction")
    return R.errors(a.unionByName(b).withColumn("up_score", F.lit(0.5)), "value")


_METRICS = "count(*) AS n, round(avg(abs_error), 6) AS mae, round(sqrt(avg(sq_error)), 6) AS rmse, round(avg(abs_amount), 3) AS mae_amount, round(avg(hit), 6) AS accuracy, CASE WHEN count(*) >= 30 THEN 'OK' ELSE 'PRELIMINARY' END AS status"


def _rounded(df, *by):
    return df.select(*by, "n", F.round("mae", 6).alias("mae"), F.round("rmse", 6).alias("rmse"), F.round("mae_amount", 3).alias("mae_amount"), F.round("accuracy", 6).alias("accuracy"), "status")


@query(f"WITH {_TWO} SELECT user_id, arm, {_METRICS} FROM g GROUP BY user_id, arm")
def arm_metrics(spark, sf):
    return _rounded(R.metrics(_two(spark, sf), ["user_id", "arm"]), "user_id", "arm")


@query(f"WITH {_TWO}, b AS (SELECT event_id FROM g GROUP BY event_id HAVING count(DISTINCT arm) = 2) SELECT arm, {_METRICS} FROM g WHERE event_id IN (SELECT event_id FROM b) AND (idx - 5) % 3 = 0 GROUP BY arm")
def paired_metrics(spark, sf):
    both = R.paired(_two(spark, sf), ["event_id"], "arm", 2)
    return _rounded(R.metrics(R.not_overlapping(both, "idx", F.lit(3)), ["arm"]), "arm")


@query(f"WITH {_TWO}, u AS (SELECT user_id, 1 / (1 + exp(-greatest(-12.0, least(12.0, prediction / 0.5)))) AS p, (actual > 0)::INT AS up FROM g WHERE arm = 'RIDGE') SELECT user_id, count(*) AS n, round(avg((p - up) * (p - up)), 6) AS brier FROM u GROUP BY user_id")
def brier(spark, sf):
    df = _two(spark, sf).where("arm = 'RIDGE'").withColumn("up_score", R.sigmoid(F.col("prediction") / 0.5))
    out = R.metrics(R.errors(df.drop("abs_error", "sq_error", "abs_amount", "hit", "brier"), "value"), ["user_id"])
    return out.select("user_id", "n", F.round("brier", 6).alias("brier"))


_DM = f"""{_TWO}, d AS (SELECT a.user_id, a.ts, a.event_id, a.abs_error - b.abs_error AS d FROM g a JOIN g b ON a.event_id = b.event_id AND a.arm = 'NO_CHANGE' AND b.arm = 'RIDGE'),
    c AS (SELECT *, d - avg(d) OVER (PARTITION BY user_id) AS c FROM d), l AS (SELECT *, c * lag(c) OVER {_SQL}) AS l1, c * lag(c, 2) OVER {_SQL}) AS l2 FROM c),
    m AS (SELECT user_id, count(*) AS n, avg(d) AS dbar, max(abs(d)) AS most, stddev_pop(d) AS sd, sum(c * c) / count(*) + 2 * (2.0 / 3) * sum(l1) / count(*) + 2 * (1.0 / 3) * sum(l2) / count(*) AS lrv FROM l GROUP BY user_id),
    q AS (SELECT *, (n + 1 - 6 + 6.0 / n) / n AS factor, CASE WHEN n < 20 THEN 'INSUFFICIENT_SAMPLE' WHEN most < 1e-12 THEN 'IDENTICAL' WHEN sd < 1e-12 THEN 'CONSTANT' WHEN lrv <= 1e-18 THEN 'NO_VARIANCE' ELSE 'COMPUTED' END AS status FROM m)"""


def _losses(spark, sf):
    g = _two(spark, sf)
    a = g.where("arm = 'NO_CHANGE'").select("event_id", "user_id", "ts", F.col("abs_error").alias("a"))
    return a.join(g.where("arm = 'RIDGE'").select("event_id", F.col("abs_error").alias("b")), "event_id")


@query(f"WITH {_DM} SELECT user_id, n, round(dbar, 6) AS mean_difference, CASE WHEN status = 'COMPUTED' THEN round(dbar / sqrt(lrv / n) * sqrt(factor), 4) END AS statistic, status FROM q")
def diebold_mariano(spark, sf):
    out = R.diebold_mariano(_losses(spark, sf), ["user_id"], ["ts", "event_id"], "a", "b", h=3)
    return out.select("user_id", "n", F.round("mean_difference", 6).alias("mean_difference"), "statistic", "status")


@query()
def diebold_mariano_p(spark, sf):
    return R.with_p_values(R.diebold_mariano(_losses(spark, sf), ["user_id"], ["ts", "event_id"], "a", "b", h=3))
