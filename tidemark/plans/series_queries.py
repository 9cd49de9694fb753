"""As-of joins, windows, dedup and revisions over `events` (users' purchases as a price series)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import series as S
from tidemark.operators.asof import asof_join, returns
from tidemark.operators.intervals import interval_join
from tidemark.plans.base import query, table

USER = ["user_id"]
ORDER = ["ts", "event_id"]


def _events(spark: SparkSession, sf: str, *kinds: str) -> DataFrame:
    df = table(spark, sf, "events").drop("props")
    return df.where(F.col("event_type").isin(*kinds)) if kinds else df


def _purchases_views(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    views = _events(spark, sf, "view").select("user_id", F.col("ts").alias("view_ts"), F.col("value").alias("view_value"), F.col("event_id").alias("view_id"))
    return _events(spark, sf, "purchase").drop("event_type"), views


_ASOF = """
    SELECT a.event_id, a.user_id, a.value, b.view_ts, b.view_value, {more}
    FROM (SELECT * FROM events WHERE event_type = 'purchase') a
    ASOF LEFT JOIN (SELECT user_id AS u, ts AS view_ts, value AS view_value FROM events WHERE event_type = 'view') b
    ON a.user_id = b.u AND a.ts {op} b.view_ts"""


@query(_ASOF.format(op=">=", more="(a.value - b.view_value) / nullif(b.view_value, 0) * 100 AS premium_pct"))
def asof_backward(spark, sf):
    a, b = _purchases_views(spark, sf)
    out = asof_join(a, b, USER, "ts", "view_ts", ["view_ts", "view_value"], tie=["view_id"])
    return out.select("event_id", "user_id", "value", "view_ts", "view_value", returns(F.col("view_value"), F.col("value")).alias("premium_pct"))


@query(_ASOF.format(op=">", more="b.view_value IS NOT NULL AS matched"))
def asof_strict(spark, sf):
    a, b = _purchases_views(spark, sf)
    out = asof_join(a, b, USER, "ts", "view_ts", ["view_ts", "view_value"], strict=True, tie=["view_id"])
    return out.select("event_id", "user_id", "value", "view_ts", "view_value", F.col("view_value").isNotNull().alias("matched"))


@query("""WITH s AS (SELECT client_id, sold_at, max(sale_id) AS last_sale FROM sales WHERE client_id IS NOT NULL AND sold_at IS NOT NULL AND sale_id IS NOT NULL GROUP BY ALL)
    SELECT click_id, c.client_id, ts, last_sale FROM clicks c ASOF LEFT JOIN s ON c.client_id = s.client_id AND c.ts >= s.sold_at""")
def asof_tied(spark, sf):
    """Each click with its client's latest sale, of those of one time the one of the highest number: ids of any length tie."""
    sales = table(spark, sf, "sales").where("client_id IS NOT NULL AND sale_id IS NOT NULL").select("client_id", "sold_at", F.col("sale_id").alias("last_sale"))
    clicks = table(spark, sf, "clicks").select("click_id", "client_id", "ts")
    return asof_join(clicks, sales, ["client_id"], "ts", "sold_at", ["last_sale"], tie=["last_sale"])


@query("""
    SELECT event_id, user_id, CASE WHEN view_ts >= ts - INTERVAL 6 HOUR THEN view_value END AS view_value FROM (
        SELECT a.event_id, a.user_id, a.ts, b.view_ts, b.view_value FROM (SELECT * FROM events WHERE event_type = 'purchase') a
        ASOF LEFT JOIN (SELECT user_id AS u, ts AS view_ts, value AS view_value FROM events WHERE event_type = 'view') b
        ON a.user_id = b.u AND a.ts >= b.view_ts)""")
def asof_tolerance(spark, sf):
    a, b = _purchases_views(spark, sf)
    return asof_join(a, b, USER, "ts", "view_ts", ["view_value"], tolerance="6 hours", tie=["view_id"]).select("event_id", "user_id", "view_value")


_LOOK = [("1 hour", "45 minutes", "1h"), ("4 hours", "2 hours", "4h"), ("1 day", "6 hours", "1d"), ("3 days", "1 day", "3d")]


@query(
    "SELECT e.event_id, " + ", ".join(f"(e.value - p{n}.value) / nullif(p{n}.value, 0) * 100 AS ret_{n}" for *_, n in _LOOK) + " FROM events e "
    + " ".join(
        f"LEFT JOIN (SELECT a.event_id, CASE WHEN b.ts >= a.ts - INTERVAL '{back}' - INTERVAL '{tol}' THEN b.value END AS value FROM events a"
        f" ASOF LEFT JOIN events b ON a.user_id = b.user_id AND a.ts - INTERVAL '{back}' >= b.ts) p{n} ON e.event_id = p{n}.event_id"
        for back, tol, n in _LOOK
    )
)
def lookback_returns(spark, sf):
    df = _events(spark, sf)
    past = df.select("user_id", F.col("ts").alias("then"), F.col("value").alias("past"), F.col("event_id").alias("past_id"))
    for back, tol, n in _LOOK:
        df = asof_join(df, past, USER, "ts", "then", ["past"], lookback=back, tolerance=tol, prefix=f"{n}_", tie=["past_id"])
    return df.select("event_id", *[returns(F.col(f"{n}_past"), F.col("value")).alias(f"ret_{n}") for *_, n in _LOOK])


_WINDOWS = [("15m", 900), ("1h", 3600), ("4h", 14400), ("1d", 86400)]


@query(
    "WITH p AS (SELECT a.event_id, epoch_us(a.ts) - epoch_us(b.ts) AS age, b.value, b.event_type FROM events a JOIN events b ON a.user_id = b.user_id"
    " AND b.ts BETWEEN a.ts - INTERVAL 1 DAY AND a.ts AND b.event_type IN ('view', 'click', 'error') WHERE a.event_type = 'purchase')"
    " SELECT e.event_id, "
    + ", ".join(f"round(avg(p.value) FILTER (WHERE age <= {s}000000), 6) AS mean_{n}, count(p.value) FILTER (WHERE age <= {s}000000) AS n_{n}" for n, s in _WINDOWS)
    + ", round(count(*) FILTER (WHERE p.event_type = 'error')::DOUBLE / nullif(count(p.value), 0), 9) AS error_share_1d"
    " FROM (SELECT * FROM events WHERE event_type = 'purchase') e LEFT JOIN p ON e.event_id = p.event_id GROUP BY e.event_id"
)
def multi_window_sentiment(spark, sf):
    """Means, counts and label shares over [T - w, T] for four windows, in one day-wide join."""
    at = _events(spark, sf, "purchase").select("event_id", "user_id", "ts")
    news = _events(spark, sf, "view", "click", "error").select("user_id", F.col("ts").alias("then"), F.col("value").alias("score"), F.col("event_type").alias("label"))
    pairs = interval_join(at, news, USER, "ts", "then", 86400)
    age = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("then").cast("timestamp"))
    aggs = [x for n, s in _WINDOWS for x in (F.avg(F.when(age <= s * 1_000_000, F.col("score"))).alias(f"mean_{n}"), F.count(F.when(age <= s * 1_000_000, F.col("score"))).alias(f"n_{n}"))]
    found = pairs.groupBy("event_id").agg(*aggs, F.try_divide(F.count_if(F.col("label") == "error").cast("double"), F.count("score")).alias("error_share_1d"))
    out = at.select("event_id").join(found, "event_id", "left")
    for n, _ in _WINDOWS:
        out = out.withColumn(f"mean_{n}", F.round(f"mean_{n}", 6)).withColumn(f"n_{n}", F.coalesce(f"n_{n}", F.lit(0)))
    return out.withColumn("error_share_1d", F.round("error_share_1d", 9))


@query("""
    SELECT a.event_id, count(b.event_id) AS n, round(sum(b.value::DECIMAL(18, 6)), 6)::DOUBLE AS total FROM (SELECT * FROM events WHERE event_type = 'purchase') a
    LEFT JOIN (SELECT * FROM events WHERE event_type = 'click') b ON a.user_id = b.user_id AND b.ts >= a.ts - INTERVAL 1 DAY AND b.ts < a.ts GROUP BY a.event_id""")
def halfopen_window_features(spark, sf):
    at = _events(spark, sf, "purchase").select("event_id", "user_id", "ts")
    news = _events(spark, sf, "click").select("user_id", F.col("ts").alias("then"), F.col("value").cast("decimal(18,6)").alias("x"))
    found = interval_join(at, news, USER, "ts", "then", 86400, closed_end=False).groupBy("event_id").agg(F.count("x").alias("n"), F.sum("x").cast("double").alias("total"))
    return at.select("event_id").join(found, "event_id", "left").select("event_id", F.coalesce("n", F.lit(0)).alias("n"), "total")


@query("""
    WITH c AS (SELECT * FROM events WHERE event_type = 'purchase'),
    seen AS (
        SELECT c.event_id AS cutoff, n.event_type AS label, CASE WHEN n.value >= 75 THEN 'b' WHEN n.value < 25 THEN 's' ELSE 'u' END AS impact
        FROM c JOIN events n ON n.user_id = c.user_id AND n.event_type IN ('view', 'click')
         AND n.ts >= c.ts - INTERVAL 1 DAY AND n.ts + INTERVAL 10 MINUTE <= c.ts),
    runs AS (
        SELECT c.event_id AS cutoff, r.value FROM c JOIN events r ON r.user_id = c.user_id AND r.event_type = 'error' AND r.ts BETWEEN c.ts - INTERVAL 1 DAY AND c.ts
        QUALIFY row_number() OVER (PARTITION BY c.event_id ORDER BY r.ts DESC, r.event_id DESC) = 1),
    k AS (
        SELECT cutoff, count(*) AS n_clusters, count(*) FILTER (WHERE impact = 'b') AS b, count(*) FILTER (WHERE impact = 's') AS s, count(*) FILTER (WHERE impact = 'u') AS u FROM seen GROUP BY cutoff)
    SELECT c.event_id, coalesce(runs.value >= 20, FALSE) AS covered,
           CASE WHEN runs.value >= 20 THEN coalesce(k.n_clusters, 0) END AS n_clusters,
           CASE WHEN runs.value >= 20 THEN round(coalesce((k.b - k.s)::DOUBLE / nullif(k.b + k.s + k.u, 0), 0), 9) END AS net_impact,
           CASE WHEN runs.value >= 20 THEN round(coalesce(k.u::DOUBLE / nullif(k.n_clusters, 0), 0), 9) END AS unknown_share
    FROM c LEFT JOIN k ON c.event_id = k.cutoff LEFT JOIN runs ON c.event_id = runs.cutoff""")
def availability_window_features(spark, sf):
    """What was available at each cutoff: both the item and its label, and the latest collection run."""
    cut = _events(spark, sf, "purchase").select("event_id", "user_id", "ts")
    news = _events(spark, sf, "view", "click").select("user_id", F.col("ts").alias("seen"), (F.col("ts") + F.expr("interval 10 minutes")).alias("labelled"), F.when(F.col("value") >= 75, "b").when(F.col("value") < 25, "s").otherwise("u").alias("impact"))
    runs = _events(spark, sf, "error").select("user_id", F.col("ts").alias("done"), F.col("event_id").alias("run_id"), F.col("value").alias("health"))
    k = interval_join(cut, news, USER, "ts", "seen", 86400).where("labelled <= ts").groupBy("event_id").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("impact") == x).alias(x) for x in "bsu"])
    r = interval_join(cut, runs, USER, "ts", "done", 86400).groupBy("event_id").agg(F.max_by("health", F.struct("done", "run_id")).alias("health"))
    covered = F.coalesce(F.col("health") >= 20, F.lit(False))
    net = F.coalesce(F.try_divide((F.col("b") - F.col("s")).cast("double"), F.col("b") + F.col("s") + F.col("u")), F.lit(0.0))
    return cut.select("event_id").join(k, "event_id", "left").join(r, "event_id", "left").select(
        "event_id", covered.alias("covered"),
        F.when(covered, F.coalesce("n", F.lit(0))).alias("n_clusters"),
        F.when(covered, F.round(net, 9)).alias("net_impact"),
        F.when(covered, F.round(F.coalesce(F.try_divide(F.col("u").cast("double"), F.col("n")), F.lit(0.0)), 9)).alias("unknown_share"),
    )


@query("""
    SELECT user_id, event_type AS label, event_id, value FROM events WHERE ts <= TIMESTAMP '2024-01-20 00:00:00'
    QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, CASE WHEN value >= 75 THEN 3 WHEN value >= 25 THEN 2 ELSE 1 END DESC, event_id) = 1""")
def latest_label_asof(spark, sf):
    rank = F.when(F.col("value") >= 75, 3).when(F.col("value") >= 25, 2).otherwise(1)
    last = F.max_by(F.struct("event_id", "value"), F.struct(F.col("ts"), rank, -F.col("event_id")))
    out = _events(spark, sf).where(F.col("ts") <= F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")).groupBy("user_id", F.col("event_type").alias("label")).agg(last.alias("l"))
    return out.select("user_id", "label", "l.event_id", "l.value")


_W = "(PARTITION BY user_id ORDER BY ts, event_id"


@query(f"""
    SELECT event_id, next_time, next_value, next_value - value AS target_change, (next_value - value) / nullif(value, 0) * 100 AS target_change_pct,
           CASE WHEN next_value > value THEN 'UP' WHEN next_value < value THEN 'DOWN' WHEN next_value = value THEN 'FLAT' END AS target_direction
    FROM (SELECT *, lead(ts) OVER {_W}) AS next_time, lead(value) OVER {_W}) AS next_value FROM events)""")
def next_event_target(spark, sf):
    return S.next_target(_events(spark, sf), S.ordered(USER, ORDER), "ts", "value").select("event_id", "next_time", "next_value", "target_change", "target_change_pct", "target_direction")


@query(f"SELECT event_id, value - lag(value) OVER {_W}) AS change, (value - lag(value) OVER {_W})) / nullif(lag(value) OVER {_W}), 0) * 100 AS change_pct FROM events")
def lag_changes(spark, sf):
    return S.changes(_events(spark, sf), S.ordered(USER, ORDER), "value").select("event_id", "change", "change_pct")


@query(f"""
    WITH s AS (SELECT *, {", ".join(f"CASE WHEN value > 0 AND lag(value, {k}) OVER {_W}) > 0 THEN ln(value / lag(value, {k}) OVER {_W})) END AS r{k}" for k in (1, 3, 5))} FROM events)
    SELECT event_id, {", ".join(f"round(coalesce(r{k}, 0), 9) AS ret_{k}" for k in (1, 3, 5))},
           round(CASE WHEN count(r1) OVER {_W} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) >= 2 THEN stddev_pop(r1) OVER {_W} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) ELSE 0 END, 7) AS vol_5
    FROM s""")
def log_returns_vol(spark, sf):
    out = S.log_returns(_events(spark, sf), S.ordered(USER, ORDER), "value")
    return out.select("event_id", *[F.round(f"ret_{k}", 9).alias(f"ret_{k}") for k in (1, 3, 5)], F.round("vol_5", 7).alias("vol_5"))


@query(f"""
    WITH s AS (SELECT *, CASE WHEN row_number() OVER {_W}) > 3 THEN avg(value) OVER {_W} ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) ELSE value END AS sma, lead(value) OVER {_W}) AS nxt FROM events)
    SELECT user_id, count(*) AS n, round(avg(abs(nxt - value)), 6) AS naive_mae, round(sqrt(avg((nxt - value) * (nxt - value))), 6) AS naive_rmse,
           round(avg(abs(nxt - sma)), 6) AS sma_mae, round(sqrt(avg((nxt - sma) * (nxt - sma))), 6) AS sma_rmse FROM s WHERE nxt IS NOT NULL GROUP BY user_id""")
def sma3_baseline(spark, sf):
    w = S.ordered(USER, ORDER)
    df = S.previous_mean(_events(spark, sf), w, "value").withColumn("nxt", F.lead("value").over(w)).where("nxt IS NOT NULL")
    mae = lambda c: F.round(F.avg(F.abs(F.col("nxt") - F.col(c))), 6)
    rmse = lambda c: F.round(F.sqrt(F.avg((F.col("nxt") - F.col(c)) * (F.col("nxt") - F.col(c)))), 6)
    return df.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), mae("value").alias("naive_mae"), rmse("value").alias("naive_rmse"), mae("sma_3").alias("sma_mae"), rmse("sma_3").alias("sma_rmse"))


@query(f"SELECT event_id, gap_minutes, coalesce(gap_minutes > 180, FALSE) AS is_stale FROM (SELECT event_id, (epoch_us(ts) - epoch_us(lag(ts) OVER {_W}))) / 60000000.0::DOUBLE AS gap_minutes FROM events)")
def gap_staleness(spark, sf):
    return S.gaps(_events(spark, sf), S.ordered(USER, ORDER), "ts").select("event_id", "gap_minutes", "is_stale")


@query("SELECT o_orderkey, o_custkey, o_orderdate, o_orderpriority FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderdate ORDER BY o_orderkey) = 1")
def dedup_first(spark, sf):
    return S.keep_one(table(spark, sf, "orders"), ["o_custkey", "o_orderdate"], ["o_orderkey"]).select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")


@query("SELECT o_orderkey, o_orderdate FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderdate ORDER BY o_orderkey DESC) = 1")
def dedup_last(spark, sf):
    return S.keep_one(table(spark, sf, "orders"), ["o_orderdate"], [F.desc("o_orderkey")]).select("o_orderkey", "o_orderdate")


@query("SELECT event_id, row_number() OVER (PARTITION BY ts::DATE, user_id, event_type, floor(value) ORDER BY ts, event_id) > 1 AS is_duplicate FROM events")
def same_day_quarantine(spark, sf):
    df = _events(spark, sf).withColumn("day", F.to_date("ts")).withColumn("price", F.floor("value"))
    return S.duplicates_flagged(df, ["day", "user_id", "event_type", "price"], ORDER).select("event_id", "is_duplicate")


_CHAIN = """
    c AS (SELECT *, ts::DATE AS day, floor(value / 25) AS price FROM events),
    d AS (SELECT *, lag(price) OVER (PARTITION BY user_id, day ORDER BY ts, event_id) AS b FROM c),
    r AS (SELECT *, row_number() OVER (PARTITION BY user_id, day ORDER BY ts, event_id) AS revision_number, lag(event_id) OVER (PARTITION BY user_id, day ORDER BY ts, event_id) AS supersedes
          FROM d WHERE b IS NULL OR abs(price - b) > 0.001)"""


def _chain(spark, sf):
    df = _events(spark, sf).withColumn("day", F.to_date("ts")).withColumn("price", F.floor(F.col("value") / 25))
    return S.revision_chain(df, ["user_id", "day"], ORDER, "price", "event_id")


@query(f"WITH {_CHAIN} SELECT event_id, user_id, day, price, revision_number, supersedes, CASE WHEN revision_number = 1 THEN 'ORIGINAL' ELSE 'CORRECTION' END AS kind FROM r")
def revision_chain(spark, sf):
    return _chain(spark, sf).select("event_id", "user_id", "day", "price", "revision_number", "supersedes", "kind")


@query(f"""
    WITH {_CHAIN}
    SELECT user_id, day, arg_max(price, revision_number) AS value, arg_min(ts, revision_number) AS first_arrival, arg_max(ts, revision_number) AS last_arrival, greatest(arg_min(ts, revision_number), arg_max(ts, revision_number)) AS available_at
    FROM r WHERE ts <= TIMESTAMP '2024-01-15 12:00:00' GROUP BY user_id, day""")
def revision_asof(spark, sf):
    return S.revisions_asof(_chain(spark, sf), ["user_id", "day"], "ts", "revision_number", "price", F.lit("2024-01-15 12:00:00").cast("timestamp_ntz"))


@query(f"""
    SELECT event_id, coalesce(lag(p) OVER {_W}) = p AND lag(h) OVER {_W}) = h, FALSE) AS is_carryover
    FROM (SELECT *, floor(value / 25) AS p, hour(ts) AS h FROM events)""")
def carryover_status(spark, sf):
    df = _events(spark, sf).withColumn("price", F.floor(F.col("value") / 25))
    return S.carryovers(df, S.ordered(USER, ORDER), F.hour("ts"), "price").select("event_id", "is_carryover")


@query(f"""
    WITH b AS (SELECT *, event_type <> 'error' AS ex, concat(event_type, ':', floor(value / 25)::BIGINT) AS sig, dayofweek(ts) = 0 AS sun FROM events),
    s AS (SELECT *, coalesce(lag(sig) OVER {_W}) = sig, FALSE) AS same FROM b),
    a AS (SELECT *, coalesce(max((ex AND NOT same AND NOT (sun AND event_type <> 'view'))::INT) OVER (PARTITION BY user_id, sig ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier FROM s),
    t AS (SELECT *, CASE WHEN ex AND earlier = 1 THEN 'DUPLICATE_POLL' WHEN same THEN 'STALE_CARRYOVER' WHEN NOT ex AND sun THEN 'UNCERTAIN'
                 WHEN ex AND sun AND event_type <> 'view' THEN 'STALE_CARRYOVER' WHEN ex THEN 'VALID' ELSE 'INFERRED' END AS status FROM a)
    SELECT event_id, status, status IN ('VALID', 'INFERRED') AS is_eligible,
           CASE WHEN status IN ('VALID', 'INFERRED') THEN sum((status IN ('VALID', 'INFERRED'))::INT) OVER {_W} ROWS UNBOUNDED PRECEDING) - 1 ELSE -1 END AS sequence_index FROM t""")
def sequence_audit(spark, sf):
    explicit = F.col("event_type") != "error"
    sig = F.concat_ws(":", "event_type", F.floor(F.col("value") / 25).cast("string"))
    out = S.sequence_audit(_events(spark, sf), USER, ORDER, explicit, sig, F.dayofweek("ts") == 1, F.col("event_type") == "view")
    return out.select("event_id", "status", "is_eligible", "sequence_index")
