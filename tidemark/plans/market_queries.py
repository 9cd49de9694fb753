"""Validation, freshness, states, ledgers, marts: rates are events, orders or line items."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import market as M
from tidemark.operators import marts, state
from tidemark.plans.base import query, table


def _ts(text: str):
    return F.lit(text).cast("timestamp_ntz")


SPECS = {"A": M.Spec("gold", "INR", 900.0, 50_000.0), "N": M.Spec("gold", "INR", 900.0, 60_000.0), "R": M.Spec("silver", "USD", 2_000.0, 90_000.0, per_gram=False)}


@query("""
    WITH r AS (
        SELECT l_orderkey, l_linenumber, l_extendedprice AS price, l_returnflag AS product, l_partkey AS source_id, l_quantity AS gram,
               CASE WHEN l_linestatus = 'O' OR l_returnflag <> 'R' THEN 'gold' ELSE 'silver' END AS metal, CASE WHEN l_returnflag = 'R' THEN 'USD' ELSE 'INR' END AS currency,
               lag(l_extendedprice) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice) AS previous FROM lineitem),
    p AS (SELECT *, CASE WHEN product IN ('A', 'N') THEN round((price / gram)::DECIMAL(20, 6), 2)::DOUBLE END AS per FROM r),
    v AS (SELECT *, CASE WHEN product = 'R' THEN price ELSE per END AS value, CASE product WHEN 'R' THEN 2000 ELSE 900 END AS low, CASE product WHEN 'A' THEN 50000 WHEN 'N' THEN 60000 ELSE 90000 END AS high FROM p)
    SELECT l_orderkey, l_linenumber,
        CASE WHEN price IS NULL OR price <= 0 OR abs(source_id - price) < 1e-6 OR (metal <> CASE WHEN product = 'R' THEN 'silver' ELSE 'gold' END) OR value < low OR value > high THEN 'QUARANTINED'
             WHEN product <> 'R' AND abs(price - previous) / previous > 0.20 THEN 'SUSPECT' ELSE 'VALID' END AS status,
        CASE WHEN price IS NULL THEN 'no price' WHEN price <= 0 THEN 'not positive' WHEN abs(source_id - price) < 1e-6 THEN 'price is the source id'
             WHEN metal <> CASE WHEN product = 'R' THEN 'silver' ELSE 'gold' END THEN 'another metal' WHEN value < low OR value > high THEN 'out of bounds'
             WHEN product <> 'R' AND abs(price - previous) / previous > 0.20 THEN 'jump' END AS reason,
        per AS per_gram FROM v""")
def validate_quarantine(spark, sf):
    from pyspark.sql import Window

    df = table(spark, sf, "lineitem").withColumn("previous", F.lag("l_extendedprice").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_extendedprice")))
    metal = F.when((F.col("l_linestatus") == "O") | (F.col("l_returnflag") != "R"), "gold").otherwise("silver")
    currency = F.when(F.col("l_returnflag") == "R", "USD").otherwise("INR")
    v = M.validate(F.col("l_extendedprice"), F.col("l_partkey").cast("string"), F.col("l_returnflag"), metal, currency, F.col("l_quantity"), F.col("previous"), SPECS)
    return df.select("l_orderkey", "l_linenumber", v.alias("v")).select("l_orderkey", "l_linenumber", "v.*")


@query("""SELECT l_orderkey, l_linenumber, round(l_quantity * CASE l_linenumber % 4 WHEN 0 THEN 1 WHEN 1 THEN 10 WHEN 2 THEN 1000 ELSE 31.1034768 END * 0.9167, 4) AS fine
          FROM lineitem""")
def unit_normalise(spark, sf):
    unit = F.element_at(F.array(*map(F.lit, ("1g", "10g", "kg", "oz"))), F.col("l_linenumber") % 4 + 1)
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.round(F.col("l_quantity") * M.grams(unit) * 0.9167, 4).alias("fine"))


@query("""SELECT event_id, abs(value - before) / before > 0.20 AS is_jump FROM (
          SELECT event_id, value, lag(value) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS before FROM events) WHERE before > 0""")
def jump_suspect(spark, sf):
    from pyspark.sql import Window

    df = table(spark, sf, "events").withColumn("before", F.lag("value").over(Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id"))).where("before > 0")
    return df.select("event_id", (F.abs(F.col("value") - F.col("before")) / F.col("before") > 0.20).alias("is_jump"))


@query("""
    WITH a AS (SELECT *, greatest(0, (epoch_us(TIMESTAMP '2024-01-31 12:00:00') - epoch_us(ts)) / 1000000.0::DOUBLE) AS s FROM events)
    SELECT event_id, CASE WHEN event_type = 'error' THEN 'SOURCE_UNAVAILABLE' WHEN user_id % 50 = 0 THEN 'MARKET_CLOSED'
        WHEN event_type = 'purchase' THEN CASE WHEN round(s / 3600, 2) < 16 THEN 'FRESH' WHEN round(s / 3600, 2) < 36 THEN 'DELAYED' ELSE 'STALE' END
        WHEN s <= 120 THEN 'LIVE' WHEN round(s / 3600, 2) < 4 THEN 'FRESH' WHEN round(s / 3600, 2) < 24 THEN 'DELAYED' ELSE 'STALE' END AS freshness,
        CASE WHEN s < 60 THEN concat(floor(s)::BIGINT, 's') WHEN s < 3600 THEN concat(floor(s / 60)::BIGINT, 'm') WHEN s < 86400 THEN concat(floor(s / 3600)::BIGINT, 'h') ELSE concat(floor(s / 86400)::BIGINT, 'd') END AS age
    FROM a""")
def freshness_class(spark, sf):
    now = _ts("2024-01-31 12:00:00")
    seconds = F.greatest(F.lit(0.0), (F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))) / 1e6)
    kind = F.when(F.col("event_type") == "purchase", "BENCHMARK").otherwise("SPOT")
    fresh = M.freshness(F.col("ts"), now, kind, F.col("event_type") == "error", F.col("user_id") % 50 == 0)
    return table(spark, sf, "events").select("event_id", fresh.alias("freshness"), M.age_text(seconds).alias("age"))


@query("""
    WITH l AS (SELECT event_id, ts + INTERVAL 330 MINUTE AS t FROM events)
    SELECT event_id, CASE WHEN dayofweek(t) = 0 OR (dayofweek(t) = 6 AND hour(t) >= 19) THEN 'CLOSED' WHEN hour(t) * 60 + minute(t) BETWEEN 540 AND 1409 THEN 'OPEN' ELSE 'AFTER_HOURS' END AS session,
           (dayofweek(t) + 6) % 7 AS weekday, dayofweek(t) IN (0, 6) AS is_weekend, hour(t) AS hour FROM l""")
def trading_session(spark, sf):
    df = table(spark, sf, "events").withColumn("t", F.col("ts") + F.expr("interval 330 minutes"))
    day = F.weekday("t")
    return df.select("event_id", M.session_status(F.col("t")).alias("session"), day.alias("weekday"), (day >= 5).alias("is_weekend"), F.hour("t").alias("hour"))


@query("""
    WITH c AS (SELECT event_id, ts, hour(ts) * 60 + minute(ts) AS m, (event_id * 7) % 1440 AS clock FROM events)
    SELECT event_id, CASE WHEN clock <= m THEN 'SAME_DAY' WHEN m < 360 AND clock >= 1080 THEN 'PREVIOUS_DAY' WHEN m < 540 AND clock >= 540 AND clock - m >= 120 THEN 'CARRYOVER_CANDIDATE' ELSE 'AMBIGUOUS' END AS status,
           CASE WHEN clock <= m THEN date_trunc('day', ts) + to_minutes(clock) WHEN (m < 360 AND clock >= 1080) OR (m < 540 AND clock >= 540 AND clock - m >= 120) THEN date_trunc('day', ts) - INTERVAL 1 DAY + to_minutes(clock) END AS at
    FROM c""")
def clock_resolution(spark, sf):
    clock = (F.col("event_id") * 7 % 1440).cast("int")
    r = M.resolve_clock(F.col("ts").cast("timestamp"), clock)
    return table(spark, sf, "events").select("event_id", r.alias("r")).select("event_id", F.col("r.at").cast("timestamp_ntz").alias("at"), "r.status")


@query("""SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(html, '<html lang="([a-z]+)"', 1) AS lang,
          len(regexp_extract_all(html, '<p>')) AS paragraphs, try_cast(nullif(regexp_extract(replace(url, ',', ''), '(-?[0-9]+(?:\\.[0-9]+)?)', 1), '') AS DOUBLE) AS first_number FROM pages""")
def html_extract(spark, sf):
    return table(spark, sf, "pages").select(
        "page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.regexp_extract("html", '<html lang="([a-z]+)"', 1).alias("lang"),
        F.size(F.regexp_extract_all("html", F.lit("<p>"), F.lit(0))).alias("paragraphs"), M.number(F.col("url")).alias("first_number"),
    )


@query("SELECT user_id, event_type, arg_max(event_id, ts) AS event_id, arg_max(value, ts) AS value, max(ts) AS ts FROM events GROUP BY user_id, event_type")
def latest_state(spark, sf):
    return state.latest(table(spark, sf, "events"), ["user_id", "event_type"], ["ts", "event_id"], ["event_id", "value", "ts"])


@query("""SELECT user_id, event_id, value, previous, value - previous AS change, (value - previous) / nullif(previous, 0) * 100 AS change_pct FROM (
          SELECT *, lead(value) OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS previous, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS nth FROM events) WHERE nth = 1""")
def latest_with_previous(spark, sf):
    out = state.latest_with_previous(table(spark, sf, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")], "value")
    return out.select("user_id", "event_id", "value", "previous", "change", "change_pct")


@query("""
    WITH a AS (SELECT user_id, arg_max(value, ts) AS value, max(ts) AS ts FROM events WHERE ts < TIMESTAMP '2024-01-20' GROUP BY user_id),
    b AS (SELECT user_id, arg_max(value, ts) AS value, max(ts) AS ts FROM events WHERE ts >= TIMESTAMP '2024-01-20' AND event_type = 'purchase' GROUP BY user_id)
    SELECT coalesce(b.user_id, a.user_id) AS user_id, CASE WHEN b.user_id IS NOT NULL THEN b.value ELSE a.value END AS value, CASE WHEN b.user_id IS NOT NULL THEN b.ts ELSE a.ts END AS ts, b.user_id IS NOT NULL AS from_cache FROM a FULL JOIN b ON a.user_id = b.user_id""")
def overlay_merge(spark, sf):
    e, cut = table(spark, sf, "events"), _ts("2024-01-20 00:00:00")
    stored = state.latest(e.where(F.col("ts") < cut), ["user_id"], ["ts", "event_id"], ["value", "ts"])
    cached = state.latest(e.where((F.col("ts") >= cut) & (F.col("event_type") == "purchase")), ["user_id"], ["ts", "event_id"], ["value", "ts"])
    return state.overlay(stored, cached, ["user_id"])


_CITY = "n AS (SELECT n_name, round(avg(s_acctbal), 6) AS rate FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name)"


def _cities(spark, sf):
    s = table(spark, sf, "supplier").join(F.broadcast(table(spark, sf, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))
    return s.groupBy("n_name").agg(F.round(F.avg("s_acctbal"), 6).alias("rate"))


@query(f"""WITH {_CITY}, b AS (SELECT rate AS base FROM n ORDER BY n_name LIMIT 1)
    SELECT n_name, rate, round(rate - base, 4) AS spread, round((rate - base) / nullif(base, 0) * 100, 3) AS spread_pct, round((rate - base) / nullif(base, 0) * 10000, 1) AS spread_bps FROM n, b""")
def city_matrix(spark, sf):
    from pyspark.sql import Window

    rates = _cities(spark, sf).withColumn("first", F.min("n_name").over(Window.partitionBy()))
    return marts.spreads(rates, "n_name", "rate", F.col("n_name") == F.col("first")).withColumn("spread", F.round("spread", 4))


@query(f"WITH {_CITY} SELECT round(max(rate) - min(rate), 4) AS max_spread, count(*) AS cities FROM n WHERE rate <> 0")
def max_spread(spark, sf):
    return _cities(spark, sf).where("rate <> 0").agg(F.round(F.max("rate") - F.min("rate"), 4).alias("max_spread"), F.count(F.lit(1)).alias("cities"))


@query(f"WITH {_CITY} SELECT nation.n_name, r.rate, r.rate IS NOT NULL AS is_available FROM nation LEFT JOIN (SELECT * FROM n WHERE rate > 4000) r ON nation.n_name = r.n_name")
def matrix_completion(spark, sf):
    return state.complete(table(spark, sf, "nation").select("n_name"), _cities(spark, sf).where("rate > 4000"), "n_name")


_HOLD = """h AS (SELECT c_mktsegment AS metal, sum(l_quantity) AS grams, round(sum(CASE WHEN l_discount > 0 THEN (l_extendedprice)::DECIMAL(18, 2) END), 2)::DOUBLE AS cost
     FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment),
    r AS (SELECT c_mktsegment AS metal, round(avg(c_acctbal), 6) AS rate FROM customer WHERE c_mktsegment <> 'BUILDING' GROUP BY c_mktsegment)"""


@query(f"""WITH {_HOLD}, v AS (SELECT h.metal, grams, cost, grams * coalesce(rate, 0) AS value, rate IS NOT NULL AS valuation_available FROM h LEFT JOIN r ON h.metal = r.metal)
    SELECT metal, grams, cost, round(value, 2) AS value, valuation_available, round(value / nullif(sum(value) OVER (), 0) * 100, 6) AS allocation_pct, CASE WHEN valuation_available THEN round(value - cost, 2) END AS pnl FROM v""")
def portfolio_summary(spark, sf):
    c = table(spark, sf, "customer")
    held = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey"))
    cost = F.when(F.col("l_discount") > 0, F.col("l_extendedprice").cast("decimal(18,2)"))
    rates = c.where("c_mktsegment <> 'BUILDING'").groupBy(F.col("c_mktsegment").alias("metal")).agg(F.round(F.avg("c_acctbal"), 6).alias("rate"))
    out = marts.portfolio(held.select(F.col("c_mktsegment").alias("metal"), F.col("l_quantity").alias("grams"), cost.alias("cost")), rates)
    return out.select("metal", "grams", F.col("cost").cast("double").alias("cost"), F.round("value", 2).alias("value"), "valuation_available", F.round("allocation_pct", 6).alias("allocation_pct"), F.round(F.col("value") - F.when(F.col("valuation_available"), F.col("cost").cast("double")), 2).alias("pnl"))


@query("""
    WITH h AS (SELECT o_orderpriority AS holding, count(*) AS qty FROM orders GROUP BY 1), r AS (SELECT ts::DATE AS day, round(avg(value), 6) AS rate FROM events GROUP BY 1)
    SELECT day, round(sum(qty * rate::DECIMAL(18, 6)), 3)::DOUBLE AS value FROM h, r GROUP BY day""")
def portfolio_history(spark, sf):
    held = table(spark, sf, "orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("qty"))
    rates = table(spark, sf, "events").groupBy(F.to_date("ts").alias("day")).agg(F.round(F.avg("value"), 6).alias("rate"))
    # Five priorities: the broadcast side has as many rows as there are kinds of holdings.
    return rates.crossJoin(F.broadcast(held)).groupBy("day").agg(F.round(F.sum(F.col("qty") * F.col("rate").cast("decimal(18,6)")), 3).cast("double").alias("value"))


@query("""
    WITH s AS (SELECT avg(value) AS price, 2.0 AS premium, -1.5 AS change_pct FROM events)
    SELECT user_id, event_id, CASE event_type WHEN 'purchase' THEN event_value >= value WHEN 'view' THEN event_value <= value WHEN 'click' THEN 2.0 >= value WHEN 'error' THEN abs(change_pct) >= value ELSE FALSE END AS triggered
    FROM (SELECT e.user_id, e.event_id, e.event_type, e.value, s.price AS event_value, s.change_pct FROM events e, s)""")
def alert_eval(spark, sf):
    e = table(spark, sf, "events")
    kinds = {"purchase": "PRICE_ABOVE", "view": "PRICE_BELOW", "click": "PREMIUM_ABOVE", "error": "DAILY_CHANGE_PCT"}
    kind = F.col("event_type")
    rules = e.select("user_id", "event_id", F.coalesce(*[F.when(kind == k, v) for k, v in kinds.items()], F.lit("OTHER")).alias("kind"), F.col("value").alias("threshold"))
    now = e.agg(F.avg("value").alias("price")).select("price", F.lit(2.0).alias("premium"), F.lit(-1.5).alias("change_pct"))
    return marts.alerts(rules, now).select("user_id", "event_id", "triggered")


@query("""
    SELECT o.o_orderkey, CASE WHEN p.o_orderkey IS NULL THEN 'ADDED' WHEN o.k IS NULL THEN 'REMOVED' ELSE 'CHANGED' END AS diff FROM (
        SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, b.o_orderkey AS k, a.o_orderkey AS j FROM (SELECT * FROM orders WHERE o_orderkey % 7 <> 0) a
        FULL JOIN (SELECT * FROM orders WHERE o_orderkey % 11 <> 0) b ON a.o_orderkey = b.o_orderkey
        WHERE a.o_orderkey IS NULL OR b.o_orderkey IS NULL OR a.o_orderkey % 13 = 0) o
    LEFT JOIN (SELECT o_orderkey FROM orders WHERE o_orderkey % 7 <> 0) p ON o.o_orderkey = p.o_orderkey""")
def fullouter_diff(spark, sf):
    """Two snapshots of the orders: each lacks some, and one has some changed."""
    o = table(spark, sf, "orders")
    after = o.where("o_orderkey % 11 <> 0").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 13 == 0, F.lit(None)).otherwise(F.col("o_orderstatus")))
    return state.rows_diff(o.where("o_orderkey % 7 <> 0"), after, ["o_orderkey"])


@query("SELECT o_orderkey FROM orders EXCEPT SELECT l_orderkey FROM lineitem WHERE l_linenumber = 3")
def except_keys(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey").subtract(table(spark, sf, "lineitem").where("l_linenumber = 3").select("l_orderkey"))


@query("SELECT o_custkey, o_orderdate, count(*) AS n FROM orders GROUP BY 1, 2 HAVING count(*) > 1")
def dup_keys(spark, sf):
    return state.duplicate_keys(table(spark, sf, "orders"), ["o_custkey", "o_orderdate"])


@query("""SELECT c_custkey, 'has urgent' AS kind FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')
          UNION ALL SELECT c_custkey, 'no orders' FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)""")
def semi_anti(spark, sf):
    c, o = table(spark, sf, "customer").select("c_custkey"), table(spark, sf, "orders")
    same = F.col("c_custkey") == F.col("o_custkey")
    a = c.join(o.where("o_orderpriority = '1-URGENT'"), same, "left_semi").withColumn("kind", F.lit("has urgent"))
    return a.unionByName(c.join(o, same, "left_anti").withColumn("kind", F.lit("no orders")))


@query("SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderdate < TIMESTAMP '1995-01-01')")
def idempotent_append(spark, sf):
    """Customers to append to a ledger that has those with an early order."""
    ledger = table(spark, sf, "orders").where(F.col("o_orderdate") < _ts("1995-01-01 00:00:00")).select(F.col("o_custkey").alias("c_custkey"))
    return state.new_rows(table(spark, sf, "customer").select("c_custkey", "c_acctbal"), ledger, ["c_custkey"])


@query("""
    WITH f AS (SELECT event_id AS id, user_id, ts AS origin_ts, ts + to_minutes(event_id % 400 - 20) AS generated_ts, 1 + event_id % 3 AS h FROM events WHERE event_type = 'purchase'),
    k AS (SELECT f.id, count(DISTINCT e.ts) AS known_after FROM f LEFT JOIN events e ON e.user_id = f.user_id AND e.ts > f.origin_ts AND e.ts <= f.generated_ts GROUP BY f.id)
    SELECT f.id, k.known_after, CASE WHEN generated_ts < origin_ts THEN 'GENERATED_BEFORE_ORIGIN' WHEN known_after >= h THEN 'HINDSIGHT' END AS violation FROM f JOIN k ON f.id = k.id""")
def hindsight_guard(spark, sf):
    e = table(spark, sf, "events")
    f = e.where("event_type = 'purchase'").select(F.col("event_id").alias("id"), "user_id", F.col("ts").alias("origin_ts"), (F.col("ts") + F.make_dt_interval(F.lit(0), F.lit(0), (F.col("event_id") % 400 - 20).cast("int"))).alias("generated_ts"), (1 + F.col("event_id") % 3).alias("h"))
    return state.insert_violations(f, e.select("user_id", "ts"), ["user_id"]).select("id", "known_after", "violation")


@query("""SELECT event_id, h, target_ts, target_value FROM (
    SELECT event_id, ts, 1 AS h, lead(ts, 1) OVER w AS target_ts, lead(value, 1) OVER w AS target_value FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
    UNION ALL SELECT event_id, ts, 3, lead(ts, 3) OVER w, lead(value, 3) OVER w FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE target_ts > ts + INTERVAL 30 MINUTE""")
def maturation(spark, sf):
    e = table(spark, sf, "events").withColumn("generated_ts", F.col("ts") + F.expr("interval 30 minutes"))
    return state.mature(e, ["user_id"], ["ts", "event_id"], [1, 3]).select("event_id", "h", "target_ts", "target_value")


@query("""SELECT o_orderkey, greatest(o_orderdate, max(l_shipdate)) AS available_at, count(*) FILTER (WHERE l_shipdate < o_orderdate) AS violations FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey, o_orderdate""")
def label_availability(spark, sf):
    j = table(spark, sf, "orders").join(table(spark, sf, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    return j.groupBy("o_orderkey", "o_orderdate").agg(F.max("l_shipdate").alias("last"), F.count_if(F.col("l_shipdate") < F.col("o_orderdate")).alias("violations")).select("o_orderkey", F.greatest("o_orderdate", "last").alias("available_at"), "violations")


@query("SELECT event_id, ts, value FROM events WHERE event_type IN ('purchase', 'view') ORDER BY ts DESC, event_id DESC LIMIT 50 OFFSET 100")
def paged_history(spark, sf):
    return table(spark, sf, "events").where(F.col("event_type").isin("purchase", "view")).orderBy(F.desc("ts"), F.desc("event_id")).offset(100).limit(50).select("event_id", "ts", "value")


@query("SELECT event_id, value FROM events ORDER BY value DESC, event_id LIMIT 25")
def topk_signal(spark, sf):
    return table(spark, sf, "events").orderBy(F.desc("value"), "event_id").limit(25).select("event_id", "value")


@query("""SELECT symbol, price, ts FROM (SELECT event_type AS symbol, value AS price, ts, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1""")
def feature_snapshot(spark, sf):
    return state.latest(table(spark, sf, "events").withColumnsRenamed({"event_type": "symbol", "value": "price"}), ["symbol"], ["ts", "event_id"], ["price", "ts"])


@query("""SELECT user_id, count(*) AS n, count(*) FILTER (WHERE event_type <> 'error') AS n_valid, count(*) FILTER (WHERE event_type = 'error') AS n_quarantined, count(DISTINCT event_type) AS n_types,
          min(ts) AS first_ts, max(ts) AS last_ts, arg_min(value, ts) AS first_value, arg_max(value, ts) AS last_value, min(value) AS low, max(value) AS high FROM events GROUP BY user_id""")
def series_summary(spark, sf):
    return table(spark, sf, "events").groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") != "error").alias("n_valid"), F.count_if(F.col("event_type") == "error").alias("n_quarantined"), F.count_distinct("event_type").alias("n_types"),
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.min_by("value", "ts").alias("first_value"), F.max_by("value", "ts").alias("last_value"), F.min("value").alias("low"), F.max("value").alias("high"),
    )
