"""The observation ledger and its audits: events are polled rates."""

from __future__ import annotations

from pyspark.sql import functions as F

import uuid

from tidemark.operators import ledger, state
from tidemark.plans.base import query, table
from tidemark.sources import io, ledger_table


def _polls(spark, sf):
    """Events as polls: some quarantined, some of the future, some without a date, some in memory only."""
    e, n = table(spark, sf, "events"), F.col("event_id")
    day = F.date_trunc("day", F.col("ts").cast("timestamp"))
    published = F.when(n % 11 == 0, F.lit(None).cast("timestamp")).when(n % 7 == 0, F.col("ts").cast("timestamp") + F.expr("interval 1 hour")).when(n % 2 == 0, day).otherwise(F.date_trunc("hour", F.col("ts").cast("timestamp")))
    return e.select(
        "user_id", n.alias("row_id"), (F.floor(F.col("value") / 20) * 10).cast("decimal(14,2)").alias("price"), F.when(n % 13 == 0, "QUARANTINED").otherwise("VALID").alias("status"), published.alias("published"), F.col("ts").cast("timestamp").alias("observed"),
        F.when(n % 3 == 0, "09:29").alias("raw_time"), (F.col("event_type") == "click").alias("in_memory"), F.col("event_type").isin("purchase", "view").alias("benchmark"), (n % 5 != 0).alias("clock_only"), (n % 19 == 0).alias("closed"),
    )


_POLLS = """p0 AS (SELECT user_id, event_id AS row_id, (floor(value / 20) * 10)::DECIMAL(14,2) AS price, CASE WHEN event_id % 13 = 0 THEN 'QUARANTINED' ELSE 'VALID' END AS status,
    CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 7 = 0 THEN ts + INTERVAL 1 HOUR WHEN event_id % 2 = 0 THEN date_trunc('day', ts) ELSE date_trunc('hour', ts) END AS published, ts AS observed, CASE WHEN event_id % 3 = 0 THEN '09:29' END AS raw_time,
    event_type = 'click' AS in_memory, event_type IN ('purchase', 'view') AS benchmark, event_id % 5 <> 0 AS clock_only, event_id % 19 = 0 AS closed FROM events),
  p1 AS (SELECT *, CASE WHEN status = 'QUARANTINED' THEN 'validation' WHEN published > observed THEN 'future publication' WHEN raw_time IS NOT NULL AND published IS NULL THEN 'source time without a date' END AS reason FROM p0),
  k AS (SELECT *, lag(price) OVER (PARTITION BY user_id ORDER BY observed, row_id) AS previous_price FROM p1 WHERE reason IS NULL AND NOT in_memory),
  k1 AS (SELECT *, previous_price IS NULL OR abs(price - previous_price) > 0.001 AS changed, benchmark AND published IS NOT NULL AS pub FROM k),
  k2 AS (SELECT *, pub AND row_number() OVER (PARTITION BY user_id, published, pub ORDER BY observed, row_id) = 1 AS first FROM k1),
  k3 AS (SELECT *, published + INTERVAL 330 MINUTE AS loc, last_value(CASE WHEN first AND NOT (clock_only AND closed) THEN published + INTERVAL 330 MINUTE END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY observed, row_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM k2),
  k4 AS (SELECT *, first AND clock_only AND (closed OR (NOT changed AND coalesce(strftime(before, '%H:%M') = strftime(loc, '%H:%M') AND before::DATE < loc::DATE, FALSE))) AS carried FROM k3),
  v AS (SELECT *, lag(price) OVER (PARTITION BY user_id, published ORDER BY observed, row_id) AS was FROM k4 WHERE pub AND NOT carried),
  r AS (SELECT row_id, row_number() OVER (PARTITION BY user_id, published ORDER BY observed, row_id) AS revision, lag(row_id) OVER (PARTITION BY user_id, published ORDER BY observed, row_id) AS supersedes FROM v WHERE was IS NULL OR abs(price - was) > 0.001)"""


@query(f"""WITH {_POLLS}
    SELECT p1.row_id, p1.reason, CASE WHEN p1.reason IS NOT NULL THEN 'QUARANTINED' WHEN p1.in_memory THEN 'IN_MEMORY' WHEN k4.previous_price IS NULL THEN 'NEW' WHEN k4.changed THEN 'CHANGED' ELSE 'UNCHANGED' END AS disposition,
        CASE WHEN k4.previous_price IS NOT NULL AND k4.changed THEN p1.price - k4.previous_price END::DOUBLE AS change, r.revision, r.supersedes,
        CASE WHEN k4.carried THEN 'CARRYOVER' WHEN r.revision > 1 THEN 'CORRECTION' WHEN r.revision = 1 OR (k4.row_id IS NOT NULL AND NOT p1.benchmark AND k4.changed) THEN 'ORIGINAL' END AS kind
    FROM p1 LEFT JOIN k4 ON p1.row_id = k4.row_id LEFT JOIN r ON p1.row_id = r.row_id""")
def ledger_upsert(spark, sf):
    """What becomes of each poll: quarantined, kept in memory, new, changed or unchanged, and its revision."""
    out = ledger.disposed(_polls(spark, sf), ["user_id"])
    return out.select("row_id", "reason", "disposition", F.col("change").cast("double").alias("change"), F.col("revision").cast("long").alias("revision"), "supersedes", "kind")


_F = """f AS (SELECT event_id AS id, CASE event_id % 9 WHEN 0 THEN 'GUESS' ELSE 'LIVE' END AS mode, event_type AS arm, event_id % 4 AS h, CASE WHEN event_id % 8 = 0 THEN -1 ELSE event_id END AS origin_id, CASE WHEN event_id % 10 = 0 THEN ts + INTERVAL 1 SECOND ELSE ts END AS origin_ts,
        CASE WHEN event_id % 6 = 0 THEN value + 1 ELSE value END AS origin_price, ts + INTERVAL 5 MINUTE AS known_at, CASE WHEN event_id % 5 = 0 THEN ts ELSE ts + INTERVAL 9 MINUTE END AS generated_ts FROM events)"""


@query(f"""WITH {_F}, x AS (SELECT f.id, list_filter([CASE WHEN mode <> 'LIVE' THEN 'mode' END, CASE WHEN arm = 'error' THEN 'arm' END, CASE WHEN h <= 0 THEN 'horizon' END, CASE WHEN NOT coalesce(e.value >= 2, FALSE) THEN 'origin' END,
        CASE WHEN NOT coalesce(origin_ts = e.ts, FALSE) THEN 'origin time' END, CASE WHEN NOT coalesce(abs(origin_price - e.value) <= 0.001, FALSE) THEN 'origin price' END, CASE WHEN NOT (known_at <= generated_ts AND generated_ts >= origin_ts) THEN 'hindsight' END], lambda s: s IS NOT NULL) AS faults FROM f LEFT JOIN events e ON f.origin_id = e.event_id)
    SELECT id, array_to_string(faults, ',') AS faults FROM x WHERE len(faults) > 0""")
def insert_rules(spark, sf):
    """The seven rules that an inserted forecast has to meet, and which it breaks."""
    e, n, minutes = table(spark, sf, "events"), F.col("event_id"), lambda k: F.col("ts") + F.expr(f"interval {k} minutes")
    f = e.select(
        n.alias("id"), F.when(n % 9 == 0, "GUESS").otherwise("LIVE").alias("mode"), F.col("event_type").alias("arm"), (n % 4).alias("h"), F.when(n % 8 == 0, F.lit(-1)).otherwise(n).alias("origin_id"), F.when(n % 10 == 0, F.col("ts") + F.expr("interval 1 second")).otherwise(F.col("ts")).alias("origin_ts"),
        F.when(n % 6 == 0, F.col("value") + 1).otherwise(F.col("value")).alias("origin_price"), minutes(5).alias("known_at"), F.when(n % 5 == 0, F.col("ts")).otherwise(minutes(9)).alias("generated_ts"),
    )
    pubs = e.select(n.alias("pub_id"), "ts", F.col("value").alias("price"), (F.col("value") >= 2).alias("valid"))
    arms = ["purchase", "view", "click", "signup"]
    return ledger.insert_faults(f, pubs, arms, ["LIVE"]).select("id", F.array_join("faults", ",").alias("faults"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN 'DELETED' ELSE 'UPDATED' END AS violation FROM orders WHERE o_orderkey % 11 = 0 OR o_orderkey % 13 = 0""")
def append_only_guard(spark, sf):
    """Ledger rows that were deleted or updated between two snapshots; rows that came are no fault."""
    o = table(spark, sf, "orders")
    before = o.select("o_orderkey", "o_orderstatus", "o_totalprice")
    after = before.where(F.col("o_orderkey") % 11 != 0).withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 13 == 0, "X").otherwise(F.col("o_orderstatus")))
    more = o.select((-F.col("o_orderkey") - 1).alias("o_orderkey"), "o_orderstatus", "o_totalprice")
    return ledger.append_only_violations(before, after.unionByName(more), ["o_orderkey"])


@query("""SELECT c_custkey, c_name, CASE WHEN c_custkey % 3 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_mktsegment END AS c_mktsegment FROM customer""")
def keyed_merge(spark, sf):
    """Latest rows with the columns that changes bring, nulls too; the rest stays."""
    c = table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    new = c.where(F.col("c_custkey") % 3 == 0).select("c_custkey", (F.col("c_acctbal") + 1).alias("c_acctbal"), F.lit(None).cast("string").alias("c_mktsegment"))
    return ledger.merged_latest(c, new, ["c_custkey"])


@query("""SELECT event_type, count(*) FILTER (WHERE event_id % 13 <> 0) AS usable, count(*) AS everything, count(*) FILTER (WHERE event_id % 13 <> 0 AND event_id % 7 <> 0 AND event_id % 5 <> 0 AND value > 10 AND event_type = 'view') AS official FROM events GROUP BY event_type""")
def authoritative_series(spark, sf):
    """Rows by whether they are usable, and whether they belong to the official series."""
    e, n = table(spark, sf, "events"), F.col("event_id")
    x = e.withColumn("status", F.when(n % 13 == 0, "QUARANTINED").otherwise("VALID"))
    own = ledger.authoritative(F.col("event_type"), F.lit("MAIN"), F.col("status"), F.when(n % 7 != 0, F.col("ts")), F.col("ts"), F.when(n % 5 == 0, "CLOCK_ONLY").otherwise("FULL"), F.col("value") - 10, "view", "MAIN")
    usable = ledger.valid_only(x).groupBy("event_type").agg(F.count(F.lit(1)).alias("usable"))
    every = ledger.valid_only(x.withColumn("own", own), include_quarantined=True).groupBy("event_type").agg(F.count(F.lit(1)).alias("everything"), F.count_if("own").alias("official"))
    return usable.join(every, "event_type").select("event_type", "usable", "everything", "official")


_GUARD = """c AS (SELECT sale_id AS id, CASE WHEN sale_id % 9 = 0 THEN 'BACKTEST' ELSE 'PROSPECTIVE' END AS mode, CASE WHEN sale_id % 11 = 0 THEN sale_id END AS target_id, client_id, status AS arm, priority % 3 + 1 AS h,
        sold_at AS origin_ts, sold_at AS origin_published, arrived_at AS generated_ts FROM (SELECT *, row_number() OVER (PARTITION BY sale_id) AS nth, count(*) OVER (PARTITION BY sale_id) AS n FROM sales WHERE sale_id IS NOT NULL) WHERE n = 1),
    p AS (SELECT client_id, ts, row_number() OVER (PARTITION BY client_id ORDER BY ts) AS rank FROM (SELECT DISTINCT client_id, ts FROM clicks WHERE client_id IS NOT NULL AND ts IS NOT NULL)),
    a AS (SELECT c.*, coalesce(p.rank, 0) AS r1 FROM c ASOF LEFT JOIN p ON c.client_id = p.client_id AND c.origin_ts >= p.ts),
    k AS (SELECT a.*, CASE WHEN generated_ts > origin_ts AND a.client_id IS NOT NULL THEN coalesce(p.rank, 0) - r1 ELSE 0 END AS known_after FROM a ASOF LEFT JOIN p ON a.client_id = p.client_id AND a.generated_ts >= p.ts),
    s AS (SELECT DISTINCT client_id, arm, h, origin_ts FROM c WHERE id % 7 = 0 AND mode = 'PROSPECTIVE' AND origin_ts IS NOT NULL),
    b AS (SELECT k.*, CASE WHEN mode <> 'PROSPECTIVE' THEN 'MODE' WHEN target_id IS NOT NULL THEN 'TARGET_KNOWN' WHEN generated_ts IS NULL OR k.origin_ts IS NULL OR generated_ts < k.origin_ts THEN 'TIMES' WHEN known_after >= k.h THEN 'HINDSIGHT'
        WHEN s.origin_ts IS NOT NULL THEN 'STORED' END AS broken FROM k LEFT JOIN s ON k.client_id IS NOT DISTINCT FROM s.client_id AND k.arm IS NOT DISTINCT FROM s.arm AND k.h IS NOT DISTINCT FROM s.h AND k.origin_ts = s.origin_ts)"""


@query(f"""WITH {_GUARD} SELECT id, known_after::BIGINT AS known_after, coalesce(broken, CASE WHEN id = min(CASE WHEN broken IS NULL THEN id END) OVER (PARTITION BY client_id, arm, h, origin_ts) THEN 'INSERTED' ELSE 'REPEATED' END) AS outcome FROM b""")
def prospective_guard(spark, sf):
    """Sales as forecasts made at their arrival: which of them a ledger takes in, with clicks as publications."""
    n = F.col("sale_id")
    sales = table(spark, sf, "sales").where(n.isNotNull())
    once = sales.groupBy("sale_id").agg(F.count(F.lit(1)).alias("n")).where("n = 1").select("sale_id")
    c = sales.join(once, "sale_id").select(
        n.alias("id"), F.when(n % 9 == 0, "BACKTEST").otherwise("PROSPECTIVE").alias("mode"), F.when(n % 11 == 0, n).alias("target_id"), "client_id", F.col("status").alias("arm"), (F.col("priority") % 3 + 1).alias("h"),
        F.col("sold_at").alias("origin_ts"), F.col("sold_at").alias("origin_published"), F.col("arrived_at").alias("generated_ts"),
    )
    out = state.guarded(c, table(spark, sf, "clicks").select("client_id", "ts"), c.where("id % 7 = 0"), ["client_id"], ["client_id", "arm", "h"])
    return out.select("id", "known_after", "outcome")


@query()
def ledger_append(spark, sf):
    """Sales appended to a new ledger in two overlapping batches, the second twice; read back with each row's first version."""
    path = f"{io.scratch(spark)}/ledger-{uuid.uuid4().hex}"
    sales = table(spark, sf, "sales").select("sale_id", "client_id", "status", "total")
    for batch in ("sale_id % 3 = 0 OR sale_id IS NULL", "sale_id % 2 = 0", "sale_id % 2 = 0"):
        ledger_table.append(sales.where(batch), path, ["sale_id"])
    first = ledger_table.read_ledger(spark, path, sales.schema, as_of=1).select("sale_id", F.lit(1).alias("v"))
    every = ledger_table.read_ledger(spark, path, sales.schema)
    return every.join(first.withColumnRenamed("sale_id", "s"), F.col("sale_id").eqNullSafe(F.col("s")), "left").select("sale_id", F.coalesce("v", F.lit(2)).alias("version"))
