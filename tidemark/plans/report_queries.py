"""Dashboards, summaries and audits: what a service or a daily report asks for."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import state
from tidemark.plans.base import query, table


@query("""
    WITH l AS (SELECT user_id, event_type, value, ts, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM events),
    w AS (SELECT user_id, max(value) FILTER (WHERE event_type = 'purchase') AS gold, max(value) FILTER (WHERE event_type = 'view') AS xau, max(value) FILTER (WHERE event_type = 'click') AS usdinr, max(ts) AS watermark, count(*) AS symbols FROM l WHERE n = 1 GROUP BY user_id)
    SELECT user_id, gold, xau, usdinr, xau * usdinr / 31.1034768 AS parity, gold - xau * usdinr / 31.1034768 AS premium, (gold - xau * usdinr / 31.1034768) / nullif(xau * usdinr / 31.1034768, 0) * 100 AS premium_pct, watermark, gold * 1.03 AS with_gst FROM w WHERE symbols >= 3""")
def bullion_dashboard(spark, sf):
    """Latest rates of each series side by side, with import parity, premium and tax."""
    from tidemark.functions import market as M

    last = state.latest(table(spark, sf, "events"), ["user_id", "event_type"], ["ts", "event_id"], ["value", "ts"])
    of = lambda k: F.max(F.when(F.col("event_type") == k, F.col("value")))
    w = last.groupBy("user_id").agg(of("purchase").alias("gold"), of("view").alias("xau"), of("click").alias("usdinr"), F.max("ts").alias("watermark"), F.count(F.lit(1)).alias("symbols")).where("symbols >= 3")
    par = M.parity(F.col("xau"), F.col("usdinr"))
    return w.select("user_id", "gold", "xau", "usdinr", par.alias("parity"), (F.col("gold") - par).alias("premium"), M.premium_pct(F.col("gold"), par).alias("premium_pct"), "watermark", (F.col("gold") * M.GST).alias("with_gst"))


@query("""SELECT event_type AS collector, count(*) AS runs, count(*) FILTER (WHERE value >= 25) AS succeeded, max(ts) AS last_run, max(ts) FILTER (WHERE value >= 25) AS last_success,
    CASE WHEN arg_max(value, ts) >= 75 THEN 'SUCCESS' WHEN arg_max(value, ts) >= 25 THEN 'PARTIAL_FAILURE' ELSE 'FAILED' END AS status FROM events GROUP BY event_type""")
def collector_status(spark, sf):
    last = F.max_by("value", F.struct("ts", "event_id"))
    return table(spark, sf, "events").groupBy(F.col("event_type").alias("collector")).agg(
        F.count(F.lit(1)).alias("runs"), F.count_if(F.col("value") >= 25).alias("succeeded"), F.max("ts").alias("last_run"), F.max(F.when(F.col("value") >= 25, F.col("ts"))).alias("last_success"),
        F.when(last >= 75, "SUCCESS").when(last >= 25, "PARTIAL_FAILURE").otherwise("FAILED").alias("status"),
    )


@query("""SELECT source, count(*) AS n, count(*) FILTER (WHERE quality = 1)::DOUBLE / nullif(count(quality), 0) AS positive, count(*) FILTER (WHERE quality = 0)::DOUBLE / nullif(count(quality), 0) AS negative,
    count(*) FILTER (WHERE toxic = 1) AS flagged, count(*) - count(quality) AS unlabelled FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source""")
def news_summary(spark, sf):
    df = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    share = lambda v: F.try_divide(F.count_if(F.col("quality") == v).cast("double"), F.count("quality"))
    return df.groupBy("source").agg(F.count(F.lit(1)).alias("n"), share(1).alias("positive"), share(0).alias("negative"), F.count_if(F.col("toxic") == 1).alias("flagged"), (F.count(F.lit(1)) - F.count("quality")).alias("unlabelled"))


@query(r"""
    WITH d AS (SELECT doc_id, source, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t, coalesce(length(text), 0) AS n FROM documents),
    s AS (SELECT *, min(doc_id) OVER (PARTITION BY t) AS original FROM d)
    SELECT doc_id, CASE WHEN n = 0 THEN 'INVALID' WHEN regexp_matches(source, '^src1[0-9]$') AND n < 20 THEN 'SYNTHETIC' WHEN original <> doc_id THEN 'DUPLICATE' WHEN n >= 200 THEN 'VERIFIED' ELSE 'HISTORICAL' END AS provenance FROM s""")
def archive_audit(spark, sf):
    """A provenance status for each archived item; the first rule that applies decides."""
    t = F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", " ")
    n = F.coalesce(F.length("text"), F.lit(0))
    # A hash of the text is the key, so that texts do not move.
    df = table(spark, sf, "documents").select("doc_id", "source", F.sha2(t.cast("binary"), 256).alias("t"), n.alias("n"))
    first = df.groupBy("t").agg(F.min("doc_id").alias("original"))
    status = (
        F.when(F.col("n") == 0, "INVALID").when(F.col("source").rlike("^src1[0-9]$") & (F.col("n") < 20), "SYNTHETIC").when(F.col("original") != F.col("doc_id"), "DUPLICATE")
        .when(F.col("n") >= 200, "VERIFIED").otherwise("HISTORICAL")
    )
    return df.join(first, "t").select("doc_id", status.alias("provenance"))


@query("SELECT user_id, event_type, event_id, label FROM (SELECT *, floor(value / 50) AS label, lag(floor(value / 50)) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS before FROM events) WHERE before IS NULL OR label <> before")
def label_append_if_changed(spark, sf):
    """Labels that differ from the one before of the same cluster and model."""
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    df = table(spark, sf, "events").withColumn("label", F.floor(F.col("value") / 50)).withColumn("before", F.lag("label").over(w))
    return df.where("before IS NULL OR label <> before").select("user_id", "event_type", "event_id", "label")


@query("""
    SELECT 'no lines' AS rule, count(*) AS violations FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)
    UNION ALL SELECT 'shipped before ordered', count(*) FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate < o_orderdate
    UNION ALL SELECT 'price out of bounds', count(*) FROM lineitem WHERE l_extendedprice <= 0 OR l_extendedprice > 100000
    UNION ALL SELECT 'unknown customer', count(*) FROM orders LEFT JOIN customer ON o_custkey = c_custkey WHERE c_custkey IS NULL
    UNION ALL SELECT 'repeated key', count(*) FROM (SELECT o_orderkey FROM orders GROUP BY 1 HAVING count(*) > 1)""")
def insert_validation(spark, sf):
    """Rows that break a rule of the ledger, counted by rule."""
    o, li, c = (table(spark, sf, n) for n in ("orders", "lineitem", "customer"))
    same = F.col("o_orderkey") == F.col("l_orderkey")
    rules = {
        "no lines": o.join(li, same, "left_anti"),
        "shipped before ordered": li.join(o, same).where("l_shipdate < o_orderdate"),
        "price out of bounds": li.where("l_extendedprice <= 0 OR l_extendedprice > 100000"),
        "unknown customer": o.join(c, F.col("o_custkey") == F.col("c_custkey"), "left_anti"),
        "repeated key": state.duplicate_keys(o, ["o_orderkey"]),
    }
    out = None
    for name, df in rules.items():
        row = df.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(name).alias("rule"), "violations")
        out = row if out is None else out.unionByName(row)
    return out


@query("""SELECT o_orderstatus AS mode, o_orderpriority AS arm, count(*) AS forecasts, count(DISTINCT o_custkey) AS origins, count(l.k) AS evaluated, min(o_orderdate) AS first_origin, max(o_orderdate) AS last_origin
    FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_linenumber = 2) l ON o_orderkey = l.k GROUP BY 1, 2""")
def ledger_summary(spark, sf):
    done = table(spark, sf, "lineitem").where("l_linenumber = 2").select(F.col("l_orderkey").alias("k")).distinct()
    df = table(spark, sf, "orders").join(done, F.col("o_orderkey") == F.col("k"), "left")
    return df.groupBy(F.col("o_orderstatus").alias("mode"), F.col("o_orderpriority").alias("arm")).agg(F.count(F.lit(1)).alias("forecasts"), F.count_distinct("o_custkey").alias("origins"), F.count("k").alias("evaluated"), F.min("o_orderdate").alias("first_origin"), F.max("o_orderdate").alias("last_origin"))


@query("""SELECT e.event_id, n.event_id AS correction_id, n.value - e.value AS amount FROM events e JOIN (
    SELECT *, lag(event_id) OVER (PARTITION BY user_id, ts::DATE ORDER BY ts, event_id) AS of FROM events) n ON n.of = e.event_id WHERE abs(n.value - e.value) > 50""")
def reassessment_rows(spark, sf):
    """A later correction of the same publication that changes an evaluated value by much."""
    w = Window.partitionBy("user_id", F.to_date("ts")).orderBy("ts", "event_id")
    df = table(spark, sf, "events").withColumn("of", F.lag("event_id").over(w)).withColumn("amount", F.col("value") - F.lag("value").over(w))
    return df.where("abs(amount) > 50").select(F.col("of").alias("event_id"), F.col("event_id").alias("correction_id"), "amount")


@query("SELECT event_id, substr(sha256(concat_ws('|', 'v1', user_id::VARCHAR, event_type)), 1, 16) AS identity, substr(sha256(concat_ws('|', event_type, user_id::VARCHAR)), 1, 32) AS label_hash FROM events")
def identity_hashes(spark, sf):
    return table(spark, sf, "events").select("event_id", T.joined_hash(F.lit("v1"), F.col("user_id"), F.col("event_type"), length=16).alias("identity"), T.joined_hash(F.col("event_type"), F.col("user_id"), length=32).alias("label_hash"))


@query("""SELECT user_id, min(ts) AS first_seen, arg_max(event_type, ts) AS payload, max(ts) AS last_seen FROM events WHERE ts >= TIMESTAMP '2024-01-31' - INTERVAL 72 HOUR AND ts <= TIMESTAMP '2024-01-31' + INTERVAL 15 MINUTE GROUP BY user_id""")
def first_seen_upsert(spark, sf):
    """Within the retention span: a first sighting that never moves later, and the latest payload."""
    from tidemark.streaming.ticks import sane

    now = F.lit("2024-01-31 00:00:00").cast("timestamp_ntz")
    return table(spark, sf, "events").where(sane(F.col("ts"), now)).groupBy("user_id").agg(F.min("ts").alias("first_seen"), F.max_by("event_type", F.struct("ts", "event_id")).alias("payload"), F.max("ts").alias("last_seen"))


@query("""WITH r AS (SELECT conv_id, role, min(turn) AS first FROM conversations GROUP BY 1, 2), o AS (SELECT conv_id, string_agg(role, ';' ORDER BY first) AS order_of_roles FROM r GROUP BY 1)
    SELECT c.conv_id, count(*) AS turns, arg_min(text, turn) AS opening, count(DISTINCT role) AS roles, any_value(order_of_roles) AS order_of_roles FROM conversations c JOIN o ON c.conv_id = o.conv_id GROUP BY c.conv_id""")
def joined_lists(spark, sf):
    """Ordered distinct lists as `;`-joined text."""
    pairs = F.array_sort(F.collect_list(F.struct("turn", "role")))
    out = table(spark, sf, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.min_by("text", "turn").alias("opening"), F.count_distinct("role").alias("roles"), pairs.alias("p"))
    return out.select("conv_id", "turns", "opening", "roles", F.array_join(F.array_distinct(F.transform("p", lambda x: x["role"])), ";").alias("order_of_roles"))


@query("SELECT event_id, try_cast(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_fields(spark, sf):
    return table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("bigint").alias("k"))
