"""News features, reviews, readiness, pages and histories, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import forecast, news
from tidemark.plans.base import query, table

_KINDS = [c for kinds, *_ in news.CATEGORY_FEATURES.values() for c in kinds]
_PICK = lambda k: "(['" + "', '".join(_KINDS) + f"'])[(event_id * {k}) % {len(_KINDS)} + 1]"


def _feature_sql() -> str:
    out = []
    for name, (kinds, dimension, least, mean) in news.CATEGORY_FEATURES.items():
        listed = "('" + "', '".join(kinds) + "')"
        is_it = f"(a.main IN {listed} OR a.s1 IN {listed} OR a.s2 IN {listed}" + (f" OR a.{dimension} >= {least})" if dimension else ")")
        out.append(f"count(a.event_id) FILTER (WHERE {is_it}) AS {name}_count")
        if mean:
            out.append(f"round(avg(a.score) FILTER (WHERE {is_it}), 4) AS {name}_mean")
    return f"""WITH a AS (SELECT event_id, ts, floor(value) / 4 AS score, {_PICK(1)} AS main, {_PICK(3)} AS s1, {_PICK(5)} AS s2, (event_id % 10) / 10.0::DOUBLE AS us, (event_id % 7) / 10.0::DOUBLE AS geopolitical, (event_id % 9) / 10.0::DOUBLE AS india, event_id % 3 = 0 AS gold FROM events WHERE event_type = 'view'),
    e AS (SELECT event_id, ts FROM events WHERE event_type = 'purchase' AND event_id % 10 = 0)
    SELECT e.event_id, count(a.event_id) AS articles, count(a.event_id) FILTER (WHERE a.gold) AS gold_count, round(avg(a.score) FILTER (WHERE a.gold), 4) AS gold_mean, {", ".join(out)},
        CASE WHEN count(a.event_id) > 0 THEN round(count(a.event_id) FILTER (WHERE a.gold)::DOUBLE / count(a.event_id), 4) END AS gold_ratio
    FROM e LEFT JOIN a ON a.ts <= e.ts AND a.ts >= e.ts - INTERVAL 1 DAY GROUP BY e.event_id"""


@query(_feature_sql())
def category_features(spark, sf):
    """Ten category counts and five means of the news of the day before an event."""
    e, n = table(spark, sf, "events"), F.col("event_id")
    pick = lambda k: F.get(F.array(*map(F.lit, _KINDS)), (n * k % len(_KINDS)).cast("int"))
    a = e.where("event_type = 'view'").select(
        F.col("ts").alias("published"), (F.floor("value") / 4).alias("score"), pick(1).alias("primary"), F.array(pick(3), pick(5)).alias("supporting"),
        *[(n % m / 10).alias(c) for c, m in (("us", 10), ("geopolitical", 7), ("india", 9))], (n % 3 == 0).alias("is_gold"),
    )
    return news.category_features(e.where("event_type = 'purchase' AND event_id % 10 = 0"), a, "event_id", "ts")


@query("""WITH a AS (SELECT event_id AS article, user_id, ts AS seen FROM events WHERE event_type = 'view' AND event_id % 6 <> 0 AND ts <= TIMESTAMP '2024-01-20'),
    b AS (SELECT event_id AS label, user_id, ts - INTERVAL 2 HOUR AS available, ts AS created FROM events WHERE event_type = 'purchase' AND event_id % 4 <> 0 AND ts <= TIMESTAMP '2024-01-20')
    SELECT article, label FROM a JOIN b ON a.user_id = b.user_id AND b.available >= a.seen""")
def available_labels(spark, sf):
    """Articles with the labels of their cluster that were known at a time."""
    e, n = table(spark, sf, "events"), F.col("event_id")
    a = e.where("event_type = 'view'").select(n.alias("article"), F.col("user_id").alias("cluster_id"), F.col("ts").alias("first_seen"), F.when(n % 6 == 0, "HISTORICAL").otherwise("VERIFIED_SOURCE").alias("provenance"))
    b = e.where("event_type = 'purchase'").select(n.alias("label"), F.col("user_id").alias("cluster_id"), (F.col("ts") - F.expr("interval 2 hours")).alias("available_at"), F.col("ts").alias("created_at"), (n % 4 != 0).alias("feature_eligible"))
    return news.available_labels(a, b, F.lit("2024-01-20").cast("timestamp_ntz")).select("article", "label")


@query("""SELECT d.doc_id, CASE WHEN v IN ('BULLISH', 'BEARISH') THEN v ELSE 'UNKNOWN' END AS impact FROM (SELECT d.doc_id, upper(coalesce(nullif(CASE d.doc_id % 4 WHEN 0 THEN ' bullish' WHEN 1 THEN ' ' END, ' '), CASE WHEN l.quality = 1 THEN 'BEARISH' WHEN l.quality = 0 THEN 'odd' END, 'UNKNOWN')) AS w, trim(w) AS v, d.doc_id FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id) d""")
def review_reference(spark, sf):
    """A review sheet's values, completed from the reference, else unknown."""
    sheet = table(spark, sf, "documents").select("doc_id", F.when(F.col("doc_id") % 4 == 0, " bullish").when(F.col("doc_id") % 4 == 1, " ").alias("impact"))
    ref = table(spark, sf, "labels").select("doc_id", F.when(F.col("quality") == 1, "BEARISH").when(F.col("quality") == 0, "odd").alias("impact"))
    return news.with_reference(sheet, ref, "doc_id", "impact", ["BULLISH", "BEARISH"]).select("doc_id", "impact")


@query("""WITH x AS (SELECT CASE WHEN doc_id % 5 = 0 THEN 'PRICE_REPORT' WHEN quality = 1 THEN 'UP' ELSE 'DOWN' END AS t, CASE WHEN doc_id % 4 = 0 THEN 'PRICE_REPORT' WHEN toxic = 1 THEN 'UP' ELSE 'DOWN' END AS p, 1 + doc_id % 3 AS w FROM labels)
    SELECT avg((t = p)::INT) AS accuracy, sum(CASE WHEN t = p THEN w ELSE 0 END)::DOUBLE / sum(w) AS weighted_accuracy, sum((t = p AND p = 'PRICE_REPORT')::INT)::DOUBLE / sum((p = 'PRICE_REPORT')::INT) AS price_report_precision FROM x""")
def weighted_accuracy(spark, sf):
    n = F.col("doc_id")
    x = table(spark, sf, "labels").select(F.when(n % 5 == 0, "PRICE_REPORT").when(F.col("quality") == 1, "UP").otherwise("DOWN").alias("t"), F.when(n % 4 == 0, "PRICE_REPORT").when(F.col("toxic") == 1, "UP").otherwise("DOWN").alias("p"), (1 + n % 3).cast("double").alias("w"))
    return news.weighted_accuracy(x, "t", "p", "w")


_WINDOW = "(PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
_DELTA = f"""d AS (SELECT user_id, event_id, ts, CASE WHEN event_id % 7 = 0 THEN 0 ELSE value / 10 END AS x, floor(lead(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) / 4) - floor(value / 4) AS y FROM events),
    s AS (SELECT *, sum(CASE WHEN y IS NOT NULL THEN 1.0::DOUBLE END) OVER {_WINDOW} AS n, sum(CASE WHEN y IS NOT NULL THEN x END) OVER {_WINDOW} AS sx, sum(y) OVER {_WINDOW} AS sy, sum(CASE WHEN y IS NOT NULL THEN x * x END) OVER {_WINDOW} AS sxx, sum(x * y) OVER {_WINDOW} AS sxy FROM d),
    m AS (SELECT *, sx / n AS mu, greatest(sxx / n - (sx / n) * (sx / n), 0) AS v FROM s), q AS (SELECT *, CASE WHEN sqrt(v) < 1e-6 THEN 1 ELSE sqrt(v) END AS sd FROM m),
    p AS (SELECT *, CASE WHEN n >= 15 THEN sy / n + (sxy - mu * sy) / sd / (n * v / (sd * sd) + 5) * (x - mu) / sd END AS predicted FROM q)"""


def _forecasts(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    x = table(spark, sf, "events").withColumn("x", F.when(F.col("event_id") % 7 != 0, F.col("value") / 10)).withColumn("y", (F.floor(F.lead("value").over(w) / 4) - F.floor(F.col("value") / 4)).cast("double"))
    return forecast.delta_ridge(x, ["user_id"], ["ts", "event_id"], "x", "y")


@query(f"WITH {_DELTA} SELECT event_id, round(predicted, 6) AS predicted FROM p")
def delta_ridge(spark, sf):
    """Changes forecast by a ridge on the rows before, without clamps."""
    return _forecasts(spark, sf).select("event_id", F.round("predicted", 6).alias("predicted"))


@query(f"""WITH {_DELTA}, e AS (SELECT event_id % 10 AS arm, round(abs(y - predicted), 2) AS e, (sign(y) = sign(predicted) OR (y = 0 AND abs(predicted) < 5))::INT AS hit FROM p WHERE predicted IS NOT NULL AND y IS NOT NULL)
    SELECT arm, round(avg(e), 2) AS mae, round(sqrt(avg(e * e)), 2) AS rmse, round(stddev_pop(e), 2) AS error_std, max(e) AS max_error, round(avg(hit) * 100, 1) AS directional_pct, round(avg((1 - hit) * (1 - hit) * 0.25::DOUBLE + 0.15::DOUBLE), 4) AS brier, count(*) AS folds FROM e GROUP BY arm""")
def walk_forward_summary(spark, sf):
    """Errors, directions and the pseudo-Brier figure of walk-forward forecasts."""
    return forecast.walk_forward_summary(_forecasts(spark, sf).withColumn("arm", F.col("event_id") % 10), ["arm"], "y", "predicted")


@query("SELECT user_id, count(*) AS samples, count(*) >= 20 AS is_ready, round(count(*) / 20.0::DOUBLE * 100, 1) AS progress_pct, CASE WHEN count(*) >= 20 THEN 'READY' ELSE 'EXPERIMENTAL_DATA_COLLECTION' END AS status FROM events GROUP BY user_id")
def model_readiness(spark, sf):
    return forecast.readiness(table(spark, sf, "events"), ["user_id"], 20)


@query("""WITH u AS (SELECT page_id, url || '?b=2&utm_source=x&ref=1&a=' || page_id || '&c=#top' AS url FROM pages), p AS (SELECT page_id, url, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) AS scheme, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) AS host,
        regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/+$', '') AS path, string_split(regexp_extract(url, '^[^?#]*[?]([^#]*)', 1), '&') AS params FROM u),
    q AS (SELECT *, array_to_string(list_filter(params, lambda x: regexp_matches(x, '^[^=]+=.') AND NOT regexp_matches(lower(x), '^(utm_|oc|ref|src|fbclid|gclid)')), '&') AS kept FROM p)
    SELECT page_id, CASE WHEN scheme = '' THEN lower(url) ELSE scheme || '://' || host || path || CASE WHEN kept = '' THEN '' ELSE '?' || kept END END AS url FROM q""")
def url_in_order(spark, sf):
    u = F.concat(F.col("url"), F.lit("?b=2&utm_source=x&ref=1&a="), F.col("page_id").cast("string"), F.lit("&c=#top"))
    return table(spark, sf, "pages").select("page_id", T.plain_url(u).alias("url"))


@query(r"""WITH t AS (SELECT doc_id, lower(trim(text || ' -  The Daily Post', chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) AS t FROM documents)
    SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(t, '[ \t\n\x0B\f\r]+[-|–—][ \t\n\x0B\f\r]+[A-Za-z0-9 \t\n\x0B\f\r.&]+$', ''), '[^\p{L}\p{N}_ \t\n\x0B\f\r]', '', 'g'), '[ \t\n\x0B\f\r]+', ' ', 'g'), ' ') AS title FROM t""")
def title_normalise(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.plain_title(F.concat(F.col("text"), F.lit(" -  The Daily Post"))).alias("title"))


@query("""SELECT page_id, r.id, r.price FROM (SELECT page_id, unnest([{'id': page_id, 'price': 1.5::DOUBLE * (page_id % 9)}, {'id': -page_id, 'price': 2.0::DOUBLE}]) AS r FROM pages WHERE page_id % 3 <> 0)""")
def script_rows(spark, sf):
    """Rows of JSON arrays that pages carry in scripts; broken ones are left out."""
    n = F.col("page_id")
    rows = F.concat(F.lit("<script>var rates = [{\"id\": "), n.cast("string"), F.lit(", \"price\": "), (F.lit(1.5) * (n % 9)).cast("string"), F.lit("}, {\"id\": -"), n.cast("string"), F.lit(", \"price\": 2.0}];</script>"))
    html = F.concat(F.coalesce("html", F.lit("")), F.when(n % 3 == 0, "<script>rates = [{\"id\": oops}]</script>").otherwise(rows))
    return table(spark, sf, "pages").select("page_id", html.alias("html")).select("page_id", F.inline(T.json_rows(F.col("html"), "rates", "id: bigint, price: double")))


@query("SELECT event_id, user_id, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 500")
def latest_history(spark, sf):
    """The latest rows, as many as asked for but no more than the cap."""
    asked, cap = 5_000, 500
    return table(spark, sf, "events").select("event_id", "user_id", "ts").orderBy(F.desc("ts"), F.desc("event_id")).limit(min(asked, cap))


@query("SELECT event_id, event_type FROM (SELECT event_id, event_type, value FROM events WHERE value > 30) ORDER BY event_id DESC LIMIT 20")
def reverse_order_scan(spark, sf):
    """From the end of the file's order back, until enough rows have met the filter."""
    return table(spark, sf, "events").where("value > 30").orderBy(F.desc("event_id")).limit(20).select("event_id", "event_type")


@query("""SELECT event_id, extract(hour FROM l)::INT AS hour, extract(minute FROM l)::INT AS minute, extract(isodow FROM l)::INT - 1 AS dow, extract(isodow FROM l) >= 6 AS is_weekend, extract(isodow FROM l) = 1 AS is_monday, extract(isodow FROM l) = 5 AS is_friday FROM (SELECT event_id, ts + INTERVAL 330 MINUTE AS l FROM events)""")
def local_calendar(spark, sf):
    """Calendar features in Indian time."""
    at = F.from_utc_timestamp(F.col("ts").cast("timestamp"), "Asia/Kolkata")
    d = F.weekday(at)
    return table(spark, sf, "events").select("event_id", F.hour(at).alias("hour"), F.minute(at).alias("minute"), d.alias("dow"), (d >= 5).alias("is_weekend"), (d == 0).alias("is_monday"), (d == 4).alias("is_friday"))


@query("""SELECT user_id, arg_max(value, struct_pack(ts, event_id)) FILTER (WHERE event_type = 'purchase') AS xau, arg_max(value, struct_pack(ts, event_id)) FILTER (WHERE event_type = 'view') AS xag, xau / nullif(xag, 0) AS gold_silver_ratio FROM events GROUP BY user_id
    HAVING count(*) FILTER (WHERE event_type = 'purchase') > 0 AND count(*) FILTER (WHERE event_type = 'view') > 0""")
def symbol_snapshot(spark, sf):
    """The latest value of each symbol side by side, for those that have all of them, and their ratio."""
    last = table(spark, sf, "events").where("event_type IN ('purchase', 'view')").groupBy("user_id").pivot("event_type", ["purchase", "view"]).agg(F.max_by("value", F.struct("ts", "event_id")))
    out = last.where("purchase IS NOT NULL AND view IS NOT NULL").select("user_id", F.col("purchase").alias("xau"), F.col("view").alias("xag"))
    return out.withColumn("gold_silver_ratio", F.try_divide("xau", "xag"))


@query("""SELECT event_id, event_id % 3 AS a, 'new' AS b, CASE WHEN event_id % 2 = 0 THEN 'y' END AS c FROM events""")
def payload_merge(spark, sf):
    """One JSON payload laid over another: the second's fields win."""
    n = F.col("event_id")
    old = F.to_json(F.struct((n % 3).alias("a"), F.lit("old").alias("b")))
    new = F.to_json(F.struct(F.lit("new").alias("b"), F.when(n % 2 == 0, "y").alias("c")))
    x = table(spark, sf, "events").select("event_id", F.from_json(old, "map<string,string>").alias("p"), F.from_json(new, "map<string,string>").alias("q"))
    whole = F.map_concat(F.map_filter("p", lambda k, _: ~F.map_contains_key("q", k)), "q")
    x = x.select("event_id", whole.alias("m"))
    return x.select("event_id", F.try_element_at("m", F.lit("a")).cast("bigint").alias("a"), F.try_element_at("m", F.lit("b")).alias("b"), F.try_element_at("m", F.lit("c")).alias("c"))
