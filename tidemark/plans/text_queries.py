"""Headlines, rules, clusters and reviews: documents are news items, events their times."""

from __future__ import annotations

import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import rule_tables as R
from tidemark.functions import text as T
from tidemark.operators import marts, rules, stories
from tidemark.plans.base import query, table

_WS = r"[ \t\n\x0B\f\r]+"
_NORM = rf"""lower(trim(regexp_replace(regexp_replace(trim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    '[ \t\n\x0B\f\r]+[-|–—][ \t\n\x0B\f\r]+[A-Za-z0-9 \t\n\x0B\f\r.&''()/]+$', ''), '{_WS}', ' ', 'g'), ' '))"""
_TOKENS = "list_filter(string_split(regexp_replace(norm, '[\\x00-/:-@\\[-^`{-\\x7F]+', ' ', 'g'), ' '), lambda w: w <> '' AND w NOT IN (" + ", ".join(f"'{w}'" for w in T.STOPWORDS) + "))"
_N = f"n AS (SELECT doc_id, {_NORM} AS norm FROM documents)"
_K = f"{_N}, t AS (SELECT doc_id, norm, {_TOKENS} AS tok FROM n), k AS (SELECT doc_id, norm, tok, CASE WHEN len(tok) = 0 THEN norm ELSE array_to_string(tok[1:6], ' ') END AS key FROM t)"


@query(f"WITH {_N} SELECT doc_id, norm AS headline FROM n")
def headline_normalise(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.normal_headline(F.col("text")).alias("headline"))


@query(f"WITH {_K} SELECT doc_id, key FROM k")
def cluster_key(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.cluster_key(F.col("text")).alias("key"))


@query(f"WITH {_N} SELECT doc_id, substr(sha256(norm || '|' || source), 1, 32) AS fingerprint FROM n JOIN documents USING (doc_id)")
def fingerprint(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.fingerprint(F.col("text"), F.col("source")).alias("fingerprint"))


_NEXT = """p AS (SELECT k.doc_id, k.key, k.tok, lead(k.key) OVER w AS key2, lead(k.tok) OVER w AS tok2 FROM k JOIN documents d ON d.doc_id = k.doc_id
     WINDOW w AS (PARTITION BY d.source ORDER BY k.key, k.doc_id))"""


def _neighbours(spark, sf):
    """Each document with the next one of its source in key order."""
    w = Window.partitionBy("source").orderBy("key", "doc_id")
    d = table(spark, sf, "documents").select("doc_id", "source", T.cluster_key(F.col("text")).alias("key"), T.token_set(F.col("text")).alias("tok"))
    return d.withColumn("key2", F.lead("key").over(w)).withColumn("tok2", F.lead("tok").over(w)).where("key2 IS NOT NULL")


@query(f"""WITH {_K}, {_NEXT}, s AS (SELECT doc_id, list_distinct(list_filter(string_split(key, ' '), lambda x: length(x) > 1)) AS a, list_distinct(list_filter(string_split(key2, ' '), lambda x: length(x) > 1)) AS b FROM p WHERE key2 IS NOT NULL)
    SELECT doc_id, CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0.0 ELSE len(list_intersect(a, b))::DOUBLE / len(list_distinct(list_concat(a, b))) END AS jaccard FROM s""")
def jaccard_pairs(spark, sf):
    return _neighbours(spark, sf).select("doc_id", T.jaccard(T.key_set(F.col("key")), T.key_set(F.col("key2"))).cast("double").alias("jaccard"))


_IN = lambda words: ", ".join(f"'{w}'" for w in words)


@query(f"""WITH {_K}, {_NEXT}, d AS (SELECT doc_id, tok AS a, tok2 AS b, list_concat(list_filter(tok, lambda x: NOT list_contains(tok2, x)), list_filter(tok2, lambda x: NOT list_contains(tok, x))) AS diff FROM p WHERE key2 IS NOT NULL),
    w AS (SELECT doc_id, len(list_filter(diff, lambda x: regexp_matches(x, '[0-9]') OR x IN ({_IN(T.ENTITIES)}))) > 0 AS tells,
        len(list_filter(a, lambda x: x IN ({_IN(T.UP)}))) > 0 AS au, len(list_filter(a, lambda x: x IN ({_IN(T.DOWN)}))) > 0 AS ad,
        len(list_filter(b, lambda x: x IN ({_IN(T.UP)}))) > 0 AS bu, len(list_filter(b, lambda x: x IN ({_IN(T.DOWN)}))) > 0 AS bd FROM d)
    SELECT doc_id, tells OR (au AND NOT ad AND bd AND NOT bu) OR (ad AND NOT au AND bu AND NOT bd) AS conflict FROM w""")
def merge_conflict(spark, sf):
    return _neighbours(spark, sf).select("doc_id", T.conflict(F.col("tok"), F.col("tok2")).alias("conflict"))


@query("""
    WITH u AS (SELECT page_id, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) AS scheme, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) AS host,
        regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/+$', '') AS path, string_split(regexp_extract(url, '^[^?#]*[?]([^#]*)', 1), '&') AS params FROM pages),
    q AS (SELECT *, array_to_string(list_sort(list_filter(params, lambda p: regexp_matches(p, '^[^=]+=.') AND NOT regexp_matches(lower(p), '^(utm_[^=]*|fbclid|gclid|mc_cid|mc_eid)='))), '&') AS kept FROM u)
    SELECT page_id, CASE WHEN scheme = '' THEN 'https' ELSE scheme END || '://' || host || path || CASE WHEN kept = '' THEN '' ELSE '?' || kept END AS url FROM q""")
def url_canonical(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.canonical_url(F.col("url")).alias("url"))


@query("SELECT doc_id, CASE lang WHEN 'en' THEN 'en' WHEN 'fr' THEN 'fr' WHEN 'de' THEN 'de' WHEN 'es' THEN 'es' ELSE coalesce(nullif(substr(lower(trim(lang)), 1, 16), ''), 'unknown') END AS code FROM documents")
def language_map(spark, sf):
    named = F.when(F.col("lang") == "fr", " French ").when(F.col("lang") == "de", "GERMAN").otherwise(F.col("lang"))
    return table(spark, sf, "documents").select("doc_id", T.language_code(named).alias("code"))


#: Categories that the invented documents can have.
TOPICS = {
    "LICENCE": ("apache license", "mit license", "gnu general public license", "cc by-nc 4.0", "licensed"), "SECRET": ("token",), "ENGLISH": ("the", "and", "that", "with"),
    "GERMAN": ("der", "und", "nicht", "auf"), "SPANISH": ("que", "los", "para"), "FRENCH": ("le", "dans", "pour", "qui"),
}
_NOT = r"[^\p{L}\p{N}_]"
_RX = lambda p: f"(?i)(?:^|{_NOT})" + re.sub(r"([+.&$])", r"[\1]", p) + (f"(?:$|{_NOT})" if p[-1].isalnum() else r"[\p{L}\p{N}_]")


def _says_sql(text: str, listed) -> str:
    """Whether any of the phrases stands in the text as whole words."""
    return "(" + " OR ".join(f"regexp_matches({text}, '{_RX(p)}')" for p in listed) + ")"


def _topic_sql() -> str:
    hits = ", ".join("(" + " + ".join(f"regexp_matches(text, '{_RX(p)}')::INT" for p in v) + f") AS n_{k}" for k, v in TOPICS.items())
    length = ", ".join("(" + " + ".join(f"CASE WHEN regexp_matches(text, '{_RX(p)}') THEN {len(p)} ELSE 0 END" for p in v) + f") AS l_{k}" for k, v in TOPICS.items())
    score = lambda k: f"CASE WHEN n_{k} > 0 THEN round(least(1.0, 0.7 + least(n_{k} - 1, 3) * 0.1::DOUBLE), 4) END"
    rows = " UNION ALL ".join(f"SELECT doc_id, '{k}' AS name, {score(k)} AS score, {2 if k == 'LICENCE' else 0 if k == 'ENGLISH' else 1} AS rank, l_{k} AS len, {-i} AS pos FROM h WHERE n_{k} > 0" for i, k in enumerate(TOPICS))
    return f"""WITH h AS (SELECT doc_id, {hits}, {length} FROM documents), r AS ({rows})"""


def _topics(spark, sf):
    return rules.relevance(
        table(spark, sf, "documents"), "text", categories=TOPICS, exclusions=("olympic medal",), context=("market",), explicit=("license",), specific=["LICENCE"], direct=["LICENCE"],
        dimensions={"world": ["GERMAN", "FRENCH"], "market": ["ENGLISH"]}, metals="SECRET", least_specific="ENGLISH",
    )


@query(_topic_sql() + ", m AS (SELECT doc_id, max(score) FILTER (WHERE name IN ('GERMAN', 'FRENCH')) AS world, max(score) FILTER (WHERE name = 'ENGLISH') AS market, max(score) FILTER (WHERE name = 'LICENCE') AS direct, max(score) FILTER (WHERE name = 'SECRET') AS metals FROM r GROUP BY doc_id)"
       """, f AS (SELECT d.doc_id, coalesce(world, 0) AS world, coalesce(market, 0) AS market, CASE WHEN direct > 0 THEN direct WHEN regexp_matches(text, '(?i)(?:^|[^\\p{L}\\p{N}_])license(?:$|[^\\p{L}\\p{N}_])') THEN round(least(1.0, 0.6 + coalesce(world, 0) * 0.3::DOUBLE), 4) ELSE round(coalesce(metals, 0) * 0.7::DOUBLE, 4) END AS relevance_score,
          regexp_matches(text, '(?i)(?:^|[^\\p{L}\\p{N}_])license(?:$|[^\\p{L}\\p{N}_])') AS said FROM documents d LEFT JOIN m ON d.doc_id = m.doc_id)
       SELECT doc_id, world, market, relevance_score, relevance_score >= 0.4 OR said AS is_relevant FROM f""")
def relevance_scores(spark, sf):
    return _topics(spark, sf).select("doc_id", "world", "market", "relevance_score", "is_relevant")


@query(_topic_sql() + ", o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, rank DESC, len DESC, pos DESC) AS nth FROM r)"
       " SELECT d.doc_id, coalesce(max(name) FILTER (WHERE nth = 1), 'OTHER') AS primary_category, coalesce(string_agg(name, ',' ORDER BY nth) FILTER (WHERE nth > 1), '') AS supporting FROM documents d LEFT JOIN o ON d.doc_id = o.doc_id GROUP BY d.doc_id")
def primary_category(spark, sf):
    return _topics(spark, sf).select("doc_id", "primary_category", F.array_join("supporting_categories", ",").alias("supporting"))


_MASKS = (r"licensed under[a-z ]*", r"token = \"[0-9a-f]+\"")


@query(rf"""
    WITH a AS (SELECT doc_id, lower(text) AS t0, regexp_replace(lower(text), 'licensed under[a-z ]*', ' ', 'g') AS t1 FROM documents),
    b AS (SELECT *, regexp_replace(t1, 'token = "[0-9a-f]+"', ' ', 'g') AS t2 FROM a)
    SELECT doc_id, t1 <> t0 AS licensed, t2 <> t1 AS secret, regexp_matches(t2, 'license') AS license_left, length(t2) AS length_left FROM b""")
def masked_negation(spark, sf):
    t = F.lower("text")
    df = table(spark, sf, "documents").select("doc_id", t.alias("t0"), rules.masked(t, _MASKS[:1]).alias("t1"))
    df = df.withColumn("t2", rules.masked(F.col("t1"), _MASKS[1:]))
    return df.select("doc_id", (F.col("t1") != F.col("t0")).alias("licensed"), (F.col("t2") != F.col("t1")).alias("secret"), F.col("t2").rlike("license").alias("license_left"), F.length("t2").alias("length_left"))


_ORDERED = (("SECRET", (r'token = "',)), ("LICENCE", (r"licen[cs]e",)), ("CARD", (r"[0-9]{16}",)), ("MAIL", (r"@[a-z0-9]+\.",)))


@query("SELECT doc_id, CASE " + " ".join(f"WHEN regexp_matches(lower(text), '{p[0]}') THEN '{k}'" for k, p in _ORDERED) + " ELSE 'UNKNOWN' END AS tag FROM documents")
def rule_direction(spark, sf):
    return table(spark, sf, "documents").select("doc_id", rules.first_tag(F.lower("text"), _ORDERED).alias("tag"))


@query("SELECT doc_id, CASE WHEN regexp_matches(lower(text), 'clown|idiot|pathetic|token') THEN 'negative' WHEN regexp_matches(lower(text), 'license|thanks') THEN 'positive' ELSE 'neutral' END AS label, CASE WHEN regexp_matches(lower(text), 'clown|idiot|pathetic|token') THEN -0.75 WHEN regexp_matches(lower(text), 'license|thanks') THEN 0.65 ELSE 0.0 END::DOUBLE AS score FROM documents")
def cue_sentiment(spark, sf):
    c = rules.cue_sentiment(F.col("text"), ["clown", "idiot", "pathetic", "token"], ["license", "thanks"])
    return table(spark, sf, "documents").select("doc_id", c.alias("c")).select("doc_id", "c.label", "c.score")


@query("SELECT source, lang, count(*) AS n, count(DISTINCT text) AS texts FROM documents GROUP BY source, lang")
def provenance_counts(spark, sf):
    return table(spark, sf, "documents").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("text").alias("texts"))


@query("SELECT source, count(*) AS n FROM documents GROUP BY source ORDER BY n DESC, source LIMIT 10")
def topn_sources(spark, sf):
    return table(spark, sf, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "source").limit(10)


@query("SELECT quality AS label, toxic AS predicted, count(*) AS n FROM labels GROUP BY 1, 2")
def confusion_matrix(spark, sf):
    return marts.confusion(table(spark, sf, "labels"), "quality", "toxic")


_CM = "m AS (SELECT quality AS label, toxic AS predicted, count(*) AS n FROM labels GROUP BY 1, 2)"


@query(f"""WITH {_CM}, s AS (SELECT label, sum(n) AS support, coalesce(sum(n) FILTER (WHERE label = predicted), 0) AS tp FROM m GROUP BY label), p AS (SELECT predicted AS label, sum(n) AS said FROM m GROUP BY 1),
    j AS (SELECT coalesce(s.label, p.label) AS label, support, coalesce(tp, 0) AS tp, said FROM s FULL JOIN p ON s.label = p.label), f AS (SELECT label, support::BIGINT AS support, tp::DOUBLE / nullif(said, 0) AS precision, tp::DOUBLE / nullif(support, 0) AS recall FROM j)
    SELECT label, support, precision, recall, 2 * precision * recall / nullif(precision + recall, 0) AS f1 FROM f""")
def class_scores(spark, sf):
    return marts.class_scores(marts.confusion(table(spark, sf, "labels"), "quality", "toxic"))


@query(f"""WITH {_CM}, t AS (SELECT sum(n)::BIGINT AS n, sum(n) FILTER (WHERE label = predicted)::DOUBLE / sum(n) AS accuracy FROM m),
    e AS (SELECT sum(a.s * b.s)::DOUBLE AS chance FROM (SELECT label, sum(n) AS s FROM m GROUP BY 1) a JOIN (SELECT predicted AS label, sum(n) AS s FROM m GROUP BY 1) b ON a.label = b.label)
    SELECT n, accuracy, (accuracy - coalesce(chance, 0) / (n * n)) / nullif(1 - coalesce(chance, 0) / (n * n), 0) AS kappa FROM t, e""")
def cohens_kappa(spark, sf):
    return marts.kappa(marts.confusion(table(spark, sf, "labels"), "quality", "toxic"))


@query("""WITH p AS (SELECT lang, count(*) AS population_n FROM documents GROUP BY 1), s AS (SELECT lang, count(*) AS sample_n FROM documents JOIN labels USING (doc_id) GROUP BY 1)
    SELECT p.lang, population_n, sample_n, (population_n::DOUBLE / (SELECT sum(population_n) FROM p)) / (sample_n::DOUBLE / (SELECT sum(sample_n) FROM s)) AS weight FROM p JOIN s ON p.lang = s.lang""")
def stratum_weights(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang")
    return marts.stratum_weights(d, d.join(table(spark, sf, "labels"), "doc_id"), "lang").select("lang", "population_n", "sample_n", "weight")


_ITEMS = """i AS (SELECT d.doc_id, d.source, d.lang, e.event_type, e.user_id, exp(-((epoch_us(TIMESTAMP '2024-02-01') - epoch_us(e.ts)) / 3600000000.0::DOUBLE) / 240) * CASE WHEN e.value >= 75 THEN 1.0 WHEN e.value >= 25 THEN 0.65 ELSE 0.35 END::DOUBLE AS weight,
     CASE e.event_type WHEN 'view' THEN 'BULLISH' WHEN 'click' THEN 'BEARISH' ELSE 'NEUTRAL' END AS direction FROM documents d JOIN events e ON d.doc_id = e.event_id)"""


def _items(spark, sf):
    e = table(spark, sf, "events")
    age = (F.unix_micros(F.lit("2024-02-01 00:00:00").cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))) / 3_600_000_000.0
    sure = F.when(F.col("value") >= 75, 1.0).when(F.col("value") >= 25, 0.65).otherwise(0.35)
    side = F.when(F.col("event_type") == "view", "BULLISH").when(F.col("event_type") == "click", "BEARISH").otherwise("NEUTRAL")
    d = table(spark, sf, "documents").join(e, F.col("doc_id") == F.col("event_id"))
    return d.select("doc_id", "source", "lang", "event_type", "user_id", "text", "ts", (F.exp(-age / 240) * sure).alias("weight"), side.alias("direction"))


@query(f"""WITH {_ITEMS}, r AS (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY weight DESC, doc_id) AS source_nth, row_number() OVER (PARTITION BY lang, event_type ORDER BY weight DESC, doc_id) AS driver_nth FROM i)
    SELECT doc_id, source_nth, driver_nth, round(weight / sqrt(source_nth) / sqrt(driver_nth), 9) AS discounted FROM r""")
def rank_discount(spark, sf):
    out = marts.ranked_discount(_items(spark, sf), ["lang"], [F.desc("weight"), F.col("doc_id")], "source", "event_type", "weight")
    return out.select("doc_id", "source_nth", "driver_nth", F.round("discounted", 9).alias("discounted"))


@query(f"""WITH {_ITEMS}, g AS (SELECT source, round(coalesce(sum(weight) FILTER (WHERE direction = 'BULLISH'), 0), 3) AS bull, round(coalesce(sum(weight) FILTER (WHERE direction = 'BEARISH'), 0), 3) AS bear, round(coalesce(sum(weight) FILTER (WHERE direction = 'NEUTRAL'), 0), 3) AS mixed, count(*) AS clusters FROM i GROUP BY source),
    s AS (SELECT *, abs(bull - bear) / greatest(bull + bear, 0.001::DOUBLE) AS spread FROM g),
    x AS (SELECT *, CASE WHEN clusters < 2 THEN 'INSUFFICIENT_NEWS' WHEN bull >= 0.35 AND bear >= 0.35 AND spread < 0.30 THEN 'MIXED' WHEN bull >= 1.25 * bear AND bull >= 0.35 THEN 'BULLISH' WHEN bear >= 1.25 * bull AND bear >= 0.35 THEN 'BEARISH' WHEN spread < 0.2 AND bull + bear > 0.35 THEN 'MIXED' ELSE 'NEUTRAL' END AS signal FROM s)
    SELECT source, bull, bear, mixed, clusters, signal, CASE WHEN clusters >= 5 AND spread >= 0.6 AND signal IN ('BULLISH', 'BEARISH') THEN 'HIGH' WHEN clusters >= 3 AND spread >= 0.3 THEN 'MEDIUM' ELSE 'LOW' END AS confidence FROM x""")
def live_consensus(spark, sf):
    return marts.consensus(_items(spark, sf), ["source"], "direction", "weight")


@query(f"WITH {_ITEMS} SELECT source, doc_id, members FROM (SELECT source, doc_id, count(*) OVER (PARTITION BY source) AS members, row_number() OVER (PARTITION BY source ORDER BY weight DESC, doc_id) AS nth FROM i) WHERE nth = 1")
def cluster_rep(spark, sf):
    w = Window.partitionBy("source")
    df = _items(spark, sf).withColumn("members", F.count(F.lit(1)).over(w)).withColumn("nth", F.row_number().over(w.orderBy(F.desc("weight"), "doc_id")))
    return df.where("nth = 1").select("source", "doc_id", "members")


@query("""SELECT source, CASE WHEN bool_and(event_type = 'error') THEN 'NEUTRAL' WHEN b AND s THEN 'MIXED' WHEN b THEN 'BULLISH' WHEN s THEN 'BEARISH' WHEN n THEN 'NEUTRAL' ELSE 'UNKNOWN' END AS label, members FROM (
    SELECT d.source, e.event_type, bool_or(event_type = 'view') OVER (PARTITION BY source) AS b, bool_or(event_type = 'click') OVER (PARTITION BY source) AS s, bool_or(event_type IN ('purchase', 'signup')) OVER (PARTITION BY source) AS n, count(*) OVER (PARTITION BY source) AS members FROM documents d JOIN events e ON d.doc_id = e.event_id)
    GROUP BY source, b, s, n, members""")
def cluster_labels(spark, sf):
    df = _items(spark, sf).withColumn("report", F.col("event_type") == "error").withColumn("sure", F.lit("LOW"))
    return stories.cluster_labels(df, "source", "direction", "sure", "report", ["ts", "doc_id"]).select("source", "label", "members")


_SMALL = "list_distinct(list_filter(string_split({0}, ' '), lambda x: length(x) > 1))"
_WAY = lambda c: f"CASE WHEN list_has_any({c}, [{_IN(T.UP)}]) AND NOT list_has_any({c}, [{_IN(T.DOWN)}]) THEN 1 WHEN list_has_any({c}, [{_IN(T.DOWN)}]) AND NOT list_has_any({c}, [{_IN(T.UP)}]) THEN -1 ELSE 0 END"
_TELL = lambda c: f"list_sort(list_distinct(list_filter({c}, lambda x: regexp_matches(x, '[0-9]') OR x IN ({_IN(T.ENTITIES)}))))"


@query(rf"""WITH RECURSIVE {_K},
    m0 AS (SELECT doc_id, regexp_replace(regexp_replace(norm, '{T.MONTHS_DAYS}', ' ', 'g'), '[$₹€£]?[0-9][0-9.,/:-]*%?', ' ', 'g') AS norm FROM n), stems AS (SELECT doc_id, array_to_string({_TOKENS}[1:8], ' ') AS stem FROM m0),
    j AS (SELECT k.doc_id, d.lang, k.key, {_SMALL.format("k.key")} AS small, {_TELL("k.tok")} AS tell, {_WAY("k.tok")} AS way, array_to_string(list_sort(list_distinct(k.tok)), ' ') AS signature, stem, epoch_us(e.ts) AS at
        FROM k JOIN documents d ON d.doc_id = k.doc_id JOIN stems ON stems.doc_id = k.doc_id JOIN events e ON e.event_id = k.doc_id),
    p AS (SELECT b.doc_id AS n, a.doc_id AS c, a.at, CASE WHEN a.key = b.key THEN 1.0::DOUBLE WHEN len(a.small) = 0 OR len(b.small) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect(a.small, b.small))::DOUBLE / len(list_distinct(list_concat(a.small, b.small))) END AS score
        FROM j b JOIN j a ON a.lang IS NOT DISTINCT FROM b.lang AND a.tell = b.tell AND (a.at < b.at OR a.at = b.at AND a.doc_id < b.doc_id) AND b.at - a.at <= 36::BIGINT * 3600000000 WHERE a.way * b.way >= 0),
    q AS (SELECT n, list(struct_pack(score := score, "at" := p.at, c := c)) AS cs FROM p WHERE score >= 0.7 GROUP BY n),
    o AS MATERIALIZED (SELECT row_number() OVER (ORDER BY j.at, j.doc_id) AS i, j.doc_id AS n, coalesce(cs, []) AS cs FROM j LEFT JOIN q ON q.n = j.doc_id),
    s AS (SELECT 0::BIGINT AS i, NULL::BIGINT AS n, NULL::BIGINT AS first, []::BIGINT[] AS opened UNION ALL
        SELECT x.i, x.n, coalesce(x.hit, x.n), CASE WHEN x.hit IS NULL THEN list_append(x.opened, x.n) ELSE x.opened END
        FROM (SELECT o.i, o.n, s.opened, list_reverse_sort(list_filter(o.cs, lambda y: list_contains(s.opened, y.c)))[1].c AS hit FROM s JOIN o ON o.i = s.i + 1) x),
    f AS (SELECT s.n AS first, signature, (j.at // 86400000000) AS day, row_number() OVER (PARTITION BY signature, (j.at // 86400000000) ORDER BY s.n) AS nth FROM s JOIN j ON j.doc_id = s.n WHERE s.n = s.first),
    g AS (SELECT stem, min(j.at) AS since FROM j WHERE stem <> '' GROUP BY stem)
    SELECT s.n AS row_id, 'clu2_' || substr(sha256('v1|d' || day || '|' || f.signature || '|' || CASE WHEN nth > 1 THEN nth::VARCHAR ELSE '' END), 1, 16) AS cluster_id, coalesce(g.since < j.at - 36::BIGINT * 3600000000, FALSE) AS is_recurring
    FROM s JOIN f ON f.first = s.first JOIN j ON j.doc_id = s.n LEFT JOIN g ON g.stem = j.stem WHERE s.i > 0""")
def story_clusters(spark, sf):
    """Whole documents as headlines. A file of one row group is one task's, so the rows are dealt out before their words are cut."""
    return stories.story_clusters(_items(spark, sf).repartition("doc_id"), "text", "ts", "doc_id", block=["lang"])


def _in_turn(rows: str) -> str:
    """CTEs that read rows(n, u, t) one after the other: s(n, accepted) in the end. rows is a CTE's name."""
    return f"""o AS MATERIALIZED (SELECT row_number() OVER (ORDER BY n) AS i, n, md5(u) AS u, md5(t) AS t FROM {rows}),
    s AS (SELECT 0::BIGINT AS i, NULL::BIGINT AS n, FALSE AS accepted, []::VARCHAR[] AS us, []::VARCHAR[] AS ts UNION ALL
        SELECT x.i, x.n, x.ok, CASE WHEN x.ok AND x.u IS NOT NULL THEN list_append(x.us, x.u) ELSE x.us END, CASE WHEN x.ok AND x.t IS NOT NULL THEN list_append(x.ts, x.t) ELSE x.ts END
        FROM (SELECT o.i, o.n, o.u, o.t, s.us, s.ts, NOT coalesce(list_contains(s.us, o.u), FALSE) AND NOT coalesce(list_contains(s.ts, o.t), FALSE) AS ok FROM s JOIN o ON o.i = s.i + 1) x)"""


@query(f"""WITH RECURSIVE {_N}, {_ITEMS}, k AS (SELECT i.doc_id AS n, i.source || '/' || e.ts::DATE AS u, n.norm AS t FROM i JOIN n ON n.doc_id = i.doc_id JOIN events e ON e.event_id = i.doc_id), {_in_turn("k")}
    SELECT n AS doc_id, accepted FROM s WHERE i > 0""")
def either_key_dedup(spark, sf):
    df = _items(spark, sf).withColumn("title", T.normal_headline(F.col("text"))).withColumn("url", F.concat_ws("/", "source", F.to_date("ts")))
    return stories.either_key_dedup(df.select("doc_id", "url", "title"), "url", "title", "doc_id").select("doc_id", "accepted")


_ARCHIVE = """a AS (SELECT doc_id, CASE WHEN doc_id % 31 = 0 THEN '' ELSE coalesce(text, '') END AS title, CASE WHEN doc_id % 29 = 0 THEN NULL ELSE 'https://' || coalesce(source, 'none') || '.example/' || (doc_id % 400) END AS url, CASE WHEN doc_id % 37 = 0 THEN NULL ELSE TIMESTAMP '2024-01-01' + (doc_id % 5) * INTERVAL 1 DAY END AS published FROM documents WHERE doc_id IS NOT NULL)"""


@query(f"""WITH RECURSIVE {_ARCHIVE}, b AS (SELECT doc_id, title AS text, url, published, trim(title, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) = '' OR url IS NULL OR published IS NULL AS bad, doc_id % 23 = 0 AS fixture FROM a),
    n AS (SELECT doc_id, {_NORM} AS norm FROM b), k AS (SELECT b.doc_id AS n, url AS u, CASE WHEN norm <> '' THEN norm || '|' || published::DATE END AS t FROM b JOIN n ON b.doc_id = n.doc_id WHERE NOT bad AND NOT fixture), {_in_turn("k")}
    SELECT b.doc_id, CASE WHEN bad THEN 'INVALID' WHEN fixture THEN 'SYNTHETIC_FIXTURE' WHEN NOT s.accepted THEN 'DUPLICATE' WHEN b.doc_id % 2 = 0 THEN 'VERIFIED_SOURCE' ELSE 'HISTORICAL_UNVERIFIED_AVAILABILITY' END AS status FROM b LEFT JOIN s ON s.n = b.doc_id""")
def archive_provenance(spark, sf):
    """The archive's own rules: fields, fixtures, earlier rows of the same URL or headline of the day, sightings."""
    d = table(spark, sf, "documents").where("doc_id IS NOT NULL")
    n, blank = F.col("doc_id"), F.lit("")
    published = F.when(n % 37 == 0, F.lit(None)).otherwise(F.expr("timestamp '2024-01-01' + make_dt_interval(cast(doc_id % 5 as int))"))
    url = F.when(n % 29 == 0, F.lit(None)).otherwise(F.concat(F.lit("https://"), F.coalesce("source", F.lit("none")), F.lit(".example/"), (n % 400).cast("string")))
    x = d.select("doc_id", F.when(n % 31 == 0, "").otherwise(F.coalesce("text", blank)).alias("title"), url.alias("url"), published.alias("published"), F.when(n % 2 == 0, published).alias("first_seen"))
    return stories.archive_status(x, "doc_id", "title", "url", "published", "first_seen", n % 23 == 0).select("doc_id", "status")


@query(f"""WITH {_K}, j AS (SELECT k.doc_id, k.key, k.tok, {_SMALL.format("k.key")} AS small, e.ts FROM k JOIN events e ON e.event_id = k.doc_id),
    p AS (SELECT n.doc_id AS n, c.doc_id AS c, c.ts, n.key = c.key AS same, CASE WHEN len(n.small) = 0 OR len(c.small) = 0 THEN 0.0 ELSE len(list_intersect(n.small, c.small))::DOUBLE / len(list_distinct(list_concat(n.small, c.small))) END AS alike,
        list_concat(list_filter(n.tok, lambda x: NOT list_contains(c.tok, x)), list_filter(c.tok, lambda x: NOT list_contains(n.tok, x))) AS diff, n.tok AS nt, c.tok AS ct
        FROM j n JOIN j c ON n.doc_id % 3 <> 0 AND c.doc_id % 3 = 0 AND abs(epoch_us(n.ts) - epoch_us(c.ts)) <= 10::BIGINT * 86400000000 AND (n.key = c.key OR len(list_intersect(n.small, c.small)) > 0)),
    m AS (SELECT n, c, ts, CASE WHEN same THEN 1.0 ELSE alike END AS score FROM p WHERE (same OR alike >= 0.7) AND NOT (len(list_filter(diff, lambda x: regexp_matches(x, '[0-9]') OR x IN ({_IN(T.ENTITIES)}))) > 0
        OR (len(list_filter(nt, lambda x: x IN ({_IN(T.UP)}))) > 0 AND len(list_filter(nt, lambda x: x IN ({_IN(T.DOWN)}))) = 0 AND len(list_filter(ct, lambda x: x IN ({_IN(T.DOWN)}))) > 0 AND len(list_filter(ct, lambda x: x IN ({_IN(T.UP)}))) = 0)
        OR (len(list_filter(nt, lambda x: x IN ({_IN(T.DOWN)}))) > 0 AND len(list_filter(nt, lambda x: x IN ({_IN(T.UP)}))) = 0 AND len(list_filter(ct, lambda x: x IN ({_IN(T.UP)}))) > 0 AND len(list_filter(ct, lambda x: x IN ({_IN(T.DOWN)}))) = 0))),
    b AS (SELECT n, 'c' || c AS cluster_id, row_number() OVER (PARTITION BY n ORDER BY score DESC, ts DESC, 'c' || c) AS nth FROM m)
    SELECT j.doc_id AS row_id, CASE WHEN j.doc_id % 7 = 0 THEN 'u' || j.doc_id ELSE b.cluster_id END AS cluster_id, CASE WHEN j.doc_id % 7 = 0 THEN 'URL' WHEN b.n IS NOT NULL THEN 'MATCH' ELSE 'NEW' END AS how FROM j LEFT JOIN b ON b.n = j.doc_id AND nth = 1 WHERE j.doc_id % 3 <> 0""")
def stored_clusters(spark, sf):
    """Items against stored clusters: by URL, else the most alike within ten days either way."""
    x = _items(spark, sf).select(F.col("doc_id").alias("row_id"), F.concat(F.lit("u"), F.col("doc_id").cast("string")).alias("url"), F.col("text").alias("title"), "ts")
    known = x.where("row_id % 7 = 0").select("url", F.col("url").alias("cluster_id"))
    clusters = x.where("row_id % 3 = 0").select("row_id", F.concat(F.lit("c"), F.col("row_id").cast("string")).alias("cluster_id"), "title", "ts")
    return stories.resolved(x.where("row_id % 3 <> 0"), known, clusters, hours=240)


@query("""
    WITH k AS (SELECT doc_id, source, lang, md5('review:' || doc_id) AS m FROM documents), l AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY m, doc_id) > 10 AS late FROM k),
    t AS (SELECT *, row_number() OVER (PARTITION BY lang, late ORDER BY m, doc_id) AS turn FROM l)
    SELECT doc_id, lang, source FROM t ORDER BY late, turn, lang, doc_id LIMIT 100""")
def stratified_sample(spark, sf):
    return stories.stratified_sample(table(spark, sf, "documents").select("doc_id", "lang", "source"), "lang", "source", "doc_id", 100, 10)


#: Headlines for documents to have, two each: every rule of the impact tables has its turn.
WIRES = (
    "Fed hikes interest rates by 25 bps", "Fed cuts rates as expected", "Fed holds rates steady as expected", "Powell strikes hawkish tone", "Fed pauses rate hikes", "Rate cuts are off the table", "ECB raises key rates", "RBI unexpectedly cuts repo rate", "RBI hikes the repo rate",
    "Treasury yields surge to new high", "Bond yields tumble on weak data", "Gold rate today in Chennai", "Check latest 22k gold rate", "MCX gold futures edges lower after Fed remarks", "Spot gold edges up", "Spot gold rises slightly higher ahead of inflation data", "Gold fails to rally", "Gold unable to extend losses", "Rupee falls to record low", "USDINR slips on inflows",
    "Dollar firms against peers", "Weak dollar lifts metals", "Middle East conflict escalates", "Safe-haven demand grows", "Central bank gold buying continues", "Central banks halt buying", "Gold demand slumps", "Dhanteras buying begins", "Gold ETFs see inflows", "Gold ETFs record outflows", "Oil jumps above $100", "Crude steadies", "Hotter than expected CPI", "Cooler than expected inflation",
    "Jobs data better than expected", "Retail sales miss", "Claims worse than expected", "Technical breakout in metals", "Flash crash hits silver", "Jewellery makers wait", "Look to Fed", "Government hikes import duty on gold", "Customs cut: lowers import duty on gold", "Fed keeps rates unchanged with limited guidance", "Quiet session in thin trade", "Hike bets ease", "Fed hike fears", "Fewer rate cuts seen", "Inflation in line with expectations", "Stocks close flat",
)
_WIRE = lambda k: f"(['" + "', '".join(WIRES) + f"'])[(doc_id * {k} + doc_id // 50) % {len(WIRES)} + 1]"


def _wires(spark, sf):
    one = lambda k: F.get(rules.strings(WIRES), ((F.col("doc_id") * k + F.floor(F.col("doc_id") / 50)) % len(WIRES)).cast("int"))
    return table(spark, sf, "documents").where("doc_id IS NOT NULL").select("doc_id", F.concat(one(1), F.lit(" "), one(7)).alias("title"))


def _impact_sql() -> str:
    # RE2 has no look-ahead; the one of the table only asks for words further on.
    text = lambda p: p.replace(r"(?=.*limited guidance)\b", r"\b.*limited guidance").replace("'", "''")
    says = lambda c, patterns: f"regexp_matches({c}, '{'|'.join(map(text, patterns))}')"

    def masked(c, patterns):
        for p in patterns:
            c = f"regexp_replace({c}, '{text(p)}', ' ', 'g')"
        return c

    tags = " ".join(f"WHEN {says('t', p)} THEN '{k}'" for k, p in R.SURPRISES)
    case = lambda side: ", ".join(f"CASE WHEN {says('t', p)} THEN '{d}|{c}' END" for d, s, c, p in R.SIGNALS if s == side)
    return f"""WITH w AS (SELECT doc_id, lower({_WIRE(1)} || ' ' || {_WIRE(7)}) AS t FROM documents WHERE doc_id IS NOT NULL),
    s AS (SELECT *, CASE {tags} ELSE 'UNKNOWN' END AS surprise, {says('t', R.PRICE_REPORT)} AND NOT {says('t', R.MACRO_CONTENT)} OR {says('t', R.DESCRIPTIVE_MOVE)} AND NOT {says('t', R.CAUSAL_MACRO)} AS is_price_report, {masked('t', R.NEGATED_HIKE)} AS a FROM w),
    s2 AS (SELECT *, {masked('a', R.NEGATED_CUT)} AS b FROM s), s3 AS (SELECT *, {masked('b', R.RBI_HAWKISH)} AS c FROM s2), s4 AS (SELECT *, {masked('c', R.RBI_DOVISH)} AS d FROM s3),
    s5 AS (SELECT *, {says('d', R.FOREIGN_BANK)} AND NOT {says('d', R.FED_NAME)} AS other, {masked('d', R.FOREIGN_POLICY)} AS e FROM s4),
    s6 AS (SELECT *, surprise = 'AS_EXPECTED' AND a = t AND b = a AND {says('e', R.FED_ACTION)} AS expected, {says('e', R.FED_NEUTRAL)} AND NOT {says('e', R.FED_BEARISH)} AS held, CASE WHEN contains(e, 'yield') AND NOT contains(e, 'fed') THEN 'US_INTEREST_RATES|HIGH' ELSE 'FED_POLICY|HIGH' END AS fed FROM s5),
    s7 AS (SELECT *, coalesce(CASE WHEN a <> t THEN 'FED_POLICY|HIGH' END, CASE WHEN d <> c THEN 'INR|MEDIUM' END, CASE WHEN NOT other AND NOT expected AND NOT held AND {says('e', R.FED_BULLISH)} THEN fed END) AS bull0,
        coalesce(CASE WHEN b <> a THEN 'FED_POLICY|HIGH' END, CASE WHEN c <> b THEN 'INR|MEDIUM' END, CASE WHEN NOT other AND NOT expected AND {says('e', R.FED_BEARISH)} THEN fed END) AS bear0, {says('t', R.INFLATION)} AS prices, {says('t', R.INFLATION_BEARISH)} AS prices_up FROM s6),
    s8 AS (SELECT *, bull0 IS NULL AND bear0 IS NULL AND (other OR NOT (expected OR held)) AS early, coalesce(bull0, {case('BULLISH')}) AS bull1, coalesce(bear0, {case('BEARISH')}, CASE WHEN prices AND prices_up THEN 'INFLATION|MEDIUM' END) AS bear1 FROM s7),
    s9 AS (SELECT *, coalesce(bull1, CASE WHEN bear1 IS NULL AND {says('t', R.MOMENTUM_BULLISH)} THEN 'OTHER_MACRO|MEDIUM' END) AS bull, coalesce(bear1, CASE WHEN bull1 IS NULL AND {says('t', R.MOMENTUM_BEARISH)} THEN 'OTHER_MACRO|MEDIUM' END) AS bear,
        CASE WHEN bull1 IS NULL AND bear1 IS NULL AND prices AND NOT prices_up THEN 'INFLATION' WHEN early AND {says('e', R.FED_PREVIEW)} THEN 'FED_POLICY' WHEN e <> d OR other THEN 'OTHER_MACRO' END AS unsure0, NOT other AND (expected OR held) AS neutral FROM s8),
    r AS (SELECT *, coalesce(unsure0, CASE WHEN bull IS NULL AND bear IS NULL AND NOT neutral AND {says('t', R.PHYSICAL_UNSPECIFIED)} THEN 'INDIAN_PHYSICAL_DEMAND' END) AS unsure FROM s9),
    o AS (SELECT doc_id, surprise, is_price_report, CASE WHEN is_price_report THEN 'NEUTRAL|GOLD_PRICE_REPORT|MEDIUM' WHEN bull IS NOT NULL AND bear IS NOT NULL THEN 'MIXED|' || split_part(bull, '|', 1) || '|MEDIUM'
        WHEN bull IS NOT NULL AND {says('t', R.FAILED_RALLY)} THEN 'UNKNOWN|' || split_part(bull, '|', 1) || '|LOW' WHEN bull IS NOT NULL THEN 'BULLISH|' || bull WHEN bear IS NOT NULL AND {says('t', R.FAILED_DROP)} THEN 'UNKNOWN|' || split_part(bear, '|', 1) || '|LOW'
        WHEN bear IS NOT NULL THEN 'BEARISH|' || bear WHEN neutral THEN 'NEUTRAL|FED_POLICY|MEDIUM' WHEN unsure IS NOT NULL THEN 'UNKNOWN|' || unsure || '|LOW' ELSE 'UNKNOWN|UNKNOWN|LOW' END AS x FROM r)
    SELECT doc_id, surprise, is_price_report, split_part(x, '|', 1) AS direction, split_part(x, '|', 2) AS driver, split_part(x, '|', 3) AS confidence FROM o"""


@query(_impact_sql())
def headline_impact(spark, sf):
    """The whole of the impact rules on headlines dealt out to the documents."""
    return rules.impact(_wires(spark, sf), "title").drop("title")


_POOL = [p for v in R.CATEGORIES.values() for p in v] + [*R.EXCLUSIONS, *R.CONTEXT, *R.EXPLICIT]


def _category_sql() -> str:
    pool = "['" + "', '".join(_POOL) + "']"
    pick = lambda k: f"({pool})[(doc_id * {k} + doc_id // 100) % {len(_POOL)} + 1]"
    n = lambda c, v: "(" + " + ".join(f"regexp_matches({c}, '{_RX(p)}')::INT" for p in v) + ")"
    length = lambda v: "(" + " + ".join(f"CASE WHEN regexp_matches(t, '{_RX(p)}') OR regexp_matches(d, '{_RX(p)}') THEN {len(p)} ELSE 0 END" for p in v) + ")"
    hits = ", ".join(f"{n('t', v)} AS t_{k}, {n('d', v)} AS d_{k}, {length(v)} AS l_{k}" for k, v in R.CATEGORIES.items())
    score = lambda k: f"CASE WHEN t_{k} > 0 THEN round(least(1.0, 0.7 + least(t_{k} - 1, 3) * 0.1::DOUBLE), 4) ELSE round(0.4 + least(d_{k} - 1, 3) * 0.1::DOUBLE, 4) END"
    rank = lambda k: 2 if k in R.SPECIFIC else 0 if k == "GOLD_DIRECT" else 1
    rows = " UNION ALL ".join(f"SELECT doc_id, '{k}' AS name, {score(k)} AS score, {rank(k)} AS rank, l_{k} AS len, {-i} AS pos FROM h WHERE NOT excluded AND t_{k} + d_{k} > 0" for i, k in enumerate(R.CATEGORIES))
    top = lambda names: "coalesce(max(score) FILTER (WHERE name IN ('" + "', '".join(names) + "')), 0)"
    dims = ", ".join(f"{top(v)} AS {k}" for k, v in R.DIMENSIONS.items())
    most = ", ".join(k for k in R.DIMENSIONS if k != "market")
    return f"""WITH i AS MATERIALIZED (SELECT doc_id, {pick(1)} || ' and ' || {pick(3)} AS t, {pick(11)} || ', ' || {pick(17)} AS d FROM documents WHERE doc_id IS NOT NULL),
    h AS MATERIALIZED (SELECT doc_id, {hits}, {_says_sql("t || ' ' || d", R.EXCLUSIONS)} AND NOT {_says_sql("t || ' ' || d", R.CONTEXT)} AS excluded, {_says_sql("t || ' ' || d", R.EXPLICIT)} AS named FROM i),
    r AS MATERIALIZED ({rows}), o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, rank DESC, len DESC, pos DESC) AS nth FROM r),
    m AS (SELECT h.doc_id, any_value(named AND NOT excluded) AS said, coalesce(max(name) FILTER (WHERE nth = 1), 'OTHER') AS primary_category, coalesce(string_agg(name, ',' ORDER BY nth) FILTER (WHERE nth > 1 AND score >= 0.35), '') AS supporting,
        {dims}, {top(R.DIRECT)} AS direct, {top(["PRECIOUS_METALS"])} AS metals FROM h LEFT JOIN o ON h.doc_id = o.doc_id GROUP BY h.doc_id),
    f AS (SELECT *, CASE WHEN direct > 0 THEN direct WHEN said THEN round(least(1.0, 0.6 + greatest(0, {most}) * 0.3::DOUBLE), 4) ELSE round(metals * 0.7::DOUBLE, 4) END AS relevance_score FROM m)
    SELECT doc_id, primary_category, supporting, {", ".join(R.DIMENSIONS)}, relevance_score, relevance_score >= 0.4 OR said AS is_relevant FROM f"""


@query(_category_sql())
def gold_relevance(spark, sf):
    """All categories of the domain on headlines and descriptions made of their phrases."""
    pick = lambda k: F.get(rules.strings(_POOL), ((F.col("doc_id") * k + F.floor(F.col("doc_id") / 100)) % len(_POOL)).cast("int"))
    df = table(spark, sf, "documents").where("doc_id IS NOT NULL").select("doc_id", F.concat(pick(1), F.lit(" and "), pick(3)).alias("t"), F.concat(pick(11), F.lit(", "), pick(17)).alias("d"))
    out = rules.relevance(df, "t", "d")
    return out.select("doc_id", "primary_category", F.array_join("supporting_categories", ",").alias("supporting"), *R.DIMENSIONS, "relevance_score", "is_relevant")
