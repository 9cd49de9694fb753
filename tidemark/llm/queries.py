"""The queries of this package for __spark_entry__.py, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import langid, toxicity
from .ann import nearest
from .cobucket import co_bucketed, key_bucket
from .exact_dedup import exact_dedup
from .licences import licence_scan
from .line_dedup import line_dedup
from .mixing import mix
from .packing import pack
from .pii import personal_data
from .repair import audits, damaged, repaired_turns
from .shared import fresh_path
from .simhash import hex64, near_duplicates
from .warc import crawl_archives


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = crawl_archives(_table(spark, sf_dir, "pages"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_table(spark, sf_dir, "documents"))


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(_table(spark, sf_dir, "documents")).drop("added")


def op4_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licence_scan(_table(spark, sf_dir, "documents")).drop("spans")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_table(spark, sf_dir, "documents"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(_table(spark, sf_dir, "documents"), keep=["doc_id"])
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    models = langid.fit(docs.where(~held_out))
    out = langid.predict(docs.select("doc_id", "text", F.coalesce(held_out, F.lit(False)).alias("held_out")), models, keep=["doc_id", "held_out"])
    return out.select("doc_id", "held_out", "lang_pred", "score")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", hex64(F.col("fp")).alias("fingerprint"), "component_id")


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(_table(spark, sf_dir, "embeddings"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations")
    return audits(repaired_turns(damaged(rows), ids=rows.select("conv_id"))).withColumnRenamed("conv", "conv_id")


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels").where(~held_out))
    return toxicity.predict(docs.select("doc_id", held_out.alias("held_out"), "text"), model)


def op13_cobucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = F.coalesce(key_bucket(F.col("item_id"), 300), F.lit(0))
    return co_bucketed(
        _table(spark, sf_dir, "sales"), _table(spark, sf_dir, "sale_lines"), "sale_id", fresh_path(spark, "cobucket"),
        left_number=lambda b: F.when(b % 3 == 1, b - 1).otherwise(b), right_number=item, names=("sales", "sale_lines"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": op1_warc,
    "op2_packing": op2_packing,
    "op3_personal_data": op3_personal_data,
    "op4_licences": op4_licences,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_line_dedup": op6_line_dedup,
    "op7_language_id": op7_language_id,
    "op8_simhash": op8_simhash,
    "op9_nearest": op9_nearest,
    "op10_mixing": op10_mixing,
    "op11_repair": op11_repair,
    "op12_toxicity": op12_toxicity,
    "op13_cobucket": op13_cobucket,
}

ORACLES: dict[str, str] = {
    "op1_warc": """
        WITH p AS (
            SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
        f AS (
            SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
        FROM f""",
    "op5_exact_dedup": r"""
        WITH d AS (
            SELECT doc_id, length(coalesce(text, '')) AS n,
                   sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
            FROM documents),
        g AS (
            SELECT doc_id, text_sha256,
                   row_number() OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS nth,
                   first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id,
                   count(*) OVER (PARTITION BY text_sha256) AS group_size
            FROM d)
        SELECT doc_id, keep_id, group_size, nth = 1 AS kept, text_sha256 FROM g""",
    "op6_line_dedup": r"""
        WITH split AS (
            SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
        l AS (
            SELECT doc_id, unnest(range(1, len(lines) + 1)) AS pos, unnest(lines) AS line FROM split),
        k AS (
            SELECT doc_id, pos, line,
                   translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
        bad AS (
            SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
        m AS (
            SELECT k.doc_id, k.pos, k.line, bad.key IS NULL AS stays FROM k LEFT JOIN bad ON k.key = bad.key)
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE NOT stays) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE stays), '')) AS kept_sha256
        FROM m GROUP BY doc_id""",
    "op10_mixing": r"""
        WITH RECURSIVE d AS (
            SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
        s AS (
            SELECT source, sum(size)::BIGINT AS source_size,
                   row_number() OVER (ORDER BY source NULLS LAST) AS nth
            FROM d GROUP BY source),
        w AS (
            SELECT source, source_size, 3 * source_size AS cap, (nth - 1) % 3 + 1 AS weight, nth FROM s),
        c AS (
            SELECT *, row_number() OVER (ORDER BY cap / weight, nth) AS level,
                   (SELECT sum(source_size) FROM w) - coalesce(sum(cap) OVER (ORDER BY cap / weight, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
                   sum(weight) OVER (ORDER BY cap / weight, nth ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS remain
            FROM w),
        o AS (
            SELECT * FROM c WHERE level = (SELECT min(level) FROM c WHERE rest * weight <= cap * remain)),
        t AS (
            SELECT c.source, c.source_size,
                   CASE WHEN c.level >= o.level THEN (c.weight * o.rest)::DOUBLE / o.remain ELSE c.cap::DOUBLE END AS target
            FROM c, o),
        p AS (
            SELECT d.doc_id, d.size, t.source_size, t.target, floor(t.target)::BIGINT AS budget,
                   coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY md5('mix:' || d.doc_id), d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
            FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
        SELECT doc_id, size::BIGINT AS size, source_size, target,
               CASE WHEN source_size = 0 THEN 0 ELSE
                    budget // source_size * size + greatest(0, least(size, budget % source_size - start)) END::BIGINT AS taken
        FROM p""",
}
