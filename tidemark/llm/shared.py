"""What the operators of this package share: the cluster's shared folder and small expressions."""

from __future__ import annotations

import functools
import math
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as in `[\x20\x09-\x0D]`.
SPACES = " \t\n\x0b\x0c\r"
#: What one summary of frequent values can go down to.
LEAST_SUPPORT = 1e-4
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


@functools.cache
def _own_folder() -> str:
    return "file://" + tempfile.mkdtemp(prefix="tidemark-")


def shared_folder(spark: SparkSession) -> str:
    """This application's folder in what driver and executors share: spark.checkpoint.dir.

    Only a local master, which has no other machine, may leave it unset; it then gets
    a temporary folder. A cluster without the setting is an error.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        # In full, so that Python's file systems and Hadoop's mean the same place.
        path = spark._jvm.org.apache.hadoop.fs.Path(found)
        whole = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
        return re.sub(r"^file:/+", "file:///", whole).rstrip("/") + f"/tidemark/{spark.sparkContext.applicationId}"
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return _own_folder()


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a Parquet table in the shared folder: computed once, and its lineage is cut there.

    A lost executor costs a re-read. Both sides of a join between such tables are plain
    exchanges, which adaptive execution can split when a key is hot.
    """
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def purge(spark: SparkSession) -> None:
    """Delete the tables and files that operators of this application have left; those of others stay."""
    jvm, root = spark._jvm, shared_folder(spark)
    path = jvm.org.apache.hadoop.fs.Path(root)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(c, UPPER, LOWER)


def body(name: str) -> Column:
    """A text column, null as the empty text."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def frequent(df: DataFrame, column: str, support: float) -> DataFrame:
    """Misra-Gries candidates: every value held by more than `support` of the rows is among them.

    One row for each candidate, some 1 / support; the summary merges map-side, so the
    shuffle has one bounded summary for each task. One summary goes down to LEAST_SUPPORT. Below it
    (integer columns only) what a first summary names is taken out, and the rest is dealt into
    classes by value, in which a share of the rows is a larger one: a summary for each class, with room for
    twice the mean class.
    """
    if support >= LEAST_SUPPORT:
        return _summary(df, column, support)
    most = written(_summary(df, column, LEAST_SUPPORT), "frequent")
    classes = math.ceil(2 * LEAST_SUPPORT / support)
    rest = df.select(column).where(F.col(column).isNotNull()).join(F.broadcast(most), column, "left_anti").withColumn("class", F.pmod(F.xxhash64(column), F.lit(classes)).cast("int"))
    path = fresh_path(df.sparkSession, "frequent-classes")
    rest.write.partitionBy("class").parquet(path)
    dealt = df.sparkSession.read.schema(rest.schema).parquet(path)
    return functools.reduce(DataFrame.union, [_summary(dealt.where(F.col("class") == c).select(column), column, LEAST_SUPPORT) for c in range(classes)], most)


def _summary(df: DataFrame, column: str, support: float) -> DataFrame:
    return df.stat.freqItems([column], support).select(F.explode(f"{column}_freqItems").alias(column)).where(F.col(column).isNotNull())


def row_key(*names: str) -> list[Column]:
    """k1, k2: 128 bits that stand for the values of these columns, nulls included."""
    parts = [x for n in names for x in (F.col(n).isNull(), F.col(n))]
    return [F.xxhash64(*parts).alias("k1"), F.xxhash64(F.lit(1), *parts).alias("k2")]


def columns(names: list[str]) -> list[Column]:
    """Columns by name, whatever characters the names have."""
    return [F.col(f"`{n.replace('`', '``')}`") for n in names]


def row_hash(df: DataFrame) -> Column:
    """128 bits of all columns of a row, whatever their types: what orders rows that keys leave equal."""
    cols = [F.to_json(F.struct(c)) if "map<" in kind or kind == "variant" else c for c, (_, kind) in zip(columns(df.columns), df.dtypes)]
    parts = [x for c in cols for x in (c.isNull(), c)]
    return F.struct(F.xxhash64(*parts).alias("h1"), F.xxhash64(F.lit(1), *parts).alias("h2"))


def one_row_each(docs: DataFrame, stay: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of docs whose key (k1, k2 of id and text) is in `stay`, one for each key."""
    keyed = docs.select(F.struct(*columns(docs.columns)).alias("row"), *row_key(id_col, text_col), row_hash(docs).alias("h"))
    kept = keyed.join(stay.hint("shuffle_hash"), ["k1", "k2"], "left_semi")
    return kept.groupBy("k1", "k2").agg(F.min_by("row", "h").alias("row")).select("row.*")
