"""Reading with schemas and checks, writing idempotently, and cutting lineage."""

from __future__ import annotations

import functools
import re
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def require_columns(df: DataFrame, required: Sequence[str], what: str = "input") -> DataFrame:
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"{what} lacks columns: {', '.join(missing)}")
    return df


def read_csv(spark: SparkSession, path: str, columns: Sequence[str], casts: dict[str, str] | None = None, lines_in_cells: bool = False) -> DataFrame:
    """A CSV with a header, read as text and then cast; what doesn't parse becomes null.

    With lines_in_cells a cell may hold line ends; a file is then read by one task.
    """
    df = require_columns(spark.read.csv(path, header=True, multiLine=lines_in_cells, escape='"'), columns, path)
    return df.select(*[F.col(c).try_cast(casts[c]).alias(c) if casts and c in casts else F.col(c) for c in columns])


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; blank and broken ones are skipped."""
    lines = spark.read.text(path).where(F.btrim("value") != "")
    parsed = lines.select(F.from_json("value", f"{schema}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("r"))
    return parsed.where(F.col("r").isNotNull() & F.col("r._corrupt").isNull()).select("r.*").drop("_corrupt")


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p))


def first_existing(spark: SparkSession, paths: Sequence[str]) -> str | None:
    """A later path counts only where the earlier ones do not exist; empty ones do."""
    return next((p for p in paths if exists(spark, p)), None)


def append_new(df: DataFrame, path: str, key: Sequence[str], fmt: str = "parquet") -> None:
    """Append the rows whose key the table at path doesn't have, one for each key.

    Reading and appending are two steps: a table has one writer at a time.
    """
    spark = df.sparkSession
    df = df.dropDuplicates(list(key))
    if exists(spark, path):
        df = materialised(df.join(spark.read.format(fmt).load(path).select(*key).distinct(), list(key), "left_anti"))
    df.write.mode("append").format(fmt).save(path)


def append_csv(df: DataFrame, path: str) -> None:
    """Append to a folder of CSV files, each with the header."""
    df.write.mode("append").option("header", True).option("escape", '"').csv(path)


def write_report(df: DataFrame, path: str, most: int = 10_000) -> int:
    """A report, which is small, as one JSON-lines file in the folder; more than `most` rows are an error."""
    n = df.limit(most + 1).count()
    if n > most:
        raise ValueError(f"a report has {most} rows at most")
    df.coalesce(1).write.mode("overwrite").json(path)
    return n


def read_jdbc(spark: SparkSession, url: str, table: str, column: str | None = None, low: int = 0, high: int = 0, parts: int = 1, **options: str) -> DataFrame:
    """A database table, read by `parts` tasks over ranges of a numeric column where one is named."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options)
    if column:
        reader = reader.option("partitionColumn", column).option("lowerBound", low).option("upperBound", high).option("numPartitions", parts)
    return reader.load()


def split_write(df: DataFrame, condition: Column, good: str, bad: str) -> None:
    """Rows that meet the condition to one place, the others (nulls too) to another."""
    ok = F.coalesce(condition, F.lit(False))
    df.where(ok).write.mode("overwrite").parquet(good)
    df.where(~ok).write.mode("overwrite").parquet(bad)


def metadata_differences(current: DataFrame, wanted: DataFrame, key: Sequence[str]) -> DataFrame:
    """Wanted rows that the table lacks or holds otherwise, nulls equal to nulls."""
    rest = [c for c in wanted.columns if c not in key]
    b = current.select(*key, F.struct(*rest).alias("_now"))
    return wanted.join(b, list(key), "left").where(~F.struct(*rest).eqNullSafe(F.col("_now"))).drop("_now")


@functools.cache
def _own_folder() -> str:
    return "file://" + tempfile.mkdtemp(prefix="tidemark-")


def scratch(spark: SparkSession) -> str:
    """This application's folder for intermediate tables: in spark.checkpoint.dir, or on a local master without one in a temporary folder."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root and spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    # In full, so that Python's file systems and Hadoop's mean the same place.
    path = spark._jvm.org.apache.hadoop.fs.Path(root or _own_folder())
    whole = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return re.sub(r"^file:/+", "file:///", whole).rstrip("/") + f"/tidemark/{spark.sparkContext.applicationId}/tables"


def purge(spark: SparkSession) -> None:
    """Delete this application's intermediate tables; results that still read them are lost, other applications' tables stay."""
    path = spark._jvm.org.apache.hadoop.fs.Path(scratch(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialised(df: DataFrame) -> DataFrame:
    """df as a table in the scratch folder: computed once, its lineage cut."""
    path = f"{scratch(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
