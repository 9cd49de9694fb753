"""Two tables rewritten into co-bucketed files by multi-level radix partitioning.

A bucket's number is read as digits of a small base. Each pass splits the files of one prefix by
the next digit, so that a task has as many open files as the base, whatever the number of buckets;
the leaves sort (Spark's external sort) and emit one file for each bucket. Files that already hold
exactly one bucket's rows stay where they are.

What goes to the driver is counted by files and buckets: their numbers, never rows or keys.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from .shared import columns

FILES = "table_name string, bucket long, path string, columns string, n_rows long, ids_sha256 string, lineage_sha256 string, n_joined long, rewritten boolean"


def _free(df: DataFrame, name: str) -> str:
    """A column name that the table doesn't have, in whatever case."""
    taken = {c.lower() for c in df.columns}
    return next(x for x in (name + "_" * i for i in itertools.count()) if x not in taken)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def _together(jobs: list[Callable[[], None]], most: int = 4) -> None:
    """Jobs of one pass, a few at a time: small ones leave executors idle."""
    with ThreadPoolExecutor(most) as pool:
        for done in [pool.submit(job) for job in jobs]:
            done.result()


def key_bucket(key: Column, buckets: int, salt: str = "") -> Column:
    """Unsigned crc32 of salt and the key's decimal digits, modulo buckets; null for null."""
    return (F.crc32(F.concat(F.lit(salt), key.cast("string")).cast("binary")) % buckets).cast("int")


@dataclass
class Table:
    """A table in numbered files: `<folder>/file=<number>`, each sorted by the key and then all other columns."""

    name: str
    rows: DataFrame
    key: str
    folder: str
    number: str = field(init=False)
    bucket: str = field(init=False)

    def __post_init__(self) -> None:
        self.number, self.bucket = _free(self.rows, "file"), _free(self.rows, "bucket")

    @property
    def spark(self) -> SparkSession:
        return self.rows.sparkSession

    def order(self) -> list[Column]:
        """The key, then the rest left to right; nulls first, strings by their UTF-8 bytes."""
        return [c.asc_nulls_first() for c in columns([self.key, *[c for c in self.rows.columns if c != self.key]])]

    def schema(self, *more: str) -> StructType:
        return StructType([*self.rows.schema.fields, *[StructField(c, IntegerType()) for c in more]])

    def write_numbered(self, number: Column, most: int) -> None:
        """A sorted file for each number from 0 to most - 1 that has rows."""
        dealt = self.rows.withColumn(self.number, number.cast("int")).repartitionById(most, self.number)
        dealt.sortWithinPartitions(self.number, *self.order()).write.partitionBy(self.number).parquet(f"{self.folder}/start")

    def numbered(self) -> DataFrame:
        return self.spark.read.schema(self.schema(self.number)).parquet(f"{self.folder}/start")

    def refine(self, routed: DataFrame, present: list[int], fanout: int, digits: int, work: str) -> None:
        """routed (the table's columns and its bucket) into `<folder>/final`, a file for each bucket.

        The first pass deals rows out by the first digit as they come, without a shuffle. Each
        pass after it reads the files of one prefix only. The last digit is a shuffle of `fanout`
        ways, whose tasks sort one bucket each.
        """
        step = fanout ** (digits - 1)
        first = _free(self.rows, "digit")
        if digits > 1:
            routed.withColumn(first, F.floor(F.col(self.bucket) / step).cast("int")).write.partitionBy(first).parquet(f"{work}/level0")
            folders = {(x,): f"{work}/level0/{first}={x}" for x in sorted({b // step for b in present})}
        else:
            folders = {(): ""}
        read = lambda at: self.spark.read.schema(self.schema(self.bucket)).parquet(at) if at else routed

        for level in range(1, digits - 1):
            step //= fanout

            def split(prefix: tuple[int, ...], at: str, level: int = level, step: int = step) -> None:
                digit = F.pmod(F.floor(F.col(self.bucket) / step), F.lit(fanout)).cast("int")
                read(at).withColumn(first, digit).write.partitionBy(first).parquet(f"{work}/level{level}/{'-'.join(map(str, prefix))}")

            _together([lambda p=p, at=at: split(p, at) for p, at in folders.items()])
            for at in folders.values():
                _delete(self.spark, at)
            folders = {
                (*p, x): f"{work}/level{level}/{'-'.join(map(str, p))}/{first}={x}"
                for p in folders
                for x in sorted({b // step % fanout for b in present if _prefix(b, fanout, digits, len(p)) == p})
            }

        def leaf(prefix: tuple[int, ...], at: str) -> None:
            dealt = read(at).repartitionById(fanout, F.col(self.bucket) % fanout)
            dealt.sortWithinPartitions(self.bucket, *self.order()).write.partitionBy(self.bucket).parquet(f"{self.folder}/final/{_free(self.rows, 'group')}={'-'.join(['g', *map(str, prefix)])}")
            if at:
                _delete(self.spark, at)

        _together([lambda p=p, at=at: leaf(p, at) for p, at in folders.items()])


def _prefix(bucket: int, fanout: int, digits: int, n: int) -> tuple[int, ...]:
    return tuple(bucket // fanout ** (digits - 1 - i) % fanout for i in range(n))


def _streamed_hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (path, id as text) in the order of the files; a row for each path."""
    now, n, sha = None, 0, hashlib.sha256()
    for b in batches:
        path, ids = b.column(0), b.column(1)
        ends = [*(pc.indices_nonzero(pc.not_equal(path[1:], path[:-1])).to_numpy() + 1).tolist(), len(path)] if len(path) else []
        start = 0
        for end in ends:
            this = path[start].as_py()
            if this != now:
                if now is not None:
                    yield pa.RecordBatch.from_pylist([{"path": now, "n_rows": n, "ids_sha256": sha.hexdigest()}])
                now, n, sha = this, 0, hashlib.sha256()
            text = ",".join(ids[start:end].to_pylist())
            sha.update(("," * (n > 0) + text).encode())
            n, start = n + end - start, end
    if now is not None:
        yield pa.RecordBatch.from_pylist([{"path": now, "n_rows": n, "ids_sha256": sha.hexdigest()}])


def _fits(found: DataFrame, t: Table) -> tuple[dict[int, int], list[int]]:
    """Starting files that hold exactly one bucket's rows, as {file: bucket}, and all buckets.

    One row for each starting file and each bucket comes to the driver.
    """
    files = found.groupBy(t.number).agg(F.min(t.bucket).alias("lo"), F.max(t.bucket).alias("hi"), F.sum("n").alias("n")).collect()
    rows = {r[0]: r[1] for r in found.groupBy(t.bucket).agg(F.sum("n")).collect()}
    return {r[0]: r["lo"] for r in files if r["lo"] == r["hi"] and rows[r["lo"]] == r["n"]}, sorted(rows)


def _report(t: Table, stays: dict[int, int], found: DataFrame, rewritten: bool) -> DataFrame:
    """Read the final files back: path, bucket, rows, and the hash of their ids in the order they lie in."""
    source, at = F.col("_metadata.file_path"), F.col("_metadata.row_index")
    ids = F.coalesce(columns([t.key])[0].cast("string"), F.lit("")).alias("id")
    parts = []
    if rewritten:
        new = t.spark.read.schema(t.schema(t.bucket)).parquet(f"{t.folder}/final")
        parts.append(new.select(source.alias("path"), at.alias("at"), ids, F.col(t.bucket).alias("b"), F.lit(True).alias("rewritten")))
    if stays:
        old = t.numbered()
        of = F.element_at(F.create_map(*[F.lit(x) for pair in stays.items() for x in pair]), F.col(t.number))
        parts.append(old.select(source.alias("path"), at.alias("at"), ids, of.alias("b"), F.lit(False).alias("rewritten")))
    if not parts:
        return t.spark.createDataFrame([], FILES)
    both = parts[0] if len(parts) == 1 else parts[0].union(parts[1])
    hashes = both.select("path", "id", "at").repartition("path").sortWithinPartitions("path", "at").select("path", "id").mapInArrow(_streamed_hash, "path string, n_rows long, ids_sha256 string")
    # Which bucket a file has stands in its folder's name, or in the list of those that stay.
    folder = lambda name: F.regexp_extract("path", f"/{name}=([0-9]+)/[^/]*$", 1).try_cast("int")
    bucket = folder(t.bucket)
    if stays:
        bucket = F.coalesce(bucket, F.element_at(F.create_map(*[F.lit(x) for pair in stays.items() for x in pair]), folder(t.number)))
    of = found.groupBy(t.bucket, t.number).agg(F.sum("n").alias("n")).groupBy(F.col(t.bucket).alias("bucket"))
    lineage = of.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(t.number, "n"))), lambda x: F.concat(x[t.number].cast("string"), F.lit(":"), x["n"].cast("string"))), ",").cast("binary"), 256).alias("lineage_sha256"))
    files = hashes.withColumn("bucket", bucket).withColumn("rewritten", ~F.contains(F.col("path"), F.lit(f"/{t.name}/start/")))
    return files.join(lineage, "bucket").withColumn("table_name", F.lit(t.name)).withColumn("columns", F.lit(",".join(t.rows.columns)))


def co_bucketed(
    left: DataFrame,
    right: DataFrame,
    key: str,
    folder: str,
    buckets: int = 300,
    salt: str = "line",
    left_number: Callable[[Column], Column] | None = None,
    right_number: Column | None = None,
    names: tuple[str, str] = ("left", "right"),
    fanout: int = 18,
) -> DataFrame:
    """Both tables in numbered files under `folder`, then rewritten there into one file for each table and bucket: FILES.

    A key's bucket is key_bucket(key, buckets, salt); right rows whose key is no left key have the
    bucket `buckets`, rows of either table with a null key `buckets` + 1. left_number makes a
    left row's starting file of its bucket, right_number is that of a right row (default: its
    bucket by key alone). Repeated rows all stay, an empty table has no files, texts may be empty or long,
    and further columns of any names are carried, as long as their types can be sorted.
    NaN sorts behind all numbers, -0.0 with 0.0.
    """
    spark, work = left.sparkSession, f"{folder}/work"
    a, b = Table(names[0], left, key, f"{folder}/{names[0]}"), Table(names[1], right, key, f"{folder}/{names[1]}")
    by_key = lambda c: F.coalesce(key_bucket(c, buckets, salt), F.lit(buckets + 1))
    col = columns([key])[0]
    a.write_numbered(by_key(col) if left_number is None else left_number(by_key(col)), buckets + 2)
    b.write_numbered(by_key(col) if right_number is None else right_number, buckets + 2)

    # Counts by key and starting file: narrow, and a hot key has one row for each file.
    counted = lambda t: t.numbered().groupBy(col.alias("k"), F.col(t.number)).agg(F.count(F.lit(1)).alias("n"))
    counted(a).withColumn(a.bucket, by_key(F.col("k"))).write.parquet(f"{work}/left")
    in_left = spark.read.parquet(f"{work}/left")
    known = in_left.where("k IS NOT NULL").groupBy("k").agg(F.sum("n").alias("left_n"))
    counted(b).join(known, "k", "left").withColumn(b.bucket, F.when(F.col("k").isNotNull() & F.col("left_n").isNull(), buckets).otherwise(by_key(F.col("k")))).write.parquet(f"{work}/right")
    in_right = spark.read.parquet(f"{work}/right")
    joined = in_right.where(F.col(b.bucket) < buckets).groupBy(F.col(b.bucket).alias("bucket")).agg(F.sum(F.col("n") * F.col("left_n")).alias("n_joined"))

    digits = next(n for n in itertools.count(1) if fanout**n >= buckets + 2)
    reports = []
    for t, found in ((a, in_left), (b, in_right)):
        stays, present = _fits(found, t)
        moved = [x for x in present if x not in stays.values()]
        if moved:
            rows = t.numbered()
            rows = rows.where(~F.col(t.number).isin(list(stays))) if stays else rows
            if t is b:
                lost = _free(rows, "no_left")
                orphans = found.where(F.col(t.bucket) == buckets).select(F.col("k").alias(_free(rows, "k"))).distinct().withColumn(lost, F.lit(True))
                rows = rows.join(orphans, rows[key] == orphans[orphans.columns[0]], "left")
                bucket = F.when(F.col(lost), buckets).otherwise(by_key(rows[key]))
            else:
                bucket = by_key(col)
            t.refine(rows.select(*[rows[f"`{c.replace('`', '``')}`"] for c in t.rows.columns], bucket.alias(t.bucket)), moved, fanout, digits, f"{work}/{t.name}")
        reports.append((t, stays, found, bool(moved)))
    parts = [_report(*r).select("table_name", "bucket", "path", "columns", "n_rows", "ids_sha256", "lineage_sha256", "rewritten") for r in reports]
    out = parts[0].union(parts[1]).join(joined, "bucket", "left").withColumn("n_joined", F.coalesce("n_joined", F.lit(0)))
    rows = out.selectExpr(*[f"CAST({x.split()[0]} AS {x.split()[1]}) AS {x.split()[0]}" for x in FILES.split(", ")]).collect()  # two rows a bucket
    for t, stays, found, _ in reports:
        for gone in {r[0] for r in found.select(t.number).distinct().collect()} - set(stays):
            _delete(spark, f"{t.folder}/start/{t.number}={gone}")
    _delete(spark, work)
    return spark.createDataFrame(rows, FILES)
