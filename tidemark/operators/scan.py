"""Prefix scans over ordered series that no task has to hold whole.

Running sums, last values, maxima and shifts are windows by key, and a window by key is one
task for one key. Where a key has more rows than a segment may have, its series is cut by its order
into segments: each segment is scanned alone, one summary of each (a sum, a last value, the rows at
its edge) is scanned in turn, and what that carries in is merged into the segment's rows. The result is the
window's, but for the order in which floating-point sums are added up.

Cuts come from a sample and only balance the work: any cuts give the same result. There are at most
four segments for each shuffle partition and twice as many keys to cut, so cuts and summaries are
small whatever the size of the table, and they are broadcast.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from tidemark.sources.io import materialised

#: Rows that one task may have of a key, and sampled rows for each segment to cut.
SEGMENT_ROWS, SAMPLE = 1_000_000, 64
#: A row takes no less in the tables read, as a rule: where they are smaller, nothing is searched for long keys. Either way
#: gives the same result.
LEAST_BYTES = 8


@dataclass(frozen=True)
class Series:
    """A key and an order, which ends in a unique column."""

    key: tuple[str, ...]
    order: tuple[str, ...]
    segment_rows: int = SEGMENT_ROWS

    def window(self) -> WindowSpec:
        return Window.partitionBy(*(self.key or (F.lit(0),))).orderBy(*self.order)


@dataclass(frozen=True)
class Scan:
    """One column: over the rows of a segment, of whole segments, of their summaries, and both put together."""

    local: Callable[[WindowSpec], Column]
    whole: Callable[[Column], Column]  # of the order as a struct
    carried: Callable[[Column, WindowSpec], Column]
    merged: Callable[[Column, Column], Column]
    shift: int = 0
    value: Column | None = None


def _frame(inclusive: bool) -> Callable[[WindowSpec], WindowSpec]:
    return lambda w: w.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)


def _before(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, -1)


def total(value: Column, inclusive: bool = True) -> Scan:
    """The sum so far; null as long as there is no value."""
    f = _frame(inclusive)
    return Scan(lambda w: F.sum(value).over(f(w)), lambda o: F.sum(value), lambda s, w: F.sum(s).over(_before(w)), lambda a, b: F.coalesce(a + b, a, b))


def number() -> Scan:
    """1 for the first row."""
    return total(F.lit(1))


def most(value: Column, inclusive: bool = True) -> Scan:
    """The largest value so far."""
    f = _frame(inclusive)
    return Scan(lambda w: F.max(value).over(f(w)), lambda o: F.max(value), lambda s, w: F.max(s).over(_before(w)), lambda a, b: F.greatest(a, b))


def last(value: Column, inclusive: bool = True) -> Scan:
    """The last value so far that isn't null."""
    f = _frame(inclusive)
    return Scan(
        lambda w: F.last(value, ignorenulls=True).over(f(w)),
        lambda o: F.max_by(value, F.when(value.isNotNull(), o)),
        lambda s, w: F.last(s, ignorenulls=True).over(_before(w)),
        lambda a, b: F.coalesce(a, b),
    )


def shifted(value: Column, k: int = 1) -> Scan:
    """The value k rows before, or -k rows after where k is negative; null where there is no such row."""
    if k == 0:
        raise ValueError("a shift of no rows is the value itself")
    boxed = F.struct(value.alias("v"))  # null only where the row is missing
    move = F.lag if k > 0 else F.lead
    n = abs(k)

    def carried(s: Column, w: WindowSpec) -> Column:
        near = F.flatten(F.collect_list(s).over(w.rowsBetween(-n, -1) if k > 0 else w.rowsBetween(1, n)))
        return F.slice(near, F.greatest(F.size(near) - n + 1, F.lit(1)), n) if k > 0 else F.slice(near, 1, n)

    return Scan(lambda w: move(boxed, n).over(w), lambda o: F.lit(None), carried, lambda a, b: F.coalesce(a, b), k, boxed)


def scanned(df: DataFrame, series: Series, scans: dict[str, Scan]) -> DataFrame:
    """df with a column for each scan.

    Null keys are a key. The order's columns ascend, nulls first. A table that is too small to have
    a long key is one window without further jobs. Others are counted by key first; with a long key
    the rows are written to the scratch folder, from where cuts, summaries and scans read them, so scans
    that build on each other don't compute each other's input anew.
    """
    unboxed = lambda s, c: c["v"] if s.shift else c
    cuts = _cuts(df, series)
    if cuts is None:
        w = series.window()
        return df.select("*", *[unboxed(s, s.local(w)).alias(name) for name, s in scans.items()])
    df = materialised(df)
    key = [f"__k{i}" for i in range(len(series.key))]
    same = lambda other: _all([F.col(a).eqNullSafe(other[b]) for a, b in zip(series.key, key)])
    order = _order(series)
    found = df.join(F.broadcast(cuts), same(cuts), "left").drop(*key)
    segment = F.when(F.col("__cuts").isNotNull(), F.size(F.filter("__cuts", lambda x: x <= order))).otherwise(0)
    rows = found.withColumn("__segment", segment).withColumn("__long", F.col("__cuts").isNotNull()).drop("__cuts")
    parts = [*series.key, "__segment"]

    sums = rows.where("__long").groupBy(*parts).agg(F.count(F.lit(1)).alias("__n"), *[s.whole(order).alias(f"__s_{name}") for name, s in scans.items()])
    for name, s in scans.items():
        if s.shift:
            sums = sums.drop(f"__s_{name}")
            edge = _edge(rows.where("__long"), parts, series, s, f"__s_{name}")
            renamed = edge.select(*[F.col(c).alias(f"__e{i}") for i, c in enumerate(parts)], f"__s_{name}")
            sums = sums.join(renamed, _all([F.col(c).eqNullSafe(F.col(f"__e{i}")) for i, c in enumerate(parts)]), "left").drop(*[f"__e{i}" for i in range(len(parts))])
    over = Window.partitionBy(*(series.key or (F.lit(0),))).orderBy("__segment")
    state = sums.select(*[F.col(c).alias(k) for c, k in zip(series.key, key)], F.col("__segment").alias("__of"), F.col("__n"), *[s.carried(F.col(f"__s_{name}"), over).alias(f"__c_{name}") for name, s in scans.items()])

    w = Window.partitionBy(*parts).orderBy(*series.order)
    local = rows.select("*", *[s.local(w).alias(f"__l_{name}") for name, s in scans.items()], F.row_number().over(w).alias("__nth"))
    both = local.join(F.broadcast(state), same(state) & (F.col("__segment") == state["__of"]), "left")

    def merged(name: str, s: Scan) -> Column:
        a, b = F.col(f"__l_{name}"), F.col(f"__c_{name}")
        if s.shift > 0:
            b = F.try_element_at(b, F.col("__nth") - F.lit(s.shift + 1))
        elif s.shift:
            b = F.try_element_at(b, F.greatest(F.lit(1), (F.lit(-s.shift) - (F.col("__n") - F.col("__nth"))).cast("int")))
        return unboxed(s, s.merged(a, b)).alias(name)

    return both.select(*[F.col(f"`{c}`") for c in df.columns], *[merged(name, s) for name, s in scans.items()])


def has_long_keys(df: DataFrame, series: Series) -> bool:
    """Whether a scan would cut a key."""
    return _cuts(df, series) is not None


def _all(conditions: list[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def _order(series: Series) -> Column:
    return F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(series.order)])


def _edge(rows: DataFrame, parts: list[str], series: Series, s: Scan, name: str) -> DataFrame:
    """The last rows of each segment (the first, for a shift the other way), in order: as many as the shift has."""
    order, n = _order(series), abs(s.shift)
    if n == 1:
        pick = F.max_by if s.shift > 0 else F.min_by
        return rows.groupBy(*parts).agg(F.array(pick(s.value, order)).alias(name))
    w = Window.partitionBy(*parts).orderBy(*[(F.desc if s.shift > 0 else F.asc)(c) for c in series.order])
    near = rows.select(*parts, order.alias("__o"), s.value.alias("__v"), F.row_number().over(w).alias("__r")).where(F.col("__r") <= n)
    return near.groupBy(*parts).agg(F.transform(F.array_sort(F.collect_list(F.struct("__o", "__v"))), lambda x: x["__v"]).alias(name))


def _read_bytes(df: DataFrame) -> int:
    """Bytes of the tables that df reads: known without planning df, and no product of sizes after a join."""
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    return sum(int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size()))


def _cuts(df: DataFrame, series: Series) -> DataFrame | None:
    """For each key with more rows than a segment: where its segments begin, as an array of orders. None without such keys."""
    if _read_bytes(df) < series.segment_rows * LEAST_BYTES:
        return None
    spark = df.sparkSession
    most_segments = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    key = [f"__k{i}" for i in range(len(series.key))]
    counts = df.groupBy(*[F.col(c).alias(k) for c, k in zip(series.key, key)]).agg(F.count(F.lit(1)).alias("n"))
    long = counts.where(F.col("n") > series.segment_rows).agg(F.sum("n")).first()[0]
    if not long:
        return None
    size = max(series.segment_rows, -(-long // most_segments))
    hot = counts.where(F.col("n") > size)
    n_hot = hot.agg(F.sum("n")).first()[0]  # of at most most_segments keys
    if not n_hot:
        return None
    share = min(1.0, SAMPLE / size)
    same = _all([F.col(c).eqNullSafe(F.col(k)) for c, k in zip(series.key, key)])
    sample = df.select(*[F.col(c) for c in series.key], _order(series).alias("__o")).join(F.broadcast(hot), same, "inner") if key else df.select(_order(series).alias("__o"), F.lit(n_hot).alias("n"))
    sample = sample.where(F.rand(7) < share).select(*key, "n", "__o")
    schema = sample.groupBy(*key).agg(F.array_sort(F.collect_list("__o")).alias("__cuts")).schema
    by: dict[tuple, tuple[int, list]] = {}
    for r in sample.collect():  # about SAMPLE rows a segment
        by.setdefault(tuple(r[: len(key)]), (r["n"], []))[1].append(r["__o"])
    nulls_first = lambda o: (0,) if o is None else (1, tuple(map(nulls_first, o)) if isinstance(o, tuple) else o)
    out = []
    for k, (n, orders) in by.items():
        orders.sort(key=nulls_first)
        segments = -(-n // size)
        out.append((*k, [orders[i * len(orders) // segments] for i in range(1, segments)]))
    return spark.createDataFrame(out, schema)
