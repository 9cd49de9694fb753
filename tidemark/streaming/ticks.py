"""Tick streams: partial frames, latest states, change-or-heartbeat emission.

Each stateful operator has a batch equivalent over the same rows; tests hold them together.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.functions import market as M

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def parse_ticks(lines: DataFrame, line: str = "value") -> DataFrame:
    """record_type, symbol, name, bid, ask, high, low, price of tab- or pipe-delimited frames.

    The pipe form has its numbers right behind the symbol, the tab form one place later. Types 1
    and 2 quote the ask or else the bid, type 3 the ask only; frames without a price, of other
    types and keep-alives are dropped.
    """
    pipe = F.col(line).contains("|") & ~F.col(line).contains("\t")
    f = F.when(pipe, F.split(F.btrim(line), "\\|")).otherwise(F.split(F.btrim(line), "\t"))
    at = lambda i: F.nullif(F.nullif(F.btrim(F.get("_f", F.lit(i))), F.lit("-")), F.lit(""))
    number = lambda i: F.when(F.col("_pipe"), M.number(at(i))).otherwise(M.number(at(i + 1)))
    out = lines.withColumn("_f", f).withColumn("_pipe", pipe).withColumn("record_type", at(0)).withColumn("symbol", at(1))
    named = F.col("record_type").isin("1", "2") & ~F.col("_pipe")
    for i, name in enumerate(("bid", "ask", "high", "low"), 2):
        out = out.withColumn(name, number(i))
    out = out.withColumn("name", F.when(named, at(2))).withColumn("price", F.when(F.col("record_type") == "3", F.col("ask")).otherwise(F.coalesce("ask", "bid")))
    return out.where(F.col("record_type").isin("1", "2", "3") & F.col("symbol").isNotNull() & F.col("price").isNotNull()).drop("_f", "_pipe")


def parse_status(lines: DataFrame, line: str = "value") -> DataFrame:
    """is_displayed, market_status and updated_at (text) of type 4 frames."""
    pipe = F.col(line).contains("|") & ~F.col(line).contains("\t")
    f = F.when(pipe, F.split(F.btrim(line), "\\|")).otherwise(F.split(F.btrim(line), "\t"))
    at = lambda i: F.btrim(F.when(pipe, F.get(f, F.lit(i))).otherwise(F.get(f, F.lit(i + 1))))
    rows = lines.where(F.btrim(F.get(f, F.lit(0))) == "4")
    updated = F.nullif(F.regexp_replace(F.coalesce(F.when(~pipe, F.get(f, F.lit(6))), F.lit("")), '"', ""), F.lit(""))
    return rows.select((F.coalesce(at(2), F.lit("1")) == "1").alias("is_displayed"), F.when(F.coalesce(at(3), F.lit("0")) == "1", "CLOSED").otherwise("OPEN").alias("market_status"), updated.alias("updated_at"))


def merge_partial(df: DataFrame, key: list[str], order: list[str], fields: list[str]) -> DataFrame:
    """Batch form of partial frames: each field keeps its last non-empty value so far."""
    from pyspark.sql import Window

    w = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    for c in fields:
        text = dict(df.dtypes)[c] == "string"
        df = df.withColumn(c, F.last(F.when(F.col(c) != "", F.col(c)) if text else F.col(c), ignorenulls=True).over(w))
    return df


def sane(ts: Column, now: Column, future: str = "15 minutes", keep: str = "72 hours") -> Column:
    """Neither too far ahead nor too old."""
    return (ts <= now + F.expr(f"interval {future}")) & (ts >= now - F.expr(f"interval {keep}"))


def _news(price: float, at: float, quarantined: bool, last: tuple[float, float] | None, least: float, heartbeat: float | None) -> tuple[str | None, tuple[float, float] | None]:
    """Why a row is told, if it is, and the price and time that later rows are compared with."""
    if quarantined:  # told, but never a price that others are compared with
        return "QUARANTINED", last
    if last is None or abs(price - last[0]) > least:
        return "CHANGE", (price, at)
    if heartbeat is not None and at - last[1] >= heartbeat:
        return "HEARTBEAT", (price, at)
    return None, last


def _in_order(rows: Iterator[pd.DataFrame], names: list[str], order: int) -> list[tuple]:
    """A key's rows as tuples of these columns, sorted by the first `order`, missing numbers last; False for a column that isn't there.

    A key has a few rows, for which building and sorting a frame would cost more than the rule.
    """
    told: list[tuple] = []
    for df in rows:
        told += zip(*[df[c].tolist() if c in df.columns else [False] * len(df) for c in names])
    return sorted(told, key=lambda r: tuple((x != x, 0 if x != x else x) for x in r[:order]))


class ChangeOrHeartbeat(StatefulProcessor):
    """Emits a key's row when its price moved by more than `least` since the row last emitted, when
    the row is quarantined, or when `heartbeat` seconds of event time have passed since then (None:
    never). With `timer` seconds, a key that falls silent repeats its last row by processing time.
    """

    def __init__(self, least: float = 1e-4, heartbeat: float | None = None, timer: float | None = None) -> None:
        self.least, self.heartbeat, self.timer = least, heartbeat, timer

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "id long, price double, at double")

    def _made(self, rows: list[tuple]) -> pd.DataFrame:
        key, n, price, at, why = zip(*rows) if rows else ((),) * 5
        return pd.DataFrame({"key": np.array(key, np.int64), "id": np.array(n, np.int64), "price": np.array(price, float), "at": np.array(at, float), "why": np.array(why, object)})

    def _arm(self, now_ms: int) -> None:
        for t in self.handle.listTimers():
            self.handle.deleteTimer(t)
        self.handle.registerTimer(now_ms + int(self.timer * 1000))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        state = self.last.get() if self.last.exists() else None
        last = before = tuple(state[1:]) if state else None
        out, of = [], None
        for at, n, price, quarantined in _in_order(rows, ["at", "id", "price", "quarantined"], 2):
            why, new = _news(float(price), float(at), bool(quarantined), last, self.least, self.heartbeat)
            if why:
                out.append((int(key[0]), int(n), float(price), float(at), why))
            if new != last:
                last, of = new, int(n)
        if last != before:
            self.last.update((of, *last))  # once: each call is a message to the JVM
        if self.timer is not None:
            self._arm(timerValues.getCurrentProcessingTimeInMs())
        if out:
            yield self._made(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if self.last.exists():
            n, price, at = self.last.get()
            self._arm(timerValues.getCurrentProcessingTimeInMs())
            yield self._made([(int(key[0]), n, price, at, "TIMER")])

    def close(self) -> None:
        pass


class PartialFrames(StatefulProcessor):
    """Emits each frame with its empty fields taken from the frames before of its type and symbol.

    The group is a bucket of keys and the state a map by key, as a group of one key has few rows and costs a batch each
    way. Of the map only keys that have rows are read and written.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.fields = handle.getMapState("fields", "key string", "fields array<string>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        by: dict[str | None, list[tuple]] = {}
        for df in rows:
            for k, n, new in zip(df["key"].tolist(), df["id"].tolist(), df["fields"].tolist()):
                by.setdefault(k, []).append((n, list(new)))
        keys, ids, out = [], [], []
        for k, told in by.items():
            at = ("" if k is None else f"={k}",)  # a map's key is never null
            have = before = list(self.fields.getValue(at)[0]) if self.fields.containsKey(at) else []
            for n, new in sorted(told, key=lambda r: r[0]):
                have = [new[i] if i < len(new) and new[i] != "" else (have[i] if i < len(have) else "") for i in range(max(len(new), len(have)))]
                keys.append(k)
                ids.append(int(n))
                out.append(have)
            if have != before:
                self.fields.updateValue(at, (have,))
        yield pd.DataFrame({"key": keys, "id": np.array(ids, np.int64), "fields": out})

    def close(self) -> None:
        pass


def merged_frames(stream: DataFrame, buckets: int = 1024) -> DataFrame:
    """stream(key string, id long, fields array<string>) -> the same with whole fields.

    A task holds a batch's rows of one bucket of keys at a time; `buckets` stays what it was where a query goes on from its checkpoint.
    """
    rows = stream.select(F.pmod(F.xxhash64("key"), F.lit(buckets)).alias("bucket"), "key", "id", "fields")
    return rows.groupBy("bucket").transformWithStateInPandas(PartialFrames(), outputStructType="key string, id long, fields array<string>", outputMode="Append", timeMode="None")


def merged_frames_batch(df: DataFrame) -> DataFrame:
    """The same over a finished table: each place keeps its last field that is not empty."""
    from pyspark.sql import Window

    w = Window.partitionBy("key", "pos").orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    most = Window.partitionBy("key").orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    wide = df.withColumn("n", F.max(F.size("fields")).over(most))
    cells = wide.select("key", "id", F.posexplode(F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.get("fields", i))).alias("pos", "cell"))
    kept = cells.withColumn("cell", F.coalesce(F.last(F.when(F.col("cell") != "", F.col("cell")), ignorenulls=True).over(w), F.lit("")))
    return kept.groupBy("key", "id").agg(F.array_sort(F.collect_list(F.struct("pos", "cell"))).alias("c")).select("key", "id", F.transform("c", lambda x: x["cell"]).alias("fields"))


def cache_accepts(price: Column, status: Column, published: Column, observed: Column, identity: Column, low: float, high: float) -> Column:
    """Whether a rate may replace a cached one: the right identity, valid, within bounds, not of the future.
    One that may not leaves the cached rate as it is."""
    return F.coalesce(identity & (status == "VALID") & price.between(low, high) & (published.isNull() | (published <= observed)), F.lit(False))


def cached_rates(rates: DataFrame, key: list[str], order: list[str], accepted: Column) -> DataFrame:
    """The cache after all rates: each key's last accepted one with the accepted one before and the change."""
    from pyspark.sql import Window

    w = Window.partitionBy(*key).orderBy(*order)
    back = Window.partitionBy(*key).orderBy(*[F.desc(c) for c in order])
    x = rates.where(accepted).withColumn("previous", F.coalesce(F.lag("price").over(w), F.col("price"))).withColumn("_nth", F.row_number().over(back)).where("_nth = 1").drop("_nth")
    return x.withColumn("change", F.round(F.col("price") - F.col("previous"), 2)).withColumn("change_pct", F.when(F.col("previous") > 0, F.round(F.round(F.col("price") - F.col("previous"), 2) / F.col("previous") * 100, 4)).otherwise(0.0))


class LiveCache(StatefulProcessor):
    """The cache as state: of each key's products the last accepted rate, forgotten `ttl` seconds after its last update.

    Emits a row for each accepted rate, and with `timer` seconds all cached rates of a key that has been silent
    so long. Rates that aren't accepted change nothing.
    """

    def __init__(self, ttl: float | None = None, timer: float | None = None) -> None:
        self.ttl, self.timer = ttl, timer

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rates = handle.getMapState("rates", "product string", "id long, price double, previous double, at double", None if self.ttl is None else int(self.ttl * 1000))

    def _made(self, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["key", "product", "id", "price", "previous", "at", "why"]).astype({"id": "int64", "price": "float64", "previous": "float64", "at": "float64"})

    def _arm(self, now_ms: int) -> None:
        if self.timer is not None:
            for t in self.handle.listTimers():
                self.handle.deleteTimer(t)
            self.handle.registerTimer(now_ms + int(self.timer * 1000))

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:  # noqa: N802, N803
        for r in initialState.itertuples(index=False):
            self.rates.updateValue((r.product,), (int(r.id), float(r.price), float(r.previous), float(r.at)))
        self._arm(timerValues.getCurrentProcessingTimeInMs())

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        out = []
        for r in pd.concat(list(rows)).sort_values(["at", "id"], kind="stable").itertuples(index=False):
            if bool(r.accepted):
                held = self.rates.getValue((r.product,)) if self.rates.containsKey((r.product,)) else None
                new = (int(r.id), float(r.price), float(held[1] if held else r.price), float(r.at))
                self.rates.updateValue((r.product,), new)
                out.append((key[0], r.product, *new, "RATE"))
        self._arm(timerValues.getCurrentProcessingTimeInMs())
        yield self._made(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self._arm(timerValues.getCurrentProcessingTimeInMs())
        yield self._made([(key[0], k[0], int(v[0]), float(v[1]), float(v[2]), float(v[3]), "TIMER") for k, v in self.rates.iterator()])

    def close(self) -> None:
        pass


def live_cache(stream: DataFrame, initial: DataFrame | None = None, ttl: float | None = None, timer: float | None = None) -> DataFrame:
    """stream(key string, product string, id long, price double, at double, accepted boolean) -> key, product,
    id, price, previous, at, why: a row for each rate that the cache took, and what its timers repeat.

    initial: stored rates (key, product, id, price, previous, at), which a new query starts from; one that goes on
    from its checkpoint has its own state. A price without one before has itself as previous. Rows are in order
    of time within a batch, and a batch follows the one before. With ttl or timer the query must run by a
    processing-time trigger: time passes without rows, so one that reads what there is now never ends.
    """
    return stream.groupBy("key").transformWithStateInPandas(
        LiveCache(ttl, timer), outputStructType="key string, product string, id long, price double, previous double, at double, why string", outputMode="Append", timeMode="None" if ttl is None and timer is None else "ProcessingTime",
        initialState=None if initial is None else initial.select("key", "product", "id", "price", "previous", "at").groupBy("key"),
    )


def cache_view(cache: DataFrame, now: Column, ttl: float = 3600.0, ts: str = "at") -> DataFrame:
    """The cache as read at `now`: age in seconds, and whether it is past its time to live."""
    age = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col(ts).cast("timestamp"))) / 1e6
    return cache.withColumn("age_seconds", F.greatest(F.lit(0.0), age)).withColumn("expired", F.col("age_seconds") > ttl)


class Snapshots:
    """For foreachBatch: hands a snapshot on whenever the watermark of the latest rows has moved, and a
    heartbeat when `heartbeat` seconds passed without one. A batch that is run again says nothing new."""

    def __init__(self, watermark: Callable[[DataFrame], str | None], emit: Callable[[str, object], None], heartbeat: float = 15.0, clock: Callable[[], float] = time.time) -> None:
        self.watermark, self.emit, self.heartbeat, self.clock = watermark, emit, heartbeat, clock
        self.seen, self.beat = None, clock()

    def __call__(self, df: DataFrame, batch: int) -> None:
        mark = self.watermark(df)
        if mark is not None and mark != self.seen:
            self.seen = mark
            self.emit("snapshot", df)
        if self.clock() - self.beat >= self.heartbeat:
            self.beat = self.clock()
            self.emit("heartbeat", self.beat)


def change_filter(stream: DataFrame, least: float = 1e-4, heartbeat: float | None = None, timer: float | None = None) -> DataFrame:
    """stream(key long, id long, price double, at double, perhaps quarantined boolean) -> the rows that
    are news, and why."""
    return stream.groupBy("key").transformWithStateInPandas(
        ChangeOrHeartbeat(least, heartbeat, timer), outputStructType="key long, id long, price double, at double, why string", outputMode="Append", timeMode="None" if timer is None else "ProcessingTime"
    )


def change_filter_batch(df: DataFrame, least: float = 1e-4, heartbeat: float | None = None) -> DataFrame:
    """The same over a finished table, quarantined rows with it: key, id, price, at, why. Timers are of
    processing time, so a finished table has none.

    Rows are sorted by key and time and streamed through the rule; a task keeps one key's last row.
    """
    rows = df if "quarantined" in df.columns else df.withColumn("quarantined", F.lit(False))
    dealt = rows.select("key", "id", "price", "at", F.coalesce("quarantined", F.lit(False)).alias("quarantined")).repartition("key").sortWithinPartitions("key", "at", "id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, last = None, None
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                if r.key != now:
                    now, last = r.key, None
                why, last = _news(r.price, r.at, bool(r.quarantined), last, least, heartbeat)
                if why:
                    out.append((r.key, r.id, r.price, r.at, why))
            yield pd.DataFrame(out, columns=["key", "id", "price", "at", "why"]).astype({"key": "int64", "id": "int64", "price": "float64", "at": "float64"})

    return dealt.mapInPandas(run, "key long, id long, price double, at double, why string")


def stream_files(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet file or folder as a stream of files."""
    schema = spark.read.parquet(path).schema
    head, _, name = path.rpartition("/")
    return spark.readStream.schema(schema).parquet(f"{head}/{name[:-1]}[{name[-1]}]")


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Read all there is now. Append goes to files with exactly-once commits, and complete overwrites
    the table with the whole result. Update writes each batch's changed rows to a folder of their own,
    which a batch that is run again overwrites; `updated_table` reads the last row of each key."""
    w = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if mode == "append":
        w.format("parquet").start(path).awaitTermination()
    elif mode == "complete":
        w.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(path)).start().awaitTermination()
    else:
        w.foreachBatch(lambda df, batch: df.write.mode("overwrite").parquet(f"{path}/batch={batch}")).start().awaitTermination()


def updated_table(spark: SparkSession, path: str, key: list[str]) -> DataFrame:
    """What update mode has written: of each key the row of the last batch that changed it."""
    df = spark.read.parquet(path)
    rest = [c for c in df.columns if c not in (*key, "batch")]
    return df.groupBy(*key).agg(F.max_by(F.struct(*rest), "batch").alias("last")).select(*key, "last.*")


def latest_by_key(stream: DataFrame, key: list[str], order: list[str], take: list[str]) -> DataFrame:
    return stream.groupBy(*key).agg(F.max_by(F.struct(*take), F.struct(*order)).alias("last")).select(*key, "last.*")
