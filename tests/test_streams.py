"""State across restarts, quarantined rows in batch and stream, heartbeats of an idle source, outages."""

import random
import time

import pytest
from pyspark.sql import functions as F

from tidemark.streaming import progress, ticks

RATES = "key string, product string, id long, price double, at double, accepted boolean"


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ticks.ROCKS)


def test_change_filter_with_quarantined_rows_over_a_restart(spark, rocks, tmp_path):
    rng = random.Random(5)
    rows = [(rng.randrange(4), i, float(rng.randrange(3)), float(i), rng.choice([False, False, True, None])) for i in range(240)]
    schema = "key long, id long, price double, at double, quarantined boolean"
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    for part in (rows[:100], rows[100:]):  # the second run goes on from the first one's checkpoint
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)
        ticks.run_to_table(ticks.change_filter(spark.readStream.schema(schema).parquet(src).withColumn("quarantined", F.coalesce("quarantined", F.lit(False))), heartbeat=9.0), out, out + "-state")
    batch = ticks.change_filter_batch(spark.createDataFrame(rows, schema), heartbeat=9.0)
    assert sorted(map(tuple, spark.read.parquet(out).collect())) == sorted(map(tuple, batch.collect()))
    assert {r.why for r in batch.collect()} == {"CHANGE", "HEARTBEAT", "QUARANTINED"}


def test_live_cache_from_a_stored_table_over_a_restart(spark, rocks, tmp_path):
    rng = random.Random(6)
    rows = [(rng.choice("ab"), rng.choice(["x", "y"]), i, float(rng.randrange(50, 60)), float(i), rng.random() < 0.7) for i in range(200)]
    df = spark.createDataFrame(rows, RATES)
    stored = ticks.cached_rates(df.where("id < 60"), ["key", "product"], ["at", "id"], F.col("accepted"))
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    for lo, hi in ((60, 130), (130, 200)):
        df.where(f"id >= {lo} AND id < {hi}").coalesce(1).write.mode("append").parquet(src)
        ticks.run_to_table(ticks.live_cache(spark.readStream.schema(RATES).parquet(src), stored), out, out + "-state")
    told = spark.read.parquet(out)
    assert sorted(r.id for r in told.collect()) == [r[2] for r in rows if r[5] and r[2] >= 60]
    last = told.groupBy("key", "product").agg(F.max_by(F.struct("id", "price", "previous"), "id").alias("r")).select("key", "product", "r.*")
    want = ticks.cached_rates(df, ["key", "product"], ["at", "id"], F.col("accepted")).select("key", "product", "id", "price", "previous")
    assert sorted(map(tuple, last.collect())) == sorted(map(tuple, want.collect()))


def test_timers_of_a_running_query(spark, rocks, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([("a", "x", 1, 5.0, 1.0, True), ("a", "y", 2, 6.0, 2.0, True), ("b", "x", 3, 7.0, 3.0, False)], RATES).coalesce(1).write.parquet(src)
    q = progress.paced(ticks.live_cache(spark.readStream.schema(RATES).parquet(src), ttl=600.0, timer=0.5), out, str(tmp_path / "c"), "300 milliseconds")
    try:
        until, told = time.time() + 45, []
        while time.time() < until and not any(r.why == "TIMER" for r in told):
            time.sleep(1)
            told = spark.read.schema("key string, product string, id long, price double, why string").parquet(out).collect() if (tmp_path / "out" / "_spark_metadata").exists() else []
    finally:
        q.stop()
    assert {(r.key, r["product"], r.price) for r in told if r.why == "RATE"} == {("a", "x", 5.0), ("a", "y", 6.0)} == {(r.key, r["product"], r.price) for r in told if r.why == "TIMER"}


def test_heartbeats_of_an_idle_source_and_outages(spark, tmp_path):
    before = spark.conf.get("spark.sql.streaming.noDataProgressEventInterval")
    spark.conf.set("spark.sql.streaming.noDataProgressEventInterval", "200")
    log = progress.ProgressLog(spark, f"file://{tmp_path}/log", heartbeat=0.5, names=("idle", "broken"))
    spark.streams.addListener(log)
    try:
        src = str(tmp_path / "in")
        spark.range(7).coalesce(1).write.parquet(src)
        q = progress.paced(spark.readStream.schema("id long").parquet(src), str(tmp_path / "out"), str(tmp_path / "c"), "200 milliseconds", "idle")
        q.processAllAvailable()
        time.sleep(4)  # nothing comes any more
        q.stop()
        bad = spark.readStream.schema("id long").parquet(src).select(F.raise_error(F.lit("source gone")).cast("string").alias("x"))
        q = progress.paced(bad, str(tmp_path / "out2"), str(tmp_path / "c2"), "200 milliseconds", "broken")
        with pytest.raises(Exception, match="source gone"):
            q.awaitTermination(60)
        until = time.time() + 20
        kinds = []
        while time.time() < until and not {("idle", "ENDED"), ("broken", "OUTAGE")} <= set(kinds):
            time.sleep(0.3)
            rows = progress.log_table(spark, f"file://{tmp_path}/log").collect()
            kinds = [(r["query"], r.kind) for r in sorted(rows, key=lambda r: r.at)]
    finally:
        spark.streams.removeListener(log)
        spark.conf.set("spark.sql.streaming.noDataProgressEventInterval", before)
    assert [r.rows for r in rows if r.kind == "PROGRESS" and r["query"] == "idle"] == [7]
    assert kinds.count(("idle", "HEARTBEAT")) >= 3 and ("broken", "OUTAGE") in kinds
    status = {r["query"]: r.status for r in progress.source_status(progress.log_table(spark, f"file://{tmp_path}/log"), time.time()).collect()}
    assert status == {"idle": "ENDED", "broken": "DOWN"}


class Counted:
    """A value state that counts its updates."""

    def __init__(self):
        self.value, self.updates = None, 0

    def getValueState(self, name, schema):
        return self

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value, self.updates = value, self.updates + 1


def test_one_state_update_a_batch():
    """However many of a key's rows are news: an update is a message to the JVM, and dominated large streams."""
    import pandas as pd

    h = Counted()
    p = ticks.ChangeOrHeartbeat()
    p.init(h)
    frames = [pd.DataFrame({"key": 7, "id": ids, "price": [float(i) for i in ids], "at": [float(i) for i in ids]}) for ids in ([3, 2], [1, 4, 5])]
    out = [tuple(r) for f in p.handleInputRows((7,), iter(frames), None) for r in f[["id", "price", "why"]].itertuples(index=False)]
    assert out == [(i, float(i), "CHANGE") for i in range(1, 6)]
    assert h.value == (5, 5.0, 5.0) and h.updates == 1
    assert list(p.handleInputRows((7,), iter([pd.DataFrame({"key": [7], "id": [6], "price": [5.0], "at": [6.0]})]), None)) == [] and h.updates == 1


def test_partial_frames_share_groups(spark, rocks, tmp_path):
    """Keys, null ones too, share groups and keep their own fields over a restart, as the batch form has them."""
    rng = random.Random(9)
    schema = "key string, id long, fields array<string>"
    rows = [(rng.choice([None, "", *"abcdefgh"]), i, [rng.choice(["", "x", "y"]) for _ in range(rng.randrange(4))]) for i in range(300)]
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    for part in (rows[:140], rows[140:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)
        ticks.run_to_table(ticks.merged_frames(spark.readStream.schema(schema).parquet(src), buckets=2), out, out + "-state")
    have, want = {}, []
    for k, i, new in rows:
        old = have.get(k, [])
        have[k] = [new[j] if j < len(new) and new[j] else (old[j] if j < len(old) else "") for j in range(max(len(new), len(old)))]
        want.append((i, k, have[k]))
    assert sorted((r.id, r.key, r.fields) for r in spark.read.parquet(out).collect()) == want
