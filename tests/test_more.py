"""Stories against a pass in order, streams of several batches, timers, files, and single functions."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.functions import market as M
from tidemark.functions import text as T
from tidemark.operators import forecast, ledger, rules, stories
from tidemark.sources import io
from tidemark.streaming import ticks

T0 = datetime(2024, 3, 1)


def first_ids(items, hours=36, least=0.7):
    """The stories of items (id, key, tokens, time), read one after the other."""
    def way(s):
        return (bool(s & set(T.UP)) and not s & set(T.DOWN)) - (bool(s & set(T.DOWN)) and not s & set(T.UP))

    def clash(a, b):
        return any(x in T.ENTITIES or any(c.isdigit() for c in x) for x in a ^ b) or way(a) * way(b) < 0

    opened, out = [], {}
    for i, key, tokens, at in sorted(items, key=lambda x: (x[3], x[0])):
        small = {x for x in key.split(" ") if len(x) > 1}
        best, chosen = -1.0, i
        for j, key2, tokens2, at2, small2 in reversed(opened):
            alike = len(small & small2) / len(small | small2) if small and small2 else 0.0
            score = 1.0 if key == key2 else alike
            if at - at2 <= timedelta(hours=hours) and (key == key2 or alike >= least) and not clash(tokens, tokens2) and score > best:
                best, chosen = score, j
        if chosen == i:
            opened.append((i, key, tokens, at, small))
        out[i] = chosen
    return out


def test_stories_against_a_pass_in_order(spark):
    rng = random.Random(4)
    words = "metal market quiet traders wait mint bazaar buyers return slow gold silver rises falls 12 to in".split()
    pool = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 6))) for _ in range(25)]
    rows = []
    for i in range(260):
        w = rng.choice(pool).split()
        if rng.random() < 0.4:
            w[rng.randrange(len(w))] = rng.choice(words)
        rows.append((i, " ".join(w), T0 + timedelta(minutes=rng.randrange(60 * 24 * 9))))
    df = spark.createDataFrame(rows, "id long, t string, ts timestamp")
    told = df.select("id", T.cluster_key(F.col("t")).alias("k"), T.token_set(F.col("t")).alias("s"), "ts").collect()
    want = first_ids([(r.id, r.k, set(r.s), r.ts) for r in told])
    got = {r.row_id: r.cluster_id for r in stories.story_clusters(df, "t", "ts", "id").collect()}
    assert len(got) == len(rows) and len(set(want.values())) < len(rows)
    by_want, by_got = {}, {}
    for i in got:
        by_want.setdefault(want[i], set()).add(i)
        by_got.setdefault(got[i], set()).add(i)
    assert sorted(map(sorted, by_want.values())) == sorted(map(sorted, by_got.values()))


def test_equal_headlines_make_no_pairs(spark):
    """n equal, blank and null headlines: as many pairs of classes whatever n is, and the stories of a pass in order."""
    def items(n):
        texts = ["Mint says gold steady - Wire", "Mint says gold steady", " ", None, "gold steady says mint", "Mint says gold falls", "Quiet day for traders here"]
        return [(i, texts[i % len(texts)], T0 + timedelta(minutes=13 * i)) for i in range(n)]

    counts = []
    for n in (140, 560):
        rows = stories._described(spark.createDataFrame(items(n), "id long, t string, ts timestamp"), "t", "ts", "id", ())
        nodes = stories._nodes(rows, 36 * 3_600_000_000)
        counts.append(stories._class_pairs(nodes, nodes, (0, 1), 0.7).count())
        assert nodes.count() <= 6 * (13 * n // (36 * 60) + 2)
    assert counts[0] == counts[1] > 0
    df = spark.createDataFrame(items(560), "id long, t string, ts timestamp")
    told = df.select("id", T.cluster_key(F.coalesce("t", F.lit(""))).alias("k"), T.token_set(F.coalesce("t", F.lit(""))).alias("s"), "ts").collect()
    want, got = first_ids([(r.id, r.k, set(r.s), r.ts) for r in told]), {r.row_id: r.cluster_id for r in stories.story_clusters(df, "t", "ts", "id").collect()}
    by_want, by_got = {}, {}
    for i in got:
        by_want.setdefault(want[i], set()).add(i)
        by_got.setdefault(got[i], set()).add(i)
    assert sorted(map(sorted, by_want.values())) == sorted(map(sorted, by_got.values()))


def test_either_key_dedup_of_null_keys(spark):
    df = spark.createDataFrame([(i, None, None) for i in range(30)] + [(30, "u", None), (31, "u", None), (32, None, "t"), (33, None, "t")], "id long, u string, t string")
    assert {r.id for r in stories.either_key_dedup(df, "u", "t", "id").collect() if not r.accepted} == {31, 33}


def test_update_mode_keeps_all_keys(spark, tmp_path):
    schema, out = "key long, price double", str(tmp_path / "out")
    for rows in ([(1, 1.0), (2, 2.0)], [(1, 9.0)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in")).groupBy("key").agg(F.max("price").alias("price"))
        ticks.run_to_table(stream, out, str(tmp_path / "state"), "update")
    assert sorted(map(tuple, ticks.updated_table(spark, out, ["key"]).collect())) == [(1, 9.0), (2, 2.0)]


class Handle:
    """What a stateful processor asks of Spark."""

    def __init__(self):
        self.value, self.timers = None, []

    def getValueState(self, name, schema):
        return self

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def listTimers(self):
        return list(self.timers)

    def deleteTimer(self, t):
        self.timers.remove(t)

    def registerTimer(self, t):
        self.timers.append(t)


class Times:
    def __init__(self, now):
        self.now = now

    def getCurrentProcessingTimeInMs(self):
        return self.now


def test_timer_and_quarantine():
    import pandas as pd

    h = Handle()
    p = ticks.ChangeOrHeartbeat(timer=60)
    p.init(h)
    frame = lambda rows: iter([pd.DataFrame(rows, columns=["key", "id", "price", "at", "quarantined"])])
    told = lambda out: [tuple(r) for f in out for r in f[["id", "price", "why"]].itertuples(index=False)]
    assert told(p.handleInputRows((7,), frame([(7, 1, 10.0, 0.0, False), (7, 2, 10.0, 1.0, False), (7, 3, 99.0, 2.0, True), (7, 4, 11.0, 3.0, False)]), Times(1000))) == [(1, 10.0, "CHANGE"), (3, 99.0, "QUARANTINED"), (4, 11.0, "CHANGE")]
    assert h.timers == [61_000]
    h.timers.clear()
    assert told(p.handleExpiredTimer((7,), Times(61_000), None)) == [(4, 11.0, "TIMER")] and h.timers == [121_000]
    assert told(p.handleInputRows((7,), frame([(7, 5, 11.0, 80.0, False)]), Times(90_000))) == [] and h.timers == [150_000]


def test_snapshots_and_frames(spark):
    said, now = [], [0.0]
    s = ticks.Snapshots(lambda df: df, lambda kind, x: said.append((kind, x)), clock=lambda: now[0])
    for mark, at in (("a", 1), ("a", 2), ("b", 3), ("b", 16), (None, 17), ("b", 40)):
        now[0] = float(at)
        s(mark, 0)
    assert said == [("snapshot", "a"), ("snapshot", "b"), ("heartbeat", 16.0), ("heartbeat", 40.0)]
    rows = [("k", 1, ["1", "x", ""]), ("k", 2, ["1", "", "5", "9"]), ("k", 3, ["1", "y"])]
    got = {r.id: r.fields for r in ticks.merged_frames_batch(spark.createDataFrame(rows, "key string, id long, fields array<string>")).collect()}
    assert got == {1: ["1", "x", ""], 2: ["1", "x", "5", "9"], 3: ["1", "y", "5", "9"]}


def test_tables_of_labels(spark, tmp_path):
    """CSV articles with JSON-lines labels by cluster; reports; splits; appended CSV."""
    (tmp_path / "a.csv").write_text("cluster,title\nc1,One\nc2,\"Two, too\"\nc3,Three\n")
    (tmp_path / "b.jsonl").write_text('{"cluster": "c1", "label": "UP"}\n{"cluster": "c1", "label": "DOWN"}\n{"cluster": "c2", "label": "UP"}\nbad\n')
    a, b = io.read_csv(spark, str(tmp_path / "a.csv"), ["cluster", "title"]), io.read_json_lines(spark, str(tmp_path / "b.jsonl"), "cluster string, label string")
    both = a.join(b, "cluster")
    assert sorted(map(tuple, both.collect())) == [("c1", "One", "DOWN"), ("c1", "One", "UP"), ("c2", "Two, too", "UP")]
    assert io.write_report(both, str(tmp_path / "report")) == 3 and spark.read.json(str(tmp_path / "report")).count() == 3
    with pytest.raises(ValueError, match="2 rows"):
        io.write_report(both, str(tmp_path / "report"), most=2)
    for _ in range(2):
        io.append_csv(a, str(tmp_path / "c"))
    assert io.read_csv(spark, str(tmp_path / "c"), ["cluster"]).count() == 6
    x = spark.createDataFrame([(1,), (-1,), (None,)], "v int")
    io.split_write(x, F.col("v") > 0, str(tmp_path / "good"), str(tmp_path / "bad"))
    assert spark.read.parquet(str(tmp_path / "good")).count() == 1 and spark.read.parquet(str(tmp_path / "bad")).count() == 2


def test_single_functions(spark):
    one = spark.range(1)
    v = lambda c: one.select(c.alias("v")).first().v
    assert v(M.fine_grams(F.lit(10.0), F.lit("g"), F.lit(916.0), F.lit(2.0))) == 18.32 and v(M.fine_grams(F.lit(1.0), F.lit("KG"), F.lit(0.5), F.lit(1.0))) == 500.0
    assert v(M.holding_value(F.lit(10.0), F.lit(0.999), F.lit(100.0), F.lit(1.0))) == 1000.0
    assert v(M.worst(F.lit("FRESH"), F.lit("STALE"))) == "STALE" and v(M.worst(F.lit("DELAYED"), F.lit("LIVE"))) == "DELAYED"
    at = F.lit("2024-03-01 10:00:00").cast("timestamp")
    a, b = v(T.single_story_id(F.lit("Gold rises today"), at)), v(T.single_story_id(F.lit("today Gold rises - Mint"), at))
    assert a == b and a.startswith("clu_") and len(a) == 20
    answer = '<think>x</think>```json\n{"gold_impact": "BULLISH", "general_tone": "calm", "confidence": "HIGH", "reasoning": "r"}```'
    got = lambda s: v(rules.strict_label(F.lit(s), ["BULLISH"], ["calm"]))
    assert got(answer).reasoning == "r" and got(answer.replace("HIGH", "SURE")) is None and got("no") is None
    assert v(F.size(rules.found_phrases(F.lit("opec+ opec+x; Opec, s&p 500!"), ["opec", "opec+", "s&p 500"]))) == 3
    df = spark.createDataFrame([("b", "x"), ("c", None)], "id string, v string")
    got = ledger.merged_latest(df, spark.createDataFrame([("c", "y"), ("d", "z")], "id string, v string"), ["id"])
    assert sorted(map(tuple, got.collect())) == [("b", "x"), ("c", "y")]


def test_trees_learn(spark):
    rng = random.Random(2)
    rows = [(T0 + timedelta(hours=i), x := rng.random(), rng.random(), 3.0 * x, float(int(3 * x))) for i in range(200)]
    df = spark.createDataFrame(rows, "t timestamp, a double, b double, y double, c double")
    model, error = forecast.fit_trees(df, ["a", "b"], "y", "t", trees=10)
    assert error < 0.3
    model, accuracy = forecast.fit_classes(df, ["a", "b"], "c", "t", trees=10)
    assert accuracy > 0.9
    assert forecast.fit_trees(df.limit(40), ["a", "b"], "y", "t") is None and forecast.fit_classes(df.limit(40), ["a", "b"], "c", "t") is None
