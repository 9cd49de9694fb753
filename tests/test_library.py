"""Edge cases of the library's operators on small literal tables."""

import math
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import market as M
from tidemark.functions import products as P
from tidemark.functions import text as T
from tidemark.operators import forecast as R
from tidemark.operators import marts, rules, series, state, stories
from tidemark.operators.asof import asof_join
from tidemark.operators.intervals import interval_join
from tidemark.sources import io
from tidemark.streaming import ticks

T0 = datetime(2024, 3, 1, 12)
AT = lambda minutes, micros=0: T0 + timedelta(minutes=minutes, microseconds=micros)


def test_asof_edges(spark):
    left = spark.createDataFrame([(1, "a", AT(60)), (2, "a", AT(60, 1)), (3, "b", AT(60)), (4, "a", None), (5, "a", AT(-1))], "id int, k string, t timestamp")
    right = spark.createDataFrame([("a", AT(0), 1.0), ("a", AT(60), 2.0), ("a", AT(60), 3.0), ("a", None, 9.0)], "k string, rt timestamp, v double")
    got = {r.id: r.v for r in asof_join(left, right, ["k"], "t", "rt", ["v"], tie=["v"]).collect()}
    assert got == {1: 3.0, 2: 3.0, 3: None, 4: None, 5: None}
    assert {r.id: r.v for r in asof_join(left, right, ["k"], "t", "rt", ["v"], strict=True, tie=["v"]).collect()}[1] == 1.0
    # An age equal to the tolerance is kept, one microsecond more is not.
    back = {r.id: r.v for r in asof_join(left, right, ["k"], "t", "rt", ["v"], lookback="30 minutes", tolerance="30 minutes").collect()}
    assert back[1] == 1.0 and back[2] is None
    assert asof_join(left, right, ["k"], "t", "rt", ["v"], how="inner").count() == 2
    assert asof_join(left.drop("k"), right.drop("k"), [], "t", "rt", ["v"]).count() == 5


def test_asof_in_stretches_of_time(spark):
    rng = random.Random(8)
    left = spark.createDataFrame([(i, rng.choice("ab"), AT(rng.randrange(5000))) for i in range(200)] + [(999, "a", None)], "id int, k string, t timestamp")
    right = spark.createDataFrame([(rng.choice("ab"), AT(rng.randrange(5000)), float(i)) for i in range(60)], "k string, rt timestamp, v double")
    for keys, more in ((["k"], {}), ([], {}), (["k"], {"strict": True}), (["k"], {"lookback": "3 hours", "tolerance": "5 hours"})):
        a, b = (left, right) if keys else (left.drop("k"), right.drop("k"))
        whole, cut = ({r.id: r.v for r in asof_join(a, b, keys, "t", "rt", ["v"], tie=["v"], chunk_seconds=c, **more).collect()} for c in (None, 3600))
        assert whole == cut


def test_interval_edges(spark):
    at = spark.createDataFrame([(1, AT(0))], "id int, t timestamp")
    items = spark.createDataFrame([(AT(0),), (AT(-60),), (AT(-60, -1),), (AT(0, 1),)], "s timestamp")
    both = interval_join(at, items, [], "t", "s", 3600)
    assert sorted(r.s for r in both.collect()) == [AT(-60), AT(0)]
    assert [r.s for r in interval_join(at, items, [], "t", "s", 3600, closed_end=False).collect()] == [AT(-60)]


def test_revision_chain(spark):
    df = spark.createDataFrame([(1, "p", AT(1), 100.0), (2, "p", AT(2), 100.0), (3, "p", AT(3), 101.0)], "id int, p string, seen timestamp, v double")
    chain = series.revision_chain(df, ["p"], ["seen"], "v", "id")
    assert [(r.id, r.revision_number, r.supersedes, r.kind) for r in chain.orderBy("id").collect()] == [(1, 1, None, "ORIGINAL"), (3, 2, 1, "CORRECTION")]
    view = lambda m: series.revisions_asof(chain, ["p"], "seen", "revision_number", "v", F.lit(AT(m))).first()
    assert (view(2).value, view(2).available_at) == (100.0, AT(1)) and (view(3).value, view(3).first_arrival, view(3).available_at) == (101.0, AT(1), AT(3))


def test_sequence_audit_statuses(spark):
    rows = [(1, False, "x", False), (2, False, "x", False), (3, True, "a", False), (4, False, "y", True), (5, True, "a", False), (6, True, "b", True)]
    df = spark.createDataFrame(rows, "id int, explicit boolean, sig string, sunday boolean").withColumn("k", F.lit(1))
    out = series.sequence_audit(df, ["k"], ["id"], F.col("explicit"), F.col("sig"), F.col("sunday"), F.lit(False)).orderBy("id").collect()
    assert [r.status for r in out] == ["INFERRED", "STALE_CARRYOVER", "VALID", "UNCERTAIN", "DUPLICATE_POLL", "STALE_CARRYOVER"]
    assert [r.sequence_index for r in out] == [0, -1, 1, -1, -1, -1]


def test_clock_only_times(spark):
    cases = [("2024-03-02 00:10:00", 1430, "PREVIOUS_DAY"), ("2024-03-02 10:00:00", 605, "AMBIGUOUS"), ("2024-03-02 06:30:00", 575, "CARRYOVER_CANDIDATE"), ("2024-03-02 10:00:00", 600, "SAME_DAY"), ("2024-03-02 10:00:00", None, "MISSING")]
    df = spark.createDataFrame(cases, "now string, clock int, want string").withColumn("r", M.resolve_clock(F.col("now").cast("timestamp"), F.col("clock")))
    for r in df.collect():
        assert r.r.status == r.want and (r.r.at is None) == (r.want in ("AMBIGUOUS", "MISSING"))
    text = spark.createDataFrame([("Time : 09:29 am",), ("12:05 PM",), ("none",)], "t string").select(M.clock_minutes(F.col("t")).alias("m"), M.precision(F.col("t")).alias("p")).collect()
    assert [(r.m, r.p) for r in text] == [(569, "CLOCK_ONLY"), (725, "CLOCK_ONLY"), (None, None)]


def test_numbers_and_times(spark):
    df = spark.createDataFrame([("Rs 1,234.50/-",), ("-5",), ("--",), ("",), (None,), ("0",)], "t string")
    assert [r[0] for r in df.select(M.number(F.col("t"))).collect()] == [1234.5, None, None, None, None, None]
    iso = spark.createDataFrame([("2024-01-02T03:04:05Z",), ("2024-01-02 03:04:05",), ("nan",), ("",)], "t string")
    assert [r[0] for r in iso.select(M.iso_time(F.col("t"))).collect()] == [datetime(2024, 1, 2, 3, 4, 5)] * 2 + [None, None]


def test_validation_order(spark):
    specs = {"GOLD_10G": M.Spec("gold", "INR", 5_000, 50_000), "GOLD_100G_999": M.Spec("gold", "INR", 5_000, 50_000), "XAU": M.Spec("gold", "USD", 1_000, 10_000, per_gram=False)}
    rows = [
        (None, "1", "GOLD_10G", "gold", "INR", 10.0, None, "QUARANTINED"), (0.0, "1", "GOLD_10G", "gold", "INR", 10.0, None, "QUARANTINED"), (51.0, "51", "GOLD_10G", "gold", "INR", 10.0, None, "QUARANTINED"),
        (100.0, "1", "GOLD_100G_999", "gold", "INR", 100.0, None, "QUARANTINED"), (70_000.0, "1", "OTHER", "gold", "INR", 10.0, None, "SUSPECT"), (70_000.0, "1", "GOLD_10G", "silver", "INR", 10.0, None, "QUARANTINED"),
        (70_000.0, "1", "GOLD_10G", "gold", "USD", 10.0, None, "QUARANTINED"), (40_000.0, "1", "GOLD_10G", "gold", "INR", 10.0, None, "QUARANTINED"), (70_000.0, "1", "GOLD_10G", "gold", "INR", 10.0, 50_000.0, "SUSPECT"),
        (60_000.0, "1", "GOLD_10G", "gold", "INR", 10.0, 50_000.0, "VALID"), (2_000.0, "1", "XAU", "gold", "USD", 31.1, 1_000.0, "VALID"),
    ]
    df = spark.createDataFrame(rows, "price double, sid string, product string, metal string, currency string, g double, prev double, want string")
    v = M.validate(F.col("price"), F.col("sid"), F.col("product"), F.col("metal"), F.col("currency"), F.col("g"), F.col("prev"), specs, artifact={"GOLD_100G_999": 100.0})
    for r in df.withColumn("v", v).collect():
        assert r.v.status == r.want, r


HEADLINES = [
    ("Fed cuts rates by 25 bps as widely expected", "NEUTRAL", "FED_POLICY"), ("Fed officials push back against rate cut expectations", "BEARISH", "FED_POLICY"), ("Fed surprises markets with 50 bps cut", "BULLISH", "FED_POLICY"),
    ("Fed holds rates, signals no cuts this year", "BEARISH", "FED_POLICY"), ("Powell says Fed will not cut rates soon", "BEARISH", "FED_POLICY"), ("ECB cuts interest rates", "UNKNOWN", "OTHER_MACRO"), ("BoJ raises rates for first time in 17 years", "UNKNOWN", "OTHER_MACRO"),
    ("Gold price today in India: RBI hikes repo rate by 25 bps", "BEARISH", "INR"), ("Gold price today in India: rupee hits record low", "BULLISH", "INR"), ("Gold rate today: check 22k and 24k prices in Chennai, Mumbai", "NEUTRAL", "GOLD_PRICE_REPORT"),
    ("Traders pare back Fed rate hike bets", "BULLISH", "FED_POLICY"), ("Powell: rate cuts not on the table", "BEARISH", "FED_POLICY"), ("Fed holds rates steady as expected", "NEUTRAL", "FED_POLICY"), ("ECB cuts rates; Fed seen holding", "UNKNOWN", "OTHER_MACRO"),
    ("Gold hits record high on safe-haven demand", "BULLISH", "GEOPOLITICS"), ("Gold fails to rally despite weak dollar", "UNKNOWN", "USD"), ("Weak dollar and rising treasury yields", "MIXED", "USD"), ("Crude steadies", "UNKNOWN", "INFLATION"), ("Local bakery opens", "UNKNOWN", "UNKNOWN"), (None, "UNKNOWN", "UNKNOWN"),
]


def test_impact_of_headlines(spark):
    rows = rules.impact(spark.createDataFrame(HEADLINES, "title string, want string, by string"), "title").collect()
    assert [(r.title, r.direction, r.driver) for r in rows] == [tuple(h) for h in HEADLINES]


def test_relevance(spark):
    cases = [("MCX gold falls as rupee slips", "INDIA_FX", True), ("Golden Globe for best movie", "OTHER", False), ("Fed minutes due", "US_FED_MONETARY_POLICY", False), ("Silver price steady", "PRECIOUS_METALS", True), ("Nothing at all", "OTHER", False)]
    rows = rules.relevance(spark.createDataFrame(cases, "title string, want string, relevant boolean"), "title").collect()
    assert [(r.title, r.primary_category, r.is_relevant) for r in rows] == cases
    assert rows[0].scores == {"INDIA_FX": 0.8, "INDIA_BULLION": 0.7, "GOLD_DIRECT": 0.7} and rows[0].supporting_categories == ["INDIA_BULLION", "GOLD_DIRECT"] and rows[0].relevance_score == 0.7


def test_merging_headlines(spark):
    pairs = [
        ("Gold steadies ahead of US CPI data", "Gold steadies ahead of US PPI data", False), ("Gold rate today in Chennai: 22 carat at Rs 7,250", "Gold rate today in Chennai: 22 carat at Rs 7,300", False), ("Gold rises as dollar weakens", "Gold falls as dollar weakens", False),
        ("Gold rises as dollar weakens - Reuters", "Gold rises as dollar weakens - Mint", True), ("Gold rises as dollar weakens after Fed", "Gold climbs as dollar weakens after Fed", True),
    ]
    df = spark.createDataFrame(pairs, "a string, b string, want boolean")
    m = T.should_merge(T.cluster_key(F.col("a")), T.cluster_key(F.col("b")), T.token_set(F.col("a")), T.token_set(F.col("b")))
    assert all(r.m.merge == r.want for r in df.withColumn("m", m).collect())
    items = [(i, t, AT(60 * i)) for i, t in enumerate(x for a, b, _ in pairs for x in (a, b))]
    got = {r.row_id: r.cluster_id for r in stories.story_clusters(spark.createDataFrame(items, "id long, t string, ts timestamp"), "t", "ts", "id").collect()}
    assert [got[2 * i] == got[2 * i + 1] for i in range(len(pairs))] == [w for *_, w in pairs]
    late = spark.createDataFrame([(1, "Gold steadies on quiet day", AT(0)), (2, "Gold steadies on quiet day", AT(60 * 40))], "id long, t string, ts timestamp")
    two = {r.row_id: r for r in stories.story_clusters(late, "t", "ts", "id").collect()}
    assert two[1].cluster_id != two[2].cluster_id and two[2].is_recurring and not two[1].is_recurring


def test_either_key_dedup_against_a_pass_in_order(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice([None, *"abcdefgh"]), rng.choice([None, *"uvwxyz"])) for i in range(60)]
    urls, titles, want = set(), set(), {}
    for i, u, t in rows:
        want[i] = not (u in urls or t in titles)
        if want[i]:
            urls |= {u} - {None}
            titles |= {t} - {None}
    got = stories.either_key_dedup(spark.createDataFrame(rows, "id long, u string, t string"), "u", "t", "id").collect()
    assert {r.id: r.accepted for r in got} == want


def test_urls_and_languages(spark):
    df = spark.createDataFrame([("HTTPS://Ex.com/a/?b=2&utm_source=x&a=1&c=#f",), ("http://x.org",), ("",), (None,)], "u string")
    assert [r[0] for r in df.select(T.canonical_url(F.col("u"))).collect()] == ["https://ex.com/a?a=1&b=2", "http://x.org", "", None]
    langs = spark.createDataFrame([("English",), (" FR ",), ("klingon of the very long kind",), (None,), ("",)], "l string")
    assert [r[0] for r in langs.select(T.language_code(F.col("l"))).collect()] == ["en", "fr", "klingon of the v", "unknown", "unknown"]


def ridge(xs, ys, now, alpha=5.0):
    x, y = np.array(xs, float), np.array(ys, float)
    mean, sd = x.mean(0), x.std(0)
    ok = sd > 1e-12
    z = np.where(ok, (x - mean) / np.where(ok, sd, 1), 0)
    w = np.linalg.solve(z.T @ z + alpha * np.eye(x.shape[1]), z.T @ (y - y.mean()))
    out = float(np.clip(y.mean() + np.where(ok, (now - mean) / np.where(ok, sd, 1), 0) @ w, -0.1, 0.1))
    scale = max(0.004, np.std(y - y.mean() - z @ w, ddof=1))
    return out, float(np.clip(1 / (1 + math.exp(-np.clip(out / scale, -12, 12))), 0.05, 0.95))


def test_ridge_against_refits(spark):
    rng = np.random.default_rng(2)
    n, h = 40, 2
    x = np.column_stack([rng.standard_normal((n, 2)), np.full(n, 3.0)])
    y = 0.02 * x[:, 0] + 0.01 * rng.standard_normal(n)
    rows = [(i, *map(float, x[i]), float(y[i]) if i < n - h else None) for i in range(n)]
    df = spark.createDataFrame(rows, "i int, a double, b double, c double, y double").withColumn("k", F.lit(1))
    w = series.ordered(["k"], ["i"])
    got = {r.i: r for r in R.ridge_many(df, w, ["a", "b", "c"], "y", h).collect()}
    one = {r.i: r for r in R.ridge_one(df, w, "a", "y", h).collect()}
    for i in range(n):
        train = [j for j in range(5, i - h + 1)]
        assert got[i].n_train == len(train)
        if len(train) < 10:
            assert got[i].prediction is None and one[i].prediction is None
        else:
            p, up = ridge(x[train], y[train], x[i])
            assert got[i].prediction == pytest.approx(p, abs=1e-9) and got[i].up_score == pytest.approx(up, abs=1e-7)
            assert np.clip(one[i].prediction, -0.1, 0.1) == pytest.approx(ridge(x[train][:, :1], y[train], x[i, :1])[0], abs=1e-9)


def test_diebold_mariano_gates(spark):
    a = [1e-4 + (i % 3) * 2e-5 for i in range(25)]
    b = [3e-4 + ((i + 1) % 3) * 3e-5 for i in range(25)]
    groups = {"ok": (a, b), "few": (a[:2], b[:2]), "nan": ([math.nan, *a[1:]], b), "same": (a, a), "constant": (a, [v + 1.0 for v in a])}
    rows = [(k, i, float(u), float(v)) for k, (x, y) in groups.items() for i, (u, v) in enumerate(zip(x, y))]
    out = {r.k: r for r in R.with_p_values(R.diebold_mariano(spark.createDataFrame(rows, "k string, i int, a double, b double"), ["k"], ["i"], "a", "b")).collect()}
    assert {k: r.status for k, r in out.items()} == {"ok": "COMPUTED", "few": "INSUFFICIENT_SAMPLE", "nan": "NOT_FINITE", "same": "IDENTICAL", "constant": "CONSTANT"}
    assert out["ok"].statistic < 0 and 0 <= out["ok"].p_value < 0.05 and out["same"].p_value is None
    assert R.t_two_sided(2.0, 24) == pytest.approx(0.056939, abs=1e-6) and R.t_two_sided(0.0, 5) == 1.0


def test_portfolio_alerts_and_consensus(spark):
    held = spark.createDataFrame([("gold", 10.0, 500.0), ("gold", 5.0, None), ("silver", 7.0, None), ("tin", 1.0, 3.0)], "metal string, grams double, cost double")
    rates = spark.createDataFrame([("gold", 100.0), ("silver", 1.0)], "metal string, rate double")
    out = {r.metal: r for r in marts.portfolio(held, rates).collect()}
    assert (out["gold"].value, out["gold"].pnl) == (1500.0, 1000.0) and out["silver"].pnl is None
    assert out["tin"].value == 0.0 and not out["tin"].valuation_available and out["tin"].pnl is None
    rules_ = spark.createDataFrame([("PRICE_ABOVE", 100.0), ("PRICE_BELOW", 100.0), ("DAILY_CHANGE_PCT", 2.0), ("PREMIUM_BELOW", 9.0), ("PREMIUM_ABOVE", 1.0)], "kind string, threshold double")
    now = spark.createDataFrame([(100.0, None, -2.0)], "price double, premium double, change_pct double")
    assert {r.kind: r.triggered for r in marts.alerts(rules_, now).collect()} == {"PRICE_ABOVE": True, "PRICE_BELOW": True, "DAILY_CHANGE_PCT": True, "PREMIUM_BELOW": False, "PREMIUM_ABOVE": False}
    news = spark.createDataFrame([("x", "BULLISH", 1.0), ("x", "BULLISH", 0.5), ("x", "NEUTRAL", 0.2), ("y", "BEARISH", 1.0)], "g string, d string, w double")
    assert {r.g: (r.signal, r.confidence) for r in marts.consensus(news, ["g"], "d", "w").collect()} == {"x": ("BULLISH", "MEDIUM"), "y": ("INSUFFICIENT_NEWS", "LOW")}


def test_diff_and_guards(spark):
    a = spark.createDataFrame([(1, None), (2, 5), (3, 1)], "k int, v int")
    b = spark.createDataFrame([(1, None), (2, None), (4, 1)], "k int, v int")
    assert {r.k: r.diff for r in state.rows_diff(a, b, ["k"]).collect()} == {2: "CHANGED", 3: "REMOVED", 4: "ADDED"}
    assert {r.k for r in io.metadata_differences(a, b, ["k"]).collect()} == {2, 4}
    assert {r.k for r in state.new_rows(b, a, ["k"]).collect()} == {4}


def test_files(spark, tmp_path):
    (tmp_path / "x.csv").write_text("a,b\n1,2024-01-01\nx,\n")
    assert [tuple(r) for r in io.read_csv(spark, str(tmp_path / "x.csv"), ["a", "b"], {"a": "int"}).collect()] == [(1, "2024-01-01"), (None, None)]
    with pytest.raises(ValueError, match="lacks columns: c, d"):
        io.read_csv(spark, str(tmp_path / "x.csv"), ["d", "c"])
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n\nbroken\n{"a": 2}\n')
    assert [r.a for r in io.read_json_lines(spark, str(tmp_path / "x.jsonl"), "a int").collect()] == [1, 2]
    df, path = spark.createDataFrame([(1, "x"), (1, "y"), (2, "z")], "k int, v string"), str(tmp_path / "t")
    for _ in range(2):
        io.append_new(df, path, ["k"])
    assert spark.read.parquet(path).count() == 2
    assert io.first_existing(spark, [str(tmp_path / "none"), path]) == path


def test_stream_agrees_with_batch(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ticks.ROCKS)
    rng = random.Random(3)
    rows = [(rng.randrange(4), i, float(rng.randrange(3)), float(i)) for i in range(300)]
    df = spark.createDataFrame(rows, "key long, id long, price double, at double")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    for heartbeat in (None, 7.0):
        out = str(tmp_path / f"out{heartbeat}")
        ticks.run_to_table(ticks.change_filter(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), heartbeat=heartbeat), out, out + "-state")
        assert sorted(r.id for r in spark.read.parquet(out).collect()) == sorted(r.id for r in ticks.change_filter_batch(df, heartbeat=heartbeat).collect())


def test_ticks(spark):
    lines = ["3\t48\t-\t-\t14504.50", "1\tSPOT-GOLD\tGOLD($)\t4,043.1\t4043.6\t1\t2", "3|51|10.5|1200000", "2|GOLDDEC|5|-", "9\tx\t1", "3\t48\t-\t12\t-", "", "ping", '4\t4\t-\t1\t0\t\t"11/11/2026 02:06:21 PM"', "4|x|0|1"]
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    got = ticks.parse_ticks(df).select("record_type", "symbol", "name", "bid", "ask", "price").collect()
    assert [tuple(r) for r in got] == [("3", "48", None, None, 14504.5, 14504.5), ("1", "SPOT-GOLD", "GOLD($)", 4043.1, 4043.6, 4043.6), ("3", "51", None, 10.5, 1200000.0, 1200000.0), ("2", "GOLDDEC", None, 5.0, None, 5.0)]
    named = {r.symbol: r for r in P.with_products(ticks.parse_ticks(df)).collect()}
    assert (named["48"].city, named["48"].unit, named["51"].unit, named["51"].weight, named["GOLDDEC"].weight) == ("CHENNAI", "1g", "100g", 100.0, 10.0)
    assert [tuple(r) for r in ticks.parse_status(df).collect()] == [(True, "OPEN", "11/11/2026 02:06:21 PM"), (False, "CLOSED", None)]
    frames = spark.createDataFrame([("a", 1, "x", 1.0), ("a", 2, "", None), ("a", 3, "y", 2.0)], "k string, i int, s string, v double")
    assert [(r.s, r.v) for r in ticks.merge_partial(frames, ["k"], ["i"], ["s", "v"]).orderBy("i").collect()] == [("x", 1.0), ("x", 1.0), ("y", 2.0)]


def test_products_and_sources(spark):
    names = spark.createDataFrame([("Gold 100 GMS 999 Bangalore", 9e3), ("SILVER 1 KG 999", 9e4), ("GOLD 1KG 99.99", 7e6), ("MJDTA gold", 1e4)], "n string, p double")
    got = [tuple(r.r)[:2] + (r.r.weight, r.r.unit, r.r.rate_type) for r in names.select(P.from_name(F.col("n"), F.col("p")).alias("r")).collect()]
    assert got == [("BENGALURU", "GOLD_100G_999", 1.0, "1g", "RETAIL"), ("ALL_INDIA", "SILVER_1KG_999", 1.0, "1kg", "RETAIL"), ("ALL_INDIA", "GOLD_1KG_9999", 1.0, "1kg", "WHOLESALE"), ("ALL_INDIA", "MJDTA_GOLD_24K", 1.0, "1g", "MJDTA_BENCHMARK")]
    ids = spark.createDataFrame([("48", "chennai ", "GOLD_100G_999"), ("47", "ALL_INDIA", "GOLD_1KG_9999"), ("48", "MUMBAI", "GOLD_100G_999"), (None, "CHENNAI", "GOLD_100G_999")], "i string, c string, p string")
    assert [r[0] for r in ids.select(P.is_transient(F.col("i"), F.col("c"), F.col("p"))).collect()] == [True, False, False, False]
    urls = spark.createDataFrame([("https://www.reuters.com/markets/gold-rises-2026-01-02", ""), ("https://www.reuters.com/markets/gold-12345-2026-01-02", ""), ("https://x.org/a-2026-01-02", "FT.com"), ("https://x.org/a-2026-01-02", ""), (None, None)], "u string, s string")
    assert [r[0] for r in urls.select(P.is_made_up(F.col("u"), F.col("s"))).collect()] == [True, False, True, False, False]
    times = spark.createDataFrame([("20261110T083000Z", "Tue, 10 Nov 2026 14:00:00 +0530"), ("2026", "10 Nov 2026 08:30:00 GMT"), (None, "soon")], "a string, b string")
    t = datetime(2026, 11, 10, 8, 30)
    assert [tuple(r) for r in times.select(P.compact_time(F.col("a")), P.mail_time(F.col("b"))).collect()] == [(t, t), (None, t), (None, None)]
    assert [r[0] for r in spark.createDataFrame([("blr",), (" Madras",), ("Pune",)], "c string").select(P.city_code(F.col("c"))).collect()] == ["BENGALURU", "CHENNAI", "PUNE"]
