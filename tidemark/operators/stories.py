"""News items: dedup by either of two keys, story clusters, labels of clusters, samples."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators.asof import asof_join
from tidemark.sources.io import materialised

#: Words of a cluster key up to which its parts are listed: a key of tokens has no more.
KEY_WORDS = 6


def either_key_dedup(df: DataFrame, first_key: str, second_key: str, order: str) -> DataFrame:
    """Adds accepted: no earlier accepted row has the same first or second key.

    Rows that are first among the undecided in both keys are accepted, what shares a key with
    them is refused, and so on: the outcome of a pass in order, without one. A null key is
    shared with no row; `order` must be unique.
    """
    work = materialised(df.select(F.col(order).alias("_o"), F.col(first_key).alias("_a"), F.col(second_key).alias("_b")))
    decided = None
    while not work.isEmpty():
        def firsts(key: str) -> DataFrame:
            """The first row of each key: a sum combined map-side, and rows without a key take no part."""
            return work.where(F.col(key).isNotNull()).groupBy(F.col(key).alias(f"_key{key}")).agg(F.min("_o").alias(f"_min{key}"))

        ready = work
        for key in ("_a", "_b"):
            ready = ready.join(firsts(key), F.col(key) == F.col(f"_key{key}"), "left").drop(f"_key{key}")
        own = F.lit(True)
        for key in ("_a", "_b"):
            own = own & F.coalesce(F.col(f"_min{key}") == F.col("_o"), F.lit(True))
        ready = materialised(ready.select("_o", "_a", "_b", own.alias("_accepted")))
        won = ready.where("_accepted")
        done = won.select("_o")
        decided = done if decided is None else materialised(decided.unionByName(done))
        left = ready.where("not _accepted").select("_o", "_a", "_b")
        left = left.join(won.where("_a IS NOT NULL").select("_a"), "_a", "left_anti").join(won.where("_b IS NOT NULL").select("_b"), "_b", "left_anti")
        work = materialised(left.select("_o", "_a", "_b"))
    if decided is None:
        return df.withColumn("accepted", F.lit(True))
    return df.join(decided.withColumn("accepted", F.lit(True)), F.col(order) == F.col("_o"), "left").drop("_o").withColumn("accepted", F.coalesce("accepted", F.lit(False)))


def _described(df: DataFrame, title: str, ts: str, row_id: str, block: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Items with the class of their headline, all that decides what it merges with, and columns to keep.

    Two headlines conflict unless they have the same tokens that tell events apart and no opposite
    directions, and merge by their keys. So items of one block, key, set of telling tokens and
    direction stand for each other, however many there are and whatever else they say.
    """
    # In steps, so that a text is cut into words once, however many columns are made of them. Only stems and keys without words need it squeezed.
    t = df.select(F.col(row_id).alias("row_id"), F.unix_micros(F.col(ts).cast("timestamp")).alias("at"), *[F.col(c).alias(f"_b{i}") for i, c in enumerate(block)], *keep, T.loose_headline(F.coalesce(F.col(title), F.lit(""))).alias("loose"))
    t = t.withColumn("words", T.tokens(F.col("loose")))
    t = t.withColumn("normal", T.squeezed(F.col("loose")))
    t = t.select("row_id", "at", *[f"_b{i}" for i in range(len(block))], *keep, T.key_of("words", T.squeezed(F.col("loose"))).alias("key"), T.stem_of("normal").alias("stem"), "words")
    tells, way = T.telling(F.col("words"))
    near = F.xxhash64(*[x for i in range(len(block)) for x in (F.col(f"_b{i}").isNull(), F.col(f"_b{i}"))], tells)
    signature = F.array_join(F.sort_array(F.array_distinct("words")), " ")
    rows = t.select("row_id", "at", *keep, "key", near.alias("near"), way.alias("way"), (F.size("words") == 0).alias("bare"), signature.alias("signature"), "stem")
    whole = ["near", "key", "way"]
    return rows.withColumn("cls", F.concat_ws("-", F.xxhash64(*whole), F.xxhash64(F.lit(1), *whole)))


def _nodes(rows: DataFrame, span: int) -> DataFrame:
    """One row for each class and bucket of `span` microseconds that has items."""
    return rows.groupBy("cls", F.floor(F.col("at") / span).alias("bucket")).agg(F.first("key").alias("key"), F.first("near").alias("near"), F.first("way").alias("way"))


def _probes(nodes: DataFrame, counts: DataFrame, least: float) -> DataFrame:
    """Classes by bucket, a row for each probe: two whose keys are alike enough share one.

    Token sets of that similarity share one of the rarest n - ceil(least n) + 1 tokens of each.
    Keys without such tokens probe as they are.
    """
    classes = nodes.select("cls", "key").distinct()
    one = classes.select("cls", F.explode(T.key_set(F.col("key"))).alias("token")).join(counts, "token")
    rare = one.groupBy("cls").agg(F.array_sort(F.collect_list(F.struct("n", "token"))).alias("t"))
    n = F.size("t")
    some = F.transform(F.slice("t", 1, n - F.ceil(n * least - 1e-9).cast("int") + 1), lambda x: x["token"])
    rare = rare.select(F.col("cls").alias("_of"), F.posexplode(some).alias("place", "probe"), n.alias("size"))
    # Equal keys meet by themselves, as the similarity of keys without long tokens is none.
    whole = classes.select(F.col("cls").alias("_of"), F.lit(-1).alias("place"), F.concat(F.lit("="), F.col("key")).alias("probe"), F.lit(0).alias("size"))
    return nodes.join(rare.unionByName(whole), F.col("cls") == F.col("_of")).drop("_of")


def _class_pairs(old: DataFrame, new: DataFrame, shifts: Sequence[int], least: float) -> DataFrame:
    """a, b, score: other classes a that items of class b may merge with, where some of each lie in buckets `shifts` apart.

    Candidates share a probe, what tells events apart, and a bucket; sizes must allow the similarity, and
    so must the tokens left behind the probe. Equal headlines are one class, so none of their pairs arises.
    """
    counts = old.select("cls", "key").unionByName(new.select("cls", "key")).distinct().select(F.explode(T.key_set(F.col("key"))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    names = ("cls", "key", "way", "size", "place", "bucket", "near", "probe")
    a = _probes(old, counts, least).select(*[F.col(c).alias(f"a_{c}") for c in names])
    b = _probes(new, counts, least).select(*[F.col(c).alias(f"b_{c}") for c in names if c != "bucket"], F.explode(F.array(*[F.col("bucket") - k for k in shifts])).alias("b_bucket"))
    met = a.join(b, (F.col("a_near") == F.col("b_near")) & (F.col("a_probe") == F.col("b_probe")) & (F.col("a_bucket") == F.col("b_bucket")))
    met = met.where((F.col("a_cls") != F.col("b_cls")) & (F.col("a_way") * F.col("b_way") >= 0))
    small, large = F.least("a_size", "b_size"), F.greatest("a_size", "b_size")
    left = F.least(F.col("a_size") - F.col("a_place"), F.col("b_size") - F.col("b_place"))  # tokens from the shared one on
    fits = (small >= least * large - 1e-9) & (left >= least / (1 + least) * (F.col("a_size") + F.col("b_size")) - F.least("a_place", "b_place") - 1e-9)
    met = met.where((F.col("a_place") < 0) | fits).select("a_cls", "b_cls", "a_key", "b_key").distinct()
    score = F.when(F.col("a_key") == F.col("b_key"), 1.0).otherwise(T.jaccard(T.key_set(F.col("a_key")), T.key_set(F.col("b_key"))))
    return met.select(F.col("a_cls").alias("a"), F.col("b_cls").alias("b"), score.alias("score")).where(F.col("score") >= least)


def _alone(rows: DataFrame, span: int) -> DataFrame:
    """The items that open a story among those of their own class: each first one beyond the span of the opening before.

    Narrow rows are sorted by class and time and streamed; a class is one task's, but none is held.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, opened = None, 0
        for b in batches:
            keep = []
            for i, (cls, at) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist())):
                if cls != now or at - opened > span:
                    now, opened = cls, at
                    keep.append(i)
            yield b.take(pa.array(keep, pa.int64()))

    dealt = rows.select("cls", "at", "row_id").repartition("cls").sortWithinPartitions("cls", "at", "row_id")
    return dealt.mapInArrow(run, dealt.schema)


def story_clusters(df: DataFrame, title: str, ts: str, row_id: str, hours: float = 36, least: float = 0.70, version: str = "v1", block: Sequence[str] = ()) -> DataFrame:
    """row id, cluster_id, is_recurring: each item joins the best earlier story that opened at most
    `hours` before it and that it should merge with; ties go to the latest.

    A story's origin never moves, so an item opens one exactly when none that it could join did.
    Items of one class that lie within a bucket of `hours` are one node, which opens one story at most. Classes
    that merge with no other are decided by themselves in one pass. The others are decided in rounds over
    the nodes: a node's first undecided item opens when no partner has an undecided one before it, and
    takes in what it reaches. Rounds grow with the longest chain of such nodes. An item whose stem equals
    that of a story outside the span is a recurring bulletin. Items of different `block` columns (language,
    say) never meet. Null titles count as blank, and blank ones are one class. Row ids are unique.
    """
    span = int(hours * 3_600_000_000)
    rows = materialised(_described(df, title, ts, row_id, block))
    pairs = materialised(_class_pairs(_nodes(rows, span), _nodes(rows, span), (0, 1), least))
    own = rows.select("row_id", "at", "cls", F.floor(F.col("at") / span).alias("bucket"))
    linked = pairs.select(F.col("a").alias("cls")).union(pairs.select("b")).distinct()
    opened = materialised(_alone(own.join(linked, "cls", "left_anti"), span))
    undecided = materialised(own.join(linked, "cls", "left_semi"))
    # Which class's stories an item of a class can join: its own, and its partners'.
    both = pairs.unionByName(rows.select(F.col("cls").alias("a"), F.col("cls").alias("b"), F.lit(1.0).alias("score")).distinct())
    edges = both.select(F.col("a").alias("from"), F.col("b").alias("to"))
    while not undecided.isEmpty():
        item = F.struct("at", "row_id")
        nodes = undecided.groupBy("cls", "bucket").agg(F.min(item).alias("first"), F.max("at").alias("last"))
        reach = F.explode(F.array("bucket", F.col("bucket") + 1))
        before = nodes.select(F.col("cls").alias("from"), F.col("first").alias("its"), F.col("last").alias("its_last"), reach.alias("to_bucket")).join(edges, "from")
        waits = nodes.join(before, (F.col("cls") == F.col("to")) & (F.col("bucket") == F.col("to_bucket"))).where((F.col("its") < F.col("first")) & (F.col("its_last") >= F.col("first.at") - span))
        waits = waits.select("cls", "bucket").distinct()
        new = materialised(nodes.join(waits, ["cls", "bucket"], "left_anti").select("cls", F.col("first.at").alias("at"), F.col("first.row_id").alias("row_id")))
        opened = opened.unionByName(new)
        story = new.select(F.col("cls").alias("from"), F.floor(F.col("at") / span).alias("from_bucket"), F.struct("at", "row_id").alias("its"))
        story = story.join(edges, "from").select(F.col("to"), "its", F.explode(F.array("from_bucket", F.col("from_bucket") + 1)).alias("to_bucket"))
        taken = undecided.join(story, (F.col("cls") == F.col("to")) & (F.col("bucket") == F.col("to_bucket"))).where((F.struct("at", "row_id") >= F.col("its")) & (F.col("at") - F.col("its.at") <= span))
        undecided = materialised(undecided.join(taken.select("row_id").distinct(), "row_id", "left_anti"))
    opened = materialised(opened)
    story = opened.select(F.col("cls").alias("a"), F.col("at").alias("its_at"), F.col("row_id").alias("its"), F.floor(F.col("at") / span).alias("its_bucket"))
    story = story.join(both, "a").select(F.col("b").alias("to"), "score", "its_at", "its", F.explode(F.array("its_bucket", F.col("its_bucket") + 1)).alias("to_bucket"))
    rest = own.join(opened.select("row_id"), "row_id", "left_anti")
    met = rest.join(story, (F.col("cls") == F.col("to")) & (F.col("bucket") == F.col("to_bucket"))).where((F.struct("its_at", "its") < F.struct("at", "row_id")) & (F.col("at") - F.col("its_at") <= span))
    best = met.groupBy("row_id").agg(F.max_by("its", F.struct("score", "its_at", "its")).alias("first_id"))
    joined = best.unionByName(opened.select("row_id", F.col("row_id").alias("first_id")))
    first = rows.select(F.col("row_id").alias("first_id"), F.col("signature").alias("first_signature"), F.floor(F.col("at") / 86_400_000_000).alias("day"))
    # Openings of the same wording on one day get a number.
    opening = opened.select(F.col("row_id").alias("first_id")).join(first, "first_id").withColumn("nth", F.row_number().over(Window.partitionBy("first_signature", "day").orderBy("first_id")))
    opening = opening.withColumn("cluster_id", F.concat(F.lit("clu2_"), T.joined_hash(F.lit(version), F.concat(F.lit("d"), "day"), F.col("first_signature"), F.when(F.col("nth") > 1, F.col("nth")), length=16)))
    # A stem recurs where its earliest item lies further back than the span: a minimum, combined map-side.
    stems = rows.where("stem <> ''").groupBy(F.col("stem").alias("_stem")).agg(F.min("at").alias("_since"))
    named = joined.join(rows.select("row_id", "at", "stem"), "row_id").join(stems, F.col("stem") == F.col("_stem"), "left")
    recurring = F.coalesce(F.col("_since") < F.col("at") - span, F.lit(False))
    return named.withColumn("is_recurring", recurring).join(opening.select("first_id", "cluster_id"), "first_id").select("row_id", "cluster_id", "is_recurring")


def _alike(least: float) -> tuple[list[list[tuple]], list[list[tuple]]]:
    """Which parts keys alike enough share, by the number of a key's words from 0 to KEY_WORDS.

    First for stored keys: a part that another key may share, and the number of words. Then for keys that look: a part of
    theirs, a number of words that a stored key with that part may have, and how alike the two are if they share
    no more. A part is the places of its words in order of spelling.
    """
    stored, looks = [[((0,), 0)]], [[((0,), 0, 1.0)]]
    for n in range(1, KEY_WORDS + 1):
        parts = [p for i in range(1, n + 1) for p in combinations(range(n), i)]
        stored.append([(p, n) for p in parts if len(p) / n >= least])
        looks.append([(p, m, len(p) / (n + m - len(p))) for p in parts for m in range(len(p), KEY_WORDS + 1) if len(p) / (n + m - len(p)) >= least])
    return stored, looks


def _parted(rows: DataFrame, choices: list[list[tuple]], tags: Column, *columns: str) -> DataFrame:
    """`columns` of rows(key, size, near, ...), and score where the choices have it, with a row for each choice and each tag.

    g and h tell apart what tells events apart, tags, numbers of words and parts. Keys without words are alike where they are equal.
    """
    fields = ("kept", "m", "score")[: len(choices[0][0])]
    one = lambda c: F.struct(*[F.lit(list(x) if isinstance(x, tuple) else x).alias(f) for f, x in zip(fields, c)])
    by_size = F.array(*[F.array(*map(one, of_size)) for of_size in choices])
    x = rows.withColumn("words", F.sort_array(T.key_set(F.col("key")))).withColumn("choice", F.explode(F.get(by_size, F.col("size")))).withColumn("tag", F.explode(tags))
    part = F.when(F.col("size") == 0, F.concat(F.lit("="), F.col("key"))).otherwise(F.array_join(F.transform("choice.kept", lambda i: F.get("words", i)), " "))
    x = x.withColumn("part", part)
    return x.select(*columns, F.xxhash64("near", "tag", "choice.m", "part").alias("g"), F.xxhash64(F.lit(1), "near", "tag", "choice.m", "part").alias("h"), *[f"choice.{f}" for f in fields[2:]])


def _places(old: DataFrame, new: DataFrame, span: int, least: float) -> tuple[DataFrame, DataFrame]:
    """Where stored headlines lie: g, h, its_at, matched; and where classes of new ones look: b, g, h, score.

    Keys alike enough share a part that leaves out few words of either. A stored one lies under all such parts of its
    key, a new one looks under all of its own: rows grow with headlines, not with pairs of them. A key that shares more than
    the part is found under the larger part too, and is more alike there.
    Only headlines without a token may have longer keys. Where there are such, their classes are paired.
    """
    stored_parts, look_parts = _alike(least)
    # Who has no direction looks among all, tag 2; others among those without one and of their own.
    lie = _parted(old, stored_parts, F.array(F.lit(2), F.col("way")), "at", "cluster_id")
    classes = new.select(F.col("cls").alias("b"), "key", "size", "near", "way").distinct()
    look = _parted(classes, look_parts, F.when(F.col("way") == 0, F.array(F.lit(2))).otherwise(F.array(F.lit(0), F.col("way"))), "b")
    whole = lambda c: (F.xxhash64(F.lit("class"), c).alias("g"), F.xxhash64(F.lit(1), F.lit("class"), c).alias("h"))
    longer = F.col("bare") & (F.col("size") > KEY_WORDS)
    shorter = F.col("bare") & ~longer & (F.col("size") >= least * (KEY_WORDS + 1) - 1e-9)
    for a, b in ((old.where(longer), new.where(longer | shorter)), (old.where(shorter), new.where(longer))):
        if a.isEmpty() or b.isEmpty():
            continue
        pairs = _class_pairs(_nodes(a, span), _nodes(b, span), (-1, 0, 1), least)
        pairs = pairs.unionByName(a.select(F.col("cls").alias("a"), F.col("cls").alias("b"), F.lit(1.0).alias("score")).distinct())
        lie = lie.unionByName(a.select("at", "cluster_id", *whole(F.col("cls"))))
        look = look.unionByName(pairs.select("b", *whole(F.col("a")), "score"))
    return lie.groupBy("g", "h", F.col("at").alias("its_at")).agg(F.min("cluster_id").alias("matched")), look


def resolved(items: DataFrame, known: DataFrame, clusters: DataFrame, hours: float = 36, least: float = 0.70) -> DataFrame:
    """row_id, cluster_id, how: items(row_id, url, title, ts) against what is stored.

    A URL of known(url, cluster_id) keeps its cluster (URL); else the cluster of clusters(row_id,
    cluster_id, title, ts) within `hours` either way that the item should merge with and is most like,
    the latest and then the smallest id of equal ones (MATCH); else none (NEW).

    An item looks once under each part of its key that a stored key alike enough may share, for the last one
    within the hours: as often however many headlines are stored.
    """
    span = int(hours * 3_600_000_000)
    size = F.size(T.key_set(F.col("key"))).alias("size")
    new = materialised(_described(items, "title", "ts", "row_id", (), ["url"]).select("row_id", "url", "at", "cls", "key", "near", "way", "bare", size))
    old = materialised(_described(clusters, "title", "ts", "row_id", (), ["cluster_id"]).select("cluster_id", "at", "cls", "key", "near", "way", "bare", size))
    stored, look = _places(old, new, span, least)
    stored = materialised(stored)
    look = look.join(stored.select("g", "h").distinct(), ["g", "h"], "left_semi")
    looks = materialised(new.select("row_id", "at", (F.col("at") + span).alias("until"), F.col("cls").alias("b")).join(look, "b").drop("b"))
    found = asof_join(looks, stored, ["g", "h"], "until", "its_at", ["its_at", "matched"]).where(F.col("its_at") >= F.col("at") - span)
    best = found.groupBy(F.col("row_id").alias("b")).agg(F.min(F.struct(-F.col("score"), -F.col("its_at"), F.col("matched").isNull(), "matched"))["matched"].alias("matched"))
    by_url = known.groupBy("url").agg(F.min("cluster_id").alias("stored"))
    out = new.select("row_id", "url").join(by_url, "url", "left").join(best, F.col("row_id") == F.col("b"), "left")
    how = F.when(F.col("stored").isNotNull(), "URL").when(F.col("matched").isNotNull(), "MATCH").otherwise("NEW")
    return out.select("row_id", F.coalesce("stored", "matched").alias("cluster_id"), how.alias("how"))


def archive_status(df: DataFrame, order: str, title: str, url: str, published: str, first_seen: str, fixture: Column) -> DataFrame:
    """Adds status and reason to every archived row, none is left out.

    INVALID without a title, URL or time; SYNTHETIC_FIXTURE; DUPLICATE of an earlier row's canonical URL
    or of its headline on the same day; VERIFIED_SOURCE with a first sighting of its own, else
    HISTORICAL_UNVERIFIED_AVAILABILITY. Rows of the first two kinds block no others.
    """
    t, u = F.btrim(F.coalesce(title, F.lit(""))), F.btrim(F.coalesce(url, F.lit("")))
    x = df.withColumn("_bad", (t == "") | (u == "") | F.col(published).isNull()).withColumn("_fixture", F.coalesce(fixture, F.lit(False)))
    headline = T.normal_headline(F.col(title))
    keys = x.where("NOT _bad AND NOT _fixture").select(F.col(order).alias("_n"), T.canonical_url(F.col(url)).alias("_u"), F.when(headline != "", F.concat_ws("|", headline, F.to_date(published).cast("string"))).alias("_t"))
    passed = either_key_dedup(keys, "_u", "_t", "_n").select(F.col("_n").alias(order), "accepted")
    x = x.join(passed, order, "left")
    status = F.when(F.col("_bad"), "INVALID").when(F.col("_fixture"), "SYNTHETIC_FIXTURE").when(~F.col("accepted"), "DUPLICATE").when(F.col(first_seen).isNotNull(), "VERIFIED_SOURCE").otherwise("HISTORICAL_UNVERIFIED_AVAILABILITY")
    why = F.when(F.col("_bad"), "missing fields").when(F.col("_fixture"), "fixture").when(~F.col("accepted"), "same URL or headline of the day").when(F.col(first_seen).isNull(), "no first sighting")
    return x.withColumn("status", status).withColumn("reason", why).drop("_bad", "_fixture", "accepted")


def cluster_labels(df: DataFrame, cluster: str, impact: str, confidence: str, price_report: str, order: Sequence[str]) -> DataFrame:
    """One label for each cluster: both sides make MIXED, else BULLISH, BEARISH, MIXED, NEUTRAL or
    UNKNOWN by what members say; only price reports make NEUTRAL. The first member of the highest
    confidence represents it."""
    rank = F.when(F.col(confidence) == "HIGH", 3).when(F.col(confidence) == "MEDIUM", 2).otherwise(1)
    says = lambda x: F.max((~F.col(price_report) & (F.col(impact) == x)).cast("int")) == 1
    out = df.groupBy(cluster).agg(
        F.min(F.col(price_report)).alias("only_reports"), *[says(x).alias(x.lower()) for x in ("BULLISH", "BEARISH", "MIXED", "NEUTRAL")],
        F.min_by(order[-1], F.struct(-rank, *order)).alias("representative"), F.count(F.lit(1)).alias("members"),
    )
    label = F.when(F.col("only_reports"), "NEUTRAL").when(F.col("bullish") & F.col("bearish"), "MIXED")
    for x in ("BULLISH", "BEARISH", "MIXED", "NEUTRAL"):
        label = label.when(F.col(x.lower()), x)
    return out.select(cluster, label.otherwise("UNKNOWN").alias("label"), "representative", "members")


def stratified_sample(df: DataFrame, stratum: str, source: str, row_id: str, n: int, per_source: int, seed: str = "review") -> DataFrame:
    """n rows in turns over the strata, at most `per_source` of a source before others run out.

    The order inside a stratum is md5(seed:id), so it repeats. Rows beyond a source's share come
    after all others, in a second pass of turns.
    """
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.col(row_id).cast("string")))
    late = F.row_number().over(Window.partitionBy(source).orderBy(key, row_id)) > per_source
    turn = F.row_number().over(Window.partitionBy(stratum, "_late").orderBy(key, row_id))
    return df.withColumn("_late", late).withColumn("_turn", turn).orderBy("_late", "_turn", stratum, row_id).limit(n).drop("_late", "_turn")
