"""Rule engines over text: relevance by category, direction of impact, cue words.

Rules are data; each turns into built-in expressions. A text is cut into words once; its runs of
words are looked up among all phrases together, by hash, so the number of phrases costs little.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import rule_tables as R

#: What words are made of. All else separates them.
WORD = r"\p{L}\p{N}_"


def strings(listed: Sequence[str]) -> Column:
    """An array of texts, in one expression: a literal for each would take a call to the JVM each."""
    return F.expr("array(" + ", ".join("'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'" for x in listed) + ")")


def found_phrases(text: Column, listed: Sequence[str], word: str = WORD) -> Column:
    """Which of the phrases stand in the text as whole words, in any case, each once.

    A run of words from the start of one to the end of another, with what stands between, is a
    phrase if it equals one; phrases that end in punctuation need a word right behind them.
    """
    low = list(dict.fromkeys(p.lower() for p in listed))
    odd = [p for p in low if not (re.match(r"\w", p) and re.search(r"\w$", p))]
    plain = [p for p in low if p not in odd]
    sizes = sorted({len(re.findall(r"\w+", p)) for p in plain})
    # Words are at even places from 0 on; a separator before the first word goes.
    tokens = F.regexp_extract_all(F.regexp_replace(F.lower(text), f"^[^{word}]+", ""), F.lit(f"[{word}]+|[^{word}]+"), F.lit(0))

    def of(t: Column, m: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.size(t), F.lit(1)), F.lit(2)), lambda i: F.array_join(F.slice(t, i, 2 * m - 1), ""))

    def runs(t: Column) -> Column:
        return F.concat(*[t if m == 1 else of(t, m) for m in sizes]) if sizes else F.array().cast("array<string>")

    hit = F.array_intersect(F.get(F.transform(F.array(tokens), runs), F.lit(0)), strings(plain))
    for p in odd:
        hit = F.when(F.lower(text).rlike(f"(?:^|[^{word}]){re.sub(r'([+.*?()|$^])', r'\\\1', p)}[{word}]"), F.concat(hit, F.array(F.lit(p)))).otherwise(hit)
    return hit


def relevance(
    df: DataFrame,
    title: str,
    description: str | None = None,
    categories: Mapping[str, Sequence[str]] = R.CATEGORIES,
    exclusions: Sequence[str] = R.EXCLUSIONS,
    context: Sequence[str] = R.CONTEXT,
    explicit: Sequence[str] = R.EXPLICIT,
    specific: Sequence[str] = R.SPECIFIC,
    direct: Sequence[str] = R.DIRECT,
    dimensions: Mapping[str, Sequence[str]] = R.DIMENSIONS,
    metals: str = "PRECIOUS_METALS",
    least_specific: str = "GOLD_DIRECT",
    word: str = WORD,
) -> DataFrame:
    """Adds scores map<string,double>, primary_category, supporting_categories, one column for each
    dimension, relevance_score and is_relevant.

    A category scores 0.7 and 0.1 for each further phrase in the title (three at most), or 0.4
    likewise by the description. An excluded text without context words scores nothing. The primary
    category has the highest score, then specificity, then matched length, then table order.
    """
    t = F.coalesce(F.col(title), F.lit(""))
    d = F.coalesce(F.col(description), F.lit("")) if description else None
    every = [p for v in categories.values() for p in v] + [*exclusions, *context, *explicit]
    # A phrase may also run from the title into the description, as both are one text to the other lists.
    df = df.withColumn("_title", found_phrases(t, every, word))
    df = df.withColumn("_desc", found_phrases(d, every, word) if description else F.array().cast("array<string>"))
    df = df.withColumn("_both", found_phrases(F.concat(t, F.lit(" "), d), every, word) if description else F.col("_title"))
    lits = lambda listed: strings([p.lower() for p in listed])
    entries = []
    for nth, (name, listed) in enumerate(categories.items()):
        n_title, n_desc = (F.size(F.array_intersect(c, lits(listed))) for c in ("_title", "_desc"))
        length = F.aggregate(F.array_intersect(F.array_union("_title", "_desc"), lits(listed)), F.lit(0), lambda acc, p: acc + F.length(p))
        score = F.when(n_title > 0, F.least(F.lit(1.0), 0.7 + F.least(n_title - 1, F.lit(3)) * 0.1)).when(n_desc > 0, 0.4 + F.least(n_desc - 1, F.lit(3)) * 0.1)
        rank = 2 if name in specific else 0 if name == least_specific else 1
        entries.append(F.struct(F.round(score, 4).alias("score"), F.lit(rank).alias("rank"), F.when(score.isNotNull(), length).alias("length"), F.lit(-nth).alias("order"), F.lit(name).alias("name")))
    says = lambda listed: F.arrays_overlap("_both", lits(listed))
    excluded = says(exclusions) & ~says(context)
    found = F.when(excluded, F.array().cast("array<struct<score:double,rank:int,length:int,order:int,name:string>>")).otherwise(F.filter(F.array(*entries), lambda e: e["score"].isNotNull()))
    df = df.withColumn("_found", F.reverse(F.array_sort(found)))
    df = df.withColumn("scores", F.map_from_entries(F.transform("_found", lambda e: F.struct(e["name"].alias("k"), e["score"].alias("v")))))
    top = lambda names: F.greatest(F.lit(0.0), *[F.coalesce(F.try_element_at("scores", F.lit(n)), F.lit(0.0)) for n in names])
    df = df.withColumn("primary_category", F.coalesce(F.get("_found", F.lit(0))["name"], F.lit("OTHER")))
    df = df.withColumn("supporting_categories", F.transform(F.filter(F.slice("_found", 2, len(categories)), lambda e: e["score"] >= 0.35), lambda e: e["name"]))
    for name, members in dimensions.items():
        df = df.withColumn(name, top(members))
    said = ~excluded & says(explicit)
    most = F.greatest(F.lit(0.0), F.lit(0.0), *[F.col(n) for n in dimensions if n != "market"])
    score = F.when(top(direct) > 0, top(direct)).when(said, F.round(F.least(F.lit(1.0), 0.6 + most * 0.3), 4)).otherwise(F.round(top([metals]) * 0.7, 4))
    return df.withColumn("relevance_score", score).withColumn("is_relevant", (score >= 0.4) | said).drop("_found", "_title", "_desc", "_both")


def masked(text: Column, patterns: Sequence[str]) -> Column:
    """The text with each pattern's matches blanked out, one pattern after the other."""
    for p in patterns:
        text = F.regexp_replace(text, p, " ")
    return text


def says(text: Column, patterns: Sequence[str]) -> Column:
    """Whether any of the patterns matches: one search for all."""
    return text.rlike("|".join(patterns))


def first_tag(text: Column, rules: Sequence[tuple[str, Sequence[str]]], default: str = "UNKNOWN") -> Column:
    out = F.lit(default)
    for tag, patterns in reversed(rules):
        out = F.when(says(text, patterns), tag).otherwise(out)
    return out


def impact(df: DataFrame, title: str) -> DataFrame:
    """Adds surprise, is_price_report, direction, driver and confidence of a headline.

    Price bulletins are neutral before all else. Negated hikes and cuts and other banks' moves
    are read first and blanked out; then the Fed's, then the signals of the table in order. The
    first signal names the driver; both sides make MIXED; a rally or drop that failed has none.
    """
    x = df.withColumn("_text", F.lower(F.coalesce(F.col(title), F.lit(""))))
    x = x.withColumn("surprise", first_tag(F.col("_text"), R.SURPRISES))
    t = F.col("_text")
    x = x.withColumn("is_price_report", says(t, R.PRICE_REPORT) & ~says(t, R.MACRO_CONTENT) | says(t, R.DESCRIPTIVE_MOVE) & ~says(t, R.CAUSAL_MACRO))
    x = x.withColumn("_a", masked(t, R.NEGATED_HIKE)).withColumn("_b", masked(F.col("_a"), R.NEGATED_CUT))
    x = x.withColumn("_c", masked(F.col("_b"), R.RBI_HAWKISH)).withColumn("_d", masked(F.col("_c"), R.RBI_DOVISH))
    x = x.withColumn("_foreign", says(F.col("_d"), R.FOREIGN_BANK) & ~says(F.col("_d"), R.FED_NAME)).withColumn("_e", masked(F.col("_d"), R.FOREIGN_POLICY))
    hike, cut = F.col("_a") != t, F.col("_b") != F.col("_a")
    e = F.col("_e")
    expected = (F.col("surprise") == "AS_EXPECTED") & ~hike & ~cut & says(e, R.FED_ACTION)
    held = says(e, R.FED_NEUTRAL) & ~says(e, R.FED_BEARISH)
    fed_driver = F.when(e.contains("yield") & ~e.contains("fed"), "US_INTEREST_RATES").otherwise("FED_POLICY")

    def signal(when: Column, driver: Column | str, confidence: str) -> Column:
        name = F.lit(driver) if isinstance(driver, str) else driver
        return F.when(when, F.struct(name.alias("driver"), F.lit(confidence).alias("confidence")))

    bull = [signal(hike, "FED_POLICY", "HIGH"), signal(F.col("_d") != F.col("_c"), "INR", "MEDIUM"), signal(~F.col("_foreign") & ~expected & ~held & says(e, R.FED_BULLISH), fed_driver, "HIGH")]
    bear = [signal(cut, "FED_POLICY", "HIGH"), signal(F.col("_c") != F.col("_b"), "INR", "MEDIUM"), signal(~F.col("_foreign") & ~expected & says(e, R.FED_BEARISH), fed_driver, "HIGH")]
    early = F.coalesce(*bull, *bear).isNull() & (F.col("_foreign") | ~(expected | held))
    for driver, side, confidence, patterns in R.SIGNALS:
        (bull if side == "BULLISH" else bear).append(signal(says(t, patterns), driver, confidence))
    inflation = says(t, R.INFLATION)
    bear.append(signal(inflation & says(t, R.INFLATION_BEARISH), "INFLATION", "MEDIUM"))
    x = x.withColumn("_bull", F.coalesce(*bull)).withColumn("_bear", F.coalesce(*bear))
    none = F.col("_bull").isNull() & F.col("_bear").isNull()
    x = x.withColumn("_momentum_up", none & says(t, R.MOMENTUM_BULLISH)).withColumn("_momentum_down", none & says(t, R.MOMENTUM_BEARISH))
    momentum = F.struct(F.lit("OTHER_MACRO").alias("driver"), F.lit("MEDIUM").alias("confidence"))
    neutral = ~F.col("_foreign") & (expected | held)
    # The last uncertain cue that applies names the driver.
    unsure = F.when(none & inflation & ~says(t, R.INFLATION_BEARISH), "INFLATION").when(early & says(e, R.FED_PREVIEW), "FED_POLICY").when((e != F.col("_d")) | F.col("_foreign"), "OTHER_MACRO")
    x = x.withColumn("_neutral", neutral).withColumn("_unsure", unsure)
    x = x.withColumn("_bull", F.coalesce("_bull", F.when(F.col("_momentum_up"), momentum))).withColumn("_bear", F.coalesce("_bear", F.when(F.col("_momentum_down"), momentum)))
    x = x.withColumn("_unsure", F.coalesce("_unsure", F.when(F.col("_bull").isNull() & F.col("_bear").isNull() & ~F.col("_neutral") & says(t, R.PHYSICAL_UNSPECIFIED), "INDIAN_PHYSICAL_DEMAND")))
    up, down = F.col("_bull").isNotNull(), F.col("_bear").isNotNull()
    made = lambda d, driver, c: F.struct(F.lit(d).alias("direction"), driver.alias("driver"), c.alias("confidence"))
    result = (
        F.when(F.col("is_price_report"), made("NEUTRAL", F.lit("GOLD_PRICE_REPORT"), F.lit("MEDIUM")))
        .when(up & down, made("MIXED", F.col("_bull.driver"), F.lit("MEDIUM")))
        .when(up & says(t, R.FAILED_RALLY), made("UNKNOWN", F.col("_bull.driver"), F.lit("LOW")))
        .when(up, made("BULLISH", F.col("_bull.driver"), F.col("_bull.confidence")))
        .when(down & says(t, R.FAILED_DROP), made("UNKNOWN", F.col("_bear.driver"), F.lit("LOW")))
        .when(down, made("BEARISH", F.col("_bear.driver"), F.col("_bear.confidence")))
        .when(F.col("_neutral"), made("NEUTRAL", F.lit("FED_POLICY"), F.lit("MEDIUM")))
        .when(F.col("_unsure").isNotNull(), made("UNKNOWN", F.col("_unsure"), F.lit("LOW")))
        .otherwise(made("UNKNOWN", F.lit("UNKNOWN"), F.lit("LOW")))
    )
    return x.withColumn("_r", result).select(*df.columns, "surprise", "is_price_report", "_r.direction", "_r.driver", "_r.confidence")


def cue_sentiment(text: Column, negative: Sequence[str], positive: Sequence[str]) -> Column:
    """struct(label, score) by substrings: negative cues first, then positive ones."""
    has = lambda words: F.lower(text).rlike("|".join(re.escape(w) for w in words))
    made = lambda label, s: F.struct(F.lit(label).alias("label"), F.lit(s).alias("score"))
    return F.when(has(negative), made("negative", -0.75)).when(has(positive), made("positive", 0.65)).otherwise(made("neutral", 0.0))


def strict_label(raw: Column, impacts: Sequence[str], tones: Sequence[str]) -> Column:
    """A model's JSON answer without thinking and fences, null unless its values are allowed."""
    clean = F.regexp_replace(F.regexp_replace(raw, r"(?s)<think>.*?</think>", ""), r"```(?:json)?", "")
    parsed = F.from_json(F.regexp_extract(clean, r"(?s)(\{.*\})", 1), "gold_impact string, general_tone string, confidence string, reasoning string")
    ok = parsed["gold_impact"].isin(*impacts) & parsed["general_tone"].isin(*tones) & parsed["confidence"].isin("HIGH", "MEDIUM", "LOW")
    return F.when(ok, parsed)
