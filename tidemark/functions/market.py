"""Numbers, times, units, validation and freshness of published rates."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

TROY_OUNCE = 31.1034768
#: Grams of a quoted unit.
UNIT_GRAMS = {"1g": 1.0, "gram": 1.0, "10g": 10.0, "100g": 100.0, "kg": 1000.0, "oz": TROY_OUNCE}
#: Inclusive bounds of plausible prices, INR per gram or as quoted.
BOUNDS = {"gold_inr_gram": (5_000, 50_000), "gold_inr_gram_gst": (5_000, 52_000), "silver_inr_gram": (80, 1_500), "silver_inr_gram_gst": (80, 1_600), "gold_usd": (1_000, 10_000), "silver_usd": (15, 200), "usdinr": (60, 150)}
GST = 1.03


def number(text: Column) -> Column:
    """The first number of a text without its commas; null for dashes, blanks and what isn't positive."""
    found = F.regexp_extract(F.regexp_replace(text, ",", ""), r"(-?[0-9]+(?:\.[0-9]+)?)", 1)
    value = found.try_cast("double")
    return F.when(value > 0, value)


def iso_time(text: Column) -> Column:
    """An ISO time, without a zone in UTC; null for blanks, nan, none and null."""
    clean = F.btrim(text)
    clean = F.when(~F.lower(clean).isin("", "nan", "none", "null"), clean)
    return clean.try_cast("timestamp")


def dated(text: Column, *formats: str) -> Column:
    """By the first format that fits, else null. A source names its formats; none is guessed."""
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats])


def clock_minutes(text: Column) -> Column:
    """Minutes after midnight of a text such as 'Time : 09:29 am'."""
    part = lambda i: F.regexp_extract(F.lower(text), r"([0-9]{1,2}):([0-9]{2})\s*(am|pm)", i)
    hour = part(1).try_cast("int") % 12 + F.when(part(3) == "pm", 12).otherwise(0)
    return hour * 60 + part(2).try_cast("int")


def resolve_clock(now: Column, clock: Column) -> Column:
    """struct(at, status) of a bare clock seen at `now` (both local; clock in minutes).

    Not later than now: today. Else before six with an evening clock: yesterday; before nine with a
    clock from nine on that is two hours ahead: yesterday, perhaps carried over; else ambiguous.
    """
    day = F.date_trunc("day", now)
    minute = F.hour(now) * 60 + F.minute(now)
    at = lambda d: day + F.make_dt_interval(F.lit(d), F.lit(0), clock)
    evening = (minute < 360) & (clock >= 1080)
    carried = (minute < 540) & (clock >= 540) & (clock - minute >= 120)
    status = F.when(clock.isNull(), "MISSING").when(clock <= minute, "SAME_DAY").when(evening, "PREVIOUS_DAY").when(carried, "CARRYOVER_CANDIDATE").otherwise("AMBIGUOUS")
    return F.struct(F.when(clock <= minute, at(0)).when(evening | carried, at(-1)).alias("at"), status.alias("status"))


def precision(text: Column) -> Column:
    return F.when(text.rlike(r"[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}[-/][0-9]{2}[-/][0-9]{4}"), "FULL").when(text.rlike(r"[0-9]{1,2}:[0-9]{2}"), "CLOCK_ONLY")


def grams(unit: Column) -> Column:
    out = F.lit(None).cast("double")
    for name, g in UNIT_GRAMS.items():
        out = F.when(F.lower(unit) == name, g).otherwise(out)
    return out


@dataclass(frozen=True)
class Spec:
    """What a product's quotes must be: its metal and currency, and bounds as quoted or per gram."""

    metal: str
    currency: str
    low: float
    high: float
    per_gram: bool = True


def validate(price: Column, source_id: Column, product: Column, metal: Column, currency: Column, gram: Column, previous: Column, specs: dict[str, Spec], jump: float = 0.20, artifact: dict[str, float] | None = None) -> Column:
    """struct(status, reason, per_gram): the first rule that applies decides.

    QUARANTINED without a price, at or below zero, where the price is its own source id, at a
    known artifact, for another metal or currency and outside the bounds; SUSPECT for an unknown
    product and a jump of more than `jump` from the previous price; else VALID.
    """
    def of(field: str) -> Column:
        out = F.lit(None)
        for k, s in specs.items():
            out = F.when(product == k, F.lit(getattr(s, field))).otherwise(out)
        return out

    per = F.when(of("per_gram").cast("boolean"), F.round((price / gram).cast("decimal(20,6)"), 2).cast("double"))
    value = F.when(of("per_gram").cast("boolean"), per).otherwise(price)
    bad = lambda why: F.struct(F.lit("QUARANTINED").alias("status"), F.lit(why).alias("reason"))
    odd = lambda why: F.struct(F.lit("SUSPECT").alias("status"), F.lit(why).alias("reason"))
    known = product.isin(*specs)
    rule = F.when(price.isNull(), bad("no price")).when(price <= 0, bad("not positive")).when(F.abs(source_id.try_cast("double") - price) < 1e-6, bad("price is the source id"))
    for k, v in (artifact or {}).items():
        rule = rule.when((product == k) & (price == v), bad("known artifact"))
    rule = (
        rule.when(product.isNull() | ~known, odd("unknown product"))
        .when(metal != of("metal"), bad("another metal"))
        .when(currency != of("currency"), bad("another currency"))
        .when((value < of("low")) | (value > of("high")), bad("out of bounds"))
        .when(of("per_gram").cast("boolean") & (F.abs(price - previous) / previous > jump), odd("jump"))
        .otherwise(F.struct(F.lit("VALID").alias("status"), F.lit(None).cast("string").alias("reason")))
    )
    return F.struct(rule["status"].alias("status"), rule["reason"].alias("reason"), F.when(known, per).alias("per_gram"))


def session_status(local: Column) -> Column:
    """Closed on Sundays and on Saturdays from 19:00; open 09:00 to 23:30; else after hours."""
    minute = F.hour(local) * 60 + F.minute(local)
    day = F.weekday(local)
    return F.when((day == 6) | (day == 5) & (minute >= 1140), "CLOSED").when((minute >= 540) & (minute < 1410), "OPEN").otherwise("AFTER_HOURS")


def freshness(ts: Column, now: Column, rate_type: Column, source_down: Column, closed: Column) -> Column:
    """LIVE, FRESH, DELAYED or STALE by age (hours to two places); a source or market that is down first."""
    seconds = F.greatest(F.lit(0.0), (F.unix_micros(now.cast("timestamp")) - F.unix_micros(ts.cast("timestamp"))) / 1e6)
    hours = F.round(seconds / 3600, 2)
    daily = F.when(hours < 16, "FRESH").when(hours < 36, "DELAYED").otherwise("STALE")
    live = F.when(seconds <= 120, "LIVE").when(hours < 4, "FRESH").when(hours < 24, "DELAYED").otherwise("STALE")
    return F.when(source_down, "SOURCE_UNAVAILABLE").when(ts.isNull(), "STALE").when(closed, "MARKET_CLOSED").when(rate_type.isin("BENCHMARK", "LBMA"), daily).otherwise(live)


def worst(a: Column, b: Column) -> Column:
    order = ["LIVE", "FRESH", "DELAYED", "MARKET_CLOSED", "STALE", "SOURCE_UNAVAILABLE"]
    rank = lambda c: F.array_position(F.array(*map(F.lit, order)), c)
    return F.when(rank(a) >= rank(b), a).otherwise(b)


def age_text(seconds: Column) -> Column:
    whole = F.floor(seconds)
    return F.when(seconds < 60, F.format_string("%ds", whole)).when(seconds < 3600, F.format_string("%dm", F.floor(seconds / 60))).when(seconds < 86400, F.format_string("%dh", F.floor(seconds / 3600))).otherwise(F.format_string("%dd", F.floor(seconds / 86400)))


def parity(xau_usd: Column, usd_inr: Column) -> Column:
    """INR per gram of the dollar price of an ounce."""
    return xau_usd * usd_inr / TROY_OUNCE


def premium_pct(local: Column, par: Column) -> Column:
    return F.try_divide(local - par, par) * 100


def fine_grams(gross: Column, unit: Column, purity: Column, quantity: Column) -> Column:
    """Pure metal in grams; a purity above one is in thousandths."""
    pure = F.when(purity > 1, purity / 1000).otherwise(purity)
    return F.round(F.when(F.lower(unit) == "kg", gross * 1000).otherwise(gross) * pure * quantity, 4)


def holding_value(gross: Column, purity: Column, rate: Column, quantity: Column) -> Column:
    """Worth at a rate for 0.999 fine metal."""
    pure = F.when(purity > 1, purity / 1000).otherwise(purity)
    return F.round(gross * (pure / 0.999) * rate * quantity, 2)
