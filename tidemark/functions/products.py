"""Quoted products: what a feed's symbols and ids mean, and what a product's name tells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values: (record type, symbol) -> city, product, metal, purity, weight, unit, currency, rate type.
SYMBOLS = (
    ("3", "47", "ALL_INDIA", "GOLD_1KG_9999", "GOLD", 0.9999, 1.0, "1g", "INR", "WHOLESALE"),
    ("3", "48", "CHENNAI", "GOLD_100G_999", "GOLD", 0.999, 1.0, "1g", "INR", "RETAIL"),
    ("3", "49", "BENGALURU", "GOLD_100G_999", "GOLD", 0.999, 1.0, "1g", "INR", "RETAIL"),
    ("3", "50", "MUMBAI", "GOLD_100G_999", "GOLD", 0.999, 1.0, "1g", "INR", "RETAIL"),
    ("3", "51", "COIMBATORE", "GOLD_100G_999", "GOLD", 0.999, 1.0, "1g", "INR", "RETAIL"),
    ("3", "52", "HYDERABAD", "GOLD_100G_999", "GOLD", 0.999, 1.0, "1g", "INR", "RETAIL"),
    ("1", "G", "ALL_INDIA", "KJPL_SPOT_GOLD_USD", "GOLD", 0.999, 1.0, "oz", "USD", "KJPL_LIVE"),
    ("1", "SPOT-GOLD", "ALL_INDIA", "KJPL_SPOT_GOLD_USD", "GOLD", 0.999, 1.0, "oz", "USD", "KJPL_LIVE"),
    ("1", "S", "ALL_INDIA", "KJPL_SPOT_SILVER_USD", "SILVER", 0.999, 1.0, "oz", "USD", "KJPL_LIVE"),
    ("1", "SPOT-SILVER", "ALL_INDIA", "KJPL_SPOT_SILVER_USD", "SILVER", 0.999, 1.0, "oz", "USD", "KJPL_LIVE"),
    ("1", "I", "ALL_INDIA", "KJPL_SPOT_USDINR", "FX", 1.0, 1.0, "USD", "INR", "KJPL_LIVE"),
    ("1", "SPOT-INR", "ALL_INDIA", "KJPL_SPOT_USDINR", "FX", 1.0, 1.0, "USD", "INR", "KJPL_LIVE"),
    ("2", "GOLD", "ALL_INDIA", "KJPL_GOLDDEC_INR_10G", "GOLD", 0.995, 10.0, "10g", "INR", "KJPL_LIVE"),
    ("2", "GOLDDEC", "ALL_INDIA", "KJPL_GOLDDEC_INR_10G", "GOLD", 0.995, 10.0, "10g", "INR", "KJPL_LIVE"),
    ("2", "SILVER", "ALL_INDIA", "KJPL_SILVERDEC_INR_1KG", "SILVER", 0.999, 1.0, "1kg", "INR", "KJPL_LIVE"),
    ("2", "SILVERDEC", "ALL_INDIA", "KJPL_SILVERDEC_INR_1KG", "SILVER", 0.999, 1.0, "1kg", "INR", "KJPL_LIVE"),
)
FIELDS = "record_type string, symbol string, city string, product string, metal string, purity double, weight double, unit string, currency string, rate_type string"
#: Other names of a city.
ALIASES = {"BENGALURU": ("BANGALORE", "BLR"), "CHENNAI": ("MAA", "MADRAS"), "MUMBAI": ("BOM", "BOMBAY"), "COIMBATORE": ("CJB",), "HYDERABAD": ("HYD",), "ALL_INDIA": ("ALL", "NATIONAL", "ALL-INDIA")}
#: A price from here on is that of the whole bar.
BAR_PRICE, GRAM_PRICE = 500_000, 100_000
#: Publishers under whose names fixtures were made up.
SEED_DOMAINS = ("reuters.com", "bloomberg.com", "economictimes.indiatimes.com", "cnbc.com", "livemint.com", "ft.com", "wsj.com")


def symbols(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(SYMBOLS), FIELDS)


def with_products(ticks: DataFrame) -> DataFrame:
    """Frames with what their symbol stands for; frames of unknown symbols go. Bars quoted whole
    get the bar's weight and unit."""
    out = ticks.withColumn("symbol", F.upper("symbol")).join(F.broadcast(symbols(ticks.sparkSession)), ["record_type", "symbol"])
    whole = (F.col("record_type") == "3") & (F.col("price") >= BAR_PRICE)
    kilo = F.col("symbol") == "47"
    return out.withColumn("weight", F.when(whole & ~kilo, 100.0).otherwise(F.col("weight"))).withColumn("unit", F.when(whole, F.when(kilo, "1kg").otherwise("100g")).otherwise(F.col("unit")))


def from_name(name: Column, price: Column) -> Column:
    """struct(city, product, metal, purity, weight, unit, rate_type) as a product's name tells them."""
    up = F.upper(name)
    metal = F.when(up.contains("SILVER"), "SILVER").otherwise("GOLD")
    city = F.lit("ALL_INDIA")
    for c, other in reversed(ALIASES.items()):
        if c != "ALL_INDIA":
            city = F.when(up.rlike("|".join((c, *(a for a in other if len(a) > 3)))), c).otherwise(city)
    kilo, hundred = up.rlike("1 ?KG|1000"), up.contains("100")
    fine = up.rlike("99\\.?99")
    per_gram = (metal == "GOLD") & (price < GRAM_PRICE)
    purity = F.when(kilo & fine, 0.9999).otherwise(0.999)
    product = (
        F.when(kilo, F.concat(metal, F.when(fine, "_1KG_9999").otherwise("_1KG_999"))).when(hundred, F.concat(metal, F.lit("_100G_999")))
        .when(metal == "GOLD", "MJDTA_GOLD_24K").otherwise("MJDTA_SILVER")
    )
    by_gram = F.coalesce(per_gram, F.lit(False)) | ~(kilo | hundred)
    weight = F.when(by_gram | kilo, 1.0).otherwise(100.0)
    unit = F.when(by_gram, "1g").when(kilo, "1kg").otherwise("100g")
    rate = F.when(kilo, F.when(metal == "GOLD", "WHOLESALE").otherwise("RETAIL")).when(hundred, "RETAIL").otherwise("MJDTA_BENCHMARK")
    return F.struct(city.alias("city"), product.alias("product"), metal.alias("metal"), purity.alias("purity"), weight.alias("weight"), unit.alias("unit"), rate.alias("rate_type"))


def city_code(name: Column) -> Column:
    """A city by any of its names, upper case."""
    clean = F.upper(F.btrim(name))
    out = clean
    for city, other in ALIASES.items():
        out = F.when(clean.isin(*other), city).otherwise(out)
    return out


def is_transient(source_id: Column, city: Column, product: Column) -> Column:
    """A city feed that is kept in memory only: id, city and product must all be those of one row."""
    same = F.lit(False)
    for kind, symbol, place, name, *_ in SYMBOLS:
        if kind == "3" and symbol != "47":
            same = same | ((F.btrim(source_id) == symbol) & (F.upper(F.btrim(city)) == place) & (F.btrim(product) == name))
    return F.coalesce(same, F.lit(False))


def is_made_up(url: Column, source: Column) -> Column:
    """A fixture: a seed publisher, and a dated slug without an article number before the date."""
    host = F.regexp_replace(F.lower(F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), "^www\\.", "")
    known = F.lit(False)
    for d in SEED_DOMAINS:
        known = known | host.contains(d) | F.lower(F.btrim(F.coalesce(source, F.lit("")))).contains(d)
    return F.coalesce(known & F.btrim(url).rlike(r"^(?!.*-\d{5,}-\d{4}-\d{2}-\d{2}).*-\d{4}-\d{2}-\d{2}/?$"), F.lit(False))


def compact_time(text: Column) -> Column:
    """yyyyMMdd[T]HHmmss[Z] in UTC."""
    return F.try_to_timestamp(F.substring(F.regexp_replace(text, "[TZ ]", ""), 1, 14), F.lit("yyyyMMddHHmmss"))


def mail_time(text: Column) -> Column:
    """RFC 822 dates, `Tue, 10 Nov 2026 08:30:00 +0530` or with GMT, in UTC."""
    clean = F.regexp_replace(F.regexp_replace(F.btrim(text), "^[A-Za-z]{3}, *", ""), "(GMT|UTC|UT|Z)$", "+0000")
    return F.try_to_timestamp(clean, F.lit("d MMM yyyy HH:mm:ss Z"))


def publisher(title: Column, tag: Column) -> Column:
    """The source tag, or what follows the title's last dash."""
    return F.coalesce(F.nullif(F.btrim(tag), F.lit("")), F.nullif(F.regexp_extract(title, r".* - (.*)$", 1), F.lit("")))
