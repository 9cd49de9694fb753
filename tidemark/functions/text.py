"""Headlines and URLs: normal forms, keys, token sets, similarity, fingerprints."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that carry no event.
STOPWORDS = ("a", "an", "the", "in", "on", "at", "to", "for", "of", "and", "or", "as", "by", "with", "from", "is", "are", "was", "were")
#: Tokens that tell two similar headlines apart.
ENTITIES = (
    "cpi", "ppi", "pce", "gdp", "nfp", "payrolls", "jobs", "jobless", "pmi", "retail", "claims",
    "fed", "fomc", "ecb", "rbi", "boj", "boe", "pboc", "snb",
    "hike", "hikes", "cut", "cuts", "hold", "holds",
    "gold", "silver", "platinum", "oil", "crude", "dollar", "rupee", "yuan", "yen", "euro",
)
#: Words of a reported rise or fall.
UP = ("rise", "rises", "gains", "gain", "climbs", "jumps", "surges", "rallies", "higher", "up", "firms")
DOWN = ("fall", "falls", "drops", "slips", "slides", "tumbles", "dips", "lower", "down", "eases", "weakens")
#: Language names by code; a code stands for itself.
LANGUAGES = {
    "en": "english", "zh": "chinese", "hi": "hindi", "bn": "bengali", "mr": "marathi", "ta": "tamil", "te": "telugu", "gu": "gujarati",
    "ml": "malayalam", "pa": "punjabi", "ur": "urdu", "ne": "nepali", "es": "spanish", "fr": "french", "de": "german", "it": "italian",
    "pt": "portuguese", "nl": "dutch", "ru": "russian", "uk": "ukrainian", "ar": "arabic", "tr": "turkish", "fa": "persian", "he": "hebrew",
    "ja": "japanese", "ko": "korean", "vi": "vietnamese", "id": "indonesian", "th": "thai", "el": "greek", "pl": "polish", "ro": "romanian",
    "hu": "hungarian", "cs": "czech", "sk": "slovak", "sl": "slovenian", "hr": "croatian", "sr": "serbian", "bs": "bosnian", "bg": "bulgarian",
    "sq": "albanian", "mk": "macedonian", "sv": "swedish", "no": "norwegian", "et": "estonian", "lt": "lithuanian", "az": "azerbaijani", "kk": "kazakh",
}
#: Parameters that only track a click.
TRACKING = ("fbclid", "gclid", "mc_cid", "mc_eid")

#: Names of months and days.
MONTHS_DAYS = r"\b(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sep(?:tember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?|monday|tuesday|wednesday|thursday|friday|saturday|sunday|today|yesterday)\b"
_SPACES = r"[ \t\n\x0b\f\r]+"


def _unsigned(title: Column) -> Column:
    text = F.btrim(title, F.lit(" \t\n\x0b\f\r"))
    return F.regexp_replace(text, r"[ \t\n\x0b\f\r]+[-|–—][ \t\n\x0b\f\r]+[A-Za-z0-9 \t\n\x0b\f\r.&'()/]+$", "")


def squeezed(text: Column) -> Column:
    return F.btrim(F.regexp_replace(text, _SPACES, " "))


def normal_headline(title: Column) -> Column:
    """Without the publisher behind a dash, white space squeezed, lower case."""
    return F.lower(squeezed(_unsigned(title)))


def loose_headline(title: Column) -> Column:
    """The normal headline with its white space as it is: it has the same tokens, and squeezed it is the same."""
    return F.lower(_unsigned(title))


def tokens(normal: Column) -> Column:
    """Words of a normal headline without stopwords, in order."""
    words = F.split(normal, r"[\x00-/:-@\[-^`{-\x7f]+")
    return F.filter(words, lambda w: (w != "") & ~w.isin(*STOPWORDS))


def cluster_key(title: Column) -> Column:
    """The first six tokens, or the normal headline where there are none."""
    normal = normal_headline(title)
    return key_of(tokens(normal), normal)


def key_of(words: Column | str, normal: Column | str) -> Column:
    """The cluster key of a normal headline whose tokens are at hand."""
    key = F.array_join(F.slice(words, 1, 6), " ")
    return F.when(key == "", F.col(normal) if isinstance(normal, str) else normal).otherwise(key)


def token_set(title: Column) -> Column:
    return F.array_distinct(tokens(normal_headline(title)))


def key_set(key: Column) -> Column:
    """Tokens of a cluster key of two letters or more, which similarity compares."""
    return F.array_distinct(F.filter(F.split(key, " "), lambda w: F.length(w) > 1))


def signature(title: Column) -> Column:
    """All tokens in order of spelling, so that word order doesn't matter."""
    return F.array_join(F.sort_array(token_set(title)), " ")


def template_stem(title: Column) -> Column:
    """Eight tokens without dates and numbers: what recurring bulletins share."""
    return stem_of(normal_headline(title))


def stem_of(normal: Column | str, head: int = 512) -> Column:
    """The template stem of a normal headline.

    Mostly the first `head` characters have its eight tokens and another: the cut touches the last token only. Where
    they don't, the whole text is cut into words.
    """
    normal = F.col(normal) if isinstance(normal, str) else normal

    def words(c: Column) -> Column:
        return tokens(F.regexp_replace(F.regexp_replace(c, MONTHS_DAYS, " "), r"[$₹€£]?[0-9][0-9.,/:-]*%?", " "))

    first = words(F.substring(normal, 1, head))
    return F.array_join(F.slice(F.when(F.size(first) > 8, first).otherwise(words(normal)), 1, 8), " ")


def jaccard(a: Column, b: Column) -> Column:
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def conflict(a: Column, b: Column) -> Column:
    """Whether token sets tell of different events: another number, entity or direction."""
    differ = F.concat(F.array_except(a, b), F.array_except(b, a))
    tells = F.exists(differ, lambda t: t.rlike("[0-9]") | t.isin(*ENTITIES))
    has = lambda s, words: F.arrays_overlap(s, F.array(*map(F.lit, words)))
    rises = lambda s: has(s, UP) & ~has(s, DOWN)
    falls = lambda s: has(s, DOWN) & ~has(s, UP)
    return tells | (rises(a) & falls(b)) | (falls(a) & rises(b))


def telling(tokens: Column) -> tuple[Column, Column]:
    """What conflict() compares: the sorted tokens that tell events apart, and 1 for a rise, -1 for a fall, else 0.

    Token sets conflict exactly if the first differ or the second are opposite.
    """
    has = lambda words: F.arrays_overlap(tokens, F.array(*map(F.lit, words)))
    way = F.when(has(UP) & ~has(DOWN), 1).when(has(DOWN) & ~has(UP), -1).otherwise(0)
    return F.sort_array(F.array_distinct(F.filter(tokens, lambda t: t.rlike("[0-9]") | t.isin(*ENTITIES)))), way


def should_merge(key_a: Column, key_b: Column, set_a: Column, set_b: Column, least: float = 0.70) -> Column:
    """struct(merge, score): the same key or alike enough, and no conflict."""
    score = jaccard(key_set(key_a), key_set(key_b))
    merge = ((key_a == key_b) | (score >= least)) & ~conflict(set_a, set_b)
    return F.struct(merge.alias("merge"), F.when(merge & (key_a == key_b), 1.0).otherwise(score).alias("score"))


def language_code(name: Column) -> Column:
    """The code of a language's name or code; other names as they are, to 16 characters; `unknown` for none."""
    known = F.create_map(*[F.lit(x) for code, n in LANGUAGES.items() for k in (n, code) for x in (k, code)])
    clean = F.lower(F.btrim(name))
    return F.when(clean.isNull() | (clean == ""), "unknown").otherwise(F.coalesce(F.try_element_at(known, clean), F.substring(clean, 1, 16)))


def canonical_url(url: Column) -> Column:
    """Lower-case scheme and host, no trailing slash, fragment or tracking; other parameters sorted."""
    raw = F.btrim(url)
    scheme = F.lower(F.regexp_extract(raw, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    host = F.lower(F.regexp_extract(raw, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    path = F.regexp_replace(F.regexp_extract(raw, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1), "/+$", "")
    params = F.split(F.regexp_extract(raw, r"^[^?#]*\?([^#]*)", 1), "&")
    keep = F.array_sort(F.filter(params, lambda p: p.rlike("^[^=]+=.") & ~F.lower(p).rlike("^(utm_[^=]*|" + "|".join(TRACKING) + ")=")))
    query = F.array_join(keep, "&")
    return F.when(raw == "", "").otherwise(F.concat(F.when(scheme == "", "https").otherwise(scheme), F.lit("://"), host, path, F.when(query == "", "").otherwise(F.concat(F.lit("?"), query))))


#: How the names of tracking parameters begin, for the normaliser that keeps the order.
TRACKING_PREFIXES = ("utm_", "oc", "ref", "src", "fbclid", "gclid")


def plain_url(url: Column) -> Column:
    """Lower-case scheme and host, no trailing slash, fragment or tracking; other parameters in their order.

    Parameters without a value go; percent-encodings stay as they are.
    """
    raw = F.btrim(url)
    scheme = F.lower(F.regexp_extract(raw, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    host = F.lower(F.regexp_extract(raw, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    path = F.regexp_replace(F.regexp_extract(raw, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1), "/+$", "")
    params = F.split(F.regexp_extract(raw, r"^[^?#]*\?([^#]*)", 1), "&")
    query = F.array_join(F.filter(params, lambda p: p.rlike("^[^=]+=.") & ~F.lower(p).rlike(f"^(?:{'|'.join(TRACKING_PREFIXES)})")), "&")
    out = F.concat(scheme, F.lit("://"), host, path, F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))
    return F.when(scheme == "", F.lower(raw)).otherwise(out)


def plain_title(title: Column) -> Column:
    """Lower case, without the publisher behind a dash and without punctuation, white space squeezed."""
    text = F.lower(F.btrim(title, F.lit(" \t\n\x0b\f\r")))
    text = F.regexp_replace(text, r"[ \t\n\x0b\f\r]+[-|–—][ \t\n\x0b\f\r]+[A-Za-z0-9 \t\n\x0b\f\r.&]+$", "")
    text = F.regexp_replace(text, r"[^\p{L}\p{N}_ \t\n\x0b\f\r]", "")
    return F.btrim(F.regexp_replace(text, _SPACES, " "))


def json_rows(html: Column, name: str, schema: str) -> Column:
    """The rows of every JSON array that a page's scripts assign to `name`; what doesn't parse is left out."""
    found = F.regexp_extract_all(html, F.lit(rf"(?s)\b{name}\s*=\s*(\[\s*\{{.*?\}}\s*\])"), F.lit(1))
    return F.flatten(F.filter(F.transform(found, lambda x: F.from_json(x, f"array<struct<{schema}>>")), lambda x: x.isNotNull()))


def fingerprint(title: Column, host: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", normal_headline(title), host).cast("binary"), 256), 1, 32)


def joined_hash(*parts: Column, length: int = 64, sep: str = "|") -> Column:
    """The first characters of the SHA-256 of the parts; a null part counts as empty."""
    return F.substring(F.sha2(F.concat_ws(sep, *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]).cast("binary"), 256), 1, length)


def single_story_id(title: Column, ts: Column, version: str = "v1", days: int = 2) -> Column:
    """An id of one headline in its window of days, whatever its word order."""
    window = F.floor(F.unix_micros(ts.cast("timestamp")) / (days * 86_400_000_000))
    return F.concat(F.lit("clu_"), joined_hash(F.lit(version), window, signature(title), length=16))
