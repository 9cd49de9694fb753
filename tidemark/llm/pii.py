"""Personal data: patterns with checks, and a semi-Markov conditional random field around them.

The field scores whole candidate segments of up to MOST_TOKENS tokens: the classes of all their
tokens, digits, separators, checksums and the words around them. A dynamic programme finds the
best boundaries and types together; what the patterns have found is clamped and splits a text,
and the field decides about the stretches between.

The segment bound is the only limit. A segment of ordinary words and punctuation only, without a
cue such as `password =` right before it, is an entity in no training sentence, so its likeliest
weight is minus infinity; stretches of such tokens are therefore passed over without a loss.

The weights are fitted here, by likelihood, on generated sentences from a fixed seed; no
document is read for it.
"""

from __future__ import annotations

import functools
import hashlib
import ipaddress
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import body

KINDS = ("email", "ip", "card", "phone")
#: The field's types; "other" is one token that belongs to no entity.
TYPES = ("other", "email", "ip", "card", "phone", "ssn", "iban", "secret")
MOST_TOKENS = 16

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A run of digits can only match from its start, so the look-behind changes no match.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
#: A token takes the white space before it along.
_TOKEN = re.compile(r"\s*(?:[^\W_]+|[^\w\s]|_)")
#: A word that opens a secret, with `:` or `=` and perhaps a quote between.
OPENERS = frozenset("password passwd pwd passphrase token key apikey secret credential credentials bearer".split())
#: Words near a number that say what it is.
CUES = OPENERS | frozenset(
    "api auth ssn social security phone tel telephone call mobile fax cell whatsapp card visa mastercard credit iban account bank email mail contact write "
    "ip host server address ping isbn issn order invoice ref reference tracking ticket case part serial commit revision sha sha1 sha256 md5 hash checksum "
    "digest version id uuid doi number no total price".split()
)
_INSIDE = frozenset("at dot com org net edu gov io info sk ghp gho xoxb pk proj live test".split())
#: Classes that say nothing by themselves; all punctuation but the at-sign is quiet too.
_QUIET_WORDS = frozenset({"a", "A", "at", *CUES, "proj", "live", "test", "info"})

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each kind's pattern; those that fail their check are dropped."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (host := _HOST.match(text, at + 1)):
            end = host.end()
            out.append(("email", start, end))
        at = text.find("@", max(at + 1, end))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if len(m[0]) >= 13 and 13 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return out


def token_class(token: str) -> str:
    """A token's class: a space if one stands before it, then a cue word itself or what it is made of."""
    word = token.lstrip()
    low, n = word.lower(), len(word)
    if low in CUES or low in _INSIDE:
        name = low
    elif word.isdigit():
        name = f"9{min(n, 24)}"
    elif word.isalpha():
        hexes = "x" if set(low) <= set("abcdef") else ""
        name = f"L{min(n // 8, 8)}{hexes}" if n >= 16 else "jwt" if word[:3] == "eyJ" and n >= 10 else "a" if word[0] == low[0] else "A"
    elif word.isalnum():
        case = "u" if word == word.upper() else "l" if word == low else "b"
        if re.fullmatch(r"[A-Z]{2}[0-9]{2}[A-Z0-9]*", word):
            name = f"i{min(n // 4, 8)}"
        elif re.fullmatch(r"A[KS]IA[A-Z0-9]{16}", word):
            name = "akia"
        elif word[:3] == "eyJ" and n >= 10:
            name = "jwt"
        else:
            name = f"m{min(n // 4, 10)}{'x' if re.fullmatch(r'[0-9a-fA-F]+', word) else ''}{case}"
    else:
        name = word
    return " " + name if word != token else name


def _quiet(name: str) -> bool:
    """Whether a class can't make a segment an entity. A bare `at`, without a space, is `(at)` or `[at]`."""
    word = name.lstrip()
    return name != "at" and (word in _QUIET_WORDS or len(word) == 1 and not word.isalnum() and word != "@")


class _Classes(dict):
    """Tokens -> numbers of classes, quiet ones below zero; forgets its tokens beyond a bound."""

    def __init__(self) -> None:
        self.names: list[str] = []
        self.numbers: dict[str, int] = {}

    def __missing__(self, token: str) -> int:
        if len(self) > 300_000:
            self.clear()
        name = token_class(token)
        n = self.numbers.get(name)
        if n is None:
            n = self.numbers[name] = len(self.names) + 1
            self.names.append(name)
        self[token] = n = -n if _quiet(name) else n
        return n


def _opened(names: list[str] | tuple[str, ...], i: int) -> bool:
    """Whether a cue that opens a secret stands right before token i."""
    k = i - 1
    if k >= 0 and names[k].lstrip() in ("'", '"', "`"):
        k -= 1
    return k > 0 and names[k].lstrip() in (":", "=") and (names[k - 1].lstrip() in OPENERS or k > 1 and names[k - 1].lstrip() in ("'", '"') and names[k - 2].lstrip() in OPENERS)


@functools.lru_cache(200_000)
def _static(names: tuple[str, ...]) -> list[str]:
    """Features of the classes of a segment's tokens, whatever stands around it."""
    names = (names[0].lstrip(), *names[1:])
    k, bare = len(names), [n.lstrip() for n in names]
    digits = sum(int(n[1:]) for n in bare if n[0] == "9" and len(n) > 1)
    shape = "".join(names)
    coarse = re.sub(r"(?: ?[aA])+", "a", re.sub(r"9[0-9]+", "9", shape))
    seps = "".join(sorted({n for n in bare if len(n) == 1 and not n.isalnum()} | ({" "} if any(n[0] == " " for n in names[1:]) else set())))
    out = ["bias", f"tokens:{k}", f"digits:{digits}", f"first:{bare[0]}", f"last:{bare[-1]}", f"ends:{bare[0]}|{bare[-1]}", f"seps:{seps}", f"coarse:{coarse[:40]}"]
    if k <= 12:
        out.append(f"shape:{shape}")
    if k == 1:
        out.append(f"alone:{bare[0]}")
    if not digits and all(n[0] not in "mi" for n in bare):
        out.append("no digits")
    for n in set(bare):
        if n in _INSIDE or n in ("akia", "jwt", "@") or n[0] in "Li" and len(n) > 1:
            out.append(f"has:{n}")
    if any(n[0] == "i" and len(n) > 1 for n in bare[1:]) or any(n in ("akia", "jwt") for n in bare[1:]):
        out.append("head inside")
    return out


def _checked(names: tuple[str, ...]) -> bool:
    """Whether _value_features may say something of a segment of these classes."""
    bare = [n.lstrip() for n in names]
    return sum(int(n[1:]) for n in bare if n[0] == "9" and len(n) > 1) >= 13 or bare[0][0] == "i" and len(bare[0]) > 1 or bare.count(":") >= 2


def _value_features(names: tuple[str, ...], value: str) -> list[str]:
    """What checksums and parsers say of a segment's text, where its classes call for one."""
    out, first = [], names[0].lstrip()
    digits = _digits(value)
    if len(digits) >= 13 and not re.search(r"[^\d .-]", value):
        out.append(f"luhn:{luhn(digits)}:{len(digits) == 16}")
        if len(digits) == 13 and digits[:3] in ("978", "979"):
            out.append("isbn")
    if first[0] == "i" and len(first) > 1:
        solid = value.replace(" ", "")
        valid = 15 <= len(solid) <= 34 and solid.isalnum() and solid.isascii() and int("".join(str(int(c, 36)) for c in solid[4:] + solid[:4])) % 97 == 1
        out.append(f"iban:{valid}")
    if value.count(":") >= 2 and re.fullmatch(r"[0-9a-fA-F:]+", value):
        try:
            out.append(f"ip6:{ipaddress.ip_address(value).version == 6}")
        except ValueError:
            out.append("ip6:False")
    return out


def _around(names: list[str] | tuple[str, ...], i: int) -> list[str]:
    """Features of what stands before token i."""
    one = names[i - 1].lstrip() if i else "^"
    two = names[i - 2].lstrip() if i > 1 else "^"
    cue = next((names[k].lstrip() for k in range(i - 1, max(-1, i - 6), -1) if names[k].lstrip() in CUES), "none")
    return [f"before:{one}", f"pair:{two} {one}", f"cue:{cue}", f"spaced:{i == 0 or i < len(names) and names[i][0] == ' '}", f"opened:{_opened(names, i)}"]


def _after(names: list[str] | tuple[str, ...], j: int) -> list[str]:
    return [f"after:{names[j]}" if j < len(names) else "after:$"]


class Field:
    """Weights by feature and type, and whether an entity follows another directly."""

    def __init__(self, rows: dict[str, int], weights: np.ndarray, follows: float) -> None:
        self.rows, self.follows = rows, follows
        self.weights = np.vstack([weights, np.zeros((1, len(TYPES)))])
        self.known: dict[tuple[str, ...], int] = {}
        self.table = np.zeros((1024, len(TYPES)))

    def _sum(self, features: list[str]) -> np.ndarray:
        return self.weights[[self.rows.get(f, -1) for f in features]].sum(axis=0)

    def _of(self, names: tuple[str, ...]) -> int:
        """Where the table has the score of a segment's classes; below zero if its text counts too."""
        at = self.known.get(names)
        if at is None:
            at = len(self.known) + 1
            if at == len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            self.table[at] = self._sum(_static(names))
            self.known[names] = at = -at if _checked(names) else at
        return at

    def _scores(self, text: str, names: tuple[str, ...], starts: list[int], ends: list[int], lo: int, hi: int) -> tuple[list[float], list[list[tuple[int, float, int]]]]:
        """Of each token its score as other, and its segments: end, best type's score, type."""
        if len(self.known) > 200_000:
            self.known.clear()
        n, top = hi - lo, len(names)
        left = np.stack([self._sum(_around(names, i)) for i in range(lo, hi)])
        last = min(top, hi + MOST_TOKENS)
        right = np.stack([self._sum(_after(names, j)) for j in range(lo + 1, last + 1)])
        whose, until, at, more = [], [], [], []
        far = [0] * (last - lo + 1)
        far[-1] = last
        for i in range(last - 1, lo - 1, -1):
            far[i - lo] = far[i - lo + 1] if _quiet(names[i]) else i
        for i in range(lo, hi):
            for j in range(i + 1 if _opened(names, i) else far[i - lo] + 1, min(top, i + MOST_TOKENS) + 1):
                seg = names[i:j]
                k = self._of(seg)
                if k < 0:
                    k = -k
                    more.append((len(at), self._sum(_value_features(seg, text[starts[i] : ends[j - 1]]))))
                whose.append(i - lo)
                until.append(j - lo)
                at.append(k)
        zero = (self.table[[abs(self._of(names[i : i + 1])) for i in range(lo, hi)], 0] + left[:, 0] + right[:n, 0]).tolist()
        segments: list[list[tuple[int, float, int]]] = [[] for _ in range(n)]
        if at:
            by_type = self.table[at] + left[whose] + right[np.array(until) - 1]
            for k, extra in more:
                by_type[k] += extra
            kinds = 1 + by_type[:, 1:].argmax(axis=1)
            for i, j, s, kind in zip(whose, until, by_type[np.arange(len(at)), kinds].tolist(), kinds.tolist()):
                segments[i].append((j, s, kind))
        return zero, segments

    def best(self, text: str, names: list[str], starts: list[int], ends: list[int], lo: int, hi: int) -> list[Span]:
        """The best segmentation of tokens lo to hi - 1, without its other tokens. names: classes of all tokens."""
        whole = tuple(names)
        n, least = hi - lo, float("-inf")
        score = [[least, least] for _ in range(n + 1)]
        score[0][0] = 0.0
        back: list[list[tuple]] = [[(), ()] for _ in range(n + 1)]
        for first in range(0, n, 2048):
            zeros, segments = self._scores(text, whole, starts, ends, lo + first, min(hi, lo + first + 2048))
            for i, (other, some) in enumerate(zip(zeros, segments), first):
                zero, one = score[i]
                if (s := max(zero, one) + other) > score[i + 1][0]:
                    score[i + 1][0], back[i + 1][0] = s, (i, int(one > zero), 0)
                enter, e = (zero, 0) if zero >= one + self.follows else (one + self.follows, 1)
                for j, by_type, kind in some:
                    if first + j <= n and (s := enter + by_type) > score[first + j][1]:
                        score[first + j][1], back[first + j][1] = s, (i, e, kind)
        out, j = [], n
        e = int(score[n][1] > score[n][0])
        while j:
            i, e_before, kind = back[j][e]
            if kind:
                out.append((TYPES[kind], starts[lo + i], ends[lo + j - 1]))
            j, e = i, e_before
        return out[::-1]


def _generated(n: int, seed: int) -> list[tuple[str, list[Span]]]:
    """Sentences with entities, and with numbers and words that are none."""
    rng = random.Random(seed)
    pick = rng.choice
    number = lambda k: "".join(pick("0123456789") for _ in range(k))
    word = lambda: "".join(pick(["th", "an", "er", "on", "re", "la", "de", "ci", "mo", "st", "ü", "é"]) for _ in range(rng.randint(1, 5)))
    hexes = lambda k: "".join(pick("0123456789abcdef") for _ in range(k))
    mixed = lambda k: "".join(pick("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(k))
    upper = lambda k: "".join(pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(k))
    letters = lambda k: "".join(pick("abcdefghijklmnopqrstuvwxyz") for _ in range(k))

    def grouped(d: str, sep: str, k: int = 4) -> str:
        return sep.join(d[i : i + k] for i in range(0, len(d), k))

    def checked(sizes: list[int], good: bool) -> str:
        while luhn(d := pick("123456789") + number(pick(sizes) - 1)) != good:
            pass
        return d

    def iban() -> str:
        country, account = pick(["DE", "FR", "ES", "GB", "NL", "IT", "CH"]), pick([number(18), upper(4) + number(14), number(20), upper(4) + number(10)])
        check = 98 - int("".join(str(int(c, 36)) for c in account + country + "00")) % 97
        return pick([f"{country}{check:02}{account}", grouped(f"{country}{check:02}{account}", " ")])

    def ip() -> str:
        if rng.random() < 0.5:
            return pick([".", ".", "[.]"]).join(str(rng.randint(0, 255)) for _ in range(4))
        group = lambda: hexes(rng.randint(1, 4))
        return pick([":".join(hexes(4) for _ in range(8)), ":".join(group() for _ in range(8)), f"{pick(['2001', 'fe80', 'fd00'])}::{group()}:{group()}", f"2001:db8:{group()}::{group()}", f"{pick(['fe80', '2001'])}::{group()}"])

    def email() -> str:
        at = pick(["@", " (at) ", " [at] ", " at ", "(at)", "[at]"])
        dot = pick([".", ".", " dot ", " (dot) ", " [dot] "])
        return f"{word()}{pick(['', '.' + number(2), '.' + word(), number(2)])}{at}{word()}{pick(['', number(1)])}{dot}{pick(['com', 'org', 'net', 'io', 'edu'])}"

    def phone() -> str:
        area = pick("23456789") + number(2)
        return pick([
            f"+{number(1)} ({number(3)}) {number(3)}-{number(4)}", f"({area}) {number(3)}-{number(4)}", f"{area}-{number(3)}-{number(4)}", f"{area}.{number(3)}.{number(4)}", f"{area} {number(3)} {number(4)}", f"1-8{pick(['00', '88', '77'])}-{number(3)}-{number(4)}",
            f"0{pick('123456789')}" + "".join(f" {number(2)}" for _ in range(4)), f"0{number(2)} {number(8)}", f"0{number(3)} {number(7)}", f"0{number(3)}/{number(6)}", f"0{number(4)} {number(6)}", f"00{number(2)} {number(3)} {number(7)}", f"({area}){number(3)}-{number(4)}", f"0{number(2)}-{number(7)}", f"0{number(2)} {number(4)} {number(4)}",
        ])

    def secret() -> tuple[str, str, str]:
        """What stands before it, the value, what stands behind."""
        if rng.random() < 0.4:
            return "", pick([f"sk-{mixed(40)}", f"sk-proj-{mixed(24)}", f"sk_{pick(['live', 'test'])}_{mixed(24)}", f"ghp_{mixed(36)}", f"AKIA{upper(16)}", f"xoxb-{number(11)}-{mixed(24)}", f"eyJ{mixed(30)}.eyJ{mixed(40)}.{mixed(40)}"]), ""
        value = pick([hexes(32), hexes(40), hexes(64), mixed(20), mixed(32), mixed(40), f"{word()}{number(1)}!", f"{word()}{number(3)}", f"{word().title()}{number(2)}#", letters(rng.randint(6, 12)), letters(rng.randint(6, 15)), letters(rng.randint(16, 40)), f"{letters(6)}-{letters(5)}", f"sk-{mixed(30)}", f"{mixed(15)}/{mixed(12)}+{mixed(10)}"])
        cue, quote = pick(["token", "key", "password", "secret", "api_key", "api key", "passwd", "auth_token", "secret_key", "Password", "API_KEY"]), pick(['"', "'", "", ""])
        return f"{cue}{pick([' = ', ': ', '=', ' : ', ':'])}{quote}", value, quote

    plain = [
        lambda: number(rng.randint(1, 8)), lambda: f"{rng.randint(1900, 2030)}-{number(2)}-{number(2)}", lambda: f"{number(2)}.{number(2)}.{rng.randint(1900, 2030)}", lambda: f"{number(1)}.{number(1)}.{number(2)}", lambda: f"version {number(1)}.{number(2)}.{number(1)}.{pick(['x', 'dev', 'rc1'])}", lambda: f"${number(3)}.{number(2)}", lambda: f"{number(3)},{number(3)}",
        lambda: f"{number(1)},{number(3)},{number(3)}.{number(2)}", lambda: f"({number(4)})", lambda: f"{word()}{number(3)}", lambda: checked([13, 14, 15, 16, 16, 16, 17, 18, 19], False), lambda: checked([13, 15, 16, 16, 17], False), lambda: grouped(checked([16], False), pick([" ", "-"])), lambda: number(rng.randint(9, 12)), lambda: number(rng.randint(20, 24)),
        lambda: f"{word()} at {word()}.", lambda: f"{word()} at {number(2)}:{number(2)}", lambda: f"{number(2)}:{number(2)}:{number(2)}", lambda: f"{word()} dot {word()}", lambda: f"{word()}.{pick(['com', 'org', 'net'])}", lambda: f"www.{word()}.com/{word()}", lambda: f"{number(3)} {number(3)}", lambda: f"{number(1)}/{number(2)}/{number(4)}", lambda: f"{number(2)}-{number(3)}",
        lambda: f"{pick(['isbn', 'ISBN', 'ISBN-13:'])} 978-{number(1)}-{number(2)}-{number(6)}-{number(1)}", lambda: f"978{number(10)}", lambda: f"978-{number(1)}-{number(3)}-{number(5)}-{number(1)}", lambda: f"{pick(['isbn', 'ISBN'])} {number(1)}-{number(3)}-{number(5)}-{pick(['X', number(1)])}", lambda: f"issn {number(4)}-{number(4)}",
        lambda: f"{pick(['order', 'invoice', 'ticket', 'tracking', 'case', 'part', 'reference', 'serial'])} {pick(['number', 'no', 'id', ''])} {pick([f'{number(3)}-{number(2)}-{number(4)}', f'{number(3)}-{number(7)}-{number(7)}', f'{number(3)}-{number(3)}-{number(4)}', number(10), f'{upper(3)}-{number(5)}', f'{number(4)}-{number(4)}', f'{number(3)} {number(3)} {number(4)}'])}",
        *[lambda: f"{pick(['order', 'invoice', 'ticket', 'case', 'part', 'serial'])} {pick(['number ', 'number ', 'no. ', 'id ', '#', ''])}{number(3)}-{number(2)}-{number(4)}"] * 3, lambda: f"{pick(['commit', 'revision', 'sha1', 'in commit', 'at commit'])} {hexes(40)}", lambda: f"{pick(['sha256', 'checksum', 'digest', 'md5', 'hash'])}{pick([' ', ': ', ' = ', ':'])}{hexes(pick([32, 64]))}", lambda: f"{hexes(7)}", lambda: "-".join(map(hexes, (8, 4, 4, 4, 12))),
        lambda: f"doi 10.{number(4)}/{number(6)}", lambda: f"{number(2)}.{number(4)}, {number(2)}.{number(4)}", lambda: f"{upper(2)}{number(2)}-{upper(3)}", lambda: f"{upper(2)}{number(2)}", lambda: f"{pick(['DE', 'FR', 'GB', 'A', 'SKU'])}{number(rng.randint(3, 18))}", lambda: mixed(rng.randint(8, 24)), lambda: hexes(pick([8, 12, 16])), lambda: ":".join(hexes(2) for _ in range(6)), lambda: f"{word()}::{word()}", lambda: f"std::{word()}",
        lambda: f"the {pick(['key', 'secret', 'token', 'password'])} {pick(['is', 'was', 'of', 'to'])} {word()} {word()}", lambda: f"{pick(['key', 'secret', 'token'])} {word()}", lambda: f"the {pick(['key', 'secret'])}: {word()} {word()} {word()}", lambda: word().title() + "".join(word() for _ in range(rng.randint(3, 6))), lambda: "".join(word() for _ in range(rng.randint(4, 6))).upper(), lambda: letters(rng.randint(16, 24)).upper() + pick(["", "!!", ","]), lambda: f"{word()}, {word()}; ({word()})", lambda: f"{rng.randint(1900, 2030)}-{rng.randint(1900, 2030)}", lambda: f"{number(2)} {number(2)} {number(2)}", lambda: f"{number(1)} 000 000", lambda: f"{number(1)}.{number(3)}.{number(3)}", lambda: f"{pick(['total', 'price', 'number', 'no', 'id'])} {number(rng.randint(4, 10))}",
    ]
    before = {
        "email": ["email", "write to", "contact", "mail:", ""], "ip": ["ip", "host", "ping", "server", "address", "", ""], "card": ["card", "visa", "credit card number", "paid with", "", ""], "phone": ["call", "tel", "phone:", "tel.", "mobile", "fax", "", "", ""],
        "ssn": ["ssn", "SSN:", "social security number", "", ""], "iban": ["iban", "IBAN:", "account", "bank account", "", ""],
    }
    makers = {"email": email, "ip": ip, "card": lambda: pick(["", " ", "-", "."]).join(grouped(checked([16], True), " ").split(" ")), "phone": phone, "ssn": lambda: f"{number(3)}-{number(2)}-{number(4)}", "iban": iban}
    kinds = ["email", "ip", "card", "phone", "phone", "ssn", "iban", "secret", "secret", "secret"]
    out = []
    for _ in range(n):
        text, spans = "", []
        for _ in range(rng.randint(2, 3)):
            if text or rng.random() < 0.8:
                text += " ".join(word() if rng.random() < 0.9 else word().title() for _ in range(rng.randint(1, 4))) + " "
            if rng.random() < 0.5:
                kind = pick(kinds)
                lead, value, tail = secret() if kind == "secret" else (f"{lead} " if (lead := pick(before[kind])) else "", makers[kind](), "")
                text += lead
                spans.append((kind, len(text), len(text) + len(value)))
                text += value + tail
            else:
                text += pick(plain)()
            text += pick([" ", " ", ", ", ". ", "; ", ") "])
        out.append((text + word() + ".", spans))
    return out


def _tokens(text: str) -> tuple[list[str], list[int], list[int]]:
    """Tokens with the space before them, and where their words start and end."""
    found = _TOKEN.findall(text.rstrip())
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))
    starts = ends - np.fromiter((len(t.lstrip()) for t in found), np.int64, len(found))
    return found, starts.tolist(), ends.tolist()


@functools.cache
def fitted(sentences: int = 1000, rounds: int = 6, seed: int = 11) -> Field:
    """Weights by gradient ascent on the likelihood of generated sentences (AdaGrad, L2)."""
    rows: dict[str, int] = {}
    lattices = []  # for each sentence: tokens, features of each segment, starts, which may be entities, gold
    for text, spans in _generated(sentences, seed):
        found, starts, ends = _tokens(text)
        names, n = [token_class(t) for t in found], len(found)
        gold = {(s, e): TYPES.index(k) for k, s, e in spans}
        inside = [any(s < b and a < e for _, s, e in spans) for a, b in zip(starts, ends)]
        hot, opened = [not _quiet(x) for x in names], [_opened(names, i) for i in range(n)]
        features: list[list[int]] = []
        may, want = [], []
        for i in range(n):
            left = _around(names, i)
            for j in range(i + 1, min(n, i + MOST_TOKENS) + 1):
                seg = tuple(names[i:j])
                features.append([rows.setdefault(f, len(rows)) for f in (*_static(seg), *left, *_after(names, j), *_value_features(seg, text[starts[i] : ends[j - 1]]))] if opened[i] or any(hot[i:j]) or j == i + 1 else [rows.setdefault("bias", len(rows))])
                may.append(opened[i] or any(hot[i:j]))
                want.append(gold.get((starts[i], ends[j - 1]), 0 if j == i + 1 and not inside[i] else -1))
        lattices.append((n, features, np.array(may), np.array(want)))
    # Features of no gold segment that are rare anywhere have no weight.
    times, good = np.zeros(len(rows), np.int64), np.zeros(len(rows), bool)
    for _, features, _, want in lattices:
        for f, w in zip(features, want.tolist()):
            times[f] += 1
            if w > 0:
                good[f] = True
    kept = np.flatnonzero(good | (times >= 10))
    place = np.full(len(rows), -1)
    place[kept] = np.arange(len(kept))
    rows = {f: int(place[i]) for f, i in rows.items() if place[i] >= 0}
    place = place.tolist()
    lattices = [(n, [[place[x] for x in f if place[x] >= 0] for f in features], may, want) for n, features, may, want in lattices]
    weights, seen = np.zeros((len(rows), len(TYPES))), np.full((len(rows), len(TYPES)), 1e-6)
    follows, follows_seen, batch = 0.0, 1e-6, 25
    packed = []
    for at in range(0, len(lattices), batch):
        some = lattices[at : at + batch]
        every = [f for _, features, *_ in some for f in features]
        sizes = np.fromiter(map(len, every), np.int64, len(every))
        packed.append((some, np.fromiter((x for f in every for x in f), np.int64, int(sizes.sum())), np.cumsum(sizes) - sizes, np.repeat(np.arange(len(every)), sizes), np.concatenate([m for *_, m, _ in some]), np.concatenate([w for *_, w in some])))
    for _ in range(rounds):
        for some, flat, starts_at, owner, may, want in packed:
            scores = np.add.reduceat(weights[flat], starts_at)
            top = scores[:, 1:].max(axis=1)
            entity = np.where(may, top + np.log(np.exp(scores[:, 1:] - top[:, None]).sum(axis=1)), -np.inf)
            gradient = np.zeros_like(scores)
            together, r = 0.0, 0
            for n, features, *_ in some:
                first_row, alpha, beta = r, np.full((n + 1, 2), -np.inf), np.full((n + 1, 2), -np.inf)
                alpha[0, 0], beta[n] = 0.0, 0.0
                row_of = [0] * (n + 1)
                for i in range(n):
                    row_of[i] = r
                    m = min(n - i, MOST_TOKENS)
                    enter = np.logaddexp(alpha[i, 0], alpha[i, 1] + follows)
                    alpha[i + 1, 0] = np.logaddexp(alpha[i, 0], alpha[i, 1]) + scores[r, 0]
                    alpha[i + 1 : i + 1 + m, 1] = np.logaddexp(alpha[i + 1 : i + 1 + m, 1], enter + entity[r : r + m])
                    r += m
                for i in range(n - 1, -1, -1):
                    q, m = row_of[i], min(n - i, MOST_TOKENS)
                    on = np.logaddexp.reduce(entity[q : q + m] + beta[i + 1 : i + 1 + m, 1])
                    step = scores[q, 0] + beta[i + 1, 0]
                    beta[i] = np.logaddexp(step, on), np.logaddexp(step, on + follows)
                total = np.logaddexp(alpha[n, 0], alpha[n, 1])
                for i in range(n):
                    q, m = row_of[i], min(n - i, MOST_TOKENS)
                    enter, later = np.logaddexp(alpha[i, 0], alpha[i, 1] + follows), beta[i + 1 : i + 1 + m, 1] - total
                    gradient[q, 0] -= np.exp(np.logaddexp(alpha[i, 0], alpha[i, 1]) + scores[q, 0] + beta[i + 1, 0] - total)
                    gradient[q : q + m, 1:] -= np.where(may[q : q + m, None], np.exp(scores[q : q + m, 1:] + (enter + later)[:, None]), 0.0)
                    together -= float(np.exp(alpha[i, 1] + follows + entity[q : q + m] + later).sum())
            gold_rows = np.flatnonzero(want >= 0)
            gradient[gold_rows, want[gold_rows]] += 1
            step = np.stack([np.bincount(flat, gradient[owner, t], len(rows)) for t in range(len(TYPES))], axis=1) - 2e-3 * weights
            seen += step * step
            weights += 0.5 * step / np.sqrt(seen)
            follows_seen += together * together
            follows += 0.5 * together / np.sqrt(follows_seen)
    return Field(rows, weights, follows)


def find(text: str, field: Field, classes: _Classes | None = None, chunk: int = 1 << 20) -> tuple[list[Span], list[Span]]:
    """The patterns' spans, and those that the field adds beside them.

    Texts are read in chunks of about `chunk` characters that end inside a long run of quiet
    tokens, where no segment can lie; without such a run a chunk grows until it has one.
    """
    classes = _Classes() if classes is None else classes
    base, added = base_spans(text), []
    taken = sorted((s, e) for _, s, e in base)
    at, size = 0, chunk
    while at < len(text):
        part = text if at == 0 and len(text) <= size else text[at : at + size]
        found = _TOKEN.findall(part.rstrip())  # white space at the end has no token
        ids = np.fromiter(map(classes.__getitem__, found), np.int64, len(found))
        stop = len(found)
        # Tokens that are not quiet, and those that an opener stands before.
        opens = [n for name, n in classes.numbers.items() if name.lstrip() in OPENERS]
        marks = np.flatnonzero((ids > 0) | np.isin(-ids, opens))
        if at + size < len(text):
            apart = np.diff(np.concatenate([[-1], marks, [len(found)]])) > 4 * MOST_TOKENS
            if not apart.any():
                size *= 2
                continue
            last = int(np.flatnonzero(apart)[-1])
            stop = int(np.concatenate([[-1], marks])[last]) + 2 * MOST_TOKENS + 1
            marks = marks[marks < stop]
        if len(marks):
            ends = at + np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))
            _regions(text, found, ids, ends, marks, stop, classes, taken, field, added)
        if stop == len(found) and at + size >= len(text):
            break
        at += sum(map(len, found[:stop]))
        size = chunk
    return base, added


def _regions(text: str, found: list[str], ids: np.ndarray, ends: np.ndarray, marks: np.ndarray, stop: int, classes: _Classes, taken: list[tuple[int, int]], field: Field, added: list[Span]) -> None:
    """Spans of the stretches around the marked tokens, between the taken spans."""
    reach, most = MOST_TOKENS, len(found)
    groups = np.split(marks, np.flatnonzero(np.diff(marks) > 2 * reach) + 1)
    for group in groups:
        lo, hi = max(0, int(group[0]) - reach), min(most, int(group[-1]) + reach + 1)
        ctx = max(0, lo - 6)
        names = [classes.names[abs(i) - 1] for i in ids[ctx : hi + 1].tolist()]
        tail = ends[ctx : hi + 1].tolist()
        heads = [e - len(t.lstrip()) for e, t in zip(tail, found[ctx : hi + 1])]
        a, b = lo - ctx, hi - ctx
        # Tokens of taken spans split the stretch.
        blocked = [False] * (b + 1)
        for s, e in taken[_first_after(taken, heads[0]) :]:
            if s >= tail[b - 1]:
                break
            for k in range(a, b):
                if heads[k] < e and s < tail[k]:
                    blocked[k] = True
        k = a
        while k < b:
            if blocked[k]:
                k += 1
                continue
            m = k
            while m < b and not blocked[m]:
                m += 1
            if any(not _quiet(n) or n.lstrip() in OPENERS for n in names[max(0, k - 6) : m]):
                added += field.best(text, names, heads, tail, k, m)
            k = m


def _first_after(taken: list[tuple[int, int]], at: int) -> int:
    """The first of the sorted spans that may reach beyond `at`: spans of one kind don't overlap, of four kinds few do."""
    from bisect import bisect_left

    i = bisect_left(taken, (at, at))
    while i > 0 and any(e > at for _, e in taken[max(0, i - 4) : i]):
        i -= 1
    return i


def _joined(spans: list[Span], kinds: tuple[str, ...]) -> str:
    order = {k: i for i, k in enumerate(kinds)}
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (order[x[0]], x[1], x[2])))


SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, added array<struct<kind:string,start:long,end:long>>"


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, added.

    The counts and base_sha256 are those of the patterns' spans, kind:start:end by kind and
    start, comma-joined, in code points, end exclusive; spans joins all spans likewise, and
    added has the field's own, which never touch one of the patterns. Null and empty texts have
    no spans. Whole texts are read; spans of different kinds may overlap. Repeated rows are
    rows of their own; an empty table gives no rows.
    """
    kinds = (*KINDS, *(t for t in TYPES[1:] if t not in KINDS))
    field = docs.sparkSession.sparkContext.broadcast(fitted())
    struct = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
    types = [*[pa.int64()] * 4, pa.string(), pa.string(), pa.list_(struct)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = _Classes()
        for b in batches:
            rows = []
            for text in b.column(1):
                base, added = find(text.as_py(), field.value, classes)
                rows.append((*(sum(k == x[0] for x in base) for k in KINDS), hashlib.sha256(_joined(base, kinds).encode()).hexdigest(), _joined(base + added, kinds), [dict(zip(("kind", "start", "end"), x)) for x in added]))
            if rows:
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(zip(*rows), types))], [x.split()[0] for x in re.split(r", (?![^<]*>)", SCHEMA)])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), body(text_col).alias("text")).mapInArrow(run, SCHEMA)
