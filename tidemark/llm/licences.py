"""Licence scans: a generalised suffix automaton of licence wording, read word by word.

All templates' words make one automaton. A text's words run through it once; at each word the
state and its length are the longest stretch ending there that occurs in some template (the
matching statistics). Where a template stops following, its stretch ends. A dynamic programme
chains each template's stretches in the order of both texts, and a chain that covers enough of
its template is a licence span; where spans of several labels lie on each other, the one with
most words of its template stays, so that words such as `lesser` decide. Short phrases are
templates that must match whole; each place where they end is counted.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .licence_texts import TEMPLATES
from .shared import LOWER, UPPER, body

#: Phrase -> label.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Every byte that is no part of a word becomes a space; A-Z becomes a-z.
_TO_WORDS = bytes(ord(LOWER[UPPER.index(chr(b))]) if chr(b) in UPPER else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


@dataclass
class Scan:
    n_words: int
    phrases: list[tuple[int, str]]  # start, label
    spans: list[tuple[int, int, str, float]]  # start, end (exclusive), label, share of the template covered


class Automaton:
    """The suffix automaton of several word sequences."""

    def __init__(self, sequences: list[list[int]]) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[set[tuple[int, int]]] = [set()]  # (sequence, end) of the longest word sequence of the state
        for n, words in enumerate(sequences):
            last = 0
            for i, w in enumerate(words):
                last = self._extend(last, w)
                self.ends[last].add((n, i + 1))
        for v in sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True):
            self.ends[self.link[v]] |= self.ends[v]

    def _state(self, length: int, like: int | None = None) -> int:
        self.next.append({} if like is None else dict(self.next[like]))
        self.link.append(0 if like is None else self.link[like])
        self.length.append(length)
        self.ends.append(set())
        return len(self.link) - 1

    def _split(self, p: int, w: int, q: int) -> int:
        """A state of its own for what ends at q and is no longer than p and w."""
        copy = self._state(self.length[p] + 1, q)
        self.link[q] = copy
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, w: int) -> int:
        known = self.next[last].get(w)
        if known is not None:
            return known if self.length[known] == self.length[last] + 1 else self._split(last, w, known)
        new, p = self._state(self.length[last] + 1), last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, w, q)
        return new


class Scanner:
    def __init__(self, phrases: dict[str, str], templates: tuple[tuple[str, str], ...], least: int = 3, gap: int = 6, cover: float = 0.7, whole: int = 12) -> None:
        self.least, self.gap = least, gap
        texts = [words.decode().split() for t in (*phrases, *(t for _, t in templates)) if (words := t.encode().translate(_TO_WORDS))]
        self.labels = [*phrases.values(), *(label for label, _ in templates)]
        self.n_phrases, self.sizes = len(phrases), [len(t) for t in texts]
        self.needed = [n if n < whole else cover * n for n in self.sizes]
        self.words = {w: i for i, w in enumerate(dict.fromkeys(w.encode() for t in texts for w in t))}
        a = self.automaton = Automaton([[self.words[w.encode()] for w in t] for t in texts])
        # By state: the lengths and numbers of the phrases that are suffixes of its longest stretch.
        self.whole: list[list[tuple[int, int]]] = [[] for _ in a.ends]
        for v in sorted(range(1, len(a.ends)), key=a.length.__getitem__):
            own = [(end, n) for n, end in sorted(a.ends[v]) if n < self.n_phrases and end == self.sizes[n] == a.length[v]]
            self.whole[v] = own + self.whole[a.link[v]]
        self.long = [[(n, end) for n, end in sorted(e) if n >= self.n_phrases] for e in a.ends]

    def scan(self, text: bytes) -> Scan:
        words = text.translate(_TO_WORDS).split()
        out = Scan(len(words), [], [])
        codes = np.fromiter((self.words.get(w, -1) for w in words), np.int32, len(words)) if not self.words.keys().isdisjoint(words) else np.array([], np.int32)
        known = np.flatnonzero(codes >= 0)
        if not len(known):
            return out
        breaks = np.flatnonzero(np.diff(known) > 1)
        matches: dict[int, list[tuple[int, int, int]]] = {}  # template -> end in the text, end in the template, words
        for first, last in zip(known[np.append(0, breaks + 1)].tolist(), known[np.append(breaks, len(known) - 1)].tolist()):
            if last > first or self._single():
                self._run(codes[first : last + 1].tolist(), first, out, matches)
        out.spans = self._resolved([x for n, stretches in matches.items() for x in self._chained(n, stretches)])
        return out

    def _single(self) -> bool:
        return self.least < 2 or 1 in self.sizes[: self.n_phrases]

    def _run(self, codes: list[int], first: int, out: Scan, matches: dict[int, list[tuple[int, int, int]]]) -> None:
        a, v, n = self.automaton, 0, 0
        follow, link, length = a.next, a.link, a.length

        def ended(v: int, n: int, at: int, on: set[tuple[int, int]]) -> None:
            """The stretches of n words that end at word `at`, but for those that go on."""
            for template, end in self.long[v]:
                if (template, end + 1) not in on:
                    matches.setdefault(template, []).append((at, end, n))

        for i, w in enumerate(codes, first + 1):
            if w in follow[v]:
                u = follow[v][w]
                if n >= self.least and len(self.long[u]) < len(self.long[v]):
                    ended(v, n, i - 1, set(self.long[u]))
                v, n = u, n + 1
            else:
                # All that ends here: the longest stretch's templates, then those of its shorter ends.
                seen: set[tuple[int, int]] = set()
                while v >= 0 and w not in follow[v]:
                    if n >= self.least:
                        ended(v, n, i - 1, seen)
                        seen.update((t, e + 1) for t, e in self.long[v])
                    v = link[v]
                    n = min(n, length[v]) if v >= 0 else 0
                if v >= 0:
                    if n >= self.least:
                        ended(v, n, i - 1, seen | set(self.long[follow[v][w]]))
                    v, n = follow[v][w], n + 1
                else:
                    v, n = 0, 0
            for size, phrase in self.whole[v]:
                if size <= n:
                    out.phrases.append((i - size, self.labels[phrase]))
        seen = set()
        while v > 0 and n >= self.least:
            ended(v, n, first + len(codes), seen)
            seen.update((t, e + 1) for t, e in self.long[v])
            v = link[v]
            n = min(n, length[v])

    def _chained(self, n: int, stretches: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int]]:
        """start, end, template, words covered: the best chains of a template that cover enough of it.

        A chain goes forward in text and template, over `gap` words of the text at most between
        stretches; words that two stretches share count once. Of chains that cover as much the
        shorter wins. Chains of one template do not overlap, best first.
        """
        order = sorted(set(stretches))
        best: list[tuple[int, int, int]] = []  # words covered, start, the stretch before
        first = 0
        longest = max(size for *_, size in order)
        for k, (end, at, size) in enumerate(order):
            own = (size, end - size, -1)
            while order[first][0] < end - longest - self.gap:
                first += 1
            for p in range(k - 1, first - 1, -1):
                last, reached, _ = order[p]
                if last < end - size - self.gap:
                    break
                over = max(0, last - (end - size), reached - (at - size))
                if last < end and reached < at and over < size and end - size + over - last <= self.gap:
                    covered, start, _ = best[p]
                    own = max(own, (covered + size - over, start, p))
            best.append(own)
        found: list[tuple[int, int, int, int]] = []
        taken = bytearray(order[-1][0])  # words of chains found
        for covered, start, end in sorted(((c, s, order[k][0]) for k, (c, s, _) in enumerate(best) if c >= self.needed[n]), key=lambda x: (-x[0], x[2] - x[1], x[1])):
            if taken.find(1, start, end) < 0:
                found.append((start, end, n, covered))
                taken[start:end] = b"\1" * (end - start)
        return found

    def _resolved(self, found: list[tuple[int, int, int, int]]) -> list[tuple[int, int, str, float]]:
        """Spans by place; one that lies half or more on a span with more of its own template goes.

        Identifiers of one expression (`A OR B`) share their lead-in and don't compete with each other.
        """
        kept: list[tuple[int, int, int, int]] = []
        # Kept spans by length class j (lengths from 2^j to below 2^(j+1)) and by start in steps of 2^(j+1). Spans of
        # a class share less than half with each other, so few start in one step.
        near: dict[tuple[int, int, bool], list[tuple[int, int]]] = {}
        classes: set[tuple[int, bool]] = set()
        for x in sorted(found, key=lambda x: (-x[3] * x[3] / self.sizes[x[2]], x)):
            start, end, named = x[0], x[1], self.labels[x[2]].endswith("-spdx")
            others = (y for j, of in classes if not (named and of) for at in range((start >> (j + 1)) - 1, ((end - 1) >> (j + 1)) + 1) for y in near.get((j, at, of), ()))
            if all(2 * (min(end, e) - max(start, s)) < min(end - start, e - s) for s, e in others):
                kept.append(x)
                j = (end - start).bit_length() - 1
                classes.add((j, named))
                near.setdefault((j, start >> (j + 1), named), []).append((start, end))
        return sorted((s, e, self.labels[n], min(1.0, c / self.sizes[n])) for s, e, n, c in kept)


@functools.lru_cache(maxsize=4)
def _scanner(phrases: tuple, templates: tuple, least: int, gap: int, cover: float, whole: int) -> Scanner:
    return Scanner(dict(phrases), templates, least, gap, cover, whole)


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<start:long,end:long,label:string,cover:double>>"


def licence_scan(docs: DataFrame, phrases: dict[str, str] | None = None, templates: tuple[tuple[str, str], ...] = TEMPLATES, least: int = 3, gap: int = 6, cover: float = 0.7, whole: int = 12, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: doc_id, n_words, n_base, first_word, last_word, base_labels,
    labels, score, spans.

    Words are runs of digits, letters a-z after lower-casing A-Z, and non-ASCII characters.
    n_base counts all places of whole phrases (overlapping ones too), first_word and last_word
    are their smallest and largest start. Template chains of stretches of `least` words or more,
    at most `gap` words apart, that cover `cover` of their template (all of it where it has fewer
    than `whole` words) add its label; spans has them by words, end exclusive. score is 1 with a phrase, else the best cover, else 0. Null,
    empty and wordless texts have no words and empty labels. Whole texts are read; repeated
    rows are rows of their own; an empty table gives no rows.
    """
    setup = (tuple((PHRASES if phrases is None else phrases).items()), tuple(templates), least, gap, cover, whole)
    span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("cover", pa.float64())])
    kinds = [*[pa.int64()] * 4, pa.string(), pa.string(), pa.float64(), pa.list_(span)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner(*setup)
        for b in batches:
            rows = []
            for text in b.column(1):
                s = scanner.scan(text.as_py())
                starts, base = [x for x, _ in s.phrases], {x for _, x in s.phrases}
                rows.append((s.n_words, len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | {x[2] for x in s.spans})), 1.0 if starts else max((x[3] for x in s.spans), default=0.0), [dict(zip(("start", "end", "label", "cover"), x)) for x in s.spans]))
            if rows:
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(zip(*rows), kinds))], ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), body(text_col).cast("binary").alias("text")).mapInArrow(run, SCHEMA)
