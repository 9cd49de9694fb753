import random
import re

from tidemark.llm import licences as L

from .cases import SCHEMA, documents, texts


def brute(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    found = []
    for p, label in L.PHRASES.items():
        p = p.split()
        found += [(i, label) for i in range(len(words)) if words[i : i + len(p)] == p]
    starts = [i for i, _ in found]
    return len(words), len(found), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in found}))


EXTRA = [
    "Licensed under CC BY-NC 4.0.\nReleased under the MIT License. mit license MIT LICENSE!",
    "apache license apache license; gnu general public licence, GNU General Public License",
    "cc cc by by cc-by mit mit license license İmit license mit licenseé",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this changed software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
    "apache license " * 3000,
]


def test_base_against_brute_force(spark):
    rng = random.Random(3)
    vocabulary = "gnu general public license apache cc by mit x the".split()
    rows = texts() + [(1000 + i, t, None, None) for i, t in enumerate(EXTRA)]
    rows += [(2000 + i, rng.choice([" ", "-", ". "]).join(rng.choice(vocabulary) for _ in range(rng.randint(1, 60))), None, None) for i in range(200)]
    got = L.licence_scan(documents(spark, rows)).collect()
    key = lambda x: repr(x)
    assert sorted([(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got], key=key) == sorted([(i, *brute(t)) for i, t, _, _ in rows], key=key)
    for r in got:
        assert set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert L.licence_scan(spark.createDataFrame([], SCHEMA)).collect() == []


def test_matching_statistics_against_brute_force():
    rng = random.Random(5)
    sequences = [[rng.randrange(3) for _ in range(rng.randint(1, 12))] for _ in range(6)]
    a = L.Automaton(sequences)
    inside = {tuple(s[i:j]) for s in sequences for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
    for _ in range(50):
        text, v, n = [rng.randrange(4) for _ in range(30)], 0, 0
        for i, w in enumerate(text):
            while v >= 0 and w not in a.next[v]:
                v = a.link[v]
                n = a.length[v] if v >= 0 else 0
            v, n = (a.next[v][w], n + 1) if v >= 0 else (0, 0)
            want = max((k for k in range(i + 2) if k == 0 or tuple(text[i + 1 - k : i + 1]) in inside))
            assert n == want
            if n:
                stretch = text[i + 1 - n : i + 1]
                assert a.ends[v] == {(s, e) for s, x in enumerate(sequences) for e in range(n, len(x) + 1) if x[e - n : e] == stretch}


def test_spans_of_changed_templates():
    s = L.Scanner(L.PHRASES, L.TEMPLATES)
    found = s.scan(("before it " + EXTRA[3] + " and after").encode())
    assert [x[2] for x in found.spans] == ["mit-notice"] and found.spans[0][0] == 2 and found.spans[0][3] > 0.9
    assert s.scan(b"the software is free of charge to the public").spans == []
    labels = lambda t: [x[2] for x in s.scan(t.encode()).spans]
    # A short template that a longer one goes on from, and words that tell kin apart.
    assert labels("Licensed under the Apache License, Version 2.0. The rest is new.") == ["apache-notice"]
    gnu = "This {} is free software; you can redistribute it and/or modify it under the terms of the GNU {}General Public License as published by the Free Software Foundation; either version {} of the License, or (at your option) any later version."
    assert labels(gnu.format("program", "", 3)) == ["gpl-notice"]
    assert labels(gnu.format("library", "Lesser ", "2.1")) == labels(gnu.format("program", "Lesser ", "3")) == ["lgpl-notice"]
    assert labels(gnu.format("program", "Affero ", 3)) == ["agpl-notice"]
    assert labels("SPDX-License-Identifier: ISC") == ["isc-spdx"] and labels("SPDX-License-Identifier: Other-1.0") == []
    assert labels("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.") == ["cc-by-sa-notice"]
    for label, text in L.TEMPLATES:
        assert labels(f"Copyright 2020 somebody\n\n{text}\n\nimport os") == [label]
    # A part of a notice, noise, then the whole: the span is that of the whole.
    words = next(t for k, t in L.TEMPLATES if k == "gpl-notice").split()
    spans = s.scan(" ".join([*words[:20], "xx yy", *words]).encode()).spans
    first = len(" ".join(words[:20]).encode().translate(L._TO_WORDS).split()) + 2
    assert [(x[0], x[2], x[3]) for x in spans] == [(first, "gpl-notice", 1.0)]


def test_chains_against_brute_force():
    """The dynamic programme covers as many words as the best of all chains of the same stretches."""
    rng = random.Random(12)
    for _ in range(300):
        s = L.Scanner({}, (("t", " ".join(rng.choice("abc") for _ in range(rng.randint(3, 9)))),), least=2, gap=2, cover=0.01, whole=0)
        text = [rng.choice("abcx") for _ in range(rng.randint(2, 14))]
        found = {}
        out = L.Scan(0, [], [])
        codes = [s.words.get(w.encode(), -1) for w in text]
        at = 0
        while at < len(codes):
            end = at
            while end < len(codes) and codes[end] >= 0:
                end += 1
            if end > at:
                s._run(codes[at:end], at, out, found)
            at = end + 1
        items = sorted(set(found.get(0, [])))

        def longest(k):
            end, at, size = items[k]
            best = size
            for p in range(k):
                last, reached, _ = items[p]
                over = max(0, last - (end - size), reached - (at - size))
                if last < end and reached < at and over < size and end - size + over - last <= 2:
                    best = max(best, longest(p) + size - over)
            return best

        chains = s._chained(0, found[0]) if items else []
        assert max((c for *_, c in chains), default=0) == max((longest(k) for k in range(len(items))), default=0)
        assert all(e <= s2 or e2 <= b for i, (b, e, *_) in enumerate(chains) for s2, e2, *_ in chains[:i])


def test_spans_against_all_pairs():
    """Looking up neighbours keeps what comparing every pair keeps."""
    s = L._scanner(tuple(L.PHRASES.items()), L.TEMPLATES, 3, 6, 0.7, 12)
    rng = random.Random(9)
    for _ in range(200):
        found = []
        for _ in range(rng.randint(1, 60)):
            start, n = rng.randint(0, 120), rng.randrange(len(L.PHRASES), len(s.sizes))
            length = rng.choice([3, 4, 5, 8, 20, 60])
            found.append((start, start + length, n, rng.randint(1, length)))
        kept = []
        for x in sorted(found, key=lambda x: (-x[3] * x[3] / s.sizes[x[2]], x)):
            named = lambda y: s.labels[y[2]].endswith("-spdx")
            if all((named(x) and named(y)) or 2 * (min(x[1], y[1]) - max(x[0], y[0])) < min(x[1] - x[0], y[1] - y[0]) for y in kept):
                kept.append(x)
        assert s._resolved(found) == sorted((a, b, s.labels[n], min(1.0, c / s.sizes[n])) for a, b, n, c in kept)


def test_time_grows_with_the_notices():
    import time

    s = L._scanner(tuple(L.PHRASES.items()), L.TEMPLATES, 3, 6, 0.7, 12)
    took = []
    for n in (5_000, 20_000):
        began = time.perf_counter()
        out = s.scan(b"licensed under the MIT License and eight other words stand in between here now " * n)
        took.append(time.perf_counter() - began)
        assert len(out.spans) == n and len(out.phrases) == n
    assert took[1] < 10 * took[0] + 1


def test_identifiers_and_dedications():
    s = L._scanner(tuple(L.PHRASES.items()), L.TEMPLATES, 3, 6, 0.7, 12)
    labels = lambda t: {x[2] for x in s.scan(t.encode().lower()).spans}
    assert labels("// SPDX-License-Identifier: MIT OR Apache-2.0") == {"mit-spdx", "apache-spdx"}
    for name, label in (("Zlib", "zlib"), ("Unlicense", "unlicense"), ("BSL-1.0", "boost"), ("CC0-1.0", "cc0"), ("MIT", "mit"), ("GPL-2.0", "gpl")):
        assert labels(f"SPDX-License-Identifier: {name}") == {f"{label}-spdx"}
    assert labels("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.") == {"cc0-notice"}
    assert labels("This Font Software is licensed under the SIL Open Font License, Version 1.1.\nThis license is copied below") == {"ofl-notice"}
    assert labels("The contents of this file are subject to the Mozilla Public License Version 1.1 (the \"License\"); you may not use this file except in compliance with the License.") == {"mpl-notice"}
