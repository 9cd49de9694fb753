"""Documents with the awkward cases: nulls, blanks, long texts, copies, repeated rows, odd columns."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, fp string, runs string, key string"


def documents(spark, rows=None):
    rows = texts() if rows is None else rows
    return spark.createDataFrame([(i, t, lang, source, len(t or ""), "x", None, "y", "z") for i, t, lang, source in rows], SCHEMA)


def texts():
    rng = random.Random(7)
    words = [a + b for a in "ka lo mi ne tu ra so".split() for b in ("", "n", "s", "lat", "É", "vor")]
    line = lambda n: " ".join(rng.choice(words) for _ in range(n))
    out = []
    for i in range(160):
        text = "\n".join(line(rng.randint(1, 14)) + "." for _ in range(rng.randint(1, 8)))
        if i % 3 == 0:
            text += "\n  Shared Line of Everyone\t"
        if i % 20 == 0:
            text = "Same text for all of these,\nwith two lines."
        if i % 20 == 1:
            text = f"Same  text for all of these, with two lines.{' ' * (i % 4)}"
        out.append((i, text, rng.choice(["en", "fr", None]), rng.choice(["a", "a", "a", "b", "c", None])))
    base = " ".join(rng.choice(words) for _ in range(400))
    for i in range(160, 200):  # near copies
        w = base.split()
        w[rng.randrange(400)] = "changed"
        out.append((i, " ".join(w), "en", "b"))
    out += [(200, None, None, None), (201, "", "en", "a"), (202, " \n\t ", "fr", "d"), (203, None, "en", "a"), (None, "null id", "en", "a"), (None, None, "en", "a")]
    out += [(204, line(30_000), "en", "c"), (205, "x" * 60_000, "en", "a"), (206, "\n".join(["Shared line of everyone"] * 40), "fr", "a")]
    out += [(7, out[7][1], out[7][2], out[7][3])] * 2 + [(8, "another text under a used id", "en", "b")]
    return out
