"""Conversation repair against an enumeration of all edits, and the query against a plain version."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import pyarrow.parquet as pq
import pytest

from tidemark.llm import repair as R
from tidemark.llm.queries import op11_repair

SF = "/root/testdata/sf0.001"
LEGAL = re.compile(r"(s?(ua)+)?")
SPACES = " \t\n\x0b\x0c\r"


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        bare = text.strip(SPACES)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def enumerated(rows, most_inserts=3):
    """(cost, audit, repaired lines) by trying everything."""
    best = None
    kinds = faults(rows)
    places = range(len(rows) + 1)
    puts = [c for n in range(most_inserts + 1) for at in itertools.combinations_with_replacement(places, n) for c in itertools.product(*[[(p, r) for r in "ua"] for p in at])]
    edits = [["D"] if k in ("blank", "duplicate") else ["D", "K", "Ru", "Ra"] for k in kinds]
    for chosen in itertools.product(*edits):
        for put in puts:
            cost, audit, lines, initials = 5 * len(put), "", [], ""
            for i in places:
                for _, r in (x for x in put if x[0] == i):
                    audit, initials = audit + "I", initials + r
                    lines.append({"u": "user:", "a": "assistant:"}[r])
                if i < len(rows):
                    role, text = rows[i]
                    e = chosen[i]
                    audit += e[0]
                    cost += {"D": 2, "K": 0, "R": 1}[e[0]] + 5 * (kinds[i] == "truncated" and e != "D")
                    if e != "D":
                        role = {"u": "user", "a": "assistant"}[e[1]] if e[0] == "R" else role
                        initials += role[:1] or "-"
                        lines.append(f"{role}:{text}")
            if LEGAL.fullmatch(initials) and (best is None or (cost, audit) < best[:2]):
                best = (cost, audit, lines)
    return best


def planned(rows):
    """The same by the operator's own functions, in one piece and in pieces."""
    dp = [(R.ROLES.find(r[:1]) if r else -1, R.FAULTS.index(k or ""), k in ("blank", "duplicate"), k not in ("blank", "duplicate")) for (r, _), k in zip(rows, faults(rows))]
    edits, state = R.forward(dp, R.backward(dp, R.END), 0)
    for i in range(len(dp) + 1):
        t = R.matrix(dp[i:])
        m = tuple(min(R.INF, *(R.END[q] + t[4 * q + r] for q in range(4))) for r in range(4))
        assert m == R.backward(dp[i:], R.END)[0]
        first, x = R.forward(dp[:i], R.backward(dp[:i], m), 0)
        second, x = R.forward(dp[i:], R.backward(dp[i:], R.END), x)
        assert (first + second, x) == (edits, state)
    return "".join("I" * len(p) + e for p, e, _ in edits) + "I" * len(R.closing(state)), R.gap(R.backward(dp, R.END)[0], 0)


def test_cheapest_edits():
    rng = random.Random(5)
    for n in [0, 1, 1, 1, 2, 2, 2, 2, 2] + [3] * 60 + [4] * 3:
        rows = [(rng.choice(["user", "assistant", "user", "assistant", "system", "tool", ""]), rng.choice(["a.", "b.", "c!", "d", "", "e"])) for _ in range(n)]
        cost, audit, _ = enumerated(rows, 2 if n == 4 else 3)
        assert planned(rows) == (audit, cost), rows


def plain(rows, ids):
    """{conv: report} for damaged rows, with an exact shortest path by (cost, audit) over the same alphabet."""
    by = collections.defaultdict(list)
    for c, turn, role, text in rows:
        by[c].append((turn, role, text))
    out = {}
    for c in ids:
        have = sorted(by.get(c, []), key=lambda r: (r[0] is not None, r[0] or 0))
        kinds = faults([r[1:] for r in have])
        # state: initials so far as a class -> (cost, audit, lines)
        best = {"": (0, "", [])}

        def put(best):
            for _ in range(2):
                for s, (cost, audit, lines) in list(best.items()):
                    r = "a" if s == "u" else "u"
                    new = (cost + 5, audit + "I", [*lines, {"u": "user:", "a": "assistant:"}[r]])
                    if r not in best or new[:2] < best[r][:2]:
                        best[r] = new
            return best

        best = put(best)
        for (_, role, text), k in zip(have, kinds):
            step = {}

            def offer(s, new, step=step):
                if s not in step or new[:2] < step[s][:2]:
                    step[s] = new

            for s, (cost, audit, lines) in best.items():
                offer(s, (cost + 2, audit + "D", lines))
                if k in ("blank", "duplicate"):
                    continue
                extra = 5 * (k == "truncated")
                to = "a" if s == "u" else "u"
                if role[:1] == to or (role[:1] == "s" and s == ""):
                    offer(role[:1], (cost + extra, audit + "K", [*lines, f"{role}:{text}"]))
                name = {"u": "user", "a": "assistant"}[to]
                offer(to, (cost + 1 + extra, audit + "R", [*lines, f"{name}:{text}"]))
            best = put(step)
        cost, audit, lines = min((v for s, v in best.items() if s in ("", "a")), key=lambda v: v[:2])
        turns = [r[0] for r in have if r[0] is not None]
        pairs = [x[1][:1] + y[1][:1] for x, y in zip(have, have[1:])]
        out[c] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, kinds.count("blank"), kinds.count("duplicate"), kinds.count("truncated"), sum(p not in ("su", "ua", "au") for p in pairs),
            cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        )
    return out


def damage(rows):
    sp = lambda x: " " if x is None else str(x)
    out = []
    for c, turn, role, text in rows:
        h = zlib.crc32(f"{sp(c)}:{sp(turn)}".encode()) % 20
        role, text = sp(role), sp(text)
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        out += [(c, turn, "user" if h == 4 else role, text)] * (h and 1 + (h == 3))
    return out


def reports(df):
    got = {r.conv_id if "conv_id" in df.columns else r.conv: tuple(r[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")) for r in df.collect()}
    return got


def test_query(spark):
    rows = [tuple(r.values()) for r in pq.read_table(f"{SF}/conversations.parquet").to_pylist()]
    df = op11_repair(spark, SF)
    assert reports(df) == plain(damage(rows), {r[0] for r in rows})
    assert df.count() == len({r[0] for r in rows})


def awkward():
    rng = random.Random(11)
    rows = []
    for c in [*range(40), None]:
        for turn in [*range(rng.randint(1, 7)), *rng.choice([[], [None], [9, 12]])]:
            rows.append((c, turn, rng.choice(["user", "assistant", "system", "User", "", None]), rng.choice(["Yes.", "No", "", None, " \t\n", "x " * 3000 + "!", f"Text {turn}?", "Ünï."])))
    rows += [(100, None, "user", "a."), (100, None, "user", "a."), (101, 0, None, None)]
    # one conversation with most of the rows, many of them equal
    rows += [(7777, i // 2, rng.choice(["user", "assistant"]), rng.choice([f"Line {i}.", "Same again.", f"cut {i}"])) for i in range(3000)]
    rows += [(7777, 5, "user", "Same again.")] * 50
    return rows


@pytest.mark.parametrize("parts", [1, 16])
def test_awkward_conversations(spark, parts):
    """Long conversations lie in several segments: the same result as in one."""
    rows = awkward()
    # ties within a turn are ordered by role, then by a hash: give each its own turn where the plain version would differ
    seen, own = {}, []
    for c, turn, role, text in rows:
        k = (c, turn)
        if turn is not None and seen.setdefault(k, (role, text)) != (role, text):
            turn = 100_000 + len(own)
        elif turn is None and seen.setdefault(k, (role, text)) != (role, text):
            continue
        own.append((c, turn, role, text))
    df = spark.createDataFrame([(*r, "x", 1) for r in own], "conv_id long, turn long, role string, text string, n string, h1 int")
    want = plain([(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in own], {r[0] for r in own} | {-1})
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        ids = spark.createDataFrame([(-1,)] + [(r[0],) for r in own], "c long")
        turns = R.repaired_turns(df, ids=ids)
        assert reports(R.audits(turns)) == want
        assert {r.edit for r in turns.collect()} == {"K", "R", "D", None}  # an insert is never the cheapest at these costs
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert R.audits(R.repaired_turns(none)).collect() == []
    only = R.audits(R.repaired_turns(none, ids=spark.createDataFrame([(3,)], "c long"))).collect()
    assert [tuple(r) for r in only] == [(3, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
