"""Conversations whose turns don't alternate, repaired by the cheapest edits.

A dynamic programme over the turns that stay: a turn is retained in its own role or in another
one, the gap to the next retained turn costs the difference of two deletion sums, and the pair of
their roles says how many empty turns must be inserted there. Per role, a running minimum over the
retained turns that follow stands for all of them. Of equally cheap repairs the one whose edits,
written as letters, come first in ASCII order is taken.

The programme is linear in (min, +), so a conversation of any length is cut at partition borders:
each piece is a 4 x 4 matrix, and what crosses a border is a vector one way and a state the other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import SPACES, written

INF = 1 << 60
ROLES = "sua"
NAMES = {"u": "user", "a": "assistant"}
DELETE, INSERT, REROLE, TRUNCATED = 2, 5, 1, 5
#: What must be inserted between a state (nothing yet, s, u, a) and what comes next (s, u, a, the end).
BETWEEN = ((0, 0, INSERT, 0), (INF, 0, INSERT, 2 * INSERT), (INF, INSERT, 0, INSERT), (INF, 0, INSERT, 0))
#: The role, as in ROLES, that an inserted or reroled turn has after a state.
NEXT = (1, 1, 2, 1)
END = (INF, INF, INF, 0)
FAULTS = ("", "blank", "duplicate", "truncated")
TURNS = "conv {conv}, turn long, fault string, old_role string, edit string, role string, text string"


def gap(m: tuple[int, ...], state: int) -> int:
    """The least cost from a gap on, with m the running minima by what comes next."""
    b = BETWEEN[state]
    return min(m[0] + b[0], m[1] + b[1], m[2] + b[2], m[3] + b[3])


def backward(rows: list[tuple], m: tuple[int, ...]) -> list[tuple[int, ...]]:
    """Running minima at each gap, from before the first row to m, behind the last.

    A row is (role as in ROLES or -1, fault as in FAULTS, copies that go, whether the row itself may stay).
    """
    out = [m]
    for role, fault, gone, free in reversed(rows):
        dead = DELETE * gone
        after = m
        m = (after[0] + dead + DELETE * free, after[1] + dead + DELETE * free, after[2] + dead + DELETE * free, after[3] + dead + DELETE * free)
        if free:
            own = dead + TRUNCATED * (fault == 3)
            stay = [own + (REROLE if r and r != role else INF if r != role else 0) + gap(after, r + 1) for r in range(3)]
            m = (min(m[0], stay[0], INF), min(m[1], stay[1], INF), min(m[2], stay[2], INF), min(m[3], INF))
        else:
            m = tuple(min(x, INF) for x in m)
        out.append(m)
    return out[::-1]


def forward(rows: list[tuple], at: list[tuple[int, ...]], state: int) -> tuple[list[tuple[str, str, str]], int]:
    """The first of the cheapest edits: (roles inserted before, edit, role), and the state behind the last row."""
    out = []
    for (role, fault, gone, free), before, after in zip(rows, at, at[1:]):
        put, edit, new = "", "D", ""
        while free and DELETE * (1 + gone) + gap(after, state) != (best := gap(before, state)):
            if INSERT + gap(before, NEXT[state] + 1) == best:
                put += ROLES[NEXT[state]]
                state = NEXT[state] + 1
                continue
            own = DELETE * gone + TRUNCATED * (fault == 3)
            if role >= 0 and BETWEEN[state][role] == 0 and own + gap(after, role + 1) == best:
                edit, state = "K", role + 1
            else:
                edit, new, state = "R", ROLES[NEXT[state]], NEXT[state] + 1
            break
        out.append((put, edit, new))
    return out, state


def closing(state: int) -> str:
    """Roles inserted behind the last row, so that the conversation ends with an answer."""
    return {0: "", 1: "ua", 2: "a", 3: ""}[state]


def matrix(rows: list[tuple]) -> list[int]:
    """What a piece makes of any vector behind it: its 4 x 4 numbers, row by row."""
    return [x for q in range(4) for x in backward(rows, tuple(0 if r == q else INF for r in range(4)))[0]]


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[tuple], dict]]:
    """Rows of one conversation in one segment: ((conv, segment), DP rows, the columns to hand on)."""
    rows = ((r["conv"], r["segment"], r) for b in batches for r in b.to_pylist())
    for key, found in groupby(rows, key=lambda r: r[:2]):
        have = [r[2] for r in found]
        yield key, [(ROLES.find(r["role"][:1]) if r["role"] else -1, r["fault"], r["n"] - (r["fault"] in (0, 3)), r["fault"] in (0, 3)) for r in have], have


def _keyed(rows: DataFrame) -> DataFrame:
    """conv, turn, role, text and 128 bits of role and text; null roles and texts are one space."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit(" ")), F.coalesce(F.col("text").cast("string"), F.lit(" "))
    parts = [role, text]
    return rows.select(F.col("conv"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), F.xxhash64(*parts).alias("h1"), F.xxhash64(F.lit(1), *parts).alias("h2"))


def _faults(keyed: DataFrame) -> DataFrame:
    """Equal rows of one turn as one row with their number, and the fault of the first of them.

    Copies are counted before anything is shuffled; first occurrences are minima and come back by
    a join that adaptive execution can split, so a very common text or conversation is no one task's.
    """
    text = F.col("text")
    blank = F.length(F.translate(text, SPACES, "")) == 0
    last = F.substring(F.rtrim(text, F.lit(SPACES)), -1, 1)
    marked = keyed.select("conv", "turn", "role", "h1", "h2", F.when(blank, 1).when(~last.isin(".", "!", "?"), 3).otherwise(0).alias("f"))
    rows = marked.groupBy("conv", "turn", "role", "h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.first("f").alias("f"))
    at = F.struct(F.col("turn").isNotNull().alias("x"), F.coalesce("turn", F.lit(0)).alias("turn"))
    first = rows.groupBy(F.col("conv").alias("c"), F.col("h1").alias("g1"), F.col("h2").alias("g2")).agg(F.min(at).alias("first"))
    both = rows.join(first, F.col("conv").eqNullSafe(F.col("c")) & (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2")))
    fault = F.when(F.col("f") == 1, 1).when(at > F.col("first"), 2).otherwise(F.col("f"))
    return both.select("conv", "turn", "role", "h1", "h2", "n", fault.alias("fault"))


def _edits(faults: DataFrame) -> DataFrame:
    """faults with each row's inserts before it, its edit and role, and what closes the conversation."""
    spark = faults.sparkSession
    order = ["conv", "turn", "role", "h1", "h2"]
    ordered = faults.repartitionByRange(*order).sortWithinPartitions(*order)
    cut = written(ordered.select("*", F.spark_partition_id().alias("segment"), F.monotonically_increasing_id().alias("pos")), "turns")
    # Segments, and conversations that lie in several: two for each segment at most.
    ends = cut.groupBy("conv").agg(F.min("segment").alias("lo"), F.max("segment").alias("hi")).where("lo < hi").collect()
    segments = (cut.agg(F.max("segment")).first()[0] or 0) + 1
    whole = cut.repartitionById(segments, "segment").sortWithinPartitions("segment", "pos")
    split = {r["conv"] for r in ends}
    # At a segment's border, for (conv, segment): the vector behind the piece and the state before it.
    vectors: dict[tuple, tuple] = {}
    states: dict[tuple, int] = {}
    if split:
        touched = {s for r in ends for s in range(r["lo"], r["hi"] + 1)}

        def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for key, rows, _ in _pieces(batches):
                if key[0] in split:
                    yield pa.RecordBatch.from_pylist([{"segment": key[1], "conv": repr(key[0]), "m": matrix(rows)}], schema=pa.schema([("segment", pa.int32()), ("conv", pa.string()), ("m", pa.list_(pa.int64()))]))

        part = whole.where(F.col("segment").isin(sorted(touched)))
        found: dict[str, list] = {}
        for r in part.mapInArrow(matrices, "segment int, conv string, m array<long>").collect():
            found.setdefault(r["conv"], []).append((r["segment"], r["m"]))
        for conv, pieces in found.items():
            m = END
            for segment, t in sorted(pieces, reverse=True):
                vectors[conv, segment] = m
                m = tuple(min(INF, *(m[q] + t[4 * q + r] for q in range(4))) for r in range(4))

        def ways(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for key, rows, _ in _pieces(batches):
                if key[0] in split:
                    at = backward(rows, vectors[repr(key[0]), key[1]])
                    yield pa.RecordBatch.from_pylist([{"segment": key[1], "conv": repr(key[0]), "to": [forward(rows, at, x)[1] for x in range(4)]}], schema=pa.schema([("segment", pa.int32()), ("conv", pa.string()), ("to", pa.list_(pa.int32()))]))

        found = {}
        for r in part.mapInArrow(ways, "segment int, conv string, to array<int>").collect():
            found.setdefault(r["conv"], []).append((r["segment"], r["to"]))
        for conv, pieces in found.items():
            state = 0
            for segment, to in sorted(pieces):
                states[conv, segment] = state
                state = to[state]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, rows, have in _pieces(batches):
            of = (repr(key[0]), key[1]) if key[0] in split else None
            vector = vectors[of] if of else END
            edits, state = forward(rows, backward(rows, vector), states[of] if of else 0)
            done = [{**r, "before": b, "edit": e, "new": x, "after": ""} for r, (b, e, x) in zip(have, edits)]
            if vector == END:
                done[-1]["after"] = closing(state)
            yield pa.RecordBatch.from_pylist(done, schema=schema)

    fields = [f for f in cut.schema.fields if f.name not in ("segment", "pos")]
    ddl = ", ".join([*[f"{f.name} {f.dataType.simpleString()}" for f in fields], "before string, edit string, new string, after string"])
    schema = _arrow(spark, ddl)
    return whole.mapInArrow(run, ddl)


def _arrow(spark, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(spark.createDataFrame([], ddl).schema)


def repaired_turns(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", ids: DataFrame | None = None) -> DataFrame:
    """A row for each edit, in order within its conversation: conv, turn, fault, old_role, edit, role, text.

    Edits: K keeps a turn, R gives it the role user or assistant, D deletes it, I inserts an empty
    turn (its turn, fault and old_role are null). Costs are 0, 1, 2 and 5, and 5 for each truncated turn
    that stays; the roles' initials then read `(s?(ua)+)?`. Faults: blank, duplicate (role and text were
    there before) and truncated (the last character that is no white space is none of `.!?`); blank
    and duplicate turns are deleted. Order: by turn, nulls first, then role, then a hash of both;
    equal rows lie side by side. Null roles and texts are one space, a null conversation id is a
    conversation, turns are read as long, further columns are left out. ids: a one-column table of
    conversations, each at least one row of the result (all null but conv if it has no turns).

    Rows of one conversation are in one partition and in order. A conversation's texts are streamed
    through one task, as its repaired text is one; all else is cut at partition borders.
    """
    col = lambda c: F.col(f"`{c.replace('`', '``')}`")
    keyed = _keyed(conversations.select(col(conv_col).alias("conv"), col(turn_col).alias("turn"), col(role_col).alias("role"), col(text_col).alias("text")))
    edits = _edits(_faults(keyed))
    none = lambda kind: F.lit(None).cast(kind)
    about = ["n", "fault", "before", "edit", "new", "after"]
    parts = edits.select("conv", "turn", "role", "h1", "h2", F.lit(1).alias("kind"), none("string").alias("text"), *about)
    texts = keyed.where(F.length(F.translate("text", SPACES, "")) > 0).select("conv", "turn", "role", "h1", "h2", F.lit(2).alias("kind"), "text", *[none(edits.schema[c].dataType).alias(c) for c in about])
    parts = parts.union(texts)
    if ids is not None:
        key = ids.select(col(ids.columns[0]).alias("conv")).distinct()
        parts = parts.union(key.select("conv", none("long").alias("turn"), none("string").alias("role"), none("long").alias("h1"), none("long").alias("h2"), F.lit(0).alias("kind"), none("string").alias("text"), *[none(edits.schema[c].dataType).alias(c) for c in about]))
    dealt = parts.repartition("conv").sortWithinPartitions("conv", "turn", "role", "h1", "h2", "kind")
    ddl = TURNS.format(conv=keyed.schema["conv"].dataType.simpleString())
    schema = _arrow(keyed.sparkSession, ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waits = None  # a turn that stays, until its text comes
        for batch in batches:
            out: list[tuple] = []
            for conv, turn, role, h1, h2, kind, text, n, fault, before, edit, new, after in zip(*(c.to_pylist() for c in batch.columns)):
                if kind == 2:
                    if waits and waits[0] == (h1, h2, turn, conv):
                        _, stays, gone, closes = waits
                        out.append((*stays, text))
                        out += gone
                        out += closes
                        waits = None
                    continue
                waits = None
                if kind == 0:
                    out.append((conv, None, None, None, None, None, None))
                    continue
                put = lambda roles, conv=conv: [(conv, None, None, None, "I", NAMES[r], "") for r in roles]
                out += put(before)
                gone = [(conv, turn, "blank" if fault == 1 else "duplicate", role, "D", None, None)] * (n - 1)
                if edit == "D":
                    out.append((conv, turn, FAULTS[fault] or None, role, "D", None, None))
                    out += gone
                    out += put(after)
                else:
                    waits = ((h1, h2, turn, conv), (conv, turn, FAULTS[fault] or None, role, edit, NAMES.get(new, role)), gone, put(after))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [[]] * len(schema), schema)], schema=schema)

    return dealt.mapInArrow(run, ddl)


def audits(turns: DataFrame) -> DataFrame:
    """A report for each conversation of repaired_turns: counts of faults, the cost, the edits and a hash of what stays.

    conv, gaps, blank, duplicate, truncated, illegal, cost (long), audit, repaired_sha256. It reads the
    rows as they come, a conversation's after each other; without turns all is zero or empty.
    """
    ddl = f"conv {turns.schema['conv'].dataType.simpleString()}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    schema = _arrow(turns.sparkSession, ddl)
    price = {"K": 0, "R": REROLE, "D": DELETE, "I": INSERT}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
        out = []
        for conv, found in groupby(rows, key=lambda r: r[0]):
            counts = dict.fromkeys(FAULTS, 0)
            sha, edits, lines, cost, illegal, low, high, turns_seen, turn_before, role_before = hashlib.sha256(), [], 0, 0, 0, None, None, 0, None, None
            for _, turn, fault, old, edit, role, text in found:
                if edit is None:
                    continue
                edits.append(edit)
                cost += price[edit] + TRUNCATED * (fault == "truncated" and edit != "D")
                if edit != "I":
                    counts[fault or ""] += 1
                    illegal += role_before is not None and role_before + old[:1] not in ("su", "ua", "au")
                    role_before = old[:1]
                    if turn is not None:
                        low, high = turn if low is None else low, turn
                        turns_seen += turn != turn_before
                        turn_before = turn
                if edit != "D":
                    sha.update(b"\n" * (lines > 0) + f"{role}:{text}".encode("utf-8", "surrogatepass"))
                    lines += 1
            gaps = 0 if low is None else high - low + 1 - turns_seen
            out.append((conv, gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, "".join(edits), sha.hexdigest()))
            if len(out) >= 4096:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return turns.mapInArrow(run, ddl)


def damaged(conversations: DataFrame) -> DataFrame:
    """Faults put into conversations by crc32 of `conv_id:turn` modulo 20, nulls written as one space.

    0 drops the row, 1 empties its text, 2 takes out `.`, `!` and `?`, 3 repeats it, 4 makes it the user's.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    h = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    text = F.when(h == 1, F.lit("")).when(h == 2, F.translate(space("text"), ".!?", "")).otherwise(space("text"))
    role = F.when(h == 4, F.lit("user")).otherwise(space("role"))
    copies = F.explode(F.when(h == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return conversations.where(h != 0).select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")

