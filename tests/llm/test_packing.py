import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from tidemark.llm.packing import best_cuts, pack
from tidemark.llm.tokens import default_vocabulary, tokens

from .cases import SCHEMA, documents, texts

ODD = ["", " ", "a  b", " a b", "a\n b", "a \nb", "a\n \nb", "a\t b ", "don't I'll", "é à Ñ ñoño", "中文 字 text", "x<|endoftext|>y z", "a b  c", "1 23  456,7 .", "Привет мир", "a\x1c b \x85c", "🙂 ok  🙂"]


@pytest.mark.parametrize("text", [*ODD, *(t or "" for _, t, _, _ in texts()[:20])])
def test_ids_are_those_of_the_vocabulary(text):
    exact = Tokenizer.from_file(default_vocabulary())
    assert tokens(default_vocabulary()).ids(text).tolist() == exact.encode(text, add_special_tokens=False).ids


def test_random_white_space():
    rng, exact, own = random.Random(5), Tokenizer.from_file(default_vocabulary()), tokens(default_vocabulary())
    for _ in range(1500):
        t = "".join(rng.choice(["a", "Bc", "é", "1", ".", " ", " ", "  ", "\n", "\t", "　", "'s", "ж"]) for _ in range(rng.randint(1, 14)))
        assert own.ids(t).tolist() == exact.encode(t, add_special_tokens=False).ids, repr(t)


def brute_cost(cuts, pen, size, short):
    f = [0] + [None] * (len(cuts) - 1)
    for j in range(1, len(cuts)):
        best = None
        for i in range(j):
            n = cuts[j] - cuts[i]
            if n > size:
                continue
            c = f[i] + size - n
            if n < size and n & (n - 1) == 0:
                c = min(c, f[i] + short)
            best = c if best is None else min(best, c)
        f[j] = best + pen[j]
    return f[-1]


def test_cuts_are_optimal():
    rng = np.random.default_rng(3)
    for _ in range(60):
        size = 64
        cuts = np.concatenate([[0], np.cumsum(rng.integers(1, 40, rng.integers(1, 40)))])
        pen = rng.integers(0, 9, len(cuts))
        pen[0] = 0
        chosen = best_cuts(cuts, pen, size, 12)
        at = {int(c): int(p) for c, p in zip(cuts, pen)}
        cost = 0
        for a, b in zip(chosen, chosen[1:]):
            n = b - a
            assert n <= size
            cost += min(size - n, 12 if n < size and n & (n - 1) == 0 else size) + at[b]
        assert cost == brute_cost(cuts.tolist(), pen.tolist(), size, 12)


@pytest.mark.parametrize("block", [1 << 18, 5000])
def test_every_id_lies_in_one_piece(spark, block):
    exact = Tokenizer.from_file(default_vocabulary())
    docs = [r for r in texts() if r[0] is not None]
    docs = list({r[0]: r for r in docs}.values())
    pieces = pack(documents(spark, docs).coalesce(2), block=block).collect()
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_sequence.setdefault(p.sequence_id, []).append(p)
    assert len(by_doc) == len(docs)
    total = 0
    for i, text, _, _ in docs:
        ids = np.array([*exact.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for p in sorted(by_doc[i], key=lambda p: p.start):
            assert (p.start, p.doc_tokens) == (at, len(ids)) and p.length > 0
            assert p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
        total += at
    padding = 0
    for s in by_sequence.values():
        at = 0
        for p in sorted(s, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 2048
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    assert padding < 0.02 * total + 2 * 2048


def test_empty_table_and_repeated_rows(spark):
    assert pack(spark.createDataFrame([], SCHEMA)).collect() == []
    assert pack(documents(spark, [(1, None, None, None), (1, None, None, None), (None, "", None, None)])).count() == 3


def test_ids_over_the_latin_range():
    import random

    from tidemark.llm.tokens import default_vocabulary, tokens

    rng, t = random.Random(14), tokens(default_vocabulary())
    assert t.ranked
    for _ in range(3_000):
        text = "".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(9, 592), 32, 10, 39, 0x2019])) for _ in range(rng.randint(0, 30)))
        assert t.ids(text).tolist() == t.exact.encode(text, add_special_tokens=False).ids, repr(text)
