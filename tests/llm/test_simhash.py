import itertools

import numpy as np
import xxhash

from tidemark.llm import simhash as S

from .cases import SCHEMA, documents, texts


def brute_fingerprint(text, width=3):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_components(fps):
    """fps: list of (id, fp) -> id -> smallest id reachable."""
    values = sorted({fp for _, fp in fps})
    parent = {v: v for v in values}

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in itertools.combinations(values, 2):
        if (a ^ b).bit_count() <= 2:
            parent[find(a)] = find(b)
    least = {}
    for i, fp in fps:
        if i is not None:
            r = find(fp)
            least[r] = min(least.get(r, i), i)
    return [(i, fp, least.get(find(fp))) for i, fp in fps]


def order(rows):
    return sorted(rows, key=repr)


def test_against_brute_force(spark):
    want = order(brute_components([(i, brute_fingerprint(t)) for i, t, _, _ in texts()]))
    got = order((r.doc_id, r.fp % (1 << 64), r.component_id) for r in S.near_duplicates(documents(spark)).collect())
    assert got == want


def test_empty_table(spark):
    assert S.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def test_masks_cover_every_pair_within_the_radius():
    masks = S.covering_masks()
    for k in (1, 2):
        for bits in itertools.combinations(range(64), k):
            assert any(not any(m >> b & 1 for b in bits) for m in masks)


def test_large_buckets_and_chains(spark):
    rng = np.random.default_rng(1)
    fps = {int(x) for x in rng.integers(-(2**62), 2**62, 50)}
    hub = 12345
    fps |= {hub ^ (1 << a) ^ (1 << b) for a, b in itertools.combinations(range(0, 40, 2), 2)}  # one dense group
    x = -987654321
    for i in range(60):  # a long chain of two-bit steps
        x ^= (1 << (i % 60)) | (1 << ((i * 7 + 3) % 60))
        fps.add(x)
    nodes = spark.createDataFrame([(v,) for v in fps], "fp long")
    links = S.hamming_links(nodes)
    rows = links.collect()
    assert all(((r.a ^ r.b) & (2**64 - 1)).bit_count() <= 2 for r in rows)
    got = {r.node: r.root for r in S.connected(links).collect()}
    pairs = [(a, b) for a, b in itertools.combinations(sorted(fps), 2) if ((a ^ b) & (2**64 - 1)).bit_count() <= 2]
    parent = {v: v for v in fps}

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in pairs:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    assert {v: got.get(v, v) for v in fps} == {v: find(v) for v in fps}


def test_buckets_around_the_switch(spark):
    """Buckets of 16, 17 and 65 values give the components of all pairs, whichever way they are compared."""
    rng = np.random.default_rng(2)
    for size in (16, 17, 65):
        base = int(rng.integers(0, 2**62))
        fps = {base}
        while len(fps) < size:
            a, b, c = (1 << int(x) for x in rng.choice(range(0, 64, 7), 3, replace=False))
            fps.add(base ^ a ^ b if len(fps) % 3 else base ^ a ^ b ^ c ^ (1 << int(rng.integers(1, 6))))
        signed = [v - (v >> 63 << 64) for v in fps]
        links = S.hamming_links(spark.createDataFrame([(v,) for v in signed], "fp long"))
        got = {r.node: r.root for r in S.connected(links).collect()}
        want = {i: least for i, _, least in brute_components([(v, v % (1 << 64)) for v in signed])}
        assert all(got.get(v, v) == want[v] for v in signed)
