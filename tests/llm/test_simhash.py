import random

import numpy as np
import xxhash
from hypothesis import given, settings, strategies as st

from sessionloom.llm import simhash
from sessionloom.llm.components import connected_components


def plain_print(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()]
    if not words:
        return 0
    parts = [b" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(numbers, radius):
    """Brute force: number -> smallest number of its class."""
    left, out = set(numbers), {}
    while left:
        group, todo = set(), [left.pop()]
        while todo:
            x = todo.pop()
            group.add(x)
            near = {y for y in left if (x ^ y).bit_count() <= radius}
            left -= near
            todo += near
        out |= {x: min(group) for x in group}
    return out


@settings(max_examples=50, deadline=None)
@given(st.text(alphabet="aB é\n\t\x1c ", max_size=60))
def test_fingerprint_is_the_majority_of_shingle_hashes(text):
    assert simhash.simhash(text.encode()) % (1 << 64) == plain_print(text)


def test_long_text_in_pieces():
    text = " ".join(random.Random(1).choice("abcdefgh") for _ in range(70_000))
    whole, simhash._HASHES = simhash.simhash(text.encode()), 1_000
    try:
        assert simhash.simhash(text.encode()) == whole
    finally:
        simhash._HASHES = 65_536


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 1 << 30), st.integers(2, 400))
def test_tree_finds_every_pair_of_a_block(seed, n):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 1 << 63, 3, dtype=np.uint64)
    flips = np.uint64(1) << rng.integers(0, 64, (n, 3), dtype=np.uint64)
    codes = np.unique(base[rng.integers(0, 3, n)] ^ np.bitwise_xor.reduce(flips, axis=1))
    rank = codes.copy()
    for by in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(by)
    codes = codes[np.argsort(rank)]
    found = set()
    for a, b in simhash.GrayTree(codes, 13).search(codes, 4, np.arange(len(codes))):
        found |= set(zip(a.tolist(), b.tolist(), strict=True))
    shift = np.uint64(51)
    want = {
        (i, j) for i in range(len(codes)) for j in range(i + 1, len(codes))
        if codes[i] >> shift == codes[j] >> shift and int(codes[i] ^ codes[j]).bit_count() <= 4
    }
    assert found == want


def test_links_are_whole_when_groups_reach_over_partitions(spark, monkeypatch):
    monkeypatch.setattr(simhash, "ENTRIES_A_TASK", 97)
    rng = random.Random(5)
    numbers = set()
    for _ in range(6):
        base = rng.getrandbits(64)
        for _ in range(60):
            x = base
            for _ in range(rng.randint(0, 5)):
                x ^= 1 << rng.randrange(64)
            numbers.add(x)
    numbers |= {rng.getrandbits(64) for _ in range(200)}
    signed = [(x - (1 << 64) if x >> 63 else x,) for x in numbers]
    nodes = spark.createDataFrame(signed, "fp bigint")
    got = {r.node % (1 << 64): r.root % (1 << 64) for r in connected_components(simhash.near_links(nodes)).collect()}
    want = classes(numbers, 4)
    groups = lambda m: {frozenset(x for x in numbers if m.get(x, x) == r) for r in set(m.get(x, x) for x in numbers)}
    assert groups(got) == groups(want)


def test_components_of_long_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(200, 260)] + [(5, 5), (None, 3), (200, 100)]
    got = {(r.node, r.root) for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {(i, 0) for i in range(61)} | {(100, 100)} | {(i, 100) for i in range(200, 260)}


def test_near_duplicates_and_kept_rows(docs):
    long = " ".join(f"w{i}" for i in range(400))
    rows = [(7, long), (3, long), (3, long), (9, long + " tail"), (1, "other words that stand alone here"), (None, long), (5, None), (4, ""), (6, " \n"), (None, "lonely text of nobody at all"), (2, "x " * 30_000)]
    table = docs(rows)
    got = {(r.doc_id, r.component_id) for r in simhash.near_duplicates(table).collect()}
    prints = {t: plain_print(t) for _, t in rows}
    roots = classes(set(prints.values()), 4)
    want = set()
    for i, t in rows:
        same = [j for j, u in rows if roots[prints[u]] == roots[prints[t]] and j is not None]
        want.add((i, min(same) if same else None))
    assert got == want
    kept = simhash.keep_one(table)
    assert kept.columns == table.columns
    assert sorted(r.doc_id or -1 for r in kept.collect()) == sorted({c if c is not None else -1 for _, c in want})


def test_empty_table(docs):
    empty = docs([(1, "a")]).where("false")
    assert simhash.near_duplicates(empty).count() == 0
    assert simhash.keep_one(empty).count() == 0
