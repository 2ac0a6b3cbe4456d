import random

import corpus_pipeline
from sessionloom.llm import near_copies


def bag(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def alike(a, b):
    return not a and not b or len(a & b) >= 0.8 * len(a | b) - 1e-9


def kept_ids(rows):
    """Brute force: the smallest id of each class of linked texts."""
    left, out = {i: bag(t) for i, t in rows}, []
    while left:
        least = min(left)
        out.append(least)
        todo = [left.pop(least)]
        while todo:
            near = [i for i in left if alike(left[i], todo[0])]
            todo = todo[1:] + [left.pop(i) for i in near]
    return sorted(out)


def test_copies_from_08_up_go_and_others_stay(spark, docs, tmp_path, monkeypatch):
    monkeypatch.setattr(near_copies, "BLOCK", 5)
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    rows, similar = [], []
    for k in range(60):
        words = [word() for _ in range(rng.choice([40, 120, 300]))]
        rows.append((k, " ".join(words)))
        for n in range(3):
            other = list(words)
            for _ in range(max(1, round(len(words) * rng.choice([0.003, 0.008, 0.015, 0.02, 0.03, 0.04])))):
                other[rng.randrange(len(other))] = word()
            rows.append((1_000 + 3 * k + n, " ".join(other).title()))
            one, two = bag(rows[-1][1]), bag(rows[k * 4][1])
            similar.append(len(one & two) / len(one | two))
    assert sum(0.8 <= s < 0.9 for s in similar) > 10 and sum(s < 0.8 for s in similar) > 10
    # a chain, whose ends are not alike, and long texts half of which is one repeated line
    words = [word() for _ in range(200)]
    for n in range(30):
        rows.append((3_000 + n, " ".join(words)))
        words[7 * n % 200] = word()
    line = " ".join(word() for _ in range(10))
    rows += [(4_000 + n, " ".join([*[line] * 30, *[word() for _ in range(300)]])) for n in range(6)]
    rows += [(5_000, None), (5_001, ""), (5_002, " \n"), (5_003, "two words"), (5_004, "Two  Words"), (5_005, rows[0][1])]
    table = docs(rows)
    got = corpus_pipeline.near_dedup(spark, table, str(tmp_path))
    assert got.columns == table.columns
    assert sorted(r.doc_id for r in got.collect()) == kept_ids(rows)


def test_rows_without_id_and_repeated_rows(docs):
    rows = [(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (2, "other words"), (2, "that stand alone"), (None, "lonely text")]
    got = near_copies.keep_one(docs(rows)).collect()
    assert sorted((r.doc_id or -1, r.text) for r in got) == [(-1, "lonely text"), (2, "other words"), (2, "that stand alone"), (3, "a b c d e f")]
    assert near_copies.keep_one(docs(rows).where("false")).count() == 0


def test_linked_fingerprints_make_candidates_that_are_checked(spark, docs, tmp_path, monkeypatch):
    """The stage had min-hashes alone; here no two texts share one."""
    monkeypatch.setattr(near_copies, "band_keys", lambda hashes: hashes[:0])
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    rows = []
    for k in range(12):
        words = [word() for _ in range(1_500)]
        rows += [(10 * k, " ".join(words)), (10 * k + 1, " ".join([*words[:-1], word()]))]
    line = " ".join(word() for _ in range(10))
    rows += [(4_000 + n, " ".join([*[line] * 30, *[word() for _ in range(300)]])) for n in range(4)]
    got = corpus_pipeline.near_dedup(spark, docs(rows), str(tmp_path))
    assert sorted(r.doc_id for r in got.collect()) == kept_ids(rows)
