import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from sessionloom.llm import super_kmers
from sessionloom.llm.words import BatchWords, sliding_min

WORDS = ["a", "b", "é", "dd", "e,", " x"]


def brute(rows, width):
    texts = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    counts = Counter(tuple(x[i : i + width]) for x in texts for i in range(len(x) - width + 1))
    out = []
    for (name, _), x in zip(rows, texts, strict=True):
        gone = set()
        for i in range(len(x) - width + 1):
            if counts[tuple(x[i : i + width])] > 1:
                gone.update(range(i, i + width))
        out.append((name, len(x), len(gone), " ".join(w for i, w in enumerate(x) if i not in gone)))
    return out


def ordered(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1:]))


def some_rows():
    draw, rows = random.Random(1), []
    for i in range(120):
        x = [draw.choice(WORDS) for _ in range(draw.choice([0, 1, 4, 5, 6, 7, 30, 200]))]
        if i % 7 == 0:
            x = ["a"] * draw.randint(0, 80)
        if i % 5 == 0 and rows:
            x += re.split(r"[\x20\x09-\x0D]+", rows[-1][1])[:50]
        rows.append((i, draw.choice([" ", "\n", "  \t", "\x0b", "\x0c\r"]).join(x)))
    return [*rows, (500, None), (501, ""), (502, " "), (3, rows[3][1]), (None, "x " * 40)]


@pytest.mark.parametrize("width, run, hot", [(35, 8, 4096), (6, 3, 4096), (6, 3, 1), (5, 9, 2)])
def test_removed_words_equal_brute_force(docs, width, run, hot):
    """Null, empty and periodic texts, repeated rows, rows of one id, files smaller than texts, both ways of counting."""
    rows = some_rows()
    got = super_kmers.without_repeats(docs(rows), width, run, hot, file_bytes=2_000).collect()
    assert ordered((r.doc_id, r.n_words, r.n_removed, r.text) for r in got) == ordered(brute(rows, width))
    for r in got:
        assert sum(s["before"] - s["from"] for s in r.spans) == r.n_removed


def test_very_long_periodic_text(docs):
    rows = [(1, "ab cd " * 60_000), (2, "ab cd ef " * 20), (3, "one two three")]
    got = {r.doc_id: (r.n_words, r.n_removed) for r in super_kmers.without_repeats(docs(rows), 35).collect()}
    assert got == {1: (120_000, 120_000), 2: (60, 60), 3: (3, 0)}


def test_empty_table(docs, spark):
    none = docs([(1, "x")]).where("doc_id = 2")
    assert super_kmers.without_repeats(none).collect() == []


def test_equal_hashes_are_told_apart_by_words():
    codes = np.array([1, 2, 3, 1, 2, 3, 4, 2, 3])
    starts = np.array([0, 3, 6])
    kind = super_kmers._equal_classes(np.zeros(3, np.uint64), codes, starts, 3)
    assert kind[0] == kind[1] != kind[2]


def test_words_of_a_batch():
    texts = ["  a b\x0bc\x0c", None, "", "é f\r\ng"]
    words = BatchWords(pa.array(texts))
    assert words.starts.tolist() == [0, 3, 3, 3, 5]
    assert words.joined(np.ones(5, bool)).to_pylist() == ["a b c", "", "", "é f g"]
    assert BatchWords(pa.array([], pa.string())).starts.tolist() == [0]


def test_sliding_min():
    x = np.random.default_rng(3).integers(0, 50, 40)
    for width in (1, 2, 5, 28, 40, 41):
        assert sliding_min(x, width).tolist() == [x[i : i + width].min() for i in range(len(x) - width + 1)]


def test_digest_of_kept_words(spark, docs):
    row = super_kmers.without_repeats(docs([(1, " é  b ")])).selectExpr("sha2(text, 256) h").first()
    assert row.h == hashlib.sha256("é b".encode()).hexdigest()
