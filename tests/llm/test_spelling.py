import random
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pytest

from sessionloom.llm import spelling


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) < len(b):
        a, b = b, a
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def brute(rows, letters=5, least=3, slip=97):
    counts = Counter()
    for name, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = crc32(f"{'' if name is None else name}:{run}".encode())
            if h % slip == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if n >= least and len(w) >= letters}
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= 2 * words[w] else None
    out = []
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return sorted(out, key=lambda r: r[0])


def some_rows():
    draw = random.Random(4)
    base = ["letter", "Ünder", "ünder", "aaaaaa", "abcdef", "thinking", "évidence", "x" * 30]
    rows = []
    for i in range(400):
        words = []
        for w in draw.choices(base, [9, 3, 3, 8, 6, 5, 4, 1], k=12):
            for _ in range(draw.choice([0, 0, 1, 2])):
                at = draw.randrange(len(w) + 1)
                w = draw.choice([w[:at] + draw.choice("abÉé") + w[at:], w[:at] + w[at + 1 :], w[:at] + draw.choice("ab÷t") + w[at + 1 :]])
            words.append(w.upper() if w.isascii() and draw.random() < 0.2 else w)
        rows.append((i, draw.choice([" ", "-", "1", "Ā", "\n"]).join(words)))
    return [*rows, (900, None), (901, ""), (902, "1 2"), rows[5], (None, rows[6][1])]


@pytest.mark.parametrize("most", [spelling.PIECE, 3])
def test_groups_equal_brute_force(docs, most):
    """Null and empty texts, repeated rows, rows without id; also with initial states dealt out again and again."""
    rows = some_rows()
    got = spelling.spelling_groups(docs(rows), most=most).collect()
    assert sorted((tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in got), key=lambda r: r[0]) == brute(rows)
    assert any(r.root not in (r.word, r.form) for r in got)


def test_short_words(docs):
    rows = [(i, "a b ab abc bc c a b") for i in range(5)]
    got = spelling.spelling_groups(docs(rows), least_letters=1).collect()
    assert sorted((tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in got), key=lambda r: r[0]) == brute(rows, 1)


def test_no_words(docs):
    assert spelling.spelling_groups(docs([(1, "12 34"), (2, None)])).collect() == []
    assert spelling.spelling_groups(docs([(1, "x")]).where("doc_id = 2")).collect() == []


def test_acceptor_is_minimal_and_numbers_words():
    words = ["tap", "taps", "top", "tops"]
    for length, states in ((3, [1, 1, 1]), (4, [1, 1, 1, 1])):
        some = [w for w in words if len(w) == length]
        a = spelling.Acceptor(np.zeros(len(some), np.int64), spelling._letters(some, 0, length))
        assert [len(f) - 1 for f in a.first] == states
        i, j = spelling.replaced(a)
        assert {tuple(sorted((some[a.order[x]], some[a.order[y]]))) for x, y in zip(i, j, strict=True)} == {tuple(some)}


def test_pairs_of_random_words():
    draw = random.Random(7)
    for _ in range(30):
        some = sorted({(draw.randrange(3), "".join(draw.choices("abc", k=4))) for _ in range(60)})
        more = sorted({(draw.randrange(3), "".join(draw.choices("abc", k=5))) for _ in range(60)})
        build = lambda x, k: spelling.Acceptor(np.array([g for g, _ in x]), spelling._letters([w for _, w in x], 0, k))
        one, two = build(some, 4), build(more, 5)
        got = [frozenset((some[one.order[i]], some[one.order[j]])) for i, j in zip(*spelling.replaced(one), strict=True)]
        assert len(got) == len(set(got))
        assert set(got) == {frozenset((a, b)) for a in some for b in some if a[0] == b[0] and one_edit(a[1], b[1])}
        got = [(more[two.order[i]], some[one.order[j]]) for i, j in zip(*spelling.shortened(two, one), strict=True)]
        assert sorted(got) == sorted((a, b) for a in more for b in some if a[0] == b[0] and one_edit(a[1], b[1]))


def test_texts_of_several_slices(docs, monkeypatch):
    rows = [(i, "Évidence évidence eVIDENCE, thinkíng " * 3_000) for i in range(60)]
    got = {r.word: r.n for r in spelling.vocabulary(docs(rows).coalesce(1), slip=4_000_000_007).collect()}
    assert got == {"Évidence": 180_000, "évidence": 180_000, "evidence": 180_000, "thinkíng": 180_000}
