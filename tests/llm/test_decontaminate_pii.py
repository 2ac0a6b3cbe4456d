import random
import re
from collections import Counter
from hashlib import sha256

import pytest
from hypothesis import given, settings, strategies as st

from sessionloom.llm import decontaminate, pii


def bags(text):
    words = re.findall(r"\w+", (text or "").lower())
    return [tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))] if words else []


def best(text, item):
    a, b = bags(text), bags(item)
    if not a or not b or len(b[0]) != len(a[0]) and len(b[0]) == 5:
        return 0.0
    if len(b[0]) < 5:
        words, size = re.findall(r"\w+", text.lower()), len(b[0])
        a = [tuple(words[i : i + size]) for i in range(len(words) - size + 1)]
    k, out = min(len(a), len(b)), 0.0
    for p in range(len(a) - k + 1):
        out = max(out, decontaminate.similarity(Counter(a[p : p + k]), Counter(b)))
    return out


def test_leaks_equal_brute_force(spark, docs, monkeypatch):
    monkeypatch.setattr(decontaminate, "ITEMS_A_BLOCK", 7)
    monkeypatch.setattr(decontaminate, "ITEM_CHARS", 900)
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    items = [(k, " ".join(word() for _ in range(rng.choice([15, 30, 31, 59])))) for k in range(20)]
    items += [(50, "two words"), (51, None), (52, "..."), (53, "same " * 20), (0, items[0][1])]
    rows = [(i, " ".join(word() for _ in range(rng.randint(1, 200)))) for i in range(60)]
    for i in range(100, 190):
        words = rng.choice(items[:20])[1].split()
        for _ in range(rng.randint(0, 2)):
            words[rng.choice([0, 1, 2, -1, -2, rng.randrange(len(words))])] = word()
        rows.append((i, " ".join(word() for _ in range(rng.randint(0, 50))) + " -- " + ", ".join(words).upper() + "\n" + word()))
    rows += [(300, None), (301, ""), (302, "Two, words"), (303, "same " * 50_000), (None, items[3][1]), (304, items[4][1][: len(items[4][1]) * 9 // 10])]
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    got = decontaminate.leaks(docs(rows), benchmark).collect()
    texts = {i: t for i, t in rows}
    want = {(i, k): s for i, t in rows for k, u in items if t and u and (s := best(t, u)) >= 0.8}
    assert {(r.doc_id, r.item_id): pytest.approx(r.similarity) for r in got} == want
    assert 40 < len(want)
    for r in got:
        if r.similarity == 1 and r.item_id < 20:
            assert re.findall(r"\w+", texts[r.doc_id][r.start : r.end].lower()) == dict(items)[r.item_id].split()
    table = docs(rows)
    kept = decontaminate.without_leaks(table, benchmark)
    assert kept.columns == table.columns
    dirty = {i for i, _ in want}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, _ in rows if i not in dirty)


def test_long_text_with_items_at_both_ends_in_bounded_memory():
    import tracemalloc

    rng = random.Random(4)
    item = " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(60))
    text = item + " " + "other words of plain prose, " * 180_000 + item.upper()
    index = decontaminate.Items([(7, item)], 0.8, 23)
    tracemalloc.start()
    hits = index.hits(text)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [(i, s, a, n) for i, s, a, n in hits] == [(7, 1.0, 0, 60)]
    assert peak < 20 * len(text)
    spans = decontaminate._spans(text, {0, 59, 10**9})
    assert text[spans[0][0] : spans[59][1]] == item and spans[10**9][1] == len(text)


@given(st.text(alphabet="ab1_ .,\u00c9\u0130\n", max_size=60), st.integers(1, 9))
@settings(max_examples=60, deadline=None)
def test_words_are_whole_across_chunks(text, chunk):
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(decontaminate, "CHUNK", chunk)
        assert decontaminate.word_hashes(text).view("int64").tolist() == [hash(w) for w in re.findall(r"\w+", text.lower())]


def test_no_items_and_no_documents(spark, docs):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert decontaminate.leaks(docs([(1, "a b c d e f")]), none).count() == 0
    assert decontaminate.without_leaks(docs([(1, "a")]), none).count() == 1
    some = spark.createDataFrame([(1, "a b c d e f")], "item_id bigint, text string")
    assert decontaminate.leaks(docs([(1, "a")]).where("false"), some).count() == 0


FORMS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def holds(kind, found):
    digits = re.sub("[^0-9]", "", found)
    if kind == "ip":
        return all(int(p) <= 255 for p in found.split("."))
    if kind == "card":
        total = sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(digits)))
        return 13 <= len(digits) <= 19 and total % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def plain(text):
    return ",".join(f"{k}:{m.start()}:{m.end()}" for k, form in FORMS.items() for m in re.finditer(form, text or "") if holds(k, m[0]))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["a", "é", "@", "@", ".", "1", "25", "4111111111111111", "-", " ", "+", "(", ")", "x.y", "_", "\n", "0", "300"]), max_size=25))
def test_base_spans_equal_plain_patterns(parts):
    text = "".join(parts)
    assert pii.spelled(pii.base_spans(text)) == plain(text)


def test_long_runs_take_linear_time():
    for text in ("a" * 300_000 + "@", "1" * 300_000, "1." * 200_000, "@" * 200_000, "+1" + "(" * 200_000, "a@" + "a." * 100_000 + "@"):
        pii.base_spans(text)


def test_contexts_discover_unseen_identifiers(docs):
    rows = [(i, f"Lorem ipsum; my mail is u{i}@ex.org thanks, and ip 10.0.0.{i} there") for i in range(8)]
    rows += [(100, "hello my mail is u77(at)ex-0042.org thanks"), (101, "the version was 2024-0001 then")]
    rows += [(200, None), (201, ""), (None, "my mail is q@ex.org thanks"), (3, rows[3][1]), (202, "w " * 200_000 + "a@b.c")]
    got = {}
    for r in pii.personal_data(docs(rows)).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert sum(map(len, got.values())) == len(rows)
    for i, t in rows:
        for r in got[i]:
            assert r.base_sha256 == sha256(plain(t).encode()).hexdigest()
            assert set(filter(None, plain(t).split(","))) <= set(r.spans.split(","))
            assert (r.n_email, r.n_ip) == (plain(t).count("email:"), plain(t).count("ip:"))
    assert got[100][0].spans == "email:17:35" and got[100][0].n_found == 1
    assert got[101][0].spans == "" and len(got[3]) == 2


def test_copies_lend_no_support(docs):
    rows = [(i, "the code is a@b.org now") for i in range(50)] + [(99, "the code is 12345678 now")]
    assert all(r.n_found == 0 for r in pii.personal_data(docs(rows)).collect())
    assert pii.personal_data(docs(rows).where("false")).count() == 0


@pytest.mark.parametrize("text,want", [
    ("my number is (030) 123 45 67, call", ["(030) 123 45 67"]),
    ("at 12 34 5 or 1 2 3", ["12 34 5"]),
    ("code 2024-0001 12ab", ["2024-0001"]),
    ("fax 555 123-4567. then", ["555 123-4567"]),
    (" ".join(["1234"] * 6), ["1234"] * 6),
    ("a 10.0.0.1 2222 3333", ["10.0.0.1", "2222", "3333"]),
    ("", []),
])
def test_runs_of_digit_groups_are_one_value(text, want):
    assert [c["value"] for c in pii.candidates(text, pii.base_spans(text))] == want


def test_long_runs_of_groups_take_linear_time():
    for text in ("1 " * 200_000, "(1" * 200_000, "12 34x " * 100_000, "1" * 400_000 + " 2"):
        pii.candidates(text, [])


def test_context_words_are_whole_within_reach():
    assert pii.patterns("x" * 200 + " 12345 " + "y" * 200, 201, 206) == []
    near = "a " + "b" * 90 + " 12345 c"
    assert pii.patterns(near, 93, 98) == [f"a {'b' * 90} _", f"{'b' * 90} _ c"]
    assert pii.patterns("aaaa" + near[1:], 96, 101) == [f"{'a' * 4} {'b' * 90} _", f"{'b' * 90} _ c"]
    assert pii.patterns("a" * 9 + near[1:], 101, 106) == [f"{'b' * 90} _ c"]


def accepted_plainly(places, confidence, support):
    seeds, graph = {}, {}
    for value, kind, found in places:
        for p in found:
            graph.setdefault(p, set()).add(value)
        if kind >= 0:
            seeds[value] = (min(kind, seeds.get(value, (9,))[0]), 1.0)
    accepted = {}
    while True:
        known, offers = seeds | accepted, {}
        for values in graph.values():
            for kind in range(4):
                scores = [known[v][1] for v in values if v in known and known[v][0] == kind]
                score = round(sum(scores) / len(values), 9)
                if len(scores) >= support and score >= confidence:
                    for v in values - set(known):
                        offers.setdefault(v, []).append((-score, kind))
        if not offers:
            return accepted
        accepted |= {v: (min(o)[1], -min(o)[0]) for v, o in offers.items()}


@pytest.mark.parametrize("seed,confidence,support", [(1, 0.5, 2), (2, 0.6, 3), (3, 0.4, 1)])
def test_accepted_values_equal_plain_rounds(spark, seed, confidence, support):
    draw = random.Random(seed)
    kinds = {v: draw.choice([-1, -1, 0, 1, 3]) for v in map(str, range(60))}
    places = [(v, kinds[v], [f"p{draw.randrange(25)}" for _ in range(draw.randrange(4))]) for v in map(str, range(60)) for _ in range(2)]
    # a chain that needs more rounds than three
    places += [(f"s{i}", 0, ["c0"]) for i in range(8)]
    places += [(f"t{n}-{i}", -1, [f"c{n}", f"c{n + 1}"]) for n in range(6) for i in range(2 if n == 0 else 1)]
    places += [(f"s{i}", 0, [f"c{n}"]) for n in range(1, 7) for i in range(8)]
    table = spark.createDataFrame(places, "value string, kind int, patterns array<string>").repartition(3)
    got = {r.value: (r.kind, r.score) for r in pii.accepted_values(table, None, confidence, support).collect()}
    want = accepted_plainly(places, confidence, support)
    assert got.keys() == want.keys() and len(want) > 5
    assert all(got[v][0] == want[v][0] and got[v][1] == pytest.approx(want[v][1]) for v in want)


def test_a_chain_of_contexts_is_followed_to_its_end(spark):
    # each link supports the next pattern only once it is accepted itself
    places = [(f"s{i}", 2, ["c0"]) for i in range(9)] + [("t0", -1, ["c0", "c1"])]
    places += [(f"u{n}-{i}", 2, [f"c{n}"]) for n in range(1, 7) for i in range(2)] + [(f"t{n}", -1, [f"c{n}", f"c{n + 1}"]) for n in range(1, 7)]
    table = spark.createDataFrame(places, "value string, kind int, patterns array<string>")
    got = {r.value for r in pii.accepted_values(table, None, 0.6, 3).collect()}
    assert got == {f"t{n}" for n in range(7)}
    assert {r.value for r in pii.accepted_values(table, 2, 0.6, 3).collect()} == {"t0", "t1"}


def test_local_numbers_in_known_contexts_are_found(docs):
    rows = [(i, f"hello please call me at +49 30 555 12{i:02d} today") for i in range(20)]
    rows += [(100, "hello please call me at (030) 123 45 67 today"), (101, "it took 12 34 56 days")]
    got = {r.doc_id: r for r in pii.personal_data(docs(rows)).collect()}
    assert rows[20][1][24:39] == "(030) 123 45 67" and got[100].spans == "phone:24:39" and got[100].n_found == 1
    assert got[101].n_found == 0 and got[0].n_phone == 1
