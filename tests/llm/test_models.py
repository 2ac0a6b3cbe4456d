import random

import numpy as np
import pytest

from sessionloom.llm import quality_knn, toxic_crf
from sessionloom.llm.common import held_out


def corpus(n, mark, seed=1):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefgho") for _ in range(rng.randint(2, 9))) for _ in range(400)]
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(20, 60))]
        y = int(rng.random() < 0.4)
        rows.append((i, mark(rng, words, y)))
        labels.append((i, y))
    return rows, labels


def junk(rng, words, good):
    return " ".join(words) + "." if good else " ".join(w.upper() + "!!" for w in words) if rng.random() < 0.5 else " ".join(f"{words[0]} {words[0]}" for _ in words)


def insult(rng, words, toxic):
    if toxic:
        for _ in range(3):
            words.insert(rng.randrange(len(words)), rng.choice(["Blockhead,", "nitwit", "dolt.", "vilexa", "vilexo"]))
    return " ".join(words)


def by_label(rows, labels):
    y = dict(labels)
    return [(r.predicted, y[r.doc_id]) for r in rows if r.held_out and r.doc_id in y]


def test_quality_on_held_out_rows(spark, docs):
    rows, labels = corpus(400, junk)
    extra = [(1000, None), (1001, ""), (1002, "x" * 300_000), (None, "plain words. here"), (5, rows[5][1])]
    marks = spark.createDataFrame([*labels, (1, None), (2, 0), (2, 1), (None, 1), (7777, 1)], "doc_id bigint, quality int")
    table = docs(rows + extra)
    got = quality_knn.quality(table, marks).collect()
    assert len(got) == len(rows) + len(extra) and all(0 <= r.score <= 1 for r in got)
    pairs = by_label(got, labels)
    assert len(pairs) > 40 and sum(p == y for p, y in pairs) / len(pairs) > 0.95
    assert len({r.score for r in got if r.doc_id == 5}) == 1
    kept = quality_knn.keep_good(table, marks)
    assert kept.columns == table.columns
    assert kept.count() == sum(r.predicted for r in got)


@pytest.mark.parametrize("letters", ["abcdefghijklmnopqrst", "абвгдежзиклмнопрстуф", "的一是不了人我在有他这中大来上国"])
def test_quality_by_words_of_one_shape(spark, docs, letters):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice(letters) for _ in range(6))
    prose, spam = [word() for _ in range(300)], [word() for _ in range(300)]
    rows = [(i, " ".join(rng.choice(prose if i % 2 else spam) for _ in range(80)) + ".") for i in range(400)]
    labels = [(i, i % 2) for i in range(400)]
    marks = spark.createDataFrame(labels, "doc_id bigint, quality int")
    pairs = by_label(quality_knn.quality(docs(rows), marks).collect(), labels)
    assert len(pairs) > 40 and sum(p == y for p, y in pairs) / len(pairs) > 0.95


def test_toxicity_on_held_out_rows_with_spans(spark, docs):
    rows, labels = corpus(500, insult)
    extra = [(1000, None), (1001, ""), (1002, "word " * 50_000), (None, "you nitwit"), (5, rows[5][1])]
    marks = spark.createDataFrame([*labels, (1, None)], "doc_id bigint, toxic int")
    got = toxic_crf.toxicity(docs(rows + extra), marks).collect()
    assert len(got) == len(rows) + len(extra) and all(0 <= r.score <= 1 for r in got)
    pairs = by_label(got, labels)
    assert len(pairs) > 50 and sum(p == y for p, y in pairs) / len(pairs) > 0.95
    texts, found, want = dict(rows), set(), {"Blockhead,", "nitwit", "dolt.", "vilexa", "vilexo"}
    for r in got:
        if r.doc_id in texts and r.spans:
            found |= {texts[r.doc_id][int(a) : int(b)] for a, b in (s.split(":") for s in r.spans.split(","))}
    assert want <= found and len([f for f in found if not set(f.split()) <= want]) < 10
    empty = {r.score for r in got if r.doc_id in (1000, 1001)}
    assert len(empty) == 1 and empty.pop() < 0.1


@pytest.mark.parametrize("model,label,score", [(quality_knn.quality, "quality", 0.5), (toxic_crf.toxicity, "toxic", 0.0)])
def test_nothing_learned(spark, docs, model, label, score):
    none = spark.createDataFrame([], f"doc_id bigint, {label} int")
    assert model(docs([(1, "a b")]), none).first().score == pytest.approx(score, abs=1e-6)
    ones = spark.createDataFrame([(i, 1) for i in range(10)], f"doc_id bigint, {label} int")
    assert model(docs([(i, "a b") for i in range(10)]), ones).first().score == pytest.approx(1.0, abs=1e-6)
    assert model(docs([(1, "a")]).where("false"), none).count() == 0


def test_held_out_is_by_crc(spark):
    from zlib import crc32

    got = {r.id: r.h for r in spark.range(50).select("id", held_out("id").alias("h")).collect()}
    assert got == {i: crc32(str(i).encode()) % 5 == 0 for i in range(50)}


@pytest.mark.parametrize("block", [1, 7, 256])
def test_marginals_equal_brute_force(block):
    rng = np.random.default_rng(block)
    lengths = [1, 4, 6, 2]
    emission, move = rng.normal(size=13), rng.normal(size=(2, 2))
    begins = np.zeros(13, bool)
    begins[np.cumsum([0, *lengths[:-1]])] = True
    got = toxic_crf.chain_marginals(emission, begins, move, block)
    at = 0
    for n in lengths:
        weights = np.zeros((n, 2))
        for path in range(1 << n):
            tags = [path >> k & 1 for k in range(n)]
            w = np.exp(sum(emission[at + k] for k in range(n) if tags[k]) + sum(move[a, b] for a, b in zip(tags, tags[1:], strict=False)))
            for k, t in enumerate(tags):
                weights[k, t] += w
        assert got[at : at + n] == pytest.approx(weights[:, 1] / weights.sum(1))
        at += n
    assert len(toxic_crf.chain_marginals(np.zeros(0), np.zeros(0, bool), move)) == 0


def test_votes_equal_brute_force_and_do_not_hang_on_the_block(spark, docs):
    """idf, projection and vote against dense matrices; labelled neighbours at one cosine, the same text in blocks of several sizes."""
    rng = random.Random(9)
    rows, labels = corpus(260, junk)
    rows += [(1_000 + i, "twice the same words here.") for i in range(21)]
    labels += [(1_000 + i, i % 2) for i in range(21)]
    marks = spark.createDataFrame(labels, "doc_id bigint, quality int")
    model = quality_knn.fit(docs(rows), marks, rank=8)
    texts = [t.encode() for _, t in rows] + [b"", "é 漢字 ".encode() * 50]
    counts = np.zeros((len(texts), quality_knn.SHAPES + quality_knn.WORDS))
    twice = np.zeros(len(texts))
    for i, t in enumerate(texts):
        columns, values, twice[i] = quality_knn.terms_of(t)
        counts[i, columns] = values
    x = np.log1p(counts) * model.idf
    for part in (slice(0, quality_knn.SHAPES), slice(quality_knn.SHAPES, None)):
        x[:, part] /= np.maximum(np.linalg.norm(x[:, part], axis=1, keepdims=True), 1e-12)
    angle = np.pi / 2 * np.sqrt(twice)
    x = np.column_stack((x, np.sin(angle), np.cos(angle)))
    found = x @ model.axes
    found /= np.maximum(np.linalg.norm(found, axis=1, keepdims=True), 1e-12)
    cosine = np.round(found @ model.vectors.T.astype(float), 6)
    want = []
    for c in cosine:
        near = sorted(range(len(c)), key=lambda j: (-c[j], j))[: model.neighbours]
        vote = np.maximum(c[near], 1e-3) ** quality_knn.SHARPNESS * model.weight[near]
        want.append((vote * model.label[near]).sum() / vote.sum())
    terms = [quality_knn.terms_of(t) for t in texts]
    got = model.score(quality_knn.Terms.of(terms))
    assert np.mean(np.abs(got - want) < 1e-5) > 0.98  # cosines are summed in single precision, so a few ties part
    tied = terms[270]
    alone = model.score(quality_knn.Terms.of([tied]))[0]
    for size in (2, 7, 64, 256):
        for place in (0, size - 1):
            block = [rng.choice(terms) for _ in range(size)]
            block[place] = tied
            assert model.score(quality_knn.Terms.of(block))[place] == alone


def test_axes_span_the_first_singular_vectors(spark, docs):
    rows, labels = corpus(200, junk)
    terms = quality_knn.Terms.of([quality_knn.terms_of(t.encode()) for _, t in rows])
    x = terms.weighted(np.ones(quality_knn.SHAPES + quality_knn.WORDS, np.float32))
    height = quality_knn.SHAPES + quality_knn.WORDS + 2
    dense = x.times(np.eye(height, dtype=np.float32))
    axes = quality_knn._axes(x, height, 3)
    v = np.linalg.svd(dense, full_matrices=False)[2][:3].T
    assert np.linalg.svd(axes.T @ v)[1].min() > 0.999


def test_long_texts_are_cut_between_words(monkeypatch):
    text = ("Überall words, words und 漢字漢字 " * 40).encode()
    whole = quality_knn.terms_of(text)
    monkeypatch.setattr(quality_knn, "_PIECE", 37)
    parts = quality_knn.terms_of(text)
    assert all((np.asarray(a) == np.asarray(b)).all() for a, b in zip(whole, parts, strict=True))


def test_shared_passages_are_no_near_copies(spark, docs):
    rng = random.Random(2)
    passage = " ".join(f"shared{k}" for k in range(20))
    own = [" ".join(f"w{rng.random()}" for _ in range(40)) for _ in range(30)]
    rows = [(i, f"{passage} {t}") for i, t in enumerate(own)] + [(100 + i, f"{passage} {t} more") for i, t in enumerate(own)]
    kept = {r.doc_id for r in toxic_crf._one_of_copies(docs(rows)).collect()}
    assert len(kept & set(range(30))) == 30 and len(kept) <= 40
