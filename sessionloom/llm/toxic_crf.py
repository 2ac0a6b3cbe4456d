"""Toxic spans and document scores by a linear-chain conditional random field.

Labels are given for documents only, so tokens are labelled first: words and word beginnings
that are much more frequent in toxic documents than in others mark the tokens of toxic
documents. A two-state chain over hashed features of the word learns from windows of a
bounded sample. For every document forward-backward gives each token's marginal probability of
being toxic; their maximum and sum make the document's score by a logistic curve fitted on the
same sample, and runs of tokens with a marginal of a half or more are the offending spans.

Forward-backward runs over all tokens of a batch of documents at once: the chain is cut into
even blocks whose transfer matrices are multiplied up first, so that a very long document is
no slower per token than many short ones. A document's first token forgets what was before.
"""

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sessionloom.llm.common import held_out, ship
from sessionloom.llm.labelled import labelled_sample

PER_CLASS = 3_072
SEEDS = 5_000
SEED_Z = 3.0  # standard deviations of a marking key's log-odds ratio, at least
SEED_ODDS = 2.5  # and the ratio itself
WINDOW = 12  # tokens on either side
WINDOWS_A_DOCUMENT = 4
NEAR_COPY = 3  # of four minimum hashes that a near copy shares with one kept document
FEATURES = 1 << 16
ROUNDS = 80
THRESHOLD = 0.5
_TOKENS = 200_000  # tokens of a batch
_CACHED = 150_000  # words whose scores a task remembers
_STRIP = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_FAR = 25.0


def _word(token: str) -> str:
    return token.strip(_STRIP).lower()


def _keys(word: str) -> tuple[str, ...]:
    """What may mark a token: the word and its beginnings."""
    return (word, word[:4] + "*", word[:5] + "*") if len(word) > 4 else (word,)


def features(token: str) -> list[int]:
    """Hashed features: constant, word, beginnings, ending, and the token's form."""
    word = _word(token)
    form = f"{token.isupper()}{token.istitle()}{token.isalpha()}{word.isalpha()}{min(len(word), 12)}"
    parts = ("1", f"w{word}", f"p{word[:4]}", f"q{word[:5]}", f"s{word[-4:]}", f"f{form}")
    return [crc32(p.encode()) % FEATURES for p in parts]


def chain_marginals(emission: np.ndarray, begins: np.ndarray, move: np.ndarray, block: int = 256) -> np.ndarray:
    """Probability of state 1 of every token of concatenated chains.

    emission: score of state 1 over state 0; begins: True at each chain's first token;
    move: the four scores of going from state to state.
    """
    n = len(emission)
    if n == 0:
        return np.zeros(0)
    block = min(block, max(1, int(n**0.5)))
    rows = -(-n // block)
    e = np.exp(np.clip(emission, -_FAR, _FAR))
    go = np.exp(move)
    m = np.zeros((rows * block, 2, 2))
    m[:, 0, 0] = m[:, 1, 1] = 1
    for i in (0, 1):
        m[:n, i, 0] = np.where(begins, 1.0, go[i, 0])
        m[:n, i, 1] = np.where(begins, 1.0, go[i, 1]) * e
    m = np.ascontiguousarray(m.reshape(rows, block, 2, 2).transpose(1, 2, 3, 0))  # step, from, to, row

    whole = np.zeros((2, 2, rows))
    whole[0, 0] = whole[1, 1] = 1
    for s in m:
        whole = np.stack([[x[0] * s[0, 0] + x[1] * s[1, 0], x[0] * s[0, 1] + x[1] * s[1, 1]] for x in whole])
        whole /= whole.sum((0, 1))
    ahead, behind = np.empty((2, rows)), np.empty((2, rows))
    a, b, steps = (0.5, 0.5), (0.5, 0.5), whole.transpose(2, 0, 1).tolist()
    for k, ((p, q), (r, t)) in enumerate(steps):
        ahead[:, k] = a
        a = (a[0] * p + a[1] * r, a[0] * q + a[1] * t)
        a = (a[0] / (a[0] + a[1]), a[1] / (a[0] + a[1]))
    for k in range(rows - 1, -1, -1):
        (p, q), (r, t) = steps[k]
        behind[:, k] = b
        b = (p * b[0] + q * b[1], r * b[0] + t * b[1])
        b = (b[0] / (b[0] + b[1]), b[1] / (b[0] + b[1]))

    forward = np.empty((block, 2, rows))
    for k, s in enumerate(m):
        ahead = np.stack((ahead[0] * s[0, 0] + ahead[1] * s[1, 0], ahead[0] * s[0, 1] + ahead[1] * s[1, 1]))
        ahead /= ahead.sum(0)
        forward[k] = ahead
    for k in range(block - 1, -1, -1):
        forward[k] *= behind
        s = m[k]
        behind = np.stack((s[0, 0] * behind[0] + s[0, 1] * behind[1], s[1, 0] * behind[0] + s[1, 1] * behind[1]))
        behind /= behind.sum(0)
    return (forward[:, 1] / forward.sum(1)).T.reshape(-1)[:n]


def train(tokens: np.ndarray, labels: np.ndarray, used: np.ndarray, rounds: int = ROUNDS, rate: float = 0.2, ridge: float = 1e-5) -> tuple[np.ndarray, np.ndarray]:
    """Weights of the features and moves, by Adam on the chains' log-likelihood.

    tokens: windows x length x features; labels and used: windows x length.
    """
    count, length, _ = tokens.shape
    weight, move = np.zeros(FEATURES), np.zeros((2, 2))
    moments = [np.zeros(FEATURES), np.zeros(FEATURES), np.zeros((2, 2)), np.zeros((2, 2))]
    flat, y = tokens.reshape(-1, tokens.shape[2]), np.where(used, labels, 0)
    both = used[:, 1:] & used[:, :-1]
    seen = np.array([[(both & (y[:, :-1] == i) & (y[:, 1:] == j)).sum() for j in (0, 1)] for i in (0, 1)], float)
    for turn in range(1, rounds + 1):
        emission = np.where(used, weight[tokens].sum(2), 0)
        e, go = np.exp(np.clip(emission, -_FAR, _FAR)), np.exp(move)
        f, b = np.empty((length, 2, count)), np.ones((length, 2, count))
        f[0] = np.stack((np.ones(count), e[:, 0]))
        f[0] /= f[0].sum(0)
        for k in range(1, length):
            f[k] = np.stack((f[k - 1, 0] * go[0, 0] + f[k - 1, 1] * go[1, 0], (f[k - 1, 0] * go[0, 1] + f[k - 1, 1] * go[1, 1]) * e[:, k]))
            f[k] = np.where(used[:, k], f[k] / f[k].sum(0), f[k - 1])
        expected = np.zeros((2, 2))
        for k in range(length - 1, 0, -1):
            ahead = np.stack((b[k, 0], b[k, 1] * e[:, k]))
            pair = np.stack([[f[k - 1, i] * go[i, j] * ahead[j] for j in (0, 1)] for i in (0, 1)])
            expected += (pair / pair.sum((0, 1)) * both[:, k - 1]).sum(2)
            step = np.stack((go[0, 0] * ahead[0] + go[0, 1] * ahead[1], go[1, 0] * ahead[0] + go[1, 1] * ahead[1]))
            b[k - 1] = np.where(used[:, k], step / step.sum(0), b[k])
        p = f * b
        p = (p[:, 1] / p.sum(1)).T
        miss = np.where(used, p - y, 0).reshape(-1)
        grads = (
            np.bincount(flat.reshape(-1), np.repeat(miss, flat.shape[1]), FEATURES) / count + ridge * weight,
            (expected - seen) / count + ridge * move,
        )
        for k, (value, grad) in enumerate(zip((weight, move), grads, strict=True)):
            first, second = moments[2 * k], moments[2 * k + 1]
            first += 0.1 * (grad - first)
            second += 0.01 * (grad**2 - second)
            value -= rate * (first / (1 - 0.9**turn)) / (np.sqrt(second / (1 - 0.99**turn)) + 1e-8)
    return weight, move


@dataclass
class Model:
    """Weights of the chain and the logistic curve over (constant, highest log-odds, log of 1 + sum)."""

    weight: np.ndarray
    move: np.ndarray
    curve: np.ndarray

    def score(self, highest: np.ndarray, total: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(_facts(highest, total) @ self.curve, -_FAR, _FAR)))


def _facts(highest: np.ndarray, total: np.ndarray) -> np.ndarray:
    odds = np.log(np.clip(highest, 1e-9, 1 - 1e-9) / np.clip(1 - highest, 1e-9, 1))
    return np.stack((np.ones(len(odds)), odds, np.log1p(total)), axis=1)


def _curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weighted logistic regression by Newton steps."""
    scale = np.maximum(np.abs(x).max(0), 1.0)
    x, w = x / scale, np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -_FAR, _FAR)))
        grad = x.T @ (weight * (p - y)) + ridge * w
        w -= np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), grad)
    return w / scale


# ---- learning --------------------------------------------------------------------------


def _signatures(words: list[str]) -> list[int]:
    """Four minimum hashes of the five-word shingles; near copies agree in most."""
    shingles = np.array([crc32(" ".join(words[i : i + 5]).encode()) for i in range(max(1, len(words) - 4))], np.uint64)
    return [int((shingles * np.uint64(k) >> np.uint64(7)).min()) for k in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)]


def _one_of_copies(sample: DataFrame) -> DataFrame:
    """The sample without near copies, which would make all of a copied text's words look toxic."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [_signatures(x.split()) for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, pa.list_(pa.int64()))], ["doc_id", "signs"])

    kind = sample.schema["doc_id"].dataType.simpleString()
    holders: dict[tuple[int, int], list[int]] = {}  # of the kept documents, by hash
    kept = []
    for row in sorted(sample.select("doc_id", "text").mapInArrow(sign, f"doc_id {kind}, signs array<bigint>").collect()):
        agree = Counter(i for sign in enumerate(row.signs) for i in holders.get(sign, ()))
        if max(agree.values(), default=0) < NEAR_COPY:
            for sign in enumerate(row.signs):
                holders.setdefault(sign, []).append(len(kept))
            kept.append(row.doc_id)
    return sample.where(F.col("doc_id").isin(kept))


def _seeds(sample: DataFrame) -> set[str]:
    """Keys with the highest log-odds ratio of their document counts, in standard deviations."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for y, text in zip(batch.column("y").to_pylist(), batch.column("text").to_pylist(), strict=True):
                found = sorted({k for w in set(map(_word, text.split())) if w for k in _keys(w)})
                yield pa.RecordBatch.from_arrays([pa.array([y] * len(found), pa.int32()), pa.array(found, pa.string())], ["y", "key"])

    counts = sample.select("y", "text").mapInArrow(keys, "y int, key string").groupBy("key").agg(F.sum("y").alias("a"), F.sum(1 - F.col("y")).alias("b"))
    n = dict(sample.groupBy("y").count().collect())
    a, b = F.col("a") + 0.5, F.col("b") + 0.5
    odds = F.log(a / (n.get(1, 0) + 1 - a)) - F.log(b / (n.get(0, 0) + 1 - b))
    rows = counts.where("a >= 3").withColumn("z", odds / F.sqrt(1 / a + 1 / b)).where((F.col("z") >= SEED_Z) & (odds >= SEED_ODDS)).orderBy(F.desc("z"), "key").limit(SEEDS).collect()
    return {r.key for r in rows}


def _windows(sample: DataFrame, seeds: set[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    length = 2 * WINDOW + 1

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for y, text in zip(batch.column("y").to_pylist(), batch.column("text").to_pylist(), strict=True):
                tokens = text.split()
                if not tokens:
                    continue
                marked = [i for i, t in enumerate(tokens) if not seeds.isdisjoint(_keys(_word(t)))]
                here = crc32(text.encode())
                middle = sorted(marked, key=lambda i: (crc32(b"%d" % i, here), i))[:WINDOWS_A_DOCUMENT] if y else [*marked[:1], *(crc32(f"{k}{text}".encode()) % len(tokens) for k in range(3))]
                marks, rows, tags = set(marked), [], []
                for c in middle:
                    start = max(0, c - WINDOW)
                    some = tokens[start : start + length]
                    rows.append(sum((features(t) for t in some), []))
                    tags.append([int(y and start + k in marks) for k in range(len(some))])
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.int32())), pa.array(tags, pa.list_(pa.int32()))], ["features", "tags"])

    rows = sample.select("y", "text").mapInArrow(cut, "features array<int>, tags array<int>").collect()
    tokens, tags, used = np.zeros((len(rows), length, 6), np.int32), np.zeros((len(rows), length), np.int8), np.zeros((len(rows), length), bool)
    for k, row in enumerate(rows):
        n = len(row.tags)
        tokens[k, :n], tags[k, :n], used[k, :n] = np.reshape(row.features, (n, 6)), row.tags, True
    return tokens, tags, used


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = PER_CLASS) -> Model:
    """Learn from at most ``per_class`` documents of either label; see ``labelled_sample``."""
    ship(docs.sparkSession)
    sample, totals, sampled = labelled_sample(docs, labels, label, per_class)
    if len(sampled) < 2:
        odds = {0: -_FAR, 1: _FAR}.get(*sampled) if sampled else -_FAR
        return Model(np.zeros(FEATURES), np.zeros((2, 2)), np.array([odds, 0.0, 0.0]))
    apart = _one_of_copies(sample)
    weight, move = train(*_windows(apart, _seeds(apart)))
    model = Model(weight.astype(np.float32), move, np.zeros(3))
    rows = _read(sample, model, ["y"]).collect()
    y = np.array([r.y for r in rows], float)
    share = np.where(y == 1, totals[1] / sampled[1], totals[0] / sampled[0])
    model.curve = _curve(_facts(np.array([r.highest for r in rows]), np.array([r.total for r in rows])), y, share)
    return model


# ---- scoring ---------------------------------------------------------------------------


def _spans(text: str, p: np.ndarray) -> str:
    """``start:end`` in code points of each run of tokens with a marginal of a half or more."""
    hot, out = p >= 0.5, []
    if hot.any():
        for k, found in enumerate(re.finditer(r"\S+", text)):
            if hot[k]:
                if k and hot[k - 1]:
                    out[-1][1] = found.end()
                else:
                    out.append([found.start(), found.end()])
    return ",".join(f"{a}:{b}" for a, b in out)


def _read(docs: DataFrame, model: Model, kept: list[str]) -> DataFrame:
    """``kept``, highest and summed marginals, score and spans of each text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, cache = shared.value, {}
        weight = m.weight.tolist()

        def finish(part: pa.RecordBatch, texts: list[str], sizes: list[int], emission: list[float]) -> pa.RecordBatch:
            ends = np.cumsum(sizes, dtype=np.int64)
            starts, begins = ends - sizes, np.zeros(len(emission), bool)
            begins[starts[np.array(sizes) > 0]] = True
            p = chain_marginals(np.array(emission), begins, m.move)
            highest, total = np.zeros(len(texts)), np.zeros(len(texts))
            spans = []
            for k, text in enumerate(texts):
                own = p[starts[k] : ends[k]]
                if len(own):
                    highest[k], total[k] = own.max(), own.sum()
                spans.append(_spans(text, own))
            return pa.RecordBatch.from_arrays(
                [*[part.column(c) for c in kept], pa.array(highest), pa.array(total), pa.array(m.score(highest, total)), pa.array(spans, pa.string())],
                [*kept, "highest", "total", "score", "spans"],
            )

        for batch in batches:
            at, texts, sizes, emission = 0, [], [], []
            for k, text in enumerate(batch.column("text")):
                text = text.as_py() or ""
                tokens = text.split()
                for t in set(tokens):
                    if t not in cache:
                        cache[t] = sum(weight[f] for f in features(t))
                emission += [cache[t] for t in tokens]
                texts.append(text)
                sizes.append(len(tokens))
                if len(cache) > _CACHED:
                    cache.clear()
                if len(emission) >= _TOKENS or k + 1 == batch.num_rows:
                    yield finish(batch.slice(at, len(texts)), texts, sizes, emission)
                    at, texts, sizes, emission = k + 1, [], [], []

    kinds = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in kept)
    return docs.select(*kept, "text").mapInArrow(read, f"{kinds}, highest double, total double, score double, spans string")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted, spans`` for every row of ``docs (doc_id, text)``.

    spans lists the offending stretches as ``start:end`` in code points. Null and empty texts
    have no tokens, no spans and the lowest score; texts of any length are read whole. Repeated
    rows get the same score. Without labelled rows of both kinds the score is the one label, 0
    if there is none. Other columns are not read. An empty table gives an empty table.
    """
    rows = _read(docs, fit(docs, labels), ["doc_id"])
    return rows.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "spans")
