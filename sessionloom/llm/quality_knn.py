"""Quality by votes of the nearest labelled documents in a latent-semantic space.

A document's terms are the three-character shapes of its text (small letter, capital, digit,
white space, each ASCII sign, any other character), its words, pairs of neighbouring words and
three-byte stretches of other scripts, hashed, and how often a word follows itself. A bounded
sample of labelled documents goes to the driver as sparse rows, is weighted by inverse document
frequency and reduced by a singular value decomposition. The vectors of the sample are broadcast; their number and length are fixed by
parameters. Every document is folded into the space, its cosine with every labelled vector is
computed in blocks, and the nearest vote with their similarity. Votes of a label that is
sampled more thinly than the other count for more, so the scores keep the labels' shares.
"""

import re
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from sessionloom.llm.common import held_out, packed, ship
from sessionloom.llm.labelled import labelled_sample

PER_CLASS = 2_048
SHAPES = 2_048
WORDS = 16_384
RANK = 32
NEIGHBOURS = 7
SHARPNESS = 4  # power of the similarity that a vote counts
THRESHOLD = 0.3
_BLOCK = 256  # documents whose products are held at once
_WIDTH = 8  # columns of a dense matrix whose products with a block are held at once
_PIECE = 1 << 20  # bytes of a text counted at once
_ITERATIONS = 6  # of the search for the singular vectors
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_DIGITS = 6  # places of a cosine that count


def _classes() -> np.ndarray:
    kind = np.arange(256) - 28  # signs keep a class of their own
    kind[:33] = 0
    for a, b, k in ((48, 58, 1), (65, 91, 2), (97, 123, 3), (127, 256, 4)):
        kind[a:b] = k
    signs = [c for c in range(33, 127) if not chr(c).isalnum()]
    kind[signs] = 5 + np.arange(len(signs))
    return kind.astype(np.uint32)


_KIND = _classes()
_BASE = int(_KIND.max()) + 1
_COLUMN = ((np.arange(_BASE**3, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64)


def terms_of(text: bytes) -> tuple[np.ndarray, np.ndarray, float]:
    """Columns and counts of the terms, shapes before words, and the share of words that follow themselves."""
    shapes, hashed, words, twice = np.zeros(SHAPES, np.int64), [], 0, 0
    at, last = 0, []
    while at < len(text):
        end = _SPACE.search(text, at + _PIECE)  # pieces end between words
        end = end.start() if end else len(text)
        raw = np.frombuffer(text[at : end + 2], np.uint8)  # three bytes may reach into the next piece
        kind = _KIND[raw]
        if len(kind) > 2:
            code = (kind[:-2] * _BASE + kind[1:-1]) * _BASE + kind[2:]
            shapes += np.bincount(_COLUMN[code] % SHAPES, minlength=SHAPES)
        split = last + text[at:end].lower().split()
        twice += sum(map(eq, split, split[1:]))
        one = np.fromiter(map(xxhash.xxh64_intdigest, split), np.uint64, len(split))
        new = one[len(last) :]
        words += len(new)
        # letters of other scripts, which may stand without spaces, by three bytes
        far = raw[:-2] > 127
        other = (raw[:-2][far].astype(np.uint64) << np.uint64(16)) | (raw[1:-1][far].astype(np.uint64) << np.uint64(8)) | raw[2:][far]
        mixed = np.concatenate((new, (one[:-1] * _SPREAD + one[1:]) * _SPREAD, (other + np.uint64(1)) * _SPREAD))
        hashed.append(np.bincount((mixed >> np.uint64(32)).astype(np.int64) % WORDS, minlength=WORDS))
        at, last = end, split[-1:]
    counts = np.concatenate((shapes, sum(hashed))) if hashed else np.zeros(SHAPES + WORDS)
    columns = np.flatnonzero(counts)
    return columns.astype(np.int32), counts[columns].astype(np.float32), twice / words if words else 0.0


@dataclass
class Terms:
    """Sparse rows of terms: where each row begins, columns, values, and each row's share of repeated words."""

    starts: np.ndarray
    columns: np.ndarray
    values: np.ndarray
    twice: np.ndarray

    @staticmethod
    def of(rows: list[tuple[np.ndarray, np.ndarray, float]]) -> "Terms":
        sizes = [len(c) for c, _, _ in rows]
        columns, values = (np.concatenate([r[k] for r in rows]) for k in (0, 1))
        return Terms(np.concatenate(([0], np.cumsum(sizes))), columns, values, np.array([r[2] for r in rows]))

    def weighted(self, idf: np.ndarray) -> "Terms":
        """Shapes and words are unit vectors each, and so are two coordinates, the last, of the repeated words."""
        values = np.log1p(self.values) * idf[self.columns]
        row = np.repeat(np.arange(len(self.twice)), np.diff(self.starts)) * 2 + (self.columns >= SHAPES)
        length = np.sqrt(np.bincount(row, values.astype(np.float64) ** 2, 2 * len(self.twice)))
        values = values / np.maximum(length, 1e-12)[row]
        angle = np.pi / 2 * np.sqrt(self.twice)
        at = np.repeat(self.starts[1:], 2)
        last = np.tile([SHAPES + WORDS, SHAPES + WORDS + 1], len(self.twice))
        columns = np.insert(self.columns, at, last)
        values = np.insert(values, at, np.column_stack((np.sin(angle), np.cos(angle))).ravel())
        return Terms(self.starts + 2 * np.arange(len(self.starts)), columns, values.astype(np.float32), self.twice)

    def times(self, matrix: np.ndarray) -> np.ndarray:
        """Product with a dense matrix; no row is empty."""
        out = np.empty((len(self.starts) - 1, matrix.shape[1]), np.float32)
        for at in range(0, len(out), _BLOCK):
            a = self.starts[at : at + _BLOCK + 1]
            columns, values = self.columns[a[0] : a[-1]], self.values[a[0] : a[-1], None]
            for c in range(0, matrix.shape[1], _WIDTH):
                out[at : at + _BLOCK, c : c + _WIDTH] = np.add.reduceat(matrix[columns, c : c + _WIDTH] * values, a[:-1] - a[0])
        return out

    def transposed_times(self, matrix: np.ndarray, height: int) -> np.ndarray:
        out = np.zeros((height, matrix.shape[1]), np.float32)
        for at in range(0, len(self.starts) - 1, _BLOCK):
            a = self.starts[at : at + _BLOCK + 1]
            columns = self.columns[a[0] : a[-1]]
            order = np.argsort(columns, kind="stable")
            columns, values = columns[order], self.values[a[0] : a[-1]][order, None]
            row = at + np.repeat(np.arange(len(a) - 1), np.diff(a))[order]
            first = np.flatnonzero(np.diff(columns, prepend=-1))
            for c in range(0, matrix.shape[1], _WIDTH):
                out[columns[first], c : c + _WIDTH] += np.add.reduceat(matrix[row, c : c + _WIDTH] * values, first)
        return out


def _axes(x: Terms, height: int, rank: int) -> np.ndarray:
    """The first right singular vectors by subspace iteration from a fixed start."""
    y = np.random.default_rng(1).normal(size=(height, rank + 16)).astype(np.float32)
    for _ in range(_ITERATIONS):
        y = np.linalg.qr(x.transposed_times(x.times(y), height))[0]
    _, turn = np.linalg.eigh((z := x.times(y)).T @ z)
    return np.ascontiguousarray(y @ turn[:, ::-1][:, :rank], dtype=np.float32)


@dataclass
class Model:
    """idf of the terms, the projection, and the labelled vectors with their labels' weights and values."""

    idf: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    weight: np.ndarray
    label: np.ndarray
    neighbours: int

    def score(self, terms: Terms) -> np.ndarray:
        """Share of the nearest labelled vectors' votes for label 1; a constant if nothing else was learned."""
        if len(self.vectors) == 0:
            return np.full(len(terms.twice), float(self.label.mean()) if len(self.label) else 0.5)
        found = _unit(terms.weighted(self.idf).times(self.axes)).astype(np.float64) @ self.vectors.T.astype(np.float64)
        cosine = np.rint(found * 10**_DIGITS).astype(np.int64)
        k, rows = min(self.neighbours, cosine.shape[1]), cosine.shape[1]
        # of equal cosines the earlier labelled row counts, so a score does not hang on the block that computes it
        near = np.argpartition(np.arange(rows) - cosine * rows, k - 1, axis=1)[:, :k]
        near.sort(axis=1)
        vote = np.maximum(np.take_along_axis(cosine, near, 1) / 10**_DIGITS, 1e-3) ** SHARPNESS * self.weight[near]
        return np.clip((vote * self.label[near]).sum(1) / vote.sum(1), 0, 1).astype(np.float64)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _counted(rows: DataFrame, kept: str) -> DataFrame:
    """``kept`` and the terms of each text of ``rows (kept, text)``."""
    ship(rows.sparkSession)
    kind = rows.schema[kept].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [terms_of(x.as_py() or b"") for x in batch.column("text").cast(pa.large_binary())]
            parts = [pa.array([r[k].tobytes() for r in got], pa.binary()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(kept), *parts, pa.array([r[2] for r in got], pa.float64())], [kept, "columns", "counts", "twice"])

    return rows.select(kept, "text").mapInArrow(count, f"{kept} {kind}, columns binary, counts binary, twice double")


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = PER_CLASS, rank: int = RANK, neighbours: int = NEIGHBOURS) -> Model:
    """Learn from at most ``per_class`` documents of either label; see ``labelled_sample``."""
    sample, totals, sampled = labelled_sample(docs, labels, label, per_class)
    rows = _counted(sample.orderBy("doc_id"), "y").collect()
    y = np.array([r.y for r in rows], np.float32)
    if len(set(y.tolist())) < 2:
        return Model(np.zeros(0), np.zeros((0, 0)), np.zeros((0, 0)), np.zeros(0), y, neighbours)
    terms = Terms.of([(np.frombuffer(r.columns, np.int32), np.frombuffer(r.counts, np.float32), r.twice) for r in rows])
    idf = np.log((1 + len(y)) / (1 + np.bincount(terms.columns, minlength=SHAPES + WORDS))).astype(np.float32) + 1
    x = terms.weighted(idf)
    axes = _axes(x, SHAPES + WORDS + 2, rank)
    weight = np.where(y == 1, totals[1] / sampled[1], totals[0] / sampled[0]).astype(np.float32)
    return Model(idf, axes, _unit(x.times(axes)), weight / weight.min(), y, neighbours)


def scored(docs: DataFrame, model: Model, kept: str = "doc_id") -> DataFrame:
    """``kept`` and ``score`` of every row of ``docs (kept, text)``.

    Null and empty texts have no terms and are scored like any other; texts of any length are
    read whole. Repeated rows get the same score: of labelled rows at equal cosines (to six
    places) those with the smaller ids vote. Without labelled rows the score is 0.5, with one
    label only it is that label. Other columns are not read. An empty table gives an empty table.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[kept].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _BLOCK):
                part = batch.slice(at, _BLOCK)
                terms = Terms.of([terms_of(x.as_py() or b"") for x in part.column("text").cast(pa.large_binary())])
                yield pa.RecordBatch.from_arrays([part.column(kept), pa.array(shared.value.score(terms), pa.float64())], [kept, "score"])

    return docs.select(kept, "text").mapInArrow(score, f"`{kept}` {kind}, score double")


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``; cases as in ``scored``."""
    rows = scored(docs, fit(docs, labels))
    return rows.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of ``docs``, all columns kept, that are predicted to be good; cases as in ``scored``."""
    rows = packed(docs, ["text"])
    return scored(rows, fit(docs, labels), kept="row").where(F.col("score") >= THRESHOLD).select("row.*")
