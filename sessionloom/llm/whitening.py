"""Whitening of embeddings from the singular values of the centred rows.

Entries become whole numbers, so sums per dimension, and with them the centred rows times
their number, are exact. Tasks reduce their centred rows block by block to triangles (QR),
triangles are reduced to one in rounds of ``FAN_IN``, and the driver, which sees that single
triangle only, finds its singular values and right vectors (``singular``). The covariance
matrix itself is never formed, so small values keep their digits.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sessionloom.llm.common import ship
from sessionloom.llm.singular import right_singular
from sessionloom.sources.scratch import save_scratch

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
FAN_IN = 16
_ROWS = 4_096  # rows taken into a triangle at once
_MOST = float(1 << 62)  # whole numbers beyond saturate


@dataclass(frozen=True)
class Whitening:
    """n vectors, the sum of each dimension, variances of all components, and the unit directions (columns) of the first."""

    n: int
    sums: list[int]
    spread: int  # no entry is farther than this from another one, times n
    variances: np.ndarray
    directions: np.ndarray

    @property
    def defined(self) -> np.ndarray:
        """Of the kept components those with a variance above the rounding of the largest."""
        kept = self.variances[: self.directions.shape[1]]
        return kept > len(self.sums) * np.finfo(float).eps * self.variances.max(initial=0.0)


def usable(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """Rows whose vector and all its entries are there and finite."""
    value = F.col(column)
    odd = F.exists(value, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return vectors.where(value.isNotNull() & ~odd)


def _whole(column: pa.Array) -> np.ndarray:
    """Vectors as rows of whole numbers: floor(SCALE * entry) + SHIFT."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return (np.clip(np.floor(flat * SCALE), -_MOST, _MOST).astype(np.int64) + SHIFT).reshape(len(column), -1)


def _centred(x: np.ndarray, n: int, sums: list[int], spread: int) -> np.ndarray:
    """n*x - S, exact: in 64 bits where they are enough, else in Python's numbers."""
    if spread < 1 << 62:
        # wraps in between, but the result is small enough
        return x * np.int64(n) - np.array([(s + (1 << 63)) % (1 << 64) - (1 << 63) for s in sums], np.int64)
    return x.astype(object) * n - np.array(sums, object)


def _summed(rows: DataFrame) -> tuple[int, list[int], int]:
    """Number of vectors, sums per dimension and n times the widest range; at most one row per dimension leaves a task."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, low, high = 0, None, None, None
        for batch in batches:
            if len(batch):
                x = _whole(batch.column("vector"))
                part = x.astype(object).sum(0) if np.abs(x).max() > 1 << 40 else x.sum(0).astype(object)
                n += len(x)
                total = part if total is None else total + part
                low = x.min(0) if low is None else np.minimum(low, x.min(0))
                high = x.max(0) if high is None else np.maximum(high, x.max(0))
        if n:
            yield from pa.table({"at": np.arange(len(total)), "n": np.full(len(total), n), "total": [str(t) for t in total], "low": low, "high": high}).to_batches()

    parts = rows.mapInArrow(add, "at bigint, n bigint, total string, low bigint, high bigint")
    sums = parts.groupBy("at").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.min("low").alias("low"), F.max("high").alias("high")).orderBy("at").collect()
    if not sums:
        return 0, [], 0
    return sums[0].n, [int(r.total) for r in sums], sums[0].n * max(r.high - r.low for r in sums)


def _triangle(rows: DataFrame, n: int, sums: list[int], spread: int) -> np.ndarray:
    """R of a QR factorisation of all centred rows."""
    width = len(sums)

    def reduced(blocks: Iterator[np.ndarray]) -> Iterator[pa.RecordBatch]:
        r, held = np.zeros((0, width)), 0
        waiting: list[np.ndarray] = []
        for block in blocks:
            waiting.append(block)
            held += len(block)
            if held >= max(_ROWS, 4 * width):
                r, waiting, held = np.linalg.qr(np.concatenate([r, *waiting]), mode="r"), [], 0
        if waiting:
            r = np.linalg.qr(np.concatenate([r, *waiting]), mode="r")
        if len(r):
            square = np.zeros((width, width))
            square[: len(r)] = r
            yield pa.RecordBatch.from_arrays([pa.array([square.ravel()], pa.list_(pa.float64()))], ["r"])

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = (b.slice(at, _ROWS) for b in batches for at in range(0, len(b), _ROWS))
        yield from reduced(_centred(_whole(b.column("vector")), n, sums, spread).astype(np.float64) / n for b in parts)

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from reduced(b.column("r").slice(i, 1).flatten().to_numpy().reshape(width, width) for b in batches for i in range(len(b)))

    now = save_scratch(rows.mapInArrow(first, "r array<double>"), "triangles")
    while (count := now.count()) > 1:
        now = save_scratch(now.repartition(-(-count // FAN_IN)).mapInArrow(again, "r array<double>"), "triangles")
    return np.array(now.first().r).reshape(width, width)


def _vectors(vectors: DataFrame, column: str, width: int, *others: str) -> DataFrame:
    return usable(vectors, column).where(F.size(column) == width).select(*others, F.col(column).alias("vector"))


def _width(vectors: DataFrame, column: str) -> int:
    """The commonest length of a usable vector, the longest of several; none: 0."""
    found = usable(vectors, column).groupBy(F.size(column).alias("width")).count().where("width > 0").orderBy(F.desc("count"), F.desc("width")).first()
    return found.width if found else 0


def fit(vectors: DataFrame, most: int = COMPONENTS, column: str = "embedding") -> Whitening | None:
    """The whitening of all usable vectors of the commonest length; None without any."""
    ship(vectors.sparkSession)
    width = _width(vectors, column)
    if not width:
        return None
    rows = _vectors(vectors, column, width)
    n, sums, spread = _summed(rows)
    squares, directions = right_singular(_triangle(rows, n, sums, spread), most)
    signs = np.sign(directions[np.abs(directions).argmax(0), np.arange(directions.shape[1])])
    return Whitening(n, sums, spread, squares / n, directions * signs)


def _projected(x: np.ndarray, model: Whitening) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        scaled = model.directions / np.sqrt(model.variances[: model.directions.shape[1]])
    return (x.astype(np.float64) / model.n) @ np.where(model.defined, scaled, 0.0)


def identity_error(vectors: DataFrame, model: Whitening, column: str = "embedding") -> float | None:
    """Largest absolute entry of the whitened vectors' covariance minus the identity, over defined components."""
    k = int(model.defined.sum())
    if not k:
        return None

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k + k * k)
        for batch in batches:
            for at in range(0, len(batch), _ROWS):
                w = _projected(_centred(_whole(batch.column("vector").slice(at, _ROWS)), model.n, model.sums, model.spread), model)[:, :k]
                total += np.concatenate((w.sum(0), (w.T @ w).ravel()))
        yield from pa.table({"at": np.arange(len(total)), "total": total}).to_batches()

    sums = _vectors(vectors, column, len(model.sums)).mapInArrow(add, "at bigint, total double").groupBy("at").agg(F.sum("total").alias("total")).orderBy("at").collect()
    got = np.array([r.total for r in sums]) / model.n
    mean, products = got[:k], got[k:].reshape(k, k)
    return float(np.abs(products - np.outer(mean, mean) - np.eye(k)).max())


_COLUMNS = "component int, n bigint, deviation bigint, whitened double, explained double"


def whitened(vectors: DataFrame, most: int = COMPONENTS, vec_id: str = "vec_id", column: str = "embedding") -> DataFrame:
    """Whitened coordinates: ``vec_id, component, n, deviation, whitened, explained, identity_error`` per vector and component.

    Entries count as the whole numbers x = floor(1024*entry) + 100000, saturating far beyond
    2^61. Vectors that are null or empty or hold null or non-finite entries take no part, nor
    do those whose length is not the commonest one (of equally common ones the longest).
    Components are numbered from 1 by falling variance, at most ``most`` and the vectors'
    length; their sign makes the largest entry of the direction positive. ``deviation`` is the
    exact sum of (n*x - S)^2, null beyond 64 bits. ``whitened`` is null for components without
    variance above rounding, ``explained`` if nothing varies at all. Repeated rows count again,
    rows without id are kept, other columns are not read. Without vectors the table is empty.
    """
    spark = vectors.sparkSession
    kind = vectors.schema[vec_id].dataType.simpleString()
    schema = f"{vec_id} {kind}, {_COLUMNS}"
    model = fit(vectors, most, column)
    if model is None:
        return spark.createDataFrame([], f"{schema}, identity_error double")
    count, total = model.directions.shape[1], float(model.variances.sum())
    shares = [float(v) / total if total else None for v in model.variances[:count]]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), _ROWS):
                part = batch.slice(at, _ROWS)
                x = _centred(_whole(part.column("vector")), model.n, model.sums, model.spread)
                w = _projected(x, model)
                small = x.dtype != object and len(model.sums) * model.spread**2 < 1 << 63
                square = (x * x).sum(1) if small else [s if s < 1 << 63 else None for s in np.square(x.astype(object)).sum(1)]
                again = pa.array(np.repeat(np.arange(len(part)), count))
                yield from pa.table([
                    part.column(vec_id).take(again), pa.array(np.tile(np.arange(1, count + 1), len(part)), pa.int32()),
                    pa.array(np.full(len(again), model.n)), pa.array(square, pa.int64()).take(again),
                    pa.array(w.ravel(), mask=np.tile(~model.defined, len(part))), pa.array(shares * len(part), pa.float64()),
                ], [vec_id, "component", "n", "deviation", "whitened", "explained"]).to_batches(max_chunksize=65_536)

    error = identity_error(vectors, model, column)
    out = _vectors(vectors, column, len(model.sums), vec_id).mapInArrow(rows, schema)
    return out.withColumn("identity_error", F.lit(error).cast("double"))
