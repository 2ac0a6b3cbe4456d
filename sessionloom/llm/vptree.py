"""Nearest neighbours by inner product, with vantage-point trees over shards of the vectors.

Angles between directions obey the triangle inequality, so they carry the trees, and a row's
length comes in last: rows whose angle to the query is at least ``a`` and whose length is at
most ``L`` have an inner product of at most ``|q| L cos(a)``. No sum of squares of the longest
row is involved, so one very long row spoils neither the order nor the pruning elsewhere.

Shards: directions of a bounded sample are grouped around pivots, each row goes to its nearest
pivot, and the rows of a pivot are sorted by their angle to it and cut into rings of bounded
size. A ring's tree is built once, by the task that holds the ring, and written to the shared
folder beside the vectors; what Spark keeps is a row per ring with its range of angles and
lengths. Neighbouring rings form shards of about equal size, however small the rings are.

Copies: of equal vectors only the k + 1 smallest ids can be among anyone's k nearest, so only
they are indexed, and equal queries are searched once.

Search: a query first goes to the shard where the bound is highest. Its k-th score there is the
floor for all others: it goes on to those shards only whose bound reaches the floor. Tasks open
the shard's files and pass a block of queries down each tree, leaving out what cannot reach the
query's k-th score so far. All angle bounds are multiplied by ``factor``: factor 1 leaves out
only what cannot be among the nearest, so the search is exact; it is what queries use. A larger
factor visits less. Leaves are compared as matrix products, and what may count is scored anew
in double precision, row by row.
"""

import uuid
from collections.abc import Iterator
from functools import lru_cache
from io import BytesIO

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from sessionloom.llm.common import ship
from sessionloom.llm.files import new_folder, open_file, write_file
from sessionloom.sources.scratch import save_scratch

NEIGHBOURS = 20
FACTOR = 1.0
LEAF = 128
SHARD_ROWS = 8_192
BLOCK_ROWS = 4_096
QUERY_EVERY = 20
PIVOTS = 256
PIVOT_SAMPLE = 4_096  # rows, chosen by a hash of the id, from which pivots are taken
SLACK = 1e-6  # radians; more than rounding can change an angle
SLICE = 1_024  # queries compared with a leaf at once
CELLS = 1 << 21  # bounds computed at once while queries are sent to rings


# ---- geometry --------------------------------------------------------------------------


def directions(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors and lengths; scaled by the largest component first, so that squares neither overflow nor vanish."""
    scale = np.abs(points).max(1, keepdims=True)
    scaled = points / scale
    length = np.sqrt((scaled**2).sum(1, keepdims=True))
    return scaled / length, (scale * length)[:, 0]


def _angles(units: np.ndarray, others: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(units @ others.T, -1, 1))


def _limit(angle: np.ndarray, low, high, shortest, longest, factor: float) -> np.ndarray:
    """Largest product with a unit query at ``angle`` to the vantage direction of rows that are at low..high from it."""
    least = np.minimum(np.maximum(np.maximum(low - angle, angle - high) - SLACK, 0) * factor, np.pi)
    share = np.cos(least)
    limit = np.where(share > 0, longest, shortest) * share
    return limit + 1e-9 * np.abs(limit)


class VantageTree:
    """Rows in the order of the leaves; a node is a stretch of them.

    links: start, stop, nearer child, farther child and vantage direction of each node (-1: leaf);
    ranges: least and greatest angle to the parent's vantage direction, least and greatest length.
    The root's parent is ``pivot``, the direction that all of the tree's rows were dealt by.
    """

    def __init__(self, points: np.ndarray, ids: np.ndarray, leaf: int = LEAF, pivot: np.ndarray | None = None):
        units, lengths = directions(points)
        order, links, ranges, vantages = [], [], [], []

        def grow(rows: np.ndarray, low: float, high: float) -> int:
            node = len(links)
            links.append([sum(map(len, order)), 0, -1, -1, -1])
            ranges.append((low, high, lengths[rows].min(), lengths[rows].max()))
            # the row farthest from the middle sees the others at the most different angles
            middle = units[rows].mean(0)
            vantage = units[rows[np.argmin(units[rows] @ middle)]]
            apart = _angles(units[rows], vantage[None])[:, 0]
            if len(rows) <= leaf or np.ptp(apart) <= SLACK:  # nothing to tell apart
                order.append(rows)
            else:
                links[node][4] = len(vantages)
                vantages.append(vantage)
                by_angle = np.argsort(apart, kind="stable")
                half = len(rows) // 2
                for side, part in enumerate((by_angle[:half], by_angle[half:])):
                    links[node][2 + side] = grow(rows[part], apart[part[0]], apart[part[-1]])
            links[node][1] = sum(map(len, order))
            return node

        self.pivot = units[:1].sum(0) if pivot is None else pivot
        if len(points):
            around = _angles(units, self.pivot[None])[:, 0]
            grow(np.argsort(ids, kind="stable"), around.min(), around.max())
        order = np.concatenate(order) if order else np.zeros(0, int)
        self.points, self.ids, self.lengths = points[order], ids[order], lengths[order]
        self.links, self.ranges = np.array(links, np.int64).reshape(-1, 5), np.array(ranges).reshape(-1, 4)
        self.vantages = np.array(vantages).reshape(-1, points.shape[1])
        self.compared = 0  # pairs of query and row in the leaves visited

    def write(self, path: str) -> None:
        kept = BytesIO()
        np.savez(kept, **{name: value for name, value in vars(self).items() if name != "compared"})
        with write_file(path) as stream:
            stream.write(kept.getbuffer())

    @classmethod
    def read(cls, path: str) -> "VantageTree":
        tree = cls.__new__(cls)
        with open_file(path) as source, np.load(BytesIO(source.read())) as kept:
            vars(tree).update({name: kept[name] for name in kept.files}, compared=0)
        return tree

    def search(
        self, queries: np.ndarray, k: int, factor: float = FACTOR, floor: np.ndarray | None = None, so_far: tuple[np.ndarray, np.ndarray] | None = None
    ) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k largest inner products of each query, highest first, then smallest id.

        floor: per query, a score below which rows are not wanted. so_far: what another tree's
        search returned, to go on from. Places that stay empty have score minus infinity.
        """
        units, lengths = directions(queries)
        floor = np.full(len(queries), -np.inf) if floor is None else floor
        ids, best = so_far or (np.zeros((len(queries), k), self.ids.dtype), np.full((len(queries), k), -np.inf))

        def visit(node: int, some: np.ndarray) -> None:
            start, stop, near, far, vantage = self.links[node]
            if vantage < 0:
                for at in range(start, stop, 8 * LEAF):  # long only where all directions are equal
                    for first in range(0, len(some), SLICE):
                        compare(at, min(stop, at + 8 * LEAF), some[first : first + SLICE])
                return
            angle = _angles(units[some], self.vantages[vantage][None])[:, 0]
            limits = [lengths[some] * _limit(angle, *self.ranges[child], factor) for child in (near, far)]
            edge = (self.ranges[near][1] + self.ranges[far][0]) / 2
            # each query sees its own side first, so that its k-th score is high when the other is judged
            for turn in (0, 1):
                for side, child in enumerate((near, far)):
                    its = ((angle >= edge) == (side == 1)) == (turn == 0)
                    its &= limits[side] >= np.maximum(best[some, -1], floor[some])
                    if its.any():
                        visit(child, some[its])

        def compare(start: int, stop: int, some: np.ndarray) -> None:
            self.compared += (stop - start) * len(some)
            rough = queries[some] @ self.points[start:stop].T
            error = 1e-12 * lengths[some][:, None] * self.lengths[start:stop]
            least = np.maximum(best[some, -1], floor[some])
            unset = np.isinf(least)
            if unset.any() and stop - start > k:  # k of this leaf are enough
                least[unset] = np.partition(rough[unset] - error[unset], -k, axis=1)[:, -k]
            a, b = np.nonzero(rough + error >= least[:, None])
            a, b = some[a], start + b
            if not len(a):
                return
            its = np.unique(a)
            score = np.concatenate((np.einsum("ij,ij->i", queries[a], self.points[b]), best[its].ravel()))
            vec = np.concatenate((self.ids[b], ids[its].ravel()))
            asked = np.concatenate((a, np.repeat(its, k)))
            order = np.lexsort((vec, -score, asked))
            first = np.flatnonzero(np.diff(asked[order], prepend=-1))
            order = order[first[:, None] + np.arange(k)]
            ids[its], best[its] = vec[order], score[order]

        if len(self.ids) and len(queries):
            limit = lengths * _limit(_angles(units, self.pivot[None])[:, 0], *self.ranges[0], factor)
            if len(some := np.flatnonzero(limit >= np.maximum(best[:, -1], floor))):
                visit(0, some)
        best[best < floor[:, None]] = -np.inf
        return ids, best


# ---- rings -----------------------------------------------------------------------------


def _usable(vector: str) -> Column:
    """Vectors that take part: not null, not zero, all components finite."""
    numbers = F.transform(vector, lambda x: x.cast("double"))
    finite = F.forall(numbers, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(numbers, lambda x: x != 0), F.lit(False))


def _matrices(column: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length of the vectors: their places and their matrix."""
    flat, sizes = column.flatten().to_numpy(zero_copy_only=False), column.value_lengths().to_numpy(zero_copy_only=False)
    for size in np.unique(sizes):
        its = sizes == size
        yield np.flatnonzero(its), flat[np.repeat(its, sizes)].reshape(-1, size)


def _pivots(rows: DataFrame, n: int, shard_rows: int) -> dict[int, np.ndarray]:
    """Pivot directions for each length of vectors in the sample, about one for each shard, at most PIVOTS."""
    step = max(1, n // PIVOT_SAMPLE)
    sample = rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(step)) == 0).limit(2 * PIVOT_SAMPLE).orderBy("vec_id").toArrow()
    out = {}
    if sample.num_rows:
        for _, points in _matrices(sample.column("embedding").combine_chunks()):
            units, _ = directions(points)
            wanted = int(min(PIVOTS, len(units), max(1, n // shard_rows * len(units) // sample.num_rows)))
            # far apart from each other first, then moved to the middle of their rows
            pivots, nearest = [units[0]], units @ units[0]
            while len(pivots) < wanted:
                pivots.append(units[np.argmin(nearest)])
                nearest = np.maximum(nearest, units @ pivots[-1])
            pivots = np.array(pivots)
            for _ in range(8):
                mine = np.argmax(units @ pivots.T, 1)
                sums = np.zeros_like(pivots)
                np.add.at(sums, mine, units)
                moved = np.abs(sums).max(1) > 1e-9
                pivots[moved] = directions(sums[moved])[0] if moved.any() else pivots[moved]
            out[points.shape[1]] = pivots
    return out


def _rings(rows: DataFrame, n: int, pivots: dict[int, np.ndarray], folder: str, shard_rows: int, leaf: int) -> DataFrame:
    """Write a tree per ring; ``path, size, pivot, low, high, shortest, longest, n`` of each."""
    kind = rows.schema["vec_id"].dataType.simpleString()

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, pivot, angle = np.zeros(len(batch), np.int32), np.full(len(batch), -1, np.int32), np.zeros(len(batch))
            for its, points in _matrices(batch.column("embedding")):
                size[its] = points.shape[1]
                if points.shape[1] in pivots:
                    apart = _angles(directions(points)[0], pivots[points.shape[1]])
                    pivot[its] = apart.argmin(1)
                    angle[its] = apart.min(1)
            names = ["vec_id", "embedding", "size", "pivot", "angle"]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("embedding"), *map(pa.array, (size, pivot, angle))], names)

    def plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = pa.Table.from_batches(batches) if (batches := list(batches)) else None
        out = []
        if part is not None and part.num_rows:
            size, pivot, angle = (part.column(c).to_numpy() for c in ("size", "pivot", "angle"))
            for s, p in sorted(set(zip(size.tolist(), pivot.tolist(), strict=True))):
                its = np.flatnonzero((size == s) & (pivot == p))
                ring = part.take(pa.array(its))
                (_, points), = _matrices(ring.column("embedding").combine_chunks())
                tree = VantageTree(points, ring.column("vec_id").to_numpy(), leaf, pivots[s][p] if p >= 0 else None)
                path = f"{folder}/{uuid.uuid4().hex}.npz"  # attempts of one task never meet
                tree.write(path)
                low, high = (angle[its].min(), angle[its].max()) if p >= 0 else (0.0, np.pi)
                out.append((path, s, p, low, high, tree.lengths.min(), tree.lengths.max(), len(its)))
        if out:
            yield pa.RecordBatch.from_pylist([dict(zip(RING, row, strict=True)) for row in out], pa.schema([
                ("path", pa.string()), ("size", pa.int32()), ("pivot", pa.int32()), *((c, pa.float64()) for c in RING[3:7]), ("n", pa.int64())
            ]))

    dealt = rows.mapInArrow(deal, f"vec_id {kind}, embedding array<double>, size int, pivot int, angle double")
    # angles are cut by rank; the id parts rows at one angle
    parts = dealt.repartitionByRange(max(1, -(-n // shard_rows)), "size", "pivot", "angle", "vec_id")
    schema = "path string, size int, pivot int, low double, high double, shortest double, longest double, n bigint"
    return save_scratch(parts.mapInArrow(plant, schema), "rings")


RING = ("path", "size", "pivot", "low", "high", "shortest", "longest", "n")


def _shards(rings: list, shard_rows: int) -> list[list[int]]:
    """Neighbouring rings of one length of vectors together, up to ``shard_rows`` rows if there are several."""
    out, held = [], 0
    for i, ring in enumerate(rings):
        if i == 0 or ring["size"] != rings[i - 1]["size"] or held + ring["n"] > shard_rows:
            out.append([])
            held = 0
        out[-1].append(i)
        held += ring["n"]
    return out


def _sent(questions: DataFrame, rings: list, shards: list[list[int]], pivots: dict[int, np.ndarray], k: int, factor: float, first: bool) -> DataFrame:
    """A row per query and shard to visit: at first the best shards, until they have k rows, later the rest that reach ``floor``."""
    kind = questions.schema["vec_id"].dataType.simpleString()
    number: dict[int, list[int]] = {}
    for at, shard in enumerate(shards):
        number.setdefault(rings[shard[0]]["size"], []).append(at)
    table = np.array([[r[c] for c in RING[2:]] for r in rings]).reshape(-1, 6)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            floors = batch.column("floor").to_numpy(zero_copy_only=False)
            for places, points in _matrices(batch.column("embedding")):
                some = np.array(number.get(points.shape[1], []), int)
                if not len(some):
                    continue
                starts = np.cumsum([0] + [len(shards[x]) for x in some])[:-1]
                pivot, low, high, shortest, longest, n = table[np.concatenate([shards[x] for x in some])].T
                held = np.add.reduceat(n, starts)
                step = max(1, CELLS // len(n))
                for at in range(0, len(places), step):
                    its = places[at : at + step]
                    units, lengths = directions(points[at : at + step])
                    known = points.shape[1] in pivots
                    angle = _angles(units, pivots[points.shape[1]])[:, pivot.astype(int)] if known else np.zeros((len(its), len(n)))
                    limit = np.maximum.reduceat(lengths[:, None] * _limit(angle, low, high, shortest, longest, factor), starts, axis=1)
                    by_limit = np.argsort(-limit, axis=1, kind="stable")
                    seen = np.cumsum(held[by_limit], axis=1) - held[by_limit]
                    best = np.zeros(limit.shape, bool)
                    np.put_along_axis(best, by_limit, seen < k, 1)
                    a, b = np.nonzero(best if first else ~best & (limit >= floors[its][:, None]))
                    for cut in range(0, len(a), 8_192):
                        out = batch.take(pa.array(its[a[cut : cut + 8_192]]))
                        yield out.append_column("shard", pa.array(some[b[cut : cut + 8_192]], pa.int32()))

    return questions.select("vec_id", "embedding", "block", "floor").mapInArrow(
        send, f"vec_id {kind}, embedding array<double>, block int, floor double, shard int"
    )


@lru_cache(maxsize=1)  # a task goes through the blocks of one shard one after another
def _trees(paths: tuple[str, ...]) -> list[VantageTree]:
    return [VantageTree.read(path) for path in paths]


def _found(sent: DataFrame, paths: list[tuple[str, ...]], k: int, factor: float) -> DataFrame:
    kind = sent.schema["vec_id"].dataType.simpleString()

    def search(asked: pa.Table) -> pa.Table:
        (_, queries), = _matrices(asked.column("embedding").combine_chunks())
        floor, so_far = asked.column("floor").to_numpy(), None
        for tree in _trees(paths[asked.column("shard")[0].as_py()]):
            so_far = tree.search(queries, k, factor, floor, so_far)
        ids, scores = so_far
        a, b = np.nonzero(scores > -np.inf)
        number = asked.schema.field("vec_id").type
        return pa.table({"query_id": pa.array(asked.column("vec_id").to_numpy()[a], number), "vec_id": pa.array(ids[a, b], number), "score": scores[a, b]})

    return sent.groupBy("shard", "block").applyInArrow(search, f"query_id {kind}, vec_id {kind}, score double")


def nearest_neighbours(
    vectors: DataFrame, every: int = QUERY_EVERY, k: int = NEIGHBOURS, factor: float = FACTOR,
    shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS, leaf: int = LEAF,
) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the k nearest of each query found.

    vectors: ``vec_id, embedding``; queries are the rows whose vec_id is divisible by ``every``.
    Rows without id and unusable vectors (null, zero, with a null or non-finite component) take
    no part. Of rows with one id the least vector in component order counts. Vectors of
    different lengths never meet. Ties go to the smaller id. With fewer candidates than k all
    are returned; a query without candidates has no row. Other columns are not read. An empty
    table gives an empty table.

    The driver holds the pivots (at most PIVOTS for a length of vectors) and a row for each ring,
    that is for about ``shard_rows`` different vectors.
    """
    spark = vectors.sparkSession
    ship(spark)
    numbers = F.transform("embedding", lambda x: x.cast("double"))
    rows = vectors.where(F.col("vec_id").isNotNull() & _usable("embedding")).select("vec_id", numbers.alias("embedding"))
    rows = save_scratch(rows.groupBy("vec_id").agg(F.min("embedding").alias("embedding")), "vectors")
    asked = rows.where(F.col("vec_id") % every == 0)
    # of equal vectors as many as anyone can have among the nearest, and one for the query itself
    copy = F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))
    indexed = save_scratch(rows.withColumn("copy", copy).where(F.col("copy") <= k + 1).drop("copy"), "indexed")
    questions = save_scratch(asked.groupBy("embedding").agg(F.min("vec_id").alias("vec_id")), "questions")
    n, queries = indexed.count(), questions.count()
    pivots = _pivots(indexed, n, shard_rows)
    rings = sorted(_rings(indexed, n, pivots, new_folder(spark, "vantage-trees"), shard_rows, leaf).collect(), key=lambda r: r[1:])
    shards = _shards(rings, shard_rows)
    paths = [tuple(rings[i]["path"] for i in shard) for shard in shards]

    block = F.pmod(F.shiftrightunsigned(F.xxhash64("vec_id"), 20), F.lit(max(1, -(-queries // block_rows)))).cast("int")
    none = F.lit(float("-inf"))
    spread = questions.withColumns({"block": block, "floor": none})
    first = save_scratch(_found(_sent(spread, rings, shards, pivots, k + 1, factor, True), paths, k + 1, factor), "first-shard")
    floors = first.groupBy(F.col("query_id").alias("vec_id")).agg(F.when(F.count("*") > k, F.min("score")).otherwise(none).alias("floor"))
    later = spread.drop("floor").join(floors, "vec_id", "left").withColumn("floor", F.coalesce("floor", none))
    found = first.union(_found(_sent(later, rings, shards, pivots, k + 1, factor, False), paths, k + 1, factor))

    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    nearest = found.withColumn("place", place).where(F.col("place") <= k + 1)
    lists = nearest.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("place", "vec_id", "score"))).alias("nearest"))
    answers = questions.join(lists.withColumnRenamed("query_id", "vec_id"), "vec_id").drop("vec_id")
    # each query takes its vector's list without itself; no shuffle follows, so a hot vector's queries can be split
    others = F.slice(F.filter("nearest", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    answered = asked.withColumnRenamed("vec_id", "query_id").join(answers, "embedding")
    return answered.select("query_id", F.posexplode(others).alias("rank", "of")).select(
        "query_id", (F.col("rank") + 1).alias("rank"), "of.vec_id", "of.score"
    )
