"""SimHash near-duplicates by a hierarchical index over fingerprints in Gray order.

Fingerprints are told apart once each, so copies never meet in a join. Of ``radius``
differing bits at least one of ``radius + 1`` blocks of the fingerprint holds none. Each
fingerprint is therefore entered once per block, rotated so that the block leads, and the
entries of one block are sorted by Gray rank: entries with the same leading bits are one
run of that order, and neighbours differ in few bits. A range partition of the order is a
bottom group; it gets an even share of the entries however alike they are.

Inside a partition the entries of one leading block form a tree. Every node holds the bits
that all entries below it share (mask and pattern). A search goes down the tree, adds up
the differences in the bits that a node newly shares, and leaves whole groups as soon as
the sum passes the radius. A block whose entries reach over several partitions has one
upper node per partition; an entry is sent to a later partition only if that node's
shared bits are within the radius.

Each task reduces the links it finds to a forest, so its output has at most one row per
entry, and the forests are joined by connected components. No link is lost.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from sessionloom.llm.common import packed, ship, tasks_for
from sessionloom.llm.components import connected_components, merge_labels
from sessionloom.sources.scratch import save_scratch

BITS = 64
RADIUS = 4
SHINGLE = 4
SEED = 42
FAN_OUT = 16
ENTRIES_A_TASK = 262_144
_FRONTIER = 2_000_000  # (query, node) pairs held at once
_HASHES = 65_536  # shingle hashes held at once


# ---- fingerprints ----------------------------------------------------------------------


def simhash(text: bytes | None, shingle: int = SHINGLE) -> int:
    """Fingerprint of a UTF-8 text: a bit is set if more than half of the shingle hashes set it.

    Null texts and texts without words give zero. The result is signed, as Spark's bigint.
    """
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(words) < shingle:
        starts, ends = starts[:1], ends[-1:]
    else:
        starts, ends = starts[: len(words) - shingle + 1], ends[shingle - 1 :]
    counts, digest = np.zeros(BITS, np.int64), xxhash.xxh64_intdigest
    for at in range(0, len(starts), _HASHES):
        part = [digest(joined[s:e], SEED) for s, e in zip(starts[at : at + _HASHES].tolist(), ends[at : at + _HASHES].tolist(), strict=True)]
        bits = np.unpackbits(np.array(part, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += np.add.reduce(bits, axis=0, dtype=np.int32)
    bits = np.packbits(counts * 2 > len(starts), bitorder="little")
    return int(bits.view("<i8")[0])


def with_fingerprint(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``(doc_id, text_hash, fp)`` of every row of ``docs (doc_id, text)``."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.large_binary())
            fp = pa.array([simhash(x.as_py(), shingle) for x in texts], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_hash"), fp], ["doc_id", "text_hash", "fp"]
            )

    ship(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(
        rows, f"doc_id {kind}, text_hash bigint, fp bigint"
    )


# ---- the index -------------------------------------------------------------------------


def _blocks(radius: int) -> list[tuple[int, int]]:
    """(first bit from the top, width) of each block."""
    cuts = [BITS * k // (radius + 1) for k in range(radius + 2)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def _rotated(fp: Column, by: int) -> Column:
    return fp if by == 0 else F.shiftleft(fp, by).bitwiseOR(F.shiftrightunsigned(fp, BITS - by))


def _gray_rank(code: Column) -> Column:
    """Place of a code in the Gray sequence, ordered as a signed number."""
    for by in (1, 2, 4, 8, 16, 32):
        code = code.bitwiseXOR(F.shiftrightunsigned(code, by))
    return code.bitwiseXOR(F.lit(-(1 << 63)))


def _gray_code(rank: np.ndarray) -> np.ndarray:
    rank = rank.astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)
    return rank ^ (rank >> np.uint64(1))


def _rotate_back(code: np.ndarray, by: int) -> np.ndarray:
    if by:
        code = (code >> np.uint64(by)) | (code << np.uint64(BITS - by))
    return code.view(np.int64)


class GrayTree:
    """Tree over codes in Gray order; codes of one leading block have a root of their own."""

    def __init__(self, codes: np.ndarray, width: int):
        self.shift = np.uint64(BITS - width)
        first = np.flatnonzero(np.concatenate(([True], codes[1:] >> self.shift != codes[:-1] >> self.shift)))
        self.prefixes = codes[first] >> self.shift
        self.order = np.argsort(self.prefixes)
        # levels from the codes upwards: shared ones, bits set anywhere, children, last code below
        group = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(codes))))
        ones, anys, last = codes, codes, np.arange(len(codes))
        self.levels = [(ones, ~np.uint64(0) * np.ones(len(codes), np.uint64), None, None, last)]
        while len(ones) > len(self.prefixes) or len(self.levels) == 1:
            begins = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
            place = np.arange(len(group)) - np.repeat(begins, np.diff(np.append(begins, len(group))))
            starts = np.flatnonzero(place % FAN_OUT == 0)
            ends = np.append(starts[1:], len(ones))
            ones, anys = np.bitwise_and.reduceat(ones, starts), np.bitwise_or.reduceat(anys, starts)
            last, group = last[ends - 1], group[starts]
            self.levels.append((ones, ~(ones ^ anys), starts, ends, last))
        self.largest = int(np.diff(np.append(first, len(codes))).max())

    def search(self, queries: np.ndarray, radius: int, after: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Blocks of (query, code) numbers within the radius, codes numbered above ``after`` only."""
        block = max(1, min(len(queries), _FRONTIER // self.largest))
        for at in range(0, len(queries), block):
            some = queries[at : at + block]
            place = np.searchsorted(self.prefixes, some >> self.shift, sorter=self.order)
            node = self.order[np.minimum(place, len(self.order) - 1)]
            q = np.flatnonzero(self.prefixes[node] == some >> self.shift)
            node = node[q]
            ones, mask, starts, ends, last = self.levels[-1]
            total = np.bitwise_count((some[q] ^ ones[node]) & mask[node])
            keep = (total <= radius) & (last[node] > after[at + q])
            q, node, total = q[keep], node[keep], total[keep]
            for level in self.levels[-2::-1]:
                count = ends[node] - starts[node]
                child = np.repeat(starts[node] - np.cumsum(count) + count, count) + np.arange(count.sum())
                q, total, shared = np.repeat(q, count), np.repeat(total, count), np.repeat(mask[node], count)
                ones, mask, starts, ends, last = level
                total = total + np.bitwise_count((some[q] ^ ones[child]) & mask[child] & ~shared)
                keep = (total <= radius) & (last[child] > after[at + q])
                q, node, total = q[keep], child[keep], total[keep]
            yield at + q, node


def _links(radius: int):
    blocks = _blocks(radius)

    def forest(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for block, part in rows.groupby("block"):
            by, width = blocks[block]
            own = np.sort(part.loc[part.own, "rank"].to_numpy())
            if not len(own):
                continue
            codes, sent = _gray_code(own), _gray_code(part.loc[~part.own, "rank"].to_numpy())
            both = np.concatenate((codes, sent))
            after = np.concatenate((np.arange(len(codes)), np.full(len(sent), -1)))
            label = np.arange(len(both))
            for a, b in GrayTree(codes, width).search(both, radius, after):
                label = merge_labels(label, a, b)
            a = np.flatnonzero(label != np.arange(len(label)))
            fps = _rotate_back(both, by)
            out.append(pd.DataFrame({"a": fps[a], "b": fps[label[a]]}))
        return pd.concat(out) if out else pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})

    return forest


def near_links(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges ``(a, b)`` that span the classes of fingerprints linked at ``radius`` bits or fewer.

    nodes: column ``fp`` with distinct fingerprints.
    """
    spark, blocks = nodes.sparkSession, _blocks(radius)
    ship(spark)
    entry = F.array(*[
        F.struct(F.lit(k).alias("block"), _gray_rank(_rotated(F.col("fp"), by)).alias("rank")) for k, (by, _) in enumerate(blocks)
    ])
    parts = tasks_for(spark, nodes.count() * len(blocks), ENTRIES_A_TASK)
    index = save_scratch(
        nodes.select(F.inline(entry)).repartitionByRange(parts, "block", "rank").sortWithinPartitions("block", "rank").withColumn("part", F.spark_partition_id()),
        "gray-index",
    )
    plain = F.col("rank").bitwiseXOR(F.lit(-(1 << 63)))
    code = plain.bitwiseXOR(F.shiftrightunsigned(plain, 1))
    width = F.element_at(F.array(*[F.lit(w) for _, w in blocks]), F.col("block") + 1)
    lead = F.expr(f"shiftrightunsigned(code, {BITS} - width)")
    coded = index.select("*", code.alias("code"), width.alias("width")).select("block", "rank", "part", "code", lead.alias("lead"))
    # upper nodes: at most one row per leading block and partition, kept where a block has several partitions
    upper = coded.groupBy("block", "lead", "part").agg(F.bit_and("code").alias("ones"), F.bit_or("code").alias("anys"))
    wide = upper.groupBy("block", "lead").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    upper = upper.join(F.broadcast(wide), ["block", "lead"]).withColumnRenamed("part", "to")
    shared = F.bitwise_not(F.col("ones").bitwiseXOR(F.col("anys")))
    sent = coded.join(F.broadcast(upper), ["block", "lead"]).where(
        (F.col("to") > F.col("part")) & (F.bit_count(F.col("code").bitwiseXOR(F.col("ones")).bitwiseAND(shared)) <= radius)
    ).select("block", "rank", F.col("to").alias("part"), F.lit(False).alias("own"))
    work = index.select("block", "rank", "part", F.lit(True).alias("own")).union(sent)
    return work.groupBy("part").applyInPandas(_links(radius), "a bigint, b bigint")


# ---- the operator ----------------------------------------------------------------------


def classes(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, text_hash, fp, class_fp, component_id`` per row; class_fp is one fingerprint of the class."""
    prints = save_scratch(with_fingerprint(docs, shingle), "fingerprints")
    nodes = save_scratch(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "nodes")
    roots = save_scratch(connected_components(near_links(nodes.select("fp"), radius)), "roots")
    smallest = nodes.join(roots.withColumnRenamed("node", "fp"), "fp").groupBy("root").agg(F.min("first").alias("least"))
    of_linked = roots.join(smallest, "root").select(F.col("node").alias("fp"), "root", "least")
    of_all = nodes.join(of_linked, "fp", "left").select(
        "fp", F.coalesce("root", "fp").alias("class_fp"), F.coalesce("least", "first").alias("component_id")
    )
    of_all = save_scratch(of_all, "classes")  # a fresh table, so that Spark can split a fingerprint with very many rows
    return prints.join(of_all, "fp").select("doc_id", "text_hash", "fp", "class_fp", "component_id")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, fp, component_id`` for every row of ``docs (doc_id, text)``.

    component_id is the smallest doc_id among the documents reachable by links of ``radius``
    bits or fewer. Null and empty texts and texts of white space have fingerprint zero and link
    like others; fewer words than a shingle form one shingle; texts of any length are read
    whole. Repeated rows stay repeated. Rows without id get the component of their class,
    which is null if no row of the class has an id. Other columns are not read. An empty
    table gives an empty table.
    """
    return classes(docs, radius, shingle).select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """The rows of ``docs`` without near-duplicates, all columns kept.

    Of each class the row with the smallest doc_id stays, rows without id last; rows of one
    doc_id but different texts are told apart by the text's hash, and of rows equal in both
    one stays. Null, empty and long texts, other columns and empty tables as in
    ``near_duplicates``.
    """
    least = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")).alias("least")
    keep = classes(docs, radius, shingle).groupBy("class_fp").agg(least).select("least.doc_id", "least.text_hash")
    rows = packed(docs, ["doc_id", "text"]).select("row", "doc_id", F.xxhash64("text").alias("text_hash"))
    one = rows.groupBy("doc_id", "text_hash").agg(F.first("row").alias("row"))
    same = one["doc_id"].eqNullSafe(keep["doc_id"]) & (one["text_hash"] == keep["text_hash"])
    return one.join(keep, same, "left_semi").select("row.*")


def fingerprint_hex(fp: Column | str) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
