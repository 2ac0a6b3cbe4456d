"""Near copies by the Jaccard similarity of their five-word shingles.

Texts of one class of `simhash` (fingerprints linked by few differing bits, as op2 links them) are
candidates. So are texts less near than fingerprints reach down to: min-hashes of a text's set of
shingles make ``BANDS`` keys of ``ROWS`` each, and texts that share a key are candidates too. A
pair of similarity 0.8 shares none about once in 1,000,000, more similar pairs less often still.
Candidates are held together by connected components, and the sets of
their shingles (64-bit hashes) are compared exactly: first each with the smallest of its
component, then those that were not similar to it with all of the component, in blocks of
bounded size. Pairs of the similarity asked for are links, and linked texts are one class.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from sessionloom.llm import simhash
from sessionloom.llm.common import mix64, packed, ship
from sessionloom.llm.components import connected_components, merge_labels
from sessionloom.sources.scratch import save_scratch

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 26, 4
BLOCK = 512  # texts of a component that a task compares with as many others
_CHUNK = 4_096  # shingles whose min-hashes are computed at once
_RANDOM = np.random.default_rng(20_240_501)
_TIMES = _RANDOM.integers(0, 1 << 63, (BANDS * ROWS, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _RANDOM.integers(0, 1 << 63, (BANDS * ROWS, 1), dtype=np.uint64) * np.uint64(2)


def shingle_set(text: bytes | None, size: int = SHINGLE) -> np.ndarray:
    """Hashes of the distinct shingles, ascending; fewer words are one shingle, no words none."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    size = min(size, len(words))
    w = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    out = np.full(len(words) - size + 1, size, np.uint64)
    for k in range(size):
        out = mix64(out + w[k : len(words) - size + 1 + k])
    return np.unique(out)


def band_keys(hashes: np.ndarray) -> np.ndarray:
    least = np.full(BANDS * ROWS, ~np.uint64(0))
    for at in range(0, len(hashes), _CHUNK):
        np.minimum(least, (hashes[at : at + _CHUNK] * _TIMES + _PLUS).min(1), out=least)
    keys = np.arange(BANDS, dtype=np.uint64)
    for column in least.reshape(BANDS, ROWS).T:
        keys = mix64(keys * np.uint64(0x9E3779B97F4A7C15) + column)
    return keys


def _mapped(rows: DataFrame, kept: list[str], name: str, work) -> DataFrame:
    """``kept`` and ``name``, the numbers that ``work`` makes of each text's shingles."""
    schema = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [work(shingle_set(x.as_py())).view(np.int64) for x in batch.column("text").cast(pa.large_binary())]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(got, pa.list_(pa.int64()))], [*kept, name])

    return rows.select(*kept, "text").mapInArrow(run, f"{schema}, {name} array<bigint>")


def _similar(least: float):
    def links(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        a, b = [], []
        if len(left) and len(right):
            sizes = right.others.map(len).to_numpy()
            some = np.flatnonzero(sizes)
            starts = np.concatenate(([0], np.cumsum(sizes[some])[:-1]))
            known, flat = np.unique(np.concatenate(right.others.to_list()).astype(np.int64), return_inverse=True)
            keys = right.other.to_numpy()
            for key, own in zip(left.key, left.shingles, strict=True):
                own = np.asarray(own, np.int64)
                if not len(own):  # texts without words are alike
                    near = np.flatnonzero(sizes == 0)
                elif len(some):
                    mark = np.isin(known, own, assume_unique=True)
                    both = np.add.reduceat(mark[flat], starts, dtype=np.int64)
                    near = some[both >= least * (len(own) + sizes[some] - both) - 1e-9]
                else:
                    continue
                near = near[keys[near] != key]
                a.append(np.full(len(near), key))
                b.append(keys[near])
        a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b))
        nodes, place = np.unique(np.concatenate((a, b)), return_inverse=True)
        label = merge_labels(np.arange(len(nodes)), place[: len(a)], place[len(a) :])
        child = np.flatnonzero(label != np.arange(len(nodes)))
        return pd.DataFrame({"a": nodes[child], "b": nodes[label[child]]})

    return links


def similar_links(texts: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """Edges ``(a, b)`` that span the classes of similar texts; texts: ``key, text``, rows of one key have one text."""
    spark = texts.sparkSession
    ship(spark)
    signed = save_scratch(_mapped(texts, ["key"], "bands", band_keys).dropDuplicates(["key"]), "bands")
    classed = simhash.classes(texts.select(F.col("key").alias("doc_id"), "text")).select(
        F.col("doc_id").alias("key"), F.xxhash64(F.lit("simhash"), "component_id").alias("band")
    )
    classed = save_scratch(classed.dropDuplicates(["key"]), "simhash-classes")
    entries = classed.unionByName(signed.select("key", F.explode("bands").alias("band")))
    heads = entries.groupBy("band").agg(F.min("key").alias("head"), F.count("*").alias("n")).where("n > 1").drop("n")
    # a text belongs to the smallest head of its bands, and that one is linked to its other heads:
    # of a large group few pairs of heads differ, so components are sought among those alone
    led = entries.join(heads, "band").groupBy("key").agg(F.min("head").alias("m"), F.collect_set("head").alias("heads"))
    led = save_scratch(led, "led")
    between = led.select(F.explode("heads").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
    roots = save_scratch(connected_components(between), "head-roots")
    members = led.select("key", "m").join(roots.select(F.col("node").alias("m"), "root"), "m", "left")
    members = save_scratch(members.select("key", F.coalesce("root", "m").alias("component")), "candidates")
    sets = _mapped(texts.join(members, "key"), ["key", "component"], "shingles", lambda x: x).dropDuplicates(["key"])
    sets = save_scratch(sets, "shingles")
    roots = sets.where("key = component").select("component", F.col("shingles").alias("of_root"))
    both = F.size(F.array_intersect("shingles", "of_root"))
    # members without words meet only their like
    alike = (F.size("shingles") + F.size("of_root") == 0) | (both >= least * (F.size("shingles") + F.size("of_root") - both) - 1e-9)
    judged = save_scratch(sets.join(roots, "component").select("key", "component", alike.alias("alike")), "judged")
    split = judged.groupBy("component").agg(F.count("*").alias("n"), F.count_if(~F.col("alike")).alias("odd")).where("odd > 0")
    split = save_scratch(split.select("component", F.ceil(F.col("n") / BLOCK).cast("int").alias("all_blocks"), F.ceil(F.col("odd") / BLOCK).cast("int").alias("odd_blocks")), "split")
    open_sets = sets.join(split, "component").join(judged.select("key", "alike"), "key")
    of = lambda blocks: F.pmod(F.xxhash64("key"), F.col(blocks).cast("bigint")).cast("int")
    every = lambda blocks: F.explode(F.sequence(F.lit(0), F.col(blocks) - 1))
    left = open_sets.where(~F.col("alike")).select("component", "key", "shingles", of("odd_blocks").alias("i"), every("all_blocks").alias("j"))
    named = [F.col("component").alias("of"), F.col("key").alias("other"), F.col("shingles").alias("others")]
    right = open_sets.select(*named, of("all_blocks").alias("second"), every("odd_blocks").alias("first"))
    rest = left.groupBy("component", "i", "j").cogroup(right.groupBy("of", "first", "second")).applyInPandas(_similar(least), "a bigint, b bigint")
    return judged.where("alike and key <> component").select(F.col("key").alias("a"), F.col("component").alias("b")).union(rest)


def keep_one(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` without near copies, all columns kept.

    Near copies are texts whose sets of five-word shingles have a Jaccard similarity of ``least``
    or more, and texts linked by such. Words are parted by ASCII white space, in lower case of
    ASCII letters; fewer words than a shingle form one; null texts and texts without words are
    alike. Texts of any length are read whole. Of each class the row with the smallest doc_id
    stays, rows without id last; rows of one doc_id but different texts are told apart by the
    text's hash, and of rows equal in both one stays. An empty table gives an empty table.
    """
    texts = docs.select(F.xxhash64("text").alias("key"), "text")
    roots = save_scratch(connected_components(similar_links(texts, least)).select(F.col("node").alias("text_hash"), "root"), "roots")
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"))
    least_row = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")).alias("least")
    of_text = rows.groupBy("text_hash").agg(least_row)
    of_class = of_text.join(roots, "text_hash", "left").groupBy(F.coalesce("root", "text_hash").alias("class")).agg(F.min("least").alias("least"))
    keep = of_class.select("least.doc_id", "least.text_hash")
    whole = packed(docs, ["doc_id", "text"]).select("row", "doc_id", F.xxhash64("text").alias("text_hash"))
    kept = whole.join(keep, whole["doc_id"].eqNullSafe(keep["doc_id"]) & (whole["text_hash"] == keep["text_hash"]), "left_semi")
    return kept.groupBy("doc_id", "text_hash").agg(F.first("row").alias("row")).select("row.*")
