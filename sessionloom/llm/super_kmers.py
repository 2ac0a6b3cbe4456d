"""Repeated word windows, found by super-k-mers.

The least hash among the runs of ``RUN`` words inside a window is its minimiser. Equal windows
have equal minimisers, and consecutive windows mostly share theirs, so the words that they
span travel together as one packed string, a super-k-mer, to the minimiser's bucket.

A window whose minimiser occurs nowhere else is no repeat, so minimisers are counted first,
as numbers, and only super-k-mers of repeated ones are packed at all. Equal packed strings
are counted before they are dealt out, so copies of a text cost one string. Inside a bucket
the windows of all strings are sorted by hash, neighbours are compared word by word, and
counts are exact. A minimiser in very many different strings (a passage in many documents)
would make one bucket too large; its windows are spread by a 128-bit digest of their own
words instead and counted by Spark.

Texts do not travel: a scanning task writes them to files of bounded size in the shared
folder, and later tasks open the file whose number their rows carry.
"""

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
import xxhash
from pyspark.sql import DataFrame, functions as F

from sessionloom.llm.common import mix64, ship, tasks_for
from sessionloom.llm.files import new_folder, open_file, write_file
from sessionloom.llm.words import BatchWords, sliding_min
from sessionloom.sources.scratch import save_scratch

WINDOW = 35
RUN = 8
FILE_BYTES = 8 << 20  # of text in a file; a longer text has a file of its own
BUCKET_BYTES = 8 << 20  # of packed strings in a task
MOST = 4_096  # windows of a packed string
FILES_A_TASK = 4
HOT = 1_024  # different strings of one minimiser from which its windows are spread
_STEP = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2^64


# ---- numbers of a batch ----------------------------------------------------------------


def _window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash of each ``width`` consecutive word hashes, from running sums of a polynomial modulo 2^64."""
    n = len(hashes)
    if n < width:
        return np.zeros(0, np.uint64)
    inverse = np.uint64(pow(int(_STEP), -1, 1 << 64))
    up = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n - 1, _STEP))))
    down = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n - width, inverse))))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashes * up)))
    return (sums[width:] - sums[:-width]) * down


def super_kmers(words: BatchWords, window: int, run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(text, start, windows, minimiser, hits)`` of the batch's super-k-mers.

    start counts the text's words, hits the places of the minimiser in the super-k-mer. A
    minimiser with one hit in all the corpus has no repeated window.
    """
    run = min(run, window)
    known = np.fromiter(map(xxhash.xxh3_64_intdigest, words.known.cast(pa.large_binary()).to_pylist()), np.uint64, len(words.known))
    none = np.zeros(0, np.int64)
    if len(words.codes) < window:
        return none, none, none, none, none
    runs = mix64(_window_hashes(known[words.codes], run))
    least = sliding_min(runs, window - run + 1)
    counts = np.maximum(np.diff(words.starts) - window + 1, 0)  # windows of each text
    text = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)
    least = least[words.starts[:-1][text] + place]
    if not len(text):
        return none, none, none, none, none
    fresh = (place == 0) | np.concatenate(([True], least[1:] != least[:-1]))
    begin = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
    first = np.flatnonzero((np.arange(len(text)) - begin) % MOST == 0)  # a very long one goes in pieces
    windows = np.diff(np.append(first, len(text)))
    text, place, least = text[first], place[first], least[first]
    spans = windows + window - run
    inside = np.arange(spans.sum()) + np.repeat(words.starts[:-1][text] + place - np.cumsum(spans) + spans, spans)
    hits = np.add.reduceat(runs[inside] == np.repeat(least, spans), np.cumsum(spans) - spans, dtype=np.int64)
    return text, place, windows, least.view(np.int64), hits


# ---- texts in files --------------------------------------------------------------------


def _scan(docs: DataFrame, folder: str, window: int, run: int, file_bytes: int) -> DataFrame:
    """Write the texts; ``file, row, start, windows, minimiser`` of every super-k-mer, and a row without start per file."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            lengths = pc.binary_length(batch.column("text").cast(pa.large_string())).fill_null(0).to_numpy(zero_copy_only=False) + 64
            sums, at = np.concatenate(([0], np.cumsum(lengths, dtype=np.int64))), 0
            while at < len(batch):
                upto = int(np.searchsorted(sums, sums[at] + file_bytes - size, side="right")) - 1
                if upto <= at and held:  # the next text does not fit into this file
                    yield from flush(held)
                    held, size = [], 0
                    continue
                upto = max(upto, at + 1)
                held.append(batch.slice(at, upto - at))
                size, at = size + int(sums[upto] - sums[at]), upto
        if held:
            yield from flush(held)

    def flush(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held)
        number = uuid.uuid4().int >> 65
        with write_file(f"{folder}/{number}.parquet") as stream:
            pq.write_table(table, stream, compression="zstd", use_dictionary=False)
        rows, *numbers = super_kmers(BatchWords(table.column("text")), window, run)
        out = [np.full(len(rows) + 1, number), np.append(rows, -1), *[np.append(x, 0) for x in numbers]]
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int32()]
        named = ["file", "row", "start", "windows", "minimiser", "hits"]
        yield from pa.table([pa.array(x, kind) for x, kind in zip(out, kinds, strict=True)], named).to_batches(max_chunksize=65_536)

    return docs.select("doc_id", "text").mapInArrow(scan, "file bigint, row int, start int, windows int, minimiser bigint, hits int")


def _texts(folder: str, number: int) -> pa.Table:
    with open_file(f"{folder}/{number}.parquet") as source:
        return pq.read_table(source)


def _packed(found: DataFrame, folder: str, window: int) -> DataFrame:
    """The packed string of every row of ``found``, and its 128-bit digest as the name ``pack``."""

    def cut(rows: pd.DataFrame) -> pd.DataFrame:
        texts = _texts(folder, int(rows.file.iloc[0])).column("text")
        rows = rows.sort_values(["row", "start"], ignore_index=True)
        at, packed = -1, []
        for row, start, windows in zip(rows.row.tolist(), rows.start.tolist(), rows.windows.tolist(), strict=True):
            if row != at:
                at, words = row, (texts[row].as_py() or "").encode().split()
            packed.append(b" ".join(words[start : start + windows + window - 1]))
        names = [hashlib.blake2b(p, digest_size=16).digest() for p in packed]
        return rows[["file", "row", "start", "windows", "minimiser"]].assign(packed=[p.decode() for p in packed], pack=names)

    return found.select("file", "row", "start", "windows", "minimiser").groupBy("file").applyInPandas(cut, "file bigint, row int, start int, windows int, minimiser bigint, packed string, pack binary")


# ---- counting --------------------------------------------------------------------------


def _equal_classes(hashes: np.ndarray, codes: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """Class number of each window; windows are of one class if their words are equal.

    Sorted by hash, each window is compared word by word with the one before it. Where two
    different windows have one hash, those of that hash are sorted by their words.
    """
    order = np.argsort(hashes, kind="stable")
    same = np.concatenate(([False], hashes[order][1:] == hashes[order][:-1]))
    pairs = np.flatnonzero(same)
    differs = np.zeros(len(pairs), bool)
    for k in range(width):
        differs |= codes[starts[order[pairs]] + k] != codes[starts[order[pairs - 1]] + k]
    if differs.any():
        group = np.cumsum(~same)
        for g in np.unique(group[pairs[differs]]):
            inside = np.flatnonzero(group == g)
            rows = codes[starts[order[inside]][:, None] + np.arange(width)]
            by_words = np.lexsort(rows.T[::-1])
            order[inside] = order[inside][by_words]
            same[inside[1:]] = (rows[by_words][1:] == rows[by_words][:-1]).all(1)
    out = np.empty(len(hashes), np.int64)
    out[order] = np.cumsum(~same) - 1
    return out


def _stretches(marks: np.ndarray, counts: np.ndarray) -> list[list[int]]:
    """Of each run of ``counts`` marks the stretches of true ones, as places from, before, from, before, ..."""
    out = []
    for part in np.split(marks, np.cumsum(counts)[:-1]):
        edges = np.flatnonzero(np.diff(np.concatenate(([0], part.astype(np.int8), [0]))))
        out.append(edges.tolist())
    return out


def _counted(window: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = list(batches)
        if not batches:
            return
        table = pa.Table.from_batches(batches)
        words = BatchWords(table.column("packed"))
        number = np.diff(words.starts) - window + 1
        pack = np.repeat(np.arange(len(number)), number)
        starts = words.starts[:-1][pack] + np.arange(len(pack)) - np.repeat(np.cumsum(number) - number, number)
        hashes = _window_hashes(mix64(np.arange(1, len(words.known) + 1, dtype=np.uint64))[words.codes], window)[starts]
        kind = _equal_classes(hashes, words.codes, starts, window)
        total = np.bincount(kind, table.column("n").to_numpy()[pack])
        found = _stretches(total[kind] > 1, number)
        some = [i for i, x in enumerate(found) if x]
        yield from pa.table({"pack": table.column("pack").take(pa.array(some, pa.int64())), "places": pa.array([found[i] for i in some], pa.list_(pa.int32()))}).to_batches()

    return count


def _spread(window: int):
    """A row per window of the hot strings: pack, place and digest of the window's words."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pack, packed, n in zip(*(batch.column(c).to_pylist() for c in ("pack", "packed", "n")), strict=True):
                words = packed.encode().split()
                ends = np.cumsum([len(w) + 1 for w in words])
                text, starts = " ".join([*(w.decode() for w in words), ""]).encode(), np.concatenate(([0], ends[:-1]))
                places = range(len(words) - window + 1)
                digests = [hashlib.blake2b(text[starts[i] : ends[i + window - 1]], digest_size=16).digest() for i in places]
                yield pa.RecordBatch.from_arrays([pa.array([pack] * len(places), pa.binary()), pa.array(places, pa.int32()), pa.array(digests, pa.binary()), pa.array([n] * len(places), pa.int64())], ["pack", "place", "digest", "n"])

    return spread


def _repeated_places(packs: DataFrame, window: int, hot: int) -> DataFrame:
    """``pack, places`` of the strings with repeated windows; packs: ``pack, minimiser, packed, n``, one row per string."""
    spark = packs.sparkSession
    sizes = packs.groupBy("minimiser").agg(F.count("*").alias("strings"))
    very = save_scratch(sizes.where(F.col("strings") > hot).select("minimiser"), "hot-minimisers")
    size = packs.agg(F.sum(F.octet_length("packed"))).first()[0] or 0
    usual = packs.join(very, "minimiser", "left_anti").repartition(tasks_for(spark, size, BUCKET_BYTES), "minimiser")
    places = usual.select("pack", "packed", "n").mapInArrow(_counted(window), "pack binary, places array<int>")
    of_hot = packs.join(very, "minimiser", "left_semi").select("pack", "packed", "n")
    spread = save_scratch(of_hot.mapInArrow(_spread(window), "pack binary, place int, digest binary, n bigint"), "spread")
    again = spread.groupBy("digest").agg(F.sum("n").alias("n")).where("n > 1").select("digest")
    marks = spread.join(again, "digest").groupBy("pack").agg(F.collect_list("place").alias("at"))
    single = F.flatten(F.transform("at", lambda p: F.array(p, p + 1)))
    return places.union(marks.select("pack", single))


# ---- the operator ----------------------------------------------------------------------


def without_repeats(docs: DataFrame, window: int = WINDOW, run: int = RUN, hot: int = HOT, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Cut the words that repeated windows cover: ``doc_id, text, n_words, n_removed, spans`` per row of ``docs (doc_id, text)``.

    A window is ``window`` consecutive words of one text, parted by ASCII white space and
    taken unchanged. Every word that is covered by a window whose words also start at another
    place, in the same text or another row, goes; windows are judged on the whole input.
    ``text`` is the kept words joined by one space, ``spans`` the removed stretches as word
    places (from, before). Null and empty texts and texts of fewer words than a window keep
    all they have; a repeated row loses all its words if it has a window. Texts of any length
    are read whole. Other columns are not read. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    ship(spark)
    folder = new_folder(spark, "window-texts")
    scanned = save_scratch(_scan(docs, folder, window, run, file_bytes), "super-k-mers")
    kmers = scanned.where("row >= 0")
    tasks = tasks_for(spark, scanned.where("row < 0").count(), FILES_A_TASK)
    repeated = save_scratch(kmers.groupBy("minimiser").agg(F.sum("hits").alias("n")).where("n > 1").select("minimiser"), "repeated-minimisers")
    candidates = kmers.join(repeated, "minimiser", "left_semi").repartition(tasks, "file")
    found = save_scratch(_packed(candidates, folder, window), "packed")
    packs = save_scratch(found.groupBy("pack", "minimiser", "packed").agg(F.count("*").alias("n")), "packs")
    places = save_scratch(_repeated_places(packs, window, hot), "places")
    marks = save_scratch(found.select("file", "row", "start", "pack").join(places, "pack").select("file", "row", "start", "places"), "marks")

    def cut(marks: pd.DataFrame) -> pd.DataFrame:
        table = _texts(folder, int(marks.file.iloc[0]))
        words = BatchWords(table.column("text"))
        marks = marks[marks.row >= 0]
        step = np.zeros(len(words.codes) + 1, np.int64)
        for row, start, places in zip(marks.row.tolist(), marks.start.tolist(), marks.places, strict=True):
            at = words.starts[row] + start + np.asarray(places, np.int64)
            np.add.at(step, at[::2], 1)
            np.add.at(step, at[1::2] + window - 1, -1)
        gone = np.cumsum(step[:-1]) > 0
        before = np.concatenate(([0], np.cumsum(gone)))
        spans = _stretches(gone, np.diff(words.starts))
        out = pd.DataFrame({"doc_id": table.column("doc_id").to_pandas(types_mapper=pd.ArrowDtype), "text": words.joined(~gone).to_pandas(types_mapper=pd.ArrowDtype)})
        out["n_words"], out["n_removed"] = np.diff(words.starts), np.diff(before[words.starts])
        out["spans"] = [[{"from": a, "before": b} for a, b in zip(x[::2], x[1::2], strict=True)] for x in spans]
        return out

    kind = docs.schema["doc_id"].dataType.simpleString()
    every_file = scanned.where("row < 0").select("file", "row", "start", F.lit(None).cast("array<int>").alias("places"))
    return marks.union(every_file).repartition(tasks, "file").groupBy("file").applyInPandas(
        cut, f"doc_id {kind}, text string, n_words bigint, n_removed bigint, spans array<struct<from: int, before: int>>"
    )
