"""Token ids in files of directly addressable codes.

An id is split into bytes, the lowest first. Level k holds the k-th bytes of the ids that have
one; a bitmap marks those that go on, and a directory of the marks before every 512th place
makes their rank, and so the place in the next level, a matter of one block. Any token, or
any stretch of tokens, is read from its own bytes alone.

Documents are range-partitioned and sorted by id, so files follow each other in the ids' order.
A file holds a bounded number of tokens, the codes, and an index of its documents. A word's
ids depend on the word alone, so words are remembered between documents.
"""

import json
import re
import struct
from collections.abc import Iterator
from functools import cache
from itertools import pairwise
from zlib import crc32

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F
from tokenizers import Tokenizer

from sessionloom.llm.common import ship, tasks_for
from sessionloom.llm.files import new_file, new_folder, open_file
from sessionloom.llm.words import BatchWords, row_slices
from sessionloom.sources.scratch import save_scratch

VOCABULARY = "word_bpe_49k.json"
END_ID = 1
FILE_TOKENS = 1 << 22
ROWS_A_TASK = 16_384
BLOCK = 512  # bits between two entries of a rank directory
_MAGIC = b"DACS"
_READ_TOKENS = 1 << 20
_CACHED = 300_000  # words of a generation
_TEXT_BYTES = 8 << 20  # of text encoded at once
_TAIL = ".,!?;:#$%&*|"
#: Letters whose normal form and lower case are one letter each, so that a mark behind them stays a piece of its own.
_PLAIN = re.compile("[A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF]+")


# ---- words to ids ----------------------------------------------------------------------


class Words:
    """Ids of words, as little-endian bytes; the words of the last two generations are remembered."""

    def __init__(self, vocabulary: str):
        self.tokenizer = Tokenizer.from_str(vocabulary)
        ends = self.tokenizer.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(max(self.tokenizer.get_vocab(with_added_tokens=True).values()) + 1, bool)
        self.ends[[i for t, i in ends.items() if t.endswith("</w>")]] = True
        self.now: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _encode(self, words: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(words, add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in found]

    def _encode_letters(self, words: list[str]) -> list[bytes]:
        """Words of plain letters are one piece each: encoded as one text, they part where a word ends."""
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
        cuts = np.flatnonzero(self.ends[ids]) + 1
        if len(cuts) != len(words):
            return self._encode(words)
        data = ids.tobytes()
        return [data[4 * a : 4 * b] for a, b in pairwise([0, *cuts.tolist()])]

    def learn(self, words: list[str]) -> None:
        """Add the ids of the words that are not known. Only words of plain letters are parted from the signs behind them."""
        if len(self.now) > _CACHED:
            self.now, self.old = {}, self.now
        letters, others, made = set(), set(), []
        for w in words:
            if w in self.now:
                continue
            if w in self.old:
                self.now[w] = self.old[w]
                continue
            stem = w.rstrip(_TAIL)
            if stem.isascii() and stem.isalpha() or _PLAIN.fullmatch(stem):
                tail, stem = w[len(stem) :], stem.lower()  # as the tokenizer does, letter by letter
                if stem != w:
                    made.append((w, stem, tail))
                if stem not in self.now:
                    if stem in self.old:
                        self.now[stem] = self.old[stem]
                    else:
                        letters.add(stem)
                if tail and tail not in self.now:
                    others.add(tail)
            else:
                others.add(w)
        for some, encode in ((list(letters), self._encode_letters), (list(others), self._encode)):
            if some:
                self.now.update(zip(some, encode(some), strict=True))
        for w, stem, tail in made:
            self.now[w] = self.now[stem] + (self.now[tail] if tail else b"")

    def ids(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each with the end id, and where each text begins.

        ASCII white space parts words in every text; other white space is left to the tokenizer.
        """
        words = BatchWords(texts)
        known = words.known.to_pylist()
        self.learn(known)
        parts = [self.now[w] for w in known]
        parts.append(np.uint32(end_id).tobytes())
        words_and_ends = np.insert(words.codes, words.starts[1:], len(known))
        data = b"".join(map(parts.__getitem__, words_and_ends.tolist()))
        lengths = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        ends = np.concatenate(([0], np.cumsum(lengths[words_and_ends])))
        return np.frombuffer(data, "<u4"), ends[words.starts[:-1] + np.arange(len(words.starts) - 1)]


@cache
def _words(vocabulary: str) -> Words:
    return Words(vocabulary)


# ---- codes -----------------------------------------------------------------------------


def encode(ids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Levels of ``(chunks, bitmap, directory)``."""
    levels, rest = [], ids.astype(np.uint32)
    while len(rest) or not levels:
        more = rest > 255
        bitmap = np.packbits(more, bitorder="little")
        padded = np.zeros(-(-len(rest) // BLOCK) * BLOCK, np.int64)
        padded[: len(rest)] = more
        directory = np.concatenate(([0], np.cumsum(padded.reshape(-1, BLOCK).sum(1))))
        levels.append(((rest & 255).astype(np.uint8), bitmap, directory.astype("<u8")))
        rest = rest[more] >> 8
    return levels


def write_codes(stream, ids: np.ndarray, index: pa.Table) -> int:
    """Write a file of ids and the index of its documents; the bytes written.

    Layout: magic, length of the header, header in JSON with the place and length of every
    part, then the parts: of each level chunks, bitmap and directory, at last the index.
    """
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, index.schema) as out:
        out.write_table(index)
    parts = [p.tobytes() for level in encode(ids) for p in level] + [sink.getvalue().to_pybytes()]
    places = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).tolist()
    head = json.dumps({"tokens": len(ids), "parts": list(pairwise(places))}).encode()
    stream.write(_MAGIC + struct.pack("<I", len(head)) + head)
    for p in parts:
        stream.write(p)
    return 8 + len(head) + places[-1]


class Codes:
    """An open file of codes; reads only the bytes that an access needs."""

    def __init__(self, source):
        self.source = source
        start = source.read_at(8, 0)
        if start[:4] != _MAGIC:
            raise ValueError("not a file of codes")
        (length,) = struct.unpack("<I", start[4:])
        head = json.loads(source.read_at(length, 8))
        self.tokens, self.parts, self.at = head["tokens"], head["parts"], 8 + length

    def _part(self, part: int, start: int, length: int) -> bytes:
        return self.source.read_at(length, self.at + self.parts[part][0] + start)

    def _rank(self, level: int, place: int) -> int:
        """Marks before a place: the directory's entry and the bits of one block."""
        block = place // BLOCK
        (before,) = struct.unpack("<Q", self._part(3 * level + 2, 8 * block, 8))
        bits = np.unpackbits(np.frombuffer(self._part(3 * level + 1, block * BLOCK // 8, -(-(place % BLOCK) // 8)), np.uint8), bitorder="little")
        return before + int(bits[: place % BLOCK].sum())

    def read(self, start: int, end: int, level: int = 0) -> np.ndarray:
        """Ids from ``start`` to before ``end``."""
        if start >= end:
            return np.zeros(0, np.uint32)
        out = np.frombuffer(self._part(3 * level, start, end - start), np.uint8).astype(np.uint32)
        first = start // 8
        bits = np.unpackbits(np.frombuffer(self._part(3 * level + 1, first, -(-end // 8) - first), np.uint8), bitorder="little")
        more = bits[start - 8 * first : end - 8 * first].astype(bool)
        if more.any():
            rank = self._rank(level, start)
            out[more] |= self.read(rank, rank + int(more.sum()), level + 1) << 8
        return out

    def __getitem__(self, place: int) -> int:
        if not 0 <= place < self.tokens:
            raise IndexError(place)
        return int(self.read(place, place + 1)[0])

    def index(self) -> pa.Table:
        """``doc_id, start`` of the documents, in order."""
        start, end = self.parts[-1]
        return pa.ipc.open_stream(self._part(len(self.parts) - 1, 0, end - start)).read_all()


# ---- tables ----------------------------------------------------------------------------


def write_tokens(docs: DataFrame, vocabulary: str | None = None, folder: str | None = None, end_id: int = END_ID, file_tokens: int = FILE_TOKENS) -> DataFrame:
    """Encode ``docs (doc_id, text)`` into files; ``path, start, tokens, documents`` of each, start counting tokens over all.

    vocabulary: path of the tokenizer's file; the driver reads it and hands it to the tasks.
    """
    spark = docs.sparkSession
    ship(spark)
    folder = folder or new_folder(spark, "tokens")
    with open(vocabulary or public_tokenizers.path(VOCABULARY), encoding="utf-8") as f:
        shared = spark.sparkContext.broadcast(f.read())
    tasks = tasks_for(spark, docs.count(), ROWS_A_TASK)
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("turn"))
    rows = rows.repartitionByRange(tasks, "doc_id", "turn").sortWithinPartitions("doc_id", "turn").select("doc_id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, task, number = _words(shared.value), TaskContext.get().partitionId(), 0
        ids, names, starts, size = [], [], [], 0

        def flush() -> pa.RecordBatch:
            index = pa.table({"doc_id": pa.concat_arrays(names), "start": np.concatenate(starts)})
            with new_file(folder, "dac") as (path, stream):
                write_codes(stream, np.concatenate(ids), index)
            return pa.RecordBatch.from_arrays([pa.array([x]) for x in (task, number, path, size, len(index))], ["task", "number", "path", "tokens", "documents"])

        for batch in batches:
            for part in row_slices(batch, "text", min(_TEXT_BYTES, 4 * file_tokens)):
                got, at = words.ids(part.column("text"), end_id)
                ids.append(got)
                names.append(part.column("doc_id"))
                starts.append(at + size)
                size += len(got)
                if size >= file_tokens:
                    yield flush()
                    ids, names, starts, size, number = [], [], [], 0, number + 1
        if ids:
            yield flush()

    files = save_scratch(rows.mapInArrow(write, "task bigint, number bigint, path string, tokens bigint, documents bigint"), "files")
    before = Window.orderBy("task", "number").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    return files.select("path", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("start"), "tokens", "documents")


def read_tokens(files: DataFrame, kind: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document in the files ``(path, start)``; kind is doc_id's type."""
    ship(files.sparkSession)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, first in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
                with open_file(path) as source:
                    codes = Codes(source)
                    index = codes.index()
                    cuts = np.append(index["start"].to_numpy(), codes.tokens)
                    sums = []
                    for a, b in pairwise(cuts.tolist()):
                        crc = 0
                        for at in range(a, b, _READ_TOKENS):
                            crc = crc32(codes.read(at, min(b, at + _READ_TOKENS)).astype("<u4").tobytes(), crc)
                        sums.append(crc)
                    for part in pa.table([index["doc_id"], pa.array(cuts[:-1] + first), pa.array(np.diff(cuts)), pa.array(sums, pa.int64())], names).to_batches():
                        yield part

    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
    spread = files.select("path", "start").repartition(max(1, files.count()))
    return spread.mapInArrow(read, f"doc_id {kind}, start bigint, n_tokens bigint, ids_crc32 bigint")


def coded_documents(docs: DataFrame, vocabulary: str | None = None, end_id: int = END_ID, file_tokens: int = FILE_TOKENS) -> DataFrame:
    """Write ``docs`` and read them back: ``doc_id, start, n_tokens, ids_crc32`` per row.

    Null and empty texts have the end id only; texts of any length are encoded whole, a text of
    more than a file's tokens in one file. Rows without id come first, rows of one id follow by
    their texts' hash. Other columns are not read. An empty table gives no files and an empty
    table.
    """
    files = save_scratch(write_tokens(docs, vocabulary, end_id=end_id, file_tokens=file_tokens), "starts")
    return read_tokens(files, docs.schema["doc_id"].dataType.simpleString())
