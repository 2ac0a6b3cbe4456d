"""Spelling variants: pairs of words one edit apart, found by composing acceptors.

``M1 . edit . M1`` accepts the pairs of words of one length that differ in one letter, and
``M2 . deletion . M1`` those where M2's words have one letter more. Acceptors are minimised,
level by level, and their states carry how many words they accept, so that the sums along a
path are the word's number in the sorted list. The pairs are enumerated over the composed
machine's states: both sides walk together until the edit, then apart but by equal letters.

An initial state stands for what both words have in common at their ends. Words of length c
(and those one longer) are dealt out twice: by the first half, for edits in the second, and
by the second half, for edits in the first. Each such state with its words is a piece of
work of its own. One with very many words is dealt out again, by a part of its middle also,
until the middle is a single letter; so pieces stay small whatever the words are, and no pair
is lost.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from zlib import crc32

from sessionloom.llm.common import mix64, ship, tasks_for
from sessionloom.llm.words import BatchWords, row_slices
from sessionloom.sources.scratch import save_scratch

LEAST_LETTERS = 5
LEAST_COUNT = 3
RATIO = 2
SLIP = 97  # one in so many runs loses a letter
PIECE = 32_768  # words of an initial state from which it is dealt out again
ENTRIES_A_TASK = 131_072
_TEXT_BYTES = 4 << 20  # of text taken apart at once
_LABEL_BITS = np.int64(21)  # room of a code point


# ---- vocabulary ------------------------------------------------------------------------


def vocabulary(docs: DataFrame, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT, slip: int = SLIP) -> DataFrame:
    """``word, n``: runs of the letters A-Z, a-z and U+00C0 to U+00FF in lower case of A-Z, and how often they occur.

    A run loses the code point ``h % length`` where h, the CRC-32 of ``<doc_id>:<run>``, is a
    multiple of ``slip``. Shorter and rarer results are left out.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in row_slices(batch, "text", _TEXT_BYTES):
                yield counted(part)

    def counted(batch: pa.RecordBatch) -> pa.RecordBatch:
        text = pc.ascii_lower(batch.column("text").cast(pa.large_string()).fill_null(""))
        words = BatchWords(pc.replace_substring_regex(text, r"[^a-z\x{C0}-\x{FF}]+", " "))
        known = words.known.to_pylist()
        data, codes, cuts = [w.encode() for w in known], words.codes.tolist(), words.starts.tolist()
        sums = []
        for name, a, b in zip(batch.column("name").to_pylist(), cuts, cuts[1:], strict=False):
            start = crc32(f"{name}:".encode())
            sums += [crc32(data[c], start) for c in codes[a:b]]
        hit = np.flatnonzero(np.array(sums, np.uint32) % np.uint32(slip) == 0).tolist()
        counts = np.bincount(words.codes, minlength=len(known))
        changed: dict[str, int] = {}
        for i in hit:
            word = known[codes[i]]
            at = sums[i] % len(word)
            less = word[:at] + word[at + 1 :]
            changed[less] = changed.get(less, 0) + 1
            counts[codes[i]] -= 1
        found = {known[i]: n for i, n in enumerate(counts.tolist()) if n}
        for word, n in changed.items():
            found[word] = found.get(word, 0) + n
        found = {w: n for w, n in found.items() if len(w) >= least_letters}
        return pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], ["word", "n"])

    ship(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("name"), "text")
    return rows.mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


# ---- acceptors and their composition ---------------------------------------------------


def _children(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(owner, place)`` of every place in the given ranges."""
    count = ends - starts
    owner = np.repeat(np.arange(len(count)), count)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(count) - count - starts, count)


class Acceptor:
    """Minimised acceptor of words of one length, one initial state per group.

    ``order`` sorts the given rows by group and letters. Of depth d, ``first[d]`` holds where a
    state's arcs begin, ``label[d]``, ``target[d]`` the arcs, and ``skip[d]`` the words below
    the arcs before it.
    """

    def __init__(self, groups: np.ndarray, letters: np.ndarray):
        length = letters.shape[1]
        self.length = length
        self.order = np.lexsort((*letters.T[::-1], groups))
        groups, letters = groups[self.order], letters[self.order]
        fresh = [np.concatenate(([True], groups[1:] != groups[:-1]))]
        for column in letters.T:
            fresh.append(fresh[-1] | np.concatenate(([True], column[1:] != column[:-1])))
        self.first, self.label, self.target, self.skip = ([None] * length for _ in range(4))
        state, words = np.zeros(int(fresh[-1].sum()), np.int64), np.ones(1, np.int64)
        for depth in range(length - 1, -1, -1):
            arcs = np.flatnonzero(fresh[depth + 1])
            starts = np.flatnonzero(fresh[depth][arcs])
            label, target = letters[arcs, depth].astype(np.int64), state
            state, keep = self._merged(starts, label, target)
            ends = np.append(starts[1:], len(arcs))
            owner, place = _children(starts[keep], ends[keep])
            self.label[depth], self.target[depth] = label[place], target[place]
            self.first[depth] = np.append(0, np.cumsum(ends[keep] - starts[keep]))
            below = np.cumsum(words[target[place]])
            before = np.concatenate(([0], below))
            self.skip[depth] = before[:-1] - before[self.first[depth][:-1]][owner]
            words = np.diff(before[self.first[depth]])
        begins = np.flatnonzero(fresh[0])
        self.groups, self.begins, self.roots = groups[begins], begins, state

    @staticmethod
    def _merged(starts: np.ndarray, label: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """State of each node and a node of each state; nodes with equal arcs are one state."""
        count = np.diff(np.append(starts, len(label)))
        seed = 1
        while True:
            arcs = (target << _LABEL_BITS | label).astype(np.uint64)
            sign = np.add.reduceat(mix64(arcs * np.uint64(2) + np.uint64(1) + np.uint64(seed)), starts)
            _, keep, state = np.unique(sign, return_index=True, return_inverse=True)
            if (count == count[keep][state]).all():
                owner, place = _children(starts, starts + count)
                other = starts[keep][state][owner] + place - starts[owner]
                if (label[place] == label[other]).all() and (target[place] == target[other]).all():
                    return state, keep
            seed += 1_000_003  # two different sets of arcs had one sign

    def arcs(self, depth: int, states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return _children(self.first[depth][states], self.first[depth][states + 1])

    def find(self, depth: int, states: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the states have an arc of that label, and the arcs of those."""
        keys = np.repeat(np.arange(len(self.first[depth]) - 1), np.diff(self.first[depth])) << _LABEL_BITS | self.label[depth]
        wanted = states << _LABEL_BITS | labels
        place = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        has = keys[place] == wanted
        return has, place[has]


def _step(left: Acceptor, right: Acceptor, depths: tuple[int, int], now: tuple) -> tuple:
    """Both sides read one equal letter; now: state and word number of each side, and a letter not to be read."""
    a, i, b, j, bar = now
    owner, arc = left.arcs(depths[0], a)
    label = left.label[depths[0]][arc]
    free = label != bar[owner]
    owner, arc, label = owner[free], arc[free], label[free]
    has, other = right.find(depths[1], b[owner], label)
    owner, arc = owner[has], arc[has]
    return (
        left.target[depths[0]][arc], i[owner] + left.skip[depths[0]][arc],
        right.target[depths[1]][other], j[owner] + right.skip[depths[1]][other], np.full(len(owner), -1),
    )


def _joined(x: tuple, y: tuple) -> tuple:
    return tuple(np.concatenate(z) for z in zip(x, y, strict=True))


_NONE = tuple(np.zeros(0, np.int64) for _ in range(5))


def replaced(words: Acceptor) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of word numbers of one group that differ in one letter, each once."""
    q, i = words.roots, words.begins
    apart = _NONE
    for depth in range(words.length):
        apart = _step(words, words, (depth, depth), apart)
        owner, arc = words.arcs(depth, q)
        one, two = _children(arc + 1, words.first[depth][q + 1][owner])
        target, at = words.target[depth], i[owner] + words.skip[depth][arc]
        second = i[owner[one]] + words.skip[depth][two]
        apart = _joined(apart, (target[arc[one]], at[one], target[two], second, np.full(len(one), -1)))
        q, i = target[arc], at
    return apart[1], apart[3]


def shortened(longer: Acceptor, words: Acceptor) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of word numbers of one group where the first word without one letter is the second, each once."""
    _, one, two = np.intersect1d(longer.groups, words.groups, assume_unique=True, return_indices=True)
    same = (longer.roots[one], longer.begins[one], words.roots[two], words.begins[two], np.full(len(one), -1))
    apart = _NONE
    for depth in range(longer.length):
        if depth:
            apart = _step(longer, words, (depth, depth - 1), apart)
        owner, arc = longer.arcs(depth, same[0])
        # of a run of equal letters the last one goes, so that a pair comes once
        gone = (longer.target[depth][arc], same[1][owner] + longer.skip[depth][arc], same[2][owner], same[3][owner], longer.label[depth][arc])
        apart = _joined(apart, gone)
        if depth < words.length:
            same = _step(longer, words, (depth, depth), same)
    return apart[1], apart[3]


# ---- pieces of work --------------------------------------------------------------------

_PIECE_KEY = ("c", "low", "high", "fixed")


def _dealt(rows: DataFrame) -> DataFrame:
    """Rows of ``c, low, high, longer, word, n`` twice, for edits in either half of the places from low to before high."""
    middle = F.floor((F.col("low") + F.col("high")) / 2).cast("int")
    halves = F.array(F.struct(F.col("low").alias("from"), middle.alias("to")), F.struct(middle.alias("from"), F.col("high").alias("to")))
    cut = rows.select("c", F.explode(halves).alias("half"), "longer", "word", "n")
    rest = F.expr("substring(word, half.to + if(longer, 2, 1))")
    fixed = F.concat(F.expr("substring(word, 1, half.from)"), F.lit("|"), rest)
    return cut.select("c", F.col("half.from").alias("low"), F.col("half.to").alias("high"), fixed.alias("fixed"), "longer", "word", "n")


def _pieces(words: DataFrame, most: int) -> list[DataFrame]:
    """Entries of words by initial state; no state has more than ``most`` words, or it has one letter left to edit."""
    length = F.char_length("word")
    roles = F.array(F.struct(length.alias("c"), F.lit(False).alias("longer")), F.struct((length - 1).alias("c"), F.lit(True).alias("longer")))
    whole = words.select(F.explode(roles).alias("role"), "word", "n").where("role.c > 0")
    rows = _dealt(whole.select("role.c", F.lit(0).alias("low"), F.col("role.c").alias("high"), "role.longer", "word", "n"))
    done = []
    while True:
        sizes = rows.groupBy(*_PIECE_KEY).agg(F.count("*").alias("size"))
        hot = save_scratch(sizes.where((F.col("size") > most) & (F.col("high") - F.col("low") > 1)).drop("size"), "hot-states")
        if hot.isEmpty():
            return [*done, rows]
        done.append(rows.join(hot, [*_PIECE_KEY], "left_anti").select(rows.columns))
        rows = _dealt(save_scratch(rows.join(hot, [*_PIECE_KEY], "left_semi").select("c", "low", "high", "longer", "word", "n"), "hot-words"))


def _letters(words: list[str], low: int, length: int) -> np.ndarray:
    return np.frombuffer("".join(w[low : low + length] for w in words).encode("utf-32-le"), "<u4").reshape(len(words), length)


def _blocks(groups: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """Rows in blocks of whole groups, groups in order."""
    order = np.argsort(groups, kind="stable")
    ends = np.flatnonzero(np.diff(groups[order], append=-1)) + 1
    at = 0
    while at < len(order):
        upto = int(ends[max(np.searchsorted(ends, at + most, side="right") - 1, np.searchsorted(ends, at, side="right"))])
        yield order[at:upto]
        at = upto


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``word, near, n``: both directions of every pair in a task's pieces; n is the near word's."""
    batches = list(batches)
    if not batches:
        return
    table = pa.Table.from_batches(batches).combine_chunks()
    numbers = {c: table.column(c).to_numpy() for c in ("c", "low", "high", "n")}
    longer = table.column("longer").to_numpy(zero_copy_only=False).astype(bool)
    group = table.column("fixed").combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    kinds, kind = np.unique(np.stack([numbers[c] for c in ("c", "low", "high")]), axis=1, return_inverse=True)
    kind = kind.ravel()
    for k, (_, low, high) in enumerate(kinds.T.tolist()):
        rows = np.flatnonzero(kind == k)
        of = group[rows]
        rows = rows[np.bincount(of)[of] > 1]
        for block in _blocks(group[rows], PIECE):
            some = rows[block]
            ours, theirs = some[~longer[some]], some[longer[some]]
            if not len(ours):
                continue
            take = lambda at: table.column("word").take(pa.array(at))
            words = Acceptor(group[ours], _letters(take(ours).to_pylist(), low, high - low))
            ours = ours[words.order]
            a, b = replaced(words)
            pairs = [(ours[a], ours[b])]
            if len(theirs):
                more = Acceptor(group[theirs], _letters(take(theirs).to_pylist(), low, high - low + 1))
                a, b = shortened(more, words)
                pairs.append((theirs[more.order][a], ours[b]))
            a, b = (np.concatenate(x) for x in zip(*pairs, strict=True))
            a, b = np.concatenate((a, b)), np.concatenate((b, a))
            yield from pa.table([take(a), take(b), pa.array(numbers["n"][b])], ["word", "near", "n"]).to_batches(max_chunksize=65_536)


def near_words(words: DataFrame, most: int = PIECE) -> DataFrame:
    """``word, near``: of each word of ``words (word, n)`` with near words, the array of them as ``(less, near)``, less being -n.

    Near words differ by exactly one inserted, deleted or replaced code point. Words must be
    distinct and not null.
    """
    ship(words.sparkSession)
    pieces = _pieces(words, most)
    tasks = tasks_for(words.sparkSession, 4 * words.count(), ENTRIES_A_TASK)
    found = None
    for rows in pieces:
        pairs = rows.repartition(tasks, *_PIECE_KEY).mapInArrow(_found, "word string, near string, n bigint")
        found = pairs if found is None else found.union(pairs)
    # a pair may come from two pieces; a word has a bounded number of near words, about a hundred per letter
    return found.groupBy("word").agg(F.collect_set(F.struct((-F.col("n")).alias("less"), "near")).alias("near"))


# ---- the operator ----------------------------------------------------------------------


def _roots(forms: DataFrame) -> DataFrame:
    """``word, root``: where the forms of ``forms (word, form)``, none of them null, lead in the end."""
    now = save_scratch(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = save_scratch(now.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        now = after.drop("moved")
        if after.where("moved").isEmpty():
            return now


def spelling_groups(docs: DataFrame, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT, ratio: float = RATIO, slip: int = SLIP, most: int = PIECE) -> DataFrame:
    """Words of ``docs (doc_id, text)`` grouped by spelling: ``word, form, root, n, n_near, form_n``.

    Words and their counts n are those of ``vocabulary``. A word's form is its near word (one
    code point inserted, deleted or replaced) of largest n, on ties the smallest in code-point
    order, if that n is at least ``ratio`` times its own; else null. ``root`` follows forms to
    the last one. Null and empty texts have no words, rows without id count with an empty id,
    repeated rows count again, texts of any length are read whole, other columns are not read.
    Tables without words give an empty table.
    """
    words = save_scratch(vocabulary(docs, least_letters, least_count, slip), "vocabulary")
    near = near_words(words, most).select("word", F.size("near").cast("bigint").alias("n_near"), F.array_min("near").alias("best"))
    joined = words.join(near, "word", "left")
    fits = -F.col("best.less") >= ratio * F.col("n")
    formed = save_scratch(joined.select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"),
        F.when(fits, F.col("best.near")).alias("form"), F.when(fits, -F.col("best.less")).alias("form_n"),
    ), "forms")
    roots = _roots(formed.where("form IS NOT NULL").select("word", "form"))
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
