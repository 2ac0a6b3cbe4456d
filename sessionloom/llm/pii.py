"""Personal data by fixed forms and by bootstrapped contexts.

E-mail addresses, IP addresses, card numbers and phone numbers are found by their form. They
are the seeds. The words around a seed are lexical patterns: the two words before it, and the
word before with the word after. Patterns and the identifier-like values that stand in
them are a graph. Identifier-like are tokens with an at sign or enough digits, and runs of
digit groups parted by single spaces, such as ``(030) 123 45 67``. Spark scores the graph in
rounds: a pattern's confidence in a kind is the mean score of its distinct values, and a value
that is no seed takes the best confidence of the patterns it stands in, if that is high.
Values found so keep kind and score and support further patterns in the next round, until a
round finds no more. Every place of an accepted value is a new span of the kind.

Texts are read once. What leaves them is spans, values and patterns, in a table in the
shared folder; a pattern that very many values share is only ever counted by grouping.
"""

import re
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from sessionloom.llm.common import ship
from sessionloom.sources.scratch import save_scratch

KINDS = ("email", "ip", "card", "phone")
CONFIDENCE = 0.8  # of a pattern, and so of the values it accepts
SUPPORT = 3  # distinct values that a pattern needs for a kind
DIGITS = 4  # of an identifier-like value without an at sign
RUN_DIGITS = 19  # the most digits of a run of groups that is one value, as many as a card has
REACH = 96  # characters before and after a value in which its context words stand whole

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_GROUP = r"\(?[0-9][0-9()/.-]*+(?=[\s,;:!?]|$)"
_GROUPS = re.compile(rf"(?<!\S)\(?\+?{_GROUP}(?: {_GROUP})++")
_STRIP = "!\"#$%&'()*+,-./:;<=>?[\\]^_`{|}~"


# ---- fixed forms -----------------------------------------------------------------------


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost addresses, in time linear in the text: from each at sign to the left and to the right."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        end = domain.end() if domain else at + 1
        if domain:
            out.append((start, end))
        at = text.find("@", end)
    return out


def _is_ip(found: str) -> bool:
    parts = [p.lstrip("0") for p in found.split(".")]
    return all(len(p) <= 3 and int(p or 0) <= 255 for p in parts)


def _is_card(found: str) -> bool:
    digits = [int(c) for c in _DIGIT.findall(found)] if len(found) < 64 else []
    if not 13 <= len(digits) <= 19:
        return False
    doubled = [d * 2 - 9 if d > 4 else d * 2 for d in digits[-2::-2]]
    return (sum(digits[-1::-2]) + sum(doubled)) % 10 == 0


def _is_phone(found: str) -> bool:
    return 9 <= len(_DIGIT.findall(found)) <= 15


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(kind, start, end)`` in code points, by kind, then start."""
    out = [(0, a, b) for a, b in emails(text)]
    if any(d in text for d in "0123456789"):
        for kind, form, holds in ((1, _IP, _is_ip), (2, _CARD, _is_card), (3, _PHONE, _is_phone)):
            out += [(kind, *m.span()) for m in form.finditer(text) if holds(m[0])]
    return out


def spelled(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


# ---- contexts --------------------------------------------------------------------------


def _plain(word: str) -> str:
    return _DIGIT.sub("0", word.strip(_STRIP).lower())


def patterns(text: str, start: int, end: int) -> list[str]:
    """Lexical patterns of a value's place; none without a word before it."""
    first, last = max(0, start - REACH), end + REACH
    before, after = text[first:start].split()[-3:], text[end:last].split()[:1]
    # a word that is cut by the reach is no word
    if first > 0 and before and not text[first - 1].isspace() and not text[first].isspace() and len(text[first:start].split()) < 4:
        before = before[1:]
    if last < len(text) and after and not text[last].isspace() and text[end:last].rstrip() == text[end:last] and len(text[end:last].split()) == 1:
        after = []
    before, after = [w for w in map(_plain, before) if w], [w for w in map(_plain, after) if w]
    out = [f"{before[-2]} {before[-1]} _"] if len(before) > 1 else []
    return out + [f"{before[-1]} _ {after[0]}"] if before and after else out


def digit_runs(text: str) -> list[tuple[int, int]]:
    """Runs of digit groups parted by single spaces that are one value: DIGITS to RUN_DIGITS digits together."""
    out = []
    for m in _GROUPS.finditer(text):
        if DIGITS <= len(_DIGIT.findall(m[0])) <= RUN_DIGITS:
            out.append((m.start(), m.end() - len(m[0]) + len(m[0].rstrip("(/.-"))))
    return out


def candidates(text: str, spans: list[tuple[int, int, int]]) -> list[dict]:
    """Seeds and identifier-like values apart from them, with value, kind (-1: none) and patterns."""
    found = [(a, b, k) for k, a, b in spans]
    if found or any(d in text for d in "0123456789@"):
        tokens = []
        for m in re.finditer(r"\S+", text):
            token = m[0]
            if "@" in token or len(_DIGIT.findall(token)) >= DIGITS:
                tokens.append((m.start() + len(token) - len(token.lstrip(_STRIP)), m.end() - len(token) + len(token.rstrip(_STRIP))))
        taken = sorted((a, b) for a, b, _ in found)
        # runs first, as a token inside one is no value of its own
        for offered in (digit_runs(text), tokens):
            free, i = [], 0
            for start, end in offered:
                while i < len(taken) and taken[i][1] <= start:
                    i += 1
                if start < end and not (i < len(taken) and taken[i][0] < end):
                    free.append((start, end))
            found += [(a, b, -1) for a, b in free]
            taken = sorted(taken + free)
    return [{"start": a, "end": b, "kind": k, "value": text[a:b], "patterns": patterns(text, a, b)} for a, b, k in sorted(found)]


def _extracted(docs: DataFrame) -> DataFrame:
    """Per row: base spans and their counts, digest and candidates; ``row`` numbers the rows."""
    ship(docs.sparkSession)
    span = pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())])
    place = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.int32()), ("value", pa.string()), ("patterns", pa.list_(pa.string()))])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, digests, places = [], [], []
            for text in batch.column("text"):
                text = text.as_py() or ""
                base = base_spans(text)
                spans.append([{"kind": k, "start": a, "end": b} for k, a, b in base])
                digests.append(sha256(spelled(base).encode()).hexdigest())
                places.append(candidates(text, base))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(spans, pa.list_(span)), pa.array(digests), pa.array(places, pa.list_(place))],
                ["doc_id", "base", "base_sha256", "places"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = (
        f"doc_id {kind}, base array<struct<kind: int, start: int, end: int>>, base_sha256 string, "
        "places array<struct<start: int, end: int, kind: int, value: string, patterns: array<string>>>"
    )
    rows = docs.select("doc_id", "text").mapInArrow(read, schema)
    return save_scratch(rows.withColumn("row", F.monotonically_increasing_id()), "extracted")


# ---- the graph -------------------------------------------------------------------------


def accepted_values(places: DataFrame, rounds: int | None = None, confidence: float = CONFIDENCE, support: int = SUPPORT) -> DataFrame:
    """``value, kind, score`` of the values that bootstrapping accepts.

    places: ``value``, ``kind`` (-1 for values that are no seeds) and ``patterns`` of each place.
    rounds: the most rounds; by default they go on until one accepts nothing new, which ends
    since accepted values stay.
    """
    graph = save_scratch(places.select("value", F.explode("patterns").alias("pattern")).distinct(), "graph")
    seeds = save_scratch(places.where("kind >= 0").groupBy("value").agg(F.min("kind").alias("kind")).withColumn("score", F.lit(1.0)), "seeds")
    values = save_scratch(graph.groupBy("pattern").agg(F.count("*").alias("values")), "patterns")
    best = Window.partitionBy("value").orderBy(F.desc("score"), "kind")
    accepted, turn = seeds.where(F.lit(False)), 0
    while rounds is None or turn < rounds:
        known = seeds.union(accepted)
        sums = graph.join(known, "value").groupBy("pattern", "kind").agg(F.sum("score").alias("sum"), F.count("*").alias("n")).where(F.col("n") >= support)
        # rounded, so that the order of a sum decides nothing
        good = sums.join(values, "pattern").withColumn("score", F.round(F.col("sum") / F.col("values"), 9)).where(F.col("score") >= confidence)
        free = graph.join(known, "value", "left_anti")
        offers = free.join(good.select("pattern", "kind", "score"), "pattern").groupBy("value", "kind").agg(F.max("score").alias("score"))
        new = save_scratch(offers.withColumn("place", F.row_number().over(best)).where("place = 1").select("value", "kind", "score"), "accepted")
        if new.isEmpty():
            break
        accepted, turn = accepted.union(new), turn + 1
    return accepted


def personal_data(docs: DataFrame, rounds: int | None = None, confidence: float = CONFIDENCE, support: int = SUPPORT) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_found`` for every row of ``docs (doc_id, text)``.

    The counts and base_sha256 are of the spans found by form, spans lists these and the
    discovered ones (n_found) as ``kind:start:end``. Null and empty texts have no spans; texts
    of any length are read whole, in linear time. Repeated rows are reported each; a value
    counts once for a pattern however often it stands there, so copies lend no support. A
    value offered to several kinds with one score takes the first kind. Other columns are
    not read. An empty table gives an empty table.
    """
    found = _extracted(docs)
    places = found.select("row", F.inline("places"))
    accepted = accepted_values(places, rounds, confidence, support)
    new = (
        places.where("kind = -1").select("row", "start", "end", "value").join(accepted.select("value", "kind"), "value")
        .groupBy("row").agg(F.collect_list(F.struct("kind", "start", "end")).alias("new"))
    )
    new_spans = F.coalesce("new", F.array().cast("array<struct<kind: int, start: int, end: int>>"))
    every = F.sort_array(F.concat("base", new_spans))
    names = F.array(*map(F.lit, KINDS))
    text = F.array_join(F.transform(every, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [(F.size("base") - F.size(F.array_remove(kinds, k))).cast("bigint").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return found.join(new, "row", "left").select(
        "doc_id", *counts, "base_sha256", text.alias("spans"), F.size(new_spans).cast("bigint").alias("n_found")
    )
