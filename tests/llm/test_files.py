import gzip
import random
from base64 import b32encode
from hashlib import sha1
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from sessionloom.llm import token_codes, warc

RNG = random.Random(4)


def pages(spark):
    noise = "".join(chr(RNG.randint(32, 0x2000)) for _ in range(50_000))
    rows = [(i, f"http://x/{i}\r\nEvil: 1", RNG.choice(["<p>a</p>", "é" * i, noise[: i * 300]]), "x") for i in range(150)]
    rows += [(500, None, None, "x"), (501, "u", "", "x"), (502, "u", "", "x"), (None, "u", "<p>a</p>", "x"), (None, "u", "lonely", "x"), (3, "u", rows[3][2], "x"), (600, "u", "WARC/1.0\r\n\r\n\x1f\x08" * 10, "x")]
    return rows, spark.createDataFrame(rows, "page_id bigint, url string, html string, digest string").repartition(3)


@pytest.mark.parametrize("length,least", [(100, 0), (4 << 20, 0), (1_000, 500)])
def test_archives_round_trip(spark, length, least):
    rows, table = pages(spark)
    got = warc.archived_pages(table, least, length).collect()
    first = {}
    for i, _, h, _ in rows:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    want = []
    for i, _, h, _ in rows:
        data = (h or "").encode()
        again = (h or "") in first and first[h or ""] != i and len(data) >= least
        want.append((i, len(data), b32encode(sha1(data).digest()).decode(), "revisit" if again else "response", first[h or ""] if again else None))
    assert sorted(map(str, got)) == sorted(f"Row(page_id={w[0]}, payload_bytes={w[1]}, payload_digest={w[2]!r}, record_type={w[3]!r}, refers_to={w[4]})" for w in want)


def test_files_are_plain_gzip_with_payloads(spark):
    rows, table = pages(spark)
    files = warc.write_archives(table)
    for r in files.collect():
        assert gzip.open(r.path.removeprefix("file://")).read().startswith(b"WARC/1.0\r\n")
    texts = {r.page_id: r.payload for r in warc.read_archives(files, 5_000).where("record_type = 'response' and page_id is not null").collect()}
    assert all((dict((i, h) for i, _, h, _ in rows)[int(i)] or "").encode() == p for i, p in texts.items())
    assert warc.archived_pages(table.where("false")).count() == 0


def test_false_magic_and_every_cut():
    data = b"junk" + warc.MAGIC + b"\x00" * 20 + warc.member(warc.record(1, None, b"x" * 3000))
    data += warc.member(b"not a record") + b"".join(warc.member(warc.record(i, "u", bytes(RNG.randbytes(50)))) for i in range(5))
    source = pa.BufferReader(data)
    whole = list(warc.records(source, 0, len(data)))
    assert [warc.parse(c)["page_id"] for _, c in whole] == ["1", "0", "1", "2", "3", "4"]
    for cut in range(0, len(data), 7):
        assert [*warc.records(source, 0, cut), *warc.records(source, cut, len(data))] == whole


def test_damaged_record_is_an_error():
    content = warc.record(1, None, b"abc")
    with pytest.raises(ValueError):
        warc.parse(content.replace(b"abc", b"abd"))
    with pytest.raises(ValueError):
        warc.parse(content[:-5])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 255), st.integers(0, 1 << 32), st.just(256), st.just((1 << 32) - 1)), max_size=2_000).map(lambda x: [min(v, (1 << 32) - 1) for v in x]))
def test_codes_give_any_stretch(ids):
    ids = np.array(ids, np.uint32)
    sink = pa.BufferOutputStream()
    index = pa.table({"doc_id": [1], "start": [0]})
    token_codes.write_codes(sink, ids, index)
    codes = token_codes.Codes(pa.BufferReader(sink.getvalue()))
    assert codes.tokens == len(ids) and codes.index() == index
    assert (codes.read(0, len(ids)) == ids).all()
    for _ in range(20):
        a, b = sorted((RNG.randint(0, len(ids)), RNG.randint(0, len(ids))))
        assert (codes.read(a, b) == ids[a:b]).all()
        if len(ids):
            assert codes[a % len(ids)] == ids[a % len(ids)]
    with pytest.raises(IndexError):
        codes[len(ids)]


@settings(max_examples=1_000, deadline=None)
@given(st.text(alphabet="abcXYZ éßİΣς.,'!#|<>0123 \n\t\x1c  ́ाक한", max_size=60))
def test_words_give_the_tokenizers_ids(text):
    words = vocabulary()
    assert ids_of(words, text) == words.tokenizer.encode(text, add_special_tokens=False).ids


def ids_of(words, text):
    ids, starts = words.ids(pa.array([text, None, text]), 1)
    assert starts.tolist() == [0, len(ids) // 2, len(ids) // 2 + 1] and ids[starts[1:] - 1].tolist() == [1, 1] and ids[-1] == 1
    assert (ids[: starts[1]] == ids[starts[2] :]).all()
    return ids[: starts[1] - 1].tolist()


def test_every_letter_before_every_sign():
    words = vocabulary()
    letters = [c for c in map(chr, [*range(0xD800), *range(0xE000, 0x10000)]) if c.isalpha() or not c.isascii() and c.isprintable()]
    some = [f"{a}{c}{t}" for c in letters for t in token_codes._TAIL for a in ("", "a")]
    text = " ".join(some)
    assert ids_of(words, text) == words.tokenizer.encode(text, add_special_tokens=False).ids


def vocabulary():
    import public_tokenizers

    with open(public_tokenizers.path(token_codes.VOCABULARY), encoding="utf-8") as f:
        return token_codes._words(f.read())


def test_forgotten_words_are_learned_again(monkeypatch):
    monkeypatch.setattr(token_codes, "_CACHED", 3)
    words = token_codes.Words(vocabulary().tokenizer.to_str())
    for text in ("alpha beta gamma delta. alpha", "<|endoftext|> it's don't alpha,", "eta theta alpha beta, gamma", "alpha") * 3:
        assert ids_of(words, text) == words.tokenizer.encode(text, add_special_tokens=False).ids


def test_documents_round_trip_in_order(docs):
    rows = [(i, " ".join(RNG.choice(["Alpha", "beta,", "été", "12"]) for _ in range(RNG.randint(0, 40)))) for i in range(120)]
    rows += [(500, None), (501, ""), (None, "no id"), (7, "again seven"), (502, "word " * 60_000)]
    got = token_codes.coded_documents(docs(rows), file_tokens=500).collect()
    tokenizer, want = vocabulary().tokenizer, {}
    for i, t in rows:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want.setdefault(i, []).append((len(ids), crc32(ids.tobytes())))
    found, place = {}, 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == place
        place += r.n_tokens
        found.setdefault(r.doc_id, []).append((r.n_tokens, r.ids_crc32))
    assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in want.items()}
    order = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert order[0] is None and order[1:] == sorted(order[1:])
    assert token_codes.coded_documents(docs(rows).where("false")).count() == 0
