"""SentencePiece, token files and packing, against the libraries and plain Python."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest

from encephalake.llm import packing, sentence_pieces, token_files, tokens
from encephalake.llm.common import fresh_path

public_tokenizers = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"
BYTES = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
ODD_TEXTS = [
    "", " ", "  ", "a", " a  b ", "\n", "\n\n a", "a\t b", "a \nb", "a\n b", "x <|endoftext|></s> <unk> <0x41>", "don't it's 'll", "▁ ▁▁a▁",
    "hello　ﬁ½\x00x", "😀😀é", "a" * 3000, " " * 50 + "x", " " * 33, "\x1c a \x1cb", "a\x85b c", "ﷺ", " \n \n", "1 2  3\r\n4 \r\n 5",
]
ROWS = [(i, t, "x", 1, None) for i, t in enumerate(ODD_TEXTS)] + [(5, ODD_TEXTS[5], "x", 1, None), (None, "no id", None, None, None), (99, None, "x", 1, None), (3, "other text", None, 2, 3)]
ODD = "doc_id long, text string, piece string, length int, ids int"


def strings(count, seed=1):
    random.seed(seed)
    parts = ["a", "e", "in", "the", "er", "tion", "B", " ", "  ", "\n", "\t", "é", "1", "'s", ".", " ", "😀", "梦", "\x1c", "▁", "ing", "an", "<|endoftext|>"]
    return ["".join(random.choices(parts, k=random.randint(0, 30))) for _ in range(count)]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(BYTES)
    found.encode_special_tokens = True
    return lambda texts: [e.ids for e in found.encode_batch(texts, add_special_tokens=False)]


@pytest.fixture(scope="module")
def pieces_library():
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=PIECES)


def split(encoded):
    ids, counts = encoded
    return [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]


def test_text_encoder(library, monkeypatch):
    texts = ODD_TEXTS + strings(3000)
    assert split(tokens.TextEncoder(BYTES).encode(texts)) == library(texts)
    monkeypatch.setattr(tokens, "_PIECES_KEPT", 50)  # forgets all the time
    small = tokens.TextEncoder(BYTES)
    for i in range(0, 600, 60):
        assert split(small.encode(texts[i : i + 60])) == library(texts[i : i + 60])


def test_piece_encoder(pieces_library, spark):
    texts = ODD_TEXTS + strings(3000, 2) + [r.text for r in spark.read.parquet(SF + "/documents.parquet").collect() if r.text]
    coder = sentence_pieces.PieceEncoder(PIECES)
    mine = split(coder.encode(texts))
    assert mine == pieces_library.encode(texts)
    assert [coder.decode(x) for x in mine] == pieces_library.decode(mine)


def test_piece_decoder_on_any_ids(pieces_library):
    coder = sentence_pieces.PieceEncoder(PIECES)
    random.seed(4)
    for _ in range(3000):
        ids = random.choices([0, 1, 2, 3, 100, 228, 198, 200, 130, 259, 260, 28705, 13, 300], k=random.randint(0, 6))
        assert coder.decode(ids) == pieces_library.decode(ids)


def test_whole_text_without_cuts(pieces_library):
    """The table of last tokens alone, over spaces and line breaks."""
    coder = sentence_pieces.PieceEncoder(PIECES)
    for text in strings(300, 3):
        if text:
            assert coder._ids("▁" + text.replace(" ", "▁")) == pieces_library.encode(text)


def test_piece_rows(spark, pieces_library):
    docs = spark.createDataFrame(ROWS, ODD)
    got = sorted((tuple(r) for r in sentence_pieces.round_trip(docs, PIECES).collect()), key=repr)
    want = []
    for key, text, *_ in ROWS:
        ids = pieces_library.encode(text or "") + [2]
        digest = hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        want.append((key, len(ids), digest, hashlib.sha256(pieces_library.decode(ids).encode()).hexdigest()))
    assert got == sorted(want, key=repr)
    back = sentence_pieces.decode(sentence_pieces.encode(docs, PIECES), PIECES)
    assert sorted((tuple(r) for r in back.collect()), key=repr) == sorted(((k, pieces_library.decode(pieces_library.encode(t or ""))) for k, t, *_ in ROWS), key=repr)
    assert sentence_pieces.round_trip(docs.limit(0), PIECES).count() == 0


@pytest.mark.parametrize("count", [0, 1, 1023, 1024, 1025, 5000])
@pytest.mark.parametrize("high", [1, 2, 17, 50_000, 1 << 40, 1 << 63])
def test_words_round_trip(count, high):
    rng = np.random.default_rng(count)
    values = rng.integers(0, high, count, dtype=np.uint64)
    values[rng.random(count) < 0.02] = np.uint64((1 << 64) - 1)
    words, offsets, escapes, escape_offsets = token_files.pack_words(values)
    assert (token_files.unpack_words(words, offsets, escapes, count) == values).all()
    for b in range(1, min(3, len(offsets) - 1)):  # one block alone
        w, e = offsets[b : b + 2].astype(int), escape_offsets[b : b + 2].astype(int)
        own = values[b * 1024 : (b + 1) * 1024]
        assert (token_files.unpack_words(words[w[0] : w[1]], offsets[b : b + 2] - offsets[b], escapes[e[0] : e[1]], len(own)) == own).all()


def test_token_files(spark, library):
    docs = spark.createDataFrame(ROWS, ODD)
    manifest = token_files.write_files(docs.repartition(3), BYTES, fresh_path(spark, "tokens"), file_ids=40)
    assert manifest.count() > 2 and manifest.agg({"documents": "sum"}).first()[0] == len(ROWS)
    got = [tuple(r) for r in token_files.read_files(manifest).collect()]
    want = {}
    for key, text, *_ in ROWS:
        ids = library([text or ""])[0] + [0]
        want.setdefault(key, []).append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    found, at = {}, 0
    for key, start, length, crc in sorted(got, key=lambda r: r[1]):
        assert start == at
        at += length
        found.setdefault(key, []).append((length, crc))
    assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in want.items()}
    order = [r[0] for r in sorted(got, key=lambda r: r[1])]
    assert order[0] is None and order[1:] == sorted(order[1:])
    assert token_files.round_trip(docs.limit(0), BYTES).count() == 0


def plain_sum_of_squares(lengths, capacity):
    gaps, place = [], []
    for size in lengths:
        def cost(b):
            after = [g - size if i == b else g for i, g in enumerate(gaps)] + ([capacity - size] if b == len(gaps) else [])
            counts = np.bincount([g for g in after if 0 < g < capacity], minlength=1)
            return int((counts**2).sum())

        options = [(cost(b), gaps[b] if b < len(gaps) else capacity, b) for b in range(len(gaps) + 1) if b == len(gaps) or gaps[b] >= size]
        best = min(o[:2] for o in options)
        b = max(o[2] for o in options if o[:2] == best)
        if b == len(gaps):
            gaps.append(capacity)
        gaps[b] -= size
        place.append(b)
    return gaps


def test_sum_of_squares_rule():
    rng = np.random.default_rng(6)
    for _ in range(20):
        lengths = rng.integers(1, 20, 60)
        place = packing.sum_of_squares(lengths, 20)
        mine = sorted((20 - np.bincount(place, lengths)).astype(int).tolist())
        assert mine == sorted(plain_sum_of_squares(lengths.tolist(), 20))


@pytest.mark.parametrize("length", [1, 1023, 1024, 1025, 2048, 5000])
def test_cut(length):
    found = packing.cut(length)
    assert sum(n for _, n in found) == length and [s for s, _ in found] == np.cumsum([0, *[n for _, n in found]])[:-1].tolist()
    assert all(n == 1024 for _, n in found[1:]) and (len(found) == 1 or length > 1024)


def test_packed_rows(spark, library):
    docs = spark.createDataFrame([*ROWS, (200, "word " * 3000, "x", 1, None)], ODD)
    rows = packing.pack_documents(docs, BYTES).toPandas()
    want = []
    for key, text, *_ in [*ROWS, (200, "word " * 3000)]:
        ids = library([text or ""])[0] + [2]
        want += [(key, i, s, n, zlib.crc32(np.array(ids[s : s + n], "<u4").tobytes())) for i, (s, n) in enumerate(packing.cut(len(ids)))]
    got = [tuple(None if x != x else int(x) for x in r) for r in rows[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False)]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    for _, part in rows.groupby("sequence_id"):
        part = part.sort_values("offset")
        assert part.offset.tolist() == [0, *part.length.cumsum().tolist()[:-1]] and part.length.sum() <= 1024
    assert packing.pack_documents(docs.limit(0), BYTES).count() == 0


def test_packing_over_many_shards(spark):
    pieces = spark.range(4000).selectExpr("id as doc_id", "0 as piece", "0L as start", "1 + pmod(xxhash64(id), 1024) as length", "id as ids_crc32")
    rows = packing.pack(pieces, shard=500).toPandas()
    sizes = rows.groupby("sequence_id").length.sum()
    assert len(rows) == 4000 and rows.doc_id.nunique() == 4000 and sizes.max() <= 1024
    assert len(sizes) < 1.05 * rows.length.sum() / 1024
