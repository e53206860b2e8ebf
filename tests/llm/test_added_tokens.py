"""Ops 4 and 6 against the plain library: the string of a special token gets the token's id."""

from __future__ import annotations

import zlib

import numpy as np
import pytest
from test_tokens_packing import ODD_TEXTS, split, strings

from encephalake.llm import tokens
from encephalake.llm.queries import QUERIES

public_tokenizers = pytest.importorskip("public_tokenizers")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
END = "<|endoftext|>"
TEXTS = [f"a {END} b", END, f"{END}{END}", f" {END} ", f"x{END}y z", f"{END}  b", f"a\n{END}\nb", f"a  {END}\tb", f"<|endoftext| > {END[:-1]}", f"word {END} " * 50]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(BYTES)
    return lambda text: found.encode(text, add_special_tokens=False).ids


def test_encoder_follows_the_library(library, monkeypatch):
    texts = TEXTS + ODD_TEXTS + strings(3000, 7)
    assert 50256 in library(TEXTS[0])
    assert split(tokens.AddedTextEncoder(BYTES).encode(texts)) == [library(t) for t in texts]
    monkeypatch.setattr(tokens, "_PIECES_KEPT", 50)
    small = tokens.AddedTextEncoder(BYTES)
    for i in range(0, 600, 60):
        assert split(small.encode(texts[i : i + 60])) == [library(t) for t in texts[i : i + 60]]


def test_tokens_that_take_spaces_with_them(library, tmp_path):
    from tokenizers import AddedToken, Tokenizer

    changed = Tokenizer.from_file(BYTES)
    changed.add_tokens([AddedToken("two words", normalized=False), AddedToken("<r>", rstrip=True, normalized=False), AddedToken("<l>", lstrip=True, normalized=False)])
    changed.save(str(tmp_path / "t.json"))
    texts = ["a two words b", "x <r> y z", "x <l> y", "one two wordsy", *TEXTS, "plain text here"]
    plain = Tokenizer.from_file(str(tmp_path / "t.json"))
    assert split(tokens.AddedTextEncoder(str(tmp_path / "t.json")).encode(texts)) == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def test_queries_follow_the_library(spark, library, tmp_path):
    rows = list(enumerate([*TEXTS, "plain text"]))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    got = {r.doc_id: (r.n_tokens, r.ids_crc32) for r in QUERIES["op4_token_files"](spark, str(tmp_path)).collect()}
    assert got == {k: (len(library(t)) + 1, crc([*library(t), 0])) for k, t in rows}
    got = {r.doc_id: (r.length, r.ids_crc32) for r in QUERIES["op6_sum_of_squares_packing"](spark, str(tmp_path)).collect()}
    assert got == {k: (len(library(t)) + 1, crc([*library(t), 2])) for k, t in rows}
