"""SentencePiece ids of texts and texts of ids, for models of the merge (BPE) kind.

Encoding keeps a table with the last token of every prefix. That token is unique: among the vocabulary
pieces that end at the prefix's end (found by an automaton) and the single character, it is the one that
is compatible with the last token of the prefix before it. A pair is compatible if merging both spellings
together never joins across their border; this is read off the order in which either token is merged.
Ids are recovered from the end backwards. Characters that the vocabulary lacks become byte tokens.

Texts are cut where no vocabulary piece can reach across (before a run of spaces, at a line break), so
that known parts are not encoded again; the model's vocabulary is checked for this, and a model for which
it does not hold gets whole texts. No normalisation beyond a leading space mark is done: models that ask
for more are refused. Null text is an empty one, whose only id is the end id.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_list, slices
from .tokens import MemoEncoder, encoder

MARK = "▁"
_PAIRS_KEPT = 1_000_000
_PARTS = re.compile(MARK + "+[^" + MARK + "]*|[^" + MARK + "]+")


class PieceEncoder(MemoEncoder):
    """Encoder and decoder of one model file."""

    def __init__(self, file: str, limit: int | None = None):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=file)
        everything = range(model.get_piece_size())
        self.end = model.eos_id()
        self.pieces = [model.id_to_piece(i) for i in everything]
        self.byte = {i: int(self.pieces[i][3:5], 16) for i in everything if model.is_byte(i)}
        self.control = {i for i in everything if model.is_control(i)}
        self.unknown = model.unk_id()
        if len(self.byte) != 256 or model.encode(" a  ａ ", out_type=str) != list(map(model.id_to_piece, model.encode(" a  ａ "))):
            raise ValueError("the model has no byte tokens")
        if model.decode(model.encode(" a  ａ ")) != " a  ａ ":
            raise ValueError("the model normalises texts")
        normal = [i for i in everything if i not in self.byte and i not in self.control and i != self.unknown and not model.is_unused(i)]
        self.id_of = {self.pieces[i]: i for i in normal}
        scores = sorted({model.get_score(i) for i in normal}, reverse=True)
        place = {s: k for k, s in enumerate(scores)}
        #: when a piece is merged: the order of its score; single characters are there from the start
        self.rank = {self.pieces[i]: place[model.get_score(i)] if len(self.pieces[i]) > 1 else -1 for i in normal}
        self.halves: dict[str, tuple[str, str] | None] = {}
        self.fits: dict[tuple[str, str], bool] = {}
        self.automaton = ahocorasick.Automaton()
        for piece in self.rank:
            if len(piece) > 1:
                self.automaton.add_word(piece, piece)
        self.automaton.make_automaton()
        self.cut_marks = not any(re.search("[^" + MARK + "]" + MARK, p) for p in self.rank)
        self.cut_lines = not any("\n" in p for p in self.rank)
        self.byte_ids = {b: i for i, b in self.byte.items()}
        self.shown = ["" if i in self.control else p.replace(MARK, " ") for i, p in enumerate(self.pieces)]
        self.shown[self.unknown] = " ⁇ "
        self.special = np.zeros(len(self.pieces), bool)
        self.special[list(self.byte)] = True
        super().__init__(limit)

    # encoding

    def cut(self, text: str) -> list[str]:
        marked = MARK + text.replace(" ", MARK)
        parts: list[str] = []
        for i, line in enumerate(marked.split("\n") if self.cut_lines else [marked]):
            if i:
                parts.append("\n")
            if not self.cut_marks:
                parts.append(line)
            elif MARK + MARK in line or line.endswith(MARK):
                parts += _PARTS.findall(line)
            else:
                first, *rest = line.split(MARK)
                if first:
                    parts.append(first)
                parts += map(MARK.__add__, rest)
        return [p for p in parts if p]

    def encode_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.fits) > _PAIRS_KEPT:
            self.fits.clear()
        found = [self._ids(p) for p in pieces]
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.uint32, int(lengths.sum())), lengths

    def _ids(self, text: str) -> list[int]:
        found: list[int] = []
        for token in self.tokens(text):
            known = self.id_of.get(token)
            if known is None:
                found += [self.byte_ids[b] for b in token.encode()]
            else:
                found.append(known)
        return found

    def tokens(self, text: str) -> list[str]:
        """The merged pieces of ``text``, characters outside the vocabulary included."""
        last: list[str | None] = [None] * len(text)
        done = 0  # prefixes of fewer characters have their last token
        fits, compatible = self.fits, self.compatible
        for at, piece in self.automaton.iter(text):
            while done < at:
                if last[done] is None:
                    last[done] = text[done]
                done += 1
            if last[at] is None:
                start = at - len(piece)
                if start < 0:
                    if self.split(piece) is not None:
                        last[at] = piece
                    continue
                pair = (last[start], piece)
                fit = fits.get(pair)
                if fit is None:
                    fit = fits[pair] = self.split(piece) is not None and compatible(*pair)
                if fit:
                    last[at] = piece
        for at in range(done, len(text)):
            if last[at] is None:
                last[at] = text[at]
        out, at = [], len(text) - 1
        while at >= 0:
            out.append(last[at])
            at -= len(last[at])
        return out[::-1]

    def split(self, piece: str) -> tuple[str, str] | None:
        """The two parts whose merge makes ``piece``; None if merging its characters ends otherwise."""
        if piece not in self.halves:
            parts, halves = list(piece), None
            while len(parts) > 1:
                best = min(((self.rank.get(a + b, 1 << 30), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))))
                if best[0] == 1 << 30:
                    halves = None
                    break
                i = best[1]
                halves = (parts[i], parts[i + 1])
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            self.halves[piece] = halves
        return self.halves[piece]

    def compatible(self, left: str, right: str) -> bool:
        """Whether the border between two tokens outlasts all merges.

        Going back in time, the token made last is taken apart. The border falls if the two symbols
        beside it make a piece that is merged before either symbol is merged into its token: earlier
        than the left one's merge, or not later than the right one's (the merge further left goes first).
        """
        rank, limit = self.rank, 1 << 60  # twice the rank; odd for what must go first also when equal
        while True:
            joined = rank.get(left + right)
            if joined is not None and 2 * joined < limit:
                return False
            made_left, made_right = rank.get(left, -1), rank.get(right, -1)
            if made_left > made_right:
                limit, left = 2 * made_left, self.split(left)[1]
            elif made_right < 0:
                return True
            else:
                limit, right = 2 * made_right + 1, self.split(right)[0]

    # decoding

    def decode(self, ids: list[int]) -> str:
        """The text of ids: marks become spaces, the leading one goes; control ids are silent."""
        while ids and ids[-1] in self.control:
            ids = ids[:-1]
        if not self.special[ids].any():
            text = "".join(map(self.shown.__getitem__, ids))
        else:
            parts, held = [], bytearray()
            for i in ids:
                value = self.byte.get(i)
                if value is not None:
                    held.append(value)
                    continue
                if held:
                    parts.append(_text_of(bytes(held)))
                    held.clear()
                parts.append(self.shown[i])
            parts.append(_text_of(bytes(held)))
            text = "".join(parts)
        first = next((i for i in ids if i not in self.control), None)
        return text[1:] if first is not None and self.pieces[first].startswith(MARK) else text


def _text_of(data: bytes) -> str:
    """UTF-8 with a replacement character for every byte that belongs to no character."""
    try:
        return data.decode()
    except UnicodeDecodeError as error:
        return data[: error.start].decode() + "�" + _text_of(data[error.start + 1 :])


def encode(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids): the ids of each whole text and the end id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(model, PieceEncoder)
        for batch in slices(batches, 1):
            ids, counts = coder.encode([t.decode("utf-8", "replace") for t in byte_list(batch.column(1))], coder.end)
            offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(ids.astype(np.int32)))], ["doc_id", "ids"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text)).mapInArrow(run, "doc_id long, ids array<int>")


def decode(rows: DataFrame, model: str) -> DataFrame:
    """(doc_id, text) of (doc_id, ids); null ids give a null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(model, PieceEncoder)
        for batch in batches:
            texts = [None if ids is None else coder.decode(ids) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): every text encoded, and its ids decoded, in one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(model, PieceEncoder)
        for batch in slices(batches, 1):
            ids, counts = coder.encode([t.decode("utf-8", "replace") for t in byte_list(batch.column(1))], coder.end)
            spelled, decoded = [], []
            for own in np.split(ids, np.cumsum(counts)[:-1]):
                own = own.tolist()
                spelled.append(hashlib.sha256(" ".join(map(str, own)).encode()).hexdigest())
                decoded.append(hashlib.sha256(coder.decode(own).encode()).hexdigest())
            columns = [batch.column(0), pa.array(counts), pa.array(spelled), pa.array(decoded)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text)).mapInArrow(run, schema)
