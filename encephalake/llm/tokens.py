"""Whole texts to token ids with a public tokenizer file.

Texts are cut at single spaces that stand between two characters which are not white space, and at single
line breaks where a text has no other white space: there the byte-level pattern always starts a new word,
whatever stands around, so pieces are encoded on their own and known pieces are not encoded again. The
memory of known pieces is bounded; texts are read whole.
Strings of special tokens are ordinary text to ``TextEncoder``; ``AddedTextEncoder`` gives them their own
ids, as ``Tokenizer.encode(text, add_special_tokens=False)`` does by default.
"""

from __future__ import annotations

import os
import re
from itertools import chain

import numpy as np

_PIECES_KEPT = 800_000
_IDS_KEPT = 4_000_000
_GROUP = 200
#: What a piece starts with that no space goes before: a line break's first word (the break is part of it), a text's first.
_LINE, _FIRST = "\n", "\r"
_CUT = re.compile(r"(?<=\S) (?=\S)")


class _Numbers(dict):
    """Pieces numbered in the order they come; new ones are also listed."""

    def __init__(self, pieces=()):
        super().__init__(zip(pieces, range(len(pieces))))
        self.new: list[str] = []

    def __missing__(self, piece: str) -> int:
        number = self[piece] = len(self)
        self.new.append(piece)
        return number


class MemoEncoder:
    """Encodes texts piece by piece and remembers pieces, within a bound; subclasses cut texts and encode new pieces."""

    def __init__(self, limit: int | None = None):
        self.limit = limit or _PIECES_KEPT
        self.number = _Numbers()
        self.ids = np.zeros(1 << 16, np.uint32)
        self.filled = 0
        self.starts, self.lengths, self.uses = (np.zeros(1 << 12, np.int64) for _ in range(3))

    def cut(self, text: str) -> list[str]:
        raise NotImplementedError

    def encode_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids one piece after another, ids of each piece)."""
        raise NotImplementedError

    def _learn(self) -> None:
        pieces, self.number.new = self.number.new, []
        ids, lengths = self.encode_pieces(pieces)
        count = len(self.number)
        first, total = count - len(pieces), self.filled + len(ids)
        self.ids = _room(self.ids, total)
        self.starts, self.lengths, self.uses = (_room(x, count) for x in (self.starts, self.lengths, self.uses))
        self.ids[self.filled : total] = ids
        self.lengths[first:count] = lengths
        self.starts[first:count] = self.filled + np.cumsum(lengths) - lengths
        self.filled = total

    def _forget(self) -> None:
        """Keep the most used half of the room; halve the counts so that old use fades."""
        count = len(self.number)
        often = np.argsort(-self.uses[:count], kind="stable")[: self.limit // 2]
        often = np.sort(often[self.uses[often] > 1])
        room = np.cumsum(self.lengths[often]) <= _IDS_KEPT // 2
        often = often[room]
        lengths = self.lengths[often].copy()
        starts = np.cumsum(lengths) - lengths
        kept = self.ids[np.repeat(self.starts[often] - starts, lengths) + np.arange(int(lengths.sum()))]
        names = list(self.number)
        self.number = _Numbers([names[i] for i in often.tolist()])
        self.ids[: len(kept)], self.filled = kept, len(kept)
        for array, values in ((self.starts, starts), (self.lengths, lengths), (self.uses, self.uses[often] // 2)):
            array[: len(often)] = values
            array[len(often) :] = 0

    def encode(self, texts: list[str], end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids one text after another, and how many each has; ``end`` is put after every text."""
        if len(self.number) > self.limit or self.filled > _IDS_KEPT:
            self._forget()
        pieces = [self.cut(text) if text else [] for text in texts]
        per_text = np.fromiter(map(len, pieces), np.int64, len(pieces))
        flat = np.fromiter(map(self.number.__getitem__, chain.from_iterable(pieces)), np.int64, int(per_text.sum()))
        if self.number.new:
            self._learn()
        self.uses[: len(self.number)] += np.bincount(flat, minlength=len(self.number))
        sizes = self.lengths[flat]
        after = np.cumsum(sizes)
        text_ends = np.concatenate([[0], after])[np.cumsum(per_text)] if len(texts) else np.zeros(0, np.int64)
        ids = self.ids[np.repeat(self.starts[flat] - after + sizes, sizes) + np.arange(int(sizes.sum()))]
        counts = np.diff(text_ends, prepend=0)
        if end is not None:
            ids = np.insert(ids, text_ends, end)
            counts = counts + 1
        return ids, counts


class TextEncoder(MemoEncoder):
    """Ids of texts by a tokenizer file of the byte-level kind, special tokens' strings being ordinary text."""

    added = False

    def __init__(self, file: str, limit: int | None = None):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        self.tokenizer.encode_special_tokens = not self.added
        tokens = [t for t in self.tokenizer.get_added_tokens_decoder().values() if self.added or not t.special]
        self.added_texts = [t.content for t in tokens]
        self.holds = _any_of(tokens)
        self.held: set[str] = set()
        self.uncut = _any_of([t for t in tokens if t.lstrip or t.rstrip or re.search(r"\s", t.content)])
        line_break = self._encode(["\n"])[0]
        if len(line_break) != 1:
            raise ValueError("the tokenizer has no single token for a line break")
        self.line_break = line_break[0]
        super().__init__(limit)

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def cut(self, text: str) -> list[str]:
        """Pieces that a space goes before, but for those that ``_LINE`` or ``_FIRST`` starts."""
        if self.uncut and self.uncut.search(text):
            self.held.add(_FIRST + text)
            return [_FIRST + text]
        # only single spaces and line breaks between words: the same words whichever way it is split
        plain = " ".join(text.split()) == text.replace("\n", " ")
        parts = text.replace("\n", " \n").split(" ") if plain else _CUT.split(text)
        parts[0] = _FIRST + parts[0]
        if any(t in text for t in self.added_texts):
            self.held.update(p for p in parts if self.holds.search(p))
        return parts

    def encode_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Pieces with white space inside or an added token are encoded one by one, all others many at a time, one to a line."""
        held, self.held = self.held, set()
        marked = [p[0] in "\n\r" if p else False for p in pieces]
        bare = [p[1:] if m else p for p, m in zip(pieces, marked)]
        lined = np.array([(b.isalnum() or b.split() == [b]) and p not in held for b, p in zip(bare, pieces)], bool)
        spelled = [b if m else " " + b for b, m in zip(bare, marked)]
        # a piece of a line break and a word has the break's id before the word's
        breaks = np.array([p[:1] == _LINE for p in pieces], bool)
        lengths = np.zeros(len(pieces), np.int64)
        found: list[np.ndarray] = []
        places = np.flatnonzero(lined)
        if len(places):
            groups = [places[i : i + _GROUP].tolist() for i in range(0, len(places), _GROUP)]
            ids = self._encode(["\n".join([spelled[i] for i in g]) for g in groups])
            every = np.concatenate([x for line in ids for x in ([self.line_break], line)]).astype(np.uint32)
            at = np.flatnonzero(every == self.line_break)
            if len(at) != len(places):
                raise AssertionError("a piece without line breaks gave the line break's id")
            stays = np.ones(len(every), bool)
            stays[at] = breaks[places]
            lengths[places] = np.diff(at, append=len(every)) - ~breaks[places]
            found.append(every[stays])
        alone = np.flatnonzero(~lined)
        if len(alone):
            ids = self._encode([spelled[i] for i in alone.tolist()])
            ids = [np.insert(x, 0, self.line_break) if breaks[i] else x for i, x in zip(alone.tolist(), ids)]
            lengths[alone] = [len(x) for x in ids]
            found.append(np.concatenate(ids).astype(np.uint32))
        # back into the order of the pieces
        order = np.concatenate([places, alone])
        starts = np.zeros(len(pieces), np.int64)
        starts[order] = np.cumsum(lengths[order]) - lengths[order]
        after = np.cumsum(lengths)
        flat = np.concatenate(found)
        return flat[np.repeat(starts - after + lengths, lengths) + np.arange(len(flat))], lengths


class AddedTextEncoder(TextEncoder):
    """The same with the library's default: an added token's string, special or not, is that token wherever it stands."""

    added = True


def _any_of(tokens: list) -> re.Pattern | None:
    return re.compile("|".join(re.escape(t.content) for t in tokens)) if tokens else None


def _room(array: np.ndarray, size: int) -> np.ndarray:
    if size <= len(array):
        return array
    larger = np.zeros(max(size, 2 * len(array)), array.dtype)
    larger[: len(array)] = array
    return larger


_ENCODERS: dict[tuple[type, str], MemoEncoder] = {}


def encoder(file: str, kind: type = TextEncoder, limit: int | None = None) -> MemoEncoder:
    """One encoder per file and Python worker, so that later tasks know the pieces of earlier ones."""
    if (kind, file) not in _ENCODERS:
        _ENCODERS[kind, file] = kind(file, limit)
    return _ENCODERS[kind, file]
