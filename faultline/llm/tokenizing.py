"""Token ids of whole texts by the libraries of public tokenizers, every distinct piece encoded once per worker.

A text is cut into pieces only where no token can lie across, so that the pieces' ids are the text's: for byte-level
vocabularies before white space that follows something else, for sentence pieces before a space that follows something
else and before a line feed. Pieces repeat, whole texts rarely do. Where the cut could be wrong (unusual spaces, a
vocabulary with pieces across words) the library gets the whole text.
"""

from __future__ import annotations

import os
import re
import sys
from array import array
from collections.abc import Iterable
from functools import lru_cache
from itertools import compress, count, pairwise, repeat
from operator import is_

import numpy as np

MOST_PIECES = 1_000_000
JOINED = 512  # new pieces given to the library in one text

_BYTE_PIECES = re.compile("[ \t-\r]*[^ \t-\r]+|[ \t-\r]+")
#: Code points that some library or other takes for white space or for nothing, without space and \t to \r.
_UNUSUAL = re.compile("[\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f\u2060\u3000\ufeff]")
_SENTENCE_PIECES = re.compile("\n[^ \n]*| +[^ \n]*")
_BYTE_PIECE = re.compile("<0x[0-9A-F]{2}>")


_SPACES = frozenset(" \t\n\r\x0b\x0c")
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
_PLAIN = frozenset("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")


def _packed(ids: Iterable[int]) -> bytes:
    out = array("I", ids)
    return out.tobytes() if sys.byteorder == "little" else np.array(out, "<u4").tobytes()


def _byte_alphabet() -> dict[str, int]:
    """Character of each byte in byte-level vocabularies: printable ones stand for themselves, the others for the code
    points from 256 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class _Pieces:
    """Ids by piece, as little-endian unsigned 32-bit numbers, and how to cut texts."""

    def __init__(self, most: int):
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}  # the store that was full before this one
        self.most = most

    def describe(self, entries: list[bytes]) -> None:
        """Bytes that each id stands for."""
        self.lengths = np.array([len(b) for b in entries])
        self.places = np.cumsum(self.lengths) - self.lengths
        self.blob = np.frombuffer(b"".join(entries), np.uint8)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Two stores of half of ``most`` pieces each: a full one gives way to a new one, into which go the pieces that
        come again, as most come once only."""
        cut = [self.cut(t) for t in texts]
        if len(self.known) > self.most // 2:
            self.before, self.known = self.known, {}
        get = self.known.get
        found = [None if c is None else list(map(get, c)) for c in cut]
        gaps = [() if f is None else [*compress(count(), map(is_, f, repeat(None)))] for f in found]
        if new := self.unknown(dict.fromkeys(c[i] for c, places in zip(cut, gaps) for i in places)):
            self.learn(new)
        for f, c, places in zip(found, cut, gaps):
            for i in places:
                f[i] = self.known[c[i]]
        return [self.whole(t) if f is None else b"".join(f) for t, f in zip(texts, found)]

    def unknown(self, pieces: Iterable[str]) -> list[str]:
        """Of pieces that the store lacks, those that the one before lacks too; the others are taken over."""
        again = {p: self.before[p] for p in pieces if p in self.before} if self.before else {}
        self.known.update(again)
        return [p for p in pieces if p not in again]

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """Bytes of all ids, one after the other."""
        size = self.lengths[ids]
        ends = np.cumsum(size)
        return self.blob[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.places[ids] - ends + size, size)]


class ByteLevel(_Pieces):
    """A byte-level vocabulary of the tokenizers library; strings of special tokens are plain text."""

    def __init__(self, path: str, most: int):
        super().__init__(most)
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = True
        size = self.model.get_vocab_size()
        alphabet = _byte_alphabet()
        entries = [self.model.id_to_token(i) or "" for i in range(size)]
        special = set(self.model.get_added_tokens_decoder())
        self.describe([e.encode() if i in special else bytes(alphabet[c] for c in e) for i, e in enumerate(entries)])

    def cut(self, text: str) -> list[str] | None:
        if not text.isascii() and _UNUSUAL.search(text) or text.isascii() and any(c in text for c in "\x1c\x1d\x1e\x1f"):
            return None
        return _BYTE_PIECES.findall(text)

    def learn(self, pieces: list[str]) -> None:
        """Marks behind a letter or digit are tokens of their own, so words with and without them are encoded once. Pieces
        that begin with white space and end without stand one after the other in one text for the library; the lengths
        of the tokens tell them apart."""
        parts, wanted = {}, {}  # in order of text, as neighbours in memory are read faster
        for p in pieces:
            if p[-1] in _MARKS:
                core = p.rstrip(_MARKS)
                if core[-1:] in _PLAIN:
                    marks = p[len(core) :]
                    parts[p] = core, marks
                    wanted[core] = wanted[marks] = None
                    continue
            wanted[p] = None
        chained, alone = [], []
        for p in self.unknown([p for p in wanted if p not in self.known]):
            (chained if p[0] in _SPACES and p[-1] not in _SPACES else alone).append(p)
        joined = [chained[i : i + JOINED] for i in range(0, len(chained), JOINED)]
        for own, e in zip(joined, self.model.encode_batch_fast(["".join(x) for x in joined], add_special_tokens=False)):
            ids = np.array(e.ids, "<u4")
            ends = np.cumsum([len(p) if p.isascii() else len(p.encode()) for p in own])
            cut = (4 * np.searchsorted(np.cumsum(self.lengths[ids]), ends, "right")).tolist()
            data = ids.tobytes()
            self.known.update(zip(own, [data[i:j] for i, j in pairwise([0, *cut])]))
        for p, e in zip(alone, self.model.encode_batch_fast(alone, add_special_tokens=False)):
            self.known[p] = _packed(e.ids)
        for p, (core, marks) in parts.items():
            self.known[p] = self.known[core] + self.known[marks]

    def whole(self, text: str) -> bytes:
        return _packed(self.model.encode(text, add_special_tokens=False).ids)


class SentencePieces(_Pieces):
    """A sentence-piece model that puts a space before the text. ``cut`` takes the text with that space."""

    def __init__(self, path: str, most: int):
        super().__init__(most)
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.describe([bytes([int(n[3:5], 16)]) if _BYTE_PIECE.fullmatch(n) else n.replace("▁", " ").encode() for n in names])
        self.apart = not any("▁" in n.lstrip("▁") or "\n" in n for n in names)
        self.space = self.model.piece_to_id("▁")
        self.apart &= _packed(self.model.encode(" \n a")) == _packed([*self.model.encode(" "), *self.model.encode("\n")[1:], *self.model.encode("a")])

    def cut(self, text: str) -> list[str] | None:
        """``text`` begins with the space that the model adds; to an empty text it adds none."""
        if text == " ":
            return []
        return _SENTENCE_PIECES.findall(text) if self.apart else None

    def learn(self, pieces: list[str]) -> None:
        ids = self.model.encode([p[1:] if p[0] == " " else p for p in pieces], num_threads=1)
        for p, i in zip(pieces, ids):
            self.known[p] = _packed([self.space] if p == " " else i if p[0] == " " else i[1:])

    def whole(self, text: str) -> bytes:
        return _packed(self.model.encode(text[1:]))


@lru_cache(maxsize=4)
def byte_level(path: str, most: int = MOST_PIECES) -> ByteLevel:
    """One per worker, vocabulary file and number of pieces to keep."""
    return ByteLevel(path, most)


@lru_cache(maxsize=4)
def sentence_pieces(path: str, most: int = MOST_PIECES) -> SentencePieces:
    return SentencePieces(path, most)
