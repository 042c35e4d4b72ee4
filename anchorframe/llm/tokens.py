"""Token ids of whole texts by a public tokenizer file, with a bounded cache of the pieces between blanks.

A tokenizer's splitting rule never joins what stands on both sides of a single blank, so a text's ids are the
ids of its pieces, one after another. Texts with other white space than single blanks and line ends, where that
does not hold plainly, are encoded in one call. A piece that is one run of Latin letters, with or without a run of
plain marks behind it, goes straight to the tokenizer's merge model, without the splitting that it does not need.
With a byte-level tokenizer many texts are cut and their distinct pieces numbered together, by Arrow.
"""

from __future__ import annotations

import json
import os
import struct
import sys
import unicodedata
from array import array
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# White space other than blank and line feed, as Python or the tokenizers see it.
_ODD = tuple(c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n")
_MARKS = ".,;:!?*%$&#|()-"
_LATIN = "\u0100"  # letters below it have simple case and composition
_CUT = "\x01"  # stands between pieces while texts are cut together
_WHOLE = (*_ODD, _CUT, "  ", "\n ", " \n", "\n\n")  # a text that has one of them is not cut
_TOGETHER = 1 << 21  # characters of the texts cut together
_SHARED: dict[str, PieceEncoder] = {}


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones for themselves."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + n) for n, b in enumerate(rest)}


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids) if sys.byteorder == "big" else array("I", ids).tobytes()


def pieces_of(text: str, blanks: bool) -> list[str]:
    """Pieces whose ids, joined, are the ids of the text. ``blanks``: a piece keeps the blank before it."""
    if any(c in text for c in _ODD):
        return [text]
    if not blanks:
        return text.split()
    out: list[str] = []
    for n, line in enumerate(text.split("\n")):
        words = line.split(" ")
        if "" in words:  # several blanks, or white space at the edge of a line
            return [text]
        if n:
            out.append("\n")
        out.append(words[0])
        out.extend([" " + w for w in words[1:]])
    return out


class PieceEncoder:
    """Encodes texts to little-endian unsigned 32-bit ids; keeps at most ``2 * limit`` pieces in memory."""

    def __init__(self, path: str, limit: int = 500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        self.blanks = said["pre_tokenizer"]["type"] == "ByteLevel"
        self.lower = said["normalizer"] is not None
        self.model, self.letters = self.tokenizer.model, byte_letters()
        self.limit = limit
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.runs: dict[str, bytes] = {}

    @classmethod
    def shared(cls, path: str) -> PieceEncoder:
        """One encoder for each worker process."""
        if path not in _SHARED:
            _SHARED[path] = cls(path)
        return _SHARED[path]

    def forget(self) -> None:
        """Gives up the memory of all pieces seen."""
        self.new, self.old, self.runs = {}, {}, {}

    def whole(self, text: str) -> bytes:
        return _packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _merged(self, run: str) -> bytes:
        """The ids of a run by the merge model."""
        # Only a run's first character can be a blank, all others of an ASCII run stand for themselves.
        spelt = run.replace(" ", self.letters[32]) if run.isascii() else "".join(map(self.letters.__getitem__, run.encode()))
        return _packed([t.id for t in self.model.tokenize(spelt)])

    def _run(self, run: str) -> bytes:
        known = self.runs.get(run)
        if known is None:
            if len(self.runs) > self.limit:
                self.runs = {}
            known = self.runs[run] = self._merged(run)
        return known

    def _piece(self, piece: str) -> bytes:
        body = piece.rstrip(_MARKS)
        word = body[1:] if body[:1] == " " else body
        plain = word.isascii()
        if not word.isalpha() or not plain and max(word) >= _LATIN:
            return self.whole(piece)
        marks = piece[len(body):]
        if self.lower:
            body = body.lower() if plain else "".join([c.lower() for c in unicodedata.normalize("NFC", body)])
        elif not marks:
            return self._merged(body)  # kept as a piece
        elif body in self.new:
            return self.new[body] + self._run(marks)
        return self._run(body) + (self._run(marks) if marks else b"")

    def _known(self, pieces: list[str]) -> list[bytes]:
        """The ids of each of the pieces, which are distinct."""
        if len(self.new) > self.limit:
            self.new, self.old = {}, self.new
        new, old = self.new, self.old
        known = list(map(new.get, pieces))
        for n, ids in enumerate(known):
            if ids is None:
                p = pieces[n]
                known[n] = new[p] = old.get(p) or self._piece(p)
        return known

    def _together(self, texts: list[str]) -> list[bytes]:
        """The ids of texts that can be cut at each blank and line feed."""
        marked = pc.replace_substring(pa.array(texts, pa.large_string()), "\n", f"{_CUT}\n{_CUT}")
        pieces = pc.split_pattern(pc.replace_substring(marked, " ", f"{_CUT} "), _CUT)
        coded = pieces.values.dictionary_encode()
        known = self._known(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        size = np.fromiter(map(len, known), np.int64, len(known)) // 4
        first, at = np.cumsum(size) - size, coded.indices.to_numpy()
        own = size[at]
        ends = np.concatenate([[0], np.cumsum(own)])
        place = np.arange(ends[-1])
        place += np.repeat(first[at] - ends[:-1], own)
        ids, bounds = np.frombuffer(b"".join(known), "<u4").take(place), ends[pieces.offsets.to_numpy()].tolist()
        return [ids[low:high].tobytes() for low, high in zip(bounds, bounds[1:])]

    def _grouped(self, texts: Iterable[str | None]) -> Iterable[bytes]:
        """``encode`` by groups of texts."""
        def ready():
            each = iter(self._together(cut) if cut else [])
            return [next(each) if known is None else known for known in held]

        held, cut, chars = [], [], 0  # ids of each text of the group, None for those to cut; these
        for text in texts:
            if not text:
                held.append(b"")
            elif not (" " in text or "\n" in text) or text[0] in " \n" or text[-1] in " \n" or any(c in text for c in _WHOLE):
                held.append(self.whole(text))
            else:
                held.append(None)
                cut.append(text)
            chars += len(text or "")
            if chars >= _TOGETHER:
                yield from ready()
                held, cut, chars = [], [], 0
        yield from ready()

    def encode(self, texts: Iterable[str | None]) -> Iterable[bytes]:
        """The ids of each text, in order; null is the empty text."""
        if self.blanks:
            yield from self._grouped(texts)
            return
        for text in texts:
            if not text:
                yield b""
                continue
            pieces = pieces_of(text, self.blanks)
            if len(pieces) == 1:  # may be long, so not kept
                yield self.whole(text)
                continue
            if len(self.new) > self.limit:
                self.new, self.old = {}, self.new
            for p in set(pieces).difference(self.new):
                self.new[p] = self.old.get(p) or self._piece(p)
            yield b"".join(map(self.new.__getitem__, pieces))
