"""Hierarchical multi-length packing of token ids into context windows.

Every document is routed by its length to the smallest window size (tier) that holds it; longer documents fill whole
largest windows first. Each tier is packed from its longest document down, and the room left in a window is filled
from the shorter tiers: the longest remaining document that fits, again and again, then, where none fits, the head of
the longest one. So every window is full, and a document is cut only where no whole one fits. The few ids left at the
end of a partition go into windows of smaller powers of two, which need no padding either.

Each partition packs its own documents in rounds of bounded size, so nothing is shuffled and no task holds more than
a round of ids beside its longest document. Sequences of a tier are dealt in equal shares to step groups that hold at
most ``step_tokens`` ids each.

Nulls: a null text is an empty one (its ids are the end id alone); a null id is carried through. Repeated rows are
packed each for itself. An empty table gives an empty result. Only the two named columns are read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anchorframe.llm.tokens import PieceEncoder

TIERS = (512, 1024, 2048, 4096)
_SHIFT = 1 << 33  # partition number before it, counter behind it
SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
          "tier int, step_group long")


class Packer:
    """Fills windows from segments ``(length, order, document, start)``, kept by length."""

    def __init__(self, tiers: Iterable[int] = TIERS):
        self.tiers = sorted(tiers)
        self.rest: list[tuple[int, int, int, int]] = []
        self.total = 0
        self._order = 0

    def add(self, document: int, start: int, length: int) -> None:
        self._order += 1
        insort(self.rest, (length, self._order, document, start))
        self.total += length

    def _take(self, at: int, room: int) -> tuple[int, int, int]:
        """The segment at ``at``, or its head where it is longer than the room."""
        length, _, document, start = self.rest.pop(at)
        self.total -= length
        if length > room:
            self.add(document, start + room, length - room)
        return document, start, min(length, room)

    def _window(self, size: int) -> list[tuple[int, int, int]]:
        pieces, room = [self._take(-1, size)], size
        room -= pieces[0][2]
        while room:
            at = bisect_right(self.rest, (room, self._order + 1, 0, 0)) - 1
            pieces.append(self._take(at, room))  # at is -1, the longest, where no whole one fits
            room -= pieces[-1][2]
        return pieces

    def windows(self, last: bool) -> Iterator[tuple[int, list[tuple[int, int, int]]]]:
        """(size, pieces) of full windows. What cannot fill its tier stays for the next call unless ``last``."""
        while self.total:
            longest = self.rest[-1][0]
            size = next((t for t in self.tiers if t >= longest), self.tiers[-1])
            if size > self.total:
                if not last:
                    return
                size = 1 << (self.total.bit_length() - 1)
            yield size, self._window(size)


def _rows(packer: Packer, held: dict, last: bool, ids: Iterator[int], groups: Iterator[int], step_tokens: int):
    """One row per piece of the windows that are full now."""
    full: dict[int, list] = {}
    for size, pieces in packer.windows(last):
        full.setdefault(size, []).append(pieces)
    for size, windows in full.items():
        steps = -(-len(windows) * size // max(step_tokens, size))
        names = [next(groups) for _ in range(steps)]
        for n, pieces in enumerate(windows):
            sequence, offset = next(ids), 0
            for document, start, length in pieces:
                doc_id, packed = held[document]
                crc = zlib.crc32(memoryview(packed)[4 * start:4 * (start + length)])
                yield doc_id, start, length, crc, len(packed) // 4, sequence, offset, size, names[n * steps // len(windows)]
                offset += length


def _counter(partition: int) -> Iterator[int]:
    n = partition * _SHIFT
    while True:
        yield n
        n += 1


def pack(docs: DataFrame, tokenizer: str, end_id: int, tiers: Iterable[int] = TIERS, round_tokens: int = 2_000_000,
         step_tokens: int = 1 << 18, id_col: str = "doc_id", text_col: str = "text", keep: bool = True) -> DataFrame:
    """Pieces of documents in sequences: each id of each document in exactly one piece.

    Without ``keep`` a worker forgets its encoder's pieces when a task ends, as stages after it may need that memory.
    """
    tiers = tuple(sorted(tiers))
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    kinds = [pa.int32() if f.split()[1] == "int" else pa.int64() for f in SCHEMA.split(", ")]

    def batch(rows):
        columns = list(zip(*rows)) or [[]] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    def run(batches):
        encoder, packer, held, documents = PieceEncoder.shared(tokenizer), Packer(tiers), {}, 0
        end = end_id.to_bytes(4, "little")
        partition = TaskContext.get().partitionId()
        ids, groups = _counter(partition), _counter(partition)
        for got in batches:
            for doc_id, packed in zip(got.column(0).to_pylist(), encoder.encode(got.column(1).to_pylist())):
                packed += end
                held[documents] = doc_id, packed
                whole = len(packed) // 4 // tiers[-1] * tiers[-1]
                for start in range(0, whole, tiers[-1]):
                    packer.add(documents, start, tiers[-1])
                if whole < len(packed) // 4:
                    packer.add(documents, whole, len(packed) // 4 - whole)
                documents += 1
                if packer.total >= round_tokens:
                    yield batch(_rows(packer, held, False, ids, groups, step_tokens))
                    held = {d: held[d] for d in {s[2] for s in packer.rest}}
        if packer.total:
            yield batch(_rows(packer, held, True, ids, groups, step_tokens))
        if not keep:
            encoder.forget()

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, SCHEMA)
