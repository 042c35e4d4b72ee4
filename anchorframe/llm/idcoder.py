"""Adaptive context-mixing range coder for token ids, in independent blocks.

A block starts from an empty model and carries a checksum, so it can be read alone. Its ids are cut into equally long
lanes that are coded in step: one numpy operation moves every lane by one id, and all lanes feed one shared model.

The model mixes three predictions of the next id: order 2 and order 1 each name one id that followed the same context
before, with a confidence; order 0 is the adaptive frequency of every id. The chance of an id is

    weight2 * [id == guess2] + weight1 * [id == guess1] + weight0 * frequency(id)

where a guess's weight is how often guesses of its confidence have been right so far in the block. All arithmetic is on
whole numbers, so the decoder repeats it exactly. The range coder has 48-bit intervals and writes 16-bit digits.

``write`` puts blocks of documents in ascending id order into a folder, one shard for each partition; ``read`` decodes
them and gives each document's place, length and checksum. Null texts are empty, null ids sort first, repeated rows
are documents of their own, an empty table gives an empty folder and an empty result.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from anchorframe.llm.tokens import PieceEncoder
from anchorframe.session import shared_folder

_MAGIC = b"CMR1"
_HEAD = "<4sIIII"  # magic, ids, lanes, size of the vocabulary, crc32 of the ids
_TOTAL = 24  # bits of a mixed distribution
_BASE = 21  # bits of the order-0 distribution
_SLOTS = 18  # bits of the order-2 table
_CELL = 5  # bits of the cells of the order-0 distribution in which an id is searched
_EVERY = 16  # steps between two refreshes of the order-0 table
_LANES = 4096
_SMALL = 1 << 32  # intervals below this give up a digit
BLOCK_SCHEMA = "shard int, block int, start long, ids long, payload binary"
PIECE_SCHEMA = "shard int, doc_start long, doc_id long, doc_tokens long, crc long"


class _Guesses:
    """One guess and its confidence (0 to 7) for each context; a table entry is eight times the guess, plus the confidence."""

    def __init__(self, slots: int):
        self.table = np.zeros(slots, np.int32)
        self.right = np.ones(8, np.int64)
        self.tried = np.full(8, 2, np.int64)
        self.chance = np.zeros(8, np.int64)

    def look(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Guess, confidence, and the chance in 65536ths that it is right."""
        entry = self.table.take(at).astype(np.int64)
        sure = entry & 7
        return entry >> 3, sure, self.chance.take(sure)

    def learn(self, at: np.ndarray, guess: np.ndarray, sure: np.ndarray, ids: np.ndarray, count: bool) -> None:
        hit = guess == ids
        if count:
            self.tried += np.bincount(sure, minlength=8)
            self.right += np.bincount(sure[hit], minlength=8)
            self.chance = (self.right << 16) // self.tried
            self.chance[0] = 0
        # A guess that was right is the id itself, so only the confidence decides.
        self.table[at] = (np.where(sure > 1, guess, ids) << 3) + _NEXT.take(sure + (hit.view(np.int8) << 3))


# The confidence that follows each one: after a miss (0 to 7), after a hit.
_NEXT = np.array([1, 1, 1, 1, 2, 2, 3, 3, 1, 2, 3, 4, 5, 6, 7, 7])


class _Model:
    def __init__(self, size: int, lanes: int):
        self.size = size
        self.count = np.ones(size, np.int64)
        self.one, self.two = _Guesses(1 << 16), _Guesses(1 << _SLOTS)
        self.last, self.before = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
        self.steps, self.seen = 0, []

    def _refresh(self) -> None:
        if self.seen:
            self.count += 24 * np.bincount(np.concatenate(self.seen), minlength=self.size)
            self.seen = []
        grown = np.concatenate([[0], np.cumsum(self.count)])
        self.base = grown * ((1 << _BASE) - self.size) // grown[-1] + np.arange(self.size + 1)
        self.next, self.near = self.base[1:], None

    def begin(self, active: int) -> None:
        """Look up what the models say about the next id of each active lane."""
        if self.steps % _EVERY == 0:
            self._refresh()
        last, before = self.last[:active], self.before[:active]
        self.at1 = last & 0xFFFF
        self.at2 = ((last * 0x9E3779B1 + before * 0x85EBCA77) >> 9) & ((1 << _SLOTS) - 1)
        self.guess1, self.sure1, chance1 = self.one.look(self.at1)
        self.guess2, self.sure2, chance2 = self.two.look(self.at2)
        self.w2 = chance2 * 160
        self.w1 = (chance1 * ((7 << (_TOTAL - 3)) - self.w2)) >> 16
        self.w0 = (1 << _TOTAL) - self.w1 - self.w2

    def _own(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the order-0 shares of ``ids`` begin and end, other weights left out."""
        return (self.base.take(ids) * self.w0) >> _BASE, (self.next.take(ids) * self.w0) >> _BASE

    def share(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the share of each of ``ids`` begins, and its size."""
        begin, end = self._own(ids)
        return (begin + self.w2 * (self.guess2 < ids) + self.w1 * (self.guess1 < ids),
                end - begin + self.w2 * (self.guess2 == ids) + self.w1 * (self.guess1 == ids))

    def _search(self, goal: np.ndarray) -> np.ndarray:
        """The id whose order-0 share holds each value."""
        if self.near is None:  # for the first value of each cell the last id that begins at or below it
            self.near = np.cumsum(np.bincount((self.base + (1 << _CELL) - 1) >> _CELL, minlength=(1 << (_BASE - _CELL)) + 1), dtype=np.int32) - 1
        found = self.near.take(goal >> _CELL).astype(np.int64)
        late = np.flatnonzero(self.next.take(found) <= goal)
        while len(late):
            more = found.take(late) + 1
            found[late] = more
            late = late[self.next.take(more) <= goal.take(late)]
        return found

    def find(self, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The id whose share of the distribution holds each value, where that begins, and its size."""
        begin2, end2 = self._own(self.guess2)
        begin1, end1 = self._own(self.guess1)
        first, last = self.guess1 < self.guess2, self.guess1 > self.guess2
        begin2 += self.w1 * first
        end2 += self.w2 + self.w1 * ~last
        begin1 += self.w2 * last
        end1 += self.w1 + self.w2 * ~first
        over2, over1 = value >= end2, value >= end1
        in2 = ~over2 & (value >= begin2)
        in1 = ~over1 & (value >= begin1)
        ids = np.where(in2, self.guess2, self.guess1)
        begin, end = np.where(in2, begin2, begin1), np.where(in2, end2, end1)
        rest = np.flatnonzero(~(in2 | in1))
        if len(rest):
            added = (self.w2 * over2 + self.w1 * over1).take(rest)
            weight = self.w0.take(rest)
            found = self._search(_quotient(((value.take(rest) - added + 1) << _BASE) - 1, weight))
            ids[rest] = found
            begin[rest] = ((self.base.take(found) * weight) >> _BASE) + added
            end[rest] = ((self.next.take(found) * weight) >> _BASE) + added
        return ids, begin, end - begin

    def end(self, ids: np.ndarray) -> None:
        count = self.steps % 4 == 0
        self.one.learn(self.at1, self.guess1, self.sure1, ids, count)
        self.two.learn(self.at2, self.guess2, self.sure2, ids, count)
        self.seen.append(ids)
        active = len(ids)
        self.before[:active] = self.last[:active]
        self.last[:active] = ids
        self.steps += 1


def _quotient(number: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Whole quotients of numbers below 2 ** 48, for which floating point division never rounds up to the next whole number."""
    return (number / by).astype(np.int64)


def _shape(n: int) -> tuple[int, int]:
    """Lanes and steps of a block of n ids."""
    steps = max(1, min(n, max(256, -(-n // _LANES))))
    return -(-n // steps), steps


def encode_block(ids: np.ndarray, size: int) -> bytes:
    """One block; ``ids`` are below ``size``, which is at most 65536."""
    n = len(ids)
    lanes, steps = _shape(n)
    head = struct.pack(_HEAD, _MAGIC, n, lanes, size, zlib.crc32(ids.astype("<u4").tobytes()))
    if not n:
        return head
    grid = np.zeros(lanes * steps, np.int64)
    grid[:n] = ids
    grid = np.ascontiguousarray(grid.reshape(lanes, steps).T)
    model, low, width = _Model(size, lanes), np.zeros(lanes, np.int64), np.full(lanes, 1 << 48)
    given = []  # lanes and the digits they gave up, which may have a carry

    def shift(at):
        now = low.take(at)
        given.append((at.astype(np.uint16), (now >> 32).astype(np.uint32)))
        low[at] = (now & 0xFFFFFFFF) << 16

    for step in range(steps):
        active = -(-(n - step) // steps)
        now = grid[step, :active]
        model.begin(active)
        begin, size_of = model.share(now)
        part = width[:active] >> _TOTAL
        low[:active] += part * begin
        part *= size_of
        small = np.flatnonzero(part < _SMALL)
        width[:active] = part
        while len(small):
            shift(small)
            wide = width.take(small) << 16
            width[small] = wide
            small = small[wide < _SMALL]
        model.end(now)
    for _ in range(3):
        shift(np.arange(lanes))
    lane, digits = (np.concatenate(x) for x in zip(*given))
    digits = digits.take(np.argsort(lane, kind="stable"))
    while len(over := np.flatnonzero(digits >> 16)):  # carries, never out of a lane's first digit
        digits[over] &= 0xFFFF
        digits[over - 1] += 1
    return head + np.bincount(lane, minlength=lanes).astype("<u4").tobytes() + digits.astype("<u2").tobytes()


def decode_block(data: bytes) -> np.ndarray:
    """The ids of a block; raises ValueError where they don't have its checksum."""
    magic, n, lanes, size, crc = struct.unpack_from(_HEAD, data)
    if magic != _MAGIC or (lanes, 1) != (_shape(n)[0], 1):
        raise ValueError("not a block of this format")
    ids = np.zeros(0, "<u4")
    if n:
        steps = _shape(n)[1]
        at = struct.calcsize(_HEAD)
        used = np.frombuffer(data, "<u4", lanes, at).astype(np.int64)
        digits = np.concatenate([np.frombuffer(data, "<u2", offset=at + 4 * lanes), np.zeros(4, "<u2")]).astype(np.int64)
        place = np.concatenate([[0], np.cumsum(used)[:-1]])
        model, width = _Model(size, lanes), np.full(lanes, 1 << 48)
        value = (digits[place] << 32) | (digits[place + 1] << 16) | digits[place + 2]
        place += 3
        grid = np.zeros((steps, lanes), np.int64)
        for step in range(steps):
            active = -(-(n - step) // steps)
            model.begin(active)
            part = width[:active] >> _TOTAL
            now, begin, size_of = model.find(np.minimum(_quotient(value[:active], part), (1 << _TOTAL) - 1))
            value[:active] -= part * begin
            part *= size_of
            small = np.flatnonzero(part < _SMALL)
            width[:active] = part
            while len(small):
                # The mask is for damaged blocks, whose values may lie outside their intervals.
                value[small] = ((value.take(small) << 16) & 0xFFFFFFFFFFFF) | digits.take(place.take(small), mode="clip")
                place[small] += 1
                wide = width.take(small) << 16
                width[small] = wide
                small = small[wide < _SMALL]
            grid[step, :active] = now
            model.end(now)
        ids = grid.T.reshape(-1)[:n].astype("<u4")
    if zlib.crc32(ids.tobytes()) != crc:
        raise ValueError("checksum of the block does not match")
    return ids


def join_crc(first: int, second: int, length: int) -> int:
    """crc32 of two strings, one after another, from their own and the second's length in bytes."""
    def times(matrix, vector):
        total, n = 0, 0
        while vector:
            if vector & 1:
                total ^= matrix[n]
            vector >>= 1
            n += 1
        return total

    matrix = [0xEDB88320] + [1 << n for n in range(31)]  # one zero bit
    for _ in range(3):
        matrix = [times(matrix, row) for row in matrix]
    while length:
        if length & 1:
            first = times(matrix, first)
        matrix = [times(matrix, row) for row in matrix]
        length >>= 1
    return first ^ second


def _pack(parts: list[tuple], size: int) -> bytes:
    """Index of the documents' pieces, then the block. parts: (doc id or None, start of the piece, length of the document, ids)."""
    index = np.array([(p[0] is None, p[0] or 0, p[1], p[2], len(p[3]) // 4) for p in parts], np.int64).reshape(-1, 5)
    packed = zlib.compress(np.ascontiguousarray(index.T).astype("<i8").tobytes(), 1)
    return struct.pack("<II", len(parts), len(packed)) + packed + encode_block(np.frombuffer(b"".join(p[3] for p in parts), "<u4"), size)


def _unpack(payload: bytes) -> Iterator[tuple]:
    n, length = struct.unpack_from("<II", payload)
    index = np.frombuffer(zlib.decompress(payload[8:8 + length]), "<i8").reshape(5, n).T.tolist()
    ids, at = memoryview(decode_block(payload[8 + length:]).tobytes()), 0
    for null, doc_id, start, total, own in index:
        yield None if null else doc_id, start, total, own, ids[4 * at:4 * (at + own)]
        at += own


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int, size: int, block_ids: int = 1 << 21, id_col: str = "doc_id",
          text_col: str = "text") -> None:
    """Encode whole texts, ``end_id`` after each, to blocks of about ``block_ids`` ids. Longer documents span several."""
    def run(batches):
        encoder, end, shard = PieceEncoder.shared(tokenizer), end_id.to_bytes(4, "little"), TaskContext.get().partitionId()
        parts, held, start, block = [], 0, 0, 0

        def full():
            nonlocal parts, held, start, block
            row = [[shard], [block], [start], [held], [_pack(parts, size)]]
            parts, held, start, block = [], 0, start + held, block + 1
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(row, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()))],
                                              names=["shard", "block", "start", "ids", "payload"])

        for got in batches:
            for doc_id, packed in zip(got.column(0).to_pylist(), encoder.encode(got.column(1).to_pylist())):
                packed += end
                for at in range(0, len(packed), 4 * block_ids):
                    parts.append((doc_id, at // 4, len(packed) // 4, packed[at:at + 4 * block_ids]))
                    held += len(parts[-1][3]) // 4
                    if held >= block_ids:
                        yield full()
        if parts:
            yield full()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    blocks = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id").mapInArrow(run, BLOCK_SCHEMA)
    blocks.write.option("compression", "none").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the blocks alone."""
    def run(batches):
        for got in batches:
            for shard, start, payload in zip(*(got.column(n).to_pylist() for n in range(3))):
                rows, at = [], start
                for doc_id, first, total, own, ids in _unpack(payload):
                    # Moved by what follows in the document, the parts' checksums add up bit by bit to its own.
                    crc = join_crc(zlib.crc32(ids), 0, 4 * (total - first - own)) if own < total else zlib.crc32(ids)
                    rows.append((shard, at - first, doc_id, total, crc))
                    at += own
                kinds = [pa.int32()] + [pa.int64()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[f.split()[0] for f in PIECE_SCHEMA.split(", ")])

    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(path)
    shards = (blocks.groupBy("shard").agg(F.sum("ids").alias("ids"))
              .select("shard", (F.sum("ids").over(Window.orderBy("shard")) - F.col("ids")).alias("before")))
    pieces = blocks.select("shard", "start", "payload").mapInArrow(run, PIECE_SCHEMA)
    docs = pieces.groupBy("shard", "doc_start", "doc_id", "doc_tokens").agg(F.bit_xor("crc").alias("crc"))
    return docs.join(shards, "shard").select(
        "doc_id", (F.col("before") + F.col("doc_start")).alias("start"), F.col("doc_tokens").alias("n_tokens"), F.col("crc").alias("ids_crc32"))


def round_trip(docs: DataFrame, tokenizer: str, end_id: int, size: int) -> DataFrame:
    """Write the documents' ids to the cluster's shared folder and read them back."""
    path = f"{shared_folder(docs.sparkSession)}/ids/{uuid.uuid4().hex}"
    write(docs, path, tokenizer, end_id, size)
    return read(docs.sparkSession, path)
