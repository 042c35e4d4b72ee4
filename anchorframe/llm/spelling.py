"""Spelling variants of a corpus's words: words one edit apart, and for each rare one the frequent word it stands for.

Words are arranged in a trie by the counts of their letters in sixteen groups, one group after another: a path of the trie is a
frequency vector. An inserted code point adds one to one group, a deleted one takes one away, a replaced one does both (or
neither, within a group), so a depth-first search for a word's neighbours follows equal counts, and counts one higher or lower
while a surplus and a deficit of one each are not spent. Words at the leaves it reaches are compared letter by letter. Each pair is
found from one side only: the search spends on a count one higher first, and of words with equal vectors the smaller one searches.

The trie's first levels are Spark rows: words with equal counts there are one shard, a word is sent to the shards that its budget
can reach (of those that exist), and one task searches a shard's trie for all words sent to it, some at a time. The number of
first levels grows until no shard has more than ``SHARD`` words; what is still larger with all levels is cut into blocks by hash,
each with all words sent to it.

Null and empty texts have no words; null ids count as an empty text in the key of a dropped letter. Rows with one id are texts
of their own. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import product
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from anchorframe.session import materialize

RUN = re.compile("[a-zÀ-ÿ]+")
_OTHER = re.compile("[^A-Za-zÀ-ÿ]")
_SLICE = 1 << 20  # code points of a text whose runs are held at once
_HELD = 200_000  # distinct words counted before they are handed on
# Letter groups, frequent letters alone; what is in none of them is the last group.
GROUPS = ("e", "a", "i", "o", "n", "s", "r", "t", "l", "u", "cd", "mp", "gh", "bfv", "jkqwxyz")
DEPTH = len(GROUPS) + 1
SHARD = 50_000  # words of a shard
_LEAF = 16  # words that are compared at once instead of going deeper
_QUERIES = 1 << 16  # words searched together
_CELLS = 1 << 20  # numbers held in a leaf's comparison
_PAIRS = 1 << 18  # words compared letter by letter together
_WIDE = 32  # code points of words that are compared as rows of a table


def runs(text: str) -> Iterator[list[str]]:
    """The maximal runs of letters, A-Z lower-cased, some at a time."""
    at = 0
    while at < len(text):
        cut = _OTHER.search(text, at + _SLICE) if at + _SLICE < len(text) else None
        end = cut.start() if cut else len(text)
        yield RUN.findall(text[at:end].encode().lower().decode())  # bytes: no letter but A-Z changes
        at = end


def _counted(least: int, every: int):
    """word, n of a task's texts: runs of ``least`` code points or more, one letter dropped where ``every`` divides a run's hash."""
    def run(batches):
        held: Counter = Counter()
        for got in batches:
            for doc_id, text in zip(got.column(0).to_pylist(), got.column(1).to_pylist()):
                start = crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for found in runs(text or ""):
                    for word, n in Counter(found).items():
                        if len(word) >= least:
                            h = crc32(word.encode(), start)
                            if h % every == 0:
                                word = word[:h % len(word)] + word[h % len(word) + 1:]
                            held[word] += n
                    if len(held) > _HELD:
                        yield _words(held, least)
                        held = Counter()
        yield _words(held, least)

    return run


def _words(held: Counter, least: int) -> pa.RecordBatch:
    found = [(w, n) for w, n in held.items() if len(w) >= least]
    return pa.RecordBatch.from_arrays([pa.array([w for w, _ in found], pa.string()), pa.array([n for _, n in found], pa.int64())], names=["word", "n"])


def vocabulary(docs: DataFrame, least: int = 6, times: int = 5, every: int = 199, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, n: words of ``least`` code points or more that occur ``times`` times or more in all texts."""
    rows = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    counted = rows.mapInArrow(_counted(least, every), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= times)


def count_of(group: int) -> Column:
    """How often ``word`` has letters of the group."""
    letters = GROUPS[group] if group < len(GROUPS) else "".join(GROUPS)
    rest = F.length(F.translate("word", letters, ""))
    return F.length("word") - rest if group < len(GROUPS) else rest


def _group_table() -> np.ndarray:
    table = np.full(256, DEPTH - 1, np.int64)
    for n, letters in enumerate(GROUPS):
        table[[ord(c) for c in letters]] = n
    return table


_TABLE = _group_table()


def vectors(words: list[str]) -> np.ndarray:
    """Letter-group counts of words, one row each."""
    data = [w.encode("latin-1") for w in words]
    row = np.repeat(np.arange(len(data)), [len(d) for d in data])
    group = _TABLE[np.frombuffer(b"".join(data), np.uint8)]
    return np.bincount(row * DEPTH + group, minlength=len(data) * DEPTH).reshape(len(data), DEPTH).astype(np.int32)


def one_edit(a: str, b: str) -> bool:
    """Whether exactly one inserted, deleted or replaced code point makes ``b`` of ``a``."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    at = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[at + (len(a) == len(b)):] == b[at + 1:]


def _letters(words: list[str]) -> np.ndarray:
    """The first code points of words, filled with zeros."""
    return np.frombuffer(b"".join([w[:_WIDE].encode("latin-1").ljust(_WIDE, b"\0") for w in words]), np.uint8).reshape(len(words), _WIDE)


def edits(short: np.ndarray, long: np.ndarray, longer: np.ndarray) -> np.ndarray:
    """:func:`one_edit` of rows of ``_letters``; ``longer``: whether the second word has one code point more (else as many)."""
    out = np.empty(len(short), bool)
    same = ~longer
    out[same] = (short[same] != long[same]).sum(1) == 1
    a, b = short[longer], long[longer]
    differ = a != b
    first = np.where(differ.any(1), differ.argmax(1), _WIDE)
    behind = a[:, :-1] != b[:, 1:]
    out[longer] = ~(behind & (np.arange(_WIDE - 1) >= first[:, None])).any(1)
    return out


class Trie:
    """Words in the order of their vectors; a node is a depth and a range of them."""

    def __init__(self, words: list[str], weights: list[int]):
        vector = vectors(words)
        order = np.lexsort(vector.T[::-1])
        self.words, self.weights, self.vector = [words[i] for i in order], [weights[i] for i in order], vector[order]
        self.letters, self.size = _letters(self.words), np.array([len(w) for w in self.words])

    def near(self, queries: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, word) places of words one edit apart, of which the word has the first count that is higher, or equal counts and the later name."""
        asked, letters, size = vectors(queries), _letters(queries), np.array([len(q) for q in queries])
        held, n = [], 0
        for own, words in self._candidates(asked):
            held.append((own, words))
            n += len(own)
            if n >= _PAIRS:
                yield self._sure(queries, asked, letters, size, held)
                held, n = [], 0
        if held:
            yield self._sure(queries, asked, letters, size, held)

    def _sure(self, queries, asked, letters, size, held) -> tuple[np.ndarray, np.ndarray]:
        """Of pairs with equal or next vectors those that are one edit apart."""
        own, words = (np.concatenate(x) for x in zip(*held))
        sure = edits(letters[own], self.letters[words], self.size[words] > size[own])
        for k in np.flatnonzero(np.maximum(size[own], self.size[words]) > _WIDE):
            sure[k] = one_edit(queries[own[k]], self.words[words[k]])
        own, words = own[sure], words[sure]
        first = (asked[own] != self.vector[words]).any(1)
        for k in np.flatnonzero(~first):
            first[k] = queries[own[k]] < self.words[words[k]]
        return own[first], words[first]

    def _candidates(self, asked: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        every = np.arange(len(asked))
        nodes = [(0, 0, len(self.words), every, np.zeros(len(every), np.int32), np.zeros(len(every), np.int32))]
        while nodes:  # depth first
            depth, low, high, alive, surplus, deficit = nodes.pop()
            if depth == DEPTH or high - low <= _LEAF:
                yield from self._leaf(asked, depth, low, high, alive, surplus, deficit)
                continue
            column = self.vector[low:high, depth]
            first = np.flatnonzero(np.concatenate([[True], column[1:] != column[:-1]]))
            for start, end in zip(first, [*first[1:], high - low]):
                more = column[start] - asked[alive, depth]
                up, down = surplus + np.maximum(more, 0), deficit + np.maximum(-more, 0)
                own = (up <= 1) & (down <= up)
                if own.any():
                    nodes.append((depth + 1, low + start, low + end, alive[own], up[own], down[own]))

    def _leaf(self, asked, depth, low, high, alive, surplus, deficit):
        step = max(1, _CELLS // (min(high - low, _QUERIES) * max(1, DEPTH - depth)))
        for top in range(low, high, _QUERIES):
            words = self.vector[top:min(high, top + _QUERIES), depth:]
            for at in range(0, len(alive), step):
                own = alive[at:at + step]
                more = words[None] - asked[own][:, None, depth:]
                up, down = (x[at:at + step, None] for x in (surplus, deficit))
                fits = (up + np.maximum(more, 0).sum(2) <= 1) & (down + np.maximum(-more, 0).sum(2) <= 1)
                i, j = np.nonzero(fits)
                if len(i) and depth < DEPTH:  # the first change must be a surplus
                    good = ((up - down)[i, 0][:, None] + np.cumsum(more[i, j], axis=1) >= 0).all(1)
                    i, j = i[good], j[good]
                if len(i):
                    yield own[i], top + j


def _searched(batches):
    """Rows (shard, block, asks, word, n) in that order, a shard's own words before those sent to it: word, near, near_n."""
    name, words, trie, asked = None, [], None, []

    def found(trie: Trie, asked: list[tuple[str, int]]):
        for own, words in trie.near([w for w, _ in asked]):
            pairs = [(*asked[i], trie.words[j], trie.weights[j]) for i, j in zip(own, words)]
            both = [*((a, b, m) for a, _, b, m in pairs), *((b, a, n) for a, n, b, _ in pairs)]
            yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in both], k) for c, k in enumerate((pa.string(), pa.string(), pa.int64()))], names=["word", "near", "near_n"])

    for got in batches:
        for shard, block, asks, word, n in zip(*(c.to_pylist() for c in got.columns)):
            if (shard, block) != name or len(asked) >= _QUERIES:
                if asked:
                    yield from found(trie, asked)
                asked = []
                if (shard, block) != name:
                    name, words, trie = (shard, block), [], None
            if not asks:
                words.append((word, n))
                continue
            if trie is None:
                trie = Trie([w for w, _ in words], [m for _, m in words])
            asked.append((word, n))
    if asked:
        yield from found(trie, asked)


def budgets(depth: int) -> list[tuple[int, ...]]:
    """Changes of the first ``depth`` counts with one surplus and one deficit at most, the surplus first."""
    changes = {(0,) * depth}
    for up, down in product(range(depth + 1), repeat=2):
        change = [0] * (depth + 2)
        change[up] += 1  # the place behind the counts stands for a surplus spent nowhere here
        change[down if down < depth else depth + 1] -= 1
        changes.add(tuple(change[:depth]))
    return sorted(c for c in changes if next((x for x in c if x), 1) > 0)


def near_words(words: DataFrame, shard_words: int = SHARD, first_depth: int = 2) -> DataFrame:
    """(word, near, near_n) of all ordered pairs of words (word, n) one edit apart."""
    parts = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    depth = first_depth
    while True:
        pathed = words.withColumn("path", F.array(*[count_of(g) for g in range(depth)]))
        shards = materialize(pathed.groupBy("path").agg(F.count("*").alias("words")))
        most = shards.agg(F.max("words")).first()[0] or 0
        if most <= shard_words or depth == DEPTH:
            break
        depth = min(DEPTH, depth + 2)
    shards = shards.select(F.array_join("path", ",").alias("shard"), F.ceil(F.col("words") / shard_words).alias("blocks"))
    own = pathed.withColumn("shard", F.array_join("path", ",")).join(shards, "shard")
    own = own.select("shard", F.expr("pmod(xxhash64(word), blocks)").alias("block"), F.lit(False).alias("asks"), "word", "n")
    changes = F.array(*[F.array(*[F.lit(x) for x in change]) for change in budgets(depth)])
    sent = pathed.select("word", "n", "path", F.explode(changes).alias("change")).withColumn("path", F.zip_with("path", "change", lambda a, b: a + b))
    sent = sent.where(F.array_min("path") >= 0).withColumn("shard", F.array_join("path", ",")).join(shards, "shard")
    sent = sent.select("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), F.lit(True).alias("asks"), "word", "n")
    rows = own.unionByName(sent).repartition(parts, "shard", "block").sortWithinPartitions("shard", "block", "asks")
    return rows.mapInArrow(_searched, "word string, near string, near_n long")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of words (word, form): the end of each word's chain of forms, in rounds that double what is followed."""
    ends = materialize(forms.select("word", F.col("form").alias("root")))
    while True:
        following = ends.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = materialize(ends.join(following, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.isnotnull("further").alias("moved")))
        ends = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return ends


def variants(docs: DataFrame, least: int = 6, times: int = 5, every: int = 199, factor: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, form, root, n, n_near, form_n of every word.

    A word's form is the most frequent word one edit apart (of equally frequent ones the first in code-point order), if it is
    ``factor`` times as frequent or more; its root is where the chain of forms ends. ``every``: one letter is dropped from runs whose
    hash with the id it divides.
    """
    words = materialize(vocabulary(docs, least, times, every, id_col, text_col))
    near = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("top"))
    rows = words.join(near, "word", "left")
    good = -F.col("top.less") >= factor * F.col("n")
    rows = materialize(rows.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(good, F.col("top.near")).alias("form"), F.when(good, -F.col("top.less")).alias("form_n")))
    ends = roots(rows.where("form IS NOT NULL").select("word", "form"))
    return rows.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
