"""Exact n-gram Jaccard join by PartEnum signatures.

A text's set holds its distinct word shingles as 64-bit hashes. Sizes are cut into bands so wide that two sets similar enough
are in one band or in neighbouring ones; an instance covers two neighbouring bands and knows how many elements (k) two of
its similar sets can differ in. There the domain of elements is cut by hash into n1 groups of n2 partitions each. As the
differences are at most k, some group has at most k2 of them, so some n2 - k2 of its partitions are equal in both sets: the
signatures of a set are all subsets of that many partitions in each group.

Signatures of partitions without any element would bring unlike sets together. There are more groups than needed: with
``spare`` extra ones, more than ``spare`` groups agree, so a set with at most that many groups that have an empty subset
can leave those signatures out without losing a link. A set with more of them emits them all.

The spare groups serve once more when it is known how many sets each signature has: similar sets have several signatures in
common (``least_common``), so each set gives up one less of its own, those that most sets have. All sets judge a signature
alike, so of the ones that two similar sets share, the one with fewest sets stays in both. Most sets that merely
share a passage have nothing left then.

Equal sets are one class from the start. Each set is first compared with the hub it shares most signatures with (of each
signature, the set with most company), and linked sets are merged; then what still stands in different components under one signature is compared pair by
pair. So components are complete, and a group of near copies costs one comparison for each member to find them. A
pair's sizes and parity bits, some tenth of its sets, show first whether it can be similar at all; pairs that they rule out are
never written as rows. A signature's sets meet in pairs of blocks of some ``_BLOCK`` sets, so that no task holds more than two
blocks of a hot signature. Under a signature of a few sets the pairs are rows from the start, each once before its bits are compared, as
a pair has many signatures in common as a rule.

All links lie inside components, so the links of each set are counted there: a component's sets are cut into bands of size and
blocks of at most some ``_TILE`` sets, and each pair of blocks whose sizes allow a link is one tile, in which the common elements of
every pair of sets are counted exactly. The work grows with the square of a component's sets, as its links may.

Null and empty texts, and texts of white space, have an empty set and link with nothing. Null ids are carried through; of rows
with the same id each is a row of its own. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import re
from contextlib import contextmanager
from functools import lru_cache
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from anchorframe.llm.components import components
from anchorframe.session import materialize

_C1, _C2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_SLICE = 1 << 20  # bytes of a text whose words are held at once
_SPACE = re.compile(rb"[ \t-\r]")
_BROADCAST_ROWS = 2_000_000  # ids of 8 bytes
_TILE, _TILE_ELEMENTS = 1024, 1 << 20  # sets in a block, and their elements
_BLOCK = 2048  # sets under one signature in a block
_FEW_SETS = 8  # sets under one signature whose pairs become rows before their bits are compared
_COLUMNS = 4096  # elements whose incidence is held at once
_ROWS = 512  # rows of texts or of pairs of sets in a batch
_PAIRS = 1 << 14  # pairs whose parity bits are compared at once
_GATHERED = 1 << 18  # signatures gathered before they are dealt out


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _C2
    return x ^ (x >> np.uint64(27))


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash of each word, A-Z lower-cased, words being runs of anything but ASCII white space."""
    from xxhash import xxh64_intdigest

    data, at, parts = text.encode("utf-8", "surrogatepass").lower(), 0, []
    while at < len(data):
        cut = _SPACE.search(data, at + _SLICE)
        end = cut.start() if cut else len(data)
        words = data[at:end].split()
        parts.append(np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words)))
        at = end
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles of ``width`` words; fewer words are one shingle."""
    words = word_hashes(text) if text else np.zeros(0, np.uint64)
    if not len(words):
        return words
    size = min(width, len(words))
    total = np.full(len(words) - size + 1, size, np.uint64)
    for n in range(size):
        total = _mix(total * _C1 + words[n:len(words) - size + 1 + n])
    return np.unique(total)


def set_key(elements: np.ndarray) -> int:
    """A 64-bit name of a set."""
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(elements.tobytes()) - (1 << 63)


_BANDS: dict[tuple[int, int], list[int]] = {}


def band_of(n: int, num: int, den: int) -> int:
    """The band of a size. Sets with similarity num/den or more are at most one band apart."""
    tops = _BANDS.setdefault((num, den), [1])
    while tops[-1] < n:
        tops.append(max(tops[-1] + 1, tops[-1] * den // num))
    return int(np.searchsorted(tops, n))


@lru_cache(maxsize=4096)
def scheme(instance: int, num: int, den: int) -> tuple[int, int, int, int]:
    """n1, n2, k2 and the spare groups of the instance that covers bands ``instance`` and the next.

    With k2 = 1, n1 groups hold k differences with at most one in some group if n1 > k / 2; a signature is two of a group's three
    partitions, six elements or so, which unlike sets that share a passage seldom have in common.
    """
    tops = _BANDS[num, den]
    while len(tops) < instance + 2:
        tops.append(max(tops[-1] + 1, tops[-1] * den // num))
    k = 2 * tops[instance + 1] * (den - num) // (den + num)
    if k == 0:
        return 1, 1, 0, 0
    need = k // 2 + 1
    spare = 1 + need // 8
    return need + spare, 3, 1, spare


def least_common(instance: int, num: int, den: int) -> int:
    """The least number of signatures that two similar sets of an instance have in common, those of empty partitions among them.

    A group has three signatures in common where the sets don't differ, one where they differ once, and perhaps none beyond.
    """
    n1, n2, _, _ = scheme(instance, num, den)
    k = 2 * _BANDS[num, den][instance + 1] * (den - num) // (den + num)
    return 1 if n2 == 1 else max(3 * n1 - 2 * k, 2 * n1 - k)


def _dealt(elements: np.ndarray, instance: int, n: int) -> tuple[np.uint64, np.ndarray, np.ndarray]:
    """An instance's seed, and of its ``n`` partitions that of each element and the sizes."""
    seed = np.uint64((instance + 1) * int(_C1) % (1 << 64))
    part = (_mix(elements + seed) % np.uint64(n)).astype(np.int64)
    return seed, part, np.bincount(part, minlength=n)


def spared(elements: np.ndarray, num: int, den: int) -> tuple[int, int]:
    """How many of its signatures with an even and with an odd mark a set can give up."""
    out = [0, 0]
    if len(elements):
        band = band_of(len(elements), num, den)
        for instance in range(max(0, band - 1), band + 1):
            n1, n2, k2, spare = scheme(instance, num, den)
            out[instance & 1] = least_common(instance, num, den) - 1
            empty = _dealt(elements, instance, n1 * n2)[2].reshape(n1, n2) == 0
            some = empty[empty.sum(1) >= n2 - k2].sum(1).tolist()
            if some:  # signatures left out already, or all of them kept
                gone = sum(comb(e, n2 - k2) for e in some)
                out[instance & 1] = max(0, out[instance & 1] - gone) if len(some) <= spare else 0
    return out[0], out[1]


def signatures(elements: np.ndarray, num: int, den: int) -> np.ndarray:
    """All signatures of a set, for the two instances that its band belongs to. The lowest bit marks odd instances."""
    if not len(elements):
        return elements
    band, out = band_of(len(elements), num, den), []
    for instance in range(max(0, band - 1), band + 1):
        n1, n2, k2, spare = scheme(instance, num, den)
        seed, part, sizes = _dealt(elements, instance, n1 * n2)
        sums = np.zeros(n1 * n2, np.uint64)
        np.add.at(sums, part, _mix(elements * _C1 + seed))
        sums = _mix(sums + sizes.astype(np.uint64) * _C1).reshape(n1, n2)
        sizes = sizes.reshape(n1, n2)
        found, empty = [], []
        for n, subset in enumerate(combinations(range(n2), n2 - k2)):
            total = (np.arange(n1, dtype=np.uint64) * np.uint64(64) + np.uint64(n)) * _C2 + seed
            for j in subset:
                total = _mix(total * _C1 + sums[:, j])
            found.append(total)
            empty.append(sizes[:, list(subset)].sum(1) == 0)
        empty = np.array(empty)
        skip = empty if empty.any(0).sum() <= spare else np.zeros_like(empty)
        out.append(np.array(found)[~skip] >> np.uint64(1) << np.uint64(1) | np.uint64(instance & 1))
    return np.concatenate(out)


def parity(elements: np.ndarray) -> np.ndarray:
    """Bits (a power of two, four to eight for an element) that count the elements of each hash class modulo 2.

    Where two sets' bits differ, they differ in an element of that class, so sets have at least as many differences as bits.
    """
    size = max(64, 4 << (len(elements) - 1).bit_length())
    bits = np.bincount((_mix(elements) % np.uint64(size)).astype(np.int64), minlength=size) & 1
    return np.packbits(bits.astype(np.uint8))


def far(a: np.ndarray, b: np.ndarray, size_a: int, size_b: int, num: int, den: int) -> bool:
    """Whether the parity bits of two sets show that they differ too much to be similar."""
    while len(a) > len(b):
        a = a[:len(a) // 2] ^ a[len(a) // 2:]
    while len(b) > len(a):
        b = b[:len(b) // 2] ^ b[len(b) // 2:]
    return (den + num) * int(np.bitwise_count(a ^ b).sum()) > (den - num) * (size_a + size_b)


def similar(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return den * both >= num * (len(a) + len(b) - both)


def _table(columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v) for v in columns.values()], names=list(columns))


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _some(batches, rows: int = 256):
    """The same rows in batches of at most ``rows``."""
    for got in batches:
        for at in range(0, got.num_rows, rows):
            yield got.slice(at, rows)


def _sized(width: int, num: int, den: int):
    """doc_id, size and name of the set of each row, the hash of its text, and how many signatures the set can give up."""
    def run(batches):
        for got in batches:
            size, key, spare = np.empty(got.num_rows, np.int64), np.empty(got.num_rows, np.int64), np.empty((2, got.num_rows), np.int64)
            for n, text in enumerate(got.column(1)):
                elements = shingle_set(text.as_py(), width)
                size[n], key[n] = len(elements), set_key(elements)
                spare[:, n] = spared(elements, num, den)
            yield pa.RecordBatch.from_arrays([got.column(0), pa.array(size), pa.array(key), got.column(2), pa.array(spare[0]), pa.array(spare[1])],
                                             names=["doc_id", "n", "key", "x", "even", "odd"])

    return run


def _signed_rows(width: int, num: int, den: int, parts: int):
    """Signatures and set names, gathered by the part that the signature belongs to; of equal sets in a task, once."""
    def gathered(sigs, keys):
        sig, key = np.concatenate(sigs), np.repeat(np.array(keys, np.int64), [len(x) for x in sigs])
        part = ((sig >> np.uint64(1)) % np.uint64(parts)).astype(np.int32)
        order = np.argsort(part, kind="stable")
        first, size = _runs(part[order])
        ends = pa.array(np.concatenate([first, [len(sig)]]), pa.int32())
        lists = [pa.ListArray.from_arrays(ends, pa.array(x[order])) for x in (_signed(sig), key)]
        return pa.RecordBatch.from_arrays([pa.array(part[order][first]), *lists], names=["part", "sig", "key"])

    def run(batches):
        done, sigs, keys, n = set(), [], [], 0
        for got in _some(batches):
            for text in got.column(0).to_pylist():
                elements = shingle_set(text, width)
                if len(elements) and (key := set_key(elements)) not in done:
                    done.add(key)
                    sigs.append(signatures(elements, num, den))
                    keys.append(key)
                    n += len(sigs[-1])
                if n > _GATHERED:
                    yield gathered(sigs, keys)
                    sigs, keys, n = [], [], 0
        if n:
            yield gathered(sigs, keys)

    return run


def _runs(sig: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First row and number of rows of each run of equal values."""
    first = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
    return first, np.diff(np.concatenate([first, [len(sig)]]))


def _shared(batches):
    """Of the partition's signatures (in lists) those that several sets have: sig, key, and how many others have it."""
    got = [(b.column(0).flatten().to_numpy(), b.column(1).flatten().to_numpy()) for b in batches]
    if not got:
        return
    sig, key = (np.concatenate(x) for x in zip(*got))
    del got
    if not len(sig):
        return
    order = np.lexsort((key, sig))
    sig, key = sig[order], key[order]
    del order
    keep = np.concatenate([[True], (sig[1:] != sig[:-1]) | (key[1:] != key[:-1])])
    sig, key = sig[keep], key[keep]
    first, size = _runs(sig)
    many = np.repeat(size > 1, size)
    yield _table({"sig": sig[many], "key": key[many], "others": np.repeat(size - 1, size)[many]})


def _kept(shared: DataFrame, sized: DataFrame) -> DataFrame:
    """Signatures that several sets still have when each has given up those it can, the ones with most sets first."""
    spare = sized.where("n > 0").select("key", "even", "odd").distinct()
    mark = F.col("sig").bitwiseAND(F.lit(1))
    place = F.row_number().over(Window.partitionBy("key", "mark").orderBy(F.desc("others"), "sig"))
    left = shared.join(spare, "key").withColumn("mark", mark).withColumn("place", place)
    left = left.where(F.col("place") > F.when(F.col("mark") == 0, F.col("even")).otherwise(F.col("odd"))).select("sig", "key")
    return left.withColumn("others", F.count("*").over(Window.partitionBy("sig")) - 1).where("others > 0")


def _folded(bits: list[bytes], size: int) -> np.ndarray:
    """Parity bits of sets, brought to ``size`` bytes each, as rows of 64-bit words."""
    folded = np.empty((len(bits), size), np.uint8)
    for n, x in enumerate(bits):
        x = np.frombuffer(x, np.uint8)
        while len(x) > size:
            x = x[:len(x) // 2] ^ x[len(x) // 2:]
        folded[n] = x
    return folded.view(np.uint64)


def near_rows(left: tuple, right: tuple, num: int, den: int):
    """Index pairs of sets (bits, sizes, components) on two sides, in different components, whose sizes and parity bits allow them to be similar.

    All pairs are compared by their bits folded to an eighth; those that are left, by all bits.
    """
    least = min(map(len, left[0] + right[0]))
    (words, n, own), (words2, m, other) = ((_folded(x[0], max(8, least // 8)), *x[1:]) for x in (left, right))
    every, every2 = (_folded(x[0], least) for x in (left, right))
    step = max(1, (1 << 20) // (words2.shape[0] * words2.shape[1]))
    for at in range(0, len(words), step):
        rows = slice(at, at + step)
        apart = np.bitwise_count(words[rows, None, :] ^ words2[None]).sum(2, dtype=np.int64)
        both = n[rows, None] + m[None]
        maybe = ((den + num) * apart <= (den - num) * both) & (own[rows, None] != other[None])
        maybe &= den * np.minimum(n[rows, None], m[None]) >= num * np.maximum(n[rows, None], m[None])
        i, j = np.nonzero(maybe)
        i = at + i
        for low in range(0, len(i), _PAIRS):
            x, y = i[low:low + _PAIRS], j[low:low + _PAIRS]
            sure = (den + num) * np.bitwise_count(every[x] ^ every2[y]).sum(1, dtype=np.int64) <= (den - num) * (n[x] + m[y])
            yield x[sure], y[sure]


def _crossing(num: int, den: int):
    """Pairs of sets under one signature that are in different components and may be similar.

    Rows come in the order of block pairs: sig, low block, high block, whether the row is of the low block, key, component, n,
    bits. Two blocks are held at a time. Parity bits are compared where they meet, so only pairs that they do not rule out become rows.
    """
    def run(batches):
        found, n = [], 0
        for rows in _grouped(batches, 3):
            sides = []
            for low in (True, False):
                own = [r[1:] for r in rows if r[0] == low]
                sides.append((np.array([r[0] for r in own], np.int64), ([r[3] for r in own], np.array([r[2] for r in own], np.int64), np.array([r[1] for r in own], np.int64))))
            (key, left), (key2, right) = sides
            if not len(key2):  # a block and itself, or one that meets an empty block
                key2, right = key, left
            if not len(key):
                continue
            for i, j in near_rows(left, right, num, den):
                if len(i):
                    x, y = key[i], key2[j]
                    found.append(np.stack([np.minimum(x, y), np.maximum(x, y)], 1))
                    n += len(i)
            if len(found) > 4096 or n > 1 << 20:
                found = [np.unique(np.concatenate(found), axis=0)]
                n = len(found[0])
                if n > 1 << 18:
                    yield _table({"a": found[0][:, 0].copy(), "b": found[0][:, 1].copy()})
                    found, n = [], 0
        if found:
            pairs = np.unique(np.concatenate(found), axis=0)
            yield _table({"a": pairs[:, 0].copy(), "b": pairs[:, 1].copy()})

    return run


def _block_pairs(crossing: DataFrame, sizes: DataFrame) -> DataFrame:
    """Rows (sig, key, component, n, bits) dealt to the pairs of their signature's blocks of some ``_BLOCK`` sets."""
    sizes = sizes.select("sig", F.ceil(F.col("sets") / _BLOCK).alias("blocks"))
    dealt = crossing.join(_few(sizes), "sig").withColumn("block", F.expr("pmod(xxhash64(key), blocks)"))
    dealt = dealt.withColumn("met", F.explode(F.expr("sequence(0L, blocks - 1)")))
    return dealt.select("sig", F.least("block", "met").alias("low"), F.greatest("block", "met").alias("high"), (F.col("block") <= F.col("met")).alias("side"), "key", "component", "n", "bits")


def _pairs_of_few(crossing: DataFrame) -> DataFrame:
    """Pairs (a, b) in different components under signatures of at most ``_FEW_SETS`` sets (sig, key, component)."""
    own = crossing.groupBy("sig").agg(F.sort_array(F.collect_list(F.struct("key", "component"))).alias("own"))
    pairs = own.select(F.explode("own").alias("x"), "own").select("x", F.explode("own").alias("y"))
    return pairs.where("x.key < y.key AND x.component <> y.component").select(F.col("x.key").alias("a"), F.col("y.key").alias("b"))


def _sets(width: int):
    def run(batches):
        for got in _some(batches):
            sets = [shingle_set(t, width) for t in got.column(1).to_pylist()]
            own = pa.array([set_key(s) == k for s, k in zip(sets, got.column(0).to_pylist())], pa.bool_())  # else another row with this id
            yield pa.RecordBatch.from_arrays([got.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([parity(s).tobytes() for s in sets], pa.binary()),
                                              pa.array([s.tobytes() for s in sets], pa.binary())], names=["key", "n", "bits", "elements"]).filter(own)

    return run


def _possible(num: int, den: int):
    """Keeps the pairs (a, b, n, bits of a, m, bits of b) that may be similar."""
    def run(batches):
        for got in batches:
            near = [not far(np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8), n, m, num, den) for n, x, m, y in zip(*(got.column(i).to_pylist() for i in range(2, 6)))]
            yield pa.RecordBatch.from_arrays([got.column(0), got.column(1)], names=["a", "b"]).filter(pa.array(near, pa.bool_()))

    return run


def _verified(num: int, den: int):
    def run(batches):
        for got in batches:
            a, b, x, y = (got.column(n).to_pylist() for n in range(4))
            sure = [similar(np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64), num, den) for p, q in zip(x, y)]
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(sure, pa.bool_())], names=["a", "b", "linked"])

    return run


def common(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Numbers of elements that each set of ``a`` has in common with each of ``b``, exactly (below 2 ** 24)."""
    out = np.zeros((len(a), len(b)), np.float32)
    left, right = np.concatenate(a), np.concatenate(b)
    both = np.intersect1d(left, right)
    sides = []
    for sets, every in ((a, left), (b, right)):
        row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        at = np.minimum(np.searchsorted(both, every), max(0, len(both) - 1))
        own = both[at] == every if len(both) else np.zeros(len(every), bool)
        order = np.argsort(at[own], kind="stable")
        sides.append((row[own][order], at[own][order]))
    for low in range(0, len(both), _COLUMNS):
        parts = []
        for n, (row, at) in zip((len(a), len(b)), sides):
            i, j = np.searchsorted(at, [low, low + _COLUMNS])
            parts.append(np.zeros((n, min(_COLUMNS, len(both) - low)), np.float32))
            parts[-1][row[i:j], at[i:j] - low] = 1
        out += parts[0] @ parts[1].T
    return out.astype(np.int64)


def tile_links(a: list[np.ndarray], b: list[np.ndarray] | None, num: int, den: int) -> np.ndarray:
    """Whether each set of ``a`` is similar to each of ``b``, or to each other one of ``a``."""
    other = a if b is None else b
    both = common(a, other)
    n, m = np.array([len(x) for x in a]), np.array([len(x) for x in other])
    linked = den * both >= num * (n[:, None] + m[None, :] - both)
    if b is None:
        np.fill_diagonal(linked, False)
    return linked


def _grouped(batches, keys: int):
    """Rows of sorted batches by their first ``keys`` columns, one group at a time."""
    name, held = None, []
    for got in batches:
        for row in zip(*(c.to_pylist() for c in got.columns)):
            if row[:keys] != name:
                if held:
                    yield held
                name, held = row[:keys], []
            held.append(row[keys:])
    if held:
        yield held


def _counted(num: int, den: int):
    """Of each tile (rows: its name, side, key, copies, elements) the linked rows of its sets: key, links."""
    def run(batches):
        keys, links, n = [], [], 0
        for rows in _grouped(batches, 5):
            sides = []
            for side in (0, 1):
                own = {key: (copies, np.frombuffer(x, np.uint64)) for s, key, copies, x, _ in rows if s == side}  # a set with a null id may come twice
                sides.append((np.array(list(own), np.int64), np.array([c for c, _ in own.values()], np.int64), [x for _, x in own.values()]))
            (key, copies, sets), (key2, copies2, sets2) = sides
            if not sets:
                continue
            alone = rows[0][4]
            if not alone and not sets2:
                continue
            linked = tile_links(sets, None if alone else sets2, num, den)
            found = [(key, linked @ (copies if alone else copies2))] + ([] if alone else [(key2, copies @ linked)])
            for k, x in found:
                keys.append(k[x > 0])
                links.append(x[x > 0])
                n += len(keys[-1])
            if n > 1 << 16:
                yield _table({"key": np.concatenate(keys), "links": np.concatenate(links)})
                keys, links, n = [], [], 0
        if n:
            yield _table({"key": np.concatenate(keys), "links": np.concatenate(links)})

    return run


def _few(rows: DataFrame) -> DataFrame:
    return F.broadcast(rows) if rows.count() <= _BROADCAST_ROWS else rows


def _links_of(members: DataFrame, num: int, den: int) -> DataFrame:
    """(key, links): of sets (component, key, copies, n, elements) the numbers of rows in other sets that link with theirs."""
    # Similar sets differ by less than one band in the logarithm of their sizes, so that they are in one band or in neighbouring ones.
    width = max(1e-3, 1.001 * float(np.log(den / num)))
    members = members.withColumn("band", F.floor(F.log("n") / width))
    cells = members.groupBy("component", "band").agg(F.count("*").alias("sets"), F.sum("n").alias("size"))
    cells = materialize(cells.select("component", "band", F.ceil(F.greatest(F.col("sets") / _TILE, F.col("size") / _TILE_ELEMENTS)).alias("blocks")))
    near = cells.select("component", F.col("band").alias("near_band"), F.col("blocks").alias("near_blocks"))
    near = cells.join(near, "component").where("abs(band - near_band) <= 1")
    near = near.groupBy("component", "band").agg(F.max("blocks").alias("blocks"), F.collect_list(F.struct("near_band", "near_blocks")).alias("others"))
    dealt = members.join(_few(materialize(near)), ["component", "band"]).withColumn("block", F.expr("pmod(xxhash64(key), blocks)"))
    # The names (band and block) of all blocks that this one meets; the smaller name is the tile's left side.
    met = "flatten(transform(others, o -> transform(sequence(0L, o.near_blocks - 1), x -> struct(o.near_band AS band, x AS block))))"
    dealt = dealt.withColumn("met", F.explode(F.expr(met))).withColumn("own", F.struct("band", "block"))
    low, high = F.least("own", "met"), F.greatest("own", "met")
    tiles = dealt.select("component", low["band"].alias("band"), low["block"].alias("block"), high["band"].alias("band2"), high["block"].alias("block2"),
                         F.when(F.col("own") == low, 0).otherwise(1).alias("side"), "key", "copies", "elements", (F.col("own") == F.col("met")).alias("alone"))
    names = ["component", "band", "block", "band2", "block2"]
    parts = 2 * int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = tiles.repartition(parts, *names).sortWithinPartitions(*names).mapInArrow(_counted(num, den), "key long, links long")
    return found.groupBy("key").agg(F.sum("links").alias("links"))


def link(docs: DataFrame, num: int = 85, den: int = 100, width: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and n_links of every row; rows link where ``den * |both| >= num * |either|``.

    n_links is the number of other rows that link with the row, those of equal sets among them.
    """
    sized, known, sets = _linked(docs, num, den, width, id_col, text_col)
    known = materialize(known)
    several = known.groupBy("component").agg(F.count("*").alias("sets")).where("sets > 1").select("component")
    members = known.join(several, "component").select("component", "key", "copies").join(sets.select("key", "n", "elements"), "key")
    links = _links_of(members.select("component", "key", "copies", "n", "elements"), num, den)
    known = known.join(links, "key", "left").select("key", "component_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    return sized.join(known, "key", "left").select("doc_id", F.col("n").alias("n_shingles"),
                                                   F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
                                                   F.when(F.col("n") > 0, F.col("n_links")).otherwise(F.lit(0)).alias("n_links"))


@contextmanager
def _small_batches(spark: SparkSession, rows: int):
    """Tasks started inside hand Python at most so many rows at a time, as a pair's two sets may be large."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _linked(docs: DataFrame, num: int, den: int, width: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (doc_id, n, key, x), sets (key, component, component_id, copies) and those with company (key, n, bits, elements)."""
    with _small_batches(docs.sparkSession, _ROWS):  # all tables below are written here
        return _components_of(docs, num, den, width, id_col, text_col)


def _components_of(docs: DataFrame, num: int, den: int, width: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The tables of ``_linked``."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sized = materialize(rows.select("*", F.xxhash64("text").alias("x")).mapInArrow(_sized(width, num, den), "doc_id long, n long, key long, x long, even long, odd long"))
    parts = 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    signed = rows.select("text").mapInArrow(_signed_rows(width, num, den, parts), "part int, sig array<long>, key array<long>")
    shared = materialize(signed.repartitionById(parts, "part").select("sig", "key").mapInArrow(_shared, "sig long, key long, others long"))
    shared = materialize(_kept(shared, sized))
    # One row with each set that has candidates. Few ids are sent to all tasks; many are joined.
    first = sized.where("n > 0").join(shared.select("key").distinct(), "key", "left_semi").groupBy("key").agg(F.min("doc_id").alias("doc_id"))
    first = materialize(first)
    wanted = (F.broadcast(first) if first.count() <= _BROADCAST_ROWS else first).withColumnRenamed("doc_id", "id")
    sets = rows.join(wanted, F.col("doc_id").eqNullSafe(F.col("id"))).select("key", "text")
    sets = materialize(sets.mapInArrow(_sets(width), "key long, n long, bits binary, elements binary"))

    def verify(pairs: DataFrame) -> DataFrame:
        """(a, b, linked) of the pairs. Sizes and parity bits show most unlike pairs; the sets of the others are compared."""
        mine, other = sets.select("key", "n", "bits").toDF("a", "n", "x"), sets.select("key", "n", "bits").toDF("b", "m", "y")
        sized_alike = (den * F.least("n", "m") >= num * F.greatest("n", "m"))
        near = pairs.join(mine, "a").join(other, "b").where(sized_alike).select("a", "b", "n", "x", "m", "y").mapInArrow(_possible(num, den), "a long, b long")
        near = materialize(near)
        mine, other = sets.select("key", "elements").toDF("a", "x"), sets.select("key", "elements").toDF("b", "y")
        return materialize(near.join(mine, "a").join(other, "b").select("a", "b", "x", "y").mapInArrow(_verified(num, den), "a long, b long, linked boolean"))

    # The hub of a signature is its set with most company, as the origin of near copies is; each set first meets the hub it
    # shares most signatures with. Then what is still apart under a signature is compared pair by pair.
    company = materialize(shared.groupBy("key").agg(F.sum("others").alias("company")))
    hubs = shared.join(company, "key").groupBy("sig").agg(F.max(F.struct("company", "key")).alias("hub")).select("sig", F.col("hub.key").alias("hub"))
    stars = shared.join(hubs, "sig").where("key <> hub").groupBy(F.col("hub").alias("a"), F.col("key").alias("b")).agg(F.count("*").alias("times"))
    best = materialize(stars.groupBy("b").agg(F.max(F.struct("times", "a")).alias("top")).select(F.col("top.a").alias("a"), "b"))
    links = verify(best).where("linked")
    tree = materialize(components(links))
    named = shared.join(tree, shared["key"] == tree["node"], "left").select("sig", "key", F.coalesce("component", "key").alias("component"))
    mixed = named.groupBy("sig").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("sets")).where("low < high").select("sig", "sets")
    mixed = materialize(mixed)
    named = materialize(named.join(mixed, "sig").select("sig", "key", "component", "sets"))
    crossing = named.where(F.col("sets") > _FEW_SETS).join(sets.select("key", "n", "bits"), "key").select("sig", "key", "component", "n", "bits")
    crossing = _block_pairs(crossing, mixed.where(F.col("sets") > _FEW_SETS))
    crossing = crossing.repartition(parts, "sig", "low", "high").sortWithinPartitions("sig", "low", "high").mapInArrow(_crossing(num, den), "a long, b long")
    crossing = crossing.unionByName(_pairs_of_few(named.where(F.col("sets") <= _FEW_SETS))).distinct()
    links = links.unionByName(verify(materialize(crossing.join(best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti"))).where("linked"))
    tree = components(links)
    known = sized.where("n > 0").groupBy("key").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies")).join(tree, F.col("key") == F.col("node"), "left")
    known = known.select("key", F.coalesce("component", "key").alias("component"), "least", "copies")
    names = known.groupBy("component").agg(F.min("least").alias("component_id"))
    return sized, known.join(names, "component").select("key", "component", "component_id", "copies"), sets


def keep_first(docs: DataFrame, num: int, den: int, width: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, whose id is the smallest of their text's component. Of rows with one id, each is judged by its text."""
    sized, known, _ = _linked(docs, num, den, width, id_col, text_col)
    found = materialize(sized.where("n > 0").join(known.select("key", "component_id"), "key").select("doc_id", "x", "component_id"))
    free = "_"
    while any(c.lower().startswith(free) for c in docs.columns):
        free += "_"
    gone = materialize(found.where("doc_id <> component_id").select(F.col("doc_id").alias(f"{free}id"), F.col("x").alias(f"{free}x")).distinct())
    few = F.broadcast(gone) if gone.count() <= _BROADCAST_ROWS else gone
    return docs.join(few, (docs[id_col] == few[f"{free}id"]) & (F.xxhash64(docs[text_col].cast("string")) == few[f"{free}x"]), "left_anti")
