"""Removal of long repeated byte strings by suffix arrays of what documents share.

A byte goes if a string of ``length`` bytes (50) that covers it also starts in a document with a smaller id.

1. Of equal texts all but the first are known to go as a whole.
2. In every window of ``length`` bytes the 16 bytes with the smallest hash (the leftmost of them) are its anchor. Equal windows
   have equal anchors, so only windows whose anchor occurs in several documents can repeat.
3. The windows of such an anchor, a few dozen bytes of text around it, are one fragment. Of equal fragments in a task only the
   first document's is passed on, as it shows that the others lose all its windows; fragments are dealt out by anchor, so that
   equal windows meet. An anchor with more than some ``_HOT`` places is too much for a task: each of its windows is a fragment of its
   own, dealt out by a hash of all its bytes.
4. There, block by block, the fragments' windows are put into suffix order (``suffixes``: buckets and difference-cover ranks),
   windows that agree in all their bytes get the smallest id of any document they are in, and places in others lose them.
5. Each document's spans are united.

A hot passage costs a row for each of its fragments and tasks, not for each document, and a document meets only its own spans.
Long texts are read in slices.

Null ids and null texts: a null text is empty; a row with a null id loses nothing and takes nothing from others. Rows with the
same id take nothing from each other, and each loses only what its own text repeats: where an id has several texts, their places
are numbered apart. Texts shorter than ``length`` are kept whole. An empty table gives an empty result. Columns may have any names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anchorframe.llm.suffixes import same_before, suffix_order
from anchorframe.session import materialize

_ANCHOR = 16  # bytes
_SLICE = 1 << 19  # windows looked at together
_BLOCK = 1 << 20  # bytes of fragments sorted together, where one anchor has no more
_HOT = 1 << 14  # places of an anchor whose fragments one task judges
_HELD = 1 << 27  # bytes of fragments and places that a task holds before it hands them on
_BROADCAST_ROWS = 2_000_000
_PLACES = 1 << 31  # places of one text; texts that share an id have places apart by this
U4, U8 = np.uint32, np.uint64


def _fours(data: bytes) -> np.ndarray:
    """The four bytes from each position, as one number."""
    out = np.empty(len(data) - 3, "<u4")
    for n in range(4):
        part = out[n::4]
        part[:] = np.frombuffer(data, "<u4", len(part), n)
    return out


def anchors(data: bytes, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each window the place of its anchor; and the 64-bit hashes of the 16 bytes at every distinct place, in order."""
    four = _fours(data)
    n, width = len(data) - _ANCHOR + 1, length - _ANCHOR + 1
    low = np.zeros(n, U4)
    for at in range(0, _ANCHOR, 4):
        low = (low ^ four[at:at + n]) * U4(0x9E3779B1 + 2 * at)
        low ^= low >> U4(15)
    least, size = (low.astype(U8) << U8(32)) | np.arange(n, dtype=U8), 1
    while 2 * size <= width:
        least, size = np.minimum(least[:-size], least[size:]), 2 * size
    if size < width:
        least = np.minimum(least[:size - width], least[width - size:])
    place = (least & U8(0xFFFFFFFF)).astype(np.int64)
    at = place[np.concatenate([[True], place[1:] != place[:-1]])]
    hashed = four[at].astype(U8)
    for n in range(4, _ANCHOR, 4):
        hashed = (hashed ^ (hashed >> U8(29))) * U8(0xBF58476D1CE4E5B9) + four[at + n]
    return place, (hashed ^ (hashed >> U8(32))).view(np.int64)


def _slices(data: bytes, length: int):
    for at in range(0, len(data) - length + 1, _SLICE):
        yield at, data[at:at + _SLICE + length - 1]


def _anchor_rows(length: int):
    def run(batches):
        for got in batches:
            for doc, text in zip(got.column(0).to_pylist(), got.column(1).to_pylist()):
                found = np.concatenate([anchors(part, length)[1] for _, part in _slices(text.encode(), length)])  # each place counts
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(np.full(len(found), doc, np.int64))], names=["hash", "doc"])

    return _gathered(run)


def _gathered(run, rows: int = 1 << 16):
    """Larger batches out of many small ones."""
    def wrapped(batches):
        held, n = [], 0
        for batch in run(batches):
            held.append(batch)
            n += batch.num_rows
            if n >= rows:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, n = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return wrapped


def _shared(hot: int):
    """Of the partition's (hash, doc) those whose hash is in several documents, each once, and whether the hash has more than ``hot`` places."""
    def run(batches):
        got = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        if not got:
            return
        hashed, doc = (np.concatenate(x) for x in zip(*got))
        if not len(hashed):
            return
        order = np.argsort(hashed, kind="stable")
        hashed, doc = hashed[order], doc[order]
        first = np.flatnonzero(np.concatenate([[True], hashed[1:] != hashed[:-1]]))
        size = np.diff(np.concatenate([first, [len(hashed)]]))
        several = np.repeat(np.minimum.reduceat(doc, first) < np.maximum.reduceat(doc, first), size)
        hashed, doc, many = hashed[several], doc[several], np.repeat(size > hot, size)[several]
        order = np.lexsort((doc, hashed))
        hashed, doc, many = hashed[order], doc[order], many[order]
        new = np.concatenate([[True], (hashed[1:] != hashed[:-1]) | (doc[1:] != doc[:-1])])[:len(hashed)]
        yield pa.RecordBatch.from_arrays([pa.array(doc[new]), pa.array(hashed[new]), pa.array(many[new])], names=["doc", "hash", "hot"])

    return run


FRAGMENTS = "anchor long, fragment binary, doc long, start long, stop long"
_NAMES = [f.split()[0] for f in FRAGMENTS.split(", ")]
_KINDS = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]


def _fragments(length: int):
    """Rows of two kinds. Of equal fragments in a task, the places in the first document: anchor, bytes, document, byte.

    All windows of the other documents with the fragment go for certain, as the first one has them: their spans, without bytes.
    Windows of a hot anchor are fragments of their own, under a hash of their bytes in place of the anchor.
    """
    from xxhash import xxh64_intdigest

    def rows(held, hots):
        columns: list[list] = [[], [], [], []]
        docs, starts, stops = [], [], []
        windows: dict[bytes, list] = {}

        def every():
            for (anchor, fragment), flat in held.items():
                yield anchor, fragment, flat, anchor in hots
            for window, flat in windows.items():
                yield xxh64_intdigest(window) - (1 << 63), window, flat, False

        for anchor, fragment, flat, hot in every():
            first = min(flat[::2])
            for doc, start in zip(flat[::2], flat[1::2]):
                if doc == first and hot:
                    for n in range(len(fragment) - length + 1):
                        windows.setdefault(fragment[n:n + length], []).extend((doc, start + n))
                elif doc == first:
                    for column, value in zip(columns, (anchor, fragment, doc, start)):
                        column.append(value)
                else:
                    docs.append(doc)
                    starts.append(start)
                    stops.append(start + len(fragment))
        for n in range(0, len(columns[0]), 1 << 14):
            part = [pa.array(c[n:n + (1 << 14)], k) for c, k in zip(columns, _KINDS)]
            yield pa.RecordBatch.from_arrays([*part, pa.nulls(len(part[0]), pa.int64())], names=_NAMES)
        if docs:
            doc, start, stop = _merged(np.array(docs), np.array(starts), np.array(stops))
            for n in range(0, len(doc), 1 << 16):
                part = [x[n:n + (1 << 16)] for x in (doc, start, stop)]
                yield pa.RecordBatch.from_arrays([pa.array(part[0]), pa.nulls(len(part[0]), pa.binary()), *map(pa.array, part)], names=_NAMES)

    def run(batches):
        held, hots, size = {}, set(), 0
        for got in batches:
            for doc, text, shared, hot, base in zip(*(got.column(n).to_pylist() for n in range(5))):
                hot = set(hot)
                shared = np.sort(np.array(shared, np.int64))
                for start, part in _slices(text.encode(), length):
                    place, hashed = anchors(part, length)
                    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
                    end = np.concatenate([first[1:], [len(place)]])
                    found = shared[np.minimum(np.searchsorted(shared, hashed), len(shared) - 1)] == hashed
                    for a, i, j in zip(hashed[found].tolist(), first[found].tolist(), end[found].tolist()):
                        key = a, part[i:j + length - 1]
                        known = held.get(key)
                        if known is None:
                            held[key] = [doc, base + start + i]
                            size += j - i + length + 200
                            if a in hot:
                                hots.add(a)
                                size += (j - i) * (length + 250)  # as so many windows
                        else:
                            known += doc, base + start + i
                            size += 64
                if size >= _HELD:
                    yield from rows(held, hots)
                    held, hots, size = {}, set(), 0
        yield from rows(held, hots)

    return run


def _merged(doc: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans, those of a document that touch united."""
    if not len(doc):
        return doc, start, stop
    order = np.lexsort((start, doc))
    doc, start, stop = doc[order], start[order], stop[order]
    # Places by their rank, so that documents can follow each other on one line without an overflow.
    place, ranks = np.unique(np.concatenate([start, stop]), return_inverse=True)
    begin, end, span = ranks[:len(start)], ranks[len(start):], len(place) + 1
    rank = np.cumsum(np.concatenate([[0], doc[1:] != doc[:-1]]))
    top = np.maximum.accumulate(end + rank * span)
    new = np.concatenate([[True], begin[1:] + rank[1:] * span > top[:-1]])
    new[1:] |= rank[1:] != rank[:-1]
    last = np.concatenate([np.flatnonzero(new)[1:] - 1, [len(doc) - 1]])
    return doc[new], start[new], place[top[last] - rank[last] * span]


def _least(fragments: list[bytes], anchor: np.ndarray, own: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For all windows of distinct fragments the smallest document (``own``: of each fragment) that has them; begins, numbers."""
    size = np.array([len(f) for f in fragments])
    windows = size - length + 1
    begin = np.cumsum(windows) - windows
    least = np.repeat(own, windows)
    # A fragment alone with its anchor has no equal windows elsewhere.
    _, group, members = np.unique(anchor, return_inverse=True, return_counts=True)
    mixed = np.flatnonzero(members[group] > 1)
    if len(mixed):
        text = np.frombuffer(b"".join([fragments[n] for n in mixed]) + bytes(length + 8), np.uint8)
        count, bytes_of = windows[mixed], size[mixed]
        inner = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        starts = np.repeat(np.cumsum(bytes_of) - bytes_of, count) + inner
        target = np.repeat(begin[mixed], count) + inner
        order = suffix_order(text, starts, length)
        first = np.flatnonzero(~same_before(text, starts[order], length))
        docs = least[target[order]]
        least[target[order]] = np.repeat(np.minimum.reduceat(docs, first), np.diff(np.concatenate([first, [len(order)]])))
    return least, begin, windows


def _judge(anchor: list, fragment: list, doc: list, start: list, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of the places whose windows are in a smaller document."""
    known: dict[tuple, int] = {}
    which = np.array([known.setdefault(key, len(known)) for key in zip(anchor, fragment)], np.int64)
    doc, start = np.array(doc, np.int64), np.array(start, np.int64)
    own = np.full(len(known), np.iinfo(np.int64).max)
    np.minimum.at(own, which, doc)
    least, begin, windows = _least([f for _, f in known], np.array([a for a, _ in known], np.int64), own, length)
    count = windows[which]
    row = np.repeat(np.arange(len(which)), count)
    inner = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    gone = least[begin[which][row] + inner] < doc[row]
    left = gone & np.concatenate([[True], ~gone[:-1] | (row[1:] != row[:-1])])
    right = gone & np.concatenate([~gone[1:] | (row[1:] != row[:-1]), [True]])
    return _merged(doc[row[left]], (start[row] + inner)[left], (start[row] + inner)[right] + length)


def _verdicts(length: int):
    """Spans (doc, start, stop). Rows come in the order of anchors; whole anchors are judged together, spans go through."""
    def out(doc, start, stop):
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (doc, start, stop)], names=["doc", "start", "stop"])

    def run(batches):
        held: list[list] = [[], [], [], []]
        size = 0
        for got in batches:
            known = pa.compute.is_valid(got.column(4))
            done = got.filter(known)
            if done.num_rows:
                yield out(done.column(2), done.column(3), done.column(4))
            got = got.filter(pa.compute.invert(known))
            for row in zip(*(got.column(n).to_pylist() for n in range(4))):
                if size >= _BLOCK and row[0] != held[0][-1]:
                    yield out(*_judge(*held, length))
                    held, size = [[], [], [], []], 0
                for column, value in zip(held, row):
                    column.append(value)
                size += len(row[1])
        if held[0]:
            yield out(*_judge(*held, length))

    return run


def _united(batches):
    """The spans of each document, united: doc, starts, ends."""
    for got in batches:
        starts, ends = [], []
        for s, e in zip(got.column(1).to_pylist(), got.column(2).to_pylist()):
            runs = united(np.array(s, np.int64), np.array(e, np.int64))
            starts.append([x for x, _ in runs])
            ends.append([x for _, x in runs])
        kind = pa.list_(pa.int64())
        yield pa.RecordBatch.from_arrays([got.column(0), pa.array(starts, kind), pa.array(ends, kind)], names=["doc", "starts", "ends"])


def united(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs that the intervals cover."""
    order = np.argsort(starts, kind="stable")
    starts, top = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate([[True], starts[1:] > top[:-1]])
    last = np.concatenate([np.flatnonzero(new)[1:] - 1, [len(starts) - 1]])
    return list(zip(starts[new].tolist(), top[last].tolist()))


def fragments_of(rows: DataFrame, length: int) -> DataFrame:
    """What documents (doc, text and perhaps base, the first place of the text) may share, by anchor, and spans that go for certain."""
    if "base" not in rows.columns:
        rows = rows.withColumn("base", F.lit(0).cast("long"))
    found = rows.select("doc", "text").mapInArrow(_anchor_rows(length), "hash long, doc long")
    shared = found.repartition("hash").mapInArrow(_shared(_HOT), "doc long, hash long, hot boolean")
    lists = shared.groupBy("doc").agg(F.collect_list("hash").alias("shared"), F.collect_list(F.when(F.col("hot"), F.col("hash"))).alias("hots"))
    return rows.join(materialize(lists), "doc").select("doc", "text", "shared", "hots", "base").mapInArrow(_fragments(length), FRAGMENTS)


def _hashes() -> list:
    return [F.xxhash64("text").alias("x"), F.xxhash64("text", F.lit(1)).alias("y")]


def repeats(docs: DataFrame, length: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Texts that go as a whole (doc, x, y: id and hashes of the text), spans of others (doc, starts, ends), and the first place of
    each text that shares its id with other texts (doc, x, y, base); None if there are none."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    rows = rows.where(F.col("doc").isNotNull() & (F.octet_length("text") >= length)).select("doc", "text", *_hashes())
    texts = materialize(rows.select("doc", "x", "y", F.octet_length("text").alias("n")))
    groups = texts.groupBy("x", "y", "n").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).where("least < most")
    copies = materialize(texts.join(groups, ["x", "y", "n"]).where("doc > least").select("doc", "x", "y").distinct())
    twins = texts.groupBy("doc").agg(F.count("*").alias("rows"), F.min(F.struct("x", "y")).alias("low"), F.max(F.struct("x", "y")).alias("high")).where("rows > 1 AND low <> high")
    twins = materialize(texts.join(twins.select("doc"), "doc").select("doc", "x", "y").distinct())
    bases = None
    if not twins.isEmpty():
        bases = materialize(twins.selectExpr("doc", "x", "y", f"(row_number() OVER (PARTITION BY doc ORDER BY x, y) - 1) * {_PLACES}L AS base"))
    rows = rows.join(_few(copies), ["doc", "x", "y"], "left_anti")
    rows = rows.withColumn("base", F.lit(0).cast("long")) if bases is None else rows.join(bases, ["doc", "x", "y"], "left").withColumn("base", F.coalesce("base", F.lit(0)))
    spans = fragments_of(rows.select("doc", "text", "base"), length).repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_verdicts(length), "doc long, start long, stop long")
    spans = spans.groupBy("doc").agg(F.collect_list("start").alias("starts"), F.collect_list("stop").alias("ends"))
    spans = spans.mapInArrow(_united, "doc long, starts array<long>, ends array<long>")
    return copies, materialize(spans), bases


def _few(rows: DataFrame) -> DataFrame:
    return F.broadcast(rows) if rows.count() <= _BROADCAST_ROWS else rows


_KEY, _SPANS = ["doc", "x", "y"], ["copy", "starts", "ends", "base"]


def _marked(docs: DataFrame, length: int, id_col: str, text_col: str) -> tuple[DataFrame, dict[str, str]]:
    """The rows with columns for a copy (boolean), lists of starts and ends of spans, and the text's first place; and those columns' names."""
    copies, spans, bases = repeats(docs, length, id_col, text_col)
    free = "_"
    while any(c.lower().startswith(free) for c in docs.columns):
        free += "_"
    mine = lambda c, side: f"{free}{side}_{c}"
    total = spans.agg(F.coalesce(F.sum(F.size("starts")), F.lit(0))).first()[0]
    hashed = docs.select("*", F.col(id_col).cast("long").alias(mine("doc", "own")), F.xxhash64(F.col(text_col).cast("string")).alias(mine("x", "own")),
                         F.xxhash64(F.col(text_col).cast("string"), F.lit(1)).alias(mine("y", "own")))

    def joined(rows: DataFrame, side: DataFrame, name: str, keys: list[str]) -> DataFrame:
        side = side.toDF(*[mine(c, name) for c in side.columns])
        return rows.join(side, [rows[mine(c, "own")] == side[mine(c, name)] for c in keys], "left")

    out = joined(hashed, _few(copies.withColumn("copy", F.lit(True))), "c", _KEY)
    out = joined(out, F.broadcast(spans) if total <= _BROADCAST_ROWS else spans, "s", ["doc"])
    out = out.withColumn(mine("base", "t"), F.lit(0).cast("long")) if bases is None else joined(out, bases, "t", _KEY)
    return out, {"copy": mine("copy", "c"), "starts": mine("starts", "s"), "ends": mine("ends", "s"), "base": mine("base", "t")}


def _cut(data: bytes, copy: bool | None, starts: list | None, ends: list | None, base: int | None, length: int) -> tuple[list, bytes]:
    """The spans that go, and what stays; the text's places begin at ``base``."""
    if copy and len(data) >= length:
        return [(0, len(data))], b""
    base = base or 0
    own = [(s - base, e - base) for s, e in zip(starts or [], ends or []) if base <= s < base + _PLACES] if len(data) >= length else []
    if not own:
        return [], data
    gone = united(*np.array(own, np.int64).T)
    kept, at = [], 0
    for start, end in gone:
        kept.append(data[at:start])
        at = end
    return gone, b"".join([*kept, data[at:]])


def report(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row."""
    def run(batches):
        for got in batches:
            rows = []
            for doc, text, *found in zip(*(got.column(n).to_pylist() for n in range(6))):
                data = (text or "").encode()
                gone, kept = _cut(data, *found, length)
                rows.append((doc, len(data), len(data) - len(kept), len(gone), hashlib.sha256(kept).hexdigest()))
            columns = zip(*rows) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [pa.int64()] * 4 + [pa.string()])],
                                             names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    marked, found = _marked(docs.select(id_col, text_col), length, id_col, text_col)
    return marked.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"), *[found[c] for c in _SPANS]).mapInArrow(
        run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def removed(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """The rows with repeats taken out of their text (and its length renewed); rows with nothing left are dropped.

    Bytes of a character that is cut in two go with it.
    """
    marked, found = _marked(docs, length, id_col, text_col)
    names, schema = docs.columns, docs.schema
    marked = marked.select(*[F.col(f"`{c}`") for c in names], *[found[c] for c in _SPANS])

    def run(batches):
        for got in batches:
            texts, gone = [], []
            for text, *spans in zip(got.column(names.index(text_col)).to_pylist(), *(got.column(len(names) + n).to_pylist() for n in range(len(_SPANS)))):
                cut, kept = ([], b"") if text is None else _cut(text.encode(), *spans, length)
                texts.append(kept.decode(errors="ignore") if cut else text)
                gone.append(bool(cut) and not texts[-1].strip())
            columns = dict(zip(names, got.columns))
            columns[text_col] = pa.array(texts, pa.string())
            if chars_col in columns:
                columns[chars_col] = pa.array([None if t is None else len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=names).filter(pa.compute.invert(pa.array(gone, pa.bool_())))

    return marked.mapInArrow(run, schema)
