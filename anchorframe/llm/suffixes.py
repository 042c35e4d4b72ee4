"""Suffix order of a text, one bucket of suffixes at a time, with ranks of a difference-cover sample.

For the cover D of a period v, any two positions i and j have an offset below v that puts both i + offset and j + offset into
the sample (positions that are in D modulo v). The sample's suffixes are ranked first, by doubling: positions v, 2v, 4v ... ahead
are in the sample again. Then the suffixes asked for are cut into buckets by their first bytes, and one bucket is sorted at a
time: by the first v bytes, and where those tie by the sample's ranks at the offsets of the two positions. So however long
suffixes agree, a comparison takes one rank, and beside the text and the ranks only one bucket is held.
"""

from __future__ import annotations

import numpy as np

PERIOD = 7
COVER = (0, 1, 3)  # a difference cover of 7: every difference modulo 7 occurs
_BUCKET = 1 << 18


def offsets() -> np.ndarray:
    """offset[a, b]: added to positions that are a and b modulo the period, it puts both into the sample."""
    table = np.zeros((PERIOD, PERIOD), np.int64)
    for a in range(PERIOD):
        for b in range(PERIOD):
            table[a, b] = next(d for d in range(PERIOD) if (a + d) % PERIOD in COVER and (b + d) % PERIOD in COVER)
    return table


_OFFSET = offsets()


def heads(text: np.ndarray) -> np.ndarray:
    """The first seven bytes from each position, as one number in the order of the bytes. ``text`` ends in zeros."""
    total = np.zeros(len(text) - PERIOD + 1, np.uint64)
    for n in range(PERIOD):
        total = (total << np.uint64(8)) | text[n:len(text) - PERIOD + 1 + n].astype(np.uint64)
    return total


def _dense(keys: np.ndarray) -> np.ndarray:
    """Ranks from 1; equal keys have equal ranks."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    rank = np.empty(len(keys), np.int64)
    rank[order] = np.cumsum(np.concatenate([[1], ordered[1:] != ordered[:-1]]))
    return rank


def sample_ranks(head: np.ndarray, depth: int) -> np.ndarray:
    """For each position of the sample its rank by at least ``depth`` bytes, 0 elsewhere and behind the end."""
    n = len(head)
    inside = np.flatnonzero(np.isin(np.arange(n) % PERIOD, COVER))
    ranks = np.zeros(n + 8 * depth, np.int64)
    ranks[inside] = _dense(head[inside])
    reach = PERIOD
    while reach < depth:
        ranks[inside] = _dense(ranks[inside] * (len(inside) + 1) + ranks[inside + reach])
        reach *= 2
    return ranks


def _below(at: np.ndarray, group: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """How many suffixes of its group each suffix comes after, by sample ranks."""
    residue = at % PERIOD
    classes = [np.flatnonzero(residue == r) for r in range(PERIOD)]
    place, top = np.zeros(len(at), np.int64), int(ranks.max()) + 1
    for b, other in enumerate(classes):
        sorted_by: dict[int, np.ndarray] = {}
        for a, own in enumerate(classes):
            if len(own) and len(other):
                d = int(_OFFSET[a, b])
                if d not in sorted_by:
                    sorted_by[d] = np.sort(group[other] * top + ranks[at[other] + d])
                base = group[own] * top
                place[own] += np.searchsorted(sorted_by[d], base + ranks[at[own] + d]) - np.searchsorted(sorted_by[d], base)
    return place


def suffix_order(text: np.ndarray, starts: np.ndarray, depth: int, bucket: int = _BUCKET) -> np.ndarray:
    """Indexes of ``starts`` in the order of their suffixes by at least ``depth`` bytes; ``text`` ends in ``depth`` zeros or more."""
    head = heads(text)
    ranks = sample_ranks(head, depth)
    own = head[starts]
    splits = np.sort(own)[bucket::bucket] if len(own) > bucket else own[:0]
    bucket_of = np.searchsorted(np.unique(splits), own, "right")
    out = []
    for n in range(int(bucket_of.max(initial=-1)) + 1):
        part = np.flatnonzero(bucket_of == n)
        part = part[np.argsort(own[part], kind="stable")]
        first = own[part]
        new = np.concatenate([[True], first[1:] != first[:-1]])
        group = np.cumsum(new)
        tied = ~new | np.concatenate([~new[1:], [False]])
        place = np.zeros(len(part), np.int64)
        place[tied] = _below(starts[part[tied]], group[tied], ranks)
        out.append(part[np.lexsort((place, group))])
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def same_before(text: np.ndarray, ordered: np.ndarray, depth: int) -> np.ndarray:
    """Whether each suffix agrees with the one before it in ``depth`` bytes."""
    same = np.ones(len(ordered), bool)
    same[:1] = False
    left = np.flatnonzero(same)
    head = heads(text)
    for at in [*range(0, depth - PERIOD, PERIOD), depth - PERIOD]:
        equal = head[ordered[left] + at] == head[ordered[left - 1] + at]
        same[left[~equal]] = False
        left = left[equal]
    return same
