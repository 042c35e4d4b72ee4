"""Toxicity by a subsequence string kernel support vector machine on Nyström landmarks.

The kernel of two words sums over all common subsequences of ``ORDER`` characters, each weighted by ``DECAY`` to the length it
spans in both, and is normalised; so words agree in spite of gaps and inserted characters. A word becomes its kernels
with a set of landmark words, times the inverse root of the landmarks' own kernel matrix, and a linear support vector machine
gives it a margin. The largest margins of a text's sentences, three words' in all, go through a logistic curve to its score.

Labels are known for texts only, so the training is that of multiple instances, on a bounded sample of labelled texts: the first
witnesses are words that occur in several toxic texts and in no other, or far more often than in others (by the odds, ``ODDS``),
weighted by how many, with copies that have characters put in; the machine's own best words in clean texts join the other examples, and it is trained again. The landmarks are
witnesses unlike each other, the hardest other words and common ones.

Tokens are runs without white space, lower-cased, without other characters at their ends; runs of single letters are also read
as one word, and long tokens in overlapping windows. Null and empty texts have the margin of no word at all. Repeated rows are
scored alike. Without both kinds of labelled texts every score is the share of toxic ones, or 0. Only the named columns are read.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field
from functools import lru_cache
from heapq import nlargest
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ORDER, DECAY = 4, 0.7
_START, _END = "\x02", "\x03"  # stand around every word
_WINDOW, _STEP = 17, 8  # characters of a long token read together
_LETTERS = 56  # characters in a worker's table; subsequences with others are searched for
ODDS = 3.0  # least log-odds ratio of a witness that clean texts have too
TOP = 3  # words of a text that its score depends on
_KNOWN = 400_000  # margins of words kept by a worker
_EDGE = "".join(c for c in map(chr, range(0x3000)) if not c.isalpha() and not c.isspace())
_ASCII_EDGE = "".join(c for c in _EDGE if c.isascii())  # a short set strips faster


def _codes(words: list[str]) -> np.ndarray:
    """Code points, filled with zeros."""
    size = max(map(len, words), default=1)
    data = "".join(w.ljust(size, "\0") for w in words).encode("utf-32-le", "surrogatepass")
    return np.frombuffer(data, "<u4").reshape(len(words), size)


def _spread(size: int) -> np.ndarray:
    """[t, u]: the weight with which a match at t counts at u, behind it."""
    step = np.arange(size)[None, :] - np.arange(size)[:, None]
    return np.where(step > 0, DECAY ** np.maximum(step - 1, 0), 0).astype(np.float32)


def raw_kernel(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Unnormalised kernels of codes (n, l) with codes (m, t), or row by row if ``b`` is (n, 1, t)."""
    pairs = b if b.ndim == 3 else np.broadcast_to(b[None], (len(a), *b.shape))
    spread = _spread(pairs.shape[-1])
    # before[i]: weights of common subsequences of i + 1 characters that end before (this place, u), decayed up to there.
    before = [np.zeros(pairs.shape, np.float32) for _ in range(ORDER - 1)]
    total = np.zeros(pairs.shape[:2], np.float32)
    for n in range(a.shape[1]):
        match = (pairs == a[:, n, None, None]) & (pairs != 0)
        if not match.any():
            for part in before:
                part *= DECAY
            continue
        ends = [np.where(match, np.float32(DECAY ** 2), np.float32(0))]
        for part in before:
            ends.append(np.where(match, part * np.float32(DECAY ** 2), np.float32(0)))
        total += ends[-1].sum(-1)
        for part, end in zip(before, ends):
            part *= DECAY
            part += end @ spread
    return total


def norms(codes: np.ndarray) -> np.ndarray:
    return np.sqrt(raw_kernel(codes, codes[:, None, :])[:, 0])


@lru_cache(maxsize=64)
def _places(size: int) -> tuple[np.ndarray, np.ndarray]:
    """All choices of ORDER places out of ``size``, and the weight of each by the length it spans."""
    found = np.array(list(combinations(range(size), ORDER)), np.int64).reshape(-1, ORDER).T
    return found, (DECAY ** (found[-1] - found[0] + 1)).astype(np.float32)


class Landmarks:
    """Kernels with fixed words, through the words' own subsequences.

    A kernel is the product of two words' weights of all subsequences, and only those of the landmarks matter. So a word costs its
    subsequences and its norm; for a weighted sum of its kernels each subsequence has one weight, whatever the number of landmarks.
    """

    def __init__(self, words: list[str]):
        letters = [c for c, _ in Counter("".join(words)).most_common()]
        assert len(letters) < 1 << 15  # a key of four characters has 64 bits
        self.code = np.zeros(0x110000, np.uint16)
        for n, c in enumerate(letters):
            self.code[ord(c)] = n + 1
        self.every, self.size = len(letters) + 1, min(len(letters) + 1, _LETTERS)
        keys, marks, weights = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.float32)]
        for n, (word, norm) in enumerate(zip(words, norms(_codes(words)) if words else ())):
            places, decay = _places(len(word))
            keys.append(self._keys(self.code[_codes([word])], places, self.every, np.int64)[0])
            marks.append(np.full(len(decay), n))
            weights.append(decay / norm)
        self.keys, at = np.unique(np.concatenate(keys), return_inverse=True)
        self.features = np.zeros((len(self.keys) + 1, len(words)), np.float32)  # the last row is of all other subsequences
        np.add.at(self.features, (at, np.concatenate(marks)), np.concatenate(weights))
        # Subsequences of the most frequent characters have a place in a table.
        digits = [self.keys // self.every ** n % self.every for n in range(ORDER - 1, -1, -1)]
        frequent = np.all([d < self.size for d in digits], axis=0)
        small = np.zeros(int(frequent.sum()), np.int64)
        for d in digits:
            small = small * self.size + d[frequent]
        self.row = np.full(self.size ** ORDER, len(self.keys), np.int32)
        self.row[small] = np.flatnonzero(frequent)

    def _keys(self, codes: np.ndarray, places: np.ndarray, base: int, kind: type) -> np.ndarray:
        """Keys of four characters each, put together from those of all pairs of places."""
        codes, size = codes.astype(kind), codes.shape[1]
        pairs = (codes[:, :, None] * kind(base) + codes[:, None, :]).reshape(len(codes), -1)
        keys = np.take(pairs * kind(base * base), places[0] * size + places[1], 1)
        keys += np.take(pairs, places[2] * size + places[3], 1)
        return keys

    def _rows(self, codes: np.ndarray, places: np.ndarray) -> np.ndarray:
        """The feature of each subsequence of words that have all frequent characters, or all some other one."""
        own = self.code[codes]
        if own.size and own.max() < self.size:
            return self.row[self._keys(own, places, self.size, np.int32)]
        keys = self._keys(own, places, self.every, np.int64)
        at = np.minimum(np.searchsorted(self.keys, keys), max(0, len(self.keys) - 1))
        return np.where(self.keys[at] == keys, at, len(self.keys)) if len(self.keys) else np.zeros(keys.shape, np.int64)

    def _blocks(self, words: list[str]):
        """Indexes of words of one length, their codes, features and weights of their subsequences, in blocks."""
        lengths = np.array([len(w) for w in words])
        for size in np.unique(lengths[lengths >= ORDER]):
            places, decay = _places(int(size))
            own = np.flatnonzero(lengths == size)
            rare = (self.code[_codes([words[i] for i in own])] >= self.size).any(1)
            step = max(1, (1 << 19) // places.shape[1])
            for part in (own[~rare], own[rare]):
                for at in range(0, len(part), step):
                    rows = part[at:at + step]
                    codes = _codes([words[i] for i in rows])
                    yield rows, codes, self._rows(codes, places), decay

    def kernels(self, words: list[str]) -> np.ndarray:
        """Normalised kernels of words with each landmark; 0 for words shorter than the order."""
        out = np.zeros((len(words), self.features.shape[1]), np.float32)
        for rows, codes, at, decay in self._blocks(words):
            word, place = np.nonzero(at < len(self.keys))
            for part in range(0, len(word), 1 << 15):
                w, p = word[part:part + (1 << 15)], place[part:part + (1 << 15)]
                first = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]]))
                out[rows[w[first]]] += np.add.reduceat(self.features[at[w, p]] * decay[p, None], first)
            out[rows] /= np.maximum(norms(codes), 1e-12)[:, None]
        return out

    def sums(self, words: list[str], weights: np.ndarray) -> np.ndarray:
        """Weighted sums of the kernels."""
        out, value = np.zeros(len(words)), self.features @ weights.astype(np.float32)
        for rows, codes, at, decay in self._blocks(words):
            found = value[at] @ decay
            some = np.flatnonzero(found)
            if len(some):
                out[rows[some]] = found[some] / norms(codes[some])
        return out


def kernel(words: list[str], landmarks: list[str]) -> np.ndarray:
    return Landmarks(landmarks).kernels(words)


def words_of(text: str | None) -> list[str]:
    """The words of a text that a margin is asked for, each as often as it occurs."""
    tokens = (text or "").lower().split()
    single = [n for n, t in enumerate(tokens) if len(t) == 1]
    if not any(b - a == 2 for a, b in zip(single, single[2:])):
        return tokens
    found, run = tokens[:], []
    for token in [*tokens, "--"]:
        if len(token) == 1 and token.isalpha():
            run.append(token)
            continue
        if len(run) > 2:
            found.append("".join(run))
        run = []
    return found


def _plain(token: str) -> list[str]:
    """Words without their edges, long ones in windows."""
    word = token if token[:1].isalpha() and token[-1:].isalpha() else token.strip(_ASCII_EDGE if token.isascii() else _EDGE)
    if len(word) < ORDER - 2:
        return []
    word = _START + word + _END
    return [word] if len(word) <= _WINDOW else [word[n:n + _WINDOW] for n in range(0, len(word) - _WINDOW + _STEP, _STEP)]


@dataclass
class Model:
    landmarks: list[str]
    weights: np.ndarray  # for normalised kernels: the machine's weights behind the Nyström map
    bias: float
    slopes: np.ndarray = field(default_factory=lambda: np.zeros(TOP))
    shift: float = 0.0
    constant: float | None = None
    known: dict = field(default_factory=dict)  # of tokens
    plain: dict = field(default_factory=dict)  # of words without their edges, as tokens share them
    table: Landmarks | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"known": {}, "plain": {}, "table": None}

    def margins(self, words: list[str]) -> np.ndarray:
        if self.table is None:
            self.table = Landmarks(self.landmarks)
        return self.table.sums(words, self.weights) + self.bias

    def learn(self, tokens: set[str]) -> None:
        """Margins of tokens that are not known yet."""
        new = [t for t in tokens if t not in self.known]
        if not new:
            return
        parts = [_plain(t) for t in new]
        words = sorted({w for p in parts for w in p if w not in self.plain})
        if words:
            self.plain.update(zip(words, self.margins(words).tolist()))
        for token, part in zip(new, parts):
            self.known[token] = self.plain[part[0]] if len(part) == 1 else max((self.plain[w] for w in part), default=self.bias)

    def best(self, texts: list[str | None]) -> list[list[tuple[float, str | None]]]:
        """The ``TOP`` largest margins in each text, with their words."""
        tokens = [words_of(t) for t in texts]
        if len(self.known) > _KNOWN:
            self.known, self.plain = {}, {}
        self.learn(set().union(*tokens) if tokens else set())
        none, found = [(self.bias, None)] * TOP, []
        for own in tokens:
            margins = list(map(self.known.__getitem__, own))
            least = min(nlargest(TOP, margins), default=0.0)
            found.append((nlargest(TOP, [(m, t) for m, t in zip(margins, own) if m >= least]) + none)[:TOP])
        return found

    def score(self, margins: list[float]) -> float:
        if self.constant is not None:
            return self.constant
        return float(1 / (1 + np.exp(-np.clip(np.dot(self.slopes, np.clip(margins, -3, 3)) + self.shift, -500, 500))))


def _machine(x: np.ndarray, y: np.ndarray, weight: np.ndarray, cost: float = 10000.0, rounds: int = 40) -> tuple[np.ndarray, float]:
    """Linear support vector machine with squared hinge loss, classes weighted alike, by Newton's method. y is -1 or 1."""
    z = np.hstack([x, np.ones((len(x), 1))])
    weight = np.where(y > 0, weight / weight[y > 0].sum(), weight / weight[y < 0].sum()) * cost / 2
    ridge = np.eye(z.shape[1])
    ridge[-1, -1] = 1e-6
    w = np.zeros(z.shape[1])
    for _ in range(rounds):
        active = y * (z @ w) < 1
        za, wa = z[active], weight[active]
        new = np.linalg.solve(ridge + (za * wa[:, None]).T @ za, (za * (wa * y[active])[:, None]).sum(0))
        if np.abs(new - w).max() < 1e-6:
            break
        w = new
    return w[:-1], float(w[-1])


def choose_landmarks(witnesses: list[str], common: list[str], size: int, alike: float = 0.9) -> list[str]:
    """Witnesses, the strongest first, that are not nearly equal, then other words likewise."""
    chosen: list[str] = []
    for words, most in ((witnesses, size // 2), (common, size)):
        near = kernel(words, words) if words else None
        taken: list[int] = []
        for n in range(len(words)):
            if len(chosen) + len(taken) < most and (not taken or near[n, taken].max() < alike):
                taken.append(n)
        chosen += [words[n] for n in taken if words[n] not in chosen]
    return chosen


def _varied(words: dict[str, float], seed: int) -> dict[str, float]:
    """Each word with one and with two characters put in, with a quarter of its weight."""
    rng, out = np.random.default_rng(seed), {}
    marks = list(".-*_'+ xq0")
    for word, weight in words.items():
        for n in (1, 2):
            letters = list(word)
            for at in sorted(rng.integers(2, max(3, len(word) - 1), n), reverse=True):
                letters.insert(int(at), marks[int(rng.integers(len(marks)))])
            out["".join(letters)] = weight / 4
    return out


def fit(landmarks: list[str], positive: dict[str, float], negative: dict[str, float]) -> Model:
    """Train on words with their weights."""
    own = kernel(landmarks, landmarks).astype(float)
    values, vectors = np.linalg.eigh((own + own.T) / 2)
    root = vectors * (1 / np.sqrt(np.maximum(values, 1e-3))) @ vectors.T
    words = [*positive, *negative]
    x = kernel(words, landmarks).astype(float) @ root
    w, bias = _machine(x, np.array([1.0] * len(positive) + [-1.0] * len(negative)), np.array([*positive.values(), *negative.values()], float))
    return Model(landmarks, (root @ w).astype(np.float32), bias)


def _logistic(margins: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, float]:
    """Slopes and shift of a logistic curve, by damped Newton steps with Platt's targets."""
    ones, zeros = label.sum(), (1 - label).sum()
    target = np.where(label > 0, (ones + 1) / (ones + 2), 1 / (zeros + 2))
    z = np.hstack([np.clip(margins, -3, 3), np.ones((len(margins), 1))])
    w, small = np.zeros(z.shape[1]), 1e-3

    def loss(v):
        s = z @ v
        return (np.logaddexp(0, s) - target * s).sum() + small * v @ v

    for _ in range(100):
        p = 1 / (1 + np.exp(-z @ w))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + 2 * small * np.eye(len(w)), z.T @ (p - target) + 2 * small * w)
        size = 1.0
        while size > 1e-6 and loss(w - size * step) > loss(w):
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-9:
            break
    return w[:-1], float(w[-1])


def _best_words(docs: DataFrame, model: Model) -> list:
    """label, margins and best words of each text of a bounded sample (label, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for got in batches:
            found = shared.value.best(got.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([got.column(0), pa.array([[m for m, _ in f] for f in found], pa.list_(pa.float64())),
                                              pa.array([[w for _, w in f] for f in found], pa.list_(pa.string()))], names=["label", "margins", "words"])

    return docs.mapInArrow(run, "label int, margins array<double>, words array<string>").collect()


def train(docs: DataFrame, labels: DataFrame, learn: Column, per_class: int = 2500, landmarks: int = 256, negatives: int = 8000, rounds: int = 3, seed: int = 11,
          id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Train on about ``per_class`` labelled texts of each kind, drawn by a hash of the id from those where ``learn`` holds."""
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label")).where("label IN (0, 1)").groupBy("id").agg(F.max("label").alias("label"))
    counts = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return Model([], np.zeros(0), 0.0, constant=float(1 in counts))
    share = F.when(F.col("label") == 1, min(1.0, per_class / counts[1])).otherwise(min(1.0, per_class / counts[0]))
    known = known.where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30) < share)
    own = docs.where(learn).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    sample = own.join(F.broadcast(known), "id").select("label", "text").where(F.col("text").isNotNull())  # 2 * per_class ids
    edge = F.lit("".join(c for c in _EDGE if 31 < ord(c) < 128))
    trimmed = F.transform(F.split(F.lower("text"), r"\s+"), lambda w: F.btrim(w, edge))
    words = sample.select("label", F.explode(F.array_distinct(trimmed)).alias("word")).where(F.length("word").between(ORDER - 2, _WINDOW - 2))  # a text counts once
    counted = words.groupBy("word").agg(F.sum("label").alias("toxic"), F.sum(1 - F.col("label")).alias("clean")).persist()
    size = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(size) < 2:
        counted.unpersist()
        return Model([], np.zeros(0), 0.0, constant=float(1 in size))
    least = max(3, size[1] // 200)

    def odds(toxic: float, clean: float) -> float:
        return float(np.log((toxic + 0.5) / (max(size[1] - toxic, 0) + 0.5) * (max(size[0] - clean, 0) + 0.5) / (clean + 0.5)))

    ratio = F.log((F.col("toxic") + 0.5) / (F.lit(size[1]) - F.col("toxic") + 0.5) * (F.lit(size[0]) - F.col("clean") + 0.5) / (F.col("clean") + 0.5))
    telling = (F.col("toxic") >= least) & ((F.col("clean") == 0) | (ratio >= ODDS))
    marked = lambda rows, n: {_START + r["word"] + _END: float(r[n]) for r in rows.collect()}
    witnesses = marked(counted.where(telling).orderBy(F.desc("toxic"), "word").limit(600), "toxic")
    common = marked(counted.where(~telling & (F.col("clean") > 0)).orderBy(F.desc("clean"), "word").limit(400), "clean")
    other = marked(counted.where(~telling & (F.col("clean") > 0)).orderBy(F.xxhash64("word", F.lit(seed)), "word").limit(negatives), "clean")
    counted.unpersist()
    if not witnesses:
        return Model([], np.zeros(0), 0.0, constant=size[1] / (size[0] + size[1]))
    positive = witnesses | _varied(witnesses, seed)
    negative = {w: n ** 0.5 for w, n in (other | common).items()}
    model = fit(choose_landmarks(list(witnesses), list(common), landmarks), positive, negative)
    for _ in range(rounds):  # the best words of clean texts are the hardest examples
        hard = Counter()
        for r in _best_words(sample.where("label = 0"), model):
            hard.update(w for t in dict.fromkeys(r["words"]) if t for w in _plain(t))
        hard = {w: n for w, n in hard.items() if w not in witnesses or odds(witnesses[w], n) < ODDS}  # a witness stays one in spite of a few clean texts
        for w, n in hard.items():
            negative[w] = max(negative.get(w, 0.0), n ** 0.5)
        margin = dict(zip(hard, model.margins(list(hard))))
        hardest = sorted(hard, key=lambda w: (-margin[w], w))
        positive = {w: n for w, n in positive.items() if w not in negative}
        model = fit(choose_landmarks([w for w in witnesses if w in positive], hardest[:landmarks] + list(common), landmarks), positive, negative)
    found = _best_words(sample, model)
    model.slopes, model.shift = _logistic(np.array([r["margins"] for r in found]), np.array([float(r["label"]) for r in found]))
    return model


def predict(docs: DataFrame, model: Model, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for got in batches:
            own = shared.value
            texts = got.column(2).to_pylist()
            scores = []
            for n in range(0, len(texts), 256):
                part = texts[n:n + 256]
                scores += [own.score([m for m, _ in f]) for f in own.best(part)] if own.constant is None else [own.constant] * len(part)
            yield pa.RecordBatch.from_arrays([got.column(0), got.column(1), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())],
                                             names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out.alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
