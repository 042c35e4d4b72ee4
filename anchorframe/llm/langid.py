"""Language identification: averaged hashed subword embeddings under a linear softmax.

A text's letters, lower-cased, with one mark for every run of other characters, give all n-grams of one to four
characters inside words and at their edges. Each is hashed to a row of an embedding table; the mean of the rows goes
through a linear softmax. Table and softmax are trained together by stochastic gradient descent in numpy on windows of
a bounded sample of labelled rows, of many lengths, so that short texts are known too. A fifth of the windows is held
back: on them a temperature is fitted, which calibrates the scores, and the score below which a text is rejected.

For prediction the two layers are multiplied out once (a score for each hash row and language), and whole texts are
read. A null text, or one without a letter, gets ``und`` and score 0 and is rejected. Rows without a label teach nothing;
without any labelled text every text is ``und``. Repeated rows are scored alike, equal scores take the first language in
alphabetical order. Only the named columns are read, so other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROWS = 1 << 16
_CHUNK = 1 << 18  # characters looked at together
_LETTER: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """For each code point whether it is a letter."""
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _LETTER[0]


def grams(text: str) -> np.ndarray:
    """Hash rows of the n-grams of a text, of a chunk at most."""
    code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    code = np.where(_letters()[code], code, 0)
    code = np.concatenate([[0], code, [0]])
    code = code[(code != 0) | np.concatenate([[True], code[:-1] != 0])].astype(np.uint64)
    if len(code) < 3:
        return np.zeros(0, np.int64)
    inside, parts = code != 0, []
    total = code * np.uint64(0x9E3779B97F4A7C15)
    parts.append(total[inside])
    kept = np.ones(len(code), bool)
    for n in range(2, 5):
        if len(code) < n:
            break
        total = total[:-1] * np.uint64(0xD6E8FEB86659FD93) + code[n - 1:] * np.uint64(0x9E3779B97F4A7C15)
        kept = kept[:-1] & (inside[n - 2:-1] if n > 2 else True)
        parts.append(total[kept])
    mixed = np.concatenate(parts)
    mixed ^= mixed >> np.uint64(29)
    return ((mixed * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(48)).astype(np.int64)


@dataclass
class Model:
    languages: list[str]
    scores: np.ndarray  # hash row x language
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, calibrated score and whether the text is rejected."""
        if not text or not self.languages:
            return "und", 0.0, True
        total, n = np.zeros(len(self.languages)), 0
        for at in range(0, len(text), _CHUNK):
            rows = grams(text[at:at + _CHUNK])
            if len(rows):
                seen = np.bincount(rows, minlength=ROWS) if len(rows) > ROWS else None
                total += seen @ self.scores if seen is not None else self.scores[rows].sum(0, dtype=np.float64)
                n += len(rows)
        if not n:
            return "und", 0.0, True
        p = _softmax((total / n + self.bias)[None, :] / self.temperature)[0]
        best = int(p.argmax())
        return self.languages[best], float(p[best]), bool(p[best] < self.threshold)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _calibrate(logits: np.ndarray, labels: np.ndarray, lost: float) -> tuple[float, float]:
    """Temperature of least log loss; the score that at most a share ``lost`` of the windows falls below."""
    choices = np.geomspace(0.05, 5, 60)
    loss = [-np.log(np.maximum(_softmax(logits / t)[np.arange(len(labels)), labels], 1e-300)).mean() for t in choices]
    t = float(choices[int(np.argmin(loss))])
    best = np.sort(_softmax(logits / t).max(1))
    return t, float(min(0.5, best[int(lost * len(best))]))


def fit(windows: list[tuple[str, str]], width: int = 16, passes: int = 800, rate: float = 3.0, batch: int = 32, lost: float = 0.001,
        seed: int = 17) -> Model:
    """Train on (text, language) windows, ``passes`` batches of them."""
    languages = sorted({lang for _, lang in windows})
    rng = np.random.default_rng(seed)
    data = [(rows, languages.index(lang)) for text, lang in windows if len(rows := grams(text))]
    if not data:
        return Model([], np.zeros((ROWS, 0), np.float32), np.zeros(0))
    rng.shuffle(data)
    held, data = data[:len(data) // 5], data[len(data) // 5:]
    table = rng.normal(0, 1 / width, (ROWS, width)).astype(np.float32)
    out, bias = np.zeros((width, len(languages)), np.float32), np.zeros(len(languages), np.float32)
    steps, step = passes, 0
    while step < steps:
        order = rng.permutation(len(data))
        for at in range(0, min(len(data), (steps - step) * batch), batch):
            own = [data[i] for i in order[at:at + batch]]
            rows, sizes = np.concatenate([r for r, _ in own]), np.array([len(r) for r, _ in own])
            labels = np.array([k for _, k in own])
            mean = np.add.reduceat(table[rows], np.concatenate([[0], np.cumsum(sizes)[:-1]])) / sizes[:, None]
            wrong = _softmax(mean @ out + bias)
            wrong[np.arange(len(own)), labels] -= 1
            now = rate * (1 - step / steps)
            pull = (wrong @ out.T) / sizes[:, None]
            out -= (now / len(own)) * (mean.T @ wrong).astype(np.float32)
            bias -= (now / len(own)) * wrong.sum(0).astype(np.float32)
            np.add.at(table, rows, np.repeat((-now * pull).astype(np.float32), sizes, axis=0))
            step += 1
    scores = table @ out
    model = Model(languages, scores, bias.astype(np.float64))
    check = held or data
    logits = np.array([scores[r].sum(0, dtype=np.float64) / len(r) + bias for r, _ in check])
    model.temperature, model.threshold = _calibrate(logits, np.array([k for _, k in check]), lost)
    return model


def train(docs: DataFrame, learn: Column, per_language: int = 400, seed: int = 17, id_col: str = "doc_id", text_col: str = "text",
          lang_col: str = "lang") -> Model:
    """Train on windows of about ``per_language`` rows of each language, of those where ``learn`` holds.

    Rows are taken by a hash of id and text, and each gives one window of 16 to 400 characters from anywhere in it, so the
    sample is bounded whatever the table's size and the texts' lengths.
    """
    text, lang = F.col(text_col).cast("string"), F.col(lang_col).cast("string")
    rows = docs.where(learn & text.isNotNull() & lang.isNotNull()).select(
        text.alias("text"), lang.alias("lang"), F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one row a language
    if not counts:
        return fit([])
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, per_language / n))])
    drawn = lambda n: F.pmod(F.xxhash64("id", F.length("text"), F.lit(seed + n)), F.lit(1 << 30)) / float(1 << 30)
    size = (16 * F.pow(F.lit(25.0), drawn(1))).cast("int")
    first = (F.greatest(F.length("text") - size, F.lit(0)) * drawn(2)).cast("int") + 1
    sample = rows.where(drawn(0) < share[F.col("lang")]).select(F.substring("text", first, size).alias("text"), "lang")
    return fit(sorted((r["text"], r["lang"]) for r in sample.collect()), seed=seed)


SCORED = "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean"


def _scorer(docs: DataFrame, model: Model) -> Callable:
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return lambda texts: [shared.value.predict(t) for t in texts]


def predict(docs: DataFrame, model: Model, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Language, calibrated score and rejection of every row."""
    score = _scorer(docs, model)

    def run(batches):
        for got in batches:
            lang, p, no = zip(*score(got.column(2).to_pylist())) if got.num_rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([got.column(0), got.column(1), pa.array(lang, pa.string()), pa.array(p, pa.float64()), pa.array(no, pa.bool_())],
                                             names=["doc_id", "held_out", "lang_pred", "score", "rejected"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out.alias("held_out"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, SCORED)


def keep_known(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, that the model does not reject."""
    score, at = _scorer(docs, model), docs.columns.index(text_col)

    def run(batches):
        for got in batches:
            yield got.filter(pa.array([not no for _, _, no in score(got.column(at).to_pylist())], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
