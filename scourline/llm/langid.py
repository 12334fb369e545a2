"""Language identification by sparse multinomial logistic regression on TF-IDF character n-grams.

The letters of a text are lower-cased, all else between them becomes one space, and the 1- to 4-grams of what is left
are hashed into buckets. Logarithmic term frequencies times inverse document frequencies, scaled to length 1, are the
features. The weights are trained by follow-the-regularised-leader with elastic-net penalties, which keeps them sparse;
a temperature, fitted on rows kept out of the training, calibrates the probabilities.

A null text and one without a letter are ``und`` with score 0. A null language is not learnt from; languages that tie
resolve to the first by name. Without any language to learn, every text is ``und``. Repeated rows keep a row each;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 16
ORDERS = 4
_SPACE = 32
_FOLD: list[np.ndarray] = []


def _fold() -> np.ndarray:
    """For each code point its lower-case letter, or a space."""
    if not _FOLD:
        points = (chr(i) for i in range(0x110000))
        _FOLD.append(np.fromiter((ord(c.lower()[0]) if c.isalpha() else _SPACE for c in points), np.uint32, 0x110000))
    return _FOLD[0]


def letters(text: str) -> np.ndarray:
    """Folded code points with single spaces around and between words; empty without letters."""
    codes = _fold()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    codes = np.concatenate([[_SPACE], codes, [_SPACE]]).astype(np.uint32)
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != _SPACE) | (codes[:-1] != _SPACE)
    codes = codes[keep]
    return codes if len(codes) > 1 else codes[:0]


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the text's n-grams and how often each occurs. Long texts are counted a part at a time."""
    codes = letters(text or "")
    counts = np.zeros(BUCKETS, np.int64)
    step = 1 << 18
    for at in range(0, len(codes), step):
        part = codes[at : at + step + ORDERS - 1]
        for n in range(1, ORDERS + 1):
            own = min(step, len(part) - n + 1)
            if own <= 0:
                continue
            h = np.full(own, n, np.uint32)
            for i in range(n):
                h = (h ^ part[i : i + own]) * np.uint32(0x9E3779B1)
                h ^= h >> np.uint32(15)
            counts += np.bincount(h & np.uint32(BUCKETS - 1), minlength=BUCKETS)
    found = np.flatnonzero(counts)
    return found, counts[found]


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


@dataclass
class Model:
    langs: list[str]
    idf: np.ndarray
    weights: np.ndarray  # buckets x languages
    bias: np.ndarray
    temperature: float = 1.0

    def vector(self, found: np.ndarray, counts: np.ndarray) -> np.ndarray:
        x = (1 + np.log(counts)) * self.idf[found]
        return x / (np.sqrt(x @ x) or 1.0)

    def logits(self, found: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return self.vector(found, counts) @ self.weights[found] + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        found, counts = features(text)
        if not len(found) or not self.langs:
            return "und", 0.0
        p = softmax(self.logits(found, counts) / self.temperature)
        k = int(p.argmax())
        return self.langs[k], float(p[k])


def fit(rows: list[tuple[str, np.ndarray, np.ndarray]], epochs: int = 6, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.01, l2: float = 0.01, seed: int = 5) -> Model:
    """A model from (language, buckets, counts). A fifth of the rows, at least one, is kept out for the temperature."""
    langs = sorted({r[0] for r in rows})
    k = len(langs)
    seen = np.zeros(BUCKETS)
    for _, found, _ in rows:
        seen[found] += 1
    idf = (np.log((1 + len(rows)) / (1 + seen)) + 1).astype(np.float32)
    model = Model(langs, idf, np.zeros((BUCKETS, k), np.float32), np.zeros(k))
    if k < 2:
        return model
    y = np.array([langs.index(r[0]) for r in rows])
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(rows))
    held, train = order[: max(1, len(rows) // 5)], order[max(1, len(rows) // 5) :]
    x = [model.vector(r[1], r[2]) for r in rows]
    z, n = np.zeros((BUCKETS + 1, k)), np.zeros((BUCKETS + 1, k))  # the last row is the bias, which has no penalty

    def weights(at: np.ndarray) -> np.ndarray:
        own, sq = z[at], n[at]
        return np.where(np.abs(own) <= l1, 0.0, -(own - np.sign(own) * l1) / ((beta + np.sqrt(sq)) / alpha + l2))

    for _ in range(epochs):
        for i in rng.permutation(train):
            at = np.append(rows[i][1], BUCKETS)
            v = np.append(x[i], 1.0)
            w = weights(at)
            w[-1] = -z[BUCKETS] / ((beta + np.sqrt(n[BUCKETS])) / alpha)
            p = softmax(v @ w)
            p[y[i]] -= 1
            g = v[:, None] * p
            sq = n[at]
            z[at] += g - (np.sqrt(sq + g * g) - np.sqrt(sq)) / alpha * w
            n[at] = sq + g * g
    model.weights = weights(np.arange(BUCKETS)).astype(np.float32)
    model.bias = -z[BUCKETS] / ((beta + np.sqrt(n[BUCKETS])) / alpha)
    logits = np.stack([model.logits(rows[i][1], rows[i][2]) for i in held])
    grid = np.exp(np.linspace(-3.5, 2.5, 121))
    aim = np.full((len(held), k), 1 / (len(held) + 2) / (k - 1))  # smoothed, else a faultless fold asks for no temperature
    aim[np.arange(len(held)), y[held]] = 1 - 1 / (len(held) + 2)
    loss = [-(aim * np.log(softmax(logits / t) + 1e-300)).sum(axis=1).mean() for t in grid]
    model.temperature = float(grid[int(np.argmin(loss))])
    return model


def train(docs: DataFrame, most: int = 2000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options) -> Model:
    """A model from about ``most`` rows of ``docs``, as many of each language as there are, at most an equal share.

    Languages are counted over all rows; the rows are chosen by a hash of id and text, of equal ones one, and only the
    sparse counts of at most ``2 * most`` reach the driver.
    """
    known = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text")).where("lang is not null")
    sizes = {r["lang"]: r["count"] for r in known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most).collect()}
    share = max(1, most // max(1, len(sizes)))
    if not sizes:
        return fit([])
    wide = 1 << 30
    cuts = F.create_map(*[F.lit(v) for lang, n in sizes.items() for v in (lang, min(wide, wide * share // n))])
    marked = known.withColumn("mark", F.xxhash64("id", "text", F.lit(3)))
    chosen = marked.where(F.pmod("mark", F.lit(wide)) < cuts[F.col("lang")]).dropDuplicates(["lang", "mark"]).orderBy("mark", "lang").limit(2 * most).select("lang", "id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lang, text in zip(b.column(0), b.column(2)):
                found, counts = features(text.as_py())
                if len(found):
                    yield pa.RecordBatch.from_arrays([pa.array([lang.as_py()]), pa.array([found.tolist()], pa.list_(pa.int32())), pa.array([counts.tolist()], pa.list_(pa.int64()))], ["lang", "found", "counts"])

    rows = chosen.mapInArrow(run, "lang string, found array<int>, counts array<bigint>").toArrow()
    lists = zip(rows["lang"].to_pylist(), rows["found"], rows["counts"])
    rows = [(lang, np.array(f.values), np.array(c.values)) for lang, f, c in lists]
    rows.sort(key=lambda r: (r[0], len(r[1]), int(r[1].sum()), int(r[2].sum())))
    return fit(rows, **options)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(``id_col``, lang_pred, score) for every row."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shipped.value
        for b in batches:
            found = [own.predict(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], ["id", "lang_pred", "score"])

    few = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    return few.mapInArrow(run, "id bigint, lang_pred string, score double").withColumnRenamed("id", id_col)
