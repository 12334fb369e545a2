"""Toxicity scores from subword-bag embeddings.

A word is the bag of its character n-grams with word ends marked. The bag's embeddings are averaged and a linear
softmax tells toxic from clean; embeddings and softmax are trained jointly, in numpy, from document labels only. One
insult must count in a text of twenty thousand words, so bags are words, not documents: a document is toxic as soon as
one of its words is (a noisy-or over words while training, the largest word logit when scoring). A logistic
calibration on rows kept out of the training turns that logit into the score. A misspelling that no training text
holds shares n-grams, and so most of its vector, with the word it comes from.

Null and empty texts have no words and get the score of the lowest logit. Without labels of both kinds the score is
the share of toxic labels (0 without any). Repeated rows keep a row each; a document with several labels is toxic if
one says so; rows without a label or an id are scored but not learnt from. Other columns are ignored.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EDGES = re.compile(r"^[\W_]+|[\W_]+$")
#: Words of more characters are cut into overlapping parts.
LONG = 32
REMEMBERED = 150_000


def pieces(token: str) -> list[str]:
    """The marked words of a lower-case token: without punctuation around it, long ones in overlapping parts."""
    word = EDGES.sub("", token)
    if not word:
        return []
    if len(word) <= LONG:
        return [f"<{word}>"]
    return [f"<{word[i : i + LONG]}>" for i in range(0, len(word) - LONG // 2, LONG // 2)]


def grams(word: str, least: int, most: int) -> list[str]:
    return [word[i : i + n] for n in range(least, most + 1) for i in range(len(word) - n + 1)] or [word]


@dataclass
class Model:
    least: int = 3
    most: int = 5
    weights: dict[str, float] = field(default_factory=dict)  # an n-gram's embedding seen along the softmax's margin
    bias: float = 0.0
    slope: float = 0.0
    offset: float = 0.0
    floor: float = 0.0  # the logit of a text without words
    known: dict[str, float] = field(default_factory=dict, repr=False, compare=False)

    def logit(self, token: str) -> float:
        """The largest logit among the token's words."""
        found = self.known.get(token)
        if found is None:
            found = self.floor
            of = self.weights.get
            for word in pieces(token):
                bag = grams(word, self.least, self.most)
                found = max(found, sum([of(g, 0.0) for g in bag]) / len(bag) + self.bias)
            if len(self.known) > REMEMBERED:
                self.known.clear()
            self.known[token] = found
        return found

    def score(self, text: str) -> float:
        best = max(map(self.logit, set(text.lower().split())), default=self.floor)
        return float(1 / (1 + np.exp(-np.clip(self.slope * best + self.offset, -40, 40))))


def _calibrate(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic regression of y on x with smoothed targets, by Newton steps."""
    n1, n0 = y.sum(), (1 - y).sum()
    t = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    center, scale = x.mean(), x.std() + 1e-9
    z = np.stack([(x - center) / scale, np.ones(len(x))])
    w = np.zeros(2)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(w @ z, -30, 30)))
        h = (z * (p * (1 - p))) @ z.T + 1e-3 * np.eye(2)
        w = w + np.linalg.solve(h, z @ (t - p) - 1e-3 * w)
    return float(w[0] / scale), float(w[1] - w[0] * center / scale)


def fit(docs: list[list[str]], labels: list[int], size: int = 8, epochs: int = 12, batch: int = 128, steps: int = 300, drop: float = 0.5, lose: float = 0.3, rate: float = 0.08, decay: float = 2e-6, seed: int = 7, least: int = 3, most: int = 5) -> Model:
    """A model from lists of distinct lower-case tokens. A fifth of the documents is kept out for the calibration.

    Words of toxic documents are dropped at random, so that an insult that mostly stands beside others is learnt too, and
    n-grams (``lose`` of them) so that a word doesn't hang on a few of its own.
    Small samples get smaller batches and more epochs, ``steps`` batches at least.
    """
    y = np.array(labels, dtype=float)
    if not len(y) or y.min() == y.max():
        share = y.mean() if len(y) else 0.0
        return Model(least, most, offset=float(np.log((share + 1e-6) / (1 - share + 1e-6))))
    rng = np.random.default_rng(seed)
    word_ids: dict[str, int] = {}
    bags = [np.unique([word_ids.setdefault(w, len(word_ids)) for t in d for w in pieces(t)]).astype(np.int64) for d in docs]
    gram_ids: dict[str, int] = {}
    packed, ends = array("i"), array("q")
    for w in word_ids:
        packed.extend([gram_ids.setdefault(g, len(gram_ids)) for g in grams(w, least, most)])
        ends.append(len(packed))
    flat = np.frombuffer(packed, np.int32)
    lens = np.diff(np.frombuffer(ends, np.int64), prepend=0)
    starts = np.cumsum(lens) - lens
    order = rng.permutation(len(y))
    kept_out = np.zeros(len(y), bool)
    for k in (0, 1):  # of each label
        own = order[y[order] == k]
        kept_out[own[: len(own) // 5]] = True
    train = np.flatnonzero(~kept_out & np.array([len(b) > 0 for b in bags]))

    embed = rng.normal(0, 0.1, (len(gram_ids), size))
    out = rng.normal(0, 0.5, (size, 2))
    bias = np.array([0.0, -4.0])
    square = [np.full(p.shape, 1e-8) for p in (embed, out, bias)]

    def segment(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = lens[words]
        at = np.repeat(starts[words] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return flat[at], n

    def logits(words: np.ndarray) -> np.ndarray:
        g, n = segment(words)
        v = embed @ (out[:, 1] - out[:, 0])
        return np.add.reduceat(v[g], np.cumsum(n) - n) / n + bias[1] - bias[0]

    batch = max(16, min(batch, len(train) // 20))
    batches = max(1, len(train) // batch)
    for epoch in range(max(epochs, -(-steps // batches)) if len(train) else 0):
        for some in np.array_split(rng.permutation(train), batches):
            cut = [bags[i] for i in some]
            if epoch > 1:
                cut = [b[rng.random(len(b)) >= drop] if y[i] > 0 and len(b) > 1 else b for i, b in zip(some, cut)]
                some, cut = some[[len(b) > 0 for b in cut]], [b for b in cut if len(b)]
            sizes = np.array([len(b) for b in cut])
            every = np.concatenate(cut)
            words, inverse = np.unique(every, return_inverse=True)
            g, n = segment(words)
            margin = out[:, 1] - out[:, 0]
            alive = (rng.random(len(gram_ids)) >= lose) / (1 - lose)
            s = (np.add.reduceat((embed @ margin * alive)[g], np.cumsum(n) - n) / n + bias[1] - bias[0])[inverse]
            p = 1 / (1 + np.exp(-np.clip(s, -30, 30)))
            begin = np.cumsum(sizes) - sizes
            clean = np.exp(np.add.reduceat(-np.logaddexp(0, s), begin))  # chance that no word is toxic
            pull = np.where(y[some] > 0, -clean / np.maximum(1 - clean, 1e-6), 1.0)
            delta = p * np.repeat(pull, sizes) / len(some)
            per_word = np.bincount(inverse, delta, len(words)) / n
            per_gram = np.bincount(g, np.repeat(per_word, n), len(gram_ids)) * alive
            ds = delta.sum()
            d_margin = embed.T @ per_gram
            for param, grad, sq in zip((embed, out, bias), (np.outer(per_gram, margin) + decay * embed, np.stack([-d_margin, d_margin], 1), np.array([-ds, ds])), square):
                sq *= 0.98
                sq += 0.02 * grad * grad
                param -= rate * grad / (np.sqrt(sq) + 1e-4)
    margin = out[:, 1] - out[:, 0]
    v = embed @ margin
    model = Model(least, most, {g: float(v[i]) for g, i in gram_ids.items()}, float(bias[1] - bias[0]))
    s = logits(np.arange(len(word_ids)))
    model.floor = float(min(s.min(), model.bias))
    best = np.array([s[b].max() if len(b) else model.floor for b in bags])
    model.slope, model.offset = _calibrate(best[kept_out], y[kept_out])
    return model


def bucket(id_col: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``."""
    return F.crc32(id_col.cast("string")) % folds


def sample(docs: DataFrame, labels: DataFrame, most: int, id_col: str, text_col: str, label_col: str, learn: Column | None) -> tuple[list[list[str]], list[int]]:
    """Distinct tokens and labels of at most ``most`` labelled documents, a third of them toxic if there are as many.

    Ids are chosen by a hash; only the distinct tokens of their texts reach the driver, of at most ``2 * most`` different
    rows however often an id occurs.
    """
    own = labels.select(F.col(id_col).cast("bigint").alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y is not null")
    own = own.where(learn) if learn is not None else own
    own = own.groupBy("id").agg(F.max("y").alias("y")).withColumn("h", F.xxhash64("id", F.lit(11)))
    ids = own.where("y = 1").orderBy("h").limit(most // 3).union(own.where("y = 0").orderBy("h").limit(most - most // 3))

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [sorted(set((t.as_py() or "").lower().split())) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(found, pa.list_(pa.string()))], ["id", "y", "tokens"])

    few = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    few = few.join(F.broadcast(ids.select("id", "y")), "id").select("id", "text", "y", F.xxhash64("text").alias("mark"))  # ids: most at most
    few = few.dropDuplicates(["id", "mark"]).orderBy("id", "mark").limit(2 * most)
    rows = few.select("id", "text", "y").mapInArrow(tokens, "id bigint, y int, tokens array<string>").toArrow()
    one: dict[str, str] = {}  # a token that many documents share is held once
    found = [(i, y, [one.setdefault(t, t) for t in x.as_py()]) for i, y, x in zip(rows["id"].to_pylist(), rows["y"].to_pylist(), rows["tokens"])]
    found.sort(key=lambda r: (r[0], r[2]))
    return [r[2] for r in found], [r[1] for r in found]


def train(docs: DataFrame, labels: DataFrame, most: int = 3000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", learn: Column | None = None, **options) -> Model:
    """A model from at most ``most`` labelled documents. ``learn`` restricts the labels by their ``id``."""
    return fit(*sample(docs, labels, most, id_col, text_col, label_col, learn), **options)


def scores(docs: DataFrame, model: Model, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(``id_col``, score, predicted) for every row."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = shipped.value.score
        for b in batches:
            s = [score(t.as_py() or "") for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64()), pa.array([int(x >= threshold) for x in s], pa.int32())], ["id", "score", "predicted"])

    few = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    return few.mapInArrow(run, "id bigint, score double, predicted int").withColumnRenamed("id", id_col)


def keep_clean(docs: DataFrame, model: Model, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that score ``threshold`` or more; the columns stay."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    schema, at = docs.schema, docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = shipped.value.score
        for b in batches:
            yield b.filter(pa.array([score(t.as_py() or "") < threshold for t in b.column(at)], pa.bool_()))

    return docs.mapInArrow(run, schema)
