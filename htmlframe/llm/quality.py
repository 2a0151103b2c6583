"""Quality classifier on supervised subword embeddings.

The features of a text are its words, the character n-grams of 3 to 5 characters within words (a white space may stand at
either end), and the pairs of neighbouring words, each hashed to one of BUCKETS vectors. A pair is hashed by both
of its words in order. A document is the mean of its features' vectors; a softmax layer gives the probability of each label. Vectors and layer are learned together by stochastic gradient
descent in numpy on a sample of labelled rows of at most 2 * PER_CLASS documents. As the layer is linear in the mean,
scoring folds it into the vectors: the difference of the two outputs is the mean of one number for each feature.

Null and empty texts have no features and get the score of the layer's bias alone. If one label or all labels are
missing, the score is 0.5 plus or minus what the bias has learned, so every row still gets one. Texts are read whole, in
blocks. Repeated rows get the same score each; an empty table gives no rows. Only the id and text columns are read, so
others and their names don't matter.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from htmlframe.llm.common import prepare, table
from htmlframe.llm.labelled import held_out, learned

BUCKETS, DIM, EPOCHS, RATE = 1 << 17, 12, 4, 16.0
PER_CLASS = 1200
NGRAMS = (3, 4, 5)
#: Characters of a text featurised at a time.
BLOCK = 1 << 18
_P = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.cumprod(np.full(4096, 0x100000001B3, np.uint64))
# White space.
_SPACE = np.zeros(33, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _spread(h: np.ndarray, salt: int) -> np.ndarray:
    h = (h + np.uint64(salt)) * _P
    return ((h ^ (h >> np.uint64(29))) >> np.uint64(20)).astype(np.int64) & (BUCKETS - 1)


def features(text: str) -> np.ndarray:
    """Bucket numbers of the features of a block of text, with repeats."""
    x = np.frombuffer(f" {text} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    space = _SPACE[np.minimum(x, 32)] & (x <= 32)
    x = np.where(space, np.uint32(32), x).astype(np.uint64)
    out = []
    inner = np.concatenate([[0], np.cumsum(space)])
    for n in NGRAMS:
        m = len(x) - n + 1
        if m <= 0:
            continue
        h = np.zeros(m, np.uint64)
        for j in range(n):
            h += x[j : j + m] * _POWERS[j]
        whole = inner[n - 1 : n - 1 + m] == inner[1 : m + 1]  # no white space but at the ends
        out.append(_spread(h[whole], n))
    starts = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    if len(starts):
        place = np.arange(len(x))
        begin = np.zeros(len(x), np.int64)
        begin[starts] = starts
        at = (place - np.maximum.accumulate(begin)) & 4095
        words = np.add.reduceat(np.where(space, np.uint64(0), (x + np.uint64(1)) * _POWERS[at]), starts)
        out += [_spread(words, 1), _spread(words[:-1] * _P + words[1:], 2)]
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def blocks(text: str) -> Iterator[str]:
    """A text in blocks that end at white space where there is one."""
    at = 0
    while at < len(text):
        end = at + BLOCK
        if end < len(text):
            cut = max(text.rfind(" ", at, end), text.rfind("\n", at, end))
            end = cut + 1 if cut > at else end
        yield text[at:end]
        at = end


class SubwordClassifier:
    """Folded model: the logit of label 1 is bias plus the mean of weight over a text's features."""

    def __init__(self, weight: np.ndarray, bias: float):
        self.weight, self.bias = weight.astype(np.float32), float(bias)

    def score(self, text: str | None) -> float:
        total, n = 0.0, 0
        for part in blocks(text or ""):
            f = features(part)
            total += float(self.weight[f].sum(dtype=np.float64))
            n += len(f)
        return float(1 / (1 + np.exp(-np.clip(self.bias + (total / n if n else 0.0), -30, 30))))


def train(rows: list[tuple[str, int]], epochs: int = EPOCHS, rate: float = RATE, dim: int = DIM, seed: int = 0) -> SubwordClassifier:
    """Learn vectors and layer from (text, label) by stochastic gradient descent, one document a step."""
    rng = np.random.default_rng(seed)
    vectors = ((rng.random((BUCKETS, dim)) - 0.5) / dim).astype(np.float32)
    layer = (rng.normal(size=(2, dim)) * 0.1).astype(np.float32)
    bias = np.zeros(2, np.float32)
    data = []
    for text, y in rows:
        parts = [features(part) for part in blocks(text)]
        f = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        used, counts = np.unique(f, return_counts=True)
        data.append((used.astype(np.int32), (counts / max(1, len(f))).astype(np.float32), y))
    steps, total = 0, max(1, epochs * len(data))
    for _ in range(epochs):
        for i in rng.permutation(len(data)):
            used, share, y = data[i]
            lr = rate * (1 - steps / total)
            steps += 1
            mean = share @ vectors[used]
            z = layer @ mean + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            back = layer.T @ p
            layer -= 0.05 * lr / rate * rate * np.outer(p, mean)
            bias -= np.float32(0.02 * lr / rate) * p
            vectors[used] -= lr * share[:, None] * back[None, :]
    fold = layer[1] - layer[0]
    return SubwordClassifier(vectors @ fold, bias[1] - bias[0])


def scorer(spark: SparkSession, model: SubwordClassifier) -> Callable[[Column], Column]:
    """A function from a text column to the column of its scores. The model is sent to each executor once."""
    prepare(spark)
    sent = spark.sparkContext.broadcast((model.weight, model.bias))

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = SubwordClassifier(*sent.value)
        for batch in batches:
            yield pa.array([own.score(t.as_py()) for t in batch], pa.float64())

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "double")


def score(docs: DataFrame, model: SubwordClassifier, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) for each row."""
    return docs.select(F.col(id_col).cast("long").alias("id"), scorer(docs.sparkSession, model)(F.col(text_col).cast("string")).alias("score"))


def _parameters(rows: list[tuple[str, int]]) -> tuple[np.ndarray, float]:
    model = train(rows)
    return model.weight, model.bias


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> SubwordClassifier:
    return SubwordClassifier(*learned(docs, labels, "quality", (per_class, per_class), _parameters))


def query(spark, sf_dir):
    """Score and prediction of every document."""
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select(F.col("id").alias("doc_id"), held_out("id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
