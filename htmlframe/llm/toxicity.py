"""Toxicity by weak supervision.

Many voters look at a document. A voter is a lexicon or a pattern: it votes toxic where something of it occurs and clean
elsewhere. Besides fixed lexicons and patterns there are MINED lexicons, among which the terms that go with the toxic label
in the labelled sample (whole words, and beginnings of words, which find them with other endings) are dealt by a hash.
Labels are no voter: they choose the terms, on at most sum(MOST) rows, and say which of the two classes found is the toxic
one.

A generative label model estimates from the votes' agreement alone, by expectation maximisation that starts where at least
two voters agree on toxic, how often each voter votes toxic on toxic and on clean documents (its accuracy), and how much
the errors of each two voters go together given the class (their correlation); a voter counts the less, the more of its
evidence others give too. A term that never occurs beside others is not believed. The posterior labels then train a linear classifier on the terms, lexicon words and patterns.

Scores look at which terms occur, not how often or how far apart, so one toxic passage counts as much in a long document
as in a short one; a text is read whole, however long. Null and empty texts, and all texts if there is no toxic row to
learn from, get the score of no evidence. Repeated rows get the same score each; an empty table gives no rows. Only the id
and text columns are read, so others and their names don't matter.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from htmlframe.llm.common import prepare, table
from htmlframe.llm.labelled import held_out, learned

#: Rows labelled 0 and 1 that are learned from, at most.
MOST = (4000, 1500)
THRESHOLD = 0.7
#: Lengths of word beginnings; terms must reach this log-likelihood ratio and share of toxic documents.
BEGINNINGS, LEAST_G, LEAST_SHARE, MOST_TERMS = (4, 5, 6), 24.0, 0.95, 400
#: Lexicons that the mined terms are dealt among, and the least correlation of two voters' errors that counts.
MINED, LEAST_CORRELATION = 12, 0.3
#: Chunks between white space in each half of a worker's memo.
MOST_CHUNKS = 200_000

# Word lists of the lexicon voters.
LEXICONS = {
    "insult": "idiot moron imbecile stupid dumb fool loser clown jerk dimwit cretin",
    "contempt": "pathetic worthless useless disgusting trash garbage scum filth vermin despicable repulsive",
    "threat": "kill murder destroy strangle exterminate",
    "hate": "hate despise loathe detest",
}
# Expressions of the pattern voters.
PATTERNS = {
    "pair": r"\b(?:idiot|moron|imbecile|loser|clown|jerk|scum|trash|garbage|filth|vermin|stupid|dumb|pathetic|worthless|useless|disgusting)\W+(?:idiot|moron|imbecile|loser|clown|jerk|scum|trash|garbage|filth|vermin|stupid|dumb|pathetic|worthless|useless|disgusting)\b",
    "second person": r"\b(?:you|your|u)\b(?:\W+\w+){0,3}?\W+(?:idiot|moron|loser|clown|scum|trash|fool|stupid|pathetic|worthless|disgusting)\b",
    "command": r"\b(?:shut up|go to hell|get lost|drop dead|kill yourself)\b",
    "naming": r"\b(?:such an?|what an?|bunch of|complete|total|utter)\s+(?:idiots?|morons?|losers?|clowns?|scum|trash|fools?)\b",
}
_WORD = re.compile(r"[^\W\d_]+")


def chunk_terms(chunk: str) -> set[str]:
    """Possible terms of a lower-case chunk: its words, and their beginnings with a star."""
    out = set()
    for w in _WORD.findall(chunk):
        out.add(w)
        out.update(w[:n] + "*" for n in BEGINNINGS if len(w) > n)
    return out


def mine(rows: Iterable[tuple[str, int]]) -> list[str]:
    """Terms that go with the toxic label, strongest first. Rows are read once; of each only its words' numbers are kept."""
    number: dict[str, int] = {}
    docs, labels = [], []
    for text, y in rows:
        found = {w for chunk in set((text or "").lower().split()) for w in _WORD.findall(chunk)}
        docs.append(np.fromiter((number.setdefault(w, len(number)) for w in found), np.int32, len(found)))
        labels.append(y)
    words, y = list(number), np.array(labels, bool)
    n1, n0 = max(1, int(y.sum())), max(1, int((~y).sum()))
    found = []  # -strength, term, its toxic documents, number of clean ones
    for length in (0, *BEGINNINGS):
        # terms of one kind: each word's term, or -1 for words that are too short
        names: dict[str, int] = {}
        of = np.array([names.setdefault(w[:length] if length else w, len(names)) if len(w) > length else -1 for w in words], np.int64)
        shown = [np.unique(x[x >= 0]) for x in (of[d] for d in docs)]
        count = [np.bincount(np.concatenate([x for x, one in zip(shown, y, strict=True) if one == want] or [np.zeros(0, np.int64)]), minlength=len(names)).astype(np.float64) for want in (True, False)]
        a, b = count
        e = (a + b) * n1 / (n0 + n1)
        with np.errstate(divide="ignore", invalid="ignore"):
            g = 2 * (np.where(a > 0, a * np.log(a / e), 0) + np.where(b > 0, b * np.log(b / (a + b - e)), 0))
            able = np.flatnonzero((a >= 3) & (a > e) & (g >= LEAST_G) & ((a / n1) / (a / n1 + (b + 0.5) / n0) >= LEAST_SHARE))
        where: dict[int, list[int]] = {t: [] for t in able.tolist()}
        for i, x in enumerate(shown):
            if y[i]:
                for t in x[np.isin(x, able)].tolist():
                    where[t].append(i)
        name = list(names)
        found += [(-g[t], name[t] + "*" * bool(length), tuple(where[t]), b[t]) for t in able.tolist()]
    found.sort(key=lambda x: x[:2])
    # of terms that occur in the same toxic documents one is kept: a whole word, else the longest beginning
    best: dict[tuple, str] = {}
    for _, t, where_, clean in found:
        key = (where_, clean)
        if key not in best or (best[key].endswith("*") and (not t.endswith("*") or len(t) > len(best[key]))):
            best[key] = t
    return [t for _, t, where_, clean in found if best[where_, clean] == t][:MOST_TERMS]


class Evidence:
    """Which terms, lexicon words and patterns a text shows. Column order: terms, other lexicon words, patterns."""

    def __init__(self, terms: list[str]):
        self.terms = terms
        self.at = {t: i for i, t in enumerate(terms)}
        lexicon = [w for name in LEXICONS for w in LEXICONS[name].split()]
        self.at |= {w: len(self.at) + i for i, w in enumerate(w for w in lexicon if w not in self.at)}
        self.lexicons = [frozenset(self.at[w] for w in LEXICONS[name].split()) for name in LEXICONS]
        self.lexicons += [frozenset(i for i, t in enumerate(terms) if zlib.crc32(t.encode()) % MINED == k) for k in range(MINED)]
        self.patterns = [re.compile(p) for p in PATTERNS.values()]
        # a pattern can match only where one of its own words is: these decide whether it is tried
        self.cue = re.compile(r"idiot|moron|imbecile|loser|clown|jerk|scum|trash|garbage|filth|vermin|fool|stupid|dumb|pathetic|worthless|useless|disgusting|shut up|go to hell|get lost|drop dead|kill yourself")
        self.first_pattern = len(self.at)
        self.width = self.first_pattern + len(PATTERNS)
        self.memo: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}

    def _chunk(self, chunk: str) -> tuple[int, ...]:
        got = self.older.get(chunk)
        if got is None:
            got = tuple(sorted(self.at[t] for t in chunk_terms(chunk) if t in self.at))
        if len(self.memo) >= MOST_CHUNKS:
            self.older, self.memo = self.memo, {}
        self.memo[chunk] = got
        return got

    def of(self, text: str | None) -> list[int]:
        text = (text or "").lower()
        found: set[int] = set()
        get = self.memo.get
        for chunk in set(text.split()):
            hits = get(chunk)
            if hits is None:
                hits = self._chunk(chunk)
            if hits:
                found.update(hits)
        if self.cue.search(text):
            found.update(self.first_pattern + i for i, p in enumerate(self.patterns) if p.search(text))
        return sorted(found)


def votes(evidence: Evidence, shown: list[list[int]]) -> np.ndarray:
    """One row of votes (1 toxic, 0 clean) for each document: the lexicons' and the patterns'."""
    out = np.zeros((len(shown), len(evidence.lexicons) + len(PATTERNS)), np.int8)
    for row, found in enumerate(shown):
        if found:
            out[row] = [*(not x.isdisjoint(found) for x in evidence.lexicons), *(i in found for i in range(evidence.first_pattern, evidence.width))]
    return out


def label_model(votes_: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(posterior that each document is toxic, how often each voter votes toxic on toxic and on clean documents, as two
    rows, correlations of the voters' errors, weights of the voters). No labels take part."""
    n, m = votes_.shape
    seen = votes_.astype(np.float64)
    p = np.where(seen.sum(axis=1) >= 2, 0.95, 0.05)
    rate, corr, weight = np.full((2, m), 0.5), np.zeros((m, m)), np.ones(m)
    for _ in range(rounds):
        prior = np.clip(p.mean(), 1e-3, 1 - 1e-3)
        rate = np.array([(q @ seen + 0.5) / (q.sum() + 1) for q in (p, 1 - p)])
        # errors: what a vote says beyond what its class explains
        error = seen - p[:, None] * rate[0] - (1 - p)[:, None] * rate[1]
        scale = np.outer(error.std(axis=0), error.std(axis=0))
        corr = np.where(scale > 1e-12, error.T @ error / n / np.maximum(scale, 1e-12), 0.0)
        np.fill_diagonal(corr, 0)
        weight = 1 / (1 + np.where(corr > LEAST_CORRELATION, corr, 0).sum(axis=1))
        z = np.log(prior / (1 - prior)) + seen @ (weight * np.log(rate[0] / rate[1])) + (1 - seen) @ (weight * np.log((1 - rate[0]) / (1 - rate[1])))
        new = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        still = np.abs(new - p).max() < 1e-4
        p = new
        if still:
            break
    return p, rate, corr, weight


def posterior(evidence: Evidence, shown: list[list[int]], labels: list[int]) -> np.ndarray:
    """Probability that each document is toxic, by the voters; labels say only which class is which."""
    p = label_model(votes(evidence, shown))[0]
    y = np.array(labels, bool)
    return 1 - p if y.any() and not y.all() and p[y].mean() < p[~y].mean() else p


class ToxicityModel:
    def __init__(self, terms: list[str], weight: np.ndarray, bias: float):
        self.evidence, self.weight, self.bias = Evidence(terms), weight, bias

    def score(self, text: str | None) -> float:
        z = self.bias + float(self.weight[self.evidence.of(text)].sum())
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def train(rows: list[tuple[str, int]], steps: int = 1500, decay: float = 3e-6) -> ToxicityModel:
    """Mine terms, vote, estimate the posterior labels and fit the linear classifier to them."""
    terms = mine(rows)
    evidence = Evidence(terms)
    labels = [y for _, y in rows]
    shown = [evidence.of(t) for t, _ in rows]
    weight, bias = np.zeros(evidence.width), -3.0
    if not rows or not any(labels):
        return ToxicityModel(terms, weight, bias)
    target = posterior(evidence, shown, labels)
    # the documents' features as pairs (row, column)
    row = np.repeat(np.arange(len(shown)), [len(x) for x in shown])
    column = np.array([i for x in shown for i in x], np.int64)
    # equal weight of both classes
    share = np.where(target > 0.5, 0.5 / max(1, (target > 0.5).sum()), 0.5 / max(1, (target <= 0.5).sum()))
    w = np.zeros(evidence.width + 1)
    w[-1] = bias
    first, second = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        z = np.bincount(row, weights=w[column], minlength=len(shown)) + w[-1]
        g = share * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target)
        grad = np.append(np.bincount(column, weights=g[row], minlength=evidence.width) + decay * w[:-1], g.sum())
        first = 0.9 * first + 0.1 * grad
        second = 0.99 * second + 0.01 * grad * grad
        w -= 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-7)
    return ToxicityModel(terms, w[:-1], float(w[-1]))


def _parameters(rows: list[tuple[str, int]]) -> tuple[list[str], np.ndarray, float]:
    model = train(rows)
    return model.evidence.terms, model.weight, model.bias


def fit(docs: DataFrame, labels: DataFrame, most: tuple[int, int] = MOST) -> ToxicityModel:
    return ToxicityModel(*learned(docs, labels, "toxic", most, _parameters))


def scorer(spark: SparkSession, model: ToxicityModel) -> Callable[[Column], Column]:
    """A function from a text column to the column of its scores. The model is sent to each executor once."""
    prepare(spark)
    sent = spark.sparkContext.broadcast((model.evidence.terms, model.weight, model.bias))

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = ToxicityModel(*sent.value)
        for batch in batches:
            yield pa.array([own.score(t.as_py()) for t in batch], pa.float64())

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "double")


def score(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) for each row."""
    return docs.select(F.col(id_col).cast("long").alias("id"), scorer(docs.sparkSession, model)(F.col(text_col).cast("string")).alias("score"))


def query(spark, sf_dir):
    """Score and prediction of every document."""
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select(F.col("id").alias("doc_id"), held_out("id").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
