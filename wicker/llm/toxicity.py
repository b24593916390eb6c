"""Toxicity: maximal-scoring segments of token log-odds, judged by extreme-value statistics."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from wicker.llm.common import blocks, checkpointed, labelled_sample, scored

#: Labelled rows that a fit takes at most; a model holds all tokens that those single out.
SAMPLE = 20_000
#: Lengths of the stems that are tokens beside the words that begin with them.
STEMS = (4, 5, 6)
WORD = re.compile(r"[^\W\d_]+")
EULER = 0.5772156649015329


def words_of(text: str) -> Iterator[list[str]]:
    for part in blocks(text):
        yield WORD.findall(part.lower())


def tokens(word: str) -> list[str]:
    """A word's tokens: itself, with a mark at its end, and its stems."""
    return [word + "$", *(word[:k] for k in STEMS if len(word) >= k)]


def segments(positions: np.ndarray, scores: np.ndarray, drift: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first and last position, score) of a sequence that has the positive scores at the
    positions and drift, which is negative, everywhere else: the linear-time scan with a list of candidates, where only
    positive positions need a step.

    A candidate keeps the sum before it (low), up to its end (high), and where it stands; a new one joins the last
    candidate with a lower sum before it, if what lies between never rose above its own high."""
    found: list[list[float]] = []  # low, high, first, last
    total, previous = 0.0, -1
    for at, s in zip(positions.tolist(), scores.tolist()):
        total += drift * (at - previous - 1)
        new = [total, total + s, at, at]
        total, previous = total + s, at
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][0] >= new[0]:
                j -= 1
            if j < 0 or found[j][1] >= new[1]:
                found.append(new)
                break
            new = [found[j][0], new[1], found[j][2], new[3]]
            del found[j:]
    return [(int(a), int(b), high - low) for low, high, a, b in found]


class Scores:
    """word -> the largest log-odds among its tokens, 0 if none is a mark."""

    def __init__(self, odds: dict[str, float]):
        self.odds, self.heads = odds, {t.rstrip("$")[: STEMS[0]] for t in odds}

    def score(self, word: str) -> float:
        odds = self.odds.get
        return max(odds(word + "$", 0.0), *(odds(word[:k], 0.0) for k in STEMS))  # a shorter word's cut is no token, or its own stem

    def marks(self, text: str) -> tuple[np.ndarray, np.ndarray, int]:
        """Positions and log-odds of a text's words that are marks, and the number of its words. Few words begin as a mark
        does; only those are looked up."""
        at, found, n, heads, head = [], [], 0, self.heads, STEMS[0]
        for words in words_of(text):
            some = [(i, s) for i, w in enumerate(words, n) if w[:head] in heads and (s := self.score(w))]
            at += [i for i, _ in some]
            found += [s for _, s in some]
            n += len(words)
        return np.array(at, np.int64), np.array(found), n


@dataclass(frozen=True)
class Passages:
    """Log-odds of the tokens that mark toxic text, the drift of all other words, and the calibration.

    rate and log_k: the extreme-value law of the best score S of n clean words, P(S > x) = 1 - exp(-K n exp(-rate x)).
    slope and base: the logistic from a document's normalised score to a probability."""

    odds: dict[str, float]
    drift: float
    rate: float
    log_k: float
    slope: float
    base: float

    def passages(self, text: str, table: Scores | None = None) -> tuple[list[tuple[int, int, float]], int]:
        """Segments as word positions and scores, and the number of words."""
        at, got, n = (table or Scores(self.odds)).marks(text)
        return segments(at, got, self.drift), n

    def normalised(self, text: str, table: Scores | None = None) -> float:
        """rate S - ln(K n) of the best segment; significant further ones add what they have beyond their own threshold."""
        found, n = self.passages(text, table)
        level = self.log_k + np.log(max(1, n))
        x = sorted((self.rate * s - level for *_, s in found), reverse=True)
        return x[0] + sum(v for v in x[1:] if v > 0) if x else -level

    def score(self, text: str, table: Scores | None = None) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.normalised(text, table) + self.base, -500, 500))))


def log_odds(counts: DataFrame, least_z: float = 3.0, least_odds: float = 1.0) -> dict[str, float]:
    """From counts (token, toxic, clean): the log-odds of all tokens that significantly mark toxic text, under a
    Dirichlet prior proportional to the tokens' overall frequency and as heavy as the toxic class."""
    n_t, n_c = (float(x or 0) for x in counts.agg(F.sum("toxic"), F.sum("clean")).first())
    if not n_t or not n_c:
        return {}
    prior = (F.col("toxic") + F.col("clean")) * F.lit(n_t / (n_t + n_c))
    side = lambda c, n: F.log((F.col(c) + F.col("prior")) / (F.lit(n + n_t) - F.col(c) - F.col("prior")))
    rows = counts.withColumn("prior", prior).withColumn("odds", side("toxic", n_t) - side("clean", n_c))
    rows = rows.withColumn("z", F.col("odds") / F.sqrt(1 / (F.col("toxic") + F.col("prior")) + 1 / (F.col("clean") + F.col("prior"))))
    return {r.token: r.odds for r in rows.where((F.col("z") >= least_z) & (F.col("odds") >= least_odds)).select("token", "odds").collect()}


def karlin(scores: np.ndarray, shares: np.ndarray, drift: float) -> float:
    """The rate of the extreme-value law: the positive root of E exp(rate s) = 1 for clean words, of which shares have the
    scores and all others drift."""
    rest = 1 - shares.sum()
    low, high = 1e-3, min(20.0, 700 / max(scores.max(initial=0), 1e-3))
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (low, mid) if (shares * np.exp(mid * scores)).sum() + rest * np.exp(mid * drift) > 1 else (mid, high)
    return low


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, float]:
    """Slope and base of a logistic regression on one input, by Newton's method; the ridge bounds a separable fit. Classes
    weigh as the root of what would balance them: toxic text is rare, and a labelled row of it tells more."""
    w, design = np.zeros(2), np.stack([x, np.ones_like(x)], axis=1)
    share = np.clip(y.mean() if len(y) else 0.5, 1e-6, 1 - 1e-6)
    weight = np.sqrt(np.where(y == 1, 0.5 / share, 0.5 / (1 - share)))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        step = np.linalg.solve((design * (weight * p * (1 - p))[:, None]).T @ design + ridge * np.eye(2), design.T @ (weight * (y - p)) - ridge * w)
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(max(w[0], 1e-3)), float(w[1])


def train(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE) -> Passages:
    """Fit on at most ``bound`` labelled rows that aren't held out (common.labelled_sample). Without toxic or clean ones
    no token is a mark, and all scores are small."""
    sample = checkpointed(labelled_sample(docs, labels, "toxic", bound))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Counter(), Counter()
        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = {w for words in words_of(text) for w in words}
                seen[label].update({t for w in words for t in tokens(w)})  # once a document: one that repeats a word is one witness
        both = sorted(seen[0].keys() | seen[1].keys())
        for i in range(0, len(both), 50_000):
            part = both[i : i + 50_000]
            yield pa.record_batch([pa.array(part), *(pa.array([c[w] for w in part], pa.int64()) for c in seen[::-1])], ["token", "toxic", "clean"])

    counts = sample.mapInArrow(count, "token string, toxic long, clean long").groupBy("token").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    odds = log_odds(counts)
    if not odds:
        return Passages({}, -1e-3, 1.0, 0.0, 1.0, -5.0)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, found = Scores(odds), Counter()
        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                _, got, n = table.marks(text)
                found.update((label, s) for s in got.tolist())
                found[label, 0.0] += n - len(got)
        yield pa.record_batch([pa.array([k[0] for k in found], pa.int32()), pa.array([k[1] for k in found], pa.float64()), pa.array(list(found.values()), pa.int64())], ["label", "s", "n"])

    words = sample.mapInArrow(measure, "label int, s double, n long").groupBy("label", "s").agg(F.sum("n").cast("double").alias("n")).toPandas()
    marked, toxic = words["s"] > 0, words["label"] == 1
    share = lambda rows: (words["n"][rows & marked].sum() + 1) / (words["n"][rows].sum() + 2)
    drift = min(-1e-3, float(np.log((1 - share(toxic)) / (1 - share(~toxic)))))
    clean = words[marked & ~toxic]
    rate = karlin(np.append(clean["s"].to_numpy(), np.mean(list(odds.values()))), np.append(clean["n"].to_numpy(), 1) / (words["n"][~toxic].sum() + 2), drift)
    raw = Passages(odds, drift, rate, 0.0, 1.0, 0.0)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Scores(odds)
        for batch in batches:
            yield pa.record_batch([pa.array([raw.normalised(t, table) for t in batch.column(0).to_pylist()], pa.float64()), batch.column(1)], ["x", "label"])

    judged = sample.mapInArrow(judge, "x double, label int").toPandas()
    log_k = float(judged["x"][judged["label"] == 0].mean() - EULER)  # the location of the Gumbel law of clean documents
    slope, base = logistic(judged["x"].to_numpy() - log_k, judged["label"].to_numpy())
    return Passages(odds, drift, rate, log_k, slope, base)


def score_documents(docs: DataFrame, model: Passages, *keep: str) -> DataFrame:
    """The kept columns and score, the probability that the row's whole text is toxic (null: empty), in the place of a kept
    column of that name; Passages.passages gives the segments of a text. One row for each row of docs, none for an empty table."""

    def scores() -> Callable[[list[str]], list[float]]:
        table = Scores(model.odds)
        return lambda texts: [model.score(t, table) for t in texts]

    return scored(docs, scores, *keep)
