"""Quality classifier: regularised quadratic discriminant analysis over transformed document statistics."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from wicker.llm.common import blocks, labelled_sample, scored

#: Labelled rows that a fit takes at most.
SAMPLE = 20_000
FEATURES = ["log_words", "symbols", "bars", "marks", "upper", "digits", "repeats", "distinct", "word_chars", "line_ends"]
_ORD = np.zeros(128, np.int8)  # classes of ASCII bytes: 1 symbol, 2 bar, 3 shout, 4 upper, 5 digit, 6 new line
for _k, _c in enumerate(("#$%&*<>=@\\^_`{}~+", "|", "!?", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "\n"), 1):
    _ORD[[ord(x) for x in _c]] = _k
_CLASS = np.concatenate([_ORD, np.zeros(128, np.int8)])


def features(text: str) -> list[float]:
    """Shares on the arcsine scale, which steadies their variance, and logarithms of counts. An empty text has zeros."""
    classes, n_bytes, n_chars, n_upper, n_words, n_same, n_letters, seen, last = np.zeros(7, np.int64), 0, 0, 0, 0, 0, 0, set(), None
    for part in blocks(text):
        data = np.frombuffer(part.encode(), np.uint8)
        classes += np.bincount(_CLASS[data], minlength=7)
        words = part.split()
        n_bytes, n_chars, n_words = n_bytes + len(data), n_chars + len(part), n_words + len(words)
        if len(data) > len(part):  # capitals beyond ASCII
            n_upper += sum(map(str.isupper, set(part) - _ASCII)) and sum(c.isupper() for c in part if c > "\x7f")
        n_letters += len(part) - sum(map(part.count, " \n\t\r"))
        n_same += sum(a == b for a, b in zip(words, ([last] if last is not None else []) + words)) if last is not None else sum(a == b for a, b in zip(words, words[1:]))
        seen.update(words)
        last = words[-1] if words else last
    w, c = n_words + 10, n_chars + 60  # ten words of nothing: shares of a few words tell little
    share = lambda a, b: float(np.arcsin(np.sqrt(min(1.0, a / b))))
    return [
        float(np.log1p(n_words)), share(classes[1], 4 * w), share(classes[2], 2 * w), share(classes[3], 2 * w), share(classes[4] + n_upper, c), share(classes[5], c), share(n_same, w),
        float(np.log((len(seen) + 10) / w**0.9)), float(np.log((n_letters + 50) / w)), share(classes[6], w)]


_ASCII = set(map(chr, range(128)))


@dataclass(frozen=True)
class Discriminant:
    """Class means, inverse Cholesky factors of their covariances, log-determinants and log-priors; scale of the features."""

    centre: np.ndarray
    scale: np.ndarray
    mean: np.ndarray
    factor: np.ndarray
    offset: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        """P(class 1): the logistic of the difference of Mahalanobis log-densities."""
        z = (x - self.centre) / self.scale
        log = [-0.5 * (((z - m) @ f.T) ** 2).sum(axis=1) + o for m, f, o in zip(self.mean, self.factor, self.offset)]
        return 1 / (1 + np.exp(np.clip(log[0] - log[1], -500, 500)))


def fit(x: np.ndarray, y: np.ndarray, pooled: float = 0.1, ridge: float = 0.02) -> Discriminant:
    """Covariances shrink towards the pooled one, then towards a multiple of the identity; a class without rows takes
    the pooled moments, so a fit without labels scores all rows one half."""
    x, y = np.asarray(x, float).reshape(-1, len(FEATURES)), np.asarray(y)
    centre = x.mean(axis=0) if len(x) else np.zeros(len(FEATURES))
    scale = x.std(axis=0) if len(x) else np.ones(len(FEATURES))
    scale = np.where(scale > 1e-9, scale, 1)
    z = (x - centre) / scale
    own = [z[y == k] for k in (0, 1)]
    both = sum((g - g.mean(axis=0)).T @ (g - g.mean(axis=0)) for g in own if len(g)) / max(1, len(z)) + np.zeros((z.shape[1],) * 2)
    mean, factor, offset = [], [], []
    for g in own:
        mean.append(g.mean(axis=0) if len(g) else np.zeros(z.shape[1]))
        cov = (1 - pooled) * np.cov(g.T, bias=True) + pooled * both if len(g) > 1 else both
        cov = (1 - ridge) * cov + ridge * max(np.trace(cov) / len(cov), 1e-3) * np.eye(len(cov))
        low = np.linalg.cholesky(cov)
        factor.append(np.linalg.inv(low))
        offset.append(np.log((len(g) + 1) / (len(z) + 2)) - np.log(np.diag(low)).sum())
    return Discriminant(centre, scale, np.array(mean), np.array(factor), np.array(offset))


def document_features(docs: DataFrame, label: str) -> DataFrame:
    """label and x, the features of each row's whole text (null: empty)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [features(t or "") for t in batch.column(0).to_pylist()]
            yield pa.record_batch([batch.column(1), pa.array(x, pa.list_(pa.float64()))], ["label", "x"])

    return docs.select(F.col("text").cast("string"), F.col(label).cast("int")).mapInArrow(run, "label int, x array<double>")


def train(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE) -> Discriminant:
    """Fit on at most ``bound`` labelled rows that aren't held out (common.labelled_sample)."""
    rows = document_features(labelled_sample(docs, labels, "quality", bound), "label").toPandas()
    return fit(np.array(rows["x"].tolist()), rows["label"].to_numpy())


def score_documents(docs: DataFrame, model: Discriminant, *keep: str) -> DataFrame:
    """The kept columns and score, P(good), from the text alone, in the place of a kept column of that name; one row for each row
    of docs, none for an empty table."""
    return scored(docs, lambda: lambda texts: model.scores(np.array([features(t) for t in texts]).reshape(-1, len(FEATURES))), *keep)
