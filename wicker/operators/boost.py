"""Gradient boosting with any objective that gives a first and a second derivative for each row.

Columns become bins by quantiles once. A level of a tree is one pass over the rows: each task adds up both derivatives for each node,
column and bin, the sums are merged by a shuffle, and the best splits are chosen from them on the driver, whose share is nodes x
columns x bins however many rows there are. Rows are never moved: a task finds a row's node and margin from the trees so far."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from wicker.operators.order import quantiles
from wicker.sources.tables import checkpointed

#: Derivatives of the loss by a row's margin: (labels, margins, totals) -> (first, second). totals is what ``totals`` of the
#: objective adds up over all rows before, for losses that aren't a sum over rows.
Derivatives = Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


@dataclass(frozen=True)
class Objective:
    derivatives: Derivatives
    totals: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None


def log_loss(y: np.ndarray, margin: np.ndarray, totals: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    p = sigmoid(margin)
    return p - y, np.maximum(p * (1 - p), 1e-16)


def soft_counts(y: np.ndarray, margin: np.ndarray) -> np.ndarray:
    """Sums of p y, of p and of y: what soft F1 = 2 sum(p y) / (sum(p) + sum(y)) is of."""
    p = sigmoid(margin)
    return np.array([(p * y).sum(), p.sum(), y.sum()])


def soft_f1(y: np.ndarray, margin: np.ndarray, totals: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Derivatives of the number of rows times 1 - soft F1 by each margin, the totals' number of rows as its last; the second one
    is that of p alone with the slope by p held, kept above zero so that a step is always downhill."""
    hit, said, pos, n = totals
    both = max(said + pos, 1e-12)
    slope = -2 * n * (y * both - hit) / both**2
    p = sigmoid(margin)
    first = slope * p * (1 - p)
    return first, np.maximum(np.abs(first * (1 - 2 * p)), 0.1 * np.abs(first) + 1e-6)


LOG_LOSS, SOFT_F1 = Objective(log_loss), Objective(soft_f1, soft_counts)


@dataclass
class Tree:
    """Nodes in level order from 0, the children of node i are 2i + 1 and 2i + 2: rows whose bin of the column is above the cut
    go right. Nodes without a split have column -1; value is what they add to a margin."""

    column: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    def node(self, bins: np.ndarray) -> np.ndarray:
        at, rows = np.zeros(len(bins), np.int64), np.arange(len(bins))
        for _ in range((len(self.column) + 1).bit_length() - 1):
            split = self.column[at] >= 0
            right = bins[rows, np.maximum(self.column[at], 0)] > self.cut[at]
            at = np.where(split, 2 * at + 1 + right, at)
        return at


@dataclass
class Boosted:
    """Edges of each column's bins, a base margin, trees with the learning rate in their values, and the objective's value after
    each round where it has totals."""

    columns: list[str]
    edges: list[np.ndarray]
    base: float
    trees: list[Tree] = field(default_factory=list)

    def binned(self, x: list[np.ndarray]) -> np.ndarray:
        """A missing number is in bin 0, others from 1."""
        return np.column_stack([np.where(np.isnan(c), 0, 1 + np.searchsorted(e, c, "left")) for c, e in zip(x, self.edges)])

    def margins(self, bins: np.ndarray, start: np.ndarray | None = None, first: int = 0) -> np.ndarray:
        out = np.full(len(bins), self.base) if start is None else start.copy()
        for t in self.trees[first:]:
            out += t.value[t.node(bins)]
        return out


def numbers(batch: pa.RecordBatch, names: list[str]) -> list[np.ndarray]:
    return [batch.column(batch.schema.names.index(c)).to_numpy(zero_copy_only=False).astype(float) for c in names]


def fit(df: DataFrame, columns: list[str], label: str, objective: Objective = LOG_LOSS, rounds: int = 20, depth: int = 3, rate: float = 0.2, bins: int = 32, ridge: float = 1.0, least: float = 1e-3, every: int = 10) -> Boosted:
    """Trees fitted one after another to the derivatives at the margins so far. Every ``every`` rounds the margins are written to
    the checkpoint folder, so a pass goes through few trees. Rows without a label are left out; null and NaN are missing
    numbers, which have a bin of their own; without rows of both classes the model has no trees."""
    rows = df.where(F.col(label).isNotNull()).select(F.col(label).cast("double").alias("_y"), *(F.col(c).cast("double").alias(c) for c in columns))
    at = [i / bins for i in range(1, bins)]
    found = quantiles(rows, {c: at for c in columns})
    share = rows.agg(F.avg("_y")).first()[0]
    edges = [np.unique([v for v in found[c] if v is not None]) for c in columns]
    model = Boosted(columns, edges, float(np.log(share / (1 - share))) if share and share < 1 else 0.0)
    if not share or share == 1:
        return model
    n = rows.count()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b = model.binned(numbers(batch, columns))
            yield pa.record_batch([batch.column(0), pa.array(b.astype(np.int32).tolist(), pa.list_(pa.int32())), pa.array(np.full(len(b), model.base))], ["y", "bins", "margin"])

    held, first = checkpointed(rows.mapInArrow(place, "y double, bins array<int>, margin double")), 0

    def parts(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        b = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, len(columns))
        return batch.column(0).to_numpy(), b, model.margins(b, batch.column(2).to_numpy(), first)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y, _, margin = parts(batch)
            yield pa.record_batch([pa.array([objective.totals(y, margin).tolist()], pa.list_(pa.float64()))], ["t"])

    def refreshed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(parts(batch)[2])], ["y", "bins", "margin"])

    for r in range(rounds):
        if r - first >= every:
            held, first = checkpointed(held.mapInArrow(refreshed, "y double, bins array<int>, margin double")), r
        totals = np.zeros(0)
        if objective.totals:
            t = held.mapInArrow(summed, "t array<double>")
            k = len(objective.totals(np.zeros(1), np.zeros(1)))
            totals = np.array([*t.agg(*(F.sum(F.col("t")[i]) for i in range(k))).first(), n])
        size = 2 ** (depth + 1) - 1
        tree = Tree(np.full(size, -1), np.zeros(size, np.int64), np.zeros(size))
        open_nodes = [0]
        for level in range(depth + 1):
            sums = histogram(held, parts, objective, totals, tree, len(columns), bins + 1, open_nodes)
            following = []
            for node in open_nodes:
                g, h = sums.get(node, np.zeros((2, len(columns), bins + 1)))
                whole = g[0].sum(), h[0].sum()
                tree.value[node] = -rate * whole[0] / (whole[1] + ridge)
                if level == depth:
                    continue
                left = np.cumsum(g, axis=1)[:, :-1], np.cumsum(h, axis=1)[:, :-1]
                right = whole[0] - left[0], whole[1] - left[1]
                gain = left[0] ** 2 / (left[1] + ridge) + right[0] ** 2 / (right[1] + ridge) - whole[0] ** 2 / (whole[1] + ridge)
                gain = np.where((left[1] > least) & (right[1] > least), gain, -np.inf)
                c, b = np.unravel_index(np.argmax(gain), gain.shape)  # of equal gains the first column and bin
                if gain[c, b] > 1e-9:
                    tree.column[node], tree.cut[node] = c, b
                    following += [2 * node + 1, 2 * node + 2]
            open_nodes = following
            if not open_nodes:
                break
        model.trees.append(tree)
    return model


def histogram(held: DataFrame, parts: Callable, objective: Objective, totals: np.ndarray, tree: Tree, columns: int, bins: int, nodes: list[int]) -> dict[int, np.ndarray]:
    """node: (2, columns, bins), the sums of both derivatives over the node's rows, for the open nodes of a level."""
    place = {node: k for k, node in enumerate(nodes)}

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((2, len(nodes) * columns * bins))
        for batch in batches:
            y, b, margin = parts(batch)
            at = np.array([place.get(i, -1) for i in range(len(tree.column))])[tree.node(b)]
            some = at >= 0
            g, h = objective.derivatives(y, margin, totals)
            cell = ((at[some, None] * columns + np.arange(columns)) * bins + b[some]).ravel()
            for k, x in enumerate((g, h)):
                out[k] += np.bincount(cell, weights=np.repeat(x[some], columns), minlength=out.shape[1])
        out = out.reshape(2, len(nodes), columns * bins)
        yield pa.record_batch([pa.array(np.repeat(nodes, columns * bins), pa.int32()), pa.array(np.tile(np.arange(columns * bins), len(nodes)), pa.int32()), pa.array(out[0].ravel()), pa.array(out[1].ravel())], ["node", "cell", "g", "h"])

    found = held.mapInArrow(add, "node int, cell int, g double, h double").where("h <> 0").groupBy("node", "cell").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
    sums: dict[int, np.ndarray] = {}
    for r in found.collect():  # nodes x columns x bins at most
        sums.setdefault(r.node, np.zeros((2, columns * bins)))[:, r.cell] = r.g, r.h
    return {node: s.reshape(2, columns, bins) for node, s in sums.items()}


def scored(df: DataFrame, model: Boosted, key: str) -> DataFrame:
    """(key, margin, p): a row's margin and the probability that it stands for; one row for each of df's."""
    kind = df.schema[key].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            margin = model.margins(model.binned(numbers(batch, model.columns)))
            yield pa.record_batch([batch.column(0), pa.array(margin), pa.array(sigmoid(margin))], ["key", "margin", "p"])

    rows = df.select(F.col(key).alias("key"), *(F.col(c).cast("double").alias(c) for c in model.columns))
    return rows.mapInArrow(score, f"key {kind}, margin double, p double").withColumnRenamed("key", key)


def soft_f1_value(df: DataFrame, label: str = "y", p: str = "p") -> float:
    """2 sum(p y) / (sum(p) + sum(y))."""
    r = df.agg(F.sum(F.col(p) * F.col(label)).alias("hit"), F.sum(p).alias("said"), F.sum(label).alias("pos")).first()
    return 2 * r.hit / (r.said + r.pos)
