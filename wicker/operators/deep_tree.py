"""Out-of-fold scores of a tree that is grown until its leaves are pure or can't be split: large nodes by sums over all tasks, a
small node with all that is below it in one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from wicker.sources.tables import checkpointed


def sums(node: np.ndarray, x: np.ndarray, n: np.ndarray, nodes: int, bins: int) -> np.ndarray:
    """(nodes, columns, bins, kinds): the sums of n's columns for each node, column of x and bin."""
    out = np.empty((nodes, x.shape[1], bins, n.shape[1]), np.int64)
    for j in range(x.shape[1]):
        at = node * bins + x[:, j]
        for y in range(n.shape[1]):
            out[:, j, :, y] = np.bincount(at, n[:, y], nodes * bins).reshape(nodes, bins)
    return out


def best_splits(found: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each node whether any split gains, and the column and bin of the split with the largest Gini gain, the first of equal
    ones: bins up to it go left. Whether there is a gain is told in whole numbers."""
    left = found.cumsum(axis=2)[:, :, :-1, :2]
    right = found[:, :1, :, :2].sum(axis=2, keepdims=True) - left
    apart = (left[..., 1] * right[..., 0] - left[..., 0] * right[..., 1]).astype(float)
    gain = (apart * apart / np.maximum(left.sum(axis=-1).astype(float) * right.sum(axis=-1), 1)).reshape(len(found), -1)
    at = gain.argmax(axis=1)
    return gain.max(axis=1) > 0, at // left.shape[2], at % left.shape[2]


def grown(x: np.ndarray, n: np.ndarray, depth: int, bins: int) -> np.ndarray:
    """The share of label 1 in each row's leaf; n has each row's number of training rows by label, which may be none."""
    p, at, node = np.zeros(len(x)), np.arange(len(x)), np.zeros(len(x), np.int64)
    while len(at):
        node = np.unique(node, return_inverse=True)[1]
        found = sums(node, x[at], n[at], node.max() + 1, bins)
        split, column, cut = best_splits(found)
        whole = found[:, 0].sum(axis=1)
        leaf = ~split[node] | (depth == 0)
        p[at[leaf]] = (whole[:, 1] / np.maximum(whole.sum(axis=1), 1))[node[leaf]]
        at, node, depth = at[~leaf], node[~leaf], depth - 1
        node = 2 * node + (x[at, column[node]] > cut[node])
    return p


def tree_out_of_fold(df: DataFrame, columns: list[str], key: str = "row_id", k: int = 3, depth: int = 30, bins: int = 32, few: int | None = None) -> DataFrame:
    """(key, fold, y, p): each row scored by an unpruned tree of the other folds, of at most ``depth`` levels. df has y, 0 or 1, and fold.

    Columns are cut at quantiles of a model's training rows into ``bins`` bins, a missing value in the last, and rows with the same bins
    are one cell of a model. Nodes of over ``few`` cells are split level by level, those of all models in one job; a row for
    each of them comes to the driver. The others are dealt to tasks whole, at most ``few`` cells each, and grown there."""
    few = few or max(100, 80_000 // len(columns))
    rows = checkpointed(df.select(key, "fold", "y", *(F.col(c).cast("double").alias(f"x{j}") for j, c in enumerate(columns))))
    names, at = [f"b{j}" for j in range(len(columns))], [i / bins for i in range(1, bins)]
    drawn = rows.agg(*(F.percentile_approx(F.when((F.col("fold") != i) & ~F.isnan(f"x{j}"), F.col(f"x{j}")), at, 10_000) for i in range(k) for j in range(len(columns)))).first()
    cuts = [[np.unique(np.array(drawn[i * len(columns) + j] or [], float)) for j in range(len(columns))] for i in range(k)]

    def binned(batch: pa.RecordBatch, i: int) -> list[pa.Array]:
        return [pa.array(np.searchsorted(cuts[i][j], batch.column(f"x{j}").to_numpy(zero_copy_only=False), "left").astype(np.int16)) for j in range(len(columns))]

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fold, y = batch.column("fold").to_numpy(), batch.column("y").to_numpy()
            for i in range(k):
                mine = fold != i
                yield pa.record_batch([pa.array(np.full(len(y), i, np.int32)), *binned(batch, i), pa.array((mine & (y == 0)).astype(np.int64)), pa.array((mine & (y == 1)).astype(np.int64))], ["model", *names, "n0", "n1"])

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fold = batch.column("fold").to_numpy()
            for i in range(k):
                some = batch.filter(pa.array(fold == i))
                yield pa.record_batch([*(some.column(c) for c in (key, "fold", "y")), *binned(some, i)], [key, "fold", "y", *names])

    kinds = ", ".join(f"{b} short" for b in names)
    cells = checkpointed(rows.mapInArrow(train, f"model int, {kinds}, n0 long, n1 long").groupBy("model", *names).agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")))

    # nodes by number, the roots first: the column it is split by or -1, the bin, the left child (the right one follows), the level, p of a leaf
    column, cut, left, level, share = [-1] * k, [0] * k, [0] * k, [0] * k, [None] * k

    def placed(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        x = np.stack([batch.column(b).to_numpy() for b in names], axis=1).astype(np.int64)
        node, (c, b, to) = batch.column("model").to_numpy().astype(np.int64), map(np.array, (column, cut, left))
        while (inner := np.flatnonzero(c[node] >= 0)).size:
            here = node[inner]
            node[inner] = to[here] + (x[inner, c[here]] > b[here])
        return x, node

    large = list(range(k))
    while large:
        numbers = np.array(large)

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[int, np.ndarray] = {}
            for batch in batches:
                x, node = placed(batch)
                mine = np.flatnonzero(np.isin(node, numbers))
                here, place = np.unique(node[mine], return_inverse=True)
                n = np.stack([batch.column("n0").to_numpy(), batch.column("n1").to_numpy(), np.ones(len(node), np.int64)], axis=1)[mine]
                for v, s in zip(here.tolist(), sums(place, x[mine], n, len(here), bins)):
                    total[v] = total[v] + s if v in total else s
            yield pa.record_batch([pa.array(list(total), pa.int32()), pa.array([s.tobytes() for s in total.values()], pa.binary())], ["node", "sums"])

        def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[int, np.ndarray] = {}
            for batch in batches:
                for v, s in zip(batch.column("node").to_pylist(), batch.column("sums").to_pylist()):
                    s = np.frombuffer(s, np.int64).reshape(len(names), bins, 3)
                    total[v] = total[v] + s if v in total else s
            out = []
            for v, s in total.items():
                (split,), (c,), (b,) = best_splits(s[None])
                n0, n1, held = s[0].sum(axis=0).tolist()
                below = int(s[c, : b + 1, 2].sum())
                out.append({"node": v, "split": bool(split), "c": int(c), "b": int(b), "p": n1 / max(1, n0 + n1), "below": below, "above": held - below})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("node", pa.int32()), ("split", pa.bool_()), ("c", pa.int32()), ("b", pa.int32()), ("p", pa.float64()), ("below", pa.int64()), ("above", pa.int64())]))

        found = cells.mapInArrow(count, "node int, sums binary").repartition("node").mapInArrow(choose, "node int, split boolean, c int, b int, p double, below long, above long").collect()
        large = []
        for r in sorted(found, key=lambda r: r.node):
            if not r.split or level[r.node] == depth:
                share[r.node] = r.p
                continue
            column[r.node], cut[r.node], left[r.node] = r.c, r.b, len(column)
            for size in (r.below, r.above):
                large += [len(column)] * (size > few)
                column, cut, left, level, share = [*column, -1], [*cut, 0], [*left, 0], [*level, level[r.node] + 1], [*share, None]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node = placed(batch)[1]
            yield pa.record_batch([*batch.columns, pa.array(node.astype(np.int32)), pa.array([share[v] for v in node.tolist()], pa.float64())], [*batch.schema.names, "node", "p"])

    def grow(part: pa.Table) -> pa.Table:
        x, n = (np.stack([part.column(c).to_numpy() for c in cs], axis=1).astype(np.int64) for cs in (names, ["n0", "n1"]))
        p = grown(x, n, depth - level[part.column("node")[0].as_py()], bins)
        return part.select(["model", *names]).append_column("p", pa.array(p))

    dealt = cells.mapInArrow(deal, f"model int, {kinds}, n0 long, n1 long, node int, p double")
    small = dealt.where("p is null").groupBy("node").applyInArrow(grow, f"model int, {kinds}, p double")
    scores = dealt.where("p is not null").select("model", *names, "p").unionByName(small).withColumnRenamed("model", "fold")
    mine = rows.mapInArrow(own, f"{key} {dict(rows.dtypes)[key]}, fold int, y {dict(rows.dtypes)['y']}, {kinds}")
    return mine.join(scores, ["fold", *names]).select(key, "fold", "y", "p")
