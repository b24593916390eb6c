"""Exact nearest neighbours: a ball tree deals rows to leaves, each row searches its own leaf, then every other leaf that may hold
a nearer one.

The tree is fitted on a bounded sample; the balls and boxes of its leaves are those of all rows. A box or ball whose nearest edge
is beyond a row's k-th gap holds no neighbour of it, nor do those within it, so a search goes down few branches. Rows with equal
numbers are one while they are searched for; of each such group the first k + 1 can be neighbours."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from wicker.operators.order import ranges
from wicker.sources.tables import checkpointed

#: Rows that the tree is fitted on at most, and of a leaf on average; numbers of a matrix of gaps.
SAMPLE, LEAF, GAPS = 131_072, 1000, 4_000_000


@dataclass
class BallTree:
    """A complete binary tree in level order: node i parts rows by axis[i] at cut[i], its children are 2i + 1 and 2i + 2. Nodes
    have boxes low..high and balls of radius about centre; of leaves there are count points, in blocks."""

    axis: np.ndarray
    cut: np.ndarray
    low: np.ndarray | None = None
    high: np.ndarray | None = None
    centre: np.ndarray | None = None
    radius: np.ndarray | None = None
    count: np.ndarray | None = None

    @property
    def inner(self) -> int:
        return len(self.axis)

    def leaf(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), np.int64)
        for _ in range((self.inner + 1).bit_length() - 1):
            node = 2 * node + 1 + (x[np.arange(len(x)), self.axis[node]] > self.cut[node])
        return node - self.inner

    def gaps(self, x: np.ndarray, node: int) -> np.ndarray:
        """The least squared distance that a point below the node may have, a little less for rounding."""
        box = np.maximum(np.maximum(self.low[node] - x, x - self.high[node]), 0)
        ball = np.maximum(np.sqrt(((x - self.centre[node]) ** 2).sum(axis=1)) * (1 - 1e-12) - self.radius[node], 0)
        return np.maximum((box * box).sum(axis=1), ball * ball) * (1 - 1e-9)

    def reached(self, x: np.ndarray, far: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows, leaves): for each row the leaves with points that may lie within its far, a squared distance."""
        rows, leaves, todo = [], [], [(0, np.arange(len(x)))]
        while todo:
            node, some = todo.pop()
            some = some[self.gaps(x[some], node) <= far[some]] if np.isfinite(self.low[node, 0]) else some[:0]
            if len(some) and node >= self.inner:
                rows.append(some)
                leaves.append(np.full(len(some), node - self.inner))
            elif len(some):
                todo += [(2 * node + 1, some), (2 * node + 2, some)]
        return (np.concatenate(rows), np.concatenate(leaves)) if rows else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def planted(sample: np.ndarray, leaves: int) -> BallTree:
    """Splits at the median of the axis with the widest spread; at least eight of the sample to a leaf."""
    depth = max(0, min(math.ceil(math.log2(max(1, leaves))), int(math.log2(max(1, len(sample) / 8)))))
    axis, cut, parts = np.zeros(2**depth - 1, np.int64), np.zeros(2**depth - 1), [sample]
    for node in range(2**depth - 1):
        part = parts[node]
        if len(part):
            axis[node] = np.argmax(part.max(axis=0) - part.min(axis=0))
            cut[node] = np.median(part[:, axis[node]])
        right = part[:, axis[node]] > cut[node]
        parts += [part[~right], part[right]]
    return BallTree(axis, cut)


def bounded(tree: BallTree, points: DataFrame, dims: int) -> BallTree:
    """The tree with the boxes and balls of all points. A row for each leaf comes to the driver; the sample bounds them."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, leaf = matrix(batch.column(0), dims), batch.column(1).to_numpy()
            order = np.argsort(leaf, kind="stable")
            edge = np.flatnonzero(np.diff(leaf[order], prepend=-1))
            if len(edge):
                y = x[order]
                low, high = np.minimum.reduceat(y, edge), np.maximum.reduceat(y, edge)
                yield pa.record_batch([pa.array(leaf[order][edge]), pa.array(np.diff(np.append(edge, len(leaf)))), pa.array(low.tolist(), pa.list_(pa.float64())), pa.array(high.tolist(), pa.list_(pa.float64()))], ["_leaf", "m", "low", "high"])

    found = points.select("_x", "_leaf").mapInArrow(measure, "_leaf int, m long, low array<double>, high array<double>")
    edge = lambda f, c: F.array(*(f(F.col(c)[i]) for i in range(dims))).alias(c)
    rows = found.groupBy("_leaf").agg(F.sum("m").alias("m"), edge(F.min, "low"), edge(F.max, "high")).collect()
    n = 2 * tree.inner + 1
    tree.low, tree.high, tree.count = np.full((n, dims), np.inf), np.full((n, dims), -np.inf), np.zeros(tree.inner + 1, np.int64)
    for r in rows:
        tree.low[tree.inner + r._leaf], tree.high[tree.inner + r._leaf], tree.count[r._leaf] = r.low, r.high, r.m
    for node in range(tree.inner - 1, -1, -1):
        for out, how in ((tree.low, np.minimum), (tree.high, np.maximum)):
            out[node] = how(out[2 * node + 1], out[2 * node + 2])
    some = np.isfinite(tree.low)
    tree.centre = np.where(some, tree.low / 2 + np.where(some, tree.high, 0) / 2, 0)
    tree.radius = np.full(n, np.inf)
    middle = tree.centre[tree.inner :]

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = np.zeros(len(middle))
        for batch in batches:
            leaf = batch.column(1).to_numpy()
            np.maximum.at(most, leaf, np.sqrt(((matrix(batch.column(0), dims) - middle[leaf]) ** 2).sum(axis=1)))
        some = np.flatnonzero(most)
        yield pa.record_batch([pa.array(some.astype(np.int32)), pa.array(most[some])], ["_leaf", "radius"])

    tree.radius[tree.inner :] = 0
    for r in points.select("_x", "_leaf").mapInArrow(spread, "_leaf int, radius double").groupBy("_leaf").agg(F.max("radius").alias("radius")).collect():
        tree.radius[tree.inner + r._leaf] = r.radius * (1 + 1e-12)
    for node in range(tree.inner - 1, -1, -1):
        below = [c for c in (2 * node + 1, 2 * node + 2) if np.isfinite(tree.low[c, 0])]
        tree.radius[node] = max((np.linalg.norm(tree.centre[node] - tree.centre[c]) + tree.radius[c] for c in below), default=0) * (1 + 1e-12)
    return tree


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def first_of_equals(points: DataFrame, keep: int) -> DataFrame:
    """At most ``keep`` points of those equal in _x and _c, the first by neighbour: first of 64 shares, then of all, so that a group
    of any size is cut down before it meets in a task."""
    salted = points.withColumn("_salt", F.pmod(F.xxhash64("neighbour"), F.lit(64)))
    for by in (["_x", "_c", "_salt"], ["_x", "_c"]):
        salted = salted.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy("neighbour"))).where(F.col("_k") <= keep)
    return salted.drop("_salt", "_k")


def searched(points: DataFrame, sources: DataFrame, need: int, dims: int, penalty: float) -> DataFrame:
    """(_x, _c, neighbour, carried columns, gap): for each source (_x, _c, _leaf, _block) its first ``need`` points in that block of that
    leaf by gap and neighbour. A task holds the points of one block, sources go by."""
    carried = [f for f in points.schema.fields if f.name not in ("_x", "_c", "_leaf", "_block")]
    both = points.select("_leaf", "_block", F.lit(0).alias("_kind"), "_x", "_c", *(f.name for f in carried))
    both = both.unionByName(sources.select("_leaf", "_block", F.lit(1).alias("_kind"), "_x", "_c", *(F.lit(None).cast(f.dataType).alias(f.name) for f in carried)))
    names = ["_x", "_c", *(f.name for f in carried), "_y", "gap"]
    schema = ", ".join(["_x array<double>", "_c array<bigint>", *(f"`{f.name}` {f.dataType.simpleString()}" for f in carried), "_y array<double>", "gap double"])

    def compare(mine: pa.RecordBatch, held: pa.RecordBatch, x: np.ndarray, c: np.ndarray) -> Iterator[pa.RecordBatch]:
        step, k = max(1, GAPS // len(x)), min(need, len(x))
        for a in range(0, mine.num_rows, step):
            part = mine.slice(a, step)
            u, v = matrix(part.column("_x"), dims), part.column("_c").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
            gap = np.zeros((len(u), len(x)))
            for i in range(dims):
                d = u[:, i, None] - x[None, :, i]
                gap += d * d
            for i in range(c.shape[1]):
                gap += (v[:, i, None] != c[None, :, i]) * (penalty * penalty)
            r, p = np.nonzero(gap <= np.partition(gap, k - 1, axis=1)[:, k - 1 : k])
            order = np.lexsort((p, gap[r, p], r))  # points stand in the order of neighbour
            r, p = r[order], p[order]
            first = np.arange(len(r)) - np.searchsorted(r, r) < k
            r, p = r[first], p[first]
            at, of = pa.array(r), pa.array(p)
            yield pa.record_batch([part.column("_x").take(at), part.column("_c").take(at), *(held.column(f.name).take(of) for f in carried), held.column("_x").take(of), pa.array(gap[r, p])], names)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts, ready = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            place = np.column_stack([batch.column(i).to_numpy() for i in range(3)])
            edge = np.flatnonzero(np.concatenate([[True], (np.diff(place, axis=0) != 0).any(axis=1), [True]]))
            for a, b in zip(edge, edge[1:]):
                leaf, block, kind = place[a].tolist()
                if (leaf, block) != key:
                    key, parts, ready = (leaf, block), [], None
                if kind == 0:
                    parts.append(batch.slice(a, b - a))
                elif parts:
                    if ready is None:
                        held = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
                        ready = held, matrix(held.column("_x"), dims), held.column("_c").flatten().to_numpy(zero_copy_only=False).reshape(held.num_rows, -1)
                    yield from compare(batch.slice(a, b - a), *ready)

    dealt = both.repartition("_leaf", "_block").sortWithinPartitions("_leaf", "_block", "_kind", "neighbour")
    return dealt.mapInArrow(search, schema)


def nearest(a: DataFrame, b: DataFrame, dims: int, k: int, same: bool, penalty: float = 0.0, leaf: int = LEAF) -> DataFrame:
    """(source, v, w, neighbour, carried columns, gap, k): the k nearest rows of b (neighbour, w, _c, ...) to each row of a (source,
    v, _c), ties by neighbour; with ``same``, a row isn't its own neighbour. v and w are arrays of ``dims`` numbers, _c of hashes of
    categories: each that differs adds the square of ``penalty`` to the gap, a squared distance.

    Rows of which a number is null or NaN have no neighbours and are none. Fewer than k rows of b give fewer neighbours."""
    fine = lambda c: F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x))
    need = k + same
    points = checkpointed(first_of_equals(b.withColumnRenamed("w", "_x").where(fine("_x")), need))
    n = points.count()
    share = min(1.0, SAMPLE / max(1, n))
    some = points.where(F.pmod(F.xxhash64("_x", "neighbour"), F.lit(1 << 20)) < int(share * (1 << 20))).select("_x").limit(2 * SAMPLE).toPandas()["_x"]
    tree = planted(np.array(some.tolist(), float).reshape(len(some), dims), -(-n // leaf))

    def leaves(rows: DataFrame) -> DataFrame:
        def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.record_batch([*batch.columns, pa.array(tree.leaf(matrix(batch.column(batch.schema.names.index("_x")), dims)).astype(np.int32))], [*batch.schema.names, "_leaf"])

        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
        return rows.mapInArrow(put, f"{kinds}, _leaf int")

    placed = leaves(points)
    tree = bounded(tree, placed, dims)
    blocks = np.maximum(1, -(-tree.count // (4 * leaf)))  # a leaf that the sample didn't foresee is searched block by block
    of = F.element_at(F.lit(blocks.tolist()).cast("array<int>"), F.col("_leaf") + 1) if (blocks > 1).any() else F.lit(1)
    placed = checkpointed(placed.withColumn("_block", F.pmod(F.xxhash64("neighbour"), of).cast("int")))
    sources = checkpointed(leaves(a.where(fine("v")).select(F.col("v").alias("_x"), "_c").distinct()).withColumn("_block", F.pmod(F.xxhash64("_x"), of).cast("int")))
    first = checkpointed(searched(placed, sources, need, dims, penalty))
    far = first.groupBy("_x", "_c").agg(F.max("gap").alias("_far"), F.count("*").alias("m")).where(F.col("m") == need).select("_x", "_c", "_far")

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 4096):
                batch = whole.slice(i, 4096)
                x, own, mine = matrix(batch.column(0), dims), batch.column(2).to_numpy(), batch.column(3).to_numpy()
                bound = batch.column(4).to_numpy(zero_copy_only=False).astype(float)
                row, leaf = tree.reached(x, np.where(np.isnan(bound), np.inf, bound))
                times = blocks[leaf]
                row, leaf = np.repeat(row, times), np.repeat(leaf, times)
                block = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
                other = (leaf != own[row]) | (block != mine[row])
                at = pa.array(row[other])
                yield pa.record_batch([batch.column(0).take(at), batch.column(1).take(at), pa.array(leaf[other].astype(np.int32)), pa.array(block[other].astype(np.int32))], ["_x", "_c", "_leaf", "_block"])

    sought = sources.join(far, ["_x", "_c"], "left").select("_x", "_c", "_leaf", "_block", "_far").mapInArrow(route, "_x array<double>, _c array<bigint>, _leaf int, _block int")
    found = first.unionByName(searched(placed, sought, need, dims, penalty))
    best = found.withColumn("k", F.row_number().over(Window.partitionBy("_x", "_c").orderBy("gap", "neighbour"))).where(F.col("k") <= need).drop("k")
    pairs = a.where(fine("v")).select("source", F.col("v").alias("_x"), "_c").join(best, ["_x", "_c"])
    if same:
        pairs = pairs.where("source <> neighbour")
    ranked = pairs.withColumn("k", F.row_number().over(Window.partitionBy("source").orderBy("gap", "neighbour"))).where(F.col("k") <= k)
    return ranked.select("source", F.col("_x").alias("v"), F.col("_y").alias("w"), *(c for c in best.columns if c not in ("_x", "_c", "_y", "gap")), "gap", "k")


def codes(sides: list[str]) -> Column:
    """Hashes of the categories, null as a category of its own; an array that may be empty."""
    return F.array(*(F.xxhash64(F.col(s).isNull(), F.col(s).cast("string")) for s in sides)).cast("array<bigint>")


def numbers(columns: list[str]) -> Column:
    return F.array(*(F.col(c).cast("double") for c in columns))


def neighbours(df: DataFrame, columns: list[str], key: str, k: int = 5, cells: int = 1, sides: list[str] | None = None, penalty: float = 0.0) -> DataFrame:
    """(source, v, w, neighbour, sides, gap, k): the k nearest rows to each row, with both rows' numbers. ``sides`` that differ add
    the square of penalty to the gap. At least ``cells`` leaves are asked for."""
    sides = sides or []
    rows = df.select(F.col(key).alias("source"), numbers(columns).alias("v"), (codes(sides) if penalty else codes([])).alias("_c"), *sides)
    leaf = max(1, min(LEAF, rows.count() // cells)) if cells > 1 else LEAF
    return nearest(rows.select("source", "v", "_c"), rows.withColumnsRenamed({"source": "neighbour", "v": "w"}), len(columns), k, True, penalty, leaf)


def nearest_category(made: DataFrame, real: DataFrame, columns: list[str], made_key: str, real_key: str, category: str) -> DataFrame:
    """(made_key, category): the category of the nearest real row; ties go to the smallest key."""
    a = made.select(F.col(made_key).alias("source"), numbers(columns).alias("v"), codes([]).alias("_c"))
    b = real.select(F.col(real_key).alias("neighbour"), numbers(columns).alias("w"), codes([]).alias("_c"), F.col(category).alias("_category"))
    return nearest(a, b, len(columns), 1, False).select(F.col("source").alias(made_key), F.col("_category").alias(category))


def nominal_penalty(df: DataFrame, columns: list[str]) -> float:
    """What a category that differs counts for among numbers: the median of the columns' standard deviations."""
    found = df.agg(F.lit(0).alias("_"), *(F.stddev_pop(F.col(c).cast("double")).alias(f"_{i}") for i, c in enumerate(columns))).first()[1:]
    return float(np.median([x for x in found if x is not None])) if any(x is not None for x in found) else 0.0
