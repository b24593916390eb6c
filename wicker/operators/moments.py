"""Correlations of all pairs of columns in one pass, each over the rows where both have a value.

A task adds up masked cross products as matrices: for each pair the rows, both means, both sums of squared deviations and of their
product, over its rows where neither is missing. Matrices travel as square blocks and are merged sixteen to a task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from wicker.operators.order import ranges

#: Columns of a block; rows that are multiplied at once; tasks whose blocks one task merges.
SIDE, ROWS, FAN = 64, 4096, 16

STATE = "slot long, i int, j int, state binary"


def block_moments(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """(6, columns of x, columns of y): rows, mean of x, mean of y, and sums of squares and products about them, over values that are finite.
    Sums are taken from a value of the column near its mean, so that a constant column has deviations of exactly zero; pairs
    whose common rows lie far from it for their spread are taken again from a value of their own."""
    p, q = np.isfinite(x), np.isfinite(y)
    pivots = [np.array([c[m][np.argmin(np.abs(c[m] - c[m].mean()))] if m.any() else 0.0 for c, m in zip(z.T, has.T)]) for z, has in ((x, p), (y, q))]
    a, b = np.where(p, x - pivots[0], 0.0), np.where(q, y - pivots[1], 0.0)
    p, q = p.astype(float), q.astype(float)
    with np.errstate(invalid="ignore", divide="ignore"):
        n = p.T @ q
        some = np.maximum(n, 1)
        mx, my, sx, sy, xy = a.T @ q / some, p.T @ b / some, (a * a).T @ q, p.T @ (b * b), a.T @ b
        vx, vy, c = np.maximum(sx - n * mx * mx, 0), np.maximum(sy - n * my * my, 0), xy - n * mx * my
        far = ((vx < 1e-6 * sx) & (sx > 0)) | ((vy < 1e-6 * sy) & (sy > 0))
    out = np.stack([n, mx + pivots[0][:, None], my + pivots[1][None, :], vx, vy, c])
    for i, j in zip(*np.nonzero(far)):
        both = (p[:, i] > 0) & (q[:, j] > 0)
        u, v = x[both, i], y[both, j]
        du, dv = u - u[0], v - v[0]
        eu, ev = du - du.mean(), dv - dv.mean()
        out[:, i, j] = len(u), u[0] + du.mean(), v[0] + dv.mean(), eu @ eu, ev @ ev, eu @ ev
    return out


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The moments of the rows of both."""
    n = a[0] + b[0]
    share = np.divide(b[0], n, out=np.zeros_like(n), where=n > 0)
    dx, dy = np.where(b[0] > 0, b[1] - a[1], 0.0), np.where(b[0] > 0, b[2] - a[2], 0.0)
    dx, dy = np.where(a[0] > 0, dx, 0.0), np.where(a[0] > 0, dy, 0.0)
    weight = a[0] * share
    mean = lambda k, d: np.where(a[0] > 0, a[k] + d * share, b[k])
    return np.stack([n, mean(1, dx), mean(2, dy), a[3] + b[3] + dx * dx * weight, a[4] + b[4] + dy * dy * weight, a[5] + b[5] + dx * dy * weight])


def moments(df: DataFrame, columns: list[str]) -> DataFrame:
    """(slot, i, j, state): the merged blocks of columns i * SIDE.. and j * SIDE.., i <= j, in one slot."""
    starts = range(0, len(columns), SIDE)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], np.ndarray] = {}
        slot = None
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS):
                part = batch.slice(k, ROWS)
                slot = part.column(0)[0].as_py()
                x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in part.columns[1:]])
                for i, a in enumerate(starts):
                    for j, b in enumerate(starts[i:], i):
                        now = block_moments(x[:, a : a + SIDE], x[:, b : b + SIDE])
                        held[i, j] = merged(held[i, j], now) if (i, j) in held else now
        yield from rows_of({(slot, i, j): s for (i, j), s in held.items()})

    def shape(i: int, j: int) -> tuple[int, int, int]:
        return 6, min(SIDE, len(columns) - i * SIDE), min(SIDE, len(columns) - j * SIDE)

    def rows_of(held: dict) -> Iterator[pa.RecordBatch]:
        for (slot, i, j), s in held.items():
            yield pa.record_batch([pa.array([slot], pa.int64()), pa.array([i], pa.int32()), pa.array([j], pa.int32()), pa.array([s.tobytes()], pa.binary())], ["slot", "i", "j", "state"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int, int], np.ndarray] = {}
        for batch in batches:
            for slot, i, j, state in zip(*(c.to_pylist() for c in batch.columns)):
                key, s = (slot // FAN, i, j), np.frombuffer(state).reshape(shape(i, j))
                held[key] = merged(held[key], s) if key in held else s
        yield from rows_of(held)

    rows = df.select((F.spark_partition_id().cast("long") % ranges(df)).alias("slot"), *(F.col(f"`{c}`").cast("double").alias(f"_{k}") for k, c in enumerate(columns)))
    found, slots = rows.mapInArrow(add, STATE), ranges(df)
    blocks = len(starts) * (len(starts) + 1) // 2
    while True:
        slots = -(-slots // FAN)
        found = found.repartition(slots * blocks, F.floor(F.col("slot") / FAN), "i", "j").mapInArrow(merge, STATE)
        if slots == 1:
            return found


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, r) for every two columns, in their order: Pearson's correlation over the rows where both are finite numbers, no
    null or NaN; null where a column is constant on those rows or fewer than two are left. One pass over the rows."""
    if len(columns) < 2:
        return df.sparkSession.createDataFrame([], "a string, b string, r double")

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, i, j, state in zip(*(c.to_pylist() for c in batch.columns)):
                a, b = columns[i * SIDE : (i + 1) * SIDE], columns[j * SIDE : (j + 1) * SIDE]
                n, _, _, vx, vy, c = np.frombuffer(state).reshape(6, len(a), len(b))
                with np.errstate(invalid="ignore", divide="ignore"):
                    r = np.clip(c / np.sqrt(vx) / np.sqrt(vy), -1, 1)
                u, v = np.nonzero(np.arange(len(a))[:, None] + i * SIDE < np.arange(len(b))[None, :] + j * SIDE)
                r = r[u, v]
                yield pa.record_batch([pa.array([a[k] for k in u], pa.string()), pa.array([b[k] for k in v], pa.string()), pa.array(r, mask=~np.isfinite(r))], ["a", "b", "r"])

    found = moments(df, columns).mapInArrow(pairs, "a string, b string, r double")
    none = df.sparkSession.createDataFrame([(a, b) for k, a in enumerate(columns) for b in columns[k + 1 :]], "a string, b string")
    return none.join(found, ["a", "b"], "left")
