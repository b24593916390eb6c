"""Global orders and exact quantiles without a task that holds all rows: rows are dealt to ranges, one for each partition, and what
stands before a range is added to what stands before a row within it."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row, Window, functions as F
from pyspark.sql.types import DoubleType, IntegralType, LongType, StructField, StructType

from wicker.sources.tables import checkpointed


def ranges(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def ranged(df: DataFrame, *order: str) -> DataFrame:
    """df with _part: partition p has the p-th range of the columns' order, nulls first, and is sorted within."""
    keys = [F.col(c).asc_nulls_first() for c in order]
    return df.repartitionByRange(ranges(df), *keys).sortWithinPartitions(*keys).withColumn("_part", F.spark_partition_id())


def before(rows: DataFrame, by: list[str], sums: dict[str, Column]) -> DataFrame:
    """(by, _part, names): for each range, the sums over the ranges before it; the first range of a group isn't there."""
    total = rows.groupBy(*by, "_part").agg(*(f.alias(n) for n, f in sums.items()))
    over = Window.partitionBy(*by).orderBy("_part")
    earlier = [F.coalesce(F.sum(n).over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(n) for n in sums]
    return total.select(*by, "_part", F.row_number().over(over).alias("_first"), *earlier).where("_first > 1").drop("_first")


def with_before(rows: DataFrame, base: DataFrame, by: list[str], sums: list[str]) -> DataFrame:
    join = F.lit(True)
    for c in [*by, "_part"]:
        join = join & F.col(f"_a.`{c}`").eqNullSafe(F.col(f"_b.`{c}`"))
    return rows.alias("_a").join(base.alias("_b"), join, "left").select("_a.*", *(F.coalesce(f"_b.{n}", F.lit(0)).alias(n) for n in sums))


def running(df: DataFrame, column: str, sums: dict[str, str], by: list[str] | None = None, inclusive: bool = True) -> DataFrame:
    """df, which has each value of column once in a group of ``by``, with the sums (name: column) over all rows up to the row's value;
    not inclusive: below it. Null counts as 0 in a sum.

    Ranges are of group and value together, so only a range's first group goes on from an earlier one: what it adds is at most
    a row for each range, and goes to every task. Ranges come from a sample, so the rows are written to the checkpoint folder
    with them; both reads see the same."""
    by = by or []
    kinds = {n: LongType() if isinstance(df.schema[c].dataType, IntegralType) else DoubleType() for n, c in sums.items()}
    rows = ranged(df, *by, column)
    schema = StructType([*rows.schema.fields, *(StructField(n, k) for n, k in kinds.items())])
    names, sizes = rows.columns, {n: "int64" if isinstance(k, LongType) else "float64" for n, k in kinds.items()}

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, carried = None, dict.fromkeys(sums, 0)
        for batch in batches:
            if not batch.num_rows:
                continue
            first = np.zeros(batch.num_rows, bool)
            for c in by:
                x = batch.column(names.index(c))
                a, b = x[1:], x[:-1]
                first[1:] |= pc.fill_null(pc.not_equal(a, b), True).to_numpy(zero_copy_only=False) & ~pc.and_(pc.is_null(a), pc.is_null(b)).to_numpy(zero_copy_only=False)
            here = [batch.column(names.index(c)) for c in by]
            first[0] = last != [x[0].as_py() for x in here]
            start, group = np.flatnonzero(first), np.cumsum(first) - 1
            out = []
            for n, c in sums.items():
                v = pc.fill_null(batch.column(names.index(c)), 0).to_numpy(zero_copy_only=False).astype(sizes[n])
                total = np.cumsum(v)
                offset = np.concatenate([total[start] - v[start], [-carried[n]]])  # the last one stands for a group begun earlier
                total = total - offset[group]
                carried[n] = total[-1]
                out.append(pa.array(total if inclusive else total - v))
            last = [x[-1].as_py() for x in here]
            yield pa.record_batch([*batch.columns, *out], [*names, *sums])

    laid = checkpointed(rows.mapInArrow(scan, schema))
    base = before(laid, by, {f"_{n}": F.sum(c) for n, c in sums.items()})
    whole = with_before(laid, F.broadcast(base), by, [f"_{n}" for n in sums])
    return whole.withColumns({n: F.col(n) + F.col(f"_{n}").cast(kinds[n]) for n in sums}).drop("_part", *(f"_{n}" for n in sums))


def numbered(df: DataFrame, *keys: str | Column, name: str = "k") -> DataFrame:
    """df with its row's position, from 0, in the order of the keys, which together are unique; null keys come first."""
    order = {f"_key{i}": F.col(k) if isinstance(k, str) else k for i, k in enumerate(keys)}
    within = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))  # the row's place in its partition
    laid = checkpointed(ranged(df.withColumns(order), *order).withColumn(name, within).drop(*order))
    base = before(laid, [], {"_before": F.count("*")})
    return with_before(laid, F.broadcast(base), [], ["_before"]).withColumn(name, F.col(name) + F.col("_before")).drop("_part", "_before")


def dealt(df: DataFrame, digest: Column, keys: list[str], by: list[str] | None = None, name: str = "k", few: bool = False) -> DataFrame:
    """The same in the order of a hexadecimal digest and keys, within each group of ``by``: the digest's first digits are the ranges,
    of equal size by nature and some for each partition. ``few`` says that there are few groups: what stands before their ranges then
    goes to every task, and rows aren't shuffled once more to meet it."""
    by = by or []
    digits = max(1, math.ceil(math.log(4 * ranges(df), 16)))
    rows = df.withColumn("_key", digest).withColumn("_part", F.conv(F.left("_key", F.lit(digits)), 16, 10).cast("int"))
    at = F.row_number().over(Window.partitionBy(*by, "_part").orderBy("_key", *keys)) - 1
    base = before(rows, by, {"_before": F.count("*")})
    whole = with_before(rows.withColumn(name, at), F.broadcast(base) if few else base, by, ["_before"])
    return whole.withColumn(name, (F.col(name) + F.col("_before")).cast("long")).drop("_key", "_part", "_before")


def within(df: DataFrame, bounds: dict[tuple[str, int], tuple[float, float]], values: bool) -> DataFrame:
    """(j, v, m) for the j-th bounds (column, number): (low, high) of a column: a row without v for the m values below low, and one
    for each value within, or without ``values`` one for all of them (v is 0). Added up over all rows, NaN aside."""
    keys, columns = list(bounds), sorted({c for c, _ in bounds})
    of = {c: [j for j, k in enumerate(keys) if k[0] == c] for c in columns}
    edges = {c: np.array([bounds[keys[j]] for j in js], float) for c, js in of.items()}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            js, vs, ms, null = [], [], [], []
            for c, x in zip(columns, batch.columns):
                x = x.drop_null().to_numpy(zero_copy_only=False)
                x = np.sort(x[~np.isnan(x)]) + 0.0
                low, high = np.searchsorted(x, edges[c][:, 0], "left"), np.searchsorted(x, edges[c][:, 1], "right")
                for j, a, b in zip(of[c], low.tolist(), np.maximum(low, high).tolist()):
                    v, m = np.unique(x[a:b], return_counts=True) if values else (np.zeros(1), np.array([b - a]))
                    js.append(np.full(len(v) + 1, j))
                    vs.append(np.concatenate([[0.0], v]))
                    ms.append(np.concatenate([[a], m]))
                    null.append(np.arange(len(v) + 1) == 0)
            js, vs, ms, null = map(np.concatenate, (js, vs, ms, null))
            keep = ms > 0
            yield pa.record_batch([pa.array(js[keep], pa.int32()), pa.array(vs[keep], mask=null[keep]), pa.array(ms[keep], pa.int64())], ["j", "v", "m"])

    found = df.select(*(F.col(f"`{c}`").cast("double") for c in columns)).mapInArrow(count, "j int, v double, m long")
    return found.groupBy("j", "v").agg(F.sum("m").alias("m"))


def numeric(column: str) -> Column:
    """The column as a number, null for NaN."""
    v = F.col(f"`{column}`").cast("double")
    return F.when(~F.isnan(v), v)


def sketched(df: DataFrame, wanted: dict[str, list[float]], near: float, **also: Column) -> Row:
    """One row: how many values each column has (its name), bounds around its wanted quantiles (name_q), and further aggregates, all in
    one pass."""
    edges = lambda ps: [x for p in ps for x in (max(0.0, p - near), min(1.0, p + near))]
    return df.agg(F.lit(0).alias("_"), *(F.count(numeric(c)).alias(c) for c in wanted), *(F.percentile_approx(numeric(c), edges(ps), 10_000).alias(f"{c}_q") for c, ps in wanted.items() if ps), *(f.alias(n) for n, f in also.items())).first()


def quantiles(df: DataFrame, wanted: dict[str, list[float]], few: int = 100_000, near: float = 5e-4, known: Row | None = None) -> dict[str, list[float | None]]:
    """Exact quantiles of numbers, linear between neighbours, nulls and NaN aside; None where there is no value.

    A sketch gives bounds around each rank, the share ``near`` of the rows to either side. Bounds that may hold more than ``few``
    rows are drawn closer in the same way until they don't, or hold one value. Then the values within bounds are counted and
    ranked, a quantile's in a task, and one row for each quantile comes back. few times near has to be some rows, for a sketch's
    own error is 1e-4. ``known`` is what ``sketched`` has given for the same columns, if a caller needed more of that pass."""
    if few * near < 10:
        raise ValueError("few times near is less than 10 rows")
    n = known or sketched(df, wanted, near)
    out = {c: [None] * len(ps) for c, ps in wanted.items()}
    bounds = {(c, i): (n[f"{c}_q"][2 * i], n[f"{c}_q"][2 * i + 1]) for c, ps in wanted.items() if n[c] for i in range(len(ps))}
    rank = {(c, i): wanted[c][i] * (n[c] - 1) for c, i in bounds}
    large = [k for k in bounds if n[k[0]] * 2 * near > few / 2]
    while large:
        held = {(r.j, r.v is None): r.m for r in within(df, {k: bounds[k] for k in large}, False).collect()}  # two rows for each
        closer = {}
        for j, k in enumerate(large):
            below, inside = held.get((j, True), 0), held.get((j, False), 0)
            if not below <= math.floor(rank[k]) <= math.ceil(rank[k]) < below + inside:
                bounds[k] = (-math.inf, math.inf)  # the sketch missed: from all values
                closer[k] = rank[k] / max(1, n[k[0]] - 1)
            elif inside > few and bounds[k][0] < bounds[k][1]:
                closer[k] = (rank[k] - below) / (inside - 1)
        if closer:
            part = lambda k: F.when(numeric(k[0]).between(*map(F.lit, bounds[k])), numeric(k[0]))
            drawn = df.agg(*(F.percentile_approx(part(k), [max(0.0, p - near), min(1.0, p + near)], 10_000).alias(str(j)) for j, (k, p) in enumerate(closer.items()))).first()
            same = [k for k, b in zip(closer, drawn) if tuple(b) == bounds[k]]
            bounds |= {k: tuple(b) for k, b in zip(closer, drawn)}
            closer = {k: p for k, p in closer.items() if k not in same}
        large = list(closer)
    while bounds:
        keys = list(bounds)
        ranks = df.sparkSession.createDataFrame([(j, math.floor(rank[k]), math.ceil(rank[k])) for j, k in enumerate(keys)], "j int, low long, high long")
        upto = F.sum("m").over(Window.partitionBy("j").orderBy(F.col("v").asc_nulls_first()))
        rows = within(df, bounds, True).withColumn("upto", upto).where("v is not null").join(F.broadcast(ranks), "j")
        at = lambda r: F.max(F.when((F.col("upto") - F.col("m") <= F.col(r)) & (F.col(r) < F.col("upto")), F.col("v"))).alias(r)
        found = {keys[r.j]: (r.low, r.high) for r in rows.groupBy("j").agg(at("low"), at("high")).collect()}
        bounds = {k: (-math.inf, math.inf) for k in bounds if None in found.get(k, (None,))}  # the sketch missed: from all values
        for (c, i), (low, high) in found.items():
            if low is not None and high is not None:
                out[c][i] = low + (high - low) * (rank[c, i] - math.floor(rank[c, i]))
    return out
