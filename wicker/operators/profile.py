"""Profiles of columns and rows. Each reads its frame once: all columns are aggregated together, then laid out as rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from wicker.operators.moments import correlations
from wicker.operators.order import numbered, quantiles, sketched


def per_column(df: DataFrame, columns: list[str], **measures) -> DataFrame:
    """A row for each column with its measures, functions from a column to an aggregate: one aggregation over all columns."""
    wide = df.agg(*(F.struct(F.lit(c).alias("column"), *(f(F.col(c)).alias(m) for m, f in measures.items())).alias(f"_{i}") for i, c in enumerate(columns)))
    return wide.select(F.inline(F.array(*(f"_{i}" for i in range(len(columns))))))


def describe_exact(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, n, mean, std, low, high, q25, q50, q75) in two passes: the first has all but the exact quartiles, of which it
    has bounds. A row for each column comes to the driver."""
    wanted = {c: [0.25, 0.5, 0.75] for c in columns}
    rest = lambda c: F.struct(F.count(c).alias("n"), F.round(F.avg(c), 6).alias("mean"), F.round(F.stddev(c), 6).alias("std"), F.min(c).cast("double").alias("low"), F.max(c).cast("double").alias("high"))
    known = sketched(df, wanted, 5e-4, **{f"{c}_rest": rest(c) for c in columns})
    rows = [(c, *known[f"{c}_rest"], *(None if x is None else round(x, 6) for x in q)) for c, q in quantiles(df, wanted, known=known).items()]
    return df.sparkSession.createDataFrame(rows, "column string, n long, mean double, std double, low double, high double, q25 double, q50 double, q75 double")


def zero_ratio(df: DataFrame, columns: list[str]) -> DataFrame:
    return per_column(df, columns, zero_ratio=lambda c: F.round(F.avg((c == 0).cast("int")), 9))


def sentinel_scan(df: DataFrame, columns: list[str], sentinels: list[float]) -> DataFrame:
    """How often each sentinel stands in each column, for those that occur."""
    found = per_column(df, columns, n=lambda c: F.array(*(F.struct(F.lit(float(s)).alias("sentinel"), F.sum((c == s).cast("long")).alias("n")) for s in sentinels)))
    return found.select("column", F.inline("n")).where("n > 0")


def ghost_values(df: DataFrame, columns: list[str], top: int = 3, least: int = 5, spread: float = 20, size: float = 50) -> DataFrame:
    """Frequent values far outside a column's bulk: among the top most frequent, occurring at least ``least`` times, further than
    ``spread`` times p99 - p1 from the median, beyond ``size``, in columns of more than two values."""
    long = df.select(F.expr(f"stack({len(columns)}, {', '.join(f'{chr(39)}{c}{chr(39)}, cast(`{c}` as double)' for c in columns)}) as (column, v)")).where("v is not null")
    count = long.groupBy("column", "v").agg(F.count("*").alias("n"))
    distinct = count.groupBy("column").agg(F.count("*").alias("distinct"))
    salted = count.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(64)))  # first the most frequent of 64 shares, then of all
    for by in (["column", "salt"], ["column"]):
        salted = salted.withColumn("k", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), "v"))).where(F.col("k") <= top).drop("k")
    best = salted.join(F.broadcast(distinct), "column").where((F.col("n") >= least) & (F.abs("v") > size) & (F.col("distinct") > 2)).select("column", "v", "n").collect()
    found = quantiles(df, {c: [0.01, 0.5, 0.99] for c in {r["column"] for r in best}}) if best else {}
    far = [r for r in best for low, mid, high in [found[r["column"]]] if abs(r.v - mid) > spread * (high - low)]
    return df.sparkSession.createDataFrame(far, "column string, v double, n long")


def out_of_range(train: DataFrame, test: DataFrame, columns: list[str]) -> DataFrame:
    """Test rows below the training minimum and above its maximum, for each column. The bounds are one row."""
    bounds = train.agg(*(f(c).alias(f"{m}_{c}") for c in columns for m, f in (("lo", F.min), ("hi", F.max))))
    seen = test.crossJoin(F.broadcast(bounds))
    one = seen.agg(*(F.struct(F.lit(c).alias("column"), F.sum((F.col(c) < F.col(f"lo_{c}")).cast("long")).alias("below"), F.sum((F.col(c) > F.col(f"hi_{c}")).cast("long")).alias("above")).alias(f"_{i}") for i, c in enumerate(columns)))
    return one.select(F.inline(F.array(*(f"_{i}" for i in range(len(columns))))))


def level_overlap(train: DataFrame, test: DataFrame, column: str) -> DataFrame:
    """Levels of train, test and both, and the test rows whose level train lacks."""
    a, b = train.groupBy(column).agg(F.lit(1).alias("in_train")), test.groupBy(column).agg(F.count("*").alias("n"))
    both = a.join(b, column, "full")
    flag = lambda c: F.sum(c.cast("long"))
    left, right = F.col("in_train").isNotNull(), F.col("n").isNotNull()
    return both.agg(flag(left).alias("train_levels"), flag(right).alias("test_levels"), flag(left & right).alias("shared"), flag(left & ~right).alias("train_only"), flag(~left & right).alias("test_only"), F.coalesce(F.sum(F.when(~left, F.col("n"))), F.lit(0)).alias("unseen_rows"))


def duplicate_columns(df: DataFrame, columns: list[str], key: str) -> DataFrame:
    """(kept, dropped): columns equal in every row, the first by name kept. One pass sums hashes of key and value; only
    columns whose sums agree are then compared exactly."""
    sums = df.agg(*(F.sum(F.xxhash64(key, F.col(c).cast("string")).cast("decimal(38,0)")).alias(c) for c in columns)).first().asDict()
    pairs = [(a, b) for i, a in enumerate(sorted(columns)) for b in sorted(columns)[i + 1 :] if sums[a] == sums[b]]
    spark = df.sparkSession
    if not pairs:
        return spark.createDataFrame([], "kept string, dropped string")
    same = df.agg(*(F.bool_and(F.col(a).eqNullSafe(F.col(b))).alias(f"{i}") for i, (a, b) in enumerate(pairs))).first()
    kept, out = {}, []
    for (a, b), equal in zip(pairs, same):
        if equal and b not in kept:
            kept[b] = kept.get(a, a)
            out.append((kept[b], b))
    return spark.createDataFrame(out, "kept string, dropped string")


def duplicate_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    n = df.groupBy(*columns).agg(F.count("*").alias("n")).where("n > 1")
    return n.agg(F.count("*").alias("groups"), F.coalesce(F.sum("n"), F.lit(0)).alias("involved"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("dropped"))


def label_conflicts(df: DataFrame, columns: list[str], label: str) -> DataFrame:
    g = df.groupBy(*columns).agg(F.count("*").alias("n"), F.count_distinct(label).alias("labels"), F.round(F.avg(label), 6).alias("rate"))
    return g.where("n > 1 and labels > 1")


def block_rates(df: DataFrame, key: str, label: str, blocks: int = 10) -> DataFrame:
    """The label's rate in contiguous blocks of rows in key order; the last takes the remainder."""
    n = df.count()
    block = F.least(F.floor(F.col("k") / max(1, n // blocks)), F.lit(blocks - 1)).cast("long")
    return numbered(df.select(key, label), key).groupBy(block.alias("block")).agg(F.count("*").alias("n"), F.round(F.avg(label), 9).alias("rate"))


def near_duplicate_columns(df: DataFrame, columns: list[str], least: float = 0.999) -> DataFrame:
    """(column, group): columns joined by correlations beyond ``least`` in size; a group is named by its first column."""
    group = {c: c for c in columns}
    for a, b, _ in correlations(df, columns).where(F.abs("r") > least).collect():
        low, high = sorted((group[a], group[b]))
        group = {c: low if g == high else g for c, g in group.items()}
    return df.sparkSession.createDataFrame(sorted(group.items()), "column string, group string")


def contract(df: DataFrame, key: str, label: str, low: float, high: float, expected: DataFrame) -> DataFrame:
    """One row of checks of an output: as many rows as expected, the same keys, each once, no nulls, labels 0 or 1, a plausible
    positive rate."""
    rate = F.avg(label)
    own = df.agg(F.count("*").alias("n"), (F.count_distinct(key) == F.count("*")).alias("unique_key"), (F.count(label) == F.count("*")).alias("no_nulls"), F.bool_and(F.col(label).isin(0, 1)).alias("binary"), ((rate > low) & (rate < high)).alias("plausible"))
    both = df.groupBy(key).agg(F.count("*").alias("_a")).join(expected.groupBy(key).agg(F.count("*").alias("_b")), key, "full")
    same = both.agg(F.coalesce(F.bool_and(F.col("_a").eqNullSafe(F.col("_b"))), F.lit(True)).alias("same_keys"), (F.coalesce(F.sum("_a"), F.lit(0)) == F.coalesce(F.sum("_b"), F.lit(0))).alias("same_count"))
    return own.crossJoin(F.broadcast(same))


def probability_contract(df: DataFrame, key: str, score: str) -> DataFrame:
    """One row of checks: keys are 0..n-1, each once; scores are finite and strictly between 0 and 1."""
    p = F.col(score)
    finite = p.isNotNull() & ~F.isnan(p) & (F.abs(p) < float("inf"))
    return df.agg(F.count("*").alias("n"), ((F.min(key) == 0) & (F.max(key) == F.count("*") - 1) & (F.count_distinct(key) == F.count("*"))).alias("dense_keys"), F.bool_and(finite).alias("finite"), F.bool_and(F.coalesce((p > 0) & (p < 1), F.lit(False))).alias("inside"))


def missing_cells(df: DataFrame, columns: list[str]) -> DataFrame:
    """The number of missing cells, nulls and NaN, over all the columns."""
    lost = lambda c: F.col(c).isNull() | F.isnan(F.col(c)) if dict(df.dtypes)[c] in ("double", "float") else F.col(c).isNull()
    return df.agg(F.sum(sum((lost(c).cast("long") for c in columns), F.lit(0).cast("long"))).alias("missing"))


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def flag_tables(df: DataFrame, flags: list[str], least: float) -> DataFrame:
    """(a, b, both, only_a, only_b, neither) for the pairs of 0/1 columns with a correlation beyond ``least`` in size."""
    pairs = [(r.a, r.b) for r in correlations(df, flags).where(F.abs("r") > least).collect()]
    if not pairs:
        return df.sparkSession.createDataFrame([], "a string, b string, both long, only_a long, only_b long, neither long")
    hit = lambda a, b, x, y, name: F.count_if((F.col(a) == x) & (F.col(b) == y)).alias(name)
    one = df.agg(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), hit(a, b, 1, 1, "both"), hit(a, b, 1, 0, "only_a"), hit(a, b, 0, 1, "only_b"), hit(a, b, 0, 0, "neither")).alias(f"_{i}") for i, (a, b) in enumerate(pairs)))
    return one.select(F.inline(F.array(*(f"_{i}" for i in range(len(pairs))))))


def constant_sides(df: DataFrame, columns: list[str], side: str) -> DataFrame:
    """(column, in_train, in_test): whether the rows with side 1, and those with 0, have at most one value."""
    alone = lambda k: lambda c: F.coalesce(F.min(F.when(F.col(side) == k, c)) == F.max(F.when(F.col(side) == k, c)), F.lit(True))
    return per_column(df, columns, in_train=alone(1), in_test=alone(0))
