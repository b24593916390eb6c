"""Transforms of columns and statistics of rows, as expressions that stay in generated code. Nulls stay null."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from wicker.operators.evaluate import rank_norm
from wicker.operators.order import quantiles


def bounds(df: DataFrame, columns: list[str], low: float = 0.0, high: float = 1.0) -> DataFrame:
    """One row: c_lo and c_hi for each column, quantiles or, at 0 and 1, the extremes."""
    inner = [p for p in (low, high) if p not in (0.0, 1.0)]
    found = quantiles(df, {c: inner for c in columns}) if inner else {}
    edge = lambda c, p, f: f(c) if p in (0.0, 1.0) else F.lit(found[c][inner.index(p)]).cast("double")
    return df.agg(F.lit(0).alias("_"), *(x for c in columns for x in (edge(c, low, F.min).alias(f"{c}_lo"), edge(c, high, F.max).alias(f"{c}_hi")))).drop("_")


def clip(df: DataFrame, columns: list[str], fitted: DataFrame) -> DataFrame:
    clipped = {c: F.when(F.col(c).isNotNull(), F.greatest(F.least(c, f"{c}_hi"), F.col(f"{c}_lo"))) for c in columns}
    return df.crossJoin(F.broadcast(fitted)).withColumns(clipped).drop(*fitted.columns)


def standard_scale(df: DataFrame, columns: list[str], fitted_on: DataFrame) -> DataFrame:
    """Centred on the mean, in population standard deviations; a constant column gives zeros."""
    fitted = fitted_on.agg(*(x for c in columns for x in (F.avg(c).alias(f"{c}_m"), F.stddev_pop(c).alias(f"{c}_s"))))
    out = {c: (F.col(c) - F.col(f"{c}_m")) / F.when(F.col(f"{c}_s") == 0, 1.0).otherwise(F.col(f"{c}_s")) for c in columns}
    return df.crossJoin(F.broadcast(fitted)).withColumns(out).drop(*fitted.columns)


def robust_scale(df: DataFrame, columns: list[str], fitted_on: DataFrame, low: float = 0.25, high: float = 0.75) -> DataFrame:
    """Centred on the median, in units of the distance between two quantiles, 1 where that is none; nulls without any value."""
    found = quantiles(fitted_on, {c: [low, 0.5, high] for c in columns})
    spread = lambda q: 1.0 if q[2] is None or q[2] == q[0] else q[2] - q[0]
    return df.withColumns({c: (F.col(c) - F.lit(found[c][1]).cast("double")) / F.lit(spread(found[c])) for c in columns})


def interactions(columns: list[str]) -> list[Column]:
    """Sum, difference, product and ratio of every two columns; a zero denominator counts as 1e-5."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    ratio = lambda a, b: F.col(a) / F.when(F.col(b) == 0, 1e-5).otherwise(F.col(b))
    return [x for a, b in pairs for x in ((F.col(a) + F.col(b)).alias(f"{a}_plus_{b}"), (F.col(a) - F.col(b)).alias(f"{a}_minus_{b}"), (F.col(a) * F.col(b)).alias(f"{a}_times_{b}"), ratio(a, b).alias(f"{a}_over_{b}"))]


def anova_f(df: DataFrame, columns: list[str], label: str) -> DataFrame:
    """The F statistic of each column between the label's classes, from sums over classes."""
    g = df.groupBy(label).agg(*(F.struct(F.lit(c).alias("column"), F.count(c).alias("n"), F.sum(c).alias("s"), F.var_pop(c).alias("v")).alias(f"_{i}") for i, c in enumerate(columns)))
    long = g.select(F.inline(F.array(*(f"_{i}" for i in range(len(columns))))))
    t = long.groupBy("column").agg(F.count("*").alias("g"), F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("b"), F.sum(F.col("v") * F.col("n")).alias("w"))
    return t.select("column", ((F.col("b") - F.col("s") * F.col("s") / F.col("n")) / (F.col("g") - 1) / (F.col("w") / (F.col("n") - F.col("g")))).alias("f"))


def row_sum(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)


def row_quantile(ordered: Column, p: float) -> Column:
    """Linear interpolation between the sorted values; null for an empty array."""
    at = (F.size(ordered) - 1) * F.lit(p)
    low, high = F.floor(at).cast("int"), F.ceil(at).cast("int")
    a, b = F.get(ordered, low), F.get(ordered, high)
    return a + (b - a) * (at - low)


def row_stats(df: DataFrame, vector: str) -> DataFrame:
    """df with the statistics of each row's numbers: n, mean, population and sample deviation, extremes, quartiles, spread,
    counts of zeros and negatives, population skewness and excess kurtosis (0 for a constant row), and the median absolute
    deviation. Nulls and NaN are left out; an empty row has null statistics."""
    x = F.filter(F.col(vector), lambda v: v.isNotNull() & ~F.isnan(v))
    d = df.withColumn("_x", F.array_sort(x)).withColumn("n_valid", F.size("_x").cast("long")).withColumn("row_mean", row_sum(F.col("_x")) / F.nullif("n_valid", F.lit(0)))
    power = lambda k: row_sum(F.transform("_x", lambda v: reduce(lambda a, b: a * b, [v - F.col("row_mean")] * k))) / F.nullif("n_valid", F.lit(0))
    d = d.withColumns({"_m2": power(2), "_m3": power(3), "_m4": power(4), "row_median": row_quantile(F.col("_x"), 0.5)})
    deviation = F.array_sort(F.transform("_x", lambda v: F.abs(v - F.col("row_median"))))
    out = {
        "row_std0": F.sqrt("_m2"), "row_std1": F.when(F.col("n_valid") > 1, F.sqrt(F.col("_m2") * F.col("n_valid") / (F.col("n_valid") - 1))), "row_min": F.array_min("_x"), "row_max": F.array_max("_x"),
        "row_q25": row_quantile(F.col("_x"), 0.25), "row_q75": row_quantile(F.col("_x"), 0.75), "n_zero": F.size(F.filter("_x", lambda v: v == 0)).cast("long"), "n_negative": F.size(F.filter("_x", lambda v: v < 0)).cast("long"),
        "row_skew": F.when(F.col("_m2") > 0, F.col("_m3") / F.pow("_m2", F.lit(1.5))).when(F.col("_m2") == 0, 0.0), "row_kurt": F.when(F.col("_m2") > 0, F.col("_m4") / (F.col("_m2") * F.col("_m2")) - 3).when(F.col("_m2") == 0, 0.0), "row_mad": row_quantile(deviation, 0.5)}
    return d.withColumns(out).drop("_x", "_m2", "_m3", "_m4")


def sentinel_flags(df: DataFrame, codes: dict[str, float]) -> DataFrame:
    """df with a 0/1 flag for each column that may hold a code for missing, n_flags, their sum, and the codes nulled."""
    flag = {f"{c}_flag": F.coalesce((F.col(c) == v).cast("int"), F.lit(0)) for c, v in codes.items()}
    out = df.withColumns(flag).withColumn("n_flags", sum((F.col(f) for f in flag), F.lit(0)))
    return out.withColumns({c: F.nullif(c, F.lit(v)) for c, v in codes.items()})


def product_features(df: DataFrame, columns: list[str], top: int = 30, pairs: int = 50) -> tuple[list[str], DataFrame]:
    """The ``top`` columns of the largest variance, ties by name, and df with the products of the first ``pairs`` pairs of them."""
    spread = df.agg(*(F.var_samp(c).alias(c) for c in columns)).first().asDict()
    names = sorted(columns, key=lambda c: (-(spread[c] or 0.0), c))[:top]
    some = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]][:pairs]
    return names, df.withColumns({f"{a}_x_{b}": F.col(a) * F.col(b) for a, b in some})


def rank_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """df with each column replaced by its average rank over the number of rows that have a value; nulls stay."""
    for c in columns:
        df = rank_norm(df, c, "_rank").withColumn(c, F.col("_rank")).drop("_rank")
    return df
