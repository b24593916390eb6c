"""Categorical encodings: fit gives a small frame of levels, apply joins it. Tables of levels follow the data, so the joins
leave the choice of a broadcast to the optimizer's size check."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from wicker.operators.order import numbered


def codes(df: DataFrame, column: str) -> DataFrame:
    """(level, code): position among the sorted levels, from 0. Only distinct levels are sorted, range by range."""
    return numbered(df.select(F.col(column).alias("level")).where("level is not null").distinct(), "level", name="code")


def first_seen(df: DataFrame, column: str, key: str) -> DataFrame:
    """(level, code): codes in the order of each level's first row."""
    level = df.groupBy(F.col(column).alias("level")).agg(F.min(key).alias("at"))
    return numbered(level, "at", "level", name="code").select("level", "code")


def frequencies(df: DataFrame, column: str) -> DataFrame:
    n = df.groupBy(F.col(column).alias("level")).agg(F.count("*").alias("n"))
    return n.crossJoin(F.broadcast(n.agg(F.sum("n").alias("total")))).select("level", "n", (F.col("n") / F.col("total")).alias("freq"))


def apply(df: DataFrame, column: str, fitted: DataFrame, value: str, default, name: str) -> DataFrame:
    """df with the fitted value of its level as name; unseen levels take the default."""
    table = fitted.select(F.col("level").alias(column), F.col(value).alias(name))
    return df.join(table, column, "left").withColumn(name, F.coalesce(F.col(name), default if isinstance(default, Column) else F.lit(default)))


def target_means(df: DataFrame, column: str, label: str, smoothing: float) -> DataFrame:
    """(level, te): (sum + s prior) / (n + s), the prior being the label's overall mean."""
    g = df.groupBy(F.col(column).alias("level")).agg(F.sum(label).alias("sum"), F.count("*").alias("n"))
    prior = df.agg(F.avg(label).alias("prior"))
    return g.crossJoin(F.broadcast(prior)).select("level", ((F.col("sum") + smoothing * F.col("prior")) / (F.col("n") + smoothing)).alias("te"))


def target_encode_oof(df: DataFrame, column: str, label: str, fold: str, smoothing: float, fold_prior: bool = False) -> DataFrame:
    """df with te, from the rows of other folds only: per level the sums of all folds less those of the row's own. The prior
    is the overall mean, or with fold_prior the mean of the other folds. Null is a level like any other. Two small
    aggregations and a window over their rows, no loop over folds."""
    by = df.groupBy(column, fold).agg(F.sum(label).alias("s"), F.count("*").alias("n"))
    level = Window.partitionBy(column)  # at most a row for each fold
    folds = by.groupBy(fold).agg(F.sum("s").alias("s_fold"), F.sum("n").alias("n_fold"))
    total = folds.agg(F.sum("s_fold").alias("s_tot"), F.sum("n_fold").alias("n_tot"))
    prior = (F.col("s_tot") - F.col("s_fold")) / (F.col("n_tot") - F.col("n_fold")) if fold_prior else F.col("s_tot") / F.col("n_tot")
    table = by.select("*", F.sum("s").over(level).alias("s_all"), F.sum("n").over(level).alias("n_all"))
    table = table.join(F.broadcast(folds), fold).crossJoin(F.broadcast(total))
    te = (F.col("s_all") - F.col("s") + smoothing * prior) / (F.col("n_all") - F.col("n") + smoothing)
    table = table.select(F.col(column).alias("_level"), F.col(fold).alias("_fold"), te.alias("te"))
    return df.join(table, F.col(column).eqNullSafe(F.col("_level")) & (F.col(fold) == F.col("_fold"))).drop("_level", "_fold")


def group_stats(df: DataFrame, column: str, numbers: list[str]) -> DataFrame:
    """(level, mean and std of each number): a level's single value has a standard deviation of 0."""
    return df.groupBy(F.col(column).alias("level")).agg(*(x for c in numbers for x in (F.avg(c).alias(f"{c}_mean"), F.coalesce(F.stddev(c), F.lit(0.0)).alias(f"{c}_std"))))


def apply_all(df: DataFrame, column: str, fitted: DataFrame) -> DataFrame:
    """df with all the fitted numbers of its level (group_stats); unseen levels and nulls take the mean over the fitted levels."""
    numbers = [c for c in fitted.columns if c != "level"]
    mean = fitted.agg(*(F.avg(c).alias(f"_{c}") for c in numbers))
    whole = df.join(fitted.withColumnRenamed("level", column), column, "left").crossJoin(F.broadcast(mean))
    return whole.withColumns({c: F.coalesce(c, f"_{c}") for c in numbers}).drop(*(f"_{c}" for c in numbers))


def levels(df: DataFrame, column: str, most: int = 50) -> list[str] | None:
    """The sorted levels of a column that has at most ``most``, else None."""
    found = [r[0] for r in df.select(column).where(F.col(column).isNotNull()).distinct().limit(most + 1).collect()]
    return sorted(found) if len(found) <= most else None


def one_hot(df: DataFrame, column: str, levels: list[str]) -> DataFrame:
    """df with a 0/1 column for each level, in the order of levels; unknown levels and nulls have zeros."""
    return df.withColumns({f"{column}_{i}": F.coalesce((F.col(column) == v).cast("int"), F.lit(0)) for i, v in enumerate(levels)})


def bool_text(column: Column, yes: str = "yes", no: str = "no") -> Column:
    return F.when(F.startswith(column, F.lit(yes)), 1).when(F.startswith(column, F.lit(no)), 0)
