"""Folds, ranks, threshold curves, metrics and blends. Curves aggregate to distinct scores before any global order."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from wicker.operators.order import dealt, numbered, quantiles, ranges, running


def uniform(*parts: Column | str) -> Column:
    """A number in [0, 1) from the md5 of the parts: the same in any engine and on any partitioning."""
    text = F.concat(*(p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def folds(df: DataFrame, key: str, k: int, label: str | None = None) -> DataFrame:
    """df with fold, 0..k-1: row numbers in md5 order, within each label, of few classes, if one is given; the md5's first digits part rows into
    ranges, so no task sorts a whole class."""
    placed = dealt(df, F.md5(F.col(key).cast("string").cast("binary")), [key], [label] if label else [], "_at", few=True)
    return placed.withColumn("fold", (F.col("_at") % k).cast("int")).drop("_at")


def curve(df: DataFrame, label: str = "y", score: str = "s", by: list[str] | None = None) -> DataFrame:
    """Counts and F1 at every distinct cut, in each group of ``by``: rows with a score of at least threshold are positive. Rows
    without a score are left out."""
    by = by or []
    each = df.where(F.col(score).isNotNull()).groupBy(*by, F.col(score).alias("threshold")).agg(F.sum(label).cast("long").alias("p"), F.count("*").alias("n"))
    c = running(each, "threshold", {"_p": "p", "_n": "n"}, by, inclusive=False)
    total = c.groupBy(*by).agg(F.sum("p").alias("all_p"), F.sum("n").alias("all_n"))  # of the distinct scores, already counted
    c = same_group(c, total, by)
    c = c.withColumns({"tp": F.col("all_p") - F.col("_p"), "n_pred_pos": F.col("all_n") - F.col("_n")})
    c = c.withColumns({"fp": F.col("n_pred_pos") - F.col("tp"), "fn": F.col("all_p") - F.col("tp")}).withColumn("tn", F.col("all_n") - F.col("all_p") - F.col("fp"))
    f1 = lambda hit, a, b: F.when(2 * F.col(hit) + F.col(a) + F.col(b) > 0, 2 * F.col(hit) / (2 * F.col(hit) + F.col(a) + F.col(b))).otherwise(0.0)
    c = c.withColumn("binary_f1", f1("tp", "fp", "fn"))
    return c.withColumn("macro_f1", (F.col("binary_f1") + f1("tn", "fp", "fn")) / 2).select(*by, "threshold", "n_pred_pos", "tp", "fp", "fn", "tn", "binary_f1", "macro_f1")


def same_group(rows: DataFrame, each: DataFrame, by: list[str]) -> DataFrame:
    """rows with the columns of the one row of ``each`` that their group has."""
    if not by:
        return rows.crossJoin(F.broadcast(each))
    join = F.lit(True)
    for c in by:
        join = join & F.col(f"_a.`{c}`").eqNullSafe(F.col(f"_b.`{c}`"))
    return rows.alias("_a").join(each.alias("_b"), join).select("_a.*", *(F.col(f"_b.`{c}`") for c in each.columns if c not in by))


def best_threshold(df: DataFrame, label: str = "y", score: str = "s") -> DataFrame:
    """The cut with the largest F1; of equal ones the smallest threshold."""
    return curve(df, label, score).agg(F.max(F.struct(F.round("binary_f1", 12).alias("f"), (-F.col("threshold")).alias("t"), "n_pred_pos")).alias("b")).select((-F.col("b.t")).alias("threshold"), F.col("b.f").alias("f1"), F.col("b.n_pred_pos").alias("n_pred_pos"))


def plateau_threshold(df: DataFrame, label: str = "y", score: str = "s", tol: float = 0.002) -> DataFrame:
    """The middle of the plateau: cuts within tol of the peak, the integer median of their counts, and the nearest cut."""
    c = curve(df, label, score)
    near = c.crossJoin(F.broadcast(c.agg(F.max("binary_f1").alias("peak")))).where(F.col("binary_f1") >= F.col("peak") - tol)
    middle = quantiles(near, {"n_pred_pos": [0.5]})["n_pred_pos"][0]
    k = near.agg(F.lit(middle).cast("long").alias("k"), F.count("*").alias("n_plateau"))
    at = c.crossJoin(F.broadcast(k)).agg(F.min(F.struct(F.abs(F.col("n_pred_pos") - F.col("k")).alias("d"), "n_pred_pos", "threshold", "k", "n_plateau")).alias("b"))
    return at.select("b.threshold", F.col("b.n_pred_pos").alias("n_pred_pos"), F.col("b.k").cast("long").alias("k"), F.col("b.n_plateau").alias("n_plateau"))


def threshold_grid(df: DataFrame, steps: int, label: str = "y", score: str = "s") -> DataFrame:
    """F1 at thresholds i / steps. The grid is fixed, so it is a set of aggregates over one pass, not a join."""
    cuts = [i / steps for i in range(1, steps)]
    hit = lambda t: F.struct(F.lit(t).alias("threshold"), F.sum((F.col(score) >= t).cast("long")).alias("n_pred_pos"), F.sum(((F.col(score) >= t) & (F.col(label) == 1)).cast("long")).alias("tp"), F.sum(F.col(label).cast("long")).alias("p"))
    rows = df.agg(F.array(*(hit(t) for t in cuts)).alias("a")).select(F.inline("a"))
    return rows.select("threshold", "n_pred_pos", F.when(F.col("n_pred_pos") + F.col("p") > 0, 2 * F.col("tp") / (F.col("n_pred_pos") + F.col("p"))).otherwise(0.0).alias("f1"))


def auc(df: DataFrame, label: str = "y", score: str = "s", by: list[str] | None = None) -> DataFrame:
    """The exact area under the ROC curve from average ranks, for each group of ``by``: ranks of distinct scores. Rows without
    a score are left out."""
    by = by or []
    each = df.where(F.col(score).isNotNull()).groupBy(*by, score).agg(F.sum(label).cast("double").alias("_p"), F.count("*").cast("double").alias("_n"))
    r = running(each, score, {"_below": "_n"}, by, inclusive=False).withColumn("_r", F.col("_below") + (F.col("_n") + 1) / 2).groupBy(*by).agg(F.sum(F.col("_p") * F.col("_r")).alias("r"), F.sum("_p").alias("p"), F.sum("_n").alias("n"))
    return r.select(*by, ((F.col("r") - F.col("p") * (F.col("p") + 1) / 2) / F.nullif(F.col("p") * (F.col("n") - F.col("p")), F.lit(0.0))).alias("auc"))


def rank_norm(df: DataFrame, score: str, name: str = "rank") -> DataFrame:
    """df with the average rank of score over the number of rows with one, null where the score is; ranks of distinct scores
    are joined back."""
    each = df.where(F.col(score).isNotNull()).groupBy(score).agg(F.count("*").alias("_m"))
    ranked = running(each, score, {"_below": "_m"}, inclusive=False).select(score, (F.col("_below") + (F.col("_m") + 1) / 2).alias("_r"))
    total = df.agg(F.count(score).alias("_n"))
    return df.join(ranked, score, "left").crossJoin(F.broadcast(total)).withColumn(name, F.col("_r") / F.col("_n")).drop("_r", "_n")


def rank_norms(df: DataFrame, scores: list[str]) -> DataFrame:
    """df with each score replaced by its average rank over the number of rows; none may be null. Rows are dealt to ranges once a
    score, and no join brings ranks back. A range ends before a value at which the next begins; such values, which may hold
    many rows, have one rank each and are spread over tasks."""
    at = [i / ranges(df) for i in range(1, ranges(df))] or [0.5]
    drawn = df.agg(*(F.percentile_approx(c, at, 10_000) for c in scores)).first()
    cuts = [np.unique(np.array(x or [], float)) for x in drawn]

    def code(q: np.ndarray) -> Callable[[Column], Column]:
        return F.arrow_udf(lambda v: pa.array((np.searchsorted(q, x := v.to_numpy(zero_copy_only=False), "left") + np.searchsorted(q, x, "right")).astype(np.int32)), "int")

    codes = [code(q)(F.col(c).cast("double")) for q, c in zip(cuts, scores)]
    held = df.select(F.posexplode(F.array(*codes))).groupBy("pos", "col").count().collect()  # two rows for each range and score
    for i, c in enumerate(scores):
        n = np.zeros(2 * len(cuts[i]) + 1, np.int64)
        for r in held:
            if r.pos == i:
                n[r.col] = r["count"]
        below = F.get(F.lit((np.cumsum(n) - n).tolist()), F.col("_code"))
        alone, own = F.col("_code") % 2 == 1, F.get(F.lit(n.tolist()), F.col("_code"))
        rows = df.withColumn("_code", codes[i]).withColumn("_salt", F.when(alone, F.pmod(F.xxhash64(*scores), F.lit(ranges(df)))).otherwise(0))
        part = Window.partitionBy("_code", "_salt")
        rows = rows.withColumns({"_at": F.rank().over(part.orderBy(c)) - 1, "_m": F.count("*").over(Window.partitionBy("_code", "_salt", c))})
        rank = F.when(alone, below + (own + 1) / 2).otherwise(below + F.col("_at") + (F.col("_m") + 1) / 2)
        df = rows.withColumn(c, rank / F.lit(int(n.sum()))).drop("_code", "_salt", "_at", "_m")
    return df


def confusion(label: str, predicted: Column) -> dict[str, Column]:
    hit = lambda a, b: F.sum(((F.col(label) == a) & (predicted == b)).cast("long"))
    return {"tp": hit(1, 1), "fp": hit(0, 1), "fn": hit(1, 0), "tn": hit(0, 0)}


def top_fraction(df: DataFrame, score: str, key: str, fraction: float, least: int = 1) -> DataFrame:
    """The share of rows with the highest scores, ties by key, at least ``least`` rows."""
    return top(df, score, key, max(least, int(df.count() * fraction)))


def top(df: DataFrame, score: str, key: str, k: int) -> DataFrame:
    """The k rows with the highest scores, ties by key, from all rows' positions: k may be a share of the table."""
    last = F.when(F.col(score).isNull(), float("inf")).otherwise(-F.col(score))
    return numbered(df, last, key, name="_at").where(F.col("_at") < k).drop("_at")


def fold_scores(df: DataFrame, label: str, score: str, threshold: float = 0.5) -> DataFrame:
    """(fold, f1): the F1 of each fold's rows at a threshold."""
    said = F.col(score) >= threshold
    return df.groupBy("fold").agg((2 * F.count_if(said & (F.col(label) == 1)) / F.nullif(F.count_if(said) + F.sum(label), F.lit(0))).alias("f1"))


def best_grid_threshold(df: DataFrame, steps: int, label: str = "y", score: str = "s", default: float = 0.5) -> DataFrame:
    """(threshold, f1): the first of the thresholds i / steps with the largest F1 that call any row positive, else the default."""
    grid = threshold_grid(df, steps, label, score).where("n_pred_pos > 0")
    best = grid.agg(F.max(F.struct(F.round("f1", 12).alias("f"), (-F.col("threshold")).alias("t"))).alias("b"))
    return best.select(F.coalesce(-F.col("b.t"), F.lit(default)).alias("threshold"), F.coalesce("b.f", F.lit(0.0)).alias("f1"))


def plateau_sensitivity(df: DataFrame, tolerances: tuple[float, ...], label: str = "y", score: str = "s") -> DataFrame:
    """(tol, n_plateau, rate): for each tolerance, the cuts within it of the peak F1 and the middle of their counts as a share of
    the rows. A number of quantiles that the tolerances give, all in the same passes."""
    c = curve(df, label, score)
    peak = c.agg(F.max("binary_f1").alias("peak"))
    near = c.crossJoin(F.broadcast(peak)).select(*(F.when(F.col("binary_f1") >= F.col("peak") - t, F.col("n_pred_pos")).alias(f"t{i}") for i, t in enumerate(tolerances)))
    middle = quantiles(near, {f"t{i}": [0.5] for i in range(len(tolerances))})
    n, held = df.where(F.col(score).isNotNull()).count(), near.agg(*(F.count(x).alias(x) for x in near.columns)).first()
    rows = [(t, held[f"t{i}"], int(middle[f"t{i}"][0]) / n) for i, t in enumerate(tolerances) if held[f"t{i}"]]
    return df.sparkSession.createDataFrame(rows, "tol double, n_plateau long, rate double")
