"""Rows drawn or altered by md5 uniforms, pseudo-label thresholds, rankings of columns, composite scores."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from wicker.operators.evaluate import auc, curve, rank_norms, same_group, top as best, uniform
from wicker.operators.order import numbered, quantiles, running
from wicker.sources.tables import checkpointed


def bootstrap(df: DataFrame, key: str, multiplier: float = 1.0, name: str = "boot") -> DataFrame:
    """(i, key): ``multiplier`` times as many rows as df has, drawn with replacement by md5 uniforms of i."""
    n = df.count()
    drawn = df.sparkSession.range(int(n * multiplier)).select(F.col("id").alias("i"), F.floor(uniform(name, F.col("id")) * n).alias("k"))
    return drawn.join(numbered(df.select(key), key), "k").select("i", key)


def jitter(value: Column, key: Column, sigma: float) -> Column:
    """value times 1 + sigma z, z normal by Box and Muller from two md5 uniforms; zeros and nulls stay."""
    z = F.sqrt(-2 * F.log(1 - uniform("a", key))) * F.cos(2 * F.pi() * uniform("b", key))
    return F.when(value == 0, value).otherwise(value * (1 + sigma * z))


def class_shuffle(df: DataFrame, columns: list[str], key: str) -> DataFrame:
    """(draw, columns): as many rows as df has, every column drawn on its own from df's rows, with replacement. Positions are
    drawn, then joined; columns follow each other, so rows of one draw come from different rows of df."""
    rows = numbered(df.select(key, *columns), key).drop(key)
    n = df.count()
    out = df.sparkSession.range(n).withColumnRenamed("id", "draw")
    for c in columns:
        one = rows.select("k", c)
        out = out.withColumn("k", F.floor(uniform(c, F.col("draw")) * n)).join(one, "k").drop("k")
    return out


def relaxed_thresholds(df: DataFrame, score: str, positive: float, negative: float, step: float, margin: float, least: int) -> DataFrame:
    """(side, threshold, n): the strictest threshold that at least ``least`` rows pass, or the loosest that keeps ``margin``
    from one half. All candidates are counted in one pass."""
    sides = {"pos": [positive], "neg": [negative]}
    while round(sides["pos"][-1] - step, 4) >= 0.5 + margin:
        sides["pos"].append(round(sides["pos"][-1] - step, 4))
    while round(sides["neg"][-1] + step, 4) <= 0.5 - margin:
        sides["neg"].append(round(sides["neg"][-1] + step, 4))
    passed = lambda side, t: F.count_if(F.col(score) > t if side == "pos" else F.col(score) < t)
    each = [F.array(*(F.struct(F.lit(s).alias("side"), F.lit(t).alias("threshold"), passed(s, t).alias("n")) for t in ts)).alias(s) for s, ts in sides.items()]
    first = lambda s: F.coalesce(F.get(F.filter(s, lambda x: x["n"] >= least), F.lit(0)), F.element_at(s, -1))
    return df.agg(*each).select(F.inline(F.array(first("pos"), first("neg"))))


def pseudo_percentile(df: DataFrame, score: str, key: str, high: float, low: float, least: int = 50) -> DataFrame:
    """(key, label): 1 for scores at or above the high quantile, 0 at or below the low one; if fewer than ``least`` rows are
    positive so, the ``least`` highest scores are, ties by key."""
    top, bottom = quantiles(df, {score: [high, low]})[score]
    if top is None:
        return df.limit(0).select(key, F.lit(1).alias("label"))
    few = df.where(F.col(score) >= top).limit(least).count() < least
    chosen = best(df, score, key, least).select(key) if few else df.where(F.col(score) >= top).select(key)
    rest = df.where(F.col(score) <= bottom).join(chosen, key, "left_anti") if few else df.where((F.col(score) <= bottom) & (F.col(score) < top))
    return chosen.select(key, F.lit(1).alias("label")).unionByName(rest.select(key, F.lit(0).alias("label")))


def drop_top(importance: DataFrame, k: int) -> DataFrame:
    """(column, importance, covered): the k columns of the largest importance, ties by name, and the share of all importance
    that they have together. A row for each column comes in, so a global order is small."""
    total = importance.agg(F.sum("importance").alias("_all"))
    top = importance.orderBy(F.desc("importance"), "column").limit(k)
    share = top.agg(F.sum("importance").alias("_some"))
    return top.crossJoin(F.broadcast(total)).crossJoin(F.broadcast(share)).select("column", "importance", (F.col("_some") / F.col("_all")).alias("covered"))


def composite_of(auc: Column, tp: Column, fp: Column, fn: Column, tn: Column) -> Column:
    """Weighted F1, AUC, precision, recall, balanced accuracy and specificity; null where one of them has no rows to be of."""
    # fixed values: the weights
    f1, p, r, s = 2 * tp / (2 * tp + fp + fn), tp / (tp + fp), tp / (tp + fn), tn / (tn + fp)
    return 0.3 * f1 + 0.25 * auc + 0.15 * p + 0.15 * r + 0.1 * (r + s) / 2 + 0.05 * s


def composite(df: DataFrame, label: str = "y", score: str = "s", by: list[str] | None = None) -> DataFrame:
    """(by, threshold, n_pred_pos, composite) at every distinct cut, in each group of ``by``."""
    by = by or []
    c = same_group(curve(df, label, score, by), auc(df, label, score, by), by)
    return c.select(*by, "threshold", "n_pred_pos", composite_of(*map(F.col, ("auc", "tp", "fp", "fn", "tn"))).alias("composite"))


def plateau_rate(df: DataFrame, label: str = "y", score: str = "s", tol: float = 5e-4, by: list[str] | None = None) -> DataFrame:
    """(by, n_plateau, rate): the share of rows above the middle of the cuts whose composite is within tol of the best, in each
    group of ``by``. The middle of an even number of cuts is the mean of two, rounded down."""
    by = by or []
    c = checkpointed(composite(df, label, score, by))
    near = same_group(c, c.groupBy(*by).agg(F.max("composite").alias("best")), by).where(F.col("composite") >= F.col("best") - tol).select(*by, "n_pred_pos", F.lit(1).alias("_one"))
    at = checkpointed(running(near, "n_pred_pos", {"_upto": "_one"}, by))
    size = at.groupBy(*by).agg(F.count("*").alias("n_plateau"))
    middle = (F.col("_upto") == F.floor((F.col("n_plateau") + 1) / 2)) | (F.col("_upto") == F.floor(F.col("n_plateau") / 2) + 1)
    k = same_group(at, size, by).where(middle).groupBy(*by).agg(F.first("n_plateau").alias("n_plateau"), F.floor(F.avg("n_pred_pos")).alias("k"))
    rows = df.where(F.col(score).isNotNull()).groupBy(*by).agg(F.count("*").alias("n"))
    return same_group(k, rows, by).select(*by, "n_plateau", (F.col("k") / F.col("n")).alias("rate"))


def best_rate(df: DataFrame, label: str, score: str, by: list[str]) -> DataFrame:
    """(by, rate, composite): for each group the share of its rows above the cut with the largest composite; of equal ones the
    cut with the fewest rows above."""
    c = composite(df, label, score, by).where(F.col("composite").isNotNull())
    best = c.groupBy(*by).agg(F.max(F.struct(F.round("composite", 12).alias("composite"), (-F.col("n_pred_pos")).alias("k"))).alias("b"))
    rows = df.where(F.col(score).isNotNull()).groupBy(*by).agg(F.count("*").alias("n"))
    return same_group(best, rows, by).select(*by, (-F.col("b.k") / F.col("n")).alias("rate"), F.col("b.composite").alias("composite"))


def rate_sweep(df: DataFrame, label: str, score: str, key: str, rate: float, deltas: tuple[float, ...]) -> DataFrame:
    """(delta, rate, n_pred_pos, composite): what the composite is if the rows with the highest scores, ties by key, a share of
    rate + delta of them, are called positive. Shares not between 0 and 1 are left out. One numbering serves all shares."""
    scored = df.where(F.col(score).isNotNull()).select(key, score, label)
    at = numbered(scored, -F.col(score), key, name="_at")
    total = at.agg(F.count("*").alias("n"), F.sum(label).alias("pos")).crossJoin(auc(scored, label, score))
    swept = [(d, rate + d) for d in deltas if 0 < rate + d < 1]
    k = lambda r: F.floor(F.lit(r) * F.col("n") + 0.5)
    hit = lambda d, r: F.struct(F.lit(d).alias("delta"), F.lit(r).alias("rate"), F.max(k(r)).alias("n_pred_pos"), F.sum(F.when(F.col("_at") < k(r), F.col(label)).otherwise(0)).alias("tp"))
    rows = at.crossJoin(F.broadcast(total)).groupBy("n", "pos", "auc").agg(F.array(*(hit(d, r) for d, r in swept)).alias("a")).select("n", "pos", "auc", F.inline("a"))
    tp, said, pos, n = map(F.col, ("tp", "n_pred_pos", "pos", "n"))
    return rows.select("delta", "rate", "n_pred_pos", composite_of(F.col("auc"), tp, said - tp, pos - tp, n - pos - said + tp).alias("composite"))


def candidates(models: int, draws: int, digits: int = 9) -> list[list[float]]:
    """Weights to try: equal ones, each model alone, then ``draws`` from the flat Dirichlet law by md5 uniforms, rounded."""
    fixed = [[1 / models] * models] + [[float(i == j) for j in range(models)] for i in range(models)]
    drawn = []
    for d in range(draws):
        x = [-math.log(1 - int(md5(f"simplex{i}:{d}".encode()).hexdigest()[:8], 16) / 2**32) for i in range(models)]
        drawn.append([round(v / sum(x), digits) for v in x])
    return fixed + drawn


def blended(x: list[np.ndarray], weights: list[float]) -> np.ndarray:
    """The blends of ranks, rounded to twelve digits, as whole numbers of a 10^12th."""
    s = np.zeros(len(x[0]))
    for c, w in zip(x, weights):
        s += c * w
    return np.floor(s * 1e12 + 0.5)


def chunks(ranked: DataFrame, label: str, columns: list[str]) -> DataFrame:
    """The rows in partitions that a task can hold: as many as there are cores, more where they would hold over 4,000,000 numbers."""
    n, cores = ranked.count(), ranked.sparkSession.sparkContext.defaultParallelism
    return ranked.select(F.col(label).cast("int"), *columns).coalesce(max(cores, math.ceil(n * (len(columns) + 1) / 4_000_000)))


def held(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, list[np.ndarray]]:
    """The labels and the scores of a partition."""
    parts = [[c.to_numpy() for c in b.columns] for b in batches if b.num_rows]
    y, *x = (np.concatenate(c) for c in zip(*parts)) if parts else (np.zeros(0, np.int32), np.zeros(0))
    return y, x


def binned(rows: DataFrame, weights: dict[int, list[float]], bins: int) -> dict[int, tuple[int, int]]:
    """candidate: (least, most) for the pairs of a positive and a negative row that its blend has in order, a tie as half: exact
    counts of rows for each of ``bins`` equal ranges of the blend, over all rows, in one pass. Pairs within a range are unknown.
    A task goes through its rows a candidate at a time, so it holds the counts of one; they are sent compressed."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        y, x = held(batches)
        if not len(y):
            return
        low = y.astype(np.int32) * bins
        for j, w in weights.items():
            total = np.zeros(2 * bins, np.int64)
            for a in range(0, len(y), 1 << 15):
                at = np.clip(blended([c[a : a + (1 << 15)] for c in x], w) * (bins / 1e12), 0, bins - 1).astype(np.int32)
                at += low[a : a + (1 << 15)]
                if bins <= 1 << 15:
                    total += np.bincount(at, minlength=2 * bins)
                else:
                    np.add.at(total, at, 1)
            yield pa.record_batch([pa.array([j], pa.int32()), pa.array([zlib.compress(total.astype(np.int32).tobytes(), 1)], pa.binary())], ["j", "n"])

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            for j, n in zip(*(c.to_pylist() for c in batch.columns)):
                now = np.frombuffer(zlib.decompress(n), np.int32)
                if j in found:
                    found[j] += now
                else:
                    found[j] = now.astype(np.int64)
        for j, (neg, pos) in ((j, n.reshape(2, bins)) for j, n in found.items()):
            some = np.flatnonzero(pos)
            least = sum(a * b for a, b in zip(pos[some].tolist(), (np.cumsum(neg) - neg)[some].tolist()))
            most = least + sum(a * b for a, b in zip(pos[some].tolist(), neg[some].tolist()))
            yield pa.record_batch([pa.array([j], pa.int32()), pa.array([str(least)]), pa.array([str(most)])], ["j", "least", "most"])

    found = rows.mapInArrow(count, "j int, n binary").repartition("j").mapInArrow(bound, "j int, least string, most string")
    return {r.j: (int(r.least), int(r.most)) for r in found.collect()}  # a row for each candidate


def ordered_pairs(rows: DataFrame, weights: dict[int, list[float]], parts: int) -> dict[int, int]:
    """candidate: twice the number of pairs of a positive and a negative row that its blend has in order, a tie as half, exactly.
    A task sends its distinct blends with their counts to ``parts`` equal ranges of the blend, as differences, compressed; a
    row for each range and candidate comes to the driver."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        y, x = held(batches)
        for j, w in weights.items() if len(y) else ():
            s, back = np.unique(blended(x, w).astype(np.int64), return_inverse=True)
            n = [np.bincount(back[y == k], minlength=len(s)).astype(np.int32) for k in (0, 1)]
            part = np.clip((s * (parts / 1e12)).astype(np.int64), 0, parts - 1)
            ends = np.flatnonzero(np.diff(part, append=-1)) + 1
            starts = np.concatenate([[0], ends[:-1]])
            packed = [[zlib.compress(v.tobytes(), 1) for v in (np.diff(s[a:b], prepend=0), n[0][a:b], n[1][a:b])] for a, b in zip(starts, ends)]
            yield pa.record_batch([pa.array(np.full(len(ends), j, np.int32)), pa.array(part[starts].astype(np.int32)), *(pa.array(c, pa.binary()) for c in zip(*packed))], ["j", "part", "s", "neg", "pos"])

    def count(part: pa.Table) -> pa.Table:
        s, neg, pos = (np.concatenate([np.frombuffer(zlib.decompress(v), kind) for v in part.column(c).to_pylist()]) if c != "s" else np.concatenate([np.cumsum(np.frombuffer(zlib.decompress(v), kind)) for v in part.column(c).to_pylist()]) for c, kind in (("s", np.int64), ("neg", np.int32), ("pos", np.int32)))
        back = np.unique(s, return_inverse=True)[1]
        neg, pos = (np.bincount(back, v).astype(np.int64) for v in (neg, pos))
        some = np.flatnonzero(pos)
        twice = sum(a * b for a, b in zip(pos[some].tolist(), (2 * np.cumsum(neg) - neg)[some].tolist()))
        return pa.table({"j": part.column("j")[:1], "part": part.column("part")[:1], "neg": [int(neg.sum())], "pos": [int(pos.sum())], "twice": [str(twice)]})

    sent = rows.mapInArrow(send, "j int, part int, s binary, neg binary, pos binary")
    out, below = dict.fromkeys(weights, 0), dict.fromkeys(weights, 0)
    for r in sorted(sent.groupBy("j", "part").applyInArrow(count, "j int, part int, neg long, pos long, twice string").collect(), key=lambda r: r.part):
        out[r.j] += int(r.twice) + 2 * r.pos * below[r.j]
        below[r.j] += r.neg
    return out


def simplex_search(df: DataFrame, scores: list[str], label: str, weights: list[list[float]], bins: int | None = None, few: int = 8) -> DataFrame:
    """(candidate, weights, auc): of the candidates the one whose blend of rank-normalised scores has the largest AUC, to nine
    digits, and of equal ones the first; blends are rounded to twelve digits.

    Every pass bounds the AUC of all candidates left and drops those that can't be the best; ranges become finer as there are
    fewer, so what a pass sends stays the same. The last ones' AUCs are exact. Rows where a score or the label is missing are
    left out; where a class has no rows, the first candidate comes back without an AUC."""
    ranked = checkpointed(rank_norms(df.select(label, *scores).dropna(), scores))
    n = ranked.agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg")).first()
    pairs, left = n.pos * n.neg, dict(enumerate(weights))
    if not pairs:
        return df.sparkSession.createDataFrame([(0, weights[0], None)], "candidate int, weights array<double>, auc double")
    rows = chunks(ranked, label, scores)
    bins = bins or min(8192, max(512, 1 << math.ceil(math.log2(4 * math.sqrt(n.pos + n.neg)))))
    memory = bins * len(weights)
    while len(left) > few and bins <= 1 << 22:
        found = binned(rows, left, bins)
        best = max(low for low, _ in found.values()) - 2e-9 * pairs
        kept = {j: w for j, w in left.items() if found[j][1] >= best}
        bins, left = (4 * bins if len(kept) == len(left) else max(bins, min(1 << 22, memory // len(kept)))), kept
    exact = ordered_pairs(rows, left, min(4096, (n.pos + n.neg) // 20_000 + 1))
    auc, j = min((-round(exact[j] / (2 * pairs), 9), j) for j in left)
    return df.sparkSession.createDataFrame([(j, weights[j], -auc)], "candidate int, weights array<double>, auc double")


def blend_search(df: DataFrame, one: str, two: str, label: str, draws: int) -> DataFrame:
    """(candidate, weight, auc) of the best rank blend of two scores: equal weights, each alone, then ``draws`` weights from md5
    uniforms."""
    u = [int(md5(f"w{i}".encode()).hexdigest()[:8], 16) / 2**32 for i in range(draws)]
    found = simplex_search(df, [one, two], label, [[w, 1 - w] for w in (0.5, 1.0, 0.0, *u)])
    return found.select("candidate", F.round(F.col("weights")[0], 9).alias("weight"), "auc")


def simplex(spark: SparkSession, models: int, draws: int) -> DataFrame:
    """(candidate, weights): equal weights, each model alone, then ``draws`` from the flat Dirichlet law, by md5 uniforms."""
    fixed = [[1 / models] * models] + [[float(i == j) for j in range(models)] for i in range(models)]
    given = spark.createDataFrame(list(enumerate(fixed)), "candidate long, weights array<double>")
    parts = F.array(*(-F.log(1 - uniform(f"simplex{i}:", F.col("id"))) for i in range(models)))
    total = F.aggregate("x", F.lit(0.0), lambda a, v: a + v)
    drawn = spark.range(draws).select((F.col("id") + len(fixed)).alias("candidate"), parts.alias("x")).select("candidate", F.transform("x", lambda v: v / total).alias("weights"))
    return given.unionByName(drawn)
