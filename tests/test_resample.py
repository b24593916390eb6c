"""Small hand-worked cases of the operators that draw, relax and rank."""

import math
import random
from pathlib import Path

from pyspark.sql import functions as F

from wicker.operators import evaluate as V, learn, resample as R, transform as T
from wicker.sources.tables import checkpointed


def test_numbered_counts_from_zero_in_key_order(spark):
    keys = random.Random(1).sample(range(100_000), 5000)
    got = {r.key: r.k for r in R.numbered(spark.createDataFrame([(k,) for k in keys], "key long").repartition(7), "key").collect()}
    assert got == {k: i for i, k in enumerate(sorted(keys))}
    assert R.numbered(spark.createDataFrame([], "key long"), "key").count() == 0


def test_jitter_keeps_zeros_and_nulls(spark):
    df = spark.createDataFrame([(1, 0.0), (2, None), (3, 10.0)], "id long, x double")
    got = [r.v for r in df.select("id", R.jitter(F.col("x"), F.col("id"), 0.03).alias("v")).orderBy("id").collect()]
    assert got[:2] == [0.0, None] and 8 < got[2] < 12 and got[2] != 10.0


def test_class_shuffle_draws_only_values_that_occur(spark):
    df = spark.createDataFrame([(i, float(i), -float(i)) for i in range(50)], "id long, a double, b double")
    rows = R.class_shuffle(df, ["a", "b"], "id").collect()
    assert len(rows) == 50 and {r.a for r in rows} <= set(map(float, range(50))) and any(r.a != -r.b for r in rows)


def test_thresholds_relax_until_enough_rows_or_the_margin(spark):
    df = spark.createDataFrame([(x,) for x in [0.97, 0.93, 0.88, 0.3, 0.02]], "p double")
    got = {r.side: (r.threshold, r.n) for r in R.relaxed_thresholds(df, "p", 0.95, 0.05, 0.05, 0.1, 2).collect()}
    assert got == {"pos": (0.9, 2), "neg": (0.35, 2)}
    none = {r.side: (r.threshold, r.n) for r in R.relaxed_thresholds(df, "p", 0.95, 0.05, 0.05, 0.1, 9).collect()}
    assert none == {"pos": (0.6, 3), "neg": (0.4, 2)}


def test_drop_top_covers_its_share(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 3.0), ("c", 3.0), ("d", 1.0)], "column string, importance double")
    assert sorted((r.column, r.covered) for r in R.drop_top(df, 2).collect()) == [("b", 0.75), ("c", 0.75)]


def test_neighbours_are_the_nearest_of_their_cell(spark):
    rows = [(i, float(i % 2 * 1000 + i), 0.0) for i in range(8)]
    near = learn.neighbours(spark.createDataFrame(rows, "id long, x double, y double"), ["x", "y"], "id", k=1, cells=2).collect()
    assert {r.source: abs(r.source - r.neighbour) for r in near} == {i: 2 for i in range(8)}


def test_neighbours_are_the_nearest_of_all_rows(spark):
    draw = random.Random(3)
    rows = [(i, draw.gauss(0, 1), draw.gauss(0, 30)) for i in range(900)] + [(900 + i, 500.0 * (i + 1), 0.0) for i in range(3)] + [(910 + i, 1.0, 1.0) for i in range(4)]
    gap = lambda a, b: (a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2
    df = spark.createDataFrame(rows, "id long, x double, y double")
    got = {(r.source, r.k): r.neighbour for r in learn.neighbours(df, ["x", "y"], "id", k=5, cells=40).collect()}
    want = {(a[0], j + 1): b[0] for a in rows for j, b in enumerate(sorted((b for b in rows if b[0] != a[0]), key=lambda b: (gap(a, b), b[0]))[:5])}
    assert got == want
    made = [(f"m{i}", draw.gauss(0, 2), draw.gauss(0, 60)) for i in range(300)]
    near = learn.nearest_category(spark.createDataFrame(made, "made string, x double, y double"), df.unionByName(df.selectExpr("id + 5000 id", "x + 0.01 x", "y")).withColumn("c", F.col("id").cast("string")), ["x", "y"], "made", "id", "c").collect()
    real = rows + [(i + 5000, x + 0.01, y) for i, x, y in rows]
    assert {r.made: r.c for r in near} == {a[0]: str(min(real, key=lambda b: (gap(a, b), b[0]))[0]) for a in made}


def test_smotenc_takes_the_most_frequent_category_of_the_neighbours(spark):
    rows = [(i, float(i), 0.0, 1, c) for i, c in enumerate("ccaab")] + [(10 + i, 1000.0 + i, 0.0, 1, c) for i, c in enumerate("xyyyx")] + [(100 + i, 0.0, 0.0, 0, "z") for i in range(60)]
    made = learn.smote(spark.createDataFrame(rows, "id long, x double, y double, t int, c string"), ["x", "y"], "t", "id", 0.5, k=4, cells=2, sides=["c"]).collect()
    want = {0: "a", 1: "a", 2: "c", 3: "c", 4: "a"} | {10: "y", 11: "x", 12: "x", 13: "x", 14: "y"}
    assert len(made) == 20 and all(r.c == want[r.source] for r in made)


def test_row_stats_of_empty_constant_and_missing_rows(spark):
    df = spark.createDataFrame([(1, []), (2, [2.0, 2.0]), (3, [None, 1.0, 3.0])], "id int, v array<double>")
    got = {r.id: r for r in T.row_stats(df, "v").collect()}
    assert (got[1].n_valid, got[1].row_mean, got[1].row_median) == (0, None, None)
    assert (got[2].row_skew, got[2].row_kurt, got[2].row_std0) == (0.0, 0.0, 0.0)
    assert (got[3].n_valid, got[3].row_mean, got[3].row_std1) == (2, 2.0, 2.0**0.5)


def test_ranks_without_a_join_are_those_of_the_join(spark):
    """Ties, among them a value that a third of the rows have and is a range of its own, and a column of one value."""
    draw = random.Random(4)
    rows = [(i, draw.choice([draw.random(), 0.25, round(draw.random(), 2)]), round(draw.gauss(0, 1), 1), 7.0) for i in range(5000)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double")
    made = V.rank_norms(df, ["a", "b", "c"])
    assert "Join" not in made._jdf.queryExecution().optimizedPlan().toString()
    want = df
    for c in "abc":
        want = V.rank_norm(want, c, f"r{c}")
    assert {tuple(r) for r in made.select("id", "a", "b", "c").collect()} == {tuple(r) for r in want.select("id", "ra", "rb", "rc").collect()}


def test_pairs_in_order_are_counted_exactly(spark):
    draw = random.Random(5)
    rows = [(draw.choice([0, 0, 1]), round(draw.random(), 2), draw.choice([0.5, draw.random()])) for _ in range(700)]
    weights = {3: [0.5, 0.5], 8: [1.0, 0.0], 9: [0.0, 1.0]}
    df = R.chunks(spark.createDataFrame(rows, "y int, a double, b double").repartition(3), "y", ["a", "b"])
    blend = lambda w: [(y, math.floor((a * w[0] + b * w[1]) * 1e12 + 0.5)) for y, a, b in rows]
    want = {j: sum(2 * (s > t) + (s == t) for y, s in blend(w) if y for z, t in blend(w) if not z) for j, w in weights.items()}
    assert R.ordered_pairs(df, weights, 1) == R.ordered_pairs(df, weights, 16) == want
    for bins in (64, 1 << 16):
        assert all(2 * low <= want[j] <= 2 * high for j, (low, high) in R.binned(df, weights, bins).items())


def test_simplex_search_writes_its_rows_once(spark):
    """The checkpoint folder gets the ranks and labels, once; blends of the last candidates are never written as rows."""
    df = spark.range(20_000).select(F.col("id"), (F.col("id") % 3 == 0).cast("int").alias("y"), V.uniform("a", F.col("id")).alias("a"), V.uniform("b", F.col("id")).alias("b"))
    checkpointed(spark.range(1))
    folder = Path(spark.sparkContext.getCheckpointDir().removeprefix("file:"))
    written = lambda: sum(f.stat().st_size for f in folder.rglob("*") if f.is_file())
    began = written()
    R.simplex_search(df, ["a", "b"], "y", R.candidates(2, 5)).collect()
    assert written() - began < 100 * 20_000
