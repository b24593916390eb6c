"""Orders, running sums and quantiles against plain Python, with nulls, ties and a value that a third of the rows have."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from wicker.operators import encode as E, evaluate as V, order as O


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(1)
    return [(i, draw.choice([draw.gauss(0, 1), 0.0, 5.0]) if draw.random() < 0.97 else None, draw.choice("abc"), "".join(draw.choice("abé") for _ in range(6))) for i in range(20_000)]


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame(rows, "id long, x double, g string, s string").cache()


def test_quantiles_are_exact(df, rows):
    ps = [0, 0.01, 0.25, 0.5, 0.75, 0.99, 1]
    want = np.quantile([x for _, x, *_ in rows if x is not None], ps)
    assert np.allclose(O.quantiles(df, {"x": ps, "id": [0.5]})["x"], want, rtol=0, atol=1e-12)
    assert np.allclose(O.quantiles(df, {"x": ps}, few=1500, near=0.02)["x"], want, rtol=0, atol=1e-12)
    assert O.quantiles(df.limit(0), {"x": [0.5]}) == {"x": [None]} and O.quantiles(df.where("id = 3"), {"id": [0.5, 1.0]}) == {"id": [3.0, 3.0]}


def test_positions_and_running_sums(df, rows):
    got = {r.id: r.k for r in O.numbered(df.select("id", "x"), -F.col("x"), "id").collect()}
    assert [got[r[0]] for r in sorted(rows, key=lambda r: (r[1] is not None, -(r[1] or 0), r[0]))] == list(range(len(rows)))
    levels = {r.level: r.code for r in E.codes(df, "s").collect()}
    assert levels == {s: i for i, s in enumerate(sorted({r[3] for r in rows}))}
    each = df.where("x is not null").groupBy("g", "x").agg(F.count("*").alias("n"))
    sums = {(r.g, r.x): r.b for r in O.running(each, "x", {"b": "n"}, ["g"]).collect()}
    for g in "abc":
        count, total = Counter(r[1] for r in rows if r[2] == g and r[1] is not None), 0
        for v in sorted(count):
            total += count[v]
            assert sums[g, v] == total
    placed = {r.id: r.fold for r in V.folds(df, "id", 5, "g").collect()}
    for g in "abc":
        ids = sorted((i for i, _, h, _ in rows if h == g), key=lambda i: (hashlib.md5(str(i).encode()).hexdigest(), i))
        assert [placed[i] for i in ids] == [k % 5 for k in range(len(ids))]


def test_windows_are_over_a_row_for_each_range(df):
    """Rows are numbered and summed within their range; the only windows are over what each range adds up to."""
    for plan in (O.numbered(df.select("id"), "id"), V.curve(df.withColumn("y", F.lit(1)), "y", "x"), V.rank_norm(df, "x")):
        text = plan._jdf.queryExecution().optimizedPlan().toString().splitlines()
        for i, line in enumerate(text):
            if "Window [" in line:
                below = text[i + 1 :]
                assert any("Aggregate" in x and "_part" in x for x in below[:3]), "\n".join(text[i : i + 4])


def test_null_keys_stay(spark):
    df = spark.createDataFrame([(1, None, 1, 0), (2, None, 0, 1), (3, "a", 1, 0), (4, "a", 0, 1)], "id int, c string, y int, fold int")
    got = {r.id: r.te for r in E.target_encode_oof(df, "c", "y", "fold", 1).collect()}
    assert got == {1: 0.25, 2: 0.75, 3: 0.25, 4: 0.75}
    scores = spark.createDataFrame([(1, 0.5, 1), (2, None, 0), (3, 0.1, 0), (4, 0.5, 0)], "id int, s double, y int")
    assert {r.id: r.rank for r in V.rank_norm(scores, "s").collect()} == {1: 2.5 / 3, 2: None, 3: 1 / 3, 4: 2.5 / 3}
    assert [r.id for r in V.top(scores, "s", "id", 2).collect()] == [1, 4] and V.auc(scores).first().auc == 0.75
    assert {r.id for r in V.top(scores, "s", "id", 4).collect()} == {1, 2, 3, 4}
