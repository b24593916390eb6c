"""Correlations, neighbours, blends, rates, ranges, streams, seals and centres against numpy and plain Python."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from wicker.operators import boost, encode as E, evaluate as V, learn, moments, neighbours as N, order as O, resample as R
from wicker.sources import tables as S


# -- correlations


def plain_corr(x):
    out = {}
    for i in range(x.shape[1]):
        for j in range(i + 1, x.shape[1]):
            both = np.isfinite(x[:, i]) & np.isfinite(x[:, j])
            u, v = x[both, i], x[both, j]
            ok = len(u) > 1 and u.min() < u.max() and v.min() < v.max()
            out[f"c{i}", f"c{j}"] = float(np.corrcoef(u, v)[0, 1]) if ok else None
    return out


def test_correlations_are_pairwise_complete(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 9)) @ rng.normal(size=(9, 9)) + 1e6 * np.arange(9)
    x[rng.random(x.shape) < 0.2] = np.nan
    x[:, 7] = np.where(np.isnan(x[:, 7]), np.nan, 0.1)  # one value
    x[:, 8] = np.where(np.isnan(x[:, 0]), x[:, 8], 1e9 + 0.1)  # one value where column 0 has any
    x[5, 3] = np.inf
    rows = [tuple(None if np.isnan(v) else float(v) for v in r) for r in x]
    df = spark.createDataFrame(rows, ", ".join(f"c{i} double" for i in range(9))).repartition(7)
    got = {(r.a, r.b): r.r for r in moments.correlations(df, df.columns).collect()}
    want = plain_corr(x)
    assert got.keys() == want.keys()
    for k, r in want.items():
        assert (got[k] is None) == (r is None) and (r is None or abs(got[k] - r) < 1e-9), k
    assert want["c0", "c8"] is None and want["c1", "c8"] is not None
    empty = moments.correlations(df.limit(0), ["c0", "c1"]).collect()
    assert [tuple(r) for r in empty] == [("c0", "c1", None)] and moments.correlations(df, ["c0"]).collect() == []


def test_a_column_with_one_row_costs_no_other_pair(spark):
    df = spark.createDataFrame([(float(i), float(i * i), 1.0 if i == 3 else None) for i in range(50)], "a double, b double, c double")
    got = {(r.a, r.b): r.r for r in moments.correlations(df, ["a", "b", "c"]).collect()}
    assert abs(got["a", "b"] - np.corrcoef(np.arange(50), np.arange(50) ** 2)[0, 1]) < 1e-12 and got["a", "c"] is None


def test_correlations_of_350_columns_with_missing_cells(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(600, 350))
    x[:, 200] = 3 * x[:, 7] + 1e-9 * x[:, 8]
    x[rng.random(x.shape) < 0.01] = np.nan
    df = spark.createDataFrame([tuple(None if np.isnan(v) else float(v) for v in r) for r in x], ", ".join(f"c{i} double" for i in range(350)))
    got = {(r.a, r.b): r.r for r in moments.correlations(df, df.columns).collect()}
    want = plain_corr(x[:, [0, 7, 63, 64, 65, 200, 349]])
    names = dict(zip([f"c{i}" for i in range(7)], ["c0", "c7", "c63", "c64", "c65", "c200", "c349"]))
    assert len(got) == 350 * 349 // 2 and all(abs(got[names[a], names[b]] - r) < 1e-12 for (a, b), r in want.items())


# -- neighbours


def brute(a, b, k, same, penalty=0.0):
    """a, b: (id, numbers, category) -> {source: [neighbour, ...]}"""
    out = {}
    for i, u, c in a:
        gaps = sorted((sum((x - y) * (x - y) for x, y in zip(u, v)) + (c != d) * penalty * penalty, j) for j, v, d in b if not same or j != i)
        out[i] = [j for _, j in gaps[:k]]
    return out


@pytest.mark.parametrize("dims", [2, 16])
def test_neighbours_equal_brute_force(spark, dims, monkeypatch):
    rng = np.random.default_rng(dims)
    x = np.concatenate([rng.normal(size=(700, dims)), 5 + 0.1 * rng.normal(size=(500, dims)), np.round(rng.normal(size=(200, dims))), np.repeat(rng.normal(size=(1, dims)), 60, 0)])
    rows = [(int(i), v.tolist(), "") for i, v in zip(rng.permutation(len(x)), x)]
    df = spark.createDataFrame([(i, *v) for i, v, _ in rows] + [(9000, *[None] * dims)], "id long, " + ", ".join(f"x{i} double" for i in range(dims)))
    got = {}
    for r in N.neighbours(df, [f"x{i}" for i in range(dims)], "id", 5, cells=30).collect():
        got.setdefault(r.source, {})[r.k] = r.neighbour
    want = brute(rows, rows, 5, True)
    assert {i: [g[k] for k in range(1, 6)] for i, g in got.items()} == want
    monkeypatch.setattr(N, "SAMPLE", 64)  # a sample that foresees few leaves: large ones go block by block
    again = {(r.source, r.k): r.neighbour for r in N.neighbours(df, [f"x{i}" for i in range(dims)], "id", 5, cells=100).collect()}
    assert again == {(i, k): j for i, g in got.items() for k, j in g.items()}


def test_work_of_the_search_grows_with_the_rows():
    """Leaves, of about as many rows each, that a row has to search do not grow in number with ten times as many rows."""
    rng, per_row = np.random.default_rng(3), []
    for n in (20_000, 200_000):
        x = rng.normal(size=(n, 2))
        tree = N.planted(x[: N.SAMPLE], n // N.LEAF)
        leaf = tree.leaf(x)
        nodes = 2 * tree.inner + 1
        tree.low, tree.high = np.full((nodes, 2), np.inf), np.full((nodes, 2), -np.inf)
        np.minimum.at(tree.low, leaf + tree.inner, x)
        np.maximum.at(tree.high, leaf + tree.inner, x)
        for i in range(tree.inner - 1, -1, -1):
            tree.low[i], tree.high[i] = np.minimum(tree.low[2 * i + 1], tree.low[2 * i + 2]), np.maximum(tree.high[2 * i + 1], tree.high[2 * i + 2])
        tree.centre, tree.radius = (tree.low + tree.high) / 2, np.full(nodes, np.inf)
        some = x[:1000]
        far = np.array([np.partition(((x - s) ** 2).sum(axis=1), 6)[6] for s in some])
        rows, leaves = tree.reached(some, far)
        per_row.append(len(leaves) / 1000)
    assert per_row[1] < 1.2 * per_row[0] < 3


def test_a_category_changes_the_neighbour(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=2).tolist(), "ab"[int(rng.integers(0, 2))] if i % 9 else None) for i in range(400)]
    df = spark.createDataFrame([(i, *v, c) for i, v, c in rows], "id long, x double, y double, c string")
    penalty = N.nominal_penalty(df, ["x", "y"])
    stds = np.array([v for _, v, _ in rows]).std(axis=0)
    assert abs(penalty - np.median(stds)) < 1e-12
    got = {(r.source, r.k): r.neighbour for r in N.neighbours(df, ["x", "y"], "id", 3, 9, ["c"], penalty).collect()}
    want = {(i, k + 1): j for i, near in brute(rows, rows, 3, True, penalty).items() for k, j in enumerate(near)}
    plain = {(i, k + 1): j for i, near in brute(rows, rows, 3, True).items() for k, j in enumerate(near)}
    assert got == want and want != plain


def test_smote_lies_between_a_row_and_its_neighbour(spark):
    rng = random.Random(6)
    rows = [(i, rng.gauss(0, 1), rng.gauss(0, 1), 1, rng.choice("ab")) for i in range(60)] + [(100 + i, 50.0, 50.0, 0, "z") for i in range(600)]
    df = spark.createDataFrame(rows, "id long, x double, y double, t int, c string")
    made = learn.smote(df, ["x", "y"], "t", "id", 0.5, k=3, sides=["c"]).collect()
    assert len(made) == 300 - 60 and {r.c for r in made} <= {"a", "b"} and len({(r.source, r.copy) for r in made}) == len(made)
    minority = [(i, [x, y], c) for i, x, y, t, c in rows if t]
    near, at = brute(minority, minority, 3, True, N.nominal_penalty(df.where("t = 1"), ["x", "y"])), {i: np.array(v) for i, v, _ in minority}
    for r in made:
        p, ends = np.array([r.x, r.y]), [at[j] for j in near[r.source]]
        off = [abs(np.linalg.norm(p - at[r.source]) + np.linalg.norm(p - e) - np.linalg.norm(at[r.source] - e)) for e in ends]
        assert min(off) < 1e-9


# -- blends and rates


def plain_auc(y, s):
    rank = np.searchsorted(np.sort(s), s, "left") + (np.searchsorted(np.sort(s), s, "right") - np.searchsorted(np.sort(s), s, "left") + 1) / 2
    p = y.sum()
    return (rank[y == 1].sum() - p * (p + 1) / 2) / (p * (len(y) - p))


def test_simplex_search_finds_the_best_of_all_candidates(spark):
    rng = np.random.default_rng(7)
    y = (rng.random(3000) < 0.3).astype(int)
    cols = [np.round(y * w + rng.normal(size=3000), d) for w, d in ((0.5, 1), (0.8, 2), (0.2, 3))]
    df = spark.createDataFrame([(int(a), *map(float, r)) for a, *r in zip(y, *cols)], "y int, p double, q double, r double")
    weights = R.candidates(3, 300)
    ranks = [np.array([(np.sort(c).searchsorted(v, "left") + np.sort(c).searchsorted(v, "right") + 1) / 2 / len(c) for v in c]) for c in cols]
    aucs = [round(plain_auc(y, np.round(sum(w * r for w, r in zip(ws, ranks)), 12)), 9) for ws in weights]
    for bins in (512, 4):
        best = R.simplex_search(df, ["p", "q", "r"], "y", weights, bins).first()
        assert best.candidate == int(np.argmax(aucs)) and best.auc == max(aucs) and best.weights == weights[best.candidate]
    assert R.simplex_search(df.where("y = 1"), ["p", "q", "r"], "y", weights).first().auc is None
    assert all(abs(sum(w) - 1) < 1e-8 and min(w) >= 0 for w in R.candidates(4, 50))


def test_median_of_a_plateau_by_group(spark):
    rng = np.random.default_rng(8)
    rows = [(i, int(rng.random() < 0.4), float(np.round(rng.random(), 2)), "ab"[i % 2] if i % 5 else None) for i in range(900)]
    df = spark.createDataFrame(rows, "id long, y int, s double, g string")
    got = {r.g: (r.n_plateau, r.rate) for r in R.plateau_rate(df, by=["g"]).collect()}
    for g in ("a", "b", None):
        one = R.plateau_rate(df.where(F.col("g").eqNullSafe(F.lit(g)))).first()
        assert got[g] == (one.n_plateau, one.rate)
    assert V.curve(df, by=["g"]).count() == len({(g, s) for _, _, s, g in rows})


# -- ranges and quantiles


def test_many_partitions_add_no_time_on_the_driver(spark):
    df = spark.range(20_000).select(F.col("id"), (F.col("id") * 7919 % 20_011).cast("double").alias("x")).cache()
    df.count()
    before, took = spark.conf.get("spark.sql.shuffle.partitions"), {}
    try:
        for parts in (200, 600):
            spark.conf.set("spark.sql.shuffle.partitions", str(parts))
            O.numbered(df, "x", "id").count()
            began = time.time()
            got = O.numbered(df, "x", "id")
            took[parts] = time.time() - began
            assert got.agg(F.count_distinct("k"), F.min("k"), F.max("k")).first()[:] == (20_000, 0, 19_999)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert took[600] < 6 * took[200] + 2, took  # tasks grow threefold, the plan doesn't


def test_positions_hold_a_key_that_a_third_of_the_rows_have(spark):
    rows = [(i, "hot" if i % 3 == 0 else f"k{i % 50}", i % 7) for i in range(6000)]
    df = spark.createDataFrame(rows, "id long, s string, v int").repartition(5)
    got = {r.id: r.k for r in O.numbered(df, "s", "id").collect()}
    assert got == {i: k for k, (_, i) in enumerate(sorted((s, i) for i, s, _ in rows))}
    sums = {(r.s, r.id): r.t for r in O.running(df, "id", {"t": "v"}, ["s"]).collect()}
    total = {}
    for i, s, v in sorted(rows):
        total[s] = total.get(s, 0) + v
        assert sums[s, i] == total[s]


def test_quantiles_bring_a_row_each_to_the_driver(spark, monkeypatch):
    rng = np.random.default_rng(9)
    x = np.round(rng.normal(size=(4000, 3)), 2)
    df = spark.createDataFrame([(*map(float, r[:2]), None if i % 10 else float("nan"), float(r[2]) if i % 3 else None) for i, r in enumerate(x)], "a double, b double, n double, c double")
    at = [i / 499 for i in range(500)]
    kinds = []
    plain = type(df).collect
    monkeypatch.setattr(type(df), "collect", lambda self: (kinds.append(rows := plain(self)), rows)[1])
    got = O.quantiles(df, {"a": at, "b": [0.5], "n": [0.5], "c": [0.0, 1.0]})
    assert all(len(rows) <= 2 * 503 for rows in kinds)
    monkeypatch.undo()
    assert np.allclose(got["a"], np.quantile(x[:, 0], at), atol=1e-12) and got["n"] == [None]
    some = x[[i for i in range(4000) if i % 3], 2]
    assert got["c"] == [some.min(), some.max()]


# -- encodings, streams, seals, bundles, centres


def test_unseen_levels_take_the_mean_of_the_levels(spark):
    train = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 8.0)], "g string, x double")
    got = {r.g: (r.x_mean, round(r.x_std, 9)) for r in E.apply_all(spark.createDataFrame([("a",), ("b",), ("z",), (None,)], "g string"), "g", E.group_stats(train, "g", ["x"])).collect()}
    s = round(2**0.5, 9)
    assert got == {"a": (2.0, s), "b": (8.0, 0.0), "z": (5.0, round(2**0.5 / 2, 9)), None: (5.0, round(2**0.5 / 2, 9))}


def test_a_stream_takes_each_file_once(spark, tmp_path):
    decode = lambda df: df.withColumn("f", E.bool_text(F.col("f")))
    for k, text in enumerate(['id,f\n1,yes\n2,"no, never"\n', "id,f\n3,\n", 'id,f\n4,"yes ""so"""\n']):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{k}.csv").write_text(text)
        S.decode_stream(spark, str(tmp_path / "in"), "id long, f string", str(tmp_path / "out"), decode)
        if k == 1:
            S.decode_stream(spark, str(tmp_path / "in"), "id long, f string", str(tmp_path / "out"), decode)
    got = spark.read.schema("id long, f int").csv(str(tmp_path / "out"), header=True).collect()
    assert sorted((r.id, r.f) for r in got) == [(1, 1), (2, 0), (3, None), (4, 1)]


def test_seals_tell_another_schema_and_another_plan(spark, tmp_path):
    df = spark.range(5).select("id", F.lit("a").alias("c"))
    S.sealed(df.groupBy("c").count(), df).write.parquet(str(tmp_path / "f"))
    fitted = spark.read.parquet(str(tmp_path / "f"))
    S.check_seal(fitted, df, plan=True)
    S.check_seal(fitted, df.where("id > 2"))
    for other, plan in ((df.select("c", "id"), False), (df.withColumn("id", F.col("id").cast("int")), False), (df.where("id > 2"), True)):
        with pytest.raises(ValueError, match="differs"):
            S.check_seal(fitted, other, plan)
    with pytest.raises(ValueError, match="no seal"):
        S.check_seal(df, df)


def test_a_stored_bundle_serves_other_rows(spark):
    rng = random.Random(2)
    rows = [(i, (x := rng.gauss(0, 1)), rng.gauss(0, 100), int(x + rng.gauss(0, 0.3) > 0)) for i in range(400)]
    df = spark.createDataFrame(rows, "row_id long, a double, b double, y int")
    path = learn.store_bundle(df.where("row_id < 300").select("y", "a", "b"), ["a", "b"], [learn.logistic(), learn.forest(5, 3)])
    got = {r.row_id: r.p for r in learn.serve_bundle(spark, path, df.where("row_id >= 300").drop("y")).collect()}
    y = np.array([r[3] for r in rows if r[0] >= 300])
    assert len(got) == 100 and plain_auc(y, np.array([got[i] for i in range(300, 400)])) > 0.9
    again = {r.row_id: r.p for r in learn.serve_bundle(spark, path, df.drop("y")).collect()}
    assert all(again[i] == p for i, p in got.items())  # a row's score is its own, whatever rows it comes with
    with pytest.raises(ValueError, match="'b'"):
        learn.serve_bundle(spark, path, df.select("row_id", "a"))


def test_minibatch_centres_come_near_k_means_on_any_partitioning(spark):
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rng = np.random.default_rng(11)
    x = np.repeat(10 * rng.normal(size=(6, 4)), 400, 0) + rng.normal(size=(2400, 4))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(9000, None), (9001, [None] * 4)], "id long, v array<double>")
    some = learn.minibatch_centres(df, "v", "id", 6)
    assert (some == learn.minibatch_centres(df.repartition(13), "v", "id", 6)).all()
    fine = df.where("id < 9000")
    whole = KMeans(k=6, seed=7).fit(fine.withColumn("features", array_to_vector("v")))
    cost = lambda c: sum(min(((p - q) ** 2).sum() for q in c) for p in x)
    assert cost(some) <= 1.05 * cost(whole.clusterCenters())
    got = learn.labelled(fine, "v", some).collect()
    assert all(r.cluster == int(np.argmin([((np.array(r.v) - c) ** 2).sum() for c in some])) for r in got[:200])


def test_schema_checks(spark):
    train = spark.range(1).select(F.lit(1).alias("k"), F.lit(2).alias("a"), F.lit(0).alias("y"))
    got = {r.check: r.ok for r in S.schema_checks(train, train.select("a", "k"), "y", "k").collect()}
    assert got == {"target_present": True, "key_present": True, "key_first": True, "key_last": False, "same_order": False}


# -- boosting


def labelled_rows(seed, n):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 4))
    y = (np.sin(2 * x[:, 0]) + x[:, 1] * x[:, 2] + 0.3 * rng.normal(size=n) > 0.8).astype(int)
    x[rng.random(x.shape) < 0.05] = np.nan
    return [(i, int(a), *(None if np.isnan(v) else float(v) for v in r)) for i, (a, r) in enumerate(zip(y, x))]


def test_derivatives_are_differences():
    rng = np.random.default_rng(1)
    y, m, e = (rng.random(40) < 0.3).astype(float), rng.normal(size=40), 1e-5
    loss = lambda v: -(y * np.log(boost.sigmoid(v)) + (1 - y) * np.log(1 - boost.sigmoid(v))).sum()
    soft = lambda v: 40 * (1 - 2 * (boost.sigmoid(v) * y).sum() / (boost.sigmoid(v).sum() + y.sum()))
    for f, value, totals in ((boost.log_loss, loss, np.zeros(0)), (boost.soft_f1, soft, np.array([*boost.soft_counts(y, m), 40]))):
        first, second = f(y, m, totals)
        for i in range(40):
            up, down = m.copy(), m.copy()
            up[i] += e
            down[i] -= e
            assert abs((value(up) - value(down)) / (2 * e) - first[i]) < 1e-6 and second[i] > 0
            if f is boost.log_loss:
                assert abs((f(y, up, totals)[0][i] - f(y, down, totals)[0][i]) / (2 * e) - second[i]) < 1e-6


def test_boosting_by_log_loss_is_as_good_as_spark_s(spark):
    from pyspark.ml.functions import vector_to_array

    columns = ["a", "b", "c", "d"]
    df = spark.createDataFrame(labelled_rows(2, 4000), "row_id long, y int, a double, b double, c double, d double").fillna(-9.0, columns)
    train, test = df.where("row_id < 3000"), df.where("row_id >= 3000")
    model = boost.fit(train, columns, "y", rounds=12, depth=3, rate=0.3)
    ours = boost.scored(test, model, "row_id").join(test, "row_id")
    spark_s = learn.boosted(12, 3).fit(learn.assemble(train, columns)).transform(learn.assemble(test, columns)).withColumn("p", vector_to_array("probability")[1])
    assert V.auc(ours, "y", "p").first().auc > V.auc(spark_s, "y", "p").first().auc - 0.01


def test_soft_f1_rises_with_the_rounds(spark):
    columns = ["a", "b", "c", "d"]
    df = spark.createDataFrame(labelled_rows(3, 1500) + [(9000, None, 1.0, 1.0, 1.0, 1.0)], "row_id long, y int, a double, b double, c double, d double")
    model = boost.fit(df, columns, "y", boost.SOFT_F1, rounds=6, every=3)
    known, values = df.where("y is not null"), []
    for k in (0, 1, 3, 6):
        some = boost.Boosted(model.columns, model.edges, model.base, model.trees[:k])
        values.append(boost.soft_f1_value(boost.scored(known, some, "row_id").join(known, "row_id")))
    assert values == sorted(values) and values[-1] > values[0] + 0.1, values
    assert boost.scored(df, model, "row_id").count() == 1501
    alone = boost.fit(df.where("y = 1"), columns, "y", rounds=3)
    assert alone.trees == [] and boost.scored(df.limit(3), alone, "row_id").where("p = 0.5").count() == 3
