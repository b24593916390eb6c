import math

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from wicker.operators import learn
from wicker.operators.deep_tree import tree_out_of_fold
from wicker.operators.evaluate import auc, folds
from wicker.plans import deeper, further, queries as tabular, wider  # noqa: F401
from wicker.sources.tables import wide

FOLDER = "/root/testdata/sf0.001"


def rows_of(spark, name):
    return tabular.QUERIES[name](spark, FOLDER).collect()


def wide_ids(spark):
    return sorted(r.row_id for r in wide(spark, FOLDER).select("row_id").collect())


@pytest.mark.parametrize("name", ["logit_oof", "rf_oof", "gbt_oof", "tree_oof", "elastic_oof", "ridge_calibrated", "boosted_early", "smote_in_folds", "stacking"])
def test_out_of_fold_queries_score_every_row_once(spark, name):
    got = rows_of(spark, name)
    assert sorted(r.row_id for r in got) == wide_ids(spark) and all(0 <= r.p <= 1 for r in got) and len({r.p for r in got}) > 1
    if name != "stacking":
        of = {}
        for r in got:
            of.setdefault((r.fold, r.y), []).append(r)
        folds = {f for f, _ in of}
        assert folds == set(range(2 if name == "smote_in_folds" else 3))
        for y in (0, 1):
            sizes = [len(of.get((f, y), [])) for f in folds]
            assert max(sizes) - min(sizes) <= 1  # stratified


def test_test_averaged_and_bundle_score_test_rows(spark):
    want = sorted(r.row_id for r in wide(spark, FOLDER).where("is_train = 0").select("row_id").collect())
    for name in ("test_averaged", "model_bundle", "soft_f1_boosted"):
        got = rows_of(spark, name)
        assert sorted(r.row_id for r in got) == want and all(0 <= r.p <= 1 for r in got)


def test_smote_queries_reach_the_ratio(spark):
    w = wide(spark, FOLDER)
    rare = {r.row_id: r for r in w.where("y4 = 1").collect()}
    want = int(0.25 * (w.count() - len(rare))) - len(rare)
    for name in ("smote", "smotenc"):
        got = rows_of(spark, name)
        assert len(got) == want and {r.source for r in got} <= set(rare)
        low, high = min(r.c_acctbal for r in rare.values()), max(r.c_acctbal for r in rare.values())
        assert all(low <= r.c_acctbal <= high for r in got)
    near = rows_of(spark, "nn_category")
    assert len(near) == want and {r.c_mktsegment for r in near} <= {r.c_mktsegment for r in rare.values()}


def test_adversarial_auc_tells_drift(spark):
    got = rows_of(spark, "adversarial_auc")
    assert len(got) == 1 and 0.3 < got[0].auc < 1  # the sides differ by date alone
    a = spark.createDataFrame([(i, float(i % 17)) for i in range(400)], "row_id long, x double")
    b = a.select((F.col("row_id") + 400).alias("row_id"), "x")
    same = learn.adversarial_auc(a, b, ["x"], "row_id").first().auc
    moved = learn.adversarial_auc(a, b.withColumn("x", F.col("x") + 50), ["x"], "row_id").first().auc
    assert abs(same - 0.5) < 0.1 and moved > 0.99


def test_components_are_orthogonal_and_explain_what_they_say(spark):
    got = rows_of(spark, "pca_rows")
    x = np.array([list(r.pc) for r in got])
    cov = np.cov(x.T)
    assert np.abs(cov - np.diag(np.diag(cov))).max() < 1e-6 * cov.max() and (np.diff(np.diag(cov)) <= 1e-9).all()
    raw = np.array([r.embedding for r in spark.read.parquet(f"{FOLDER}/embeddings.parquet").collect()], float)
    whole = np.linalg.eigvalsh(np.cov(raw.T))[::-1]
    assert np.allclose(np.diag(cov), whole[: x.shape[1]], rtol=1e-6) and whole[: x.shape[1]].sum() >= 0.95 * whole.sum() > whole[: x.shape[1] - 1].sum()
    told = sorted(rows_of(spark, "pca_explained"), key=lambda r: r.component)
    assert np.allclose([r.variance for r in told], whole / whole.sum(), atol=1e-9) and sum(r.kept for r in told) == x.shape[1]


def test_clusters_have_the_nearest_centre(spark):
    for r in rows_of(spark, "kmeans_dist")[:100]:
        gaps = [r[f"distance_{i}"] for i in range(8)]
        assert gaps[r.cluster] == min(gaps)
    several = rows_of(spark, "kmeans_several")
    assert {r.cluster_4 for r in several} == set(range(4)) and all(r.nearest_4 >= 0 and r.nearest_8 >= 0 for r in several)
    few = rows_of(spark, "kmeans_minibatch")
    assert len(few) == len(several) and {r.cluster for r in few} <= set(range(8))


def test_quantile_normal_query_is_normal(spark):
    x = np.sort([r.o_totalprice for r in rows_of(spark, "quantile_normal")])
    assert abs(np.median(x)) < 0.1 and 0.9 < np.quantile(x, 0.84) < 1.1 and x.max() <= 5.2


def test_oof_scores_are_those_of_the_folds(spark):
    got = {r.fold: r.auc for r in rows_of(spark, "oof_scores")}
    assert got == {r.fold: r.auc for r in auc(tabular.QUERIES["logit_oof"](spark, FOLDER), "y", "p", ["fold"]).collect()} and set(got) == {0, 1, 2}


def test_arms_are_ranked_by_their_score(spark):
    got = rows_of(spark, "arm_search")
    assert [r.f1 for r in got] == sorted((r.f1 for r in got), reverse=True) and len(got) == 6 and all(0 <= r.f1 <= 1 for r in got)


def test_2000_draws_do_no_worse_than_23(spark):
    many, few = rows_of(spark, "simplex_search_2000")[0], rows_of(spark, "simplex_search")[0]
    assert many.auc >= few.auc and abs(sum(many.weights) - 1) < 1e-6


def test_every_query_without_sql_is_tested_here():
    here = {"logit_oof", "rf_oof", "gbt_oof", "tree_oof", "elastic_oof", "ridge_calibrated", "boosted_early", "smote_in_folds", "stacking", "test_averaged", "model_bundle", "soft_f1_boosted", "smote", "smotenc", "nn_category",
            "adversarial_auc", "pca_rows", "pca_explained", "kmeans_dist", "kmeans_several", "kmeans_minibatch", "quantile_normal", "oof_scores", "arm_search", "simplex_search_2000"}
    assert set(tabular.QUERIES) - set(tabular.ORACLE) == here


def noisy(spark, n=600):
    """Rows whose labels are drawn by themselves: a model that has seen a row can know its label, no other can."""
    rng = np.random.default_rng(1)
    rows = [(i, int(rng.random() < 0.3), *map(float, rng.normal(size=2))) for i in range(n)]
    return folds(spark.createDataFrame(rows, "row_id long, y int, a double, b double"), "row_id", 3, "y")


def test_no_model_has_seen_the_rows_that_it_scores(spark):
    df = noisy(spark)
    seen = learn.assemble(df, ["a", "b"])
    own = learn.tree(20).fit(seen).transform(seen).select("y", vector_to_array("probability")[1].alias("p"))
    assert auc(own, "y", "p").first().auc > 0.95
    assert abs(auc(learn.out_of_fold(seen, learn.tree(20)), "y", "p").first().auc - 0.5) < 0.1
    assert abs(auc(learn.out_of_fold_smote(df, ["a", "b"], learn.tree(20), 0.9), "y", "p").first().auc - 0.5) < 0.1
    assert abs(auc(learn.stacked(seen, {"t": learn.tree(20), "l": learn.logistic()}).join(df.select("row_id", "y"), "row_id"), "y", "p").first().auc - 0.5) < 0.15


def test_rounds_end_where_the_held_part_no_longer_gains(spark):
    df = learn.assemble(noisy(spark), ["a", "b"]).withColumn("held", F.col("row_id") % 4 == 0)
    stopped, full = learn.boosted(30, 3, "held").fit(df), learn.boosted(30, 3).fit(df)
    assert stopped.getNumTrees < full.getNumTrees == 30


def test_normal_quantile(spark):
    p = [1e-7, 0.001, 0.02, 0.3, 0.5, 0.975, 0.9999]
    got = [r.q for r in spark.createDataFrame([(i, x) for i, x in enumerate(p)], "i int, p double").select("i", learn.normal_quantile(F.col("p")).alias("q")).orderBy("i").collect()]
    assert all(abs(0.5 * math.erfc(-q / math.sqrt(2)) - x) < 1e-8 for q, x in zip(got, p))


def test_quantile_normal_takes_the_middle_of_ties(spark):
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate([0, 0, 0, 1, 2])], "i int, x double")
    got = [r.x for r in learn.quantile_normal(df, "x", df, knots=5).orderBy("i").collect()]
    assert abs(got[0] - (-0.6744897501960817)) < 1e-6 and got[0] == got[2] and got[4] > 5


def test_quantile_normal_searches_its_knots_once_a_row(spark):
    """1000 knots on nulls, NaN, ties and values beyond the fitted ones against plain numpy; no array of knots is gone through for a row."""
    rng = np.random.default_rng(2)
    x = np.round(rng.normal(size=20_000), 3)
    odd = [(-1, None), (-2, float("nan")), (-3, -99.0), (-4, 99.0)]
    fitted = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "i int, x double")
    made = learn.quantile_normal(fitted.unionByName(spark.createDataFrame(odd, "i int, x double")), "x", fitted, knots=1000)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "lambdafunction" not in plan and plan.count("share(") == plan.count("ArrowEvalPython")
    got = {r.i: r.x for r in made.collect()}
    at = np.linspace(0, 1, 1000)
    q = np.quantile(x, at)
    middle = (np.searchsorted(q, x, "left") + np.searchsorted(q, x, "right") - 1) / 2 / 999
    u = np.clip(np.where(np.isin(x, q), middle, np.interp(x, q, at)), 1e-7, 1 - 1e-7)
    assert max(abs(0.5 * math.erfc(-got[i] / math.sqrt(2)) - p) for i, p in enumerate(u)) < 1e-6
    assert got[-1] is None and got[-2] == got[-4] > 5 and got[-3] < -5


def plain_tree(rows, depth=30):
    """The share of label 1 in the leaf of each tuple of values, by recursion over (values, label)."""
    n1 = sum(y for _, y in rows)
    best = (0, 0, 0)
    for j in range(len(rows[0][0])):
        for v in sorted({x[j] for x, _ in rows})[:-1]:
            side = [y for x, y in rows if x[j] <= v]
            l1, l0 = sum(side), len(side) - sum(side)
            r1, r0 = n1 - l1, len(rows) - len(side) - n1 + l1
            gain = (l1 * r0 - l0 * r1) ** 2 / (len(side) * (len(rows) - len(side)))
            best = max(best, (gain, -j, -v))
    if not depth or not best[0]:
        return {x: n1 / len(rows) for x, _ in rows}
    j, v = -best[1], -best[2]
    return plain_tree([r for r in rows if r[0][j] <= v], depth - 1) | plain_tree([r for r in rows if r[0][j] > v], depth - 1)


@pytest.mark.parametrize("few,depth", [(10**6, 30), (40, 30), (40, 4)])
def test_deep_tree_is_that_of_plain_recursion(spark, few, depth):
    """Whether nodes are split by sums over tasks or within one; no leaves are merged, so a model knows what it has seen."""
    rng = np.random.default_rng(3)
    rows = [(i, int(rng.random() < 0.4), i % 3, *map(float, rng.integers(0, 8, size=3))) for i in range(4000)]
    df = spark.createDataFrame(rows, "row_id long, y int, fold int, a double, b double, c double").repartition(5)
    got = {r.row_id: r.p for r in tree_out_of_fold(df, ["a", "b", "c"], depth=depth, few=few).collect()}
    assert len(got) == len(rows)
    for f in range(3):
        known = plain_tree([(r[3:], r[1]) for r in rows if r[2] != f], depth)
        mine = [r for r in rows if r[2] == f and r[3:] in known]  # all but a few cells occur in both
        assert len(mine) > 1200 and max(abs(got[r[0]] - known[r[3:]]) for r in mine) < 1e-12


def test_training_rows_are_made_once_for_all_folds(spark):
    """Fits read what was written, not the joins and windows of the folds; what stands before a range goes to every task."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    df = noisy(spark).select("row_id", "y", "a", "b", "fold")
    train, test = df.mapInArrow(count, df.schema), df.drop("fold")
    got = {r.row_id: r.p for r in learn.averaged_over_folds(train, test, learn.logistic(), columns=["a", "b"]).collect()}
    assert 600 <= seen.value < 3 * 600
    same = learn.averaged_over_folds(learn.assemble(df, ["a", "b"]), learn.assemble(test, ["a", "b"]), learn.logistic()).collect()
    assert len(got) == 600 and all(abs(got[r.row_id] - r.p) < 1e-9 for r in same)
    assert "strategy=broadcast" in noisy(spark)._jdf.queryExecution().optimizedPlan().toString()
