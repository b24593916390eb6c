"""Registered queries on files and reports, fold metrics, correlations over many columns, and whole-table encodings."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from wicker.operators import encode as E, evaluate as V, profile as P, resample as R, transform as T
from wicker.plans.queries import NUMBERS, each, query, rounded, split
from wicker.plans.scoring import PRED, pred
from wicker.sources import tables as S
from wicker.sources.tables import SCORES, WIDE, read, scores, wide

# -- files


@query("SELECT c_custkey, c_name, c_acctbal FROM customer")
def csv_round_trip(spark, d):
    """Customers, written as CSV and read again with a schema that Spark infers, three columns of them."""
    path = S.first_existing(spark, [f"{d}/absent", S.shared_folder(spark)]) + f"/csv-{uuid.uuid4().hex}"
    S.write_csv(read(spark, d, "customer"), path)
    return S.read_csv(spark, path, columns=["c_custkey", "c_name", "c_acctbal"])


@query("SELECT n_nationkey || ' | ' || n_name || ' | ' || n_regionkey AS line FROM nation")
def report_lines(spark, d):
    path = f"{S.shared_folder(spark)}/report-{uuid.uuid4().hex}"
    S.write_report(read(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey"), path)
    return spark.read.text(path).withColumnRenamed("value", "line")


@query("SELECT DISTINCT column_name AS \"column\" FROM information_schema.columns WHERE table_name IN ('orders', 'customer')")
def column_union(spark, d):
    return spark.createDataFrame([(c,) for c in S.all_columns(read(spark, d, "orders"), read(spark, d, "customer"))], "column string")


@query("SELECT DISTINCT column_name AS extra FROM information_schema.columns WHERE table_name = 'orders' AND column_name NOT IN ('o_orderkey', 'o_custkey')")
def extra_columns(spark, d):
    return spark.createDataFrame([(c,) for c in S.contract_columns(read(spark, d, "orders"), ["o_custkey", "o_orderkey"])[1]], "extra string")


# -- profiles of many columns

PAIRS = [(a, b) for i, a in enumerate(NUMBERS) for b in NUMBERS[i + 1 :]]


@query(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 9) AS r FROM wide" for a, b in PAIRS), WIDE)
def pearson_matrix(spark, d):
    return rounded(P.correlations(wide(spark, d), NUMBERS), "r", digits=9)


FLAGS = ["urgent", "finished", "open", "rush"]
FLAGGED = "flagged AS (SELECT (o_orderpriority = '1-URGENT')::INT AS urgent, (o_orderstatus = 'F')::INT AS finished, (o_orderstatus <> 'F')::INT AS open, (o_orderpriority = '1-URGENT' AND o_orderkey % 20 > 0)::INT AS rush FROM orders)"


@query("SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, sum(({a} = 1 AND {b} = 1)::INT)::BIGINT AS both, sum(({a} = 1 AND {b} = 0)::INT)::BIGINT AS only_a, sum(({a} = 0 AND {b} = 1)::INT)::BIGINT AS only_b, sum(({a} = 0 AND {b} = 0)::INT)::BIGINT AS neither FROM flagged HAVING abs(corr({a}, {b})) > 0.8" for i, a in enumerate(FLAGS) for b in FLAGS[i + 1 :]) + ")", FLAGGED)
def correlated_flags(spark, d):
    """Pairs of flags with a correlation beyond 0.8 in size and their 2 x 2 counts."""
    o, urgent, done = read(spark, d, "orders"), F.col("o_orderpriority") == "1-URGENT", F.col("o_orderstatus") == "F"
    f = o.select(urgent.cast("int").alias("urgent"), done.cast("int").alias("finished"), (~done).cast("int").alias("open"), (urgent & (F.col("o_orderkey") % 20 > 0)).cast("int").alias("rush"))
    return P.flag_tables(f, FLAGS, 0.8)


@query("SELECT round((r1 + r2 + r3) / 3, 9) AS mean_r FROM (SELECT corr(p, q) AS r1, corr(p, (p + q) / 2) AS r2, corr(q, (p + q) / 2) AS r3 FROM pred)", SCORES, PRED)
def mean_model_corr(spark, d):
    three = pred(spark, d).withColumn("m", (F.col("p") + F.col("q")) / 2)
    return P.correlations(three, ["p", "q", "m"]).agg(F.round(F.avg("r"), 9).alias("mean_r"))


@query(each("SELECT '{c}' AS \"column\", coalesce(min({c}) FILTER (is_train = 1) = max({c}) FILTER (is_train = 1), true) AS in_train, coalesce(min({c}) FILTER (is_train = 0) = max({c}) FILTER (is_train = 0), true) AS in_test FROM (SELECT is_train, y4, 1.0 AS const, coalesce(nullif(sent, -999999), 0) AS sent, is_train * o_totalprice AS train_only FROM wide)", ["y4", "const", "sent", "train_only"]), WIDE)
def constant_sides(spark, d):
    """Columns without a second value after missing cells are filled, on the training side and on the test side."""
    w = wide(spark, d).select("is_train", "y4", F.lit(1.0).alias("const"), F.nullif("sent", F.lit(-999999.0)).alias("sent"), (F.col("is_train") * F.col("o_totalprice")).alias("train_only")).fillna(0.0)
    return P.constant_sides(w, ["y4", "const", "sent", "train_only"], "is_train")


@query("SELECT round(avg((cust NOT IN (SELECT cust FROM wide WHERE is_train = 1))::INT), 9) AS unseen_share FROM wide WHERE is_train = 0", WIDE)
def unseen_share(spark, d):
    train, test = split(wide(spark, d))
    seen = P.level_overlap(train, test, "cust")
    return seen.crossJoin(F.broadcast(test.agg(F.count("*").alias("n")))).select(F.round(F.col("unseen_rows") / F.col("n"), 9).alias("unseen_share"))


@query(each("SELECT '{c}' AS flag, round(abs(avg({c}) FILTER (is_train = 1) - avg({c}) FILTER (is_train = 0)), 9) AS gap FROM (SELECT is_train, y, y4, (c_mktsegment = 'BUILDING')::INT AS building FROM wide)", ["y", "y4", "building"]), WIDE)
def flag_rate_shifts(spark, d):
    w = wide(spark, d).withColumn("building", (F.col("c_mktsegment") == "BUILDING").cast("int"))
    of = lambda c, k: F.avg(F.when(F.col("is_train") == k, c))
    return P.per_column(w, ["y", "y4", "building"], gap=lambda c: F.round(F.abs(of(c, 1) - of(c, 0)), 9)).withColumnRenamed("column", "flag")


# -- encodings and transforms on rows


@query("SELECT row_id, round(coalesce(f, 0), 12) AS freq FROM wide LEFT JOIN (SELECT cust AS level, count(*) / sum(count(*)) OVER () AS f FROM wide GROUP BY 1) ON cust = level", WIDE)
def freq_encode_all(spark, d):
    """Relative frequencies of train and test together, on every row."""
    w = wide(spark, d)
    return rounded(E.apply(w, "cust", E.frequencies(w, "cust"), "freq", 0.0, "freq").select("row_id", "freq"), "freq", digits=12)


SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@query("SELECT row_id, " + ", ".join(f"(c_mktsegment = '{s}')::INT AS c_mktsegment_{i}" for i, s in enumerate(SEGMENTS)) + " FROM wide", WIDE)
def one_hot_levels(spark, d):
    """One-hot columns for the levels that training rows have, for columns of at most 50 levels: c_mktsegment, but not cust."""
    w = wide(spark, d).select("row_id", "is_train", "c_mktsegment", "cust")
    for c in ("c_mktsegment", "cust"):
        found = E.levels(split(w)[0], c, 50)
        w = E.one_hot(w, c, found) if found is not None else w
    return w.drop("is_train", "c_mktsegment", "cust")


GROUPS = """groups AS (SELECT cust AS level, avg(o_totalprice) AS m, coalesce(stddev(o_totalprice), 0) AS s, avg(c_acctbal) AS m2, coalesce(stddev(c_acctbal), 0) AS s2
 FROM wide WHERE is_train = 1 GROUP BY 1)"""


@query("SELECT row_id, round(coalesce(m, (SELECT avg(m) FROM groups)), 6) AS o_totalprice_mean, round(coalesce(s, (SELECT avg(s) FROM groups)), 6) AS o_totalprice_std, round(coalesce(m2, (SELECT avg(m2) FROM groups)), 6) AS c_acctbal_mean, round(coalesce(s2, (SELECT avg(s2) FROM groups)), 6) AS c_acctbal_std FROM wide LEFT JOIN groups ON cust = level", WIDE, GROUPS)
def group_agg_rows(spark, d):
    """Statistics of each row's level in training rows; unseen levels take the mean of the levels' values."""
    w, numbers = wide(spark, d), ["o_totalprice", "c_acctbal"]
    out = E.apply_all(w.select("row_id", "cust"), "cust", E.group_stats(split(w)[0], "cust", numbers)).drop("cust")
    return rounded(out, *(f"{c}_{s}" for c in numbers for s in ("mean", "std")))


@query("SELECT row_id, (sent = -999999)::INT AS sent_flag, (sparse = 0)::INT AS sparse_flag, (sent = -999999)::INT + (sparse = 0)::INT AS n_flags, nullif(sent, -999999) AS sent, nullif(sparse, 0) AS sparse FROM wide", WIDE)
def sentinel_flag_count(spark, d):
    """Flags and their count before the codes are nulled."""
    return T.sentinel_flags(wide(spark, d).select("row_id", "sent", "sparse"), {"sent": -999999.0, "sparse": 0.0})


TOP3 = "long3 AS (SELECT col, row_number() OVER (ORDER BY v DESC, col) AS k FROM (" + each("SELECT '{c}' AS col, var_samp({c}) AS v FROM wide", NUMBERS) + "))"


@query("SELECT col AS \"column\", k::BIGINT AS k FROM long3 WHERE k <= 3", WIDE, TOP3)
def products_columns(spark, d):
    names = T.product_features(wide(spark, d), NUMBERS, 3, 50)[0]
    return spark.createDataFrame(list(zip(names, range(1, 4))), "column string, k long")


@query("SELECT row_id, o_totalprice * c_acctbal AS a_x, o_totalprice * custkey AS b_x, custkey * c_acctbal AS c_x FROM wide", WIDE)
def products_rows(spark, d):
    """Products of every two of the three columns of the largest variance, which are these three."""
    names, w = T.product_features(wide(spark, d), ["o_totalprice", "c_acctbal", "custkey"], 3, 50)
    of = lambda a, b: F.col(f"{a}_x_{b}" if names.index(a) < names.index(b) else f"{b}_x_{a}")
    return w.select("row_id", of("o_totalprice", "c_acctbal").alias("a_x"), of("o_totalprice", "custkey").alias("b_x"), of("custkey", "c_acctbal").alias("c_x"))


# -- folds, thresholds, blends

FOLDP = "foldp AS (SELECT *, ((row_number() OVER (PARTITION BY y ORDER BY md5(id::VARCHAR), id) - 1) % 5)::INT AS fold FROM pred)"
FOLD_F1 = "f AS (SELECT fold, 2 * sum((p >= 0.5 AND y = 1)::INT) / (sum((p >= 0.5)::INT) + sum(y)) AS f1 FROM foldp GROUP BY 1)"


@query("SELECT fold, round(f1, 9) AS f1 FROM f", SCORES, PRED, FOLDP, FOLD_F1)
def fold_f1(spark, d):
    return rounded(V.fold_scores(V.folds(pred(spark, d), "id", 5, "y"), "y", "p"), "f1", digits=9)


@query("SELECT round(avg(f1), 9) AS mean, round(stddev_pop(f1), 9) AS std FROM f", SCORES, PRED, FOLDP, FOLD_F1)
def fold_summary(spark, d):
    found = V.fold_scores(V.folds(pred(spark, d), "id", 5, "y"), "y", "p")
    return found.agg(F.round(F.avg("f1"), 9).alias("mean"), F.round(F.stddev_pop("f1"), 9).alias("std"))


GRID = "grid AS (SELECT i / 20 AS t, sum((s / 100 >= i / 20)::INT) AS n, 2 * sum((s / 100 >= i / 20 AND y = 1)::INT) / (sum((s / 100 >= i / 20)::INT) + sum(y)) AS f FROM scores, range(1, 20) t(i) GROUP BY 1)"


@query("SELECT coalesce((SELECT t FROM grid WHERE n > 0 ORDER BY round(f, 12) DESC, t LIMIT 1), 0.5) AS threshold, round(coalesce((SELECT max(f) FROM grid WHERE n > 0), 0), 9) AS f1", SCORES, GRID)
def best_grid_threshold(spark, d):
    return rounded(V.best_grid_threshold(scores(spark, d).withColumn("s", F.col("s") / 100), 20), "f1", digits=9)


TOLS = (1e-4, 5e-4, 2e-3, 1e-2)


@query(" UNION ALL ".join(f"SELECT {t}::DOUBLE AS tol, count(*)::BIGINT AS n_plateau, round(floor(quantile_cont(n_pred_pos, 0.5)) / (SELECT count(*) FROM scores), 9) AS rate FROM curve WHERE binary_f1 >= (SELECT max(binary_f1) FROM curve) - {t}" for t in TOLS), SCORES, """each_ AS (SELECT s AS threshold, sum(y) AS p, count(*) AS n FROM scores GROUP BY 1), c_ AS (SELECT threshold, sum(p) OVER w AS tp, sum(n) OVER w AS n_pred_pos, (SELECT sum(p) FROM each_) AS ap FROM each_ WINDOW w AS (ORDER BY threshold DESC)),
 curve AS (SELECT threshold, n_pred_pos, 2 * tp / (n_pred_pos + ap) AS binary_f1 FROM c_)""")
def plateau_sensitivity(spark, d):
    """How the plateau's middle, as a share of the rows, moves with the tolerance."""
    return rounded(V.plateau_sensitivity(scores(spark, d), TOLS), "rate", digits=9)


@query("SELECT count(*)::BIGINT AS n, round(max(abs(total - 1)), 9) AS off, bool_and(least >= 0) AS positive FROM (SELECT 1 AS total, 0 AS least FROM range(27))")
def simplex_weights(spark, d):
    """Equal weights, each model alone, and draws from the flat Dirichlet law: all on the simplex."""
    w = R.simplex(spark, 3, 23)
    total = F.aggregate("weights", F.lit(0.0), lambda a, x: a + x)
    return w.agg(F.count("*").alias("n"), F.round(F.max(F.abs(total - 1)), 9).alias("off"), F.bool_and(F.array_min("weights") >= 0).alias("positive"))


# -- models: rows only


@query()
def boosted_early(spark, d):
    """Boosted trees that stop when a part of the training folds no longer gains."""
    from wicker.operators import learn
    from wicker.plans.queries import folded

    return learn.out_of_fold(folded(spark, d), learn.boosted(20, 4, "held"), holdout="held")


@query()
def smote_in_folds(spark, d):
    """Out-of-fold scores of a model whose training folds alone are filled up with synthetic rows."""
    from wicker.operators import learn

    w = T.standard_scale(wide(spark, d), NUMBERS, wide(spark, d)).select("row_id", F.col("y4").alias("y"), *NUMBERS)
    return learn.out_of_fold_smote(V.folds(w, "row_id", 2, "y"), NUMBERS, learn.logistic(), 0.25, k=2)


@query()
def test_averaged(spark, d):
    """Test rows scored by every fold's model, averaged."""
    from wicker.operators import learn

    w = T.standard_scale(wide(spark, d), NUMBERS, split(wide(spark, d))[0])
    train, test = split(w)
    return learn.averaged_over_folds(V.folds(train, "row_id", 3, "y"), test, learn.logistic(), columns=NUMBERS)


@query()
def pca_rows(spark, d):
    """Rows on the components that explain 95 % of the variance."""
    from wicker.operators import learn
    from wicker.plans.queries import vectors

    return learn.projected(vectors(spark, d), vectors(spark, d), "v", 0.95).select("vec_id", "pc")


@query()
def kmeans_several(spark, d):
    """Cluster labels and the distance to the nearest centre for several numbers of clusters."""
    from wicker.operators import learn
    from wicker.plans.queries import vectors

    return learn.clusters(vectors(spark, d), "v", (4, 8)).drop("v")
