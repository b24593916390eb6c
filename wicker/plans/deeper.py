"""Registered queries on columns with missing cells, exact neighbours, blends of many models, rates by fold, streams of files, seals."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from wicker.operators import encode as E, evaluate as V, profile as P, resample as R, transform as T
from wicker.plans.queries import NUMBERS, ORACLE, column_pairs, each, query, rounded, split
from wicker.plans.scoring import PRED, TYPED, pred
from wicker.sources import tables as S
from wicker.sources.tables import SCORES, WIDE, read, scores, wide

# -- correlations of columns with missing cells

HOLED = ["price", "balance", "cust", "one", "twice", "gone"]
HOLES = """holes AS (SELECT CASE WHEN row_id % 7 > 0 THEN o_totalprice END AS price, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS balance,
 CASE WHEN row_id % 11 < 5 THEN custkey END AS cust, CASE WHEN row_id % 97 = 0 THEN 1.0::DOUBLE END AS one,
 CASE WHEN row_id % 3 > 0 THEN 2 * custkey + 1 END AS twice, NULL::DOUBLE AS gone FROM wide)"""


def holes(spark, d):
    """Columns that miss cells here and there, one that holds one value, and one that holds none."""
    w, key = wide(spark, d), F.col("row_id")
    return w.select(
        F.when(key % 7 > 0, F.col("o_totalprice")).alias("price"), F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("balance"), F.when(key % 11 < 5, F.col("custkey")).alias("cust"),
        F.when(key % 97 == 0, 1.0).alias("one"), F.when(key % 3 > 0, 2 * F.col("custkey") + 1).alias("twice"), F.lit(None).cast("double").alias("gone"))


def corr_of(a: str, b: str) -> str:
    """DuckDB's corr, null where it isn't a number."""
    return f"SELECT '{a}' AS a, '{b}' AS b, CASE WHEN isfinite(r) THEN round(r, 9) END AS r FROM (SELECT corr({a}, {b}) AS r FROM holes)"


@query(" UNION ALL ".join(corr_of(a, b) for i, a in enumerate(HOLED) for b in HOLED[i + 1 :]), WIDE, HOLES)
def pearson_with_nulls(spark, d):
    """Every pair of columns over the rows where neither is missing, all pairs in one pass."""
    return rounded(P.correlations(holes(spark, d), HOLED), "r", digits=9)


@query("SELECT c AS \"column\", coalesce(min(a), c) AS \"group\" FROM (SELECT unnest(['price', 'balance', 'cust', 'twice']) AS c) LEFT JOIN (" + column_pairs("abs(corr({a}, {b})) > 0.999", ["price", "balance", "cust", "twice"], "holes") + ") ON b = c GROUP BY c", WIDE, HOLES)
def near_duplicates_with_nulls(spark, d):
    return P.near_duplicate_columns(holes(spark, d), ["price", "balance", "cust", "twice"])


# -- blends of many models

#: A third score, and what each row's scores have as average ranks over the number of rows.
RANKED = "ranked AS (SELECT y, " + ", ".join(f"(rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2) / count(*) OVER () AS {n}" for c, n in (("p", "a"), ("q", "b"), ("abs(p - q)", "c"))) + " FROM pred)"
DRAW = "-ln(1 - ('0x' || substr(md5('simplex{i}:' || d::VARCHAR), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"
DRAWN = f"""drawn AS (SELECT 0 AS candidate, 1 / 3.0::DOUBLE AS u, 1 / 3.0::DOUBLE AS v, 1 / 3.0::DOUBLE AS w UNION ALL SELECT 1, 1, 0, 0 UNION ALL SELECT 2, 0, 1, 0 UNION ALL SELECT 3, 0, 0, 1
 UNION ALL SELECT d + 4, round(x / (x + y + z), 9), round(y / (x + y + z), 9), round(z / (x + y + z), 9) FROM (SELECT d, {DRAW.format(i=0)} AS x, {DRAW.format(i=1)} AS y, {DRAW.format(i=2)} AS z FROM range(23) t(d)))"""


@query("""SELECT candidate::INT AS candidate, u, v, w, auc FROM drawn JOIN (
 SELECT candidate, round((sum(y * r) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y))), 9) AS auc FROM (
  SELECT candidate, y, rank() OVER (PARTITION BY candidate ORDER BY s) + (count(*) OVER (PARTITION BY candidate, s) - 1) / 2 AS r FROM (
   SELECT candidate, y, round(u * a + v * b + w * c, 12) AS s FROM ranked, drawn)) GROUP BY 1) USING (candidate)
 ORDER BY auc DESC, candidate LIMIT 1""", SCORES, PRED, RANKED, DRAWN)
def simplex_search(spark, d):
    """The best rank blend of three scores: equal weights, each alone and 23 draws."""
    rows = pred(spark, d).withColumn("r", F.abs(F.col("p") - F.col("q")))
    best = R.simplex_search(rows, ["p", "q", "r"], "y", R.candidates(3, 23))
    return best.select("candidate", *(F.col("weights")[i].alias(c) for i, c in enumerate("uvw")), "auc")


@query()
def simplex_search_2000(spark, d):
    """The same with 2000 draws, as many as the search is meant for."""
    rows = pred(spark, d).withColumn("r", F.abs(F.col("p") - F.col("q")))
    return R.simplex_search(rows, ["p", "q", "r"], "y", R.candidates(3, 2000))


# -- rates by fold

FOLD_CUTS = """each_ AS (SELECT id % 4 AS fold, s AS threshold, sum(y) AS p, count(*) AS n FROM scores WHERE s IS NOT NULL GROUP BY 1, 2),
 cum AS (SELECT *, sum(p) OVER w AS tp, sum(n) OVER w AS k, sum(p) OVER (PARTITION BY fold) AS pos, sum(n) OVER (PARTITION BY fold) AS rows_ FROM each_ WINDOW w AS (PARTITION BY fold ORDER BY threshold DESC)),
 area AS (SELECT fold, (sum(p * (rows_ - k + (n + 1) / 2)) - any_value(pos) * (any_value(pos) + 1) / 2) / (any_value(pos) * (any_value(rows_) - any_value(pos))) AS auc FROM cum GROUP BY 1),
 comp AS (SELECT fold, threshold, k, rows_, 0.3::DOUBLE * (2 * tp / (k + pos)) + 0.25::DOUBLE * auc + 0.15::DOUBLE * (tp / k) + 0.15::DOUBLE * (tp / pos) + 0.1::DOUBLE * (tp / pos + (rows_ - pos - k + tp) / (rows_ - pos)) / 2
  + 0.05::DOUBLE * ((rows_ - pos - k + tp) / (rows_ - pos)) AS composite FROM cum JOIN area USING (fold))"""


def by_fold(spark, d):
    return scores(spark, d).withColumn("fold", F.col("id") % 4)


@query("SELECT fold, round(k / rows_, 9) AS rate, round(composite, 6) AS composite FROM comp QUALIFY row_number() OVER (PARTITION BY fold ORDER BY round(composite, 12) DESC, k) = 1", SCORES, FOLD_CUTS)
def fold_best_rates(spark, d):
    """The best positive rate of each fold: how far the optimum moves."""
    return R.best_rate(by_fold(spark, d), "y", "s", ["fold"]).select("fold", F.round("rate", 9).alias("rate"), F.round("composite", 6).alias("composite"))


@query("SELECT fold, count(*)::BIGINT AS n_plateau, round(floor(quantile_cont(k, 0.5)) / any_value(rows_), 9) AS rate FROM comp JOIN (SELECT fold, max(composite) AS best FROM comp GROUP BY 1) USING (fold) WHERE composite >= best - 5e-4 GROUP BY fold", SCORES, FOLD_CUTS)
def fold_plateau_rates(spark, d):
    return rounded(R.plateau_rate(by_fold(spark, d), by=["fold"]), "rate", digits=9)


DELTAS = (-0.04, -0.02, -0.01, 0.0, 0.01, 0.02, 0.04)
SWEPT = f"""chosen AS (SELECT floor(quantile_cont(k, 0.5)) / any_value(rows_) AS rate FROM comp WHERE composite >= (SELECT max(composite) FROM comp) - 5e-4),
 placed AS (SELECT y, row_number() OVER (ORDER BY s DESC, id) - 1 AS pl, count(*) OVER () AS n, sum(y) OVER () AS pos FROM scores WHERE s IS NOT NULL),
 swept AS (SELECT delta::DOUBLE AS delta, rate + delta::DOUBLE AS r FROM chosen, (SELECT unnest([{', '.join(f'{x}::DOUBLE' for x in DELTAS)}]) AS delta) WHERE rate + delta > 0 AND rate + delta < 1),
 hit AS (SELECT delta, r, floor(r * n + 0.5) AS k, any_value(n) AS n, any_value(pos) AS pos, coalesce(sum(y) FILTER (pl < floor(r * n + 0.5)), 0) AS tp FROM swept, placed GROUP BY delta, r, floor(r * n + 0.5))"""


@query("""SELECT delta, round(r, 9) AS rate, k::BIGINT AS n_pred_pos, round(0.3 * (2 * tp / (k + pos)) + 0.25 * auc + 0.15 * (tp / k) + 0.15 * (tp / pos) + 0.1 * (tp / pos + (n - pos - k + tp) / (n - pos)) / 2
 + 0.05 * ((n - pos - k + tp) / (n - pos)), 6) AS composite FROM hit, area""", SCORES, FOLD_CUTS.replace("id % 4 AS fold", "0 AS fold"), SWEPT)  # fmt: skip
def rate_sweep(spark, d):
    """The composite at the plateau's rate and beside it."""
    rate = R.plateau_rate(scores(spark, d)).first().rate
    return R.rate_sweep(scores(spark, d), "y", "s", "id", rate, DELTAS).select("delta", F.round("rate", 9).alias("rate"), "n_pred_pos", F.round("composite", 6).alias("composite"))


# -- transforms


@query("SELECT row_id, " + ", ".join(f"round((rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2) / count(*) OVER (), 9) AS {c}" for c in NUMBERS) + " FROM wide", WIDE)
def rank_columns(spark, d):
    """Every number replaced by its average rank over the number of rows."""
    return rounded(T.rank_columns(wide(spark, d).select("row_id", *NUMBERS), NUMBERS), *NUMBERS, digits=9)


# -- files, streams, stored frames


@query("SELECT doc_id, quality, CASE WHEN toxic = 1 THEN 1 WHEN quality = 1 THEN 0 END::INT AS flag FROM labels")
def csv_stream_decode(spark, d):
    """A growing folder of CSV files with booleans as text, decoded as a stream to compact CSV: two runs, each row once."""
    rows = read(spark, d, "labels").select("doc_id", "quality", F.when(F.col("toxic") == 1, "yes, it is").when(F.col("quality") == 1, "no").otherwise("unknown").alias("flag"))
    folder = f"{S.shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    decode = lambda df: df.withColumn("flag", E.bool_text(F.col("flag")))
    for half in (0, 1):
        rows.where(F.col("doc_id") % 2 == half).write.mode("append").csv(f"{folder}/in", header=True, escape='"')
        S.decode_stream(spark, f"{folder}/in", "doc_id long, quality int, flag string", f"{folder}/out", decode)
    return spark.read.schema("doc_id long, quality int, flag int").csv(f"{folder}/out", header=True)


@query("SELECT row_id, coalesce(n / (SELECT count(*) FROM wide WHERE is_train = 1), 0) AS f FROM wide LEFT JOIN (SELECT cust, count(*) AS n FROM wide WHERE is_train = 1 GROUP BY 1) USING (cust) WHERE is_train = 0", WIDE)
def sealed_frequencies(spark, d):
    """Level frequencies fitted on training rows, stored with the digest of the schema they were fitted on, read back and
    applied to test rows after the digests have been compared."""
    train, test = split(wide(spark, d))
    path = f"{S.shared_folder(spark)}/sealed-{uuid.uuid4().hex}"
    total = train.agg(F.count("*").alias("all"))
    fitted = train.groupBy("cust").agg(F.count("*").alias("n")).crossJoin(F.broadcast(total)).select("cust", (F.col("n") / F.col("all")).alias("f"))
    S.sealed(fitted, train).write.parquet(path)
    fitted = spark.read.parquet(path)
    S.check_seal(fitted, test)
    return test.select("row_id", "cust").join(fitted, "cust", "left").select("row_id", F.coalesce("f", F.lit(0.0)).alias("f"))


@query("SELECT unnest(['target_present', 'key_present', 'key_first', 'key_last', 'same_order']) AS \"check\", unnest([list_contains(names, 'y'), list_contains(names, 'row_id'), names[1] = 'row_id', names[-1] = 'row_id', true]) AS ok FROM (SELECT list(name) AS names FROM typed)", WIDE, TYPED)
def schema_checks(spark, d):
    """Whether target and key are there, where the key stands, and whether both sides have the same columns in order."""
    return S.schema_checks(*split(wide(spark, d)), "y", "row_id")


@query()
def kmeans_minibatch(spark, d):
    """Cluster labels from centres that batches of rows have moved."""
    from wicker.operators import learn
    from wicker.plans.queries import vectors

    v = vectors(spark, d)
    return learn.labelled(v, "v", learn.minibatch_centres(v, "v", "vec_id", 8)).drop("v")


@query()
def soft_f1_boosted(spark, d):
    """Test rows' scores by trees that were fitted on training rows to raise soft F1."""
    from wicker.operators import boost

    train, test = split(wide(spark, d))
    model = boost.fit(train, NUMBERS, "y", boost.SOFT_F1, rounds=6)
    return boost.scored(test, model, "row_id")
