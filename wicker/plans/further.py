"""Registered queries on row statistics, resampling, thresholds, rankings of columns, blends and stored models."""

from __future__ import annotations

from pyspark.sql import functions as F

from wicker.operators import encode as E, evaluate as V, profile as P, resample as R, transform as T
from wicker.plans.queries import AUC, COPIES, CURVE, EQUAL, NUMBERS, OOF, ORACLE, RANK, RAW, column_pairs, each, folded, query, rounded, split
from wicker.plans.scoring import F1, PRED, pred
from wicker.sources.tables import SCORES, WIDE, read, scores, wide

#: Embeddings with zeros and missing cells: one row for each cell in SQL, one array for each row here.
CELLS = "cells AS (SELECT vec_id, CASE WHEN abs(x) < 0.02 THEN 0 WHEN x > 0.25 THEN NULL ELSE x END AS x FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS x FROM embeddings))"
MOMENTS = "mom AS (SELECT vec_id, avg(x) AS m, stddev_pop(x) AS s FROM cells GROUP BY 1), c AS (SELECT * FROM cells JOIN mom USING (vec_id))"
SKEW, KURT = "round(avg((x - m) ** 3) / any_value(s) ** 3, 5)", "round(kurtosis_pop(x), 5)"


def cells(spark, d):
    x = F.transform(F.col("embedding").cast("array<double>"), lambda v: F.when(F.abs(v) < 0.02, 0.0).when(v > 0.25, F.lit(None)).otherwise(v))
    return read(spark, d, "embeddings").select("vec_id", x.alias("v"))


def count_of(condition) -> F.Column:
    return F.size(F.filter("v", condition)).cast("long")


def valid():
    return F.filter("v", lambda x: x.isNotNull())


# -- rows


@query("SELECT vec_id, sum((x <> 0)::INT)::BIGINT AS n_nonzero, sum((x = 0)::INT)::BIGINT AS n_zero, sum((x IS NULL)::INT)::BIGINT AS n_missing, sum((x < 0)::INT)::BIGINT AS n_negative, round(sum(x), 6) AS row_sum, round(avg(x) FILTER (x <> 0), 6) AS mean_nonzero, round(stddev(x), 6) AS row_std, max(x) AS row_max, min(x) AS row_min FROM cells GROUP BY 1", CELLS)
def row_aggregates(spark, d):
    s = T.row_stats(cells(spark, d), "v")
    nonzero = count_of(lambda x: x != 0)
    total = T.row_sum(valid())
    return s.select("vec_id", nonzero.alias("n_nonzero"), "n_zero", count_of(lambda x: x.isNull()).alias("n_missing"), "n_negative", F.round(total, 6).alias("row_sum"), F.round(total / F.nullif(nonzero, F.lit(0)), 6).alias("mean_nonzero"), F.round("row_std1", 6).alias("row_std"), "row_max", "row_min")


@query(f"SELECT vec_id, round(avg(x), 6) AS row_mean, round(stddev_pop(x), 6) AS row_std, round(quantile_cont(x, 0.75) - quantile_cont(x, 0.25), 6) AS row_iqr, sum((x = 0)::INT)::BIGINT AS n_zero, {SKEW} AS row_skew, {KURT} AS row_kurt FROM c GROUP BY 1", CELLS, MOMENTS)
def row_stats6(spark, d):
    s = T.row_stats(cells(spark, d), "v")
    return s.select("vec_id", F.round("row_mean", 6).alias("row_mean"), F.round("row_std0", 6).alias("row_std"), F.round(F.col("row_q75") - F.col("row_q25"), 6).alias("row_iqr"), "n_zero", F.round("row_skew", 5).alias("row_skew"), F.round("row_kurt", 5).alias("row_kurt"))


QS = (5, 10, 25, 75, 90, 95)


@query(f"""SELECT vec_id, round(avg(x), 6) AS row_mean, round(stddev_pop(x), 6) AS row_std, min(x) AS row_min, max(x) AS row_max, round(quantile_cont(x, 0.5), 6) AS row_median, round(max(x) - min(x), 6) AS row_range, sum((x = 0)::INT)::BIGINT AS n_zero, sum((x > 0)::INT)::BIGINT AS n_positive,
 sum((x < 0)::INT)::BIGINT AS n_negative, {SKEW} AS row_skew, {KURT} AS row_kurt, {', '.join(f'round(quantile_cont(x, {q / 100}), 6) AS q{q:02}' for q in QS)}, round(quantile_cont(x, 0.75) - quantile_cont(x, 0.25), 6) AS row_iqr, round(stddev_pop(x) / (abs(avg(x)) + 0.01), 5) AS row_cv, round((max(x) - min(x)) / (stddev_pop(x) + 0.01), 5) AS range_ratio FROM c GROUP BY 1""", CELLS, MOMENTS)
def row_stats_full(spark, d):
    s = T.row_stats(cells(spark, d), "v").withColumn("o", F.array_sort(valid()))
    span = F.col("row_max") - F.col("row_min")
    r = lambda c, name, k=6: F.round(c, k).alias(name)
    return s.select(
        "vec_id", r("row_mean", "row_mean"), r("row_std0", "row_std"), "row_min", "row_max", r("row_median", "row_median"), r(span, "row_range"), "n_zero", count_of(lambda x: x > 0).alias("n_positive"), "n_negative",
        r("row_skew", "row_skew", 5), r("row_kurt", "row_kurt", 5), *(r(T.row_quantile(F.col("o"), q / 100), f"q{q:02}") for q in QS), r(F.col("row_q75") - F.col("row_q25"), "row_iqr"),
        r(F.col("row_std0") / (F.abs("row_mean") + 0.01), "row_cv", 5), r(span / (F.col("row_std0") + 0.01), "range_ratio", 5))


@query("SELECT vec_id, round(quantile_cont(x, 0.5), 6) AS row_median, round(mad(x), 6) AS row_mad FROM cells GROUP BY 1", CELLS)
def row_mad(spark, d):
    return T.row_stats(cells(spark, d), "v").select("vec_id", F.round("row_median", 6).alias("row_median"), F.round("row_mad", 6).alias("row_mad"))


@query(f"SELECT vec_id, count(*)::BIGINT AS n_valid, round(avg(x), 6) AS row_mean, round(stddev_pop(x), 6) AS row_std, round(sum(x), 6) AS row_sum, {SKEW} AS row_skew, {KURT} AS row_kurt FROM c GROUP BY 1", CELLS.replace("cells AS", "every AS"), "cells AS (SELECT * FROM every WHERE x <> 0)", MOMENTS)
def row_valid_moments(spark, d):
    s = T.row_stats(cells(spark, d).withColumn("v", F.filter("v", lambda x: x != 0)), "v")
    zero = lambda c, k: F.coalesce(F.round(c, k), F.lit(0.0))
    return s.select("vec_id", "n_valid", zero("row_mean", 6).alias("row_mean"), zero("row_std0", 6).alias("row_std"), F.round(T.row_sum(F.col("v")), 6).alias("row_sum"), zero("row_skew", 5).alias("row_skew"), zero("row_kurt", 5).alias("row_kurt"))


@query("SELECT row_id, ((sent = 0)::INT + (sparse = 0)::INT + (c_nationkey = 0)::INT)::BIGINT AS n_zero, ((sent = -999999)::INT + (sparse = -999999)::INT + (c_nationkey = -999999)::INT)::BIGINT AS n_sentinel FROM wide", WIDE)
def row_zero_sentinel(spark, d):
    w = wide(spark, d).select("row_id", F.array("sent", "sparse", "c_nationkey").alias("v"))
    return w.select("row_id", count_of(lambda x: x == 0).alias("n_zero"), count_of(lambda x: x == -999999).alias("n_sentinel"))


@query("SELECT vec_id, sum((x = 0)::INT)::BIGINT AS n_zero, sum((x <> 0)::INT)::BIGINT AS n_nonzero, sum((x < 0)::INT)::BIGINT AS n_negative, round(sum(x), 6) AS row_sum, round(avg(x), 6) AS row_mean, round(stddev(x), 6) AS row_std, max(x) AS row_max, round(skewness(x), 5) AS row_skew FROM cells GROUP BY 1", CELLS)
def row_aggregates_old(spark, d):
    s = T.row_stats(cells(spark, d), "v")
    n = F.col("n_valid")
    unbiased = F.col("row_skew") * F.sqrt(n * (n - 1)) / (n - 2)
    return s.select("vec_id", "n_zero", count_of(lambda x: x != 0).alias("n_nonzero"), "n_negative", F.round(T.row_sum(valid()), 6).alias("row_sum"), F.round("row_mean", 6).alias("row_mean"), F.round("row_std1", 6).alias("row_std"), "row_max", F.round(unbiased, 5).alias("row_skew"))


@query("SELECT vec_id, " + ", ".join(f"sum((x <> 0)::INT) FILTER ({w})::BIGINT AS {g}_nonzero, round(sum(x) FILTER ({w}), 6) AS {g}_sum, round(avg(x) FILTER ({w}), 6) AS {g}_mean, max(x) FILTER ({w}) AS {g}_max" for g, w in (("head", "i <= 32"), ("tail", "i > 32"))) + " FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY 1")
def row_group_aggregates(spark, d):
    v = read(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    out = []
    for g, part in (("head", F.slice("v", 1, 32)), ("tail", F.expr("slice(v, 33, greatest(size(v) - 32, 0))"))):
        total = T.row_sum(part)
        out += [F.size(F.filter(part, lambda x: x != 0)).cast("long").alias(f"{g}_nonzero"), F.round(total, 6).alias(f"{g}_sum"), F.round(total / F.size(part), 6).alias(f"{g}_mean"), F.array_max(part).alias(f"{g}_max")]
    return v.select("vec_id", *out)


# -- columns


@query("SELECT row_id, a.o_totalprice, b.c_acctbal FROM wide a JOIN wide b USING (row_id)", WIDE)
def assemble_blocks(spark, d):
    w = wide(spark, d)
    return w.select("row_id", "o_totalprice").join(w.select("row_id", "c_acctbal"), "row_id")


@query("SELECT row_id, round(c_nationkey)::INT::VARCHAR AS code FROM wide", WIDE)
def code_to_string(spark, d):
    return wide(spark, d).select("row_id", F.round("c_nationkey").cast("int").cast("string").alias("code"))


@query("SELECT row_id, nullif(sent, -999999) AS v FROM wide", WIDE)
def sentinel_to_null(spark, d):
    return wide(spark, d).select("row_id", F.nullif("sent", F.lit(-999999.0)).alias("v"))


# Codes that commonly stand for a missing value.
CODES = [-1, 99, 999, 9999, 99999, 999999, 9999999999, -99, -999, -9999, -99999, -999999]


@query("SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {s}::DOUBLE AS sentinel, sum(({c} = {s})::INT)::BIGINT AS n FROM wide" for c in RAW for s in CODES) + ") WHERE n > 0", WIDE)
def sentinel_candidates(spark, d):
    return P.sentinel_scan(wide(spark, d), RAW, CODES)


@query(f"SELECT round(v, 2) AS v, count(*)::BIGINT AS n FROM ({ORACLE['ghost_values']}) GROUP BY 1")
def ghost_recurrence(spark, d):
    return P.ghost_values(wide(spark, d), RAW).groupBy(F.round("v", 2).alias("v")).agg(F.count("*").alias("n"))


BOTH = ["a_price", "c_acctbal", "dup", "sent"]
SIDES = "copies AS (SELECT *, sent FROM (SELECT row_id, is_train, o_totalprice AS a_price, o_totalprice AS dup, c_acctbal, sent FROM wide)), one AS (SELECT * FROM copies WHERE is_train = 1), two AS (SELECT * FROM copies WHERE is_train = 0)"


@query(f"SELECT min(a) AS kept, b AS dropped FROM (SELECT * FROM ({column_pairs(EQUAL, BOTH, 'one')}) INTERSECT SELECT * FROM ({column_pairs(EQUAL, BOTH, 'two')})) GROUP BY b", WIDE, SIDES)
def duplicate_columns_both(spark, d):
    w = wide(spark, d).select("row_id", "is_train", F.col("o_totalprice").alias("a_price"), F.col("o_totalprice").alias("dup"), "c_acctbal", "sent")
    one, two = (P.duplicate_columns(part, ["a_price", "dup", "c_acctbal", "sent"], "row_id") for part in split(w))
    return one.intersect(two)


@query("SELECT DISTINCT \"column\" FROM (" + each("SELECT '{c}' AS \"column\" FROM copies HAVING min({c}) = max({c})", ["a_price", "c_acctbal", "const", "dup"]) + f" UNION ALL SELECT b FROM ({column_pairs(EQUAL, ['a_price', 'c_acctbal', 'const', 'dup'])}))", WIDE, COPIES)
def droppable_columns(spark, d):
    w = wide(spark, d).select("row_id", F.col("o_totalprice").alias("a_price"), F.col("o_totalprice").alias("dup"), "c_acctbal", F.lit(1.0).alias("const"))
    names = w.columns[1:]
    constant = P.per_column(w, names, constant=lambda c: F.min(c) == F.max(c)).where("constant").select("column")
    return constant.union(P.duplicate_columns(w, names, "row_id").select("dropped")).distinct()


PLAIN = "folded AS (SELECT *, ((row_number() OVER (ORDER BY md5(row_id::VARCHAR), row_id) - 1) % 5)::INT AS fold FROM wide)"


@query(OOF.format(s=50, prior="st / nt"), WIDE, PLAIN)
def target_encode_kfold(spark, d):
    w = V.folds(wide(spark, d), "row_id", 5)
    return rounded(E.target_encode_oof(w, "cust", "y", "fold", 50).select("row_id", "te"), "te", digits=9)


LONG = f"long AS ({each('SELECT $${c}$$ AS col, row_id, y, is_train, {c} AS v FROM wide', NUMBERS)})"


@query("SELECT row_id, round(max(v) * min(v), 4) AS v FROM long WHERE col IN (SELECT col FROM long GROUP BY 1 ORDER BY var_samp(v) DESC, col LIMIT 2) GROUP BY 1", WIDE, LONG)
def products_top_variance(spark, d):
    w = wide(spark, d)
    spread = P.per_column(w, NUMBERS, v=F.var_samp).collect()
    a, b = (r["column"] for r in sorted(spread, key=lambda r: (-r["v"], r["column"]))[:2])
    return w.select("row_id", F.round(F.col(a) * F.col(b), 4).alias("v"))


@query("SELECT row_id, round(o_totalprice / (c_nationkey + 1e-6), 2) AS per_nation, round(o_totalprice - c_acctbal, 4) AS deficit, round(c_acctbal / (abs(o_totalprice) + 1e-6), 6) AS debt, round(o_totalprice * c_nationkey, 4) AS scaled FROM wide", WIDE)
def domain_ratios(spark, d):
    o, a, n = F.col("o_totalprice"), F.col("c_acctbal"), F.col("c_nationkey")
    return wide(spark, d).select("row_id", F.round(o / (n + 1e-6), 2).alias("per_nation"), F.round(o - a, 4).alias("deficit"), F.round(a / (F.abs(o) + 1e-6), 6).alias("debt"), F.round(o * n, 4).alias("scaled"))


@query("SELECT doc_id, (quality - toxic)::INT AS net, (quality = 0 AND toxic = 0)::INT AS neither FROM labels")
def net_flags(spark, d):
    return read(spark, d, "labels").select("doc_id", (F.col("quality") - F.col("toxic")).cast("int").alias("net"), ((F.col("quality") == 0) & (F.col("toxic") == 0)).cast("int").alias("neither"))


@query("SELECT doc_id, ((quality = 0)::INT + (toxic = 1)::INT)::INT AS risks FROM labels")
def risk_flag_count(spark, d):
    return read(spark, d, "labels").select("doc_id", ((F.col("quality") == 0).cast("int") + (F.col("toxic") == 1).cast("int")).alias("risks"))


# -- rankings of columns

DRIFT = "imp AS (SELECT col, abs(avg(v) FILTER (is_train = 1) - avg(v) FILTER (is_train = 0)) / stddev_pop(v) AS importance FROM long GROUP BY 1)"
TOP = "SELECT col AS \"column\", round(importance, 9) AS importance, round(sum(importance) OVER () / (SELECT sum(importance) FROM imp), 9) AS covered FROM (SELECT * FROM imp ORDER BY importance DESC, col LIMIT {k})"


def drift(spark, d):
    of = lambda c, k: F.avg(F.when(F.col("is_train") == k, c))
    return P.per_column(wide(spark, d), NUMBERS, importance=lambda c: F.abs(of(c, 1) - of(c, 0)) / F.stddev_pop(c))


@query(TOP.format(k=3), WIDE, LONG, DRIFT)
def drift_drop(spark, d):
    return rounded(R.drop_top(drift(spark, d), 3), "importance", "covered", digits=9)


@query(TOP.format(k="(SELECT greatest(1, count(*) * 25 // 100) FROM imp)"), WIDE, LONG, DRIFT)
def drift_drop_pct(spark, d):
    return rounded(R.drop_top(drift(spark, d), max(1, len(NUMBERS) * 25 // 100)), "importance", "covered", digits=9)


@query("SELECT col AS \"column\", round(abs(corr(v, y)), 9) AS importance FROM long GROUP BY 1 ORDER BY abs(corr(v, y)) DESC, col LIMIT 2", WIDE, LONG)
def topk_importance(spark, d):
    found = P.per_column(wide(spark, d), NUMBERS, importance=lambda c: F.abs(F.corr(c, "y")))
    return rounded(R.drop_top(found, 2).drop("covered"), "importance", digits=9)


@query("SELECT col AS \"column\", round(share, 9) AS share, round(cum, 9) AS cumulative, cum - share < 0.95 AS kept FROM (SELECT *, sum(share) OVER (ORDER BY share DESC, col) AS cum FROM (SELECT col, var_samp(v) / sum(var_samp(v)) OVER () AS share FROM long GROUP BY 1))", WIDE, LONG)
def cum_variance(spark, d):
    rows = sorted(((r["column"], r["v"]) for r in P.per_column(wide(spark, d), NUMBERS, v=F.var_samp).collect()), key=lambda r: (-r[1], r[0]))
    total, cum, out = sum(v for _, v in rows), 0.0, []
    for name, v in rows:  # one entry for each column
        cum += v / total
        out.append((name, round(v / total, 9), round(cum, 9), cum - v / total < 0.95))
    return spark.createDataFrame(out, "column string, share double, cumulative double, kept boolean")


# -- resampling


def uni(prefix: str, key: str) -> str:
    return f"(('0x' || substr(md5('{prefix}' || {key}::VARCHAR), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


@query(f"SELECT row_id, CASE WHEN sparse = 0 THEN 0 ELSE round(sparse * (1 + 0.03 * (sqrt(-2 * ln(1 - {uni('a', 'row_id')})) * cos(2 * pi() * {uni('b', 'row_id')}))), 4) END AS v FROM wide", WIDE)
def jitter(spark, d):
    return wide(spark, d).select("row_id", F.round(R.jitter(F.col("sparse"), F.col("row_id"), 0.03), 4).alias("v"))


@query(f"SELECT draw, a.o_totalprice, b.c_acctbal FROM (SELECT draw, floor({uni('o_totalprice', 'draw')} * n) AS ka, floor({uni('c_acctbal', 'draw')} * n) AS kb FROM (SELECT row_number() OVER () - 1 AS draw, count(*) OVER () AS n FROM pos)) JOIN pos a ON a.k = ka JOIN pos b ON b.k = kb", WIDE, "pos AS (SELECT *, row_number() OVER (ORDER BY row_id) - 1 AS k FROM wide WHERE y4 = 1)")
def class_shuffle(spark, d):
    return R.class_shuffle(wide(spark, d).where("y4 = 1"), ["o_totalprice", "c_acctbal"], "row_id")


STEPS = [("pos", i, round(0.995 - 0.05 * i, 4)) for i in range(8)] + [("neg", i, round(0.005 + 0.05 * i, 4)) for i in range(8)]


@query(f"SELECT side, threshold, n FROM (SELECT *, row_number() OVER (PARTITION BY side ORDER BY n < 20, CASE WHEN n >= 20 THEN i ELSE -i END) AS k FROM (SELECT side, i, threshold, sum(CASE WHEN side = 'pos' THEN p > threshold ELSE p < threshold END::INT)::BIGINT AS n FROM pred, (VALUES {', '.join(f'({s!r}, {i}, {t}::DOUBLE)' for s, i, t in STEPS)}) t(side, i, threshold) GROUP BY 1, 2, 3)) WHERE k = 1", SCORES, PRED)
def pseudo_thresholds(spark, d):
    return R.relaxed_thresholds(pred(spark, d), "p", 0.995, 0.005, 0.05, 0.1, 20)


@query("SELECT id AS source_row, round(p, 12) AS stage1_prob, (p > 0.9 OR p < 0.05) AS accepted, CASE WHEN p > 0.9 THEN 1 WHEN p < 0.05 THEN 0 ELSE -1 END AS pseudo_label FROM pred", SCORES, PRED)
def synthetic_export(spark, d):
    p = F.col("p")
    return pred(spark, d).select(F.col("id").alias("source_row"), F.round(p, 12).alias("stage1_prob"), ((p > 0.9) | (p < 0.05)).alias("accepted"), F.when(p > 0.9, 1).when(p < 0.05, 0).otherwise(-1).alias("pseudo_label"))


# -- thresholds and blends

AREA = f"area AS (SELECT {AUC.replace('round(', '(').replace(', 9) AS', ') AS')} FROM (SELECT y, {RANK.format(p='', q='', s='s')} FROM scores))"
COMPOSITE = "comp AS (SELECT threshold, n_pred_pos, 0.3::DOUBLE * binary_f1 + 0.25::DOUBLE * auc + 0.15::DOUBLE * (tp / n_pred_pos) + 0.15::DOUBLE * (tp / (tp + fn)) + 0.1::DOUBLE * (tp / (tp + fn) + tn / (tn + fp)) / 2 + 0.05::DOUBLE * (tn / (tn + fp)) AS composite FROM curve, area)"


@query("SELECT threshold, n_pred_pos, round(composite, 6) AS composite FROM comp", SCORES, CURVE, AREA, COMPOSITE)
def composite_curve(spark, d):
    return rounded(R.composite(scores(spark, d)), "composite")


@query("SELECT count(*)::BIGINT AS n_plateau, round(floor(quantile_cont(n_pred_pos, 0.5)) / (SELECT count(*) FROM scores), 9) AS rate FROM comp WHERE composite >= (SELECT max(composite) FROM comp) - 5e-4", SCORES, CURVE, AREA, COMPOSITE)
def plateau_rate(spark, d):
    return rounded(R.plateau_rate(scores(spark, d)), "rate", digits=9)


HELD = "held AS (SELECT * FROM pred ORDER BY q DESC, id LIMIT (SELECT greatest(200, (count(*) * 15) // 100) FROM pred))"


def f1_of(c: str):
    return F.round(2 * F.count_if((F.col(c) >= 0.5) & (F.col("y") == 1)) / (F.count_if(F.col(c) >= 0.5) + F.sum("y")), 9)


@query("SELECT count(*)::BIGINT AS n, round(2 * sum((p >= 0.5 AND y = 1)::INT) / (sum((p >= 0.5)::INT) + sum(y)), 9) AS f1 FROM held", SCORES, PRED, HELD)
def holdout_f1(spark, d):
    return V.top_fraction(pred(spark, d), "q", "id", 0.15, 200).agg(F.count("*").alias("n"), f1_of("p").alias("f1"))


@query("SELECT id FROM held JOIN (SELECT id FROM pred WHERE p >= 0.5) USING (id)", SCORES, PRED, HELD)
def holdout_in_scored(spark, d):
    df = pred(spark, d)
    return V.top_fraction(df, "q", "id", 0.15, 200).select("id").join(df.where("p >= 0.5").select("id"), "id")


@query("""SELECT model, threshold, round(f, 9) AS f1 FROM (SELECT *, 2 * tp / (n + (SELECT sum(y) FROM pred)) AS f FROM (SELECT model, s AS threshold, sum(tp_) OVER w AS tp, sum(n_) OVER w AS n FROM (SELECT model, s, sum(y) AS tp_, count(*) AS n_ FROM
 (SELECT 'p' AS model, y, p AS s FROM pred UNION ALL SELECT 'q', y, q FROM pred UNION ALL SELECT 'mean', y, (p + q) / 2 FROM pred) GROUP BY 1, 2) WINDOW w AS (PARTITION BY model ORDER BY s DESC))) ORDER BY round(f, 12) DESC, model, threshold LIMIT 1""", SCORES, PRED)
def best_ensemble(spark, d):
    df = pred(spark, d).withColumn("mean", (F.col("p") + F.col("q")) / 2)
    found = [V.best_threshold(df, "y", m).select(F.lit(m).alias("model"), "threshold", "f1") for m in ("p", "q", "mean")]
    best = found[0].unionByName(found[1]).unionByName(found[2]).orderBy(F.desc("f1"), "model").limit(1)
    return rounded(best, "f1", digits=9)


@query(f"SELECT CASE WHEN two > one THEN 'stage2' ELSE 'stage1' END AS chosen, round(greatest(one, two), 9) AS f1 FROM (SELECT {F1.format(c='p')} AS one, {F1.format(c='q')} AS two)", SCORES, PRED)
def select_stage(spark, d):
    f = pred(spark, d).agg(f1_of("p").alias("one"), f1_of("q").alias("two"))
    return f.select(F.when(F.col("two") > F.col("one"), "stage2").otherwise("stage1").alias("chosen"), F.greatest("one", "two").alias("f1"))


GAP = "SELECT abs(({a}) - 0.5) AS g".format
AUC_OF = lambda c: f"SELECT {AUC.removesuffix(' AS auc')} FROM (SELECT y, {RANK.format(p='', q='', s=c)} FROM pred)"


@query(f"SELECT round(a.g, 9) AS base, round(b.g, 9) AS final, b.g < a.g AS closed FROM ({GAP(a=AUC_OF('p'))}) a, ({GAP(a=AUC_OF('q'))}) b", SCORES, PRED)
def gap_closed(spark, d):
    df = pred(spark, d)
    gap = lambda c, name: V.auc(df, "y", c).select(F.round(F.abs(F.round("auc", 9) - 0.5), 9).alias(name))
    return gap("p", "base").crossJoin(F.broadcast(gap("q", "final"))).withColumn("closed", F.col("final") < F.col("base"))


NORM = "(rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2) / count(*) OVER ()"
TRIES = ["0.5::DOUBLE", "1::DOUBLE", "0::DOUBLE", *(uni("w", str(i)) for i in range(8))]


@query(f"SELECT candidate::INT AS candidate, round(weight, 9) AS weight, auc FROM (SELECT candidate, weight, {AUC} FROM (SELECT candidate, weight, y, {RANK.format(p='PARTITION BY candidate', q='candidate,', s='s')} FROM (SELECT candidate, weight, y, round(weight * a + (1 - weight) * b, 12) AS s FROM (SELECT y, {NORM.format(c='p')} AS a, {NORM.format(c='q')} AS b FROM pred), (VALUES {', '.join(f'({i}, {t})' for i, t in enumerate(TRIES))}) t(candidate, weight))) GROUP BY 1, 2) ORDER BY auc DESC, candidate LIMIT 1", SCORES, PRED)
def blend_search(spark, d):
    return R.blend_search(pred(spark, d), "p", "q", "y", 8)


@query("SELECT to_json(struct_pack(n := count(*), pos := sum(y)::BIGINT, train := sum(is_train)::BIGINT))::VARCHAR AS summary FROM wide", WIDE)
def run_summary(spark, d):
    return wide(spark, d).agg(F.to_json(F.struct(F.count("*").alias("n"), F.sum("y").alias("pos"), F.sum("is_train").alias("train"))).alias("summary"))


# -- models: rows only


@query()
def oof_scores(spark, d):
    from wicker.operators import learn

    scored = learn.out_of_fold(folded(spark, d), learn.logistic())
    return V.auc(scored, "y", "p", ["fold"])


@query()
def tree_oof(spark, d):
    from wicker.operators.deep_tree import tree_out_of_fold

    return tree_out_of_fold(folded(spark, d), NUMBERS)


@query()
def elastic_oof(spark, d):
    from wicker.operators import learn

    return learn.out_of_fold(folded(spark, d), learn.logistic(elasticNetParam=0.5))


@query()
def ridge_calibrated(spark, d):
    from wicker.operators import learn

    return learn.out_of_fold(folded(spark, d), learn.ridge())


#: All pairs of the rarer class, and of each row the five nearest.
NEAREST = "SELECT a.row_id AS source, b.row_id AS neighbour, row_number() OVER (PARTITION BY a.row_id ORDER BY gap, b.row_id)::INT AS k, round(gap, 6) AS gap FROM (SELECT * FROM wide WHERE y4 = 1) a JOIN (SELECT * FROM wide WHERE y4 = 1) b ON a.row_id <> b.row_id, LATERAL (SELECT (a.o_totalprice - b.o_totalprice) * (a.o_totalprice - b.o_totalprice) + (a.c_acctbal - b.c_acctbal) * (a.c_acctbal - b.c_acctbal) AS gap) QUALIFY k <= 5"


@query(NEAREST, WIDE)
def knn_minority(spark, d):
    from wicker.operators import learn

    return learn.neighbours(wide(spark, d).where("y4 = 1"), ["o_totalprice", "c_acctbal"], "row_id").select("source", "neighbour", "k", F.round("gap", 6).alias("gap"))


@query()
def nn_category(spark, d):
    from wicker.operators import learn

    columns = ["o_totalprice", "c_acctbal"]
    made = learn.smote(wide(spark, d), columns, "y4", "row_id", 0.25)
    return learn.nearest_category(made.select(F.concat_ws(":", "source", "copy").alias("made"), *columns), wide(spark, d).where("y4 = 1"), columns, "made", "row_id", "c_mktsegment")


@query()
def arm_search(spark, d):
    from wicker.operators import learn

    w = T.standard_scale(wide(spark, d), NUMBERS, wide(spark, d)).select("row_id", "y", *NUMBERS)
    return learn.arm_search(V.folds(w, "row_id", 3, "y"), {"all": NUMBERS, "price": NUMBERS[:1], "money": NUMBERS[:2]}, (1.0, 2.0))


@query()
def model_bundle(spark, d):
    """Models of the training rows, stored with what prepares their columns, read back and put to the test rows."""
    from wicker.operators import learn

    train, test = split(wide(spark, d))
    path = learn.store_bundle(train.select("y", *NUMBERS), NUMBERS, [learn.logistic(), learn.forest(10, 4)])
    return learn.serve_bundle(spark, path, test.select("row_id", *NUMBERS))
