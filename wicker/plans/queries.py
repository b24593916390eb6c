"""Registered queries of the tabular operators, each beside the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from wicker.operators import encode as E, evaluate as V, profile as P, transform as T
from wicker.operators.order import dealt, quantiles
from wicker.sources.tables import SCORES, WIDE, read, scores, wide

QUERIES, ORACLE = {}, {}
NUMBERS = ["o_totalprice", "c_acctbal", "c_nationkey", "custkey"]
RAW = ["c_acctbal", "custkey", "o_totalprice", "sent", "sparse"]


def query(sql: str | None = None, *ctes: str):
    """Register a function of (spark, folder) under its name, with its SQL and the frames that the SQL begins with."""
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = ("WITH " + ", ".join(ctes) + " " if ctes else "") + sql
        return f

    return add


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def split(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    return df.where("is_train = 1"), df.where("is_train = 0")


# -- projection, filters, nulls


@query("SELECT l_returnflag, sum(l_quantity) AS qty FROM lineitem GROUP BY 1")
def scan_pruned(spark, d):
    return read(spark, d, "lineitem").select("l_returnflag", "l_quantity").groupBy("l_returnflag").agg(F.sum("l_quantity").alias("qty"))


@query("SELECT row_id, c_mktsegment FROM wide WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')", WIDE)
def filter_in(spark, d):
    return wide(spark, d).where(F.col("c_mktsegment").isin("BUILDING", "MACHINERY")).select("row_id", "c_mktsegment")


@query("SELECT row_id, o_totalprice, y FROM wide", WIDE)
def drop_cols(spark, d):
    return wide(spark, d).drop("c_acctbal", "c_nationkey", "custkey", "cust", "o_orderpriority", "c_mktsegment", "y4", "is_train", "sent", "sparse", "absent")


@query("SELECT event_id, try_cast(CASE WHEN event_id % 7 = 0 THEN 'n/a' ELSE value::VARCHAR END AS DOUBLE) AS v FROM events")
def coerce_numeric(spark, d):
    text = F.when(F.col("event_id") % 7 == 0, "n/a").otherwise(F.col("value").cast("string"))
    return read(spark, d, "events").select("event_id", text.try_cast("double").alias("v"))


@query("SELECT row_id, coalesce(nullif(sent, -999999), 0) AS v FROM wide", WIDE)
def fill_zero(spark, d):
    return wide(spark, d).select("row_id", F.nullif("sent", F.lit(-999999.0)).alias("v")).fillna(0.0)


@query("SELECT row_id, round(coalesce(nullif(sent, -999999), (SELECT quantile_cont(nullif(sent, -999999), 0.5) FROM wide WHERE is_train = 1)), 6) AS v FROM wide", WIDE)
def fill_median(spark, d):
    w = wide(spark, d).withColumn("v", F.nullif("sent", F.lit(-999999.0)))
    m = quantiles(split(w)[0], {"v": [0.5]})["v"][0]
    return w.select("row_id", F.round(F.coalesce("v", F.lit(m).cast("double")), 6).alias("v"))


@query("SELECT row_id, CASE WHEN sparse = 0 THEN NULL ELSE round(o_totalprice / sparse, 6) END AS v FROM wide", WIDE)
def inf_to_null(spark, d):
    return wide(spark, d).select("row_id", F.round(F.try_divide("o_totalprice", "sparse"), 6).alias("v"))


@query("SELECT row_id, coalesce(nullif(c_mktsegment, 'BUILDING'), 'MISSING') AS v FROM wide", WIDE)
def fill_category(spark, d):
    return wide(spark, d).select("row_id", F.coalesce(F.nullif("c_mktsegment", F.lit("BUILDING")), F.lit("MISSING")).alias("v"))


@query("SELECT row_id FROM wide ORDER BY md5(row_id::VARCHAR), row_id LIMIT 500", WIDE)
def smoke_sample(spark, d):
    return wide(spark, d).select("row_id").orderBy(F.md5(F.col("row_id").cast("string").cast("binary")), "row_id").limit(500)


@query("SELECT id, greatest(least(s / 100, 0.999), 0.001) AS p FROM scores", SCORES)
def clip_proba(spark, d):
    return scores(spark, d).select("id", F.greatest(F.least(F.col("s") / 100, F.lit(0.999)), F.lit(0.001)).alias("p"))


@query("SELECT id, (s >= 50)::INT AS label FROM scores", SCORES)
def binarize(spark, d):
    return scores(spark, d).select("id", (F.col("s") >= 50).cast("int").alias("label"))


# -- profiles


@query("SELECT count(*)::BIGINT AS n, sum(y)::BIGINT AS pos, round(avg(y), 9) AS rate FROM wide", WIDE)
def target_balance(spark, d):
    return wide(spark, d).agg(F.count("*").alias("n"), F.sum("y").alias("pos"), F.round(F.avg("y"), 9).alias("rate"))


@query("SELECT sum((nullif(sent, -999999) IS NULL)::INT + (nullif(sparse, 0) IS NULL)::INT + (nullif(c_nationkey, 3) IS NULL)::INT + (c_mktsegment IS NULL)::INT)::BIGINT AS missing FROM wide", WIDE)
def missing_cells(spark, d):
    null = {"sent": -999999.0, "sparse": 0.0, "c_nationkey": 3.0}
    return P.missing_cells(wide(spark, d).withColumns({c: F.nullif(c, F.lit(v)) for c, v in null.items()}), [*null, "c_mktsegment"])


def each(sql: str, columns: list[str]) -> str:
    return " UNION ALL ".join(sql.replace("{c}", c) for c in columns)


@query(each("SELECT '{c}' AS \"column\", count({c})::BIGINT AS n, round(avg({c}), 6) AS mean, round(stddev({c}), 6) AS std, min({c}) AS low, round(quantile_cont({c}, 0.25), 6) AS q25, round(quantile_cont({c}, 0.5), 6) AS q50, round(quantile_cont({c}, 0.75), 6) AS q75, max({c}) AS high FROM wide", NUMBERS), WIDE)
def describe_exact(spark, d):
    return P.describe_exact(wide(spark, d), NUMBERS)


@query(each("SELECT '{c}' AS \"column\", round(avg(({c} = 0)::INT), 9) AS zero_ratio FROM wide", RAW), WIDE)
def zero_ratio(spark, d):
    return P.zero_ratio(wide(spark, d), RAW)


@query(f"SELECT * FROM ({each(each('SELECT $${c}$$ AS column, {s}::DOUBLE AS sentinel, sum(({c} = {s})::INT)::BIGINT AS n FROM wide', RAW).replace('column,', '\"column\",').replace('{s}', '{c}'), ['-999999', '9999999999', '0'])}) WHERE n > 0", WIDE)
def sentinel_scan(spark, d):
    return P.sentinel_scan(wide(spark, d), RAW, [-999999, 9999999999, 0])


@query(f"""SELECT c.col AS "column", c.v, c.n FROM (SELECT *, row_number() OVER (PARTITION BY col ORDER BY n DESC, v) AS k, count(*) OVER (PARTITION BY col) AS dist
 FROM (SELECT col, v, count(*)::BIGINT AS n FROM long WHERE v IS NOT NULL GROUP BY 1, 2)) c JOIN (SELECT col, quantile_cont(v, 0.01) AS a, quantile_cont(v, 0.5) AS m, quantile_cont(v, 0.99) AS b FROM long GROUP BY 1) q ON c.col = q.col
 WHERE k <= 3 AND n >= 5 AND abs(v) > 50 AND dist > 2 AND abs(v - m) > 20 * (b - a)""", WIDE, f"long AS ({each('SELECT $${c}$$ AS col, {c} AS v FROM wide', RAW)})")
def ghost_values(spark, d):
    return P.ghost_values(wide(spark, d), RAW)


@query("SELECT c_mktsegment AS value, count(*)::BIGINT AS n FROM wide GROUP BY 1 ORDER BY n DESC, value LIMIT 3", WIDE)
def topk_values(spark, d):
    return wide(spark, d).groupBy(F.col("c_mktsegment").alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(3)


@query(each("SELECT '{c}' AS \"column\", count(DISTINCT {c})::BIGINT AS n FROM wide", NUMBERS + ["cust"]), WIDE)
def distinct_counts(spark, d):
    return P.per_column(wide(spark, d), NUMBERS + ["cust"], n=F.count_distinct)


@query(each("SELECT '{c}' AS \"column\", min({c}) AS low, max({c}) AS high FROM wide HAVING greatest(abs(min({c})), abs(max({c}))) > 100000", RAW), WIDE)
def extreme_columns(spark, d):
    return P.per_column(wide(spark, d), RAW, low=F.min, high=F.max).where("greatest(abs(low), abs(high)) > 100000")


@query("SELECT c_mktsegment AS level, count(*)::BIGINT AS n, round(avg(y), 9) AS rate FROM wide GROUP BY 1", WIDE)
def target_rate_by_level(spark, d):
    return wide(spark, d).groupBy(F.col("c_mktsegment").alias("level")).agg(F.count("*").alias("n"), F.round(F.avg("y"), 9).alias("rate"))


@query("SELECT (sent = -999999) AS is_sentinel, count(*)::BIGINT AS n, round(avg(y), 9) AS rate FROM wide GROUP BY 1", WIDE)
def sentinel_target_rate(spark, d):
    return wide(spark, d).groupBy((F.col("sent") == -999999).alias("is_sentinel")).agg(F.count("*").alias("n"), F.round(F.avg("y"), 9).alias("rate"))


@query("""SELECT sum((a IS NOT NULL)::INT)::BIGINT AS train_levels, sum((b IS NOT NULL)::INT)::BIGINT AS test_levels, sum((a IS NOT NULL AND b IS NOT NULL)::INT)::BIGINT AS shared, sum((b IS NULL)::INT)::BIGINT AS train_only,
 sum((a IS NULL)::INT)::BIGINT AS test_only, coalesce(sum(CASE WHEN a IS NULL THEN n END), 0)::BIGINT AS unseen_rows FROM (SELECT DISTINCT cust AS a FROM wide WHERE is_train = 1) FULL JOIN (SELECT cust AS b, count(*) AS n FROM wide WHERE is_train = 0 GROUP BY 1) ON a = b""", WIDE)
def level_overlap(spark, d):
    return P.level_overlap(*split(wide(spark, d)), "cust")


@query("SELECT row_id, cust FROM wide WHERE is_train = 0 AND cust NOT IN (SELECT cust FROM wide WHERE is_train = 1)", WIDE)
def unseen_rows_anti(spark, d):
    train, test = split(wide(spark, d))
    return test.join(train.select("cust").distinct(), "cust", "left_anti").select("row_id", "cust")


@query("SELECT DISTINCT cust FROM wide WHERE is_train = 1 INTERSECT SELECT cust FROM wide WHERE is_train = 0", WIDE)
def level_intersect(spark, d):
    train, test = split(wide(spark, d))
    return train.select("cust").intersect(test.select("cust"))


@query("SELECT cust FROM wide WHERE is_train = 1 EXCEPT SELECT cust FROM wide WHERE is_train = 0", WIDE)
def level_except(spark, d):
    train, test = split(wide(spark, d))
    return train.select("cust").subtract(test.select("cust"))


@query("SELECT bool_and(starts_with(p_brand, 'Brand')) AS conforms FROM part")
def prefix_check(spark, d):
    return read(spark, d, "part").agg(F.bool_and(F.startswith("p_brand", F.lit("Brand"))).alias("conforms"))


@query(each("SELECT '{c}' AS \"column\", sum(({c} < lo)::INT)::BIGINT AS below, sum(({c} > hi)::INT)::BIGINT AS above FROM wide, (SELECT min({c}) AS lo, max({c}) AS hi FROM wide WHERE is_train = 1) WHERE is_train = 0", NUMBERS), WIDE)
def out_of_range(spark, d):
    return P.out_of_range(*split(wide(spark, d)), NUMBERS)


@query("SELECT least((rn - 1) // ((SELECT count(*) FROM wide) // 10), 9)::BIGINT AS block, count(*)::BIGINT AS n, round(avg(y), 9) AS rate FROM (SELECT y, row_number() OVER (ORDER BY row_id) AS rn FROM wide) GROUP BY 1", WIDE)
def block_rates(spark, d):
    return P.block_rates(wide(spark, d), "row_id", "y")


@query(each("SELECT '{c}' AS \"column\", round(corr({c}, y), 9) AS r FROM wide", NUMBERS), WIDE)
def target_corr(spark, d):
    return P.per_column(wide(spark, d), NUMBERS, r=lambda c: F.round(F.corr(c, "y"), 9))


@query("SELECT count(*)::BIGINT AS groups, coalesce(sum(n), 0)::BIGINT AS involved, coalesce(sum(n - 1), 0)::BIGINT AS dropped FROM (SELECT count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1)")
def duplicate_rows(spark, d):
    return P.duplicate_rows(read(spark, d, "documents"), ["text"])


@query("SELECT c_nationkey, c_mktsegment, o_orderpriority, count(*)::BIGINT AS n, count(DISTINCT y)::BIGINT AS labels, round(avg(y), 6) AS rate FROM wide GROUP BY 1, 2, 3 HAVING count(*) > 1 AND count(DISTINCT y) > 1", WIDE)
def label_conflicts(spark, d):
    return P.label_conflicts(wide(spark, d), ["c_nationkey", "c_mktsegment", "o_orderpriority"], "y")


COPIES = "copies AS (SELECT row_id, is_train, o_totalprice AS a_price, o_totalprice AS dup, 2 * o_totalprice AS scaled, c_acctbal, 1.0::DOUBLE AS const FROM wide)"


def column_pairs(test: str, columns: list[str], frame: str = "copies") -> str:
    """SQL for the pairs (a, b) of columns that pass a test, an aggregate over the frame with {a} and {b}."""
    return " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b FROM {frame} HAVING {test.format(a=a, b=b)}" for i, a in enumerate(columns) for b in columns[i + 1 :])


COPIED, EQUAL = ["a_price", "c_acctbal", "const", "dup", "scaled"], "bool_and({a} IS NOT DISTINCT FROM {b})"


@query(f"SELECT min(a) AS kept, b AS dropped FROM ({column_pairs(EQUAL, COPIED)}) GROUP BY b", WIDE, COPIES)
def duplicate_columns(spark, d):
    w = wide(spark, d).select("row_id", F.col("o_totalprice").alias("a_price"), F.col("o_totalprice").alias("dup"), (2 * F.col("o_totalprice")).alias("scaled"), "c_acctbal", F.lit(1.0).alias("const"))
    return P.duplicate_columns(w, ["a_price", "dup", "scaled", "c_acctbal", "const"], "row_id")


@query("SELECT c AS \"column\", coalesce(min(a), c) AS \"group\" FROM (SELECT unnest(['a_price', 'c_acctbal', 'dup', 'scaled']) AS c) LEFT JOIN (" + column_pairs("abs(corr({a}, {b})) > 0.999", ["a_price", "c_acctbal", "dup", "scaled"]) + ") ON b = c GROUP BY c", WIDE, COPIES)
def near_duplicate_columns(spark, d):
    w = wide(spark, d).select(F.col("o_totalprice").alias("a_price"), F.col("o_totalprice").alias("dup"), (2 * F.col("o_totalprice")).alias("scaled"), "c_acctbal")
    return P.near_duplicate_columns(w, w.columns)


@query("SELECT count(*)::BIGINT AS n, count(DISTINCT row_id) = count(*) AS unique_key, count(y4) = count(*) AS no_nulls, bool_and(y4 IN (0, 1)) AS binary, avg(y4) > 0.01 AND avg(y4) < 0.15 AS plausible, (SELECT count(*) FROM (SELECT row_id FROM wide EXCEPT SELECT o_orderkey FROM orders UNION ALL SELECT o_orderkey FROM orders EXCEPT SELECT row_id FROM wide)) = 0 AS same_keys, count(*) = (SELECT count(*) FROM orders) AS same_count FROM wide", WIDE)
def validate_output(spark, d):
    return P.contract(wide(spark, d), "row_id", "y4", 0.01, 0.15, read(spark, d, "orders").select(F.col("o_orderkey").alias("row_id")))


@query("SELECT c_nationkey, c_mktsegment, count(*)::BIGINT AS n, round(avg(y), 9) AS rate, round(stddev(y), 9) AS spread FROM wide GROUP BY 1, 2", WIDE)
def pseudo_entities(spark, d):
    return wide(spark, d).groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n"), F.round(F.avg("y"), 9).alias("rate"), F.round(F.stddev("y"), 9).alias("spread"))


@query("SELECT round(o_totalprice, -3) AS k, count(*)::BIGINT AS n FROM wide GROUP BY 1", WIDE)
def rounded_groups(spark, d):
    return wide(spark, d).groupBy(F.round("o_totalprice", -3).alias("k")).agg(F.count("*").alias("n"))


# -- encodings

CODES = "codes AS (SELECT cust AS level, row_number() OVER (ORDER BY cust) - 1 AS code FROM (SELECT DISTINCT cust FROM wide WHERE is_train = 1))"


@query("SELECT row_id, coalesce(code, -1)::BIGINT AS code FROM wide LEFT JOIN codes ON cust = level", WIDE, CODES)
def code_encode(spark, d):
    w = wide(spark, d)
    return E.apply(w, "cust", E.codes(split(w)[0], "cust"), "code", -1, "code").select("row_id", "code")


@query("SELECT row_id, coalesce(code, (SELECT count(*) FROM codes))::BIGINT AS code FROM wide LEFT JOIN codes ON cust = level", WIDE, CODES)
def code_encode_keep(spark, d):
    w = wide(spark, d)
    levels = E.codes(split(w)[0], "cust")
    return E.apply(w.crossJoin(F.broadcast(levels.agg(F.count("*").alias("k")))), "cust", levels, "code", F.col("k"), "code").select("row_id", "code")


@query("SELECT row_id, (dense_rank() OVER (ORDER BY cust) - 1)::BIGINT AS code FROM wide", WIDE)
def label_encode_union(spark, d):
    w = wide(spark, d)
    return E.apply(w, "cust", E.codes(w, "cust"), "code", -1, "code").select("row_id", "code")


@query("SELECT cust AS level, (row_number() OVER (ORDER BY min(row_id)) - 1)::BIGINT AS code FROM wide GROUP BY cust", WIDE)
def factorize(spark, d):
    return E.first_seen(wide(spark, d), "cust", "row_id")


@query("SELECT row_id, CASE WHEN cust IN (SELECT cust FROM wide WHERE is_train = 1) THEN cust ELSE '<UNK>' END AS cust FROM wide", WIDE)
def unk_bucket(spark, d):
    w = wide(spark, d)
    seen = split(w)[0].select(F.col("cust").alias("level")).distinct().withColumn("v", F.col("level"))
    return E.apply(w, "cust", seen, "v", "<UNK>", "known").select("row_id", F.col("known").alias("cust"))


@query("SELECT row_id, round(coalesce(f, 0), 12) AS freq FROM wide LEFT JOIN (SELECT cust AS level, count(*) / sum(count(*)) OVER () AS f FROM wide WHERE is_train = 1 GROUP BY 1) ON cust = level", WIDE)
def freq_encode(spark, d):
    w = wide(spark, d)
    return rounded(E.apply(w, "cust", E.frequencies(split(w)[0], "cust"), "freq", 0.0, "freq").select("row_id", "freq"), "freq", digits=12)


@query("SELECT row_id, round(ln(1 + count(*) OVER (PARTITION BY cust)), 9) AS v FROM wide", WIDE)
def log_count_encode(spark, d):
    w = wide(spark, d)
    table = E.frequencies(w, "cust").withColumn("v", F.log1p("n"))
    return rounded(E.apply(w, "cust", table, "v", 0.0, "v").select("row_id", "v"), "v", digits=9)


@query("SELECT row_id, round(coalesce(te, (SELECT avg(y) FROM wide WHERE is_train = 1)), 9) AS te FROM wide LEFT JOIN (SELECT cust AS level, (sum(y) + 50 * (SELECT avg(y) FROM wide WHERE is_train = 1)) / (count(*) + 50) AS te FROM wide WHERE is_train = 1 GROUP BY 1) ON cust = level", WIDE)
def target_encode_full(spark, d):
    w = wide(spark, d)
    train = split(w)[0]
    seen = w.crossJoin(F.broadcast(train.agg(F.avg("y").alias("prior"))))
    return rounded(E.apply(seen, "cust", E.target_means(train, "cust", "y", 50), "te", F.col("prior"), "te").select("row_id", "te"), "te", digits=9)


FOLDED = "folded AS (SELECT *, ((row_number() OVER (PARTITION BY y ORDER BY md5(row_id::VARCHAR), row_id) - 1) % 5)::INT AS fold FROM wide)"
OOF = """SELECT a.row_id, round((sl - coalesce(sf, 0) + {s} * {prior}) / (nl - coalesce(nf, 0) + {s}), 9) AS te FROM folded a JOIN (SELECT cust, sum(y) AS sl, count(*) AS nl FROM folded GROUP BY 1) l USING (cust)
 JOIN (SELECT cust, fold, sum(y) AS sf, count(*) AS nf FROM folded GROUP BY 1, 2) f USING (cust, fold) JOIN (SELECT fold, sum(y) AS sg, count(*) AS ng FROM folded GROUP BY 1) g USING (fold), (SELECT sum(y) AS st, count(*) AS nt FROM folded)"""


@query(OOF.format(s=50, prior="st / nt"), WIDE, FOLDED)
def target_encode_oof(spark, d):
    w = V.folds(wide(spark, d), "row_id", 5, "y")
    return rounded(E.target_encode_oof(w, "cust", "y", "fold", 50).select("row_id", "te"), "te", digits=9)


@query(OOF.format(s=10, prior="((st - sg) / (nt - ng))"), WIDE, FOLDED)
def target_encode_foldprior(spark, d):
    w = V.folds(wide(spark, d), "row_id", 5, "y")
    return rounded(E.target_encode_oof(w, "cust", "y", "fold", 10, fold_prior=True).select("row_id", "te"), "te", digits=9)


@query("SELECT row_id, (c_mktsegment = 'AUTOMOBILE')::INT AS c_mktsegment_0, (c_mktsegment = 'BUILDING')::INT AS c_mktsegment_1 FROM wide", WIDE)
def one_hot(spark, d):
    w = E.one_hot(wide(spark, d), "c_mktsegment", ["AUTOMOBILE", "BUILDING"])
    return w.select("row_id", "c_mktsegment_0", "c_mktsegment_1")


@query("SELECT cust AS level, round(avg(o_totalprice), 6) AS o_totalprice_mean, round(coalesce(stddev(o_totalprice), 0), 6) AS o_totalprice_std FROM wide WHERE is_train = 1 GROUP BY 1", WIDE)
def group_agg_encode(spark, d):
    return rounded(E.group_stats(split(wide(spark, d))[0], "cust", ["o_totalprice"]), "o_totalprice_mean", "o_totalprice_std")


@query("SELECT doc_id, toxic::INT AS flag FROM labels")
def bool_text_decode(spark, d):
    text = F.concat(F.when(F.col("toxic") == 1, "yes").otherwise("no"), F.lit(", this item was flagged by review"))
    return read(spark, d, "labels").select("doc_id", E.bool_text(text).alias("flag"))


# -- transforms


@query("SELECT row_id, (sent = -999999)::INT AS flag, nullif(sent, -999999) AS v FROM wide", WIDE)
def sentinel_flags(spark, d):
    return wide(spark, d).select("row_id", (F.col("sent") == -999999).cast("int").alias("flag"), F.nullif("sent", F.lit(-999999.0)).alias("v"))


@query("SELECT row_id, greatest(least(o_totalprice, hi), lo) AS v FROM wide, (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM wide WHERE is_train = 1)", WIDE)
def clip_to_train(spark, d):
    w = wide(spark, d)
    return T.clip(w, ["o_totalprice"], T.bounds(split(w)[0], ["o_totalprice"])).select("row_id", F.col("o_totalprice").alias("v"))


@query("SELECT row_id, round(greatest(least(o_totalprice, hi), lo), 6) AS v FROM wide, (SELECT quantile_cont(o_totalprice, 0.01) AS lo, quantile_cont(o_totalprice, 0.99) AS hi FROM wide)", WIDE)
def winsorize(spark, d):
    w = wide(spark, d)
    return T.clip(w, ["o_totalprice"], T.bounds(w, ["o_totalprice"], 0.01, 0.99)).select("row_id", F.round("o_totalprice", 6).alias("v"))


@query("SELECT row_id, round((o_totalprice - m) / s, 6) AS v FROM wide, (SELECT avg(o_totalprice) AS m, stddev_pop(o_totalprice) AS s FROM wide WHERE is_train = 1)", WIDE)
def standard_scale(spark, d):
    w = wide(spark, d)
    return T.standard_scale(w, ["o_totalprice"], split(w)[0]).select("row_id", F.round("o_totalprice", 6).alias("v"))


@query("SELECT row_id, round((o_totalprice - m) / (b - a), 6) AS v FROM wide, (SELECT quantile_cont(o_totalprice, 0.25) AS a, quantile_cont(o_totalprice, 0.5) AS m, quantile_cont(o_totalprice, 0.75) AS b FROM wide WHERE is_train = 1)", WIDE)
def robust_scale(spark, d):
    w = wide(spark, d)
    return T.robust_scale(w, ["o_totalprice"], split(w)[0]).select("row_id", F.round("o_totalprice", 6).alias("v"))


@query("SELECT row_id, c_acctbal + c_nationkey AS c_acctbal_plus_c_nationkey, c_acctbal - c_nationkey AS c_acctbal_minus_c_nationkey, c_acctbal * c_nationkey AS c_acctbal_times_c_nationkey, c_acctbal / CASE WHEN c_nationkey = 0 THEN 1e-5 ELSE c_nationkey END AS c_acctbal_over_c_nationkey FROM wide", WIDE)
def interactions(spark, d):
    return wide(spark, d).select("row_id", *T.interactions(["c_acctbal", "c_nationkey"]))


@query(each("SELECT '{c}' AS \"column\", round((sum(s * s / n) - sum(s) * sum(s) / sum(n)) / (count(*) - 1) / (sum(v * n) / (sum(n) - count(*))), 4) AS f FROM (SELECT y, count({c}) AS n, sum({c}) AS s, var_pop({c}) AS v FROM wide GROUP BY 1)", NUMBERS), WIDE)
def anova_f(spark, d):
    return rounded(T.anova_f(wide(spark, d), NUMBERS, "y"), "f", digits=4)


@query("""SELECT vec_id, count(*)::BIGINT AS n_valid, round(avg(x), 6) AS row_mean, round(stddev_pop(x), 6) AS row_std0, min(x) AS row_min, max(x) AS row_max, round(quantile_cont(x, 0.25), 6) AS row_q25, round(quantile_cont(x, 0.5), 6) AS row_median,
 round(mad(x), 6) AS row_mad, round(kurtosis_pop(x), 5) AS row_kurt, sum((x < 0)::INT)::BIGINT AS n_negative FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY 1""")
def row_stats(spark, d):
    v = read(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    out = T.row_stats(v, "v").select("vec_id", "n_valid", "row_mean", "row_std0", "row_min", "row_max", "row_q25", "row_median", "row_mad", "row_kurt", "n_negative")
    return rounded(rounded(out, "row_mean", "row_std0", "row_q25", "row_median", "row_mad"), "row_kurt", digits=5)


# -- folds, metrics, blends


@query("SELECT row_id, fold FROM folded", WIDE, FOLDED)
def strat_folds(spark, d):
    return V.folds(wide(spark, d), "row_id", 5, "y").select("row_id", "fold")


@query("SELECT row_id, ((row_number() OVER (ORDER BY md5(row_id::VARCHAR), row_id) - 1) % 5)::INT AS fold FROM wide", WIDE)
def kfolds(spark, d):
    return V.folds(wide(spark, d), "row_id", 5).select("row_id", "fold")


@query("SELECT row_id FROM folded WHERE fold = 0", WIDE, FOLDED)
def strat_holdout(spark, d):
    return V.folds(wide(spark, d), "row_id", 5, "y").where("fold = 0").select("row_id")


CURVE = """each_ AS (SELECT s AS threshold, sum(y) AS p, count(*) AS n FROM scores GROUP BY 1), c_ AS (SELECT threshold, sum(p) OVER w AS tp, sum(n) OVER w AS n_pred_pos, (SELECT sum(p) FROM each_) AS ap, (SELECT sum(n) FROM each_) AS an FROM each_ WINDOW w AS (ORDER BY threshold DESC)),
 curve AS (SELECT threshold, n_pred_pos::BIGINT AS n_pred_pos, tp::BIGINT AS tp, (n_pred_pos - tp)::BIGINT AS fp, (ap - tp)::BIGINT AS fn, (an - ap - n_pred_pos + tp)::BIGINT AS tn, 2 * tp / (n_pred_pos + ap) AS binary_f1 FROM c_)"""


@query("SELECT threshold, n_pred_pos, tp, fp, fn, tn, round(binary_f1, 9) AS binary_f1, round((binary_f1 + 2 * tn / (2 * tn + fp + fn)) / 2, 9) AS macro_f1 FROM curve", SCORES, CURVE)
def cutoff_curve(spark, d):
    return rounded(V.curve(scores(spark, d)), "binary_f1", "macro_f1", digits=9)


@query("SELECT threshold, round(binary_f1, 9) AS f1, n_pred_pos FROM curve ORDER BY round(binary_f1, 12) DESC, threshold LIMIT 1", SCORES, CURVE)
def best_threshold(spark, d):
    return rounded(V.best_threshold(scores(spark, d)), "f1", digits=9)


@query("SELECT threshold, n_pred_pos, k, n_plateau FROM curve, (SELECT floor(quantile_cont(n_pred_pos, 0.5))::BIGINT AS k, count(*)::BIGINT AS n_plateau FROM curve WHERE binary_f1 >= (SELECT max(binary_f1) FROM curve) - 0.002) ORDER BY abs(n_pred_pos - k), n_pred_pos LIMIT 1", SCORES, CURVE)
def plateau_threshold(spark, d):
    return V.plateau_threshold(scores(spark, d))


@query("SELECT i / 20 AS threshold, sum((s / 100 >= i / 20)::INT)::BIGINT AS n_pred_pos, round(2 * sum((s / 100 >= i / 20 AND y = 1)::INT) / (sum((s / 100 >= i / 20)::INT) + sum(y)), 9) AS f1 FROM scores, range(1, 20) t(i) GROUP BY 1", SCORES)
def threshold_grid(spark, d):
    return rounded(V.threshold_grid(scores(spark, d).withColumn("s", F.col("s") / 100), 20), "f1", digits=9)


AUC = "round((sum(CASE WHEN y = 1 THEN r END) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y))), 9) AS auc"
RANK = "rank() OVER ({p} ORDER BY {s}) + (count(*) OVER (PARTITION BY {q} {s}) - 1) / 2 AS r"


@query(f"SELECT {AUC} FROM (SELECT y, {RANK.format(p='', q='', s='s')} FROM scores)", SCORES)
def auc_exact(spark, d):
    return rounded(V.auc(scores(spark, d)), "auc", digits=9)


@query(f"SELECT {AUC} FROM (SELECT y, {RANK.format(p='', q='', s='row_id')} FROM wide)", WIDE)
def row_index_auc(spark, d):
    return rounded(V.auc(wide(spark, d), score="row_id"), "auc", digits=9)


@query(f"SELECT col AS \"column\", greatest(auc, 1 - auc) AS auc FROM (SELECT col, {AUC} FROM (SELECT col, y, {RANK.format(p='PARTITION BY col', q='col,', s='s')} FROM long) GROUP BY 1)", WIDE, f"long AS ({each('SELECT $${c}$$ AS col, y, {c} AS s FROM wide', NUMBERS)})")
def single_feature_auc(spark, d):
    long = wide(spark, d).unpivot(["y"], NUMBERS, "column", "s")
    return rounded(V.auc(long, by=["column"]), "auc", digits=9).select("column", F.greatest("auc", 1 - F.col("auc")).alias("auc"))


@query("SELECT id, round((rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2) / count(*) OVER (), 9) AS rank FROM scores", SCORES)
def rank_norm(spark, d):
    return rounded(V.rank_norm(scores(spark, d), "s").select("id", "rank"), "rank", digits=9)


@query("SELECT round(2 * sum(y) / (count(*) + sum(y)), 9) AS all_ones_f1, 0.0::DOUBLE AS all_zeros_f1 FROM scores", SCORES)
def degenerate_floors(spark, d):
    return scores(spark, d).agg(F.round(2 * F.sum("y") / (F.count("*") + F.sum("y")), 9).alias("all_ones_f1"), F.lit(0.0).alias("all_zeros_f1"))


@query("SELECT fold, round(avg(y), 9) AS rate, count(*)::BIGINT AS n FROM folded GROUP BY 1", WIDE, FOLDED)
def fold_metrics(spark, d):
    return V.folds(wide(spark, d), "row_id", 5, "y").groupBy("fold").agg(F.round(F.avg("y"), 9).alias("rate"), F.count("*").alias("n"))


@query("SELECT row_id, CASE WHEN y = 1 THEN round((SELECT sum(1 - y) / sum(y) FROM wide), 9) ELSE 1 END AS w FROM wide", WIDE)
def class_weights(spark, d):
    w = wide(spark, d)
    ratio = w.agg((F.sum(1 - F.col("y")) / F.sum("y")).alias("ratio"))
    return w.crossJoin(F.broadcast(ratio)).select("row_id", F.when(F.col("y") == 1, F.round("ratio", 9)).otherwise(1.0).alias("w"))


@query("SELECT id FROM scores ORDER BY s DESC, id LIMIT (SELECT greatest(200, (count(*) * 15) // 100) FROM scores)", SCORES)
def shift_holdout(spark, d):
    return V.top_fraction(scores(spark, d), "s", "id", 0.15, 200).select("id")


@query("SELECT round_, row_id, y FROM (SELECT round_, row_id, y, row_number() OVER (PARTITION BY round_, y ORDER BY md5(row_id::VARCHAR || ':' || round_::VARCHAR), row_id) AS k FROM wide, range(3) t(round_)) WHERE k <= (SELECT sum(y) FROM wide)", WIDE)
def balanced_bags(spark, d):
    w = wide(spark, d)
    rounds = w.select("row_id", "y", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long"))).alias("round_"))
    placed = dealt(rounds, F.md5(F.concat_ws(":", "row_id", "round_").cast("binary")), ["row_id"], ["round_", "y"])
    return placed.crossJoin(F.broadcast(w.agg(F.sum("y").alias("pos")))).where("k < pos").select("round_", "row_id", "y")


UNI = "(('0x' || substr(md5(id::VARCHAR), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


@query(f"SELECT id, CASE WHEN p > 0.9 THEN 1 ELSE 0 END::INT AS label FROM (SELECT id, {UNI} AS p FROM scores) WHERE p > 0.9 OR p < 0.05", SCORES)
def pseudo_fixed(spark, d):
    p = scores(spark, d).select("id", V.uniform(F.col("id")).alias("p"))
    return p.where("p > 0.9 or p < 0.05").select("id", (F.col("p") > 0.9).cast("int").alias("label"))


@query(f"SELECT id, round(greatest(0.25, least(4, p / (1 - p))), 9) AS w FROM (SELECT id, {UNI} AS p FROM scores)", SCORES)
def adversarial_weights(spark, d):
    p = V.uniform(F.col("id"))
    return scores(spark, d).select("id", F.round(F.greatest(F.lit(0.25), F.least(F.lit(4.0), p / (1 - p))), 9).alias("w"))


@query("SELECT id, round(CASE WHEN s / 100 < 0.3 THEN 0.5 * (s / 100) / 0.3 ELSE 0.5 + 0.5 * (s / 100 - 0.3) / 0.7 END, 9) AS p FROM scores", SCORES)
def recalibrate(spark, d):
    s = F.col("s") / 100
    return scores(spark, d).select("id", F.round(F.when(s < 0.3, 0.5 * s / 0.3).otherwise(0.5 + 0.5 * (s - 0.3) / 0.7), 9).alias("p"))


# -- models: rows only


def folded(spark, d):
    from wicker.operators import learn

    w = T.standard_scale(wide(spark, d), NUMBERS, wide(spark, d)).select("row_id", "y", *NUMBERS)
    return V.folds(learn.assemble(w, NUMBERS), "row_id", 3, "y")


def vectors(spark, d):
    return read(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))


@query()
def logit_oof(spark, d):
    from wicker.operators import learn

    return learn.out_of_fold(folded(spark, d), learn.logistic())


@query()
def rf_oof(spark, d):
    from wicker.operators import learn

    return learn.out_of_fold(folded(spark, d), learn.forest())


@query()
def gbt_oof(spark, d):
    from wicker.operators import learn

    return learn.out_of_fold(folded(spark, d), learn.boosted())


@query()
def stacking(spark, d):
    from wicker.operators import learn

    return learn.stacked(folded(spark, d), {"logit": learn.logistic(), "forest": learn.forest(10, 4)})


@query()
def adversarial_auc(spark, d):
    from wicker.operators import learn

    return learn.adversarial_auc(*split(wide(spark, d)), NUMBERS, "row_id")


@query()
def pca_explained(spark, d):
    from wicker.operators import learn

    return learn.explained(vectors(spark, d), "v")


@query()
def kmeans_dist(spark, d):
    from wicker.operators import learn

    return learn.cluster_distances(vectors(spark, d), "v").drop("v")


@query()
def quantile_normal(spark, d):
    from wicker.operators import learn

    w = wide(spark, d)
    return learn.quantile_normal(w, "o_totalprice", split(w)[0]).select("row_id", "o_totalprice")


@query()
def smote(spark, d):
    from wicker.operators import learn

    return learn.smote(wide(spark, d), ["o_totalprice", "c_acctbal"], "y4", "row_id", 0.25)


@query()
def smotenc(spark, d):
    from wicker.operators import learn

    return learn.smote(wide(spark, d), ["o_totalprice", "c_acctbal"], "y4", "row_id", 0.25, sides=["c_mktsegment"])
