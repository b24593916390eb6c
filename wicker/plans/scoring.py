"""Registered queries on predictions, contracts, resampling and the remaining column profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from wicker.operators import encode as E, evaluate as V, profile as P, resample as R, transform as T
from wicker.operators.order import dealt, numbered, quantiles
from wicker.plans.queries import FOLDED, NUMBERS, RAW, UNI, each, query, rounded, split
from wicker.sources.tables import SCORES, WIDE, contract_columns, read, scores, wide

#: Two scores from hashes beside a label.
PRED = f"pred AS (SELECT id, y, {UNI} AS p, {UNI.replace('id::VARCHAR', chr(39) + 'b' + chr(39) + ' || id::VARCHAR')} AS q FROM scores)"


def pred(spark, d):
    return scores(spark, d).select("id", "y", V.uniform(F.col("id")).alias("p"), V.uniform("b", F.col("id")).alias("q"))


# -- contracts


@query("SELECT count(*)::BIGINT AS n, min(id) = 0 AND max(id) = count(*) - 1 AND count(DISTINCT id) = count(*) AS dense_keys, bool_and(p IS NOT NULL AND isfinite(p)) AS finite, bool_and(p > 0 AND p < 1) AS inside FROM pred", SCORES, PRED)
def validate_proba(spark, d):
    return P.probability_contract(pred(spark, d), "id", "p")


@query("SELECT round(avg((p >= 0.8)::INT) / avg(y), 9) AS ratio, avg((p >= 0.8)::INT) / avg(y) BETWEEN 0.5 AND 2 AS expected FROM pred", SCORES, PRED)
def rate_ratio(spark, d):
    r = F.avg((F.col("p") >= 0.8).cast("int")) / F.avg("y")
    return pred(spark, d).agg(F.round(r, 9).alias("ratio"), r.between(0.5, 2).alias("expected"))


@query("SELECT sum(((p >= 0.5) <> (q >= 0.5))::INT)::BIGINT AS differing FROM pred", SCORES, PRED)
def reproduce_diff(spark, d):
    one, two = pred(spark, d).select("id", "p"), pred(spark, d).select("id", "q")
    return one.join(two, "id").agg(F.sum(((F.col("p") >= 0.5) != (F.col("q") >= 0.5)).cast("long")).alias("differing"))


@query("SELECT row_id, p FROM wide JOIN pred ON row_id = id", WIDE, SCORES, PRED)
def predictions_by_id(spark, d):
    return wide(spark, d).join(pred(spark, d), F.col("row_id") == F.col("id")).select("row_id", "p")


#: Names and types of the columns of wide, from its first row.
TYPED = "typed AS (SELECT unnest(json_keys(j)) AS name, unnest([lower(x) FOR x IN t]) AS kind FROM (SELECT to_json(wide) AS j, [" + ", ".join(f"typeof({c})" for c in ("row_id", "o_totalprice", "c_acctbal", "c_nationkey", "custkey", "cust", "o_orderpriority", "c_mktsegment", "y", "y4", "is_train", "sent", "sparse")) + "] AS t FROM wide LIMIT 1))"


@query("SELECT name AS \"column\" FROM typed WHERE kind = 'double'", WIDE, TYPED)
def schema_roles(spark, d):
    names = [(f.name,) for f in wide(spark, d).schema if f.dataType.typeName() == "double"]
    return spark.createDataFrame(names, "column string")


@query("SELECT CASE kind WHEN 'integer' THEN 'int' WHEN 'varchar' THEN 'string' ELSE kind END AS kind, count(*)::BIGINT AS n FROM typed GROUP BY 1", WIDE, TYPED)
def schema_report(spark, d):
    return spark.createDataFrame([(t,) for _, t in wide(spark, d).dtypes], "kind string").groupBy("kind").agg(F.count("*").alias("n"))


@query("SELECT CASE WHEN starts_with(name, 'o_') THEN 'orders' WHEN starts_with(name, 'c_') THEN 'customers' ELSE 'other' END AS \"group\", count(*)::BIGINT AS n FROM typed GROUP BY 1", WIDE, TYPED)
def column_groups(spark, d):
    group = lambda c: "orders" if c.startswith("o_") else "customers" if c.startswith("c_") else "other"
    return spark.createDataFrame([(group(c),) for c in wide(spark, d).columns], "group string").groupBy("group").agg(F.count("*").alias("n"))


@query("SELECT row_id, y, o_totalprice FROM wide", WIDE)
def column_contract(spark, d):
    return contract_columns(wide(spark, d), ["row_id", "y", "o_totalprice"])[0]


# -- profiles


@query(each("SELECT '{c}' AS \"column\", min({c}) = max({c}) AS in_all, min({c}) FILTER (is_train = 1) = max({c}) FILTER (is_train = 1) AS in_train FROM wide", RAW + ["y4"]), WIDE)
def constant_columns(spark, d):
    w = wide(spark, d)
    of = lambda c, k: F.when(F.col("is_train") == k, c)
    return P.per_column(w, RAW + ["y4"], in_all=lambda c: F.min(c) == F.max(c), in_train=lambda c: F.min(of(c, 1)) == F.max(of(c, 1)))


@query(each("SELECT '{c}' AS \"column\", var_samp({c}) <= 1e-12 AS constant FROM wide", NUMBERS), WIDE)
def zero_variance(spark, d):
    return P.per_column(wide(spark, d), NUMBERS, constant=lambda c: F.var_samp(c) <= 1e-12)


@query("SELECT c_mktsegment AS value, n, round(n / total, 9) AS share, levels FROM (SELECT c_mktsegment, count(*)::BIGINT AS n, sum(count(*)) OVER () AS total, count(*) OVER () AS levels FROM wide GROUP BY 1) ORDER BY n DESC, value LIMIT 1", WIDE)
def dominant_value(spark, d):
    n = wide(spark, d).groupBy(F.col("c_mktsegment").alias("value")).agg(F.count("*").alias("n"))
    return n.crossJoin(F.broadcast(n.agg(F.sum("n").alias("total"), F.count("*").alias("levels")))).orderBy(F.desc("n"), "value").limit(1).select("value", "n", F.round(F.col("n") / F.col("total"), 9).alias("share"), "levels")


@query("SELECT count(*) FILTER (o_totalprice < q)::BIGINT AS below, (SELECT min(o_totalprice) FROM wide WHERE o_totalprice > (SELECT min(o_totalprice) FROM wide)) AS second FROM wide, (SELECT quantile_cont(o_totalprice, 0.01) AS q FROM wide)", WIDE)
def tail_profile(spark, d):
    w = wide(spark, d)
    q = quantiles(w, {"o_totalprice": [0.01]})["o_totalprice"][0]
    least = w.agg(F.min("o_totalprice").alias("least"))
    return w.crossJoin(F.broadcast(least)).agg(F.count_if(F.col("o_totalprice") < F.lit(q)).alias("below"), F.min(F.when(F.col("o_totalprice") > F.col("least"), F.col("o_totalprice"))).alias("second"))


@query(each("SELECT '{c}' AS \"column\", avg((abs({c} - round({c})) <= 1e-8 + 1e-5 * abs(round({c})))::INT) >= 0.99 AS integer_like FROM wide", NUMBERS), WIDE)
def integer_like(spark, d):
    return P.per_column(wide(spark, d), NUMBERS, integer_like=lambda c: F.avg((F.abs(c - F.round(c)) <= 1e-8 + 1e-5 * F.abs(F.round(c))).cast("int")) >= 0.99)


@query("SELECT row_id, count(*) OVER (PARTITION BY c_acctbal)::BIGINT AS n, (count(*) OVER (PARTITION BY c_acctbal) = 1) AS single FROM wide", WIDE)
def value_uniqueness(spark, d):
    w = wide(spark, d)
    n = w.groupBy("c_acctbal").agg(F.count("*").alias("n"))
    n = n.withColumnRenamed("c_acctbal", "_v")
    return w.join(n, F.col("c_acctbal").eqNullSafe(F.col("_v"))).select("row_id", "n", (F.col("n") == 1).alias("single"))


@query("SELECT bool_or(length(v) > 15 AND starts_with(v, 'yes')) AS is_text_boolean FROM (SELECT CASE WHEN toxic = 1 THEN 'yes' ELSE 'no' END || ', this item was flagged by review' AS v FROM labels ORDER BY doc_id LIMIT 300)")
def bool_text_detect(spark, d):
    v = F.concat(F.when(F.col("toxic") == 1, "yes").otherwise("no"), F.lit(", this item was flagged by review"))
    return read(spark, d, "labels").orderBy("doc_id").limit(300).agg(F.bool_or((F.length(v) > 15) & F.startswith(v, F.lit("yes"))).alias("is_text_boolean"))


@query("SELECT quality::INT AS a, toxic::INT AS b, count(*)::BIGINT AS n FROM labels GROUP BY 1, 2")
def flag_pairs(spark, d):
    return read(spark, d, "labels").groupBy(F.col("quality").cast("int").alias("a"), F.col("toxic").cast("int").alias("b")).agg(F.count("*").alias("n"))


@query("SELECT round(abs(avg(y) FILTER (is_train = 1) - avg(y) FILTER (is_train = 0)), 9) AS gap FROM wide", WIDE)
def flag_rate_shift(spark, d):
    of = lambda k: F.avg(F.when(F.col("is_train") == k, F.col("y")))
    return wide(spark, d).agg(F.round(F.abs(of(1) - of(0)), 9).alias("gap"))


@query("SELECT doc_id, dense_rank() OVER (ORDER BY source, lang)::BIGINT AS g FROM documents")
def group_number(spark, d):
    docs = read(spark, d, "documents").select("doc_id", "source", "lang")
    keys = numbered(docs.select("source", "lang").distinct(), "source", "lang", name="g").withColumn("g", F.col("g") + 1)
    return docs.join(keys.withColumnsRenamed({"source": "_s", "lang": "_l"}), F.col("source").eqNullSafe(F.col("_s")) & F.col("lang").eqNullSafe(F.col("_l"))).select("doc_id", "g")


@query("SELECT doc_id, greatest(m, 1 - m) AS w FROM (SELECT doc_id, avg(quality) OVER (PARTITION BY text) AS m FROM documents JOIN labels USING (doc_id))")
def purity_weight(spark, d):
    rows = read(spark, d, "documents").join(read(spark, d, "labels"), "doc_id").select("doc_id", "text", "quality")
    rows = rows.withColumn("text", F.coalesce(F.sha2("text", 256), F.lit("")))  # texts are compared by digest, null to null
    m = rows.groupBy("text").agg(F.avg("quality").alias("m"))
    return rows.join(m, "text").select("doc_id", F.greatest("m", 1 - F.col("m")).alias("w"))


@query("SELECT doc_id FROM documents WHERE doc_id % 2 = 1 AND text IN (SELECT text FROM documents WHERE doc_id % 2 = 0)")
def cross_overlap_semi(spark, d):
    docs = read(spark, d, "documents").select("doc_id", "text")
    return docs.where("doc_id % 2 = 1").join(docs.where("doc_id % 2 = 0").select("text"), "text", "left_semi").select("doc_id")


@query("SELECT row_id, 'train' AS part FROM wide WHERE is_train = 1 UNION ALL SELECT row_id, 'test' FROM wide WHERE is_train = 0", WIDE)
def union_tagged(spark, d):
    train, test = split(wide(spark, d))
    return train.select("row_id", F.lit("train").alias("part")).unionByName(test.select("row_id", F.lit("test").alias("part")))


@query("SELECT round(quantile_cont(p, 0.9), 9) AS p90, round(quantile_cont(p, 0.95), 9) AS p95, round(quantile_cont(p, 0.99), 9) AS p99 FROM pred", SCORES, PRED)
def score_percentiles(spark, d):
    found = quantiles(pred(spark, d), {"p": [0.9, 0.95, 0.99]})["p"]
    return spark.createDataFrame([tuple(round(x, 9) for x in found)], "p90 double, p95 double, p99 double")


@query("SELECT round(corr(p, q), 9) AS r FROM pred", SCORES, PRED)
def model_corr(spark, d):
    return pred(spark, d).agg(F.round(F.corr("p", "q"), 9).alias("r"))


@query("SELECT cust AS level, count(*)::BIGINT AS n, round(count(*) / (SELECT count(*) FROM wide), 12) AS freq FROM wide GROUP BY 1", WIDE)
def freq_encode_union(spark, d):
    return rounded(E.frequencies(wide(spark, d), "cust"), "freq", digits=12)


@query("SELECT row_id, round(greatest(least(o_totalprice, hi), lo), 6) AS v, (o_totalprice < lo OR o_totalprice > hi) AS clipped FROM wide, (SELECT quantile_cont(o_totalprice, 0.005) AS lo, quantile_cont(o_totalprice, 0.995) AS hi FROM wide WHERE is_train = 1) WHERE is_train = 0", WIDE)
def clip_percentile(spark, d):
    train, test = split(wide(spark, d))
    out = T.clip(test.withColumn("raw", F.col("o_totalprice")), ["o_totalprice"], T.bounds(train, ["o_totalprice"], 0.005, 0.995))
    return out.select("row_id", F.round("o_totalprice", 6).alias("v"), (F.col("raw") != F.col("o_totalprice")).alias("clipped"))


# -- predictions


@query("SELECT id, round((rank() OVER (ORDER BY p) + rank() OVER (ORDER BY q) + (count(*) OVER (PARTITION BY p) - 1) / 2 + (count(*) OVER (PARTITION BY q) - 1) / 2) / 2 / count(*) OVER (), 9) AS blend FROM pred", SCORES, PRED)
def rank_blend(spark, d):
    both = V.rank_norm(V.rank_norm(pred(spark, d), "p", "a"), "q", "b")
    return both.select("id", F.round((F.col("a") + F.col("b")) / 2, 9).alias("blend"))


F1 = "(SELECT 2 * sum(({c} >= 0.5 AND y = 1)::INT) / (sum(({c} >= 0.5)::INT) + sum(y)) FROM pred)"


@query(f"SELECT id, round(({F1.format(c='p')} * p + {F1.format(c='q')} * q) / ({F1.format(c='p')} + {F1.format(c='q')}), 9) AS blend FROM pred", SCORES, PRED)
def f1_weighted_blend(spark, d):
    df = pred(spark, d)
    f1 = lambda c: 2 * F.count_if((F.col(c) >= 0.5) & (F.col("y") == 1)) / (F.count_if(F.col(c) >= 0.5) + F.sum("y"))
    w = df.agg(f1("p").alias("wp"), f1("q").alias("wq"))
    return df.crossJoin(F.broadcast(w)).select("id", F.round((F.col("wp") * F.col("p") + F.col("wq") * F.col("q")) / (F.col("wp") + F.col("wq")), 9).alias("blend"))


@query("SELECT id, round((p + q) / 2, 12) AS p FROM pred", SCORES, PRED)
def seed_average(spark, d):
    long = pred(spark, d).unpivot(["id"], ["p", "q"], "model", "v")
    return long.groupBy("id").agg(F.round(F.avg("v"), 12).alias("p"))


@query(" UNION ALL ".join(f"SELECT {t}::DOUBLE AS threshold, sum((p >= {t})::INT)::BIGINT AS n, round(avg((p >= {t})::INT), 9) AS rate FROM pred" for t in (0.3, 0.5, 0.7)), SCORES, PRED)
def threshold_probes(spark, d):
    probe = lambda t: F.struct(F.lit(t).alias("threshold"), F.count_if(F.col("p") >= t).alias("n"), F.round(F.avg((F.col("p") >= t).cast("int")), 9).alias("rate"))
    return pred(spark, d).agg(F.array(*map(probe, (0.3, 0.5, 0.7))).alias("a")).select(F.inline("a"))


@query("""SELECT round(0.3 * f1 + 0.25 * auc + 0.15 * tp / (tp + fp) + 0.15 * tp / (tp + fn) + 0.1 * (tp / (tp + fn) + tn / (tn + fp)) / 2 + 0.05 * tn / (tn + fp), 9) AS composite FROM (SELECT 2 * tp / (2 * tp + fp + fn) AS f1, * FROM (SELECT sum((p >= 0.5 AND y = 1)::INT) AS tp, sum((p >= 0.5 AND y = 0)::INT) AS fp, sum((p < 0.5 AND y = 1)::INT) AS fn, sum((p < 0.5 AND y = 0)::INT) AS tn FROM pred)),
 (SELECT (sum(CASE WHEN y = 1 THEN r END) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y))) AS auc FROM (SELECT y, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2 AS r FROM pred))""", SCORES, PRED)
def composite_score(spark, d):
    df = pred(spark, d)
    c = df.agg(*(v.alias(k) for k, v in V.confusion("y", (F.col("p") >= 0.5).cast("int")).items())).crossJoin(F.broadcast(V.auc(df, "y", "p")))
    return c.select(F.round(R.composite_of(*map(F.col, ("auc", "tp", "fp", "fn", "tn"))), 9).alias("composite"))


@query("SELECT id, (row_number() OVER (ORDER BY p DESC, id) <= round(0.2 * (SELECT count(*) FROM pred)))::INT AS label FROM pred", SCORES, PRED)
def topk_rate_label(spark, d):
    df = pred(spark, d)
    return numbered(df.select("id", "p"), -F.col("p"), "id").select("id", (F.col("k") < round(0.2 * df.count())).cast("int").alias("label"))


@query("SELECT id, greatest(0.001, least(0.999, p + 0.5 - 0.375)) AS p FROM pred", SCORES, PRED)
def affine_shift(spark, d):
    return pred(spark, d).select("id", F.greatest(F.lit(0.001), F.least(F.lit(0.999), F.col("p") + 0.5 - 0.375)).alias("p"))


#: Scores with both cuts, their place from the highest, and whether fewer than 50 reach the upper cut: then the 50 highest are positive.
CUT = """cut AS (SELECT id, p, b, CASE WHEN count(*) FILTER (p >= a) OVER () >= 50 THEN p >= a
 ELSE row_number() OVER (ORDER BY p DESC, id) <= 50 END AS pos
 FROM pred, (SELECT quantile_cont(p, 0.99) AS a, quantile_cont(p, 0.3) AS b FROM pred))"""


@query("SELECT id, pos::INT AS label FROM cut WHERE pos OR p <= b", SCORES, PRED, CUT)
def pseudo_percentile(spark, d):
    return R.pseudo_percentile(pred(spark, d), "p", "id", 0.99, 0.3)


@query("SELECT id, label FROM (SELECT id, label, row_number() OVER (PARTITION BY label ORDER BY md5(id::VARCHAR), id) AS k, sum(label) OVER () AS pos FROM (SELECT id, (p > 0.99)::INT AS label FROM pred WHERE p > 0.99 OR p < 0.5)) WHERE label = 1 OR k <= 10 * pos", SCORES, PRED)
def pseudo_cap(spark, d):
    df = pred(spark, d).where("p > 0.99 or p < 0.5").select("id", (F.col("p") > 0.99).cast("int").alias("label"))
    pos = df.where("label = 1")
    some = dealt(df.where("label = 0"), F.md5(F.col("id").cast("string").cast("binary")), ["id"])
    return pos.unionByName(some.where(F.col("k") < 10 * pos.count()).drop("k"))


@query("SELECT row_id, fold FROM folded UNION ALL SELECT -id, -1 FROM pred WHERE p > 0.95", WIDE, FOLDED, SCORES, PRED)
def fold_safe_union(spark, d):
    real = V.folds(wide(spark, d), "row_id", 5, "y").select("row_id", "fold")
    return real.unionByName(pred(spark, d).where("p > 0.95").select((-F.col("id")).alias("row_id"), F.lit(-1).alias("fold")))


@query("SELECT greatest(0, floor(0.5 * sum(1 - y4)) - sum(y4))::BIGINT AS n FROM wide", WIDE)
def smote_count(spark, d):
    return wide(spark, d).agg(F.greatest(F.lit(0), F.floor(0.5 * F.sum(1 - F.col("y4"))) - F.sum("y4")).cast("long").alias("n"))


@query("SELECT id, greatest(0, least(floor(p * 12 + 0.5), 9))::INT AS code FROM pred", SCORES, PRED)
def round_codes(spark, d):
    return pred(spark, d).select("id", F.greatest(F.lit(0), F.least(F.floor(F.col("p") * 12 + 0.5), F.lit(9))).cast("int").alias("code"))


@query("SELECT i::BIGINT AS i, row_id FROM (SELECT i, ((('0x' || substr(md5('boot' || i::VARCHAR), 1, 8))::BIGINT / 4294967296.0::DOUBLE) * (SELECT count(*) FROM wide))::DOUBLE AS u FROM (SELECT row_number() OVER () - 1 AS i FROM wide)) JOIN (SELECT row_id, row_number() OVER (ORDER BY row_id) - 1 AS k FROM wide) ON k = floor(u)", WIDE)
def bootstrap_rows(spark, d):
    w = wide(spark, d).select("row_id")
    return R.bootstrap(w, "row_id", 1.0)
