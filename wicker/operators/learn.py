"""Models, resampling and drift: Spark ML estimators inside out-of-fold loops, SMOTE, quantile maps, PCA, k-means."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from wicker.operators.evaluate import auc, folds, uniform
from wicker.operators.neighbours import nearest_category, neighbours, nominal_penalty  # noqa: F401  (users take all three from here)
from wicker.operators.order import dealt, quantiles
from wicker.sources.tables import checkpointed, shared_folder


def assemble(df: DataFrame, columns: list[str], name: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=columns, outputCol=name).transform(df)


def logistic(**more) -> Estimator:
    return LogisticRegression(featuresCol="features", labelCol="y", regParam=0.01, maxIter=50, **more)


def forest(trees: int = 20, depth: int = 6) -> Estimator:
    return RandomForestClassifier(featuresCol="features", labelCol="y", numTrees=trees, maxDepth=depth, seed=7)


def boosted(rounds: int = 10, depth: int = 4, holdout: str | None = None) -> Estimator:
    """Boosted trees; rows with holdout true aren't fitted, and rounds end where these gain less than 0.001."""
    early = {"validationIndicatorCol": holdout, "validationTol": 0.001} if holdout else {}
    return GBTClassifier(featuresCol="features", labelCol="y", maxIter=rounds, maxDepth=depth, seed=7, **early)


def tree(depth: int = 30) -> Estimator:
    """A tree as deep as Spark allows, which shows how much a model could memorise."""
    return DecisionTreeClassifier(featuresCol="features", labelCol="y", maxDepth=depth, seed=7)


def ridge() -> Estimator:
    """Ridge regression of the label, whose output a logistic regression turns into a probability."""
    linear = LinearRegression(featuresCol="features", labelCol="y", predictionCol="linear", regParam=0.01)
    return Pipeline(stages=[linear, VectorAssembler(inputCols=["linear"], outputCol="score"), LogisticRegression(featuresCol="score", labelCol="y")])


def out_of_fold(df: DataFrame, model: Estimator, key: str = "row_id", k: int = 3, holdout: str | None = None) -> DataFrame:
    """(key, fold, y, p): each row scored by a model of the other folds. df has features, y and fold. Folds, not rows, are
    looped over; scores stay distributed. holdout names a column for early stopping, true for a tenth of the rows. The
    rows are kept in memory while models are fitted."""
    if holdout:
        df = df.withColumn(holdout, uniform("early", F.col(key)) < 0.1)
    df = df.persist()
    try:
        models = [model.fit(df.where(F.col("fold") != i)) for i in range(k)]
    finally:
        df.unpersist()
    return union([m.transform(df.where(F.col("fold") == i)).select(key, "fold", "y", vector_to_array("probability")[1].alias("p")) for i, m in enumerate(models)])


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def out_of_fold_smote(df: DataFrame, columns: list[str], model: Estimator, ratio: float, key: str = "row_id", k: int = 3) -> DataFrame:
    """(key, fold, y, p): out of fold as above, where each model is fitted on its folds and synthetic rows made of them alone."""
    parts = []
    for i in range(k):
        train = df.where(F.col("fold") != i)
        made = smote(train, columns, "y", key, ratio).select(F.lit(1).alias("y"), *columns)
        fitted = model.fit(assemble(train.select("y", *columns).unionByName(made), columns))
        parts.append(fitted.transform(assemble(df.where(F.col("fold") == i), columns)).select(key, "fold", "y", vector_to_array("probability")[1].alias("p")))
    return union(parts)


def averaged_over_folds(train: DataFrame, test: DataFrame, model: Estimator, key: str = "row_id", k: int = 3, columns: list[str] | None = None) -> DataFrame:
    """(key, p): test rows' mean score over the models of the training folds. A row's scores are columns side by side. What the
    models read of the training rows is written once, so that a fit doesn't join and place them in folds again: features, or if
    given the columns that these are then made of, which take less room."""
    scored, train = test, checkpointed(train.select(*(columns or ["features"]), "y", "fold"))
    if columns:
        scored, train = assemble(test, columns), assemble(train, columns)
    for i in range(k):
        fitted = model.fit(train.where(F.col("fold") != i))
        scored = fitted.transform(scored).withColumn(f"_p{i}", vector_to_array("probability")[1]).drop("rawPrediction", "probability", "prediction")
    return scored.select(key, (sum((F.col(f"_p{i}") for i in range(k)), F.lit(0.0)) / k).alias("p"))


def projected(df: DataFrame, fitted_on: DataFrame, vector: str, target: float = 0.95) -> DataFrame:
    """df with pc, its vectors on the first components of fitted_on's PCA that explain ``target`` of the variance."""
    raw = lambda x: x.withColumn("_raw", array_to_vector(vector))
    centre = StandardScaler(inputCol="_raw", outputCol="_x", withMean=True, withStd=False).fit(raw(fitted_on))
    rows = centre.transform(raw(fitted_on))
    found = PCA(k=centre.mean.size, inputCol="_x", outputCol="_pc").fit(rows)
    kept = int(np.searchsorted(np.cumsum(found.explainedVariance.toArray()), target - 1e-12)) + 1
    out = found.transform(centre.transform(raw(df)))
    return out.withColumn("pc", F.slice(vector_to_array("_pc"), 1, kept)).drop("_raw", "_x", "_pc")


def clusters(df: DataFrame, vector: str, sizes: tuple[int, ...], seed: int = 7) -> DataFrame:
    """df with cluster_k and nearest_k, the distance to the own centre, for each number k of clusters."""
    for k in sizes:
        found = cluster_distances(df, vector, k, seed)
        own = F.least(*(F.col(f"distance_{i}") for i in range(k))) if k > 1 else F.col("distance_0")
        df = found.withColumn(f"nearest_{k}", own).withColumnRenamed("cluster", f"cluster_{k}").drop(*(f"distance_{i}" for i in range(k)))
    return df


def adversarial_auc(train: DataFrame, test: DataFrame, columns: list[str], key: str) -> DataFrame:
    """How well a forest tells train from test, out of fold: 0.5 where there is no drift."""
    both = train.select(key, *columns, F.lit(0).alias("y")).unionByName(test.select(key, *columns, F.lit(1).alias("y")))
    scored = out_of_fold(folds(assemble(both, columns), key, 3, "y"), forest(10, 5), key)
    return auc(scored, "y", "p")


def stacked(df: DataFrame, models: dict[str, Estimator], key: str = "row_id") -> DataFrame:
    """(key, p): a logistic model of the out-of-fold scores of several models, itself scored out of fold."""
    base = df.select(key, "y", "fold")
    for name, model in models.items():
        base = base.join(out_of_fold(df, model, key).select(key, F.col("p").alias(name)), key)
    return out_of_fold(assemble(base, list(models)), logistic(), key).select(key, "p")


def explained(df: DataFrame, vector: str, target: float = 0.95) -> DataFrame:
    """(component, variance, cumulative, kept) of a PCA on centred columns; the first components that reach target are kept."""
    v = df.select(array_to_vector(vector).alias("raw"))
    centred = StandardScaler(inputCol="raw", outputCol="x", withMean=True, withStd=False).fit(v).transform(v)
    k = centred.first()["x"].size
    found = PCA(k=k, inputCol="x", outputCol="pc").fit(centred).explainedVariance.toArray().tolist()
    rows, total = [], 0.0
    for i, share in enumerate(found):
        rows.append((i, float(share), total + share, total < target))
        total += share
    return df.sparkSession.createDataFrame(rows, "component int, variance double, cumulative double, kept boolean")


def cluster_distances(df: DataFrame, vector: str, k: int = 8, seed: int = 7) -> DataFrame:
    """df with cluster and the distance to each of k centres."""
    v = df.withColumn("features", array_to_vector(vector))
    fitted = KMeans(k=k, seed=seed).fit(v)
    x = F.col(vector)
    gaps = [F.sqrt(F.aggregate(F.zip_with(x, F.array(*map(F.lit, c.tolist())), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, y: s + y)) for c in fitted.clusterCenters()]
    return fitted.transform(v).withColumnRenamed("prediction", "cluster").withColumns({f"distance_{i}": g for i, g in enumerate(gaps)}).drop("features")


def normal_quantile(p: Column) -> Column:
    """The inverse of the normal distribution function, to about 1e-9: a rational approximation (Acklam's published
    coefficients) in the middle and in the tails."""
    # The published coefficients.
    a = [-39.69683028665376, 220.9460984245205, -275.9285104469687, 138.3577518672690, -30.66479806614716, 2.506628277459239]
    b = [-54.47609879822406, 161.5858368580409, -155.6989798598866, 66.80131188771972, -13.28068155288572, 1.0]
    c = [-0.007784894002430293, -0.3223964580411365, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783]
    d = [0.007784695709041462, 0.3224671290700398, 2.445134137142996, 3.754408661907416, 1.0]

    def poly(k: list[float], x: Column) -> Column:
        out = F.lit(k[0])
        for v in k[1:]:
            out = out * x + v
        return out

    mid, tail = p - 0.5, lambda q: F.sqrt(-2 * F.log(q))
    return F.when(p < 0.02425, poly(c, tail(p)) / poly(d, tail(p))).when(p > 1 - 0.02425, -poly(c, tail(1 - p)) / poly(d, tail(1 - p))).otherwise(poly(a, mid * mid) * mid / poly(b, mid * mid))


def quantile_normal(df: DataFrame, column: str, fitted_on: DataFrame, knots: int = 100, clip: float = 1e-7) -> DataFrame:
    """df with the column mapped to a normal law through fitted quantiles: linear between knots, the middle of a flat stretch.
    A value finds its knots by binary search, a batch of rows at a time; only the column goes to Python."""
    found = quantiles(fitted_on, {column: [i / (knots - 1) for i in range(knots)]})[column]
    q = np.array([v for v in found if v is not None], float)

    def share(values: pa.Array) -> pa.Array:
        x = pc.fill_null(values, 0.0).to_numpy(zero_copy_only=False)
        below, upto = np.searchsorted(q, x, "left"), np.searchsorted(q, x, "right")
        u = np.where(upto > below, (below + upto - 1) / 2 / (knots - 1), np.where(below > 0, 1.0, 0.0))
        i = np.flatnonzero((upto == below) & (below > 0) & (below < len(q)))
        low, high = q[below[i] - 1], q[below[i]]
        u[i] = (below[i] - 1 + (x[i] - low) / (high - low)) / (knots - 1)
        u[below >= len(q)] = 1.0 if len(q) else 0.0
        return pa.array(np.clip(u, clip, 1 - clip), mask=pc.is_null(values).to_numpy(zero_copy_only=False))

    u = F.arrow_udf(share, "double")(F.col(column).cast("double"))
    return df.withColumn("_u", u).withColumn(column, normal_quantile(F.col("_u"))).drop("_u")


def arm_search(df: DataFrame, arms: dict[str, list[str]], weights: tuple[float, ...]) -> DataFrame:
    """(arm, weight, f1), best first: logistic models of each set of columns and weight of positives, fitted on the folds but
    the first, with their F1 on that. The search loops over arms, whose number is a parameter."""
    rows, df = [], df.persist()
    try:
        for arm, columns in arms.items():
            for weight in weights:
                w = assemble(df, columns).withColumn("w", F.when(F.col("y") == 1, weight).otherwise(1.0))
                p = logistic(weightCol="w").fit(w.where("fold <> 0")).transform(w.where("fold = 0"))
                hit = p.agg(F.sum(F.col("y") * F.col("prediction")).alias("tp"), F.sum("y").alias("pos"), F.sum("prediction").alias("said")).first()
                rows.append((arm, weight, 2 * hit.tp / (hit.pos + hit.said) if hit.pos + hit.said else 0.0))
    finally:
        df.unpersist()
    return df.sparkSession.createDataFrame(sorted(rows, key=lambda r: (-r[2], r[0], r[1])), "arm string, weight double, f1 double")


def store_bundle(train: DataFrame, columns: list[str], models: list[Estimator]) -> str:
    """The folder of a bundle: for each model a pipeline that scales and assembles the columns as train's are, and the model, fitted
    on train, which has a label y."""
    folder = f"{shared_folder(train.sparkSession)}/bundle-{uuid.uuid4().hex}"
    for i, model in enumerate(models):
        stages = [VectorAssembler(inputCols=columns, outputCol="_raw", handleInvalid="keep"), StandardScaler(inputCol="_raw", outputCol="features", withMean=True), model]
        Pipeline(stages=stages).fit(train).write().overwrite().save(f"{folder}/{i}")
    train.sparkSession.createDataFrame([(len(models), columns)], "models int, columns array<string>").write.json(f"{folder}/bundle")
    return folder


def serve_bundle(spark: SparkSession, folder: str, df: DataFrame, key: str = "row_id") -> DataFrame:
    """(key, p): the mean score of all models of a stored bundle for rows that have its columns; missing ones are an error."""
    known = spark.read.schema("models int, columns array<string>").json(f"{folder}/bundle").first()
    if lost := sorted(set(known.columns) - set(df.columns)):
        raise ValueError(f"columns are missing: {lost}")
    for i in range(known.models):
        df = PipelineModel.load(f"{folder}/{i}").transform(df).withColumn(f"_p{i}", vector_to_array("probability")[1]).drop("_raw", "features", "rawPrediction", "probability", "prediction")
    return df.select(key, (sum((F.col(f"_p{i}") for i in range(known.models)), F.lit(0.0)) / known.models).alias("p"))


def minibatch_centres(df: DataFrame, vector: str, key: str, k: int, batches: int = 12, epochs: int = 2, seed: int = 7, sample: int = 4096) -> np.ndarray:
    """k centres that move with each batch of rows to the mean of all rows they have had so far, in batches by a hash of the key;
    the first centres are drawn from a sample of at most ``sample`` rows, each the further from the others the likelier.

    Sums are of whole numbers, the vectors in steps of a 2^30th of their largest number, so the centres don't depend on how rows
    are dealt to tasks. Rows whose vector is null or holds null or non-finite numbers are left out."""
    rows = df.select(F.col(key).alias("_key"), F.col(vector).alias("v")).where(F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < float("inf"))))
    first = np.array([r.v for r in rows.orderBy(F.xxhash64("_key", F.lit(seed)), "_key").limit(sample).collect()], float)
    if not len(first):
        raise ValueError("no rows to cluster")
    rng, chosen = np.random.default_rng(seed), [first[0]]
    for _ in range(1, min(k, len(first))):
        gap = np.min([((first - c) ** 2).sum(axis=1) for c in chosen], axis=0)
        best = [rng.choice(len(first), p=gap / gap.sum()) if gap.sum() else 0 for _ in range(4)]
        chosen.append(first[min(best, key=lambda i: np.minimum(gap, ((first - first[i]) ** 2).sum(axis=1)).sum())])
    centres, dims = np.array(chosen), first.shape[1]
    most = rows.agg(F.max(F.array_max(F.transform("v", F.abs)))).first()[0] or 1.0
    step = most / (1 << 30)

    def assign(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            x = part.column(0).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, dims)
            own, whole = nearest_centre(x, centres), np.rint(x / step).astype(np.int64)
            sums, n = np.zeros((len(centres), dims), np.int64), np.bincount(own, minlength=len(centres))
            np.add.at(sums, own, whole)
            yield pa.record_batch([pa.array(range(len(centres)), pa.int32()), pa.array(n), pa.array(sums.tolist(), pa.list_(pa.int64()))], ["c", "n", "sums"])

    weight = np.zeros(len(centres))
    batch = F.pmod(F.xxhash64("_key", F.lit(seed + 1)), F.lit(batches))
    for e in range(epochs * batches):
        found = rows.where(batch == e % batches).select("v").mapInArrow(assign, "c int, n long, sums array<long>")
        total = found.groupBy("c").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("sums")[i].cast("decimal(38,0)")) for i in range(dims))).alias("sums")).collect()
        for r in total:
            if r.n:
                weight[r.c] += r.n
                centres[r.c] += (np.array([float(s) for s in r.sums]) * step / r.n - centres[r.c]) * (r.n / weight[r.c])
    return centres


def nearest_centre(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest centre of each row, of equal ones the first; dimensions are added in order, so a row's gaps are its own."""
    gap = np.zeros((len(x), len(centres)))
    for i in range(x.shape[1]):
        gap += (x[:, i, None] - centres[None, :, i]) ** 2
    return gap.argmin(axis=1)


def labelled(df: DataFrame, vector: str, centres: np.ndarray) -> DataFrame:
    """df with cluster and nearest, the number of the nearest centre and the distance to it."""
    gaps = F.array(*(F.aggregate(F.zip_with(vector, F.lit(c.tolist()), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, y: s + y) for c in centres))
    rows = df.withColumn("_gaps", gaps).withColumn("nearest", F.sqrt(F.array_min("_gaps")))
    return rows.withColumn("cluster", (F.array_position("_gaps", F.array_min("_gaps")) - 1).cast("int")).drop("_gaps")


def smote(df: DataFrame, columns: list[str], label: str, key: str, ratio: float, k: int = 5, cells: int = 1, sides: list[str] | None = None) -> DataFrame:
    """Synthetic minority rows, enough for ``ratio`` of the majority: between a row and one of its k nearest neighbours, at
    a share drawn from an md5; categories in ``sides`` take the most frequent value among the k neighbours, the smallest of equals.
    Between neighbours a category that differs counts as the median of the minority's standard deviations."""
    n = {r[label]: r["count"] for r in df.groupBy(label).count().collect()}
    want = max(0, int(ratio * n.get(0, 0)) - n.get(1, 0))
    rare = df.where(F.col(label) == 1)
    near = checkpointed(neighbours(rare, columns, key, k, cells, sides, nominal_penalty(rare, columns) if sides else 0.0))
    if sides:
        most = near.groupBy("source").agg(*(F.mode(c, True).alias(c) for c in sides))
        near = near.drop(*sides).join(most, "source")
    times = math.ceil(want / max(1, n.get(1, 0)))
    drawn = near.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(max(1, times))))).withColumn("u", uniform(F.concat_ws(":", "source", "neighbour", "copy")))
    one = drawn.withColumn("r", F.row_number().over(Window.partitionBy("source", "copy").orderBy("u", "neighbour"))).where("r = 1")
    share = uniform(F.concat_ws("|", "source", "copy"))
    minority = df.where(F.col(label) == 1).select(F.col(key).alias("source"))
    place = dealt(minority, F.md5(F.col("source").cast("string").cast("binary")), ["source"], name="_at")
    rows = one.join(place, "source").where((F.col("copy") - 1) * n.get(1, 0) + F.col("_at") < want)  # the first in the order of copy and md5
    return rows.select("source", "copy", *((F.col("v")[i] + share * (F.col("w")[i] - F.col("v")[i])).alias(c) for i, c in enumerate(columns)), *(sides or []))
