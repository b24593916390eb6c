"""Readers and the labelled frames that queries work on."""

from __future__ import annotations

import tempfile
from collections.abc import Callable
from hashlib import sha256

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_csv(spark: SparkSession, path: str, schema: str | None = None, columns: list[str] | None = None) -> DataFrame:
    """A CSV file or folder with headers: with a declared schema, else one inferred in a pass of its own; only ``columns``,
    if given, are parsed."""
    reader = spark.read.schema(schema) if schema else spark.read.option("inferSchema", True)
    df = reader.csv(path, header=True, escape='"')
    return df.select(*columns) if columns else df


def write_csv(df: DataFrame, path: str) -> None:
    """A folder of CSV part files with headers, written by all executors."""
    df.write.mode("overwrite").csv(path, header=True, escape='"')


def write_report(df: DataFrame, path: str, separator: str = " | ") -> None:
    """A folder of text files with a line for each row: its values, null as an empty string."""
    df.select(F.concat_ws(separator, *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns)).alias("line")).write.mode("overwrite").text(path)


def decode_stream(spark: SparkSession, folder: str, schema: str, out: str, decode: Callable[[DataFrame], DataFrame]) -> None:
    """The CSV files of a folder, with headers and a declared schema, decoded row by row to CSV files in another. Ends when all files
    are read; what was read is kept beside the output, so a later run takes only files that are new, each once even if a run
    is broken off."""
    rows = spark.readStream.schema(schema).csv(folder, header=True, escape='"')
    sink = decode(rows).writeStream.format("csv").option("header", True).option("path", out).option("checkpointLocation", f"{out}-progress")
    sink.trigger(availableNow=True).start().awaitTermination()


def schema_digest(df: DataFrame) -> str:
    """A digest of the names and types of the columns, in order."""
    return sha256(df.schema.simpleString().encode()).hexdigest()


def sealed(fitted: DataFrame, source: DataFrame) -> DataFrame:
    """A fitted frame that carries, with its first column, digests of the schema and of the plan that it was fitted on; they are
    stored and read with it."""
    first = fitted.columns[0]
    return fitted.withMetadata(first, {"fitted_schema": schema_digest(source), "fitted_plan": str(source.semanticHash())})


def check_seal(fitted: DataFrame, df: DataFrame, plan: bool = False) -> None:
    """An error unless df has the schema that the frame was fitted on; with ``plan``, also the same plan, so that a fit can be told
    to be that of df itself."""
    seal = fitted.schema[0].metadata
    if "fitted_schema" not in seal:
        raise ValueError("the fitted frame has no seal")
    if seal["fitted_schema"] != schema_digest(df):
        raise ValueError("the schema differs from the one that was fitted on")
    if plan and seal["fitted_plan"] != str(df.semanticHash()):
        raise ValueError("the plan differs from the one that was fitted on")


def schema_checks(train: DataFrame, test: DataFrame, target: str, key: str) -> DataFrame:
    """(check, ok): target and key are there, the key is first, the key is last, test has train's columns in order but for the target."""
    names, other = train.columns, [c for c in test.columns if c != target]
    rows = [("target_present", target in names), ("key_present", key in names), ("key_first", names[:1] == [key]), ("key_last", names[-1:] == [key]), ("same_order", [c for c in names if c != target] == other)]
    return train.sparkSession.createDataFrame(rows, "check string, ok boolean")


def first_existing(spark: SparkSession, candidates: list[str]) -> str:
    """The first of the paths that exists, in whatever file system it names."""
    for path in candidates:
        try:
            spark.read.format("binaryFile").load(path).schema  # analysis looks for the path
            return path
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
    raise FileNotFoundError(f"none of {candidates} exists")


def all_columns(*frames: DataFrame) -> list[str]:
    """The union of the frames' column names, sorted."""
    return sorted({c for df in frames for c in df.columns})


def contract_columns(df: DataFrame, order: list[str]) -> tuple[DataFrame, list[str]]:
    """df in a saved column order, and the columns that it has beyond; missing ones are an error."""
    missing = sorted(set(order) - set(df.columns))
    if missing:
        raise ValueError(f"columns are missing: {missing}")
    return df.select(*order), [c for c in df.columns if c not in order]


def shared_folder(spark: SparkSession) -> str:
    """Where all executors can read what others write: the session's spark.checkpoint.dir; unset, a temporary folder, but only if
    driver and executors are one machine, as in tests."""
    named, master = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.master
    if not named and (not master.startswith("local") or master.startswith("local-cluster")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return named or tempfile.mkdtemp(prefix="shared")


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows of df, from the checkpoint folder: they stay as they are however often they are read, and whoever is lost."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def wide(spark: SparkSession, folder: str) -> DataFrame:
    """Orders with their customers: row_id, numbers, categories, labels y and y4, is_train by date."""
    o, c = read(spark, folder, "orders"), read(spark, folder, "customer")
    urgent = (F.col("o_orderstatus") == "F") & (F.col("o_orderpriority") == "1-URGENT")
    key = F.col("o_orderkey")
    return o.join(c, o.o_custkey == c.c_custkey).select(
        key.alias("row_id"), "o_totalprice", "c_acctbal", F.col("c_nationkey").cast("double").alias("c_nationkey"), F.col("o_custkey").cast("double").alias("custkey"),
        F.col("o_custkey").cast("string").alias("cust"), "o_orderpriority", "c_mktsegment", (F.col("o_orderstatus") == "F").cast("int").alias("y"), urgent.cast("int").alias("y4"),
        (F.col("o_orderdate") < F.lit("2000-01-01").cast("timestamp")).cast("int").alias("is_train"),
        F.when(key % 650 == 0, F.lit(-999999.0)).otherwise(F.col("c_acctbal")).alias("sent"), F.when(key % 10 < 9, F.lit(0.0)).otherwise(F.col("o_totalprice")).alias("sparse"))


#: The same frame in SQL.
WIDE = """wide AS (SELECT o_orderkey AS row_id, o_totalprice, c_acctbal, c_nationkey::DOUBLE AS c_nationkey, o_custkey::DOUBLE AS custkey,
 o_custkey::VARCHAR AS cust, o_orderpriority, c_mktsegment, (o_orderstatus = 'F')::INT AS y, (o_orderstatus = 'F' AND o_orderpriority = '1-URGENT')::INT AS y4,
 (o_orderdate < TIMESTAMP '2000-01-01')::INT AS is_train, CASE WHEN o_orderkey % 650 = 0 THEN -999999.0::DOUBLE ELSE c_acctbal END AS sent,
 CASE WHEN o_orderkey % 10 < 9 THEN 0.0::DOUBLE ELSE o_totalprice END AS sparse FROM orders JOIN customer ON o_custkey = c_custkey)"""


def scores(spark: SparkSession, folder: str) -> DataFrame:
    """Events as scored rows: id, y (a purchase) and s (their value)."""
    return read(spark, folder, "events").select(F.col("event_id").alias("id"), (F.col("event_type") == "purchase").cast("int").alias("y"), F.col("value").alias("s"))


SCORES = "scores AS (SELECT event_id AS id, (event_type = 'purchase')::INT AS y, value AS s FROM events)"
