"""What several operators share: reading, checkpoints, held-out rows, components of a graph, union-find in a task."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir, which all executors share. Where it names none, a temporary
    one, but only if driver and executors are one machine, as in tests."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and (not context.master.startswith("local") or context.master.startswith("local-cluster")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints"))
    return spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows of df, from the checkpoint folder: later work doesn't go back behind it when executors are lost."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def numbered_rows(docs: DataFrame) -> DataFrame:
    """docs with _file and _row, which name each row, the same whenever docs are read again: a hash of the file and the place in
    it, or for rows that no file has places in a checkpoint."""
    try:
        return docs.select("*", F.xxhash64("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    except AnalysisException:
        return checkpointed(docs).select("*", F.lit(0).cast("long").alias("_file"), F.monotonically_increasing_id().alias("_row"))


def partitions(df: DataFrame, rows: int, rows_each: int) -> int:
    """Shuffle partitions for so many rows, so that a task that gathers its partition stays small."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // rows_each))


def held_out(doc_id: str = "doc_id"):
    """True for the rows that labels are never learnt from."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, bound: int) -> DataFrame:
    """(text, label) of at most ``bound`` labelled rows that aren't held out, the first in the order of a hash of doc_id.

    Only the ids and labels of the sample are broadcast; ``bound`` limits their size. A doc_id that is null, or
    labelled more than once, counts once or not at all: labels are grouped by doc_id and averaged, ties are dropped. Of the
    documents of one doc_id the least text counts, so there are no more rows than ids."""
    one = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out()).groupBy("doc_id").agg(F.avg(label).alias("label"))
    one = one.where(F.col("label") != 0.5).withColumn("label", (F.col("label") > 0.5).cast("int"))
    sample = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    found = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    return found.select(F.coalesce("text", F.lit("")).alias("text"), "label")


def scored(docs: DataFrame, scorer: Callable[[], Callable[[list[str]], object]], *keep: str) -> DataFrame:
    """The kept columns of docs and score, which takes the place of a kept one of that name: a task makes a scorer, which gives a
    number for each text of a batch (null: empty)."""
    kept = [c for c in keep if c != "score"]
    schema = StructType([docs.schema[c] for c in kept] + [StructField("score", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = scorer()
        for batch in batches:
            texts = [t or "" for t in batch.column(0).to_pylist()]
            yield pa.record_batch([*batch.columns[1:], pa.array(score(texts), pa.float64())], [*kept, "score"])

    rows = docs.select(F.col("text").cast("string"), *(F.col(f"`{c}`") for c in kept))
    return rows.toDF(*(f"_{i}" for i in range(len(kept) + 1))).mapInArrow(run, schema)


class Union:
    """Union-find over 0..n-1 whose root is the smallest member; for the links that one task has found."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        """Join a[i] with b[i]: hook the larger root on the smaller one, halve paths, until all agree."""
        while True:
            ra, rb = self.root[a], self.root[b]
            differ = ra != rb
            if not differ.any():
                return
            a, b = a[differ], b[differ]
            low, high = np.minimum(ra, rb)[differ], np.maximum(ra, rb)[differ]
            np.minimum.at(self.root, high, low)
            while True:
                up = self.root[self.root]
                if (up == self.root).all():
                    break
                self.root = up


def hot_keys(rows: DataFrame, key: str, bound: int = 10_000, least: int = 1000) -> DataFrame:
    """(key): the keys that more than a ``bound``th of the rows have, and more than ``least``; at most ``bound`` keys."""
    count = rows.groupBy(key).agg(F.count("*").alias("n"))
    return checkpointed(count.where(F.col("n") > max(least, rows.count() // bound)).select(key))


def looked_up(rows: DataFrame, key: str, table: DataFrame, hot: DataFrame | None = None) -> DataFrame:
    """rows, which have no null key, left-joined to a table that has each key once. Hot keys, whose number is bounded, go
    to every task with their rows of the table; only the others are dealt by key, so none brings a task many rows."""
    hot = hot_keys(rows, key) if hot is None else hot
    if hot.isEmpty():
        return rows.join(table, key, "left")
    few = hot.join(table.join(F.broadcast(hot), key), key, "left")
    rest = rows.join(F.broadcast(hot), key, "left_anti").join(table, key, "left")
    return rows.join(F.broadcast(few), key).unionByName(rest)


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for every node of links (a, b): the smallest node that links reach.

    Each round takes the smallest label among neighbours and then jumps to the label's own label, so a chain of n
    nodes needs about log n rounds. Labels are checkpointed, so an executor that is lost costs no earlier round. A node
    with many links, and a label that many nodes have, are looked up apart (looked_up).
    Rows with a null end are left out; links to oneself give the node itself."""
    links = links.where("a is not null and b is not null")
    both = checkpointed(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    hubs = hot_keys(both, "b")
    label = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label"))
    for _ in range(rounds):
        label = checkpointed(label)
        near = looked_up(both, "b", label.withColumnRenamed("node", "b"), hubs).groupBy("a").agg(F.min("label").alias("m"))
        step = checkpointed(label.join(near.withColumnRenamed("a", "node"), "node").select("node", "label", F.least("label", "m").alias("next")))
        up = label.select(F.col("node").alias("next"), F.col("label").alias("jump"))
        step = checkpointed(looked_up(step, "next", up).select("node", "label", F.least("next", "jump").alias("next")))
        label = step.select("node", F.col("next").alias("label"))
        if step.where("next <> label").isEmpty():
            return label.select("node", F.col("label").alias("component"))
    raise RuntimeError(f"components did not settle in {rounds} rounds")


#: Bits of a filter at most.
BITS = 1 << 28


class Filter:
    """Which hashes may be in a set: a bit for each value modulo the number of bits, none of the set's missing. Bits follow the
    set up to BITS; beyond, more others pass."""

    def __init__(self, hashes: DataFrame):
        """The set is hashes.h."""
        self.mask = min(BITS, 1 << max(16, (32 * hashes.count()).bit_length())) - 1
        bit = F.col("h").bitwiseAND(F.lit(self.mask)) + 1
        parts = hashes.groupBy(F.bitmap_bucket_number(bit).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits")).collect()  # BITS / 8 bytes at most
        self.bits = np.zeros((self.mask + 1) // 8, np.uint8)
        for r in parts:
            self.bits[(r.k - 1) * 4096 : r.k * 4096] = np.frombuffer(bytes(r.bits), np.uint8)[: len(self.bits)]

    def __call__(self, h: np.ndarray) -> np.ndarray:
        bit = (h & np.uint64(self.mask)).astype(np.int64)
        return (self.bits[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 > 0


class Table(dict):
    """key -> made(key), kept in two generations of at most ``size`` keys: keys in use survive, memory stays bounded."""

    size = 250_000

    def __init__(self):
        self.old: dict = {}

    def made(self, key):
        raise NotImplementedError

    def __missing__(self, key):
        got = self.old.get(key)
        if got is None:
            got = self.made(key)
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        self[key] = got
        return got


def blocks(text: str, size: int = 1 << 20):
    """A text in blocks of about size characters that end where ASCII white space begins, so that long texts cost little memory."""
    at = 0
    while at < len(text):
        stop = at + size
        while stop < len(text) and text[stop] not in " \n\t\r":
            stop += 1
        yield text[at:stop] if at or stop < len(text) else text
        at = stop
