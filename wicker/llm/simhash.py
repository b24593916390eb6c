"""SimHash near-dedup: fingerprints of word shingles, candidates by pigeonring chains, groups by connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from wicker.llm.common import Filter, Union, checkpointed, components, looked_up, numbered_rows, partitions

SEED = 42  # fixed value: the hash's seed
#: The ring of segments: first bit and width of each.
SEGMENTS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
DISTANCE = 4
#: Shingles whose bits are held at once.
BLOCK = 1 << 15
#: Fingerprints of a bucket that one task compares with each other; those of larger buckets are compared block by block.
CROWD = 4096


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """The majority bits of the shingles' XXH64. Only A-Z is lower-cased, only ASCII white space parts words; a text of
    fewer words is one shingle; a null text or one without words gives 0. Whole texts count, in blocks."""
    words = text.encode().lower().split() if text else ()
    if not words:
        return 0
    digest, whole = xxhash.xxh64_intdigest, b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    width = min(shingle, len(words))
    starts, stops = (np.concatenate(([0], ends[:-1]))[: len(words) - width + 1]).tolist(), (ends[width - 1 :] - 1).tolist()
    ones = np.zeros(64, np.int64)
    for i in range(0, len(starts), BLOCK):
        h = np.array([digest(whole[a:b], SEED) for a, b in zip(starts[i : i + BLOCK], stops[i : i + BLOCK])], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(starts), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 4, *keep: str) -> DataFrame:
    """(doc_id, fp, kept columns): the fingerprint as a signed long. Other columns of docs are left out."""
    schema = StructType([StructField("doc_id", LongType()), StructField("fp", LongType()), *(docs.schema[c] for c in keep)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.fromiter((fingerprint(x, shingle) for x in batch.column(1).to_pylist()), np.uint64, batch.num_rows)
            yield pa.record_batch([batch.column(0), pa.array(fp.view(np.int64)), *batch.columns[2:]], schema.names)

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *(F.col(f"`{c}`") for c in keep))
    return rows.toDF(*(f"_{i}" for i in range(len(keep) + 2))).mapInArrow(run, schema)


def chain_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys under which fingerprints meet, and the row of fp for each key.

    Of 5 segments in a ring, 4 differing bits leave a start from which the first l segments differ in at most 4l/5
    bits together, for every l: the first in none, the first two in at most one. A key is the start, its segment and
    the next one. Each fingerprint has its own 5 keys, and for each set bit of a next segment the key with that bit
    cleared: of two that differ in one bit there, one has it set. Bit 0 of a key tells the first kind from the second."""
    keys, rows, all_rows = [], [], np.arange(len(fp))
    for i, (at, width) in enumerate(SEGMENTS):
        to, w = SEGMENTS[(i + 1) % len(SEGMENTS)]
        first, after = fp >> np.uint64(at) & np.uint64((1 << width) - 1), fp >> np.uint64(to) & np.uint64((1 << w) - 1)
        head = np.uint64(i << 27) | first << np.uint64(14)
        keys.append(head | after << np.uint64(1) | np.uint64(1))
        rows.append(all_rows)
        for b in range(w):
            has = all_rows[(after >> np.uint64(b) & np.uint64(1)).astype(bool)]
            keys.append(head[has] | (after[has] & ~np.uint64(1 << b)) << np.uint64(1))
            rows.append(has)
    return np.concatenate(keys), np.concatenate(rows)


def near_pairs(run: np.ndarray, start: np.ndarray, own: np.ndarray, fp: np.ndarray, distance: int = DISTANCE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of positions within runs (equal numbers stand together) whose fingerprints link; start is the segment where a run's
    chain begins. At least one of the two must have the run's key as its own. Chains are pruned by their cumulative
    differences, then all bits count."""
    near, step = np.arange(len(fp)), 0
    while True:
        step += 1
        near = near[: np.searchsorted(near, len(fp) - step)]
        near = near[run[near] == run[near + step]]
        if not len(near):
            return
        a = near[own[near] | own[near + step]]
        x = fp[a] ^ fp[a + step]
        a, x = a[x != 0], x[x != 0]
        spent = np.zeros(len(a), np.int64)
        for length in range(1, len(SEGMENTS) + 1):
            at = (start[a] + length - 1) % len(SEGMENTS)
            shift, mask = (np.array([f(s) for s in SEGMENTS], np.uint64)[at] for f in (lambda s: s[0], lambda s: (1 << s[1]) - 1))
            spent = spent + np.bitwise_count(x >> shift & mask)
            keep = spent <= length * distance // len(SEGMENTS)
            a, x, spent = a[keep], x[keep], spent[keep]
        a = a[np.bitwise_count(x) <= distance]
        if len(a):
            yield a, a + step


def crowded(keys: DataFrame, few: int = 100_000) -> DataFrame:
    """keys (bucket, own, fp) dealt to pairs of blocks, one and two: for buckets with more than CROWD fingerprints, one of
    which has it as its own, every two blocks meet; all others are a block of themselves. Up to ``few`` large buckets are
    broadcast."""
    size = keys.groupBy("bucket").agg(F.count("*").alias("n"), F.bool_or("own").alias("any"))
    large = checkpointed(size.where(F.col("any") & (F.col("n") > CROWD)).select("bucket", "n"))
    if large.isEmpty():
        return keys.select("bucket", F.lit(0).alias("one"), F.lit(0).alias("two"), "own", "fp")
    large = F.broadcast(large) if large.count() <= few else large
    k = F.coalesce(F.ceil(F.col("n") / (CROWD // 2)).cast("int"), F.lit(1))
    dealt = keys.join(large, "bucket", "left").withColumn("k", k).withColumn("mine", F.pmod(F.xxhash64("fp"), F.col("k")).cast("int"))
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    return met.select("bucket", F.least("mine", "other").alias("one"), F.greatest("mine", "other").alias("two"), "own", "fp")


def scattered(bucket: np.ndarray) -> np.ndarray:
    """The bucket's bits spread, as filters take their lowest ones."""
    with np.errstate(over="ignore"):
        h = bucket.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ h >> np.uint64(32)


def keyed(fps: DataFrame) -> DataFrame:
    """(bucket, own, fp): the fingerprints under their own keys, and under those with a cleared bit that some fingerprint may have
    as its own: most of them meet nobody, and a filter of bounded size tells."""

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = chain_keys(batch.column(0).to_numpy().view(np.uint64))[0]
            yield pa.record_batch([pa.array(scattered(key[key & np.uint64(1) > 0] >> np.uint64(1)).view(np.int64))], ["h"])

    wanted = Filter(fps.select("fp").mapInArrow(own, "h long").distinct())

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy().view(np.uint64)
            key, row = chain_keys(fp)
            met = np.flatnonzero((key & np.uint64(1) > 0) | wanted(scattered(key >> np.uint64(1))))
            key, row = key[met], row[met]
            yield pa.record_batch([pa.array((key >> np.uint64(1)).astype(np.int64)), pa.array((key & np.uint64(1)).astype(bool)), pa.array(fp[row].view(np.int64))], ["bucket", "own", "fp"])

    return fps.select("fp").mapInArrow(spread, "bucket long, own boolean, fp long")


def near_links(fps: DataFrame, n: int) -> DataFrame:
    """(a, b): links between n distinct fingerprints fp, thinned to a forest within each task, so that a group of many
    near copies gives as many rows as it has members, not as many as it has pairs."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [[c.to_numpy(zero_copy_only=False) for c in batch.columns] for batch in batches if batch.num_rows]
        if not parts:
            return
        bucket, one, two, own, fp = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((fp, two, one, bucket)) if two.any() else np.lexsort((fp, bucket))
        bucket, one, two, own, fp = (x[order] for x in (bucket, one, two, own, fp))
        run = np.cumsum(np.concatenate([[False], (np.diff(bucket) != 0) | (np.diff(one) != 0) | (np.diff(two) != 0)])[: len(fp)])
        led = np.bincount(run, weights=own)[run] > 0  # runs where nobody has the key as its own hold no pair
        run, bucket, own, fp = (x[led] for x in (run, bucket, own, fp))
        fp = fp.view(np.uint64)
        value, at = np.unique(fp, return_inverse=True)
        joined = Union(len(value))
        for a, b in near_pairs(run, bucket >> 26, own, fp):
            joined.link(at[a], at[b])
        member = np.flatnonzero(joined.root != np.arange(len(value)))
        yield pa.record_batch([pa.array(value[x].view(np.int64)) for x in (member, joined.root[member])], ["a", "b"])

    return crowded(keyed(fps)).repartition(partitions(fps, 37 * n, 2_000_000), "bucket", "one", "two").mapInArrow(meet, "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = 4, *keep: str) -> DataFrame:
    """(doc_id, fp, component_id, component, kept columns): documents whose fingerprints differ in at most 4 bits link;
    component_id is the smallest doc_id that links reach, component the smallest fingerprint, which names the group even
    where doc_ids are null or repeat.

    Equal fingerprints meet once: their rows count as one with the smallest doc_id. Every row of docs gives a row,
    repeated ones too; a null doc_id gets the component of its fingerprint's group (null if no other row has it); an
    empty table gives none. Other columns of docs are left out. A fingerprint or a component that many rows have is
    looked up apart (common.looked_up)."""
    fps = checkpointed(fingerprints(docs, shingle, *keep))
    one = checkpointed(fps.groupBy("fp").agg(F.min("doc_id").alias("first")))
    group = components(near_links(one, one.count()))
    rep = checkpointed(one.join(group.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("component", "fp").alias("component")))
    least = rep.groupBy("component").agg(F.min("first").alias("component_id"))
    whole = looked_up(rep, "component", least).select("fp", "component_id", "component")
    return looked_up(fps, "fp", whole).select("doc_id", "fp", "component_id", "component", *keep)


def representatives(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """docs with one row of each group alone: that with the smallest doc_id, of rows that repeat any one. Null doc_ids come
    last. Texts are dealt out only if the rows that go are too many to be sent to every task."""
    rows = numbered_rows(docs)
    key = ["_file", "_row"]
    group = checkpointed(near_duplicates(rows, shingle, *key))
    first = group.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", *key)).alias("k")).select("k._file", "k._row")
    gone = checkpointed(group.select(*key).join(first, key, "left_anti"))
    return rows.join(gone, key, "left_anti").drop(*key)
