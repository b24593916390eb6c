"""Conversation prefix trie: rebuilt conversations as paths of turns, and for each distinct prefix what its subtree holds.

A prefix is named by a chained digest of 128 bits over its turns. Conversations of the same turns are one path with their number
as its weight. A path belongs to the shard of its shallowest prefix that few paths share; each shard's trie is built in level order
in one task, as a bit vector of degrees (LOUDS) with the nodes' arrays beside it, and rolled up from the last level to the first.
Prefixes that many paths share are the upper levels, whose number is bounded; they take the shards' sums and are rolled up apart."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from wicker.llm.common import checkpointed, partitions

ROOT = bytes(16)
#: Paths that may share a prefix within a shard, at least; upper prefixes at most.
CROWD, UPPER = 32, 100_000

PATH = "conv_id long, depth int, key binary, up binary, chars long, last boolean"
NODE = "key binary, up binary, top boolean, conv_id long, depth int, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
NOBODY = sha256(b"").hexdigest()


def rebuilt(turns: DataFrame, block: int = 100, head: int = 6) -> DataFrame:
    """A row for each turn of each rebuilt conversation, with the digests of the prefix that it ends (key) and of the one before
    (up), and whether it is the last; a conversation without turns has one row at depth 0.

    A block's conversations are one task's, its first one before the others; rows are read one after another, so nothing is
    held but the first turns of the block's first conversation."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    mark = F.unhex(F.sha2(F.concat(F.octet_length(text("role")).cast("string"), F.lit(":"), text("role"), text("text")), 256))
    rows = turns.where("conv_id is not null").select("conv_id", "turn", mark.alias("mark"), F.length(text("text")).cast("long").alias("chars"))
    c = F.col("conv_id")
    rows = rows.withColumn("base", c - c % block).withColumn("h", (F.crc32(c.cast("string").cast("binary")) % head).cast("int")).withColumn("other", c != F.col("base"))

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, first, conv, seen, depth, key, pending = None, [], None, 0, 0, ROOT, None
        out: list[tuple] = []

        def add(mark: bytes, chars: int) -> None:
            nonlocal depth, key, pending
            if pending:
                out.append((*pending, False))
            up, depth = key, depth + 1
            key = sha256(key + mark).digest()[:16]
            pending = (conv, depth, key, up, chars)

        def done() -> None:
            if conv is not None:
                out.append((*(pending or (conv, 0, ROOT, None, 0)), True))

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.bool_())
            return pa.record_batch([pa.array(list(x), k) for x, k in zip(zip(*rows), kinds)], ["conv_id", "depth", "key", "up", "chars", "last"])

        for batch in batches:
            for b, c, h, mark, chars in zip(*(x.to_pylist() for x in batch.columns)):
                if c != conv:
                    done()
                    if b != base:
                        base, first = b, []
                    conv, seen, depth, key, pending = c, 0, 0, ROOT, None
                    if c != b:
                        for turn in first[:h]:
                            add(*turn)
                if c == b and seen < head:
                    first.append((mark, chars))
                if c == b or seen >= h:  # the first h turns of a block's first conversation are its own
                    add(mark, chars)
                seen += 1
            if out:
                yield batch_of(out)
                out.clear()
        done()
        if out:
            yield batch_of(out)

    dealt = rows.repartition("base").sortWithinPartitions("base", "other", "conv_id", F.col("turn").asc_nulls_first(), "mark")
    return dealt.select("base", "conv_id", "h", "mark", "chars").mapInArrow(chain, PATH)


def endings(paths: DataFrame) -> DataFrame:
    """(key, conv_id, weight, ends): for each prefix that conversations end with, the smallest of them, their number, and the
    digest of their ids. Ids are first joined where ranges of (key, id) put them, so of many that end alike few rows meet; these
    stream through a task in order, as a digest has to."""

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                key, conv = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                edge = [0, *(i for i in range(1, len(key)) if key[i] != key[i - 1]), len(key)]
                out = [(key[a], conv[a], b - a, ",".join(map(str, conv[a:b]))) for a, b in zip(edge, edge[1:])]
                yield pa.record_batch([pa.array(list(x), t) for x, t in zip(zip(*out), kinds)], names)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            out = []
            for key, conv, n, ids in zip(*(x.to_pylist() for x in batch.columns)):
                if now is not None and key == now[0]:
                    state.update(f",{ids}".encode())
                    now = (*now[:2], now[2] + n)
                    continue
                if now is not None:
                    out.append((*now, state.hexdigest()))
                now, state = (key, conv, n), sha256(ids.encode())
            if out:
                yield pa.record_batch([pa.array(list(x), t) for x, t in zip(zip(*out), kinds)], names)
        if now is not None:
            yield pa.record_batch([pa.array([x], t) for x, t in zip((*now, state.hexdigest()), kinds)], names)

    kinds, names, schema = (pa.binary(), pa.int64(), pa.int64(), pa.string()), ["key", "conv_id", "weight", "ends"], "key binary, conv_id long, weight long, ends string"
    last = paths.where("last").select("key", "conv_id").repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
    return last.mapInArrow(joined, schema).repartition("key").sortWithinPartitions("key", "conv_id").mapInArrow(digest, schema)


def words(column: pa.Array) -> np.ndarray:
    """Digests of 16 bytes as two unsigned words each."""
    return np.frombuffer(b"".join(column.to_pylist()), ">u8").reshape(-1, 2).astype(np.uint64)


class Louds:
    """Nodes in level order as a bit vector: for each node, from an unnamed one above all, a one for each child, then a zero."""

    def __init__(self, levels: list[np.ndarray]):
        """``levels`` has the parent of each node of a level, as its place in the level before, ascending."""
        degrees = [np.array([len(levels[0])])] if levels else [np.array([0])]
        for here, below in zip(levels, [*levels[1:], np.zeros(0, np.int64)]):
            degrees.append(np.bincount(below, minlength=len(here)))
        degree = np.concatenate(degrees)
        self.bits = np.ones(int(degree.sum()) + len(degree), bool)
        self.bits[np.cumsum(degree + 1) - 1] = False
        self.level = np.concatenate([[0], np.cumsum([len(x) for x in levels])]).astype(np.int64)

    def parents(self) -> np.ndarray:
        """Of each node, its parent, -1 for those of the first level: the zeros before the node's one."""
        return np.cumsum(~self.bits)[self.bits] - 1

    def degrees(self) -> np.ndarray:
        """Of each node, the ones between its zero and the one before."""
        return np.diff(np.flatnonzero(~self.bits)) - 1

    def rolled(self, own: np.ndarray, how: Callable = np.add) -> np.ndarray:
        """For each node ``how`` over its subtree: from the last level up, each adds itself to its parent."""
        total, parent = own.copy(), self.parents()
        for a, b in zip(self.level[-2:0:-1], self.level[:0:-1]):
            how.at(total, parent[a:b], total[a:b])
        return total


def level_order(key: np.ndarray, up: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Of distinct nodes, their order level by level, siblings together, and each level's parents as places in the level before.
    Nodes whose parent isn't there are of the first level, whatever their depth; they count as that of their shard."""
    name = {bytes(k): i for i, k in enumerate(key.astype(">u8").view("V16").ravel().tolist())}
    parent = np.array([name.get(bytes(u), -1) for u in up.astype(">u8").view("V16").ravel().tolist()], np.int64)
    order, levels = [], []
    children = np.argsort(parent, kind="stable")
    first, after = np.searchsorted(parent[children], np.arange(-1, len(key))), np.searchsorted(parent[children], np.arange(-1, len(key)), side="right")
    here, above = children[first[0] : after[0]], np.full(after[0] - first[0], -1, np.int64)
    while len(here):
        order.append(here)
        levels.append(above)
        size = (after - first)[here + 1]
        above = np.repeat(np.arange(len(here)), size)
        start = np.repeat(first[here + 1] - np.concatenate([[0], np.cumsum(size)[:-1]]), size)
        here = children[start + np.arange(len(above))]
    return np.concatenate(order) if order else np.zeros(0, np.int64), levels


def trie_rows(key: np.ndarray, up: np.ndarray, depth: np.ndarray, chars: np.ndarray, conv: np.ndarray, weight: np.ndarray, ends: list, more: dict | None = None) -> pa.RecordBatch:
    """The nodes of a forest, given each once with its smallest path, the weight and digest of the conversations that end there;
    ``more`` has what shards below a node add to it."""
    order, levels = level_order(key, up)
    key, up, depth, chars, conv, weight = (x[order] for x in (key, up, depth, chars, conv, weight))
    more = {c: x[order] for c, x in (more or {c: np.zeros(len(key), np.int64) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")}).items()}
    trie = Louds(levels)
    parent, children = trie.parents(), trie.degrees() + more["n_children"]
    n = trie.rolled(weight + more["n_convs"])
    least = trie.rolled(conv, np.minimum)
    leaves = trie.rolled((children == 0).astype(np.int64) + more["n_leaves"])
    saved = trie.rolled(np.where(depth > 0, (n - 1) * chars, 0) + more["saved_tokens"])
    digests = lambda x: pa.array([w.tobytes() for w in x.astype(">u8")], pa.binary())
    above = np.where(parent >= 0, least[np.maximum(parent, 0)], 0)
    return pa.record_batch([digests(key), digests(up), pa.array(parent < 0), pa.array(least), pa.array(depth.astype(np.int32)), pa.array(above, mask=parent < 0), pa.array(n), pa.array(children), pa.array(leaves), pa.array(saved), pa.array([ends[i] or NOBODY for i in order])], [f.split()[0] for f in NODE.split(", ")])


def shard_nodes(rows: DataFrame, parts: int) -> DataFrame:
    """The nodes of all shards; a task's shards are one forest."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        t = pa.Table.from_batches(parts).combine_chunks()
        key = words(t["key"])
        order = np.lexsort((t["conv_id"].to_numpy(), key[:, 1], key[:, 0]))
        at = order[np.concatenate([[True], (np.diff(key[order], axis=0) != 0).any(axis=1)])]  # each prefix where its smallest path has it
        node = np.empty(len(key), np.int64)
        node[order] = np.cumsum(np.concatenate([[0], (np.diff(key[order], axis=0) != 0).any(axis=1)]))
        last = np.flatnonzero(t["last"].to_numpy(zero_copy_only=False))
        weight, ends = np.zeros(len(at), np.int64), [None] * len(at)
        weight[node[last]] = t["weight"].to_numpy()[last]
        for i, d in zip(node[last].tolist(), t["ends"].take(pa.array(last)).to_pylist()):
            ends[i] = d
        yield trie_rows(key[at], words(t["up"])[at], t["depth"].to_numpy()[at], t["chars"].to_numpy()[at], t["conv_id"].to_numpy()[at], weight, ends)

    return rows.repartition(parts, "shard").select("conv_id", "depth", "key", "up", "chars", "last", "weight", "ends").mapInArrow(build, NODE)


def upper_nodes(rows: DataFrame, below: DataFrame) -> DataFrame:
    """The root and the prefixes above all shards. Rows of a prefix and sums of the shards below it are added up before they
    meet in one task, which gets a row for each prefix: at most UPPER and the root."""
    end = F.when(F.col("last"), F.struct("weight", "ends"))
    own = rows.groupBy("key").agg(F.min("conv_id").alias("conv_id"), F.first("up").alias("up"), F.first("depth").alias("depth"), F.first("chars").alias("chars"), F.max(end).alias("end"))
    sums = below.groupBy(F.col("up").alias("key")).agg(F.min("conv_id").alias("least"), F.sum("n_convs").alias("n_convs"), F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    none = F.lit(0).cast("long")
    both = own.join(sums, "key", "full").select(
        "key", F.coalesce("up", F.unhex(F.lit("ff" * 16))).alias("up"), F.coalesce("depth", F.lit(0)).alias("depth"), F.coalesce("chars", none).alias("chars"), F.coalesce(F.least("conv_id", "least"), "conv_id", "least").alias("conv_id"),
        F.coalesce("end.weight", none).alias("weight"), F.col("end.ends").alias("ends"), *(F.coalesce(c, none).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if parts:
            t = pa.Table.from_batches(parts).combine_chunks()
            plain = {c: t[c].to_numpy() for c in ("depth", "chars", "conv_id", "weight", "n_convs", "n_children", "n_leaves", "saved_tokens")}
            yield trie_rows(words(t["key"]), words(t["up"]), plain["depth"], plain["chars"], plain["conv_id"], plain["weight"], t["ends"].to_pylist(), {c: plain[c] for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")})

    return both.repartition(1).mapInArrow(build, NODE)


def prefix_trie(conversations: DataFrame, crowd: int = CROWD) -> DataFrame:
    """A row for each distinct prefix of rebuilt conversations: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256, as the contract says.

    Rows with a null conv_id are of no conversation and left out; a null turn comes first, rows of one turn stand in the order
    of a digest of role and text, and all of them count. The block's first conversation of c is c - c % 100 with the sign of
    SQL's remainder. Prefixes are told apart by 128 bits of SHA-256 over their turns. Other columns are left out; an empty
    table gives no rows, not even a root, for nobody is its member. One conversation's turns have to fit a task as
    numbers, not as texts."""
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    paths = checkpointed(rebuilt(turns))
    ends = endings(paths)
    rows = checkpointed(paths.join(ends.select("conv_id", "weight", "ends"), "conv_id"))
    n = rows.count()
    # A prefix is above the shards if more than so many paths have it: at most UPPER are, for each row counts for one.
    shared = rows.where("depth > 0").groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > max(crowd, n // UPPER)).select("key", F.lit(True).alias("heavy"))
    over = Window.partitionBy("conv_id").orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = rows.where("depth > 0").join(F.broadcast(shared), "key", "left")
    placed = checkpointed(placed.withColumn("shard", F.first(F.when(F.col("heavy").isNull(), F.col("key")), ignorenulls=True).over(over)).drop("heavy"))
    nodes = checkpointed(shard_nodes(placed.where("shard is not null"), partitions(rows, n, 200_000)))
    root = rows.agg(F.max("conv_id").alias("conv_id")).where("conv_id is not null").select("conv_id", F.lit(0).alias("depth"), F.lit(ROOT).alias("key"), F.lit(0).cast("long").alias("chars"), F.lit(False).alias("last"))
    above = placed.where("shard is null").unionByName(rows.where("depth = 0"), True).unionByName(root, True)
    upper = checkpointed(upper_nodes(above, nodes.where("top").select("up", "conv_id", "n_convs", "n_leaves", "saved_tokens")))
    known = F.broadcast(upper.select(F.col("key").alias("up"), F.col("conv_id").alias("found")))
    whole = nodes.join(known, "up", "left").withColumn("parent_conv_id", F.when(F.col("top"), F.col("found")).otherwise(F.col("parent_conv_id"))).drop("found")
    return whole.unionByName(upper).select("conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
