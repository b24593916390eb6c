"""Merkle dataset manifest: a tree of rows for each source, a tree of their roots, and a proof for each row.

Rows are laid out in the order of source and doc_id, a range for each partition. A partition holds a sparse forest: the nodes
whose run of siblings it doesn't hold whole, keyed by group, level and index. Merging two forests is their union, after which
every run whose number of siblings is all there becomes its parent: associative, so forests are merged as a tree of tasks."""

from __future__ import annotations

from binascii import hexlify
from collections.abc import Iterator
from dataclasses import astuple, dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from wicker.llm.common import checkpointed, partitions

ARITY = 16  # fixed value: siblings of a run
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")  # fixed value: what a leaf digests, in order
#: The group of the tree over subroots; sources are groups from 0, in their order.
TOP = -1
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

NODE = "slot long, g long, n long, level int, i long, digest binary, open boolean, fresh boolean"


def leaf(**instead: Column) -> Column:
    """The digest of a row's fields, each as its byte count and value, ``-`` for null; ``instead`` gives other values of fields."""
    parts = []
    for name in FIELDS:
        value = instead.get(name, F.col(name)).cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.unhex(F.sha2(F.concat(*parts), 256))


def tampered(every: int = 5) -> Column:
    """The leaf of a row whose text's A-Z were lower-cased, where ``every`` divides the crc32 of the decimal doc_id; else null."""
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % every == 0
    return F.when(hit, leaf(text=F.translate("text", UPPER, LOWER)))


def parent(children: list[bytes]) -> bytes:
    return sha256(hexlify(b"".join(children))).digest()


def width(n: int, level: int) -> int:
    """How many nodes a level of a tree of n leaves has."""
    return -(-n // ARITY**level)


def height(n: int) -> int:
    level = 0
    while width(n, level) > 1:
        level += 1
    return level


def settle(nodes: dict, sizes: dict) -> dict:
    """Turn each whole run of nodes {(group, level): {index: digest}} into its parent, bottom up; the root of a source becomes
    a leaf of the top tree. ``sizes`` has the leaves of each group, so a run knows how many it has. Returns the nodes that
    have their parent now, keyed likewise."""
    spent: dict = {}
    for g in [*(g for g in sizes if g != TOP), TOP]:
        n = sizes[g]
        for level in range(height(n)):
            here = nodes.get((g, level), {})
            runs: dict[int, list[int]] = {}
            for i in here:
                runs.setdefault(i // ARITY, []).append(i)
            for j, members in runs.items():
                if len(members) == min(ARITY, width(n, level) - ARITY * j):
                    run = {i: here.pop(i) for i in sorted(members)}
                    spent.setdefault((g, level), {}).update(run)
                    nodes.setdefault((g, level + 1), {})[j] = parent(list(run.values()))
        if g != TOP and 0 in nodes.get((g, height(n)), {}):
            nodes.setdefault((TOP, 0), {})[g] = nodes.pop((g, height(n)))[0]
    return spent


def node_rows(slot: int, nodes: dict, sizes: dict, spent: dict, known: set) -> pa.RecordBatch:
    """The nodes of a forest as rows, the open ones and the spent ones that weren't known before; these are fresh."""
    rows = [(slot, g, sizes[g], level, i, d, still, (g, level, i) not in known) for some, still in ((nodes, True), (spent, False)) for (g, level), here in some.items() for i, d in here.items()]
    rows = [r for r in rows if r[6] or r[7]]
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.bool_(), pa.bool_())
    columns = zip(*rows) if rows else [[]] * len(kinds)
    return pa.record_batch([pa.array(list(c), k) for c, k in zip(columns, kinds)], ["slot", "g", "n", "level", "i", "digest", "open", "fresh"])


def spans(sources: pa.Array | pa.ChunkedArray) -> list[tuple[str | None, int]]:
    """(source, rows) for each run of equal sources."""
    whole = sources.combine_chunks() if isinstance(sources, pa.ChunkedArray) else sources
    if not len(whole):
        return []
    runs = pc.run_end_encode(whole)
    ends = runs.run_ends.to_numpy()
    return list(zip(runs.values.to_pylist(), np.diff(ends, prepend=0).tolist()))


def laid_out(leaves: DataFrame) -> DataFrame:
    """leaves with part, a partition's number, and at, ascending within it: ranges of (source, doc_id, leaf), nulls first. Rows
    equal in all three are told apart by their place, so a key with many rows is split as well."""
    rows = checkpointed(leaves).withColumn("_tie", F.monotonically_increasing_id())
    order = [F.col(c).asc_nulls_first() for c in ("source", "doc_id", "leaf", "_tie")]
    dealt = rows.repartitionByRange(partitions(rows, rows.count(), 100_000), *order).sortWithinPartitions(*order).drop("_tie")
    return checkpointed(dealt.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")))


@dataclass
class Bound:
    """A partition's groups: the first and the last, the place of the first row in its group, the leaves of both in all, and
    the rows of both here."""

    first: int
    last: int
    start: int
    n_first: int
    n_last: int
    m_first: int
    m_last: int


def bounds(laid: DataFrame) -> tuple[dict[int, Bound], int]:
    """What each partition holds, and the number of groups. A row for each partition comes to the driver, none for each source."""

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, first, last, part = 0, None, None, None
        for batch in batches:
            for source, m in spans(batch.column(1)):
                part = batch.column(0)[0].as_py()
                if last is not None and last[0] == source:
                    last = (source, last[1] + m)
                else:
                    last, k = (source, m), k + 1
                first = last if k == 1 else first
        if k:
            yield pa.record_batch([pa.array([x], t) for x, t in ((part, pa.int32()), (k, pa.int64()), (first[0], pa.string()), (first[1], pa.int64()), (last[0], pa.string()), (last[1], pa.int64()))], ["part", "k", "a", "an", "b", "bn"])

    rows = laid.select("part", "source").mapInArrow(ends, "part int, k long, a string, an long, b string, bn long").collect()
    at, sizes, g, before = {}, {}, -1, None
    for r in sorted(rows, key=lambda r: r.part):
        same = before is not None and before.b == r.a
        first, start = (g, sizes[g]) if same else (g + 1, 0)
        sizes[first] = start + r.an
        g = first + r.k - 1
        if r.k > 1:
            sizes[g] = r.bn
        at[r.part], before = (first, g, start, r.an, r.bn), r
    return {p: Bound(a, b, start, sizes[a], sizes[b], ma, mb) for p, (a, b, start, ma, mb) in at.items()}, g + 1


def segments(sources: pa.ChunkedArray, at: Bound) -> list[tuple[int, int, int, int]]:
    """(group, place of its first row here, rows here, leaves in all) for the groups of a partition, in order."""
    rows = enumerate((m for _, m in spans(sources)), at.first)
    return [(g, at.start if g == at.first else 0, m, at.n_first if g == at.first else at.n_last if g == at.last else m) for g, m in rows]


def forests(laid: DataFrame, at: dict[int, Bound], groups: int) -> DataFrame:
    """The nodes that each partition can't resolve alone."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(batches) if (batches := [b for b in batches if b.num_rows]) else None
        if rows is None:
            return
        slot, row, nodes, sizes = rows["part"][0].as_py(), 0, {}, {TOP: groups}
        digests = rows["leaf"].to_pylist()
        for g, start, m, n in segments(rows["source"], at[slot]):
            nodes[g, 0] = dict(zip(range(start, start + m), digests[row : row + m]))
            sizes[g], row = n, row + m
        settle(nodes, sizes)
        yield node_rows(slot, nodes, sizes, {}, set())

    return laid.select("part", "source", "leaf").mapInArrow(fold, NODE)


def merged(found: DataFrame, slots: int, groups: int) -> tuple[DataFrame, bytes]:
    """All nodes whose siblings several partitions hold, and the root: forests are merged sixteen to a task until one is left.
    A forest has at most the runs at both its ends, so a task's rows follow the trees' heights, not their leaves."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes, sizes, slot = {}, {TOP: groups}, None
        for batch in batches:
            for slot, g, n, level, i, digest in zip(*(c.to_pylist() for c in batch.columns[:6])):
                nodes.setdefault((g, level), {})[i] = digest
                sizes[g] = n
        if slot is not None:
            known = {(g, level, i) for (g, level), here in nodes.items() for i in here}
            spent = settle(nodes, sizes)
            yield node_rows(slot // ARITY, nodes, sizes, spent, known)

    rounds = [found]
    while slots > 1:
        slots = -(-slots // ARITY)
        rounds.append(checkpointed(rounds[-1].where("open").repartition(slots, F.floor(F.col("slot") / ARITY)).mapInArrow(merge, NODE)))
    root = rounds[-1].where(F.col("open") & (F.col("g") == TOP)).collect()  # one row: all else is resolved
    published = rounds[0]
    for r in rounds[1:]:
        published = published.unionByName(r)
    return published.where("fresh").select("g", "level", "i", "digest"), bytes(root[0].digest)


def needed(spark: SparkSession, at: dict[int, Bound], groups: int, published: DataFrame) -> DataFrame:
    """(part, g, level, i, digest): published siblings of the paths from both ends of each partition's groups."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = set()
            for part, *rest in zip(*(c.to_pylist() for c in batch.columns)):
                b = Bound(*rest)
                for g, low, high, n in ((b.first, b.start, b.start + b.m_first, b.n_first), (b.last, 0 if b.last > b.first else b.start, (0 if b.last > b.first else b.start) + b.m_last, b.n_last), (TOP, b.first, b.last + 1, groups)):
                    out |= {(part, g, level, x // ARITY ** (level + 1)) for level in range(height(n)) for x in (low, high - 1)}
            columns = zip(*sorted(out)) if out else [[]] * 4
            yield pa.record_batch([pa.array(list(c), t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int32(), pa.int64()))], ["part", "g", "level", "run"])

    plan = spark.createDataFrame([(p, *astuple(b)) for p, b in at.items()], "part int, first long, last long, start long, n_first long, n_last long, m_first long, m_last long")
    asked = plan.mapInArrow(ask, "part int, g long, level int, run long")
    return asked.join(published.withColumn("run", F.floor(F.col("i") / ARITY)), ["g", "level", "run"]).select("part", "g", "level", "i", "digest")


def climb(here: dict[int, bytes], low: int, high: int, n: int, more: dict, g: int) -> list[dict[int, str]]:
    """For each level of a group's tree the runs (number: hex digests of its siblings) over the leaves low..high - 1, whose digests
    are given; ``more`` has the siblings beyond them. The last item is the root as a run of its own."""
    out = []
    for level in range(height(n)):
        here |= more.get((g, level), {})
        runs, above = {}, {}
        for j in range(low // ARITY, (high - 1) // ARITY + 1):
            children = [here[i] for i in range(ARITY * j, min(ARITY * (j + 1), width(n, level)))]
            runs[j] = hexlify(b"".join(children))
            above[j] = sha256(runs[j]).digest()
        out.append(runs)
        here, low, high = above, low // ARITY, (high - 1) // ARITY + 1
    return [*out, {0: hexlify(here[low])}]


def without(run: bytes, i: int) -> bytes:
    k = 64 * (i % ARITY)
    return run[:k] + run[k + 64 :]


def proofs(laid: DataFrame, at: dict[int, Bound], groups: int, more: DataFrame, root: bytes, digests: bool) -> DataFrame:
    """The result rows: a task gets the rows of a partition in order, before them the nodes that it lacks."""
    kinds = {f.name: f.dataType.simpleString() for f in laid.schema.fields}
    rows = laid.select("part", "at", "source", "leaf", "doc_id", "claim", *(F.lit(None).cast(t).alias(c) for c, t in (("g", "long"), ("level", "int"), ("i", "long"))))
    extra = more.select("part", F.lit(-1).cast("long").alias("at"), F.lit(None).cast("string").alias("source"), F.col("digest").alias("leaf"), F.lit(None).cast(kinds["doc_id"]).alias("doc_id"), F.lit(None).cast("binary").alias("claim"), "g", "level", "i")
    whole = hexlify(root)

    def prove(rows: pa.Table, extra: pa.Table) -> Iterator[pa.RecordBatch]:
        bound, more = at[rows["part"][0].as_py()], {}
        for g, level, i, digest in zip(*(extra[c].to_pylist() for c in ("g", "level", "i", "leaf"))):
            more.setdefault((g, level), {})[i] = digest
        leaves, row, trees, tops = rows["leaf"].to_pylist(), 0, [], {}
        for g, start, m, n in segments(rows["source"], bound):
            runs = climb(dict(zip(range(start, start + m), leaves[row : row + m])), start, start + m, n, more, g)
            tops[g] = bytes.fromhex(runs.pop()[0].decode())
            trees.append((g, row, start, m, runs))
            row += m
        upper = climb(dict(tops), bound.first, bound.last + 1, groups, more, TOP)[:-1]
        claims = rows["claim"].to_pylist()
        for g, row, start, m, runs in trees:
            subroot, above = hexlify(tops[g]), [(r[g // ARITY ** (k + 1)], g // ARITY**k) for k, r in enumerate(upper)]
            tails = {0: b"".join(without(r, i) for r, i in above)}  # of each node of a level, what its path's siblings are
            for level in range(len(runs) - 1, 0, -1):
                nodes = range(start // ARITY**level, (start + m - 1) // ARITY**level + 1)
                tails = {i: without(runs[level][i // ARITY], i) + tails[i // ARITY] for i in nodes}
            for a in range(row, row + m, 4096):
                b = min(a + 4096, row + m)
                out = []
                for k in range(a, b):
                    i = start + k - row
                    proof = without(runs[0][i // ARITY], i) + tails[i // ARITY] if runs else tails[0]
                    now = hexlify(claims[k] or leaves[k])
                    for level, r in enumerate(runs):
                        j = i // ARITY**level
                        siblings, place = r[j // ARITY], 64 * (j % ARITY)
                        now = hexlify(sha256(siblings[:place] + now + siblings[place + 64 :]).digest())
                    for siblings, j in above:
                        place = 64 * (j % ARITY)
                        now = hexlify(sha256(siblings[:place] + now + siblings[place + 64 :]).digest())
                    out.append((hexlify(leaves[k]).decode(), sha256(proof).hexdigest() if digests else proof.decode(), now.decode()))
                one, two, three = (pa.array(c, pa.string()) for c in zip(*out))
                fill = lambda v: pa.array([v.decode()] * (b - a), pa.string())
                yield pa.record_batch([rows["doc_id"].slice(a, b - a).combine_chunks(), one, fill(subroot), fill(whole), two, three, pc.equal(three, whole.decode())], ["doc_id", "leaf", "subroot", "root", "proof", "folded_root", "verified"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = None, []

        def flush() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held)
            k = pc.sum(pc.less(table["at"], 0)).as_py()
            yield from prove(table.slice(k), table.slice(0, k))

        for batch in batches:
            while batch.num_rows:
                first = batch.column(0)[0].as_py()
                same = pc.sum(pc.equal(batch.column(0), first)).as_py()  # rows are in order of part
                if part is not None and first != part:
                    yield from flush()
                    held = []
                part = first
                held.append(batch.slice(0, same))
                batch = batch.slice(same)
        if held:
            yield from flush()

    sorted_rows = rows.unionByName(extra).repartition(max(len(at), 1), "part").sortWithinPartitions("part", "at")
    return sorted_rows.mapInArrow(run, f"doc_id {kinds['doc_id']}, leaf string, subroot string, root string, proof string, folded_root string, verified boolean")


def manifest(docs: DataFrame, claim: Column | None = None, digests: bool = False) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof, folded_root, verified) for every row of docs.

    A leaf digests the row's doc_id, source, lang, n_chars and text. The rows of a source, null among them, ascend by doc_id,
    null first; rows of one doc_id ascend by their leaf, and rows equal in all fields are interchangeable. Sixteen siblings make
    a node, the last run of a level may have fewer; subroots in the order of source make the root in the same way. proof has the
    hexadecimal digests of all siblings of the path, or with ``digests`` the digest of that text. ``claim``, a leaf as ``leaf``
    makes it or null for the row's own, is folded with the proof to folded_root; verified tells whether that is the root. Null
    and empty texts differ. Other columns are left out; an empty table gives no rows."""
    fields = [F.col(f"`{c}`") for c in FIELDS]
    leaves = docs.select(*fields).select("doc_id", F.col("source").cast("string").alias("source"), leaf().alias("leaf"), (F.lit(None).cast("binary") if claim is None else claim).alias("claim"))
    laid = laid_out(leaves)
    at, groups = bounds(laid)
    if not at:
        none = {"leaf": "string", "subroot": "string", "root": "string", "proof": "string", "folded_root": "string", "verified": "boolean"}
        return laid.select("doc_id", *(F.lit(None).cast(t).alias(c) for c, t in none.items()))
    found = checkpointed(forests(laid, at, groups))
    published, root = merged(found, max(at) + 1, groups)
    return proofs(laid, at, groups, checkpointed(needed(docs.sparkSession, at, groups, published)), root, digests)
