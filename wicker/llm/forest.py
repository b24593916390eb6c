"""Embedding near-dedup: a forest of random-projection trees with spill, exact comparison within leaves, components."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from wicker.llm.common import Union, checkpointed, components, looked_up, partitions

#: Vectors that a forest's thresholds are fitted on at most, and lengths of vectors that have forests; every vector is indexed, those
#: of other lengths in one leaf for each length.
SAMPLE, FORESTS = 16_384, 64
#: Vectors of a leaf.
LEAF = 200
#: Rows of a leaf that are compared at once; levels of a tree whose leaves are compared in one task; vectors of a branch beyond
#: which it is split to blocks.
BLOCK, BRANCH, LARGE = 2048, 6, 32_768


@dataclass(frozen=True)
class Forest:
    """directions[tree, level] are unit vectors; low and high[tree, node] bound the spill around a node's median, those of
    deeper[tree, level] the spill at all nodes of a level that the sample doesn't reach. The children of node i are
    2i + 1 and 2i + 2."""

    directions: np.ndarray
    low: np.ndarray
    high: np.ndarray
    deeper: np.ndarray
    spills: int = 2

    @property
    def depth(self) -> int:
        return self.directions.shape[1]

    def edges(self, tree: int, level: int, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if 2 ** (level + 1) - 1 <= self.low.shape[1]:
            return self.low[tree, node], self.high[tree, node]
        low, high = self.deeper[tree, level]
        return np.full(len(node), low), np.full(len(node), high)

    def leaves(self, unit: np.ndarray, only: int | None = None) -> np.ndarray:
        """Leaf numbers of each row, over all trees or only one: (rows, trees x 2^spills), -1 where there is none. A vector
        within a node's spill goes both ways, on at most ``spills`` levels of a path: then a tight group at a threshold
        can't fill the tree."""
        trees = range(len(self.directions)) if only is None else [only]
        out = np.full((len(unit), len(trees), 2**self.spills), -1, np.int64)
        for k, t in enumerate(trees):
            row, node, spent, slot = np.arange(len(unit)), np.zeros(len(unit), np.int64), np.zeros(len(unit), np.int64), np.zeros(len(unit), np.int64)
            for level in range(self.depth):
                p = (unit @ self.directions[t, level])[row]
                low, high = self.edges(t, level, node)
                both = (p > low) & (p <= high) & (spent < self.spills)
                right = p > (low + high) / 2
                spent = spent + both
                child = 2 * node + 1 + right
                more = np.flatnonzero(both)
                row, node = np.concatenate([row, row[more]]), np.concatenate([child, 4 * node[more] + 3 - child[more]])
                slot = np.concatenate([slot, slot[more] + 2 ** (spent[more] - 1)])
                spent = np.concatenate([spent, spent[more]])
            out[row, k, slot] = node + (t << 40)
        return out.reshape(len(unit), -1)

    def branches(self, leaves: np.ndarray) -> np.ndarray:
        """The node BRANCH levels above each leaf, with its tree; -1 for none. Vectors go to the branches, once to each."""
        node = (((leaves & ((1 << 40) - 1)) + 1) >> min(self.depth, BRANCH)) - 1
        return np.where(leaves < 0, -1, node + (leaves >> 40 << 40))


def tree_recall(depth: int, cosine: float, spill: float = 0.06, spills: int = 2) -> float:
    """The share of pairs at a cosine that meet in a leaf of one tree, for isotropic vectors and exact medians: the
    projections of a pair on a level's direction are normal with that correlation, and each level is drawn anew."""
    normal, points = NormalDist(), 4096
    x = np.array([normal.inv_cdf((i + 0.5) / points) for i in range(points)])
    beside = np.sqrt(1 - min(cosine, 1 - 1e-12) ** 2)
    below = lambda edge: np.array([normal.cdf((edge - cosine * v) / beside) for v in x])
    z = normal.inv_cdf(0.5 + spill)
    both = np.mean((np.abs(x) <= z) * (below(z) - below(-z)))
    lost = {(e, f): 2 * np.mean((x < -e) * (1 - below(f))) for e in (0.0, z) for f in (0.0, z)}
    at = np.zeros((spills + 1, spills + 1))  # pairs still together, by the spills that each of the two has spent
    at[0, 0] = 1.0
    for _ in range(depth):
        after = np.zeros_like(at)
        for (a, b), p in np.ndenumerate(at):
            u, v = a < spills, b < spills
            one, other, shared = 2 * spill * u, 2 * spill * v, both * (u and v)
            after[a, b] += p * (1 - one - other + shared - lost[z * u, z * v])
            for da, db, share in ((u, v, shared), (u, 0, one - shared), (0, v, other - shared)):
                after[a + da, b + db] += p * share
        at = after
    return float(at.sum())


def trees_for(depth: int, cosine: float, spill: float = 0.06, recall: float = 0.95, least: int = 5) -> int:
    """How many trees find ``recall`` of the pairs at a cosine: as depth grows, each finds less."""
    one = min(tree_recall(depth, cosine, spill), 1 - 1e-9)
    return max(least, int(np.ceil(np.log(1 - recall) / np.log(1 - one))))


def fit(sample: np.ndarray, n: int, trees: int | None = None, leaf: int = LEAF, spill: float = 0.06, seed: int = 7, least: float = 0.9) -> Forest:
    """Thresholds are medians of the sample's projections at each node, with the quantiles ``spill`` to either side. Levels where
    a node has fewer than 16 of the sample on average take the level's own quantiles over the whole sample, and so does a
    node that fewer than eight reach: its direction is new to the tree, so they are near its own. Depth follows n, the
    number of vectors to index, and the number of trees follows depth, so that recall at a cosine of ``least`` holds at
    any n; the thresholds' number follows the sample alone."""
    rng = np.random.default_rng(seed)
    depth = int(np.clip(np.ceil(np.log2(max(n, 1) / leaf)), 0, 36))
    trees = trees or trees_for(depth, least, spill)
    if depth and not len(sample):
        raise ValueError("no sample to fit a forest on")
    dims = sample.shape[1]
    directions = rng.normal(size=(trees, max(depth, 1), dims))
    directions /= np.linalg.norm(directions, axis=2, keepdims=True)
    reach = min(depth, max(0, int(np.log2(max(1, len(sample)) / 8))))
    low, high, deeper = np.zeros((trees, 2**reach - 1)), np.zeros((trees, 2**reach - 1)), np.zeros((trees, depth, 2))
    for t in range(trees):
        node = np.zeros(len(sample), np.int64)
        for level in range(depth):
            p = sample @ directions[t, level]
            deeper[t, level] = np.quantile(p, (0.5 - spill, 0.5 + spill))
            if level >= reach:
                continue
            order = np.argsort(node, kind="stable")
            bounds = np.searchsorted(node[order], np.arange(2**level - 1, 2 ** (level + 1)))
            for i in range(2**level):
                part, at = p[order[bounds[i] : bounds[i + 1]]], 2**level - 1 + i
                low[t, at], high[t, at] = np.quantile(part, (0.5 - spill, 0.5 + spill)) if len(part) >= 8 else deeper[t, level]
            node = 2 * node + 1 + (p > (low[t, node] + high[t, node]) / 2)
    return Forest(directions[:, :depth], low, high, deeper)


def units(column: pa.Array, dims: int) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # first by the largest component: squares neither overflow nor vanish
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def one_leaf(dims: int) -> Forest:
    """A tree without splits."""
    return Forest(np.zeros((1, 0, dims)), np.zeros((1, 0)), np.zeros((1, 0)), np.zeros((1, 0, 2)))


def forests(reps: DataFrame, least: float, sample: int) -> dict[int, Forest]:
    """length: forest, for the FORESTS most frequent lengths of vectors that have more than a leaf of them. Each is fitted on at most
    about ``sample`` of them, by a hash of the vector: all are different, whatever their ids."""
    often = reps.groupBy(F.size("v").alias("dims")).count().where(F.col("count") > LEAF).orderBy(F.desc("count"), "dims").limit(FORESTS).collect()
    if not often:
        return {}
    kept = F.element_at(F.create_map(*(F.lit(x) for r in often for x in (r.dims, int(min(1.0, sample / r["count"]) * (1 << 20))))), F.size("v"))
    some = reps.where(F.pmod(F.xxhash64("v", F.lit(2)), F.lit(1 << 20)) < kept).select("v").toPandas()["v"]
    length = some.map(len)
    return {r.dims: fit(units(pa.array(some[length == r.dims].tolist(), pa.list_(pa.float64())), r.dims), r["count"], least=least) for r in often}


def leaf_links(reps: DataFrame, trees: dict[int, Forest], n: int, least: float) -> DataFrame:
    """(rid, links, root): for vectors with links, the rows that they link with (weights of the others summed), each
    pair counted in the first leaf that both share; root joins what a task has found, with one row for each member.

    A vector is sent to each branch that holds a leaf of it, and finds its leaves there again. Vectors of different lengths never
    meet: each length has trees of its own."""

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            length = pc.list_value_length(whole.column(2)).to_numpy()
            for dims in np.unique(length).tolist():
                batch, forest = whole.filter(pa.array(length == dims)), trees.get(dims) or one_leaf(dims)
                found = np.sort(forest.branches(forest.leaves(units(batch.column(2), dims))), axis=1)
                first = np.concatenate([np.ones((len(found), 1), bool), found[:, 1:] != found[:, :-1]], axis=1)
                row, slot = np.nonzero(first & (found >= 0))
                take = pa.array(row)
                yield pa.record_batch([pa.array(np.full(len(row), dims, np.int32)), pa.array(found[row, slot]), *(c.take(take) for c in batch.columns)], ["dims", "branch", "rid", "weight", "v"])

    routed = reps.select("rid", "weight", "v").mapInArrow(route, f"dims int, branch long, rid long, weight long, v {reps.schema['v'].dataType.simpleString()}")
    sizes = checkpointed(routed.groupBy("dims", "branch").count().where(F.col("count") > 2 * LARGE))
    to = partitions(reps, 2 * max((len(f.directions) for f in trees.values()), default=1) * n, 100_000)
    if sizes.isEmpty():
        dealt, keys = routed.select("dims", "branch", F.lit(0).alias("one"), F.lit(0).alias("two"), F.lit(0).alias("mine"), "rid", "weight", "v"), ["dims", "branch"]
    else:  # members of a large branch are dealt to blocks, and every two blocks meet in one task: all its pairs, in bounded memory
        k = F.coalesce(F.ceil(F.col("count") / LARGE).cast("int"), F.lit(1))
        dealt = routed.join(sizes, ["dims", "branch"], "left").withColumn("k", k).withColumn("mine", F.pmod(F.xxhash64("rid"), F.col("k")).cast("int"))
        dealt = dealt.withColumn("other", F.explode(F.expr("sequence(0, k - 1)"))).select("dims", "branch", F.least("mine", "other").alias("one"), F.greatest("mine", "other").alias("two"), "mine", "rid", "weight", "v")
        keys = ["dims", "branch", "one", "two"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        whole = pa.Table.from_batches(parts).combine_chunks()
        length, branch, one, two, mine, rid, weight = (whole.column(c).to_numpy() for c in ("dims", "branch", "one", "two", "mine", "rid", "weight"))
        vectors = whole.column("v").chunk(0) if whole.column("v").num_chunks else whole.column("v")
        ids, at = np.unique(rid, return_inverse=True)
        links, joined = np.zeros(len(ids), np.int64), Union(len(ids))
        order = np.lexsort((rid, mine, two, one, branch, length))
        edge = np.flatnonzero(np.concatenate([[True], np.any([np.diff(c[order]) != 0 for c in (length, branch, one, two)], axis=0), [True]]))
        for a, b in zip(edge, edge[1:]):
            rows = order[a:b]
            if len(rows) < 2:
                continue
            dims = int(length[rows[0]])
            forest, x = trees.get(dims) or one_leaf(dims), units(vectors.take(pa.array(rows)), dims)
            seen, spread = forest.leaves(x), 2**forest.spills
            own = seen.reshape(len(x), -1, spread)[:, branch[rows[0]] >> 40]
            r, slot = np.nonzero(forest.branches(own) == branch[rows[0]])
            leaf = own[r, slot]
            by = np.lexsort((r, leaf))
            r, leaf = r[by], leaf[by]
            cut = np.flatnonzero(np.concatenate([[True], np.diff(leaf) != 0, [True]]))
            left = mine[rows] == one[rows[0]]
            for c, d in zip(cut, cut[1:]):
                members = r[c:d]
                u, v = (members, members) if one[rows[0]] == two[rows[0]] else (members[left[members]], members[~left[members]])
                for i in range(0, len(u), BLOCK):
                    for j in range(i if u is v else 0, len(v), BLOCK):
                        p, q = np.nonzero(x[u[i : i + BLOCK]] @ x[v[j : j + BLOCK]].T >= least)
                        p, q = u[p + i], v[q + j]
                        if u is v:
                            p, q = p[p < q], q[p < q]
                        for k in range(0, len(p), 1 << 16):  # count a pair where its first common leaf is
                            s, w = p[k : k + (1 << 16)], q[k : k + (1 << 16)]
                            common = np.full(len(s), np.iinfo(np.int64).max)
                            for t in range(0, seen.shape[1], spread):  # a leaf is of one tree: memory doesn't grow with their number
                                su, sv = (seen[z, t : t + spread] for z in (s, w))
                                common = np.minimum(common, np.where((su[:, :, None] == sv[:, None, :]) & (su[:, :, None] >= 0), su[:, :, None], np.iinfo(np.int64).max).min(axis=(1, 2)))
                            first = common == leaf[c]
                            np.add.at(links, at[rows[s[first]]], weight[rows[w[first]]])
                            np.add.at(links, at[rows[w[first]]], weight[rows[s[first]]])
                            joined.link(at[rows[s]], at[rows[w]])
        root = joined.root
        some = np.flatnonzero((links > 0) | (root != np.arange(len(ids))))
        yield pa.record_batch([pa.array(ids[some]), pa.array(links[some]), pa.array(ids[root[some]])], ["rid", "links", "root"])

    return dealt.repartition(to, *keys).mapInArrow(compare, "rid long, links long, root long")


def near_duplicates(vectors: DataFrame, least: float = 0.9, sample: int = SAMPLE) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of vectors (vec_id, embedding).

    Vectors that are null, zero, or hold null or non-finite components link with nothing, and vectors of different lengths never
    link. Equal vectors count as one with their number as its weight, and link with each other; they are told by a
    hash of 128 bits. Rows link if their cosine in double precision is at least ``least`` and a leaf of the forest holds
    both: none below it, and of those at it what the forest's recall gives (the tests hold it against brute force). A null
    vec_id gives a row of its own without links; rows are told apart by their vectors, so a vec_id that repeats counts as often
    as it does; an empty table gives no rows. Other columns are left out."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v"))
    fine = "v is not null and size(v) > 0 and vec_id is not null and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(v, x -> x <> 0)"
    key = [F.xxhash64("v").alias("h"), F.xxhash64(F.lit(1), "v").alias("g")]
    reps = checkpointed(rows.where(fine).groupBy("v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight"))).withColumn("rid", F.monotonically_increasing_id())
    found = checkpointed(leaf_links(reps, forests(reps, least, sample), reps.count(), least))
    group = components(found.where("rid <> root").select(F.col("rid").alias("a"), F.col("root").alias("b"))).select(F.col("node").alias("rid"), "component")
    total = found.groupBy("rid").agg(F.sum("links").alias("links"))
    known = reps.select(F.struct(*key).alias("hash"), "rid", "rep", "weight").join(total, "rid", "left").join(group, "rid", "left")
    known = checkpointed(known.select("hash", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "rep", "component"))
    grouped = known.where("component is not null")
    named = looked_up(grouped, "component", grouped.groupBy("component").agg(F.min("rep").alias("least")))
    known = named.select("hash", "n_links", F.col("least").alias("component")).unionByName(known.where("component is null").select("hash", "n_links", F.col("rep").alias("component")))
    keyed = checkpointed(rows.select("vec_id", *(F.when(F.expr(fine), k).alias(c) for k, c in zip(key, "hg"))))
    linked = looked_up(keyed.where("h is not null").select("vec_id", F.struct("h", "g").alias("hash")), "hash", known).select("vec_id", "n_links", "component")
    alone = keyed.where("h is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.lit(None).cast("long").alias("component"))
    out = linked.unionByName(alone).select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
