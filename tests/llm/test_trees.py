"""The Merkle manifest, the prefix trie and the benchmark join against plain Python, with many partitions, deep and shared prefixes,
long texts, nulls, ties, repeated rows, clashing names and empty tables."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wicker.llm import leaks, merkle, trie


def digest(x):
    return hashlib.sha256(x.encode()).hexdigest()


def levels_of(leaves):
    out = [leaves]
    while len(out[-1]) > 1:
        out.append([digest("".join(out[-1][i : i + 16])) for i in range(0, len(out[-1]), 16)])
    return out


def path_of(levels, i):
    for level in levels[:-1]:
        j = i // 16 * 16
        yield "".join(level[j:i]), "".join(level[i + 1 : j + 16])
        i //= 16


def plain_manifest(rows):
    """(doc_id, source, lang, n_chars, text) -> (doc_id, leaf, subroot, root, proof, folded_root, verified)"""
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r: digest("".join(map(field, r)))
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append(r)
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for s in sources:
        by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    trees = {s: levels_of([leaf(r) for r in by[s]]) for s in sources}
    top = levels_of([trees[s][-1][0] for s in sources])
    for g, s in enumerate(sources):
        for i, r in enumerate(by[s]):
            steps = [*path_of(trees[s], i), *path_of(top, g)]
            now = leaf(r)
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0:
                now = leaf((*r[:4], r[4] and re.sub("[A-Z]", lambda m: m[0].lower(), r[4])))
            for a, b in steps:
                now = digest(a + now + b)
            yield r[0], trees[s][0][i], trees[s][-1][0], top[-1][0], "".join(a + b for a, b in steps), now, now == top[-1][0]


@pytest.mark.parametrize("rows, sources, parts", [(1, 1, 3), (16, 1, 3), (700, 1, 7), (700, 600, 5), (900, 3, 29)])
def test_manifest_is_the_one_of_plain_python(spark, rows, sources, parts):
    rng = random.Random(rows + sources)
    data = []
    for i in range(rows):
        source = f"s{rng.randrange(sources)}" if rng.random() < 0.6 else "é" if sources > 1 else "s0"
        data.append((rng.choice([None, rng.randrange(-50, 2000)]), source if sources < 3 or rng.random() < 0.9 else None, rng.choice([None, "", "en"]), i, rng.choice([None, "", "A b É", "x" * 3000])))
    data += data[: rows // 3 + 1]
    df = spark.createDataFrame(data, "doc_id long, source string, lang string, n_chars long, text string").withColumns({"leaf": F.lit("l"), "part": F.lit(1), "claim": F.lit(2), "g": F.lit(3)})
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        got = merkle.manifest(df, merkle.tampered()).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sorted(map(tuple, got), key=repr) == sorted(plain_manifest(data), key=repr)


def test_forests_merge_in_any_order():
    """Merging is associative and commutative: any grouping of the fragments leaves the same root."""
    rng, leaves = random.Random(2), [hashlib.sha256(bytes([i % 256, i // 256])).digest() for i in range(777)]
    want = levels_of([x.hex() for x in leaves])[-1][0]
    for _ in range(5):
        cuts = [0, *sorted(rng.sample(range(1, 777), 12)), 777]
        some = [{(0, 0): dict(zip(range(a, b), leaves[a:b]))} for a, b in zip(cuts, cuts[1:])]
        rng.shuffle(some)
        while len(some) > 1:
            a, b = some.pop(rng.randrange(len(some))), some.pop(rng.randrange(len(some)))
            for key, here in b.items():
                a.setdefault(key, {}).update(here)
            merkle.settle(a, {0: 777, merkle.TOP: 1})
            some.append(a)
        assert some[0][merkle.TOP, 0][0].hex() == want


def test_manifest_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, source string, lang string, n_chars long, text string")
    assert merkle.manifest(none).collect() == []


def plain_trie(turns):
    """(conv_id, turn, role, text) -> the contract's rows, by following every prefix."""
    own = {}
    mark = lambda r, x: hashlib.sha256(f"{len((r or '').encode())}:{r or ''}{x or ''}".encode()).digest()
    for c, t, r, x in turns:
        if c is not None:
            own.setdefault(c, []).append((t is not None, t or 0, mark(r, x), (r or "", x or "")))
    own = {c: [said for *_, said in sorted(rows, key=lambda v: v[:3])] for c, rows in own.items()}
    members, ends = {}, {}
    for c, said in own.items():
        base, h = c - int(np.fmod(c, 100)), zlib.crc32(str(c).encode()) % 6
        path = tuple([*own.get(base, [])[:h], *said[h:]])
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append(c)
        ends.setdefault(path, []).append(c)
    for p, who in members.items():
        below = [q for q in members if q[: len(p)] == p]
        inner = {q[:-1] for q in members if q}
        yield (min(who), len(p), min(members[p[:-1]]) if p else None, len(who), sum(len(q) == len(p) + 1 for q in below), sum(q not in inner for q in below),
               sum((len(members[q]) - 1) * len(q[-1][1]) for q in below if q), digest(",".join(map(str, sorted(ends.get(p, []))))))


@pytest.mark.parametrize("crowd", [10_000, 6, 0])
def test_trie_is_the_one_of_plain_python(spark, crowd):
    rng = random.Random(4)
    turns = [(c, t, rng.choice(["user", "user", None]), rng.choice(["a", "a", "éé", "", None])) for c in [*range(-130, 250, 7), *range(1000, 1060)] for t in range(rng.randrange(1, 9))]
    turns += [(5, None, "x", "y"), (5, None, "x", "y"), (None, 1, "user", "nobody"), (2**40, 0, "user", "a"), (2000, 0, "user", "w " * 50_000)]
    turns += [(c, t, "user", str(t)) for c in (3000, 3001, 3002) for t in range(60)]  # a long path that is shared
    df = spark.createDataFrame(turns, "conv_id long, turn int, role string, text string").withColumns({"key": F.lit("k"), "depth": F.lit(1), "weight": F.lit(2), "last": F.lit(True)})
    got = sorted(map(tuple, trie.prefix_trie(df, crowd).collect()), key=repr)
    assert got == sorted(plain_trie(turns), key=repr)
    assert trie.prefix_trie(df.limit(0)).collect() == [] and trie.prefix_trie(df.where("conv_id is null")).collect() == []


def test_upper_levels_and_shards_give_one_trie(spark):
    """All conversations alike, and none with a turn: the root is there."""
    alike = spark.createDataFrame([(c, t, "user", "same") for c in range(1, 400, 3) for t in range(7)], "conv_id long, turn int, role string, text string")
    rows = [tuple(r) for r in alike.collect()]
    assert sorted(map(tuple, trie.prefix_trie(alike, 0).collect()), key=repr) == sorted(plain_trie(rows), key=repr)
    few = alike.where("turn = 0 and conv_id in (1, 4)")
    assert sorted(map(tuple, trie.prefix_trie(few).collect()), key=repr) == sorted(plain_trie([tuple(r) for r in few.collect()]), key=repr)


def test_louds_gives_parents_and_degrees():
    levels = [np.array([-1, -1]), np.array([0, 0, 1]), np.array([2])]
    t = trie.Louds(levels)
    assert t.parents().tolist() == [-1, -1, 0, 0, 1, 4] and t.degrees().tolist() == [2, 1, 0, 0, 1, 0]
    assert t.bits.astype(int).tolist() == [1, 1, 0, 1, 1, 0, 1, 0, 0, 0, 1, 0, 0]
    assert t.rolled(np.ones(6, np.int64)).tolist() == [3, 3, 1, 1, 2, 1]


WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def said(x):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), x or ""))


def plain_leaks(docs, items):
    cuts = {}
    for i, x in items:
        w = said(x)
        for k in range(max(1, len(w) - 9) if w else 0):
            cuts.setdefault(tuple(w[k : k + 10]), set()).add(i)
    sizes = {len(c) for c in cuts}
    for i, x in docs:
        w, hit, whose = said(x), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if (c := tuple(w[k : k + n])) in cuts:
                    hit |= set(range(k, k + n))
                    whose |= cuts[c]
        spans = [(k, next(e for e in range(k + 1, len(w) + 2) if e not in hit)) for k in sorted(hit) if k - 1 not in hit]
        yield i, len(w), [s for s in spans], sorted(str(z) for z in whose if z is not None)


def leak_tables(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice(["the", "of", "é", "Ünï", "a1", "中文", "x" * 40, *map(str, range(60))])
    text = lambda n: "".join(word() + rng.choice([" ", "\n", ", ", "-", "\x00"]) for _ in range(n))
    items = [(i, text(rng.choice([1, 2, 3, 5, 9, 10, 11, 30]))) for i in range(40)] + [(None, text(12)), (3, text(15)), (50, ""), (51, None), (52, "the"), (53, "a a a a a a a a a a a a a")]
    docs = [(i, text(rng.choice([0, 1, 4, 10, 300]))) for i in range(60)]
    for i in range(60):
        at = rng.randrange(len(items))
        x = items[at][1] or ""
        docs.append((rng.choice([None, 7, 100 + i]), text(rng.randrange(4)) + rng.choice([x, x.upper(), x[len(x) // 3 :], x[: len(x) // 2]]) + " " + text(rng.randrange(9))))
    return docs + [(200, None), (201, ""), (202, "\x00 ,;"), (203, "a " * 300), (203, "a " * 300)], items


@pytest.mark.parametrize("slab, bound", [(leaks.SLAB, leaks.BROADCAST), (64, 0)])
def test_leaks_are_those_of_plain_python(spark, monkeypatch, slab, bound):
    """With slabs so small that texts are read in many parts, and without a broadcast, alike."""
    monkeypatch.setattr(leaks, "SLAB", slab)
    monkeypatch.setattr(leaks, "BROADCAST", bound)
    docs, items = leak_tables(slab)
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"h": F.lit(1), "words": F.lit("w"), "n_words": F.lit(2), "_row": F.lit(3)})
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("window", F.lit(1))
    got = [(r.doc_id, r.n_words, [tuple(s) for s in r.spans], list(r["items"])) for r in leaks.contamination(df, bench).collect()]
    assert sorted(got, key=repr) == sorted(plain_leaks(docs, items), key=repr)
    assert leaks.contamination(df.limit(0), bench).collect() == []
    none = leaks.contamination(df, bench.limit(0)).collect()
    assert len(none) == len(docs) and not any(r.spans or r["items"] for r in none)


def test_words_of_long_texts_hash_as_short_ones_do():
    """Parts of a text, words longer than a part and texts of a megabyte and more give each word the hash that it has alone."""
    words, rng = leaks.Words(), random.Random(1)
    text = " ".join(rng.choice(["a", "bé", "Q9", "long" * 50]) for _ in range(60_000)) + " " + "y" * (3 << 20) + " end"
    column = pa.array([b"x", text.encode(), None, b"", b"y z"], pa.binary())
    got = [(int(s.row[k]), int(s.number[k]), s.word(k), int(s.hashes[k])) for s in leaks.slabs(column, words) for k in range(*s.own.indices(len(s.row)))]
    want = [(i, k, w) for i, x in enumerate(["x", text, "", "", "y z"]) for k, w in enumerate(said(x))]
    assert [g[:3] for g in got] == want
    alone = {w: int(words(np.frombuffer(w.encode(), np.uint8))[3][0]) for w in {w for *_, w in want}}
    assert len(set(alone.values())) == len(alone) and all(alone[w] == h for _, _, w, h in got)
