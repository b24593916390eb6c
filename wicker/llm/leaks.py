"""Benchmark decontamination: a prefix-filtered join of item windows with documents, verified word by word.

A window is some consecutive words of an item. Its shingles, runs of up to three of its words, are ordered by how often documents
hold them: as a window occurs whole or not at all, its prefix is its rarest shingle alone, and where even that never occurs the
window doesn't either. Documents send the words around each place of a prefix shingle; the join on the shingle brings the
windows, a window's length and the shingle's place in it say where it would lie, and all its words are compared there."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from wicker.llm.common import Filter, checkpointed, numbered_rows

#: Words of a window, and of a shingle at most.
WINDOW, SHINGLE = 10, 3
#: Bytes of text that are looked at together; bytes of windows that every task may get.
SLAB, BROADCAST = 1 << 20, 1 << 25
#: An odd number, which has an inverse modulo 2^64.
BASE, RING = 0x9E3779B97F4A7C15, 1 << 64

#: What stands for each byte: lower-cased, and 0 where it is of no word. Bytes from 0x80 are of letters beyond ASCII.
LOWER = np.zeros(256, np.uint8)
for _a, _b in ((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF)):
    LOWER[_a : _b + 1] = np.arange(_a, _b + 1)
LOWER[0x41:0x5B] = np.arange(0x61, 0x7B)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


class Words:
    """Where the words of UTF-8 bytes begin and end, and a hash of 64 bits of each, wherever it stands: sums of bytes times powers
    of BASE, taken SLAB bytes at a time, so that a word of any length costs little memory."""

    def __init__(self):
        table = lambda base: np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(SLAB - 1, base, np.uint64)]), dtype=np.uint64)
        self.inverse = pow(BASE, -1, RING)
        self.up, self.down = table(BASE), table(self.inverse)

    def __call__(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(lower-cased bytes, starts, ends, hashes)."""
        low = LOWER[data]
        edge = np.flatnonzero(np.diff((low > 0).astype(np.int8), prepend=0, append=0))
        starts, ends = edge[::2], edge[1::2]
        with np.errstate(over="ignore"):
            sums, carry = np.zeros(len(edge), np.uint64), np.uint64(0)
            for c in range(0, len(low), SLAB):
                part = low[c : c + SLAB]
                run, shift = np.cumsum(part * self.up[: len(part)], dtype=np.uint64), np.uint64(pow(BASE, c, RING))
                a, b = np.searchsorted(edge, (c + 1, c + len(part) + 1))
                sums[a:b] = carry + run[edge[a:b] - c - 1] * shift
                carry = carry + run[-1] * shift
            back = np.array([pow(self.inverse, c, RING) for c in range(0, len(low) + 1, SLAB)], np.uint64)[starts // SLAB] * self.down[starts % SLAB]
            return low, starts, ends, mixed((sums[1::2] - sums[::2]) * back + (ends - starts).astype(np.uint64))


def shingle_hashes(h: np.ndarray, width: int) -> np.ndarray:
    """A hash for each ``width`` consecutive words, in terms of theirs."""
    n = max(0, len(h) - width + 1)
    out = np.full(n, width, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            out = mixed(out * np.uint64(BASE) + h[k : n + k])
    return out


@dataclass
class Slab:
    """Words of some rows, or of a part of a long one: where they stand, their hashes, rows and numbers in the row. own are those
    to look at; the others stand beside them."""

    low: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    row: np.ndarray
    number: np.ndarray
    own: slice

    def shingles(self, width: int, wanted: Filter) -> tuple[np.ndarray, np.ndarray]:
        """(places, hashes) of own shingles that the filter lets through; none goes from one row to the next."""
        h = shingle_hashes(self.hashes, width)[self.own]
        at = np.flatnonzero(wanted(h))
        place = at + self.own.start
        whole = self.row[place] == self.row[place + width - 1]
        return place[whole], h[at[whole]]

    def word(self, i: int) -> str:
        return self.low[self.starts[i] : self.ends[i]].tobytes().decode(errors="replace")


def slabs(column: pa.Array, words: Words) -> Iterator[Slab]:
    """A column of binary values, null as empty, as slabs of about SLAB bytes, rows in order."""
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    a = 0
    while a < len(column):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + SLAB, side="right")) - 1)
        part, size = data[offsets[a] : offsets[b]], np.diff(offsets[a : b + 1])
        if len(part) > SLAB:
            yield from long_slabs(part, a, words)
        else:
            joined = np.zeros(len(part) + b - a, np.uint8)  # a byte between rows that is of no word
            joined[np.arange(len(part)) + np.repeat(np.arange(b - a), size)] = part
            low, starts, ends, h = words(joined)
            row = np.searchsorted(offsets[a:b] - offsets[a] + np.arange(b - a), starts, side="right") - 1
            number = np.arange(len(starts)) - np.searchsorted(row, row)
            yield Slab(low, starts, ends, h, row + a, number, slice(0, len(starts)))
        a = b


def long_slabs(text: np.ndarray, row: int, words: Words) -> Iterator[Slab]:
    """A long text in parts that end between words, each led by the last words of the one before."""
    tail, a, number, own = text[:0], 0, 0, 0
    while a < len(text):
        b = min(a + SLAB, len(text))
        while b < len(text):  # on to where a word ends
            gap = np.flatnonzero(LOWER[text[b : b + SLAB]] == 0)
            b = b + int(gap[0]) if len(gap) else min(b + SLAB, len(text))
            if len(gap):
                break
        low, starts, ends, h = words(np.concatenate([tail, text[a:b]]))
        n = len(starts)
        stop = n if b == len(text) else max(own, n - WINDOW)
        yield Slab(low, starts, ends, h, np.full(n, row), np.arange(number, number + n), slice(own, stop))
        keep = max(0, stop - WINDOW)
        tail = low[starts[keep] :] if keep < n else low[:0]
        a, own, number = b, stop - keep, number + keep


def windows(items: DataFrame, size: int = WINDOW) -> DataFrame:
    """(item_id, words, window): the windows of all items, each once for an item, and a digest that names it."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                low, starts, ends, _ = words(np.frombuffer(text or b"", np.uint8))
                said = [low[a:b].tobytes().decode(errors="replace") for a, b in zip(starts, ends)]
                n = max(1, len(said) - size + 1) if said else 0
                for a in range(0, n, 4096):
                    rows = [said[k : k + size] for k in range(a, min(a + 4096, n))]
                    yield pa.record_batch([pa.array([i] * len(rows), pa.int64()), pa.array(rows, pa.list_(pa.string()))], ["item_id", "words"])

    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(cut, "item_id long, words array<string>").distinct().withColumn("window", F.unhex(F.sha2(F.array_join("words", " "), 256)))


def shingled(distinct: DataFrame) -> DataFrame:
    """(window, place, h): the shingles of each window by their place in it."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            out = []
            for window, said in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                h = words(np.frombuffer(" ".join(said).encode(), np.uint8))[3]
                out += [(window, k, x) for k, x in enumerate(shingle_hashes(h, min(SHINGLE, len(h))).view(np.int64).tolist())]
            columns = zip(*out) if out else [[]] * 3
            yield pa.record_batch([pa.array(list(c), t) for c, t in zip(columns, (pa.binary(), pa.int32(), pa.int64()))], ["window", "place", "h"])

    return distinct.select("window", "words").mapInArrow(each, "window binary, place int, h long")


def counted(docs: DataFrame, wanted: Filter, widths: list[int]) -> DataFrame:
    """(h, n): how often all documents hold each hash that the filter lets through."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            for slab in slabs(batch.column(0), words):
                found = [slab.shingles(w, wanted)[1] for w in widths]
                value, n = np.unique(np.concatenate(found or [np.zeros(0, np.uint64)]), return_counts=True)
                yield pa.record_batch([pa.array(value.view(np.int64)), pa.array(n.astype(np.int64))], ["h", "n"])

    return docs.select(F.col("text").cast("string").cast("binary")).mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def rarest(distinct: DataFrame, docs: DataFrame, widths: list[int]) -> DataFrame:
    """(h, place, words, window): each window's rarest shingle in documents, for windows all of whose shingles occur there."""
    grams = checkpointed(shingled(distinct))
    n = counted(docs, Filter(grams.select("h").distinct()), widths)
    known = grams.join(n, "h", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    first = known.groupBy("window").agg(F.min(F.struct("n", "h", "place")).alias("s")).where("s.n > 0")
    return first.join(distinct, "window").select("s.h", "s.place", "words", "window")


def looked_at(docs: DataFrame, wanted: Filter, widths: list[int]) -> DataFrame:
    """A row for each document with its n_words, and one for each place of a shingle that the filter lets through: its hash, its
    number among the words, the words around it and its place in these."""
    kind = docs.schema["doc_id"].dataType
    schema = f"_file long, _row long, doc_id {kind.simpleString()}, n_words long, h long, number long, at int, around array<string>"

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            file, row, doc, text = batch.columns
            n_words = np.zeros(batch.num_rows, np.int64)
            for slab in slabs(text, words):
                np.add.at(n_words, slab.row[slab.own], 1)
                for w in widths:
                    place, h = slab.shingles(w, wanted)
                    for k in range(0, len(place), 4096):
                        some = place[k : k + 4096]
                        low = np.maximum(np.maximum(some - WINDOW + w, 0), np.searchsorted(slab.row, slab.row[some]))
                        high = np.minimum(some + WINDOW, np.searchsorted(slab.row, slab.row[some], side="right"))
                        around = [[slab.word(i) for i in range(a, b)] for a, b in zip(low.tolist(), high.tolist())]
                        at = pa.array(slab.row[some])
                        none = lambda t: pa.nulls(len(some), t)
                        yield pa.record_batch([file.take(at), row.take(at), none(doc.type), none(pa.int64()), pa.array(h[k : k + 4096].view(np.int64)), pa.array(slab.number[some]), pa.array((some - low).astype(np.int32)), pa.array(around, pa.list_(pa.string()))], names)
            none = lambda t: pa.nulls(batch.num_rows, t)
            yield pa.record_batch([file, row, doc, pa.array(n_words), none(pa.int64()), none(pa.int64()), none(pa.int32()), none(pa.list_(pa.string()))], names)

    names = [f.split()[0] for f in schema.split(", ")]
    return numbered_rows(docs).select("_file", "_row", "doc_id", F.col("text").cast("string").cast("binary").alias("text")).mapInArrow(look, schema)


def contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, n_words, spans, items) for every row of docs: spans are the stretches of its words, as first and end, that lie in
    windows of items, ascending and apart; items the ids of those items, ascending as text.

    Words are runs of ASCII letters and digits and of all characters beyond ASCII, A-Z lower-cased. A window is WINDOW
    consecutive words of an item, or all of a shorter one's; items and documents without words, null texts among them, have
    none. Rows are told apart by their place, so a doc_id may be null or repeat; items of one item_id are one, the windows
    of a null item_id count for spans and aren't among items. Other columns are left out; an empty table gives no rows."""
    docs = docs.select("doc_id", "text")
    cuts = checkpointed(windows(items))
    distinct = cuts.select("window", "words").distinct()
    widths = sorted(r.w for r in distinct.select(F.least(F.size("words"), F.lit(SHINGLE)).alias("w")).distinct().collect())
    prefix = checkpointed(rarest(distinct, docs, widths))
    found = checkpointed(looked_at(docs, Filter(prefix.select("h").distinct()), widths))
    size = prefix.agg(F.sum(F.length(F.array_join("words", " ")) + 64)).first()[0] or 0
    known = F.broadcast(prefix) if size <= BROADCAST else prefix
    begin = F.col("at") - F.col("place")
    fits = (begin >= 0) & (begin + F.size("words") <= F.size("around"))
    met = found.where("h is not null").join(known, "h").where(fits).where(F.slice("around", F.greatest(begin, F.lit(0)) + 1, F.size("words")) == F.col("words"))
    met = checkpointed(met.select("_file", "_row", (F.col("number") - F.col("place")).alias("first"), (F.col("number") - F.col("place") + F.size("words")).alias("end"), "window"))

    over = Window.partitionBy("_file", "_row").orderBy("first", "end")
    before = F.max("end").over(over.rowsBetween(Window.unboundedPreceding, -1))
    lines = met.select("_file", "_row", "first", "end").distinct().withColumn("new", F.when(F.col("first") <= before, 0).otherwise(1))
    lines = lines.withColumn("k", F.sum("new").over(over.rowsBetween(Window.unboundedPreceding, 0))).groupBy("_file", "_row", "k").agg(F.min("first").alias("first"), F.max("end").alias("end"))
    spans = lines.groupBy("_file", "_row").agg(F.sort_array(F.collect_list(F.struct("first", "end"))).alias("spans"))
    named = met.select("_file", "_row", "window").distinct().join(cuts.where("item_id is not null").select("window", "item_id"), "window")
    whose = named.select("_file", "_row", F.col("item_id").cast("string").alias("item")).groupBy("_file", "_row").agg(F.sort_array(F.collect_set("item")).alias("items"))
    rows = found.where("n_words is not null").select("_file", "_row", "doc_id", "n_words")
    none = F.expr("array()")
    whole = rows.join(spans, ["_file", "_row"], "left").join(whose, ["_file", "_row"], "left")
    return whole.select("doc_id", "n_words", F.coalesce("spans", none).alias("spans"), F.coalesce("items", none).alias("items"))
