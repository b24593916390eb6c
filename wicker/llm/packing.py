"""Best-fit packing: pieces of tokenised documents into sequences by the sum-of-squares rule."""

from __future__ import annotations

import json
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from wicker.llm.common import checkpointed

#: Marks that end a word and that the tokenizer always parts from a letter before them; none is part of a special token.
TAIL = ".,;:!?%$#*&"
#: Letters, each of which is one letter in lower case too.
PLAIN = "^[A-Za-zÀ-ÖØ-öø-ÿ]+$"
#: What a tokenizer file has to say for words to be encoded apart: the pattern that parts words, and the mark of their ends.
WORD, WORD_END = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+", "</w>"
#: Words merged at once; bytes of the longest of them, as a merge takes as many rounds as a word has pairs; answers of the
#: tokenizer that are kept; bytes of texts taken at once.
CHUNK, LONGEST, KEPT, STEP = 16_384, 64, 100_000, 1 << 24
NONE = np.iinfo(np.int32).max


def separable(path: str) -> bool:
    """Whether texts can be encoded word by word: byte-level BPE with word ends over lower-cased words that white space
    parts, and special tokens that hold none."""
    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    model, normal, parts = told["model"], (told.get("normalizer") or {}).get("normalizers") or [], (told.get("pre_tokenizer") or {}).get("pretokenizers") or []
    if [x["type"] for x in normal] != ["NFC", "Replace", "Lowercase"] or [x["type"] for x in parts] != ["Split", "ByteLevel"]:
        return False
    spaces = normal[1]["pattern"] == {"Regex": r"\s+"} and normal[1]["content"] == " "
    parted = parts[0]["pattern"] == {"Regex": WORD} and parts[0]["behavior"] == "Removed" and parts[0]["invert"] and not parts[1]["add_prefix_space"] and not parts[1]["use_regex"]
    bpe = model["type"] == "BPE" and model["end_of_word_suffix"] == WORD_END and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
    special = not any(t["lstrip"] or t["rstrip"] or t["normalized"] or any(c.isspace() for c in t["content"]) for t in told["added_tokens"])
    return spaces and parted and bpe and special


class Merges:
    """The merges of a BPE vocabulary as arrays, which encode many words at once."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, pairs = model["vocab"], [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        # a hash table with linear probing, in which keys lie in the order of their hashes
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        self.bits = np.uint64(64 - max(8, 2 + len(keys).bit_length()))
        home = self.hashed(keys)
        order, run = np.argsort(home, kind="stable"), np.arange(len(keys))
        at = np.maximum.accumulate(home[order] - run) + run
        size = (1 << int(64 - self.bits)) + int((at - home[order]).max(initial=0)) + 2
        self.key, self.rank, self.made = np.full(size, -1, np.int64), np.full(size, NONE, np.int32), np.zeros(size, np.int32)
        self.key[at], self.rank[at], self.made[at] = keys[order], order, np.array([vocab[a + b] for a, b in pairs], np.int32)[order]
        # fixed values: the bytes that stand for themselves in a byte-level vocabulary; all others follow character 255
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        char = dict(zip(shown, map(chr, shown))) | {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)).difference(shown)))}
        self.inner, self.last = (np.array([vocab[char[b] + end] for b in range(256)], np.int32) for end in ("", WORD_END))

    def hashed(self, key: np.ndarray) -> np.ndarray:
        return (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.bits).astype(np.int64)

    def look(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rank of each pair of symbols and what it becomes; NONE where it has no merge. A negative b is no symbol."""
        key = a.astype(np.int64) << 32 | np.maximum(b, 0)
        at = self.hashed(key)
        miss = np.flatnonzero(self.key[at] != key)
        while len(miss):
            miss = miss[self.key[at[miss]] >= 0]
            at[miss] += 1
            miss = miss[self.key[at[miss]] != key[miss]]
        return np.where((self.key[at] == key) & (b >= 0), self.rank[at], NONE), self.made[at]

    def merge(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words of at least one byte, one word after the other, and how many each has.

        symbol[i] are the words' i-th symbols; after and before chain those that are left. In each round every word merges
        its pair of the lowest rank, the first of equals, until no word has any."""
        n, wide = len(starts), int(lengths.max())
        place = np.arange(wide)[:, None]
        raw = data[np.where(place < lengths, starts + place, starts)]
        symbol = np.full((wide + 1, n), -1, np.int32)
        symbol[:wide] = np.where(place < lengths - 1, self.inner[raw], np.where(place < lengths, self.last[raw], -1))
        rank, made = np.full((wide + 1, n), NONE, np.int32), np.zeros((wide + 1, n), np.int32)
        for i in range(wide - 1):
            some = np.flatnonzero(lengths > i + 1)
            rank[i, some], made[i, some] = self.look(symbol[i, some], symbol[i + 1, some])
        after = np.repeat(np.minimum(np.arange(1, wide + 2, dtype=np.int16), wide)[:, None], n, axis=1)
        before = np.repeat(np.arange(-1, wide, dtype=np.int16)[:, None], n, axis=1)
        rows = np.arange(n)
        while len(rows):
            best, at = np.full(len(rows), NONE, np.int32), np.zeros(len(rows), np.int16)
            for i in range(wide):
                r = rank[i, rows]
                less = r < best
                at[less], best[less] = i, r[less]
            some = best < NONE
            rows, at = rows[some], at[some]
            gone = after[at, rows]
            to = after[gone, rows]
            symbol[at, rows], symbol[gone, rows], rank[gone, rows] = made[at, rows], -1, NONE
            after[at, rows], before[to, rows] = to, at
            rank[at, rows], made[at, rows] = self.look(symbol[at, rows], symbol[to, rows])
            left = before[at, rows]
            has = left >= 0
            u, v = left[has], rows[has]
            rank[u, v], made[u, v] = self.look(symbol[u, v], symbol[at[has], v])
        kept = (symbol[:-1] >= 0).T
        return symbol[:-1].T[kept], kept.sum(axis=1)


def gathered(flat: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """flat[start : start + length] of every entry, one after the other."""
    ends = np.cumsum(length)
    return flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - ends + length, length)]


class Words:
    """The ids of many texts at once, from those of their distinct words.

    A word is what ASCII white space parts, for the tokenizer drops it and parts words there. Words of plain letters, last
    marks aside, are encoded in lower case by Merges; last marks, long words and all others by the tokenizer, whose answers
    to the latest of them are kept."""

    def __init__(self, path: str, end: int):
        from tokenizers import Tokenizer

        self.tokenizer, self.merges, self.end = Tokenizer.from_file(path), Merges(path), end
        self.known: dict[str, list[int]] = {}

    def plain(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of distinct words of letters in lower case, of LONGEST bytes at most: ids, and where each word's begin and how many
        they are. Words of like length are merged together, CHUNK at once."""
        data = words.cast(pa.large_binary())
        ends = np.frombuffer(data.buffers()[1], np.int64)[data.offset : data.offset + len(data) + 1]
        size, flat, start, length, at = np.diff(ends), [], np.zeros(len(data), np.int64), np.zeros(len(data), np.int64), 0
        order = np.argsort(size, kind="stable")
        for some in (order[i : i + CHUNK] for i in range(0, len(order), CHUNK)):
            ids, count = self.merges.merge(np.frombuffer(data.buffers()[2], np.uint8), ends[some], size[some])
            start[some], length[some] = at + np.cumsum(count) - count, count
            flat.append(ids)
            at += len(ids)
        return np.concatenate([*flat, np.zeros(0, np.int32)]), start, length

    def other(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same of any words."""
        texts = words.to_pylist()
        new = [x for x in texts if x not in self.known]
        if len(self.known) + len(new) > KEPT:
            self.known, new = {}, texts
        got = dict(zip(new, (x.ids for x in self.tokenizer.encode_batch(new, add_special_tokens=False)))) if new else {}
        self.known |= {x: ids for x, ids in got.items() if len(x) <= LONGEST}
        ids = [got[x] if x in got else self.known[x] for x in texts]
        length = np.array(list(map(len, ids)), np.int64)
        return np.array([x for one in ids for x in one], np.int32), np.cumsum(length) - length, length

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, each with the end id, and how many each text has."""
        parts = pc.ascii_split_whitespace(texts)
        counts, coded = pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64), parts.flatten().dictionary_encode()
        words, occurs = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
        core = pc.utf8_rtrim(words, TAIL)
        plain = pc.and_(pc.match_substring_regex(core, PLAIN), pc.less_equal(pc.binary_length(core), LONGEST))
        marked = pc.and_(plain, pc.not_equal(pc.binary_length(words), pc.binary_length(core)))
        tails = [w[n:] for w, n in zip(words.filter(marked).to_pylist(), pc.utf8_length(core.filter(marked)).to_pylist())]
        sides = [(pc.utf8_lower(core.filter(plain)), plain, self.plain), (words.filter(pc.invert(plain)), pc.invert(plain), self.other), (pa.array(tails, words.type), marked, self.other)]
        flat, used, start, length = [], 0, np.zeros((2, len(words)), np.int64), np.zeros((2, len(words)), np.int64)
        for i, (some, mask, ids_of) in enumerate(sides):
            some, mask = some.dictionary_encode(), mask.to_numpy(zero_copy_only=False)
            ids, at, n = ids_of(some.dictionary)
            which = some.indices.to_numpy(zero_copy_only=False)
            start[i // 2, mask], length[i // 2, mask] = used + at[which], n[which]
            flat.append(ids)
            used += len(ids)
        flat = np.append(gathered(np.concatenate(flat), start.T.ravel(), length.T.ravel()), np.int32(self.end))
        length = np.append(length.sum(axis=0), 1)
        order = np.insert(occurs, np.cumsum(counts), len(words))
        ids = gathered(flat, (np.cumsum(length) - length)[order], length[order])
        ends = np.cumsum(length[order])[np.cumsum(counts + 1) - 1]
        return ids, np.diff(ends, prepend=0)


class Whole(Words):
    """The same for tokenizers whose words can't be encoded apart: the library takes each whole text."""

    def __init__(self, path: str, end: int):
        from tokenizers import Tokenizer

        self.tokenizer, self.end = Tokenizer.from_file(path), end

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        ids = [[*self.tokenizer.encode(x, add_special_tokens=False).ids, self.end] for x in texts.to_pylist()]
        return np.array([x for one in ids for x in one], np.int32), np.array([len(x) for x in ids], np.int64)


def steps(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """(first, number) of runs of texts of about STEP bytes; a longer text is a run of its own."""
    ends, at = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False)), 0
    while at < len(texts):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + STEP, side="right")))
        yield at, stop - at
        at = stop


def tokenised(docs: DataFrame, tokenizer: str, end: int, size: int) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each document's ids and the end id, cut into pieces of size only if longer."""
    kind = Words if separable(tokenizer) else Whole

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = kind(tokenizer, end)
        for batch in batches:
            texts = pc.fill_null(batch.column(1), "")
            for first, n in steps(texts):
                ids, length = table.encode(texts.slice(first, n))
                ids, ends = ids.astype("<u4", copy=False), np.cumsum(length)
                pieces = -(-length // size)
                row = np.repeat(np.arange(n), pieces)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = piece * size
                part = np.minimum(size, length[row] - start)
                at = ((ends - length)[row] + start).tolist()
                crc = [crc32(ids[a : a + k]) for a, k in zip(at, part.tolist())]
                yield pa.record_batch([batch.column(0).slice(first, n).take(pa.array(row)), *(pa.array(x, t) for x, t in ((piece, pa.int32()), (start, pa.int64()), (part, pa.int64()), (crc, pa.int64())))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def sum_of_squares(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The bin and the place in it of each item, in the order of lengths given.

    Where a document goes, the squared counts of open bins per residual gap become smallest: moving a bin from gap g to
    g - s changes their sum by 2 (N[g-s] - N[g]) + 2, closing one takes 2 N[g] - 1 away, a new bin adds 2 N[size-s] + 1.
    Of equal changes the smallest gap wins, and an open bin before a new one."""
    count = np.zeros(size + 1, np.int64)
    bins: list[list[int]] = [[] for _ in range(size + 1)]
    to, at, n = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    for k, s in enumerate(lengths.tolist()):
        change = 2 * (count[: size - s] - count[s:size]) + 2  # for the gaps s..size-1
        if len(change):
            change[0] = 1 - 2 * count[s]
        change[count[s:size] == 0] = np.iinfo(np.int64).max
        new = 2 * count[size - s] + 1 if s < size else 0
        best = int(change.argmin()) if len(change) else -1
        if best >= 0 and change[best] <= new:
            gap = best + s
            b = bins[gap].pop()
            count[gap] -= 1
        else:
            gap, b, n = size, n, n + 1
        to[k], at[k] = b, size - gap
        if gap > s:
            bins[gap - s].append(b)
            count[gap - s] += 1
    return to, at


def pack(pieces: DataFrame, size: int, shard: int = 20_000) -> DataFrame:
    """pieces (doc_id, piece, length, ...) with sequence_id and offset: each sequence holds at most size tokens, gapless from 0.

    The pieces are dealt to shards of about ``shard`` each, by a hash of where a row stands, so that rows that repeat part
    too; the rows have to keep their places when they are read again, as those of a checkpoint do. A shard is packed by
    sum_of_squares in falling order of length: it wastes a sequence or two of several thousand, and no task holds more than its
    shards. Ties go by doc_id and piece, repeated rows in any order."""
    n = pieces.count()
    shards = max(1, -(-n // shard))
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], kind="stable")
        to, at = sum_of_squares(group["length"].to_numpy(), size)
        return group.assign(sequence_id=group["shard"] + to * shards, offset=at).drop(columns="shard")

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"
    return dealt.groupBy("shard").applyInPandas(run, schema)


def pack_documents(docs: DataFrame, tokenizer: str, size: int = 4096, end: int = 1) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: all documents' tokens in as few sequences as this finds.

    A null text counts as empty and gives the end id alone; each row of docs is packed, repeated ones too; other
    columns are left out; an empty table gives no rows. Pieces are checkpointed, for their number is needed first."""
    return pack(checkpointed(tokenised(docs, tokenizer, end, size)), size)
