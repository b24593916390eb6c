"""Media columns: AVI files of motion-JPEG frames, written, indexed, decoded and cut into shots."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from hashlib import sha256
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Samples in a row of a frame, rows in a frame at most, frames a second.
WIDTH, ROWS, RATE = 64, 64, 25
#: The bits of a difference's category: category s takes 9 - s bits and s more follow, so every difference takes 9; the one
#: AC code, end of block, takes 1. All-one codes stay unused, as the format asks.
DC_LENGTHS = bytes([1] * 9 + [0] * 7)
DC_VALUES = bytes(range(8, -1, -1))
AC_LENGTHS, AC_VALUES = bytes([1] + [0] * 15), b"\0"

def _codes() -> np.ndarray:
    """The ten bits of a block (difference and end of block) for differences -255..255, at difference + 255."""
    out = np.zeros(511, np.uint64)
    for d in range(-255, 256):
        s = abs(d).bit_length()
        prefix = (1 << (9 - s)) - 2  # 0, 10, 110, ...
        out[d + 255] = ((prefix << s) | (d if d >= 0 else d + (1 << s) - 1)) << 1
    return out


_CODE = _codes()
_DIFFERENCE = np.zeros(1024, np.int16)
_DIFFERENCE[_CODE.astype(int)] = np.arange(-255, 256)


def jpeg(samples: np.ndarray) -> bytes:
    """A baseline frame whose block (r, c) is flat with the 8-bit sample [r, c]: only its DC coefficient is set, at a
    quantiser of 8, so decoding gives each sample back exactly, 64 times."""
    h, w = samples.shape
    level = samples.ravel().astype(np.int64) - 128
    bits = _CODE[np.diff(level, prepend=0) + 255]
    pad = -len(bits) % 4
    bits = np.concatenate([bits, np.full(pad, _CODE[255], np.uint64)]).reshape(-1, 4)
    word = bits[:, 0] << np.uint64(30) | bits[:, 1] << np.uint64(20) | bits[:, 2] << np.uint64(10) | bits[:, 3]
    scan = word.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 3:].tobytes()[: (h * w * 10 + 7) // 8].replace(b"\xff", b"\xff\x00")
    part = lambda mark, body: b"\xff" + bytes([mark]) + struct.pack(">H", len(body) + 2) + body
    return b"\xff\xd8" + part(0xDB, b"\0" + bytes([8] * 64)) + part(0xC0, struct.pack(">BHHB3B", 8, 8 * h, 8 * w, 1, 1, 0x11, 0)) + part(0xC4, b"\0" + DC_LENGTHS + DC_VALUES + b"\x10" + AC_LENGTHS + AC_VALUES) + part(0xDA, bytes([1, 1, 0, 0, 63, 0])) + scan + b"\xff\xd9"


def huffman(lengths: bytes, values: bytes) -> dict[tuple[int, int], int]:
    """(length, code) -> value of a canonical table."""
    out, code, k = {}, 0, 0
    for n, count in enumerate(lengths, 1):
        for _ in range(count):
            out[n, code] = values[k]
            code, k = code + 1, k + 1
        code <<= 1
    return out


def dc_image(frame: bytes) -> np.ndarray:
    """The DC levels (block means, 0..255) of a baseline grey frame, [row, column] of its blocks.

    Any Huffman tables do; AC coefficients are read and passed over. Frames with jpeg()'s tables are read all at once."""
    at, tables, quant, h, w = 2, {}, {}, 0, 0
    while True:
        mark, size = frame[at + 1], int.from_bytes(frame[at + 2 : at + 4], "big")
        body, at = frame[at + 4 : at + 2 + size], at + 2 + size
        if mark == 0xC4:
            while body:
                n = sum(body[1:17])
                tables[body[0]], body = (body[1:17], body[17 : 17 + n]), body[17 + n :]
        elif mark == 0xDB:
            while body:
                wide = 2 if body[0] >> 4 else 1
                quant[body[0] & 15], body = int.from_bytes(body[1 : 1 + wide], "big"), body[1 + 64 * wide :]
        elif mark == 0xC0:
            h, w, parts, q = -(-int.from_bytes(body[1:3], "big") // 8), -(-int.from_bytes(body[3:5], "big") // 8), body[5], body[8]
            if parts != 1:
                raise ValueError("grey frames only")
        elif 0xC1 <= mark <= 0xCF:
            raise ValueError("baseline frames only")
        elif mark == 0xDA:
            dc, ac = tables[body[2] >> 4], tables[0x10 | body[2] & 15]
            break
    scan = frame[at : frame.rindex(b"\xff\xd9")].replace(b"\xff\x00", b"\xff")
    n = h * w
    if dc == (DC_LENGTHS, DC_VALUES) and ac == (AC_LENGTHS, AC_VALUES):
        raw = np.frombuffer(scan + bytes(-len(scan) % 5), np.uint8).reshape(-1, 5).astype(np.uint64)
        word = raw[:, 0] << np.uint64(32) | raw[:, 1] << np.uint64(24) | raw[:, 2] << np.uint64(16) | raw[:, 3] << np.uint64(8) | raw[:, 4]
        ten = np.stack([word >> np.uint64(s) & np.uint64(1023) for s in (30, 20, 10, 0)], axis=1).ravel()[:n]
        level = np.cumsum(_DIFFERENCE[ten.astype(np.int64)])
    else:
        level, bits, where = np.zeros(n, np.int64), "".join(f"{b:08b}" for b in scan), 0
        dc, ac = huffman(*dc), huffman(*ac)

        def symbol(table: dict) -> int:
            nonlocal where
            for size in range(1, 17):
                if (size, int(bits[where : where + size], 2)) in table:
                    where += size
                    return table[size, int(bits[where - size : where], 2)]
            raise ValueError("no such code")

        last = 0
        for i in range(n):
            s = symbol(dc)
            v = int(bits[where : where + s] or "0", 2)
            where += s
            last += v if not s or v >> (s - 1) else v - (1 << s) + 1
            level[i], k = last, 1
            while k < 64:
                run = symbol(ac)
                if not run:
                    break
                where += run & 15
                k += (run >> 4) + 1
    return np.clip(level * quant[q] // 8 + 128, 0, 255).astype(np.uint8).reshape(h, w)


def chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def write_avi(payload: bytes) -> bytes:
    """Payload, a multiple of 64 bytes, as a grey motion-JPEG film: its bytes are the samples, row by row. The last frame is
    filled with zeros; an INFO chunk has the payload's length, idx1 where each frame is."""
    rows = len(payload) // WIDTH
    frames = max(1, -(-rows // ROWS))
    height = max(1, -(-rows // frames))
    data = np.frombuffer(payload, np.uint8)
    data = np.concatenate([data, np.zeros(frames * height * WIDTH - len(data), np.uint8)]).reshape(frames, height, WIDTH)
    pictures = [chunk(b"00dc", jpeg(x)) for x in data]
    places = np.cumsum([4] + [len(p) for p in pictures])
    index = b"".join(b"00dc" + struct.pack("<III", 16, at, struct.unpack("<I", p[4:8])[0]) for at, p in zip(places.tolist(), pictures))
    main = struct.pack("<14I", 1_000_000 // RATE, 0, 0, 0x10, frames, 0, 1, 0, 8 * WIDTH, 8 * height, 0, 0, 0, 0)
    stream = b"vidsMJPG" + struct.pack("<IHH8I4H", 0, 0, 0, 0, 1, RATE, 0, frames, 0, 0xFFFFFFFF, 0, 0, 0, 8 * WIDTH, 8 * height)
    form = struct.pack("<IiiHH4sIiiII", 40, 8 * WIDTH, 8 * height, 1, 24, b"MJPG", 0, 0, 0, 0, 0)
    head = chunk(b"LIST", b"hdrl" + chunk(b"avih", main) + chunk(b"LIST", b"strl" + chunk(b"strh", stream) + chunk(b"strf", form)))
    info = chunk(b"LIST", b"INFO" + chunk(b"ICMT", str(len(payload)).encode()))
    return chunk(b"RIFF", b"AVI " + head + info + chunk(b"LIST", b"movi" + b"".join(pictures)) + chunk(b"idx1", index))


def read_avi(media: bytes) -> tuple[list[np.ndarray], int, float]:
    """The DC images of the frames that the index lists, the payload's length (-1 if it isn't told) and frames a second."""
    found, length, rate, movi, index = [], -1, float(RATE), 0, b""
    todo = [(12, 8 + struct.unpack("<I", media[4:8])[0])]
    while todo:
        at, end = todo.pop()
        while at + 8 <= end:
            name, size = media[at : at + 4], struct.unpack("<I", media[at + 4 : at + 8])[0]
            if name == b"LIST":
                if media[at + 8 : at + 12] == b"movi":
                    movi = at + 8
                else:
                    todo.append((at + 12, at + 8 + size))
            elif name == b"avih":
                rate = 1e6 / max(1, struct.unpack("<I", media[at + 8 : at + 12])[0])
            elif name == b"ICMT":
                length = int(media[at + 8 : at + 8 + size])
            elif name == b"idx1":
                index = media[at + 8 : at + 8 + size]
            at += 8 + size + size % 2
    for i in range(0, len(index), 16):
        if index[i + 2 : i + 4] == b"dc":
            at, size = struct.unpack("<II", index[i + 8 : i + 16])
            found.append(dc_image(media[movi + at + 8 : movi + at + 8 + size]))
    return found, length, rate


def shots(frames: list[np.ndarray], bins: int = 32, window: int = 8, factor: float = 2.0, floor: float = 0.1) -> list[tuple[int, int]]:
    """(first, last) frame of each shot. A cut is where the histograms of neighbours differ by more than factor times the
    mean difference of the ``window`` steps around, and by more than floor (a share of the samples)."""
    if not frames:
        return []
    h = np.array([np.bincount(x.ravel() >> 3, minlength=bins) / x.size for x in frames])
    d = np.abs(np.diff(h, axis=0)).sum(axis=1) / 2
    total = np.concatenate([[0], np.cumsum(d)])
    at = np.arange(len(d))
    low, high = np.maximum(0, at - window), np.minimum(len(d), at + window + 1)
    around = (total[high] - total[low] - d) / np.maximum(1, high - low - 1)
    first = [0, *(np.flatnonzero((d > factor * around) & (d > floor)) + 1).tolist()]
    return list(zip(first, [*(x - 1 for x in first[1:]), len(frames) - 1]))


def payload_of(text: str | None) -> tuple[bytes, int]:
    data = (text or "").encode()
    return data + bytes(-len(data) % 64 if data else 64), len(data)


def encode_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media: each text's UTF-8 bytes (null: none), filled with zeros to a positive multiple of 64, as an
    AVI file. Every row of docs gives a row; other columns are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                got = [payload_of(x) for x in part.column(1).to_pylist()]
                yield pa.record_batch([part.column(0), pa.array([n for _, n in got], pa.int64()), pa.array([write_avi(p) for p, _ in got], pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


READ = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, clips array<struct<first:int,last:int,start:double,end:double,level:double>>"
KINDS = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("start", pa.float64()), ("end", pa.float64()), ("level", pa.float64())]))]
NAMES = ["doc_id", "n_bytes", *(x.split(" ")[0] for x in READ.split(", "))]


def read_film(media: bytes) -> tuple:
    """The values of READ of one film: its payload's digests, its own, and a clip for each shot."""
    frames, length, rate = read_avi(media)
    payload = b"".join(x.tobytes() for x in frames)[:length]
    cut = [{"first": a, "last": b, "start": a / rate, "end": (b + 1) / rate, "level": float(np.mean([x.mean() for x in frames[a : b + 1]]))} for a, b in shots(frames)]
    return len(payload), sha256(payload).hexdigest(), crc32(payload[-64:]), len(media), sha256(media).hexdigest(), cut


def clips(films: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256 and clips: what reading the media
    column back gives, with a clip (first and last frame, start and end in seconds, mean level) for each shot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (b.slice(i, 256) for b in batches for i in range(0, b.num_rows, 256)):
            rows = [(doc.as_py(), n.as_py(), *read_film(media.as_py())) for doc, n, media in zip(*part.columns)]
            yield pa.record_batch([pa.array(x, k) for x, k in zip(zip(*rows), KINDS)], NAMES)

    return films.select("doc_id", "n_bytes", "media").mapInArrow(run, f"doc_id long, n_bytes long, {READ}")


def document_clips(docs: DataFrame) -> DataFrame:
    """clips(encode_documents(docs)) in one pass: each text becomes a film, whose bytes are read back before the next one's, so
    a task holds one film at a time and no film goes through a second worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (b.slice(i, 256) for b in batches for i in range(0, b.num_rows, 256)):
            rows = []
            for doc, text in zip(*part.columns):
                payload, n = payload_of(text.as_py())
                rows.append((doc.as_py(), n, *read_film(write_avi(payload))))
            yield pa.record_batch([pa.array(x, k) for x, k in zip(zip(*rows), KINDS)], NAMES)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, f"doc_id long, n_bytes long, {READ}")
