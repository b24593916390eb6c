"""SentencePiece encoding and decoding by a table of distinct marked words."""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, functions as F

from wicker.llm.common import Table

MARK = "▁"
#: A chunk is a run of space marks and the characters up to the next mark or new line, or a new line and what follows.
CHUNK = re.compile(r" +[^ \n]*|\n[^ \n]*")


def separable(model: str) -> bool:
    """Whether chunks can be encoded apart: BPE with plain normalisation, a mark before the text, kept spaces, and no
    piece with a mark after another character, with a new line, or taken from texts as a whole."""
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    with open(model, "rb") as f:
        proto.ParseFromString(f.read())
    n = proto.normalizer_spec
    plain = n.name == "identity" and n.add_dummy_prefix and not n.remove_extra_whitespaces and n.escape_whitespaces and not n.precompiled_charsmap
    return bool(plain) and proto.trainer_spec.model_type == 2 and not any(MARK in p.piece.lstrip(MARK) or "\n" in p.piece or p.type == 4 for p in proto.pieces)


class Chunks(Table):
    """The distinct-chunk table of a task: chunk -> (its ids in decimal, their number, the chunk decoded)."""

    def __init__(self, model: str):
        super().__init__()
        self.model = sentencepiece.SentencePieceProcessor(model_file=model)
        self.mark = self.model.piece_to_id(MARK)

    def made(self, chunk: str) -> tuple[str, int, str]:
        # encode() puts a mark before its text: that is the chunk's first space, or one too many before a new line
        if chunk == " ":
            ids = [self.mark]
        else:
            ids = self.model.encode(chunk[1:]) if chunk[0] == " " else self.model.encode(chunk)[1:]
        said = self.model.decode([self.mark, *ids])  # decode() drops one mark
        return " ".join(map(str, ids)), len(ids), chunk if said == chunk else said

    def text(self, text: str) -> tuple[str, int, str]:
        """Of a whole text, with the end id: ids in decimal, their number, the text decoded from them."""
        end = str(self.model.eos_id())
        if not text:
            return end, 1, ""
        ids, counts, said = zip(*map(self.__getitem__, CHUNK.findall(" " + text.replace(MARK, " "))))
        return f"{' '.join(ids)} {end}", sum(counts) + 1, "".join(said)[1:]


class Plain(Chunks):
    """The same for models whose chunks can't be encoded apart: the library takes each whole text."""

    def text(self, text: str) -> tuple[str, int, str]:
        ids = [*self.model.encode(text), self.model.eos_id()]
        return " ".join(map(str, ids)), len(ids), self.model.decode(ids)


def encode_documents(docs: DataFrame, model: str, digests: bool = False) -> DataFrame:
    """doc_id, n_tokens, and ids (decimal, joined by one space) with decoded text, or their SHA-256 in digests' place.

    A null text counts as empty and gives the end id alone; each row of docs gives a row, other columns are left out.
    Every task keeps a table of the distinct chunks that it has met and takes their ids from it in the text's order,
    so nothing is shuffled, no position is stored, and the table's size doesn't follow the corpus."""
    kind = Chunks if separable(model) else Plain

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = kind(model)
        for batch in batches:
            for part in (batch.slice(i, 512) for i in range(0, batch.num_rows, 512)):
                got = [table.text(x or "") for x in part.column(1).to_pylist()]
                ids, said = [x[0] for x in got], [x[2] for x in got]
                if digests:
                    ids, said = ([sha256(x.encode()).hexdigest() for x in texts] for texts in (ids, said))
                yield pa.record_batch([part.column(0), pa.array([x[1] for x in got], pa.int64()), pa.array(ids, pa.string()), pa.array(said, pa.string())], ["doc_id", "n_tokens", "ids", "decoded"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_tokens long, ids string, decoded string")
