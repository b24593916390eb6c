"""Each registered query as the entry point runs it, on tables with nulls, empty and long texts, ties, repeated rows and extra
columns whose names clash: against DuckDB where there is SQL, else against plain Python; and on empty tables."""

import hashlib
import zlib

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from wicker.llm import site_tree
from wicker.llm.queries import OPERATORS, ORACLE, QUERIES, vocabulary

TABLES = ["documents", "labels", "embeddings", "pages", "conversations", "benchmark"]
SMALL = "/root/testdata/sf0.001"
KEY = "AKIA" + "Q7" * 8
TEXTS = [
    None, "", " \t\r\n", "one", "one two three", "One  two\x0bthree", "É▁İ <|endoftext|> \x00 ſecret=abcdefgh1", "x" * 70_000, "a b c d " * 20_000,
    f"password = 'hunter22' {KEY} API_KEY:\"0123456789abcdef0123456789abcdef\" token=short", "0" * 31 + " " + "0" * 32 + KEY, "中文字" * 500, "a" * 64]


def odd_tables():
    """Frames of the small tables with odd rows put to them."""
    t = {n: pq.read_table(f"{SMALL}/{n}.parquet").to_pandas() for n in TABLES}
    d = pd.DataFrame({"doc_id": [*range(900_000, 900_000 + len(TEXTS)), None, 900_003, 900_003], "text": [*TEXTS, "no id", "tie", "tie"], "lang": None, "source": "odd", "n_chars": None})
    d = pd.concat([t["documents"], d], ignore_index=True)
    t["documents"] = d.assign(doc_id=d["doc_id"].astype("Int64"), n_chars=d["n_chars"].astype("Int64"), score="s", base=1, spans="t", x=2.0, fp=3, ids="i")
    c = pd.DataFrame([(910_000, 0, None, None), (910_000, None, "assistant", "a\\<|end|>"), (910_000, 1, "assistant", ""), (910_000, 1, "assistant", ""), (None, 0, "system", "s"), (None, 1, "assistant", "[[INST]<s")]
                     + [(910_001, i, ["system", "user", "assistant"][min(i, 2 - i % 2)], "w " * (97 * i % 700)) for i in range(40)], columns=["conv_id", "turn", "role", "text"])
    c = pd.concat([t["conversations"], c], ignore_index=True)
    t["conversations"] = c.assign(conv_id=c["conv_id"].astype("Int64"), turn=c["turn"].astype("Int64"), window=1, formatted="f")
    size = len(t["embeddings"]["embedding"][0])
    one, rng = np.eye(size, dtype="float32")[0], np.random.default_rng(1)
    close = [one + np.float32(0.04) * rng.standard_normal(size).astype("float32") for _ in range(30)]
    odd = [None, [], [0.0] * size, [float("nan")] * size, [float("inf"), *[1.0] * (size - 1)], [None, *[1.0] * (size - 1)], [1.0, 2.0], one, one, 5 * one, -one, *close]
    e = pd.DataFrame({"vec_id": [*range(920_000, 920_000 + len(odd)), None], "embedding": [*odd, one], "label": 0})
    e = pd.concat([t["embeddings"], e], ignore_index=True)
    t["embeddings"] = e.assign(vec_id=e["vec_id"].astype("Int64"), rep=1, weight=2)
    body = f"<p>{' word' * 30_000}</p>"
    p = pd.DataFrame([(930_000, "u", None), (930_001, "u", ""), (930_002, None, "<html><body><article><p>a&amp;b</p></article></body></html>"), (930_002, None, "<p"), (930_003, "http://long/1", f"<article>{body}</article>")], columns=["page_id", "url", "html"])
    t["pages"] = pd.concat([t["pages"], p], ignore_index=True).assign(text="t", host="h")
    b = t["benchmark"]
    odd = pd.DataFrame({"item_id": [940_000, 940_001, 940_002, 940_003, 940_003, None], "text": [None, "", "One two three", b["text"][0].upper(), "b c d a b c d a b c d a", " ".join(b["text"][1].split()[:12])]})
    b = pd.concat([b, odd], ignore_index=True)
    t["benchmark"] = b.assign(item_id=b["item_id"].astype("Int64"), doc_id=1, h="h", window=2)
    return t


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    """The folder of the odd tables, and the frames."""
    folder, tables = tmp_path_factory.mktemp("odd"), odd_tables()
    for name, frame in tables.items():
        schema = pa.schema([pa.field("vec_id", pa.int64()), pa.field("embedding", pa.list_(pa.float32())), pa.field("label", pa.int32()), pa.field("rep", pa.int64()), pa.field("weight", pa.int64())]) if name == "embeddings" else None
        pq.write_table(pa.Table.from_pandas(frame, schema=schema, preserve_index=False), f"{folder}/{name}.parquet")
    return str(folder), tables


def plain(rows):
    return sorted(map(tuple, rows), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_gives_the_rows_of_its_sql(spark, odd, name):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{odd[0]}/{table}.parquet'")
    want = con.sql(ORACLE[name])
    got = QUERIES[name](spark, odd[0])
    assert got.columns == want.columns and plain(got.collect()) == plain(want.fetchall())


def texts(odd):
    d = odd[1]["documents"]
    return [(None if pd.isna(i) else int(i), x or "") for i, x in zip(d["doc_id"], d["text"])]


def test_op3(spark, odd):
    got = QUERIES["op3_main_text"](spark, odd[0]).collect()
    assert len(got) == len(odd[1]["pages"]) and all(r.n_chars == len(r.text) for r in got)
    last = plain((r.page_id, r.url, r.text) for r in got if r.page_id >= 930_000)
    assert last == plain([(930_000, "u", ""), (930_001, "u", ""), (930_002, None, "a&b"), (930_002, None, ""), (930_003, "http://long/1", " ".join(["word"] * 30_000))])


def test_op4_spans_hold_the_base_ones(spark, odd):
    got = QUERIES["op4_secret_spans"](spark, odd[0]).collect()
    assert len(got) == len(odd[1]["documents"])
    for r in got:
        base = [s for s in r.spans.split(",") if s and not s.startswith("markov")]
        assert hashlib.sha256(",".join(base).encode()).hexdigest() == r.base_sha256 and len(base) == r.n_assign + r.n_access + r.n_hex


def test_op5(spark, odd):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model"))
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for i, x in texts(odd):
        ids = model.encode(x, add_eos=True)
        want.append((i, len(ids), digest(" ".join(map(str, ids))), digest(model.decode(ids))))
    assert plain(QUERIES["op5_piece_encoding"](spark, odd[0]).collect()) == plain(want)


def test_op6(spark, odd):
    import tokenizers

    words = tokenizers.Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    want = []
    for i, x in texts(odd):
        ids = [*words.encode(x, add_special_tokens=False).ids, 1]
        want += [(i, at // 4096, at, len(ids[at : at + 4096]), zlib.crc32(np.array(ids[at : at + 4096], "<u4").tobytes())) for at in range(0, len(ids), 4096)]
    got = QUERIES["op6_best_fit_packing"](spark, odd[0]).toPandas()
    rows = [(None if pd.isna(r.doc_id) else int(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got.itertuples()]
    assert plain(rows) == plain(want)
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert s["length"].sum() <= 4096 and list(s["offset"]) == [0, *np.cumsum(s["length"])[:-1]]
    assert got["sequence_id"].nunique() <= -(-got["length"].sum() // 4096) * 1.02 + 1


@pytest.mark.parametrize("name, cut", [("op7_quality_scores", 0.5), ("op10_toxicity_scores", 0.7)])
def test_op7_and_op10(spark, odd, name, cut):
    got = QUERIES[name](spark, odd[0]).collect()
    assert plain((r.doc_id, r.held_out) for r in got) == plain((i, None if i is None else zlib.crc32(str(i).encode()) % 3 == 1) for i, _ in texts(odd))
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= cut) for r in got)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, set()).add(r.score)
    same = {}
    for i, x in texts(odd):
        if len(by[i]) == 1:
            same.setdefault(x, set()).update(by[i])
    assert all(len(s) == 1 for s in same.values())  # equal texts, equal scores


def test_op9(spark, odd):
    import re

    import xxhash

    def fingerprint(text):
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text)
        words = re.findall("[^\x20\x09-\x0d]+", lower)
        shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    rows = texts(odd)
    cache = {x: fingerprint(x) for x in {x for _, x in rows}}
    fp = np.array([cache[x] for _, x in rows], np.uint64)
    near = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 4
    root = np.arange(len(rows))
    while True:
        step = np.where(near, root[None, :], len(rows)).min(axis=1)
        if (step == root).all():
            break
        root = step
    least = {c: min((i for (i, _), r in zip(rows, root) if r == c and i is not None), default=None) for c in set(root.tolist())}
    want = [(i, f"{f:016x}", least[c]) for (i, _), f, c in zip(rows, fp.tolist(), root.tolist())]
    assert plain(QUERIES["op9_simhash_groups"](spark, odd[0]).collect()) == plain(want)


def test_pipeline_on_odd_rows(spark, odd):
    got = QUERIES["pipeline"](spark, odd[0])
    assert got.columns[:2] == ["doc_id", "piece"] and got.groupBy("sequence_id").sum("length").where("`sum(length)` > 4096").isEmpty()


def test_empty_tables(spark, tmp_path):
    for table in TABLES:
        spark.read.parquet(f"{SMALL}/{table}.parquet").limit(0).coalesce(1).write.parquet(f"{tmp_path}/{table}.parquet")
    for f in OPERATORS:
        rows = f(spark, str(tmp_path)).count()
        assert rows == (1 if f.__name__ == "op1_chat_windows" else 0), f.__name__  # conversation -1 is always there
