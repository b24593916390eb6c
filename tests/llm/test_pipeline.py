"""The pipeline's stages against brute-force versions, each on its own input."""

import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from wicker.llm import quality, secret_spans, simhash, toxicity
from wicker.llm.queries import vocabulary

FOLDER = "/root/testdata/sf0.01"  # of the smallest tables 87 rows are labelled, too few for a fit that must hold
BASE = re.compile(r"AKIA[A-Z0-9]{12}|[0-9a-f]{32}")


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = {r.doc_id: r for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
        stage(spark, docs, FOLDER).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = before, docs
        if name != "packing":
            assert docs.columns == corpus_pipeline.DOCUMENTS
    for name, label, gone in (("quality", "quality", 0), ("toxicity", "toxic", 1)):
        before, after = seen[name]
        kept = {r.doc_id for r in after.select("doc_id").collect()}
        marked = [d for d in before if d in labels]
        assert np.mean([(d in kept) == (labels[d][label] != gone) for d in marked]) > 0.9
    before, after = seen["near_duplicates"]
    ids = sorted(before)
    fp = np.array([simhash.fingerprint(before[d]) for d in ids], np.uint64)
    near = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 4
    root = np.arange(len(ids))
    for _ in range(len(ids)):
        step = np.where(near, root[None, :], len(ids)).min(axis=1)
        if (step == root).all():
            break
        root = step
    assert {r.doc_id for r in after.select("doc_id").collect()} == {ids[i] for i in np.unique(root)}
    before, after = seen["secrets"]
    texts = {r.doc_id: r for r in after.collect()}
    assert set(texts) == set(before) and not any(BASE.search(r.text) for r in texts.values())
    assert all(r.n_chars == len(r.text) for d, r in texts.items() if r.text != before[d])
    before, after = seen["packing"]
    p = after.toPandas()
    assert set(p["doc_id"]) == set(before) and p.groupby("sequence_id")["length"].sum().max() <= 4096
    assert corpus_pipeline.run(spark, FOLDER).count() == len(p)


KEY = "AKIA" + "Q7" * 8
ODD = [None, "", " \t\r\n", "one", "one two three", "ONE  two\x0bthree", "É▁İ <|endoftext|> \x00 ſecret=abcdefgh1", "x" * 70_000, "a b c d " * 20_000, f"password = 'hunter22' {KEY} and so on", "0" * 32, "0" * 31 + " " + "0" * 32 + KEY]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Documents with nulls in every column, empty and long texts, ties, repeated rows and columns whose names clash."""
    rows = [(i, x, None, "odd", None) for i, x in enumerate(ODD, 900_000)] + [(None, "no id", "en", None, 5), (900_003, "tie", "en", "s", 3), (900_003, "tie", "en", "s", 3), (900_003, "other", None, None, None)]
    real = spark.read.parquet(f"{FOLDER}/documents.parquet")
    some = spark.createDataFrame(rows, real.schema)
    path = str(tmp_path_factory.mktemp("stages")) + "/documents.parquet"
    clash = {"score": F.lit("s"), "base": F.lit(1), "spans": F.lit("t"), "x": F.lit(2.0), "fp": F.lit(3), "label": F.lit(4), "component": F.lit(5), "ids": F.lit("i"), "rows": F.monotonically_increasing_id()}
    real.unionByName(some).withColumns(clash).write.parquet(path)
    return spark.read.parquet(path)


def plain(df):
    return sorted((tuple(r[c] for c in corpus_pipeline.DOCUMENTS) for r in df.collect()), key=repr)


@pytest.mark.parametrize("name, module, cut", [("quality", quality, 0.5), ("toxicity", toxicity, 0.7)])
def test_stage_keeps_what_its_score_says(spark, odd, name, module, cut):
    model = module.train(odd, spark.read.parquet(f"{FOLDER}/labels.parquet"))
    scores = module.score_documents(odd, model, "rows").collect()
    good = {r.rows for r in scores if (r.score >= cut) == (name == "quality")}
    got = dict(corpus_pipeline.STAGES)[name](spark, odd, FOLDER)
    assert got.columns == corpus_pipeline.DOCUMENTS and 0 < len(good) < len(scores)
    assert plain(got) == plain(odd.where(F.col("rows").isin(list(good))))


def test_stage_of_near_duplicates_keeps_one_of_each_group(spark, odd):
    got = dict(corpus_pipeline.STAGES)["near_duplicates"](spark, odd, "")
    rows = odd.collect()
    fp = np.array([simhash.fingerprint(r.text) for r in rows], np.uint64)
    near = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 4
    root = np.arange(len(rows))
    while True:
        step = np.where(near, root[None, :], len(rows)).min(axis=1)
        if (step == root).all():
            break
        root = step
    ids = {}
    for r, c in zip(rows, root.tolist()):
        ids.setdefault(c, []).append(r.doc_id)
    want = [min((i for i in some if i is not None), default=None) for some in ids.values()]
    assert got.columns == corpus_pipeline.DOCUMENTS and sorted((r.doc_id for r in got.collect()), key=repr) == sorted(want, key=repr)


def test_stage_of_secrets_changes_only_what_is_secret(spark, odd):
    got = dict(corpus_pipeline.STAGES)["secrets"](spark, odd, "")
    model = secret_spans.fit_markov(secret_spans.labelled_strings(spark, odd))
    spans = {(r.rows): r for r in secret_spans.scan(odd, model).collect()}
    assert got.columns == corpus_pipeline.DOCUMENTS and got.count() == odd.count()
    clean = [r for r in odd.collect() if not spans[r.rows].spans]
    assert set(map(repr, plain(odd.where(F.col("rows").isin([r.rows for r in clean]))))) <= set(map(repr, plain(got)))
    texts = {r.doc_id: r.text for r in got.where("doc_id >= 900000").collect()}
    assert texts[900_009] == "<secret>' <secret> and so on" and texts[900_010] == "<secret>" and texts[900_000] is None and not any(BASE.search(r.text or "") for r in got.collect())


def test_stage_of_packing_places_every_token(spark, odd):
    import tokenizers

    words = tokenizers.Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    want = []
    for r in odd.collect():
        ids = [*words.encode(r.text or "", add_special_tokens=False).ids, 1]
        want += [(r.doc_id, at // 4096, at, len(ids[at : at + 4096]), zlib.crc32(np.array(ids[at : at + 4096], "<u4").tobytes())) for at in range(0, len(ids), 4096)]
    got = dict(corpus_pipeline.STAGES)["packing"](spark, odd, "").collect()
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=repr) == sorted(want, key=repr)
    placed = {}
    for r in got:
        placed.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for some in placed.values():
        ends = np.cumsum([n for _, n in sorted(some)])
        assert [o for o, _ in sorted(some)] == [0, *ends[:-1]] and ends[-1] <= 4096
