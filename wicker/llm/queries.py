"""The registered queries: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from wicker.llm import chat, forest, leaks, media, merkle, packing, pieces, quality, secret_spans, simhash, site_tree, toxicity, trie
from wicker.llm.common import held_out, read_table
from wicker.llm.oracles import ORACLE  # noqa: F401  (the entry point takes both from here)


def vocabulary(name: str) -> str:
    """Where the installed public vocabularies are."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_chat_windows(spark, sf_dir):
    """All conversations and conversation -1, formatted in windows and read back from them; one row for each conv_id, null among them."""
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    probe = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").cast("int").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    back = chat.read_back(chat.format_conversations(turns.unionByName(probe)))
    whole = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return back.select("conv_id", "n_turns", F.sha2(whole, 256).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"), "formatted_chars")


def op2_media_clips(spark, sf_dir):
    """All documents as films; one row for each, and what its film's clips are as text."""
    got = media.document_clips(read_table(spark, sf_dir, "documents"))
    return got.withColumn("feature", F.expr("array_join(transform(clips, c -> concat_ws(':', c.first, c.last, cast(round(c.level, 3) as string))), ',')")).drop("clips")


def op3_main_text(spark, sf_dir):
    """The main text of all pages; one row for each."""
    return site_tree.extract(read_table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op4_secret_spans(spark, sf_dir):
    """Secrets of all documents; one row for each, without spans the digest is that of the empty string."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    got = secret_spans.scan(docs, secret_spans.fit_markov(secret_spans.labelled_strings(spark, docs)))
    of = [F.expr(f"cast(size(filter(base, v -> v.k = {k})) as long)").alias(f"n_{secret_spans.KINDS[k]}") for k in range(3)]
    return got.select("doc_id", *of, F.sha2(secret_spans.written("base"), 256).alias("base_sha256"), secret_spans.written("spans").alias("spans"))


def op5_piece_encoding(spark, sf_dir):
    """All documents encoded and decoded; one row for each."""
    got = pieces.encode_documents(read_table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"), digests=True)
    return got.select("doc_id", "n_tokens", F.col("ids").alias("ids_sha256"), F.col("decoded").alias("decoded_sha256"))


def op6_best_fit_packing(spark, sf_dir):
    """The place of each piece of all documents; an empty document is one piece of one token."""
    return packing.pack_documents(read_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op7_quality_scores(spark, sf_dir):
    """The quality of all documents; held_out is null where doc_id is."""
    docs = read_table(spark, sf_dir, "documents")
    got = quality.score_documents(docs, quality.train(docs, read_table(spark, sf_dir, "labels")), "doc_id")
    return got.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_embedding_groups(spark, sf_dir):
    """The groups of all vectors; one row for each."""
    return forest.near_duplicates(read_table(spark, sf_dir, "embeddings"))


def op9_simhash_groups(spark, sf_dir):
    """The near-duplicate groups of all documents; one row for each."""
    got = simhash.near_duplicates(read_table(spark, sf_dir, "documents"))
    return got.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op10_toxicity_scores(spark, sf_dir):
    """The toxicity of all documents; held_out is null where doc_id is."""
    docs = read_table(spark, sf_dir, "documents")
    got = toxicity.score_documents(docs, toxicity.train(docs, read_table(spark, sf_dir, "labels")), "doc_id")
    return got.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op11_merkle_manifest(spark, sf_dir):
    """The proofs of all documents, folded from tampered texts where 5 divides the crc32 of the doc_id; one row for each."""
    got = merkle.manifest(read_table(spark, sf_dir, "documents"), merkle.tampered(), digests=True)
    return got.withColumnRenamed("proof", "proof_sha256")


def op12_prefix_trie(spark, sf_dir):
    """The prefixes of all rebuilt conversations; one row for each."""
    return trie.prefix_trie(read_table(spark, sf_dir, "conversations"))


def op13_benchmark_leaks(spark, sf_dir):
    """What of all documents stands in benchmark items; one row for each."""
    got = leaks.contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["first"])
    return got.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


def media_payloads(spark, sf_dir):
    """What op2_media_clips reads back of each payload, without what its film's format decides: SQL can tell these columns."""
    return op2_media_clips(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32")


def secret_base_spans(spark, sf_dir):
    """The fixed kinds of op4_secret_spans, without the models' spans: SQL can tell these columns."""
    return op4_secret_spans(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256")


def quality_held_out(spark, sf_dir):
    """Which rows op7_quality_scores learns nothing from: SQL can tell this column."""
    return op7_quality_scores(spark, sf_dir).select("doc_id", "held_out")


def pipeline(spark, sf_dir):
    """All stages of corpus_pipeline over all documents."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


OPERATORS = (op1_chat_windows, op2_media_clips, op3_main_text, op4_secret_spans, op5_piece_encoding, op6_best_fit_packing, op7_quality_scores, op8_embedding_groups, op9_simhash_groups, op10_toxicity_scores, op11_merkle_manifest, op12_prefix_trie, op13_benchmark_leaks, pipeline)
QUERIES = {f.__name__: f for f in (*OPERATORS, media_payloads, secret_base_spans, quality_held_out)}
