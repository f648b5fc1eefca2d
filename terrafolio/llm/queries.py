"""The queries of the training-data operators, each over whole tables."""

from __future__ import annotations

import hashlib
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrafolio.llm import ann, audit, chat, decontam, langid, mixing, ngram_join, pii, quality, substring, toxicity, trie, warc
from terrafolio.llm.common import Scratch, bucket, column_of, map_texts, table
from terrafolio.llm.oracles import ORACLES


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; the model sees only documents whose crc32 remainder modulo 4 isn't 2."""
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(bucket("doc_id", 4) != 2))
    found = langid.identify(docs, model)
    return found.select("doc_id", (bucket("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document; the model sees only labels whose crc32 remainder modulo 3 isn't 1."""
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").where(bucket("doc_id", 3) != 1).select("doc_id", F.col("quality").alias("label"))
    found = quality.score(docs, quality.fit(docs, labels))
    return found.select("doc_id", (bucket("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in every document."""
    found = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), "contaminated")


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of 4-word shingles have a Jaccard similarity of 0.85 or more."""
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"), ngram_join.JoinParams(size=4, percent=85))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates of all documents that give each language the same share of tokens, little of it of low quality."""
    docs = table(spark, sf_dir, "documents")
    model = mixing.fit(docs, mixing.language_quality(docs, table(spark, sf_dir, "labels")))
    mixed = mixing.mix(docs.select("doc_id", "text"), replace(model, params=replace(model.params, weights=mixing.balanced(model.domains))))
    return mixed.select("doc_id", "n_tokens", "domain", "target", "reached", "rate", "copies")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the windows of 35 words that occur more than once."""
    found = substring.repeated_words(table(spark, sf_dir, "documents"), substring.SubstringParams(window=35))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    docs = table(spark, sf_dir, "documents")
    found = pii.find(docs, pii.fit(docs))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    number = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    counts = [number(kind) for kind in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(joined("base").cast("binary"), 256).alias("base_sha256"), joined("spans").alias("spans"))


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, and one that quotes control strings, formatted and read back."""
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    quoted = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", quoted), (-7, 1, "assistant", quoted)], "conv_id long, turn long, role string, text string")
    formatted = chat.format_conversations(turns.unionByName(extra))

    def read_back(batch):
        rows = [(chat.parse(f), chat.learned_text(f, s)) for f, s in zip(column_of(batch, "formatted").to_pylist(), column_of(batch, "loss_spans").to_pylist())]
        return {
            "conv_id": column_of(batch, "conv_id"),
            "n_turns": [len(turns) for turns, _ in rows],
            "turns_sha256": [hashlib.sha256("".join(f"{role}\n{text}\n" for role, text in turns).encode()).hexdigest() for turns, _ in rows],
            "loss_chars": [len(learned) for _, learned in rows],
            "loss_sha256": [hashlib.sha256(learned.encode()).hexdigest() for _, learned in rows],
            "formatted_chars": [len(f) for f in column_of(batch, "formatted").to_pylist()],
        }

    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return map_texts(formatted, schema, read_back, text="formatted")


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest vectors of each vector whose vec_id is divisible by 50, against all others."""
    vectors = ann.usable(table(spark, sf_dir, "embeddings"))
    return ann.search(vectors, vectors.where("vec_id % 50 = 0"), ann.fit(vectors))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document by the chain low quality -> toxic."""
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")
    found = toxicity.predict(docs, toxicity.fit(docs, labels, ("low_quality", "toxic")))
    return found.select("doc_id", "p_low_quality", "p_toxic", F.col("is_toxic").alias("toxic"))


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as WARC records and read back, equal payloads stored once."""
    path = Scratch(spark).root
    warc.archive(table(spark, sf_dir, "pages"), path)
    return warc.archived_pages(spark, path)


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of five filters removes in every order of them, by language."""
    return audit.interactions(audit.document_cells(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")), "ABCDE")


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the prefix trie of all conversations, rebuilt so that families share their first turns."""
    return trie.prefix_trie(table(spark, sf_dir, "conversations"), trie.RebuildParams())


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_quality": op2_quality,
    "op3_decontamination": op3_decontamination,
    "op4_ngram_jaccard": op4_ngram_jaccard,
    "op5_mixing": op5_mixing,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_pii": op7_pii,
    "op8_chat_format": op8_chat_format,
    "op9_nearest_neighbours": op9_nearest_neighbours,
    "op10_toxicity": op10_toxicity,
    "op11_warc": op11_warc,
    "op12_filter_audit": op12_filter_audit,
    "op13_prefix_trie": op13_prefix_trie,
}


__all__ = ["ORACLES", "QUERIES"]
