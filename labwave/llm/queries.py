"""Registered queries ``opN_<name>``: each applies its operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import embedding_dedup, html_text, lexical, line_dedup, mixing, packing, quality, rules, secrets, simhash, spelling, topk, toxicity
from .common import held_out, may_train, read


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words the mix takes of every document."""
    mixed = mixing.placed(read(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return mixed.select("doc_id", "size", "source_size", "target",
                        (F.col("copies") * F.col("size")).alias("taken"), "copies", "source", "weight")


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document; labels of a third of the ids are never learned."""
    docs, labels = read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "labels")
    weights = quality.fit_quality(docs, labels, may_train(F.col("doc_id")))
    scored = quality.score_quality(docs, weights)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document, with the sentences that offend."""
    docs, labels = read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "labels")
    weights = toxicity.fit_toxicity(docs, labels, may_train(F.col("doc_id")))
    judged = toxicity.score_toxicity(docs, weights)
    return judged.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("toxicity.score").alias("score"),
                         (F.col("toxicity.score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
                         F.col("toxicity.sentences").alias("sentences"))


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    groups = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 tokens."""
    return packing.pack(read(spark, sf_dir, "documents"))


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    texts = html_text.main_text(read(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return texts.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that many sites share."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return line_dedup.dedup_lines(docs, removed_col="n_removed").select("doc_id", "text", "n_removed")


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document: counts by kind, digest of the base spans, all spans."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    scanned = secrets.scan(docs, secrets.train(docs))
    counts = [F.size(f"s{k}").cast("long").alias(f"n_{kind[0]}") for k, kind in enumerate(secrets.KINDS)]
    return scanned.select("doc_id", *counts, F.sha2(secrets.written(F.col("base")), 256).alias("base_sha256"),
                          secrets.written(F.concat("base", "more")).alias("spans"))


def op2_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best other vectors of every vector whose id is divisible by 20."""
    return topk.search(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors with a cosine of at least 0.93 within a label."""
    return embedding_dedup.near_vectors(read(spark, sf_dir, "embeddings"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 best documents of every benchmark item."""
    return lexical.search(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark").select("item_id", "text"))


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures of every document, and whether it stays by its rules and its host's."""
    judged = rules.judge(read(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Form, root and neighbours of every frequent word of the documents."""
    return spelling.variants(read(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {
    "op1_mix_sources": op1_mix_sources,
    "op2_topk_search": op2_topk_search,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_toxicity": op4_toxicity,
    "op5_simhash_near_dedup": op5_simhash_near_dedup,
    "op6_pack_sequences": op6_pack_sequences,
    "op7_html_text": op7_html_text,
    "op8_line_dedup": op8_line_dedup,
    "op9_embedding_near_dedup": op9_embedding_near_dedup,
    "op10_secret_scan": op10_secret_scan,
    "op11_lexical_search": op11_lexical_search,
    "op12_quality_rules": op12_quality_rules,
    "op13_spelling_variants": op13_spelling_variants,
}
