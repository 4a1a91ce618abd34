"""Registered queries of the subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from glossmark.llm import alignment, byte_bpe, importance, line_quality, lm_score, mixing, ngram_join, oracles, pii, quality_rules, substring_dedup, url_filter, vector_search, word_bpe
from glossmark.llm.common import documents


def op1_mix_sources(spark, sf_dir):
    rows = mixing.mix(documents(spark, sf_dir).select("doc_id", "text", "source"))
    return rows.select("doc_id", "size", "source_size", "target", "taken")


def op2_quality_classifier(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return quality_rules.classify(documents(spark, sf_dir).select("doc_id", "text"), labels)


def op3_pii(spark, sf_dir):
    return pii.digest_columns(pii.find_spans(documents(spark, sf_dir).select("doc_id", "text")))


def op4_url_filter(spark, sf_dir):
    return url_filter.judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"))


def tokenizer_definition(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    with open(public_tokenizers.path(name), encoding="utf-8") as file:
        return file.read()


def op6_bpe_words(spark, sf_dir):
    return word_bpe.encode(documents(spark, sf_dir).select("doc_id", "text"), tokenizer_definition())


def op5_lm_scores(spark, sf_dir):
    return lm_score.score_texts(documents(spark, sf_dir).select("doc_id", "text"))


def op7_quality_rules(spark, sf_dir):
    return line_quality.judge_texts(documents(spark, sf_dir).select("doc_id", "text", "source"))


def op8_exact_top_k(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return vector_search.top_k(vectors, F.col("vec_id") % 50 == 0, k=5)


def op9_ngram_jaccard_join(spark, sf_dir):
    return ngram_join.similarity_groups(documents(spark, sf_dir).select("doc_id", "text"), width=4, percent=85)


def op10_substring_dedup(spark, sf_dir):
    kept = substring_dedup.remove_repeats(documents(spark, sf_dir).select("doc_id", "text"), width=35, block=18)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op11_importance_resampling(spark, sf_dir):
    rows = importance.weighed(documents(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("text"))
    return importance.ranked(rows).select("doc_id", "n_features", "weight", "score", "rank")


def op12_byte_bpe(spark, sf_dir):
    import public_tokenizers

    ranks = tokenizer_definition("byte_bpe_50k.tiktoken")
    return byte_bpe.encode(documents(spark, sf_dir).select("doc_id", "text"), ranks, public_tokenizers.PATTERN)


def op13_token_alignment(spark, sf_dir):
    import public_tokenizers

    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as file:
        model = file.read()
    bytes_level = tokenizer_definition("byte_bpe_50k.json")
    return alignment.align(documents(spark, sf_dir).select("doc_id", "text"), bytes_level, public_tokenizers.PATTERN, model)


QUERIES = {f.__name__: f for f in (
    op1_mix_sources, op2_quality_classifier, op3_pii, op4_url_filter, op5_lm_scores, op6_bpe_words, op7_quality_rules, op8_exact_top_k, op9_ngram_jaccard_join, op10_substring_dedup,
    op11_importance_resampling, op12_byte_bpe, op13_token_alignment)}
ORACLES = {
    "op1_mix_sources": oracles.OP1, "op7_quality_rules": oracles.OP7, "op8_exact_top_k": oracles.OP8,
    "op9_ngram_jaccard_join": oracles.OP9, "op10_substring_dedup": oracles.OP10,
    "op11_importance_resampling": oracles.OP11}
