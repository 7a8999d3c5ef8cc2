"""Registered queries of the subpackage; each reads whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lectern.llm import oracles
from lectern.llm.tables import table
from lectern.plans.scratch import Scratch

BYTE_BPE = "byte_bpe_50k.json"


def tokenizer_path(name: str = BYTE_BPE) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm.quality import assess

    return assess(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm.langid import fit, predict

    docs = table(spark, sf_dir, "documents")
    return predict(docs, fit(docs))


def op3_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm.encoding import round_trip_digests

    return round_trip_digests(table(spark, sf_dir, "documents"), tokenizer_path())


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm.html_text import fit, main_texts

    pages = table(spark, sf_dir, "pages")
    return main_texts(pages, fit(pages))


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm.pii import report

    return report(table(spark, sf_dir, "documents")).drop("max_score")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm.toxicity import fit, score

    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm.embedding_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"), Scratch(spark, "op7"))


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm.jaccard import similar_components

    found = similar_components(table(spark, sf_dir, "documents"), Scratch(spark, "op8"))
    return found.select("doc_id", "n_shingles", "component_id")


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path(), Scratch(spark, "op9"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm.counting import token_counts

    return token_counts(table(spark, sf_dir, "documents"), tokenizer_path())


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm.lexical_search import rank_documents

    return rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), Scratch(spark, "op11"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm.spelling import spelling_variants

    return spelling_variants(table(spark, sf_dir, "documents"), Scratch(spark, "op12"))


def op13_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm.exact_search import exact_top_k

    vectors = table(spark, sf_dir, "embeddings")
    return exact_top_k(vectors, vectors.where("vec_id % 50 = 0"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_rules": op1_quality_rules,
        "op2_language_id": op2_language_id,
        "op3_bpe_roundtrip": op3_bpe_roundtrip,
        "op4_html_extraction": op4_html_extraction,
        "op5_personal_data": op5_personal_data,
        "op6_toxicity": op6_toxicity,
        "op7_embedding_dedup": op7_embedding_dedup,
        "op8_ngram_jaccard": op8_ngram_jaccard,
        "op9_best_fit_packing": op9_best_fit_packing,
        "op10_token_counts": op10_token_counts,
        "op11_lexical_search": op11_lexical_search,
        "op12_spelling_variants": op12_spelling_variants,
        "op13_exact_topk": op13_exact_topk,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_quality_rules": oracles.OP1,
        "op5_personal_data": oracles.OP5,
        "op7_embedding_dedup": oracles.OP7,
        "op11_lexical_search": oracles.OP11,
        "op12_spelling_variants": oracles.OP12,
        "op13_exact_topk": oracles.OP13,
    }
