"""The registered queries of the training-data operators, and the SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_attention_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import classify

    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_prefix_tree_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import BEGIN, END, mark_test_rows, prefix_trees, read_back

    rows = mark_test_rows(table(spark, sf_dir, "conversations"), -1, f"{END}{BEGIN}assistant ok")
    return read_back(prefix_trees(rows, tokenizer_path()), tokenizer_path())


def op3_wrapper_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .wrappers import extract_text

    return extract_text(table(spark, sf_dir, "pages"))


def op4_hnsw_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neighbours import nearest

    return nearest(table(spark, sf_dir, "embeddings"))


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix_sources

    return mix_sources(table(spark, sf_dir, "documents")).taken()


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op7_quartile_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fingerprints import edit_sensitivity

    return edit_sensitivity(table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tokencounts import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), tokenizer_path())


def op9_interleaved_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import interleave_shards

    return interleave_shards(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_shingle_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .shingles import near_duplicate_components

    return near_duplicate_components(table(spark, sf_dir, "documents"))


def op11_byte_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bytemodel import held_out_by_crc, language_scores

    return language_scores(table(spark, sf_dir, "documents"), held_out_by_crc())


def op12_son_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .phrases import collocations

    return collocations(table(spark, sf_dir, "documents"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .crosstokens import align_tokens

    return align_tokens(table(spark, sf_dir, "documents"), tokenizer_path(), tokenizer_path("piece_bpe_32k.model"))


QUERIES = {f.__name__: f for f in (
    op1_attention_quality, op2_prefix_tree_chat, op3_wrapper_text, op4_hnsw_neighbours, op5_source_mix,
    op6_best_fit_packing, op7_quartile_digests, op8_token_counts, op9_interleaved_shards, op10_shingle_components,
    op11_byte_contexts, op12_son_collocations, op13_token_alignment)}


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    """SQL where there is any: hashes, models and tokenizers have none, and component search in SQL is too slow."""
    from .mixing import oracle_sql as mix_sql
    from .phrases import oracle_sql as phrase_sql

    return {"op5_source_mix": mix_sql(), "op12_son_collocations": phrase_sql()}
