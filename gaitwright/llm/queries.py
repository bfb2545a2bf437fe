"""The queries of the training-data operators, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import adaptjoin, decontam, fim, htmltemplate, importance, mixing, ogg, omh, quality, rans, sharding, suffixindex, toxicity
from .common import table


def op1_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return omh.classify(table(spark, sf_dir, "documents"))


def op2_additive_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_ogg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    media = ogg.add_media(docs, F.col("text")).select("doc_id", "media")
    return ogg.add_media_features(media).drop("media")


def op4_rans_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return rans.token_index(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op5_systematic_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def op6_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_suffix_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixindex.strip_repeats(table(spark, sf_dir, "documents"))


def op8_suffix_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.audit_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_template_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltemplate.extract_pages(table(spark, sf_dir, "pages"))


def op10_hash_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op11_adaptive_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adaptjoin.similar_sets(table(spark, sf_dir, "documents"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = fim.restore(fim.transform(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return cut.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_order_minhash": op1_order_minhash,
    "op2_additive_quality": op2_additive_quality,
    "op3_ogg_media": op3_ogg_media,
    "op4_rans_tokens": op4_rans_tokens,
    "op5_systematic_mix": op5_systematic_mix,
    "op6_toxicity_chain": op6_toxicity_chain,
    "op7_suffix_levels": op7_suffix_levels,
    "op8_suffix_decontamination": op8_suffix_decontamination,
    "op9_template_extraction": op9_template_extraction,
    "op10_hash_ring": op10_hash_ring,
    "op11_adaptive_prefixes": op11_adaptive_prefixes,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_importance_resampling": op13_importance_resampling,
}
ORACLES = {
    "op5_systematic_mix": mixing.MIX_SQL,
    "op8_suffix_decontamination": decontam.AUDIT_SQL,
    "op11_adaptive_prefixes": adaptjoin.SIMILAR_SQL,
    "op12_fill_in_middle": fim.FIM_SQL,
    "op13_importance_resampling": importance.RESAMPLE_SQL,
}
