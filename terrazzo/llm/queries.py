"""The registered queries of this subpackage: thin calls of its operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fingerprint, langid, mixing, oracles, packing, preference, quality_knn, quality_rules, simhash, toxicity, url_filter
from .shared import held_out, table

#: The rules that op8 judges by.
URL_RULES = (
    url_filter.Rule("block", "net", "/"),
    url_filter.Rule("allow", "example.net", "/en/"),
    url_filter.Rule("block", "example.com", "/de/"),
    url_filter.Rule("allow", "org", "/fr/"),
)
#: op8's list stands for one that others have collected: the canonical URLs of every ``LISTED_FOLDS``-th page on hosts with
#: one of these labels. A host says nothing by itself: other URLs of the same hosts are not listed.
LISTED_HOST_LABELS = ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")
LISTED_FOLDS = 2


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = quality_knn.scored(docs, quality_knn.fitted(docs, table(spark, sf_dir, "labels")))
    score = F.col("quality_score")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score.alias("score"), (score >= quality_knn.THRESHOLD).cast("int").alias("predicted"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "continues", "sequence_length", "padded_length")


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.identified(docs.select("doc_id", "text"), langid.fitted(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.col("lang_entropy").alias("entropy"), F.col("lang_rejected").alias("rejected"))


def op4_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    chosen = turns.withColumnRenamed("conv_id", "pair_id")
    rejected = preference.stale_replies(turns).withColumnRenamed("conv_id", "pair_id")
    pairs = preference.preference_pairs(chosen, rejected)
    return pairs.withColumns({name: preference.spans_text(F.col(name)) for name in ("chosen_mask", "rejected_mask")}).withColumnRenamed("pair_id", "conv_id")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = toxicity.scored(docs, toxicity.fitted(docs, table(spark, sf_dir, "labels")))
    score = F.col("toxicity")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score.alias("score"), (score >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.as_hex(F.col("fp")).alias("fingerprint"), "component_id")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents")).withColumn("failed_rules", F.array_join("failed_rules", ","))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    labels = F.split(url_filter.host_of(F.col("url")), r"\.")
    listed = url_filter.listed_urls(pages.where(F.arrays_overlap(labels, F.array(*map(F.lit, LISTED_HOST_LABELS))) & (F.col("page_id") % LISTED_FOLDS == 0)))
    return url_filter.url_verdicts(pages, listed, URL_RULES)


def op9_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = fingerprint.sketched(table(spark, sf_dir, "documents").select("doc_id", text.alias("text")))
    pairs = fingerprint.with_next(docs, ["text", "sketch"]).withColumn("n_chars", F.length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - half), F.substring("next_text", F.lit(1), half))
    pairs = fingerprint.sketched(pairs.withColumn("edited", edited), "edited", "edited_sketch")
    return pairs.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint.encode(F.col("sketch")).alias("fingerprint"), fingerprint.encode(F.col("edited_sketch")).alias("edited_fingerprint"),
        fingerprint.resemblance(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        fingerprint.resemblance(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
        fingerprint.distinct_shingles(F.col("sketch")).alias("n_shingles"),
        fingerprint.containment(F.col("edited_sketch"), F.col("sketch")).alias("edited_contained"),
    )


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_knn": op1_quality_knn,
    "op2_packing": op2_packing,
    "op3_langid": op3_langid,
    "op4_preference": op4_preference,
    "op5_toxicity": op5_toxicity,
    "op6_simhash": op6_simhash,
    "op7_quality_rules": op7_quality_rules,
    "op8_url_filter": op8_url_filter,
    "op9_fingerprint": op9_fingerprint,
    "op10_mixing": op10_mixing,
}

ORACLES: dict[str, str] = {
    "op4_preference": oracles.preference_pairs(),
    "op7_quality_rules": oracles.quality(),
    "op8_url_filter": oracles.url_filter(URL_RULES, LISTED_HOST_LABELS, LISTED_FOLDS),
    "op10_mixing": oracles.mixing_copies(),
}
