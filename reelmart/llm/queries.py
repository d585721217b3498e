"""One registered query per operator, over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reelmart.llm import (
    decontamination,
    html_text,
    language_id,
    mixing,
    near_duplicates,
    neighbours,
    packing,
    secret_scan,
    spelling,
    substring_dedup,
    token_counts,
    warc,
    whitening,
)
from reelmart.scratch import scratch_folder

Query = Callable[[SparkSession, str], DataFrame]

MIX_WEIGHTS = (5, 2, 1)
MIX_SEED = 17


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def archived_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    archive = scratch_folder(spark)
    warc.write_warc(_table(spark, sf_dir, "pages"), archive)
    records = warc.read_warc(spark, archive, with_payload=False).where("gap_reason IS NULL")
    return records.select(
        F.expr("try_cast(record_id AS bigint)").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        F.expr("try_cast(refers_to AS bigint)").alias("refers_to"),
    )


def nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return neighbours.nearest(vectors, vectors.where("vec_id % 50 = 0"), wanted=5)


def mixed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    weights = mixing.cyclic_weights(docs, MIX_WEIGHTS)
    mix = mixing.mix_sources(docs, weights, max_epochs=3.0, seed=MIX_SEED)
    return mix.select("doc_id", "size", "source_size", "target", "taken")


def counted_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, sf_dir, "documents"))


def contaminated_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contamination(
        _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")
    )
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        decontamination.contaminated().alias("contaminated"),
    )


def repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.repeats(_table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        "n_bytes",
        "n_removed",
        F.size("runs").cast("bigint").alias("n_spans"),
        "kept_sha256",
        # The bytes left, and whether any went.
        (F.col("n_bytes") - F.col("n_removed")).alias("n_kept"),
        (F.col("n_removed") > 0).alias("has_repeats"),
    )


def found_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan_secrets(_table(spark, sf_dir, "documents"))

    def count(kind: str) -> Column:
        return F.size(F.filter("findings", lambda f: f["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    base = F.filter("findings", lambda f: f["kind"] != "model")
    return found.select(
        "doc_id",
        count("assign"),
        count("access"),
        count("hex"),
        F.sha2(secret_scan.listed(base), 256).alias("base_sha256"),
        secret_scan.listed(F.col("findings")).alias("spans"),
    )


def predicted_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    is_held_out = F.coalesce(language_id.held_out(F.col("doc_id")), F.lit(False))
    found = language_id.predict_languages(docs, docs.where(~is_held_out))
    return found.select("doc_id", is_held_out.alias("held_out"), "lang_pred", "score")


def extracted_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(_table(spark, sf_dir, "pages"))


def near_duplicate_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(_table(spark, sf_dir, "documents"))


def whitened_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened_components(_table(spark, sf_dir, "embeddings"))


def variants_of_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(_table(spark, sf_dir, "documents"))


def packed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def llm_queries() -> dict[str, Query]:
    return {
        "op1_warc": archived_pages,
        "op2_neighbours": nearest_vectors,
        "op3_mixing": mixed_documents,
        "op4_token_counts": counted_tokens,
        "op5_decontamination": contaminated_documents,
        "op6_substring_dedup": repeated_bytes,
        "op7_secret_scan": found_secrets,
        "op8_language_id": predicted_languages,
        "op9_html_text": extracted_pages,
        "op10_near_duplicates": near_duplicate_documents,
        "op11_whitening": whitened_vectors,
        "op12_spelling_variants": variants_of_words,
        "op13_best_fit_packing": packed_documents,
    }
