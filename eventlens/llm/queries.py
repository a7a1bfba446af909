"""One query per operator over its whole table; each takes ``(spark, sf_dir)``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventlens.llm.centroids import cluster_vectors, digests, with_inertia
from eventlens.llm.common import scratch, stored
from eventlens.llm.decontaminate import decontaminate
from eventlens.llm.exact_dedup import exact_dedup
from eventlens.llm.language_id import fit_language_id, identify_languages
from eventlens.llm.merkle import folded, hashed, merkle_manifest, siblings, told
from eventlens.llm.mixing import mix_sources
from eventlens.llm.ngram_join import ngram_join
from eventlens.llm.repeats import remove_repeats
from eventlens.llm.secrets import fit_secret_filter, rule_labels, scan_secrets, secret_features
from eventlens.llm.simhash import simhash_join
from eventlens.llm.token_counts import count_tokens, unigram_pieces
from eventlens.llm.toxicity import fit_characters, fit_toxicity, score_toxicity
from eventlens.llm.warc import read_warc, warc_records, write_warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _remainder(n: int):
    return F.crc32(F.col("doc_id").cast("string")) % n


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(_remainder(4) == 2, F.lit(False))
    net = fit_language_id(docs.filter(~held_out))
    found = identify_languages(docs, net)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return decontaminate(docs, items).drop("text_key")


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = ngram_join(table(spark, sf_dir, "documents"))
    return joined.select("doc_id", "n_shingles", "component_id")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents")).drop("text_key")


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings are labelled by rules; the forest learns from documents that are not held out."""
    features = rule_labels(secret_features(table(spark, sf_dir, "documents")))
    features = stored(features, "findings")
    held_out = F.coalesce(_remainder(4) == 2, F.lit(False))
    learned = fit_secret_filter(features.filter(~held_out))
    return scan_secrets(features, learned).select(
        "doc_id", held_out.alias("held_out"), "place", F.sha2("value", 256).alias("value_sha256"),
        F.col("length").cast("long").alias("n_chars"), "dictionary_coverage", "label", "score",
        "is_secret",
    )


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = remove_repeats(table(spark, sf_dir, "documents"), keep_bytes=False)
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers  # the vocabulary files; no other query needs them

    pieces = unigram_pieces(public_tokenizers.path("piece_bpe_32k.model"))
    return count_tokens(table(spark, sf_dir, "documents"), pieces).drop("text_key")


def op8_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "warc")
    write_warc(warc_records(table(spark, sf_dir, "pages")), path)
    records = read_warc(spark, path, payloads=False).filter("kind = 'record'")
    header = records["headers"].getItem
    digest = F.when(
        F.col("warc_type") == "revisit", F.substring_index(header("WARC-Payload-Digest"), ":", -1)
    ).otherwise(F.col("payload_sha1"))
    return records.select(
        header("X-Page-ID").try_cast("long").alias("page_id"),
        F.when(F.col("warc_type") == "revisit", header("X-Payload-Length").try_cast("long"))
        .otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        digest.alias("payload_digest"),
        F.col("warc_type").alias("record_type"),
        F.regexp_extract(header("WARC-Refers-To"), "^<urn:page:(-?[0-9]+)>$", 1).try_cast("long")
        .alias("refers_to"),
    )


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.coalesce(_remainder(3) == 1, F.lit(False))
    model = fit_toxicity(docs, labels.filter(~held_out), fit_characters(docs))
    scored = score_toxicity(docs, model)
    return scored.select(
        "doc_id", held_out.alias("held_out"), "score",
        F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"),
    )


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).drop("text_key")


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    assigned, centroids = cluster_vectors(table(spark, sf_dir, "embeddings"))
    return with_inertia(assigned).select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia",
        digests(centroids).alias("centroid_sha256"),
    )


def op12_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = simhash_join(table(spark, sf_dir, "documents"))
    return joined.select("doc_id", "fingerprint", "component_id")


def merkle_digests(docs: DataFrame) -> DataFrame:
    """Digests of the manifest, and what becomes of its proofs where line ends were cut."""
    columns = ("doc_id", "source", "lang", "n_chars", "text")
    cut = {"text": F.replace(docs["text"], F.lit("\n"), F.lit(""))}
    tampered = F.when(_remainder(2) == 0, hashed(*(told(cut.get(c, docs[c])) for c in columns)))
    rows = merkle_manifest(docs, columns, carry={"tampered": tampered})
    again = folded(F.coalesce("carried.tampered", "leaf"), F.col("path"))
    return rows.withColumn("folded_root", again).select(
        F.col("id").alias("doc_id"), "leaf", "subroot", "root",
        F.sha2(siblings(F.col("path")), 256).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_digests(table(spark, sf_dir, "documents"))


def llm_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_language_id": op1_language_id,
        "op2_decontamination": op2_decontamination,
        "op3_ngram_jaccard_join": op3_ngram_jaccard_join,
        "op4_exact_dedup": op4_exact_dedup,
        "op5_secret_scan": op5_secret_scan,
        "op6_suffix_array_dedup": op6_suffix_array_dedup,
        "op7_token_counts": op7_token_counts,
        "op8_warc_salvage": op8_warc_salvage,
        "op9_toxicity": op9_toxicity,
        "op10_source_mixing": op10_source_mixing,
        "op11_centroid_clustering": op11_centroid_clustering,
        "op12_simhash_near_dedup": op12_simhash_near_dedup,
        "op13_merkle_manifest": op13_merkle_manifest,
    }
