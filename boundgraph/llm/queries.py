"""The registered queries of this subpackage: production parameters, whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, embed_dedup, mixing, packing, pii, quality, simhash, suffix_dedup, token_files, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def good_labels(labels: DataFrame) -> DataFrame:
    """Rows of ``labels`` as ``(id, good)``: of quality, and not toxic."""
    toxic = F.coalesce(F.col("toxic"), F.lit(0)) != 0
    return labels.select(F.col("doc_id").cast("long").alias("id"), F.when(F.col("quality").isNotNull(), ((F.col("quality") == 1) & ~toxic).cast("double")).alias("good"))


def op1_co_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, both views' probabilities, the combined score and keep, of every document."""
    docs = _table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, good_labels(_table(spark, sf_dir, "labels")))).withColumnRenamed("id", "doc_id")


def labelled_sources(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The source of every document that ``labels`` covers, as ``(id, domain)``."""
    known = labels.select(F.col("doc_id").cast("long").alias("id")).distinct()
    return docs.select(F.col("doc_id").cast("long").alias("id"), F.col("source").cast("string").alias("domain")).join(known, "id", "left_semi")


def op2_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates and copies of every document that bring the sources' tokens to the square root of their shares."""
    docs = _table(spark, sf_dir, "documents")
    mixed = mixing.mix(docs, labelled_sources(docs, _table(spark, sf_dir, "labels")), weights=0.5)
    return mixed.select("doc_id", "source", "n_tokens", "rate", "copies")


def op3_separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, without separator, counted in the flat files that hold them all."""
    return token_files.count(_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op4_simhash_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint, component_id of every document: 3-word shingles, links at 3 bits."""
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"), shingle=3, words=1, max_bits=3)
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens of every document and their places in as few sequences."""
    return packing.pack_documents(_table(spark, sf_dir, "documents"), capacity=2048).withColumnRenamed("id", "doc_id")


def op6_pivot_permutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings at a cosine of 0.98 within a label."""
    found = embed_dedup.near_duplicates(_table(spark, sf_dir, "embeddings"), cosine=0.98)
    return found.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), F.col("id").eqNullSafe(F.col("component")).alias("kept"))


def op7_one_bit_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 largest inner products of every twentieth vector, against all others."""
    table = _table(spark, sf_dir, "embeddings")
    return ann.search(table, table.where("vec_id % 20 = 0"), k=20).withColumnRenamed("id", "vec_id")


def op8_seekable_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record per page, written to bundles and read back by the index from their frames."""
    index, _ = warc.archive_pages(_table(spark, sf_dir, "pages"), least=1000)
    number = lambda c: F.regexp_extract(c, r"^urn:page:(-?\d+)$", 1).try_cast("long")
    return warc.fetch(index, payloads=False).select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))


def op9_pii_tagger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document; the counts are those of the base spans."""
    docs = _table(spark, sf_dir, "documents")
    found = pii.find(docs, pii.train(docs))
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(F.col("id").alias("doc_id"), *map(count, pii.KINDS), F.sha2(joined("base").cast("binary"), 256).alias("base_sha256"), joined("spans").alias("spans"))


def op10_longest_previous_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of every document without the strings of 100 bytes that start earlier too."""
    found = suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents"), length=100)
    return found.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op1_co_training": op1_co_training, "op2_soft_mixing": op2_soft_mixing, "op3_separator_scan": op3_separator_scan, "op4_simhash_pivots": op4_simhash_pivots, "op5_best_fit_packing": op5_best_fit_packing, "op6_pivot_permutations": op6_pivot_permutations, "op7_one_bit_codes": op7_one_bit_codes, "op8_seekable_warc": op8_seekable_warc, "op9_pii_tagger": op9_pii_tagger, "op10_longest_previous_factors": op10_longest_previous_factors}
ORACLE_SQL: dict[str, str] = {
    "op8_seekable_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
        d AS (SELECT page_id, strlen(body)::BIGINT AS payload_bytes, sha1(body) AS payload_digest FROM p),
        m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS kept FROM d)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 1000 AND page_id <> kept THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 1000 AND page_id <> kept THEN kept END AS refers_to
        FROM m""",
}
