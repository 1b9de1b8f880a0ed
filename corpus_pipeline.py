"""A training corpus from the table documents, in five stages; part of the subpackage llm.

Every stage works on all rows that the one before kept, and what it decides takes
effect: documents that the quality classifier rejects go, one document of every group
of near duplicates stays, personal data is masked, sources are resampled to their
target weights, and what is left is tokenised and packed.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boundgraph.llm import mixing, packing, pii, quality, simhash
from boundgraph.llm.queries import good_labels, labelled_sources
from boundgraph.llm.shared import materialise

#: Near duplicates: five-word shingles of a Jaccard similarity of 0.8; candidates differ in 64 of 256 bits at most and agree in one of 96 tables.
#: At exactly 0.8 two equally long texts differ in 0.1515 of the bits (0.99 of such pairs are candidates), and more alike ones in fewer.
SHINGLE, SIMILARITY, WORDS, MAX_BITS, TABLES, TABLE_BITS, APART = 5, 0.8, 4, 64, 96, 16, 0.1515
#: Each source's share of tokens is brought to this power of what it has.
TEMPERATURE = 0.7
CAPACITY = 2048


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose co-trained score is at least a half.

    Null and empty texts and null metadata are scored like others; repeated rows go or stay alike;
    labels without a document, and null ones, count for nothing; an empty table stays empty; extra columns stay.
    """
    return quality.kept(docs, quality.train(docs, good_labels(_table(spark, sf_dir, "labels"))))


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links connect, the one with the smallest doc_id.

    Documents without doc_id stay; of rows that repeat a doc_id all stay if it is the smallest.
    """
    tables = partial(simhash.drawn_tables, WORDS, TABLES, TABLE_BITS, APART)
    found = simhash.near_duplicates(docs, shingle=SHINGLE, words=WORDS, max_bits=MAX_BITS, tables=tables, similarity=SIMILARITY)
    copies = found.where("id <> component").select(F.col("id").alias("doc_id")).distinct()
    return docs.join(copies, "doc_id", "left_anti").select(*docs.columns)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data masked, and their new lengths.

    Every row stays; a null text stays null and has the length 0; an empty table stays empty; extra columns stay as they are.
    """
    clean = pii.redact(docs, pii.train(docs))
    kind = dict(docs.dtypes)["n_chars"]
    return clean.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(kind)).select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many copies of each document as its rate comes to, which may be none.

    A null or empty text has no tokens and a rate like others; rows that share an id are rounded alike;
    without labels every row stays once; an empty table stays empty; extra columns stay, whatever their names.
    """
    return mixing.resample(docs, labelled_sources(docs, _table(spark, sf_dir, "labels")), weights=TEMPERATURE)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of every document and their places in sequences.

    A null or empty text is one piece of one token; repeated rows are each packed; a null id is kept; an
    empty table gives no piece; extra columns are left out.
    """
    return packing.pack_documents(docs, capacity=CAPACITY).withColumnRenamed("id", "doc_id")


STAGES = [
    ("quality classifier", quality_stage),
    ("SimHash near-dedup", near_duplicates_stage),
    ("PII", pii_stage),
    ("mixing sources", mixing_stage),
    ("best-fit packing", packing_stage),
]

#: SQL cannot express the classifier, the tagger or the packing; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents, each written as Parquet and read again."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-").lower())
    return STAGES[-1][1](spark, docs, sf_dir)
