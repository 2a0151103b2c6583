"""The corpus pipeline: documents in, packed sequences out.

STAGES are functions (spark, docs, sf_dir) -> DataFrame. Each is written as Parquet and read again as the next one's
docs; all but the last return the columns of documents. run() applies them to the table documents.

Every stage reads only the columns of documents, so that others may have any names, takes whole texts of any length, keeps
null ids, and gives an empty table for an empty one. What else it does with odd rows is said there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from htmlframe.llm import linededup, packing, quality, simhash, toxicity
from htmlframe.llm.common import kept, release, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts. It learns from the labelled rows of the table documents.

    Null and empty texts have the score of no features, 0.5 being accepted; repeated rows share their fate."""
    model = quality.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return docs.where(quality.scorer(spark, model)(F.col("text")) >= 0.5).select(*COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier doesn't reject. Null and empty texts have the score of no evidence and stay;
    repeated rows share their fate."""
    model = toxicity.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return docs.where(toxicity.scorer(spark, model)(F.col("text")) < toxicity.THRESHOLD).select(*COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that match earlier ones; a document that loses all its lines goes, too.

    Null and empty texts have no lines and stay; rows with the same id and text lose the same lines, so all of them stay."""
    left = linededup.dedup_lines(docs.select(*COLUMNS))
    return left.where("n_removed = 0 or trim(text) <> ''").withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group that SimHash links: null, empty and blank texts are one group,
    and of repeated rows one stays."""
    return simhash.drop_near_duplicates(docs.select(*COLUMNS)).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents left in sequences of at most 4096 tokens; null texts are empty, repeated rows are packed as often as
    they occur."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json")).withColumnRenamed("id", "doc_id")


STAGES = [
    ("quality classifier", keep_quality),
    ("toxicity", drop_toxic),
    ("line dedup", drop_lines),
    ("SimHash near-dedup", drop_near_duplicates),
    ("best-fit packing", pack),
]

#: SQL can't express the classifiers; the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage keeps is written below the folder that all executors share, until the next one
    has read it."""
    docs, last = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        docs = kept(stage(spark, docs, sf_dir), "pipeline")
        if last is not None:
            release(last)
        last = docs
    return docs
