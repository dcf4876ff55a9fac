"""The corpus pipeline: from raw documents to packed training sequences.

Every stage takes all documents that the one before it kept; all but the last
return the columns of ``documents``, whatever else they are called.

Cases, for every stage: an empty table gives an empty result; a null text counts
as empty; ids may be null or shared, texts that share one are documents of their
own; repeated rows are one document from the second stage on; texts of any length
are read whole; ties go to the smallest id, then the smallest text name; further
columns stay, whatever their names, until packing, which returns pieces.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import drop, give_back, materialize, release, tables_of
from lodestone.llm.neardup import keep_first
from lodestone.llm.packing import pack_documents
from lodestone.llm.pii import mask_pii
from lodestone.llm.quality import quality_filter
from lodestone.llm.suffixes import remove_repeats


def _counted(docs: DataFrame) -> DataFrame:
    """Documents whose text changed, with ``n_chars`` of the new one."""
    return docs.withColumn("n_chars", F.length("text").cast("long"))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects; null and empty texts are rejected, repeated rows judged alike."""
    return quality_filter(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class, the one with the smallest id; null ids come first, of repeated rows one stays."""
    # the stage before leaves the executors with all of their heap taken
    give_back(spark)
    return keep_first(docs)


def repeated_string_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the 100-byte strings that start earlier too, by id, then place; those with nothing left go, null texts too."""
    done = remove_repeats(docs, binary=False)
    kept = F.col(f"`{done.columns[-1]}`.kept")
    return _counted(done.withColumn("text", kept).where("text != ''").select(*[F.col(f"`{c}`") for c in docs.columns]))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind; null and empty texts stay as they are."""
    return _counted(mask_pii(docs))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in training sequences; a null or empty text is one piece, its end token."""
    return pack_documents(docs)


STAGES = [
    ("quality rules", quality_stage),
    ("near-duplicates", near_duplicate_stage),
    ("repeated strings", repeated_string_stage),
    ("personal data", pii_stage),
    ("packing", packing_stage),
]

#: Weighted similarities, byte strings and tokens are beyond SQL; tests/llm/test_pipeline.py compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    *filters, (_, last) = STAGES
    for at, (_, stage) in enumerate(filters):
        # what a stage wrote for itself goes when its result is written, and so does the result before
        group = f"stage{at}-{uuid.uuid4().hex}"
        with tables_of(group):
            made = stage(spark, docs, sf_dir)
        read, docs = docs, materialize(made, f"stage{at}")
        release(spark, group)
        if at:
            drop(read)
    return last(spark, docs, sf_dir)
