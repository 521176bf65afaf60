"""The corpus pipeline: from raw documents to packed training sequences.

Each stage is one operator of :mod:`strata.llm`; it takes the documents that the stage
before it kept and returns documents, the last one the pieces of its sequences.

In every stage ids may be null or repeated, as rows are told apart by their place in the
input; columns beyond those of documents are kept by all stages but the last, whatever
their names; an empty table gives an empty one.  Most stages read their input twice, in
the same order, as files and checkpoints give it; another order is found out by the
rows' digests, or by the counts of their n-grams, and is an error.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strata.llm import exact_dedup, ngram_join, packing, quality_rules, repeat_index
from strata.llm.common import ready


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules or their host's verdict reject go.

    A null or empty text has no words and goes; a null source is a host of its own;
    repeated rows are judged one by one; texts are read whole; a host whose rate equals
    the bar passes.
    """
    ready(spark)
    return quality_rules.keep_good(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays.

    Null and empty texts are equal; a null id is smaller than any other; of repeated rows
    with the largest id exactly one stays; texts of any length are compared whole.
    """
    ready(spark)
    return exact_dedup.keep_first(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a Jaccard similarity of 0.8 or more stays.

    The first row of a group stays; a null text, or one without words, is in no group and
    stays; repeated rows are one group; a similarity of exactly 0.8 links.
    """
    ready(spark)
    return ngram_join.keep_one(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of 200-byte strings that start twice or more are cut out of the texts.

    All copies go, the first too; ``n_chars`` is set to what is left.  A null text becomes
    empty; texts below 200 bytes stay; a text that is all repeats becomes empty and stays; a
    character of which a cut takes some bytes goes as a whole.
    """
    ready(spark)
    from pyspark.sql import functions as F

    left = repeat_index.keep_unrepeated(docs)
    return left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else left


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces placed in sequences of 4096: one row a piece, other columns are not read.

    A null or empty text is the end token alone; repeated rows are packed one by one; only
    longer documents are cut.
    """
    ready(spark)
    return packing.pack_documents(docs)


STAGES = [("quality rules", quality), ("exact dedup", exact), ("near duplicates", near), ("suffix-array dedup", repeats), ("best-fit packing", packed)]

#: SQL can express neither the packing nor the token ids
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; each stage but the last is cut off by checkpoint()."""
    ready(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stage(spark, docs, sf_dir).checkpoint()
    return STAGES[-1][1](spark, docs, sf_dir)
