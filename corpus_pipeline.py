"""A corpus pipeline of five stages; each takes what its predecessor kept, as written and read again.

toxicity (rejects go), exact duplicates (the smallest doc_id of equal texts stays), near duplicates (one document of
each group stays), the mix of sources at target weights (documents repeat or go by their source's target), packing.

Nulls and edge cases, for every stage: a null text counts as empty; rows with a null or repeated doc_id are judged each
by its own text; extra columns of any name stay as they are; an empty table gives an empty table. Of rows equal in
doc_id and text the two deduplicating stages keep one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.llm.common import NULL_ID, durable, id_key, table
from tabloom.llm.exact_dedup import exact_dedup, normal_sha
from tabloom.llm.minhash import near_owners, text_mark
from tabloom.llm.mixing import mix
from tabloom.llm.packing import pack
from tabloom.llm.toxicity import clean_rows

#: Percent of shared five-word shingles from which documents are near copies.
NEAR_PERCENT = 80


def _chosen(docs: DataFrame, mark: Column, chosen: DataFrame) -> DataFrame:
    """The rows of docs whose (doc_id, mark) is in chosen (doc_id with null as NULL_ID, mark, n).

    Where n > 1, rows repeat both, and one of them stays: the smallest by its columns in order.
    """
    chosen = durable(chosen)
    names = [f"c{i}" for i in range(len(docs.columns))]
    keyed = docs.withColumns({"_id": F.coalesce(docs["doc_id"].cast("long"), F.lit(NULL_ID)), "_mark": mark}).toDF(*names, "_id", "_mark")
    key = lambda condition: chosen.where(condition).select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark"))
    out = keyed.join(key("n = 1"), ["_id", "_mark"], "left_semi").select(*names)
    if not chosen.where("n > 1").isEmpty():
        repeats = keyed.join(key("n > 1"), ["_id", "_mark"], "left_semi")
        out = out.unionByName(repeats.groupBy("_id", "_mark").agg(F.min(F.struct(*names)).alias("s")).select("s.*"))
    return out.toDF(*docs.columns)


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows whose text is not predicted to be toxic; without both labels among the rows nothing is, or all is."""
    return clean_rows(docs, table(spark, sf_dir, "labels"))


def exact_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows with equal text (white space aside) the one with the smallest doc_id, null last; all empty texts are equal."""
    rows = exact_dedup(docs).groupBy(id_key().alias("doc_id"), F.col("text_sha256").alias("mark"))
    owners = rows.agg(F.count(F.lit(1)).alias("n"), F.max("kept").alias("kept")).where("kept").drop("kept")
    return _chosen(docs, normal_sha(docs["text"]), owners)


def near_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the row with the smallest doc_id, null last; texts without words all stay."""
    return _chosen(docs, text_mark(docs["text"]), near_owners(docs, NEAR_PERCENT))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as their source's target asks, none more than three times; texts without words go or stay alike."""
    return mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences as of pack(); an empty text is its end id alone."""
    return pack(docs)


STAGES = [("toxicity", toxic_out), ("exact_dedup", exact_out), ("near_dedup", near_out), ("mixing", mixed), ("packing", packed)]

#: SQL expresses neither the trained classifier nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over documents; every one is written to the checkpoint folder and read again."""
    from tabloom.llm.common import shared_folder

    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    last = None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if last:  # what has been read again is not kept
            path = spark._jvm.org.apache.hadoop.fs.Path(last)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        last = f"{folder}/{name}"
    return docs
