"""From raw documents to packed training windows.

Stages: toxic documents go; lines that documents share stay only in one;
of near duplicates one document stays; sources are brought to target weights;
what is left is packed into token windows. Each stage takes (spark, docs,
sf_dir), works on all rows its predecessor kept, and returns the columns of
``docs``, but for the last, which returns the segments of the windows.

Defined cases beyond those of the operators: a document that line dedup leaves
without any text, though it had some, is a repetition of others and goes; one
that was null or blank before stays. ``n_chars`` follows the text.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkspool.llm import linededup, mixing, packing, simhash, toxicity
from inkspool.llm.common import fresh, named, read, shared_folder

#: Share of its own and of the other's text from which a document with lines of one other counts as a copy of it as a whole.
NEAR_COPY = 0.3


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model, trained on labelled documents, doesn't find toxic."""
    return toxicity.drop_toxic(docs, toxicity.train(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that others own, from the second document on.

    Near copies of one other document keep all lines: whether they go is
    judged on the whole document by the next stage, which would not see what
    they are if their common lines were gone.
    """
    lost = fresh(docs, "lines_lost")
    out = linededup.dedup_lines(docs, lost_col=lost, spare=NEAR_COPY)
    out = out.where((named(lost) == 0) | named(lost).isNull() | F.col("text").rlike(r"[^ \t\r\n]"))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(named(lost) > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return out.select(*map(named, docs.columns))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates."""
    return simhash.near_dedup(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents within their source's share of the whole budget."""
    return mixing.mix_filter(docs, budget=1.0)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(window_id, slot, doc_id, start_token, n_tokens)."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("line_dedup", line_dedup_stage),
    ("simhash_near_dedup", near_dedup_stage),
    ("source_mixing", mixing_stage),
    ("packing", packing_stage),
]

#: SimHash search, the trained model and best-fit packing have no SQL form; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the table of documents; what a stage returns is written as Parquet beside the checkpoints and read again.

    What a stage returned is deleted once the next one is written; the last
    result stays, as it is what the caller reads.
    """
    docs = read(spark, sf_dir, "documents")
    root = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    for name, stage in STAGES:
        path = f"{root}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            gone = spark._jvm.org.apache.hadoop.fs.Path(before)
            gone.getFileSystem(spark._jsc.hadoopConfiguration()).delete(gone, True)
        before = path
    return docs
