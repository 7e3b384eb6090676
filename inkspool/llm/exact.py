"""Exact dedup by 128-bit content hash with byte comparison (operator 9).

md5 of the text finds candidates in a narrow table of ids and hashes. Texts
move only for rows whose hash occurs more than once: a bitmap of those hashes
passes them through, and grouping them by hash and full text (with map-side
combining, so that thousands of copies shrink before the shuffle) compares the
bytes. Two texts with one hash are thus never merged.

Defined cases: null texts are never duplicates; empty texts are copies of each
other; rows that share id and text are one document; a null id takes part but
ranks after every other id; very long texts are hashed and compared whole; an
empty table gives an empty result; ids may have any type that can be ordered,
other columns any name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, maybe_member, named, read


def exact_groups(docs: DataFrame, id_col="doc_id", text_col="text", hash_fn=F.md5) -> DataFrame:
    """(doc_id, group_id, keep, content_hash): group_id is the smallest id with the same bytes.

    Ids of null stay null, with keep = true where the text has no smaller id.
    """
    spark = docs.sparkSession
    base = docs.select(named(id_col).alias("id"), named(text_col).alias("t"))
    hashed = base.withColumn("ch", hash_fn(F.col("t").cast("binary")))
    narrow = cut(hashed.select("id", "ch"))
    counted = narrow.where("ch is not null").groupBy("ch").agg(F.count("*").alias("n"), F.min("id").alias("rep"))
    twice = cut(counted.where("n > 1").select("ch", F.xxhash64("ch").alias("hh")))
    probe = maybe_member(spark, twice, "hh")
    candidates = hashed.where("ch is not null").where(probe(F.xxhash64("ch")))
    texts = candidates.groupBy("ch", "t").agg(F.min("id").alias("rep"), F.count("*").alias("n"))
    per = texts.groupBy("ch").agg(F.count("*").alias("texts"), F.min("rep").alias("rep"), F.sum("n").alias("n")).where("n > 1")
    per = cut(per)
    plain = narrow.join(per.where("texts = 1").select("ch", "rep"), "ch", "left").select("id", "ch", F.coalesce("rep", "id").alias("rep"))
    clashing = per.where("texts > 1").select("ch")
    if not clashing.isEmpty():  # one hash, different bytes: these rows are grouped by their texts
        rows = hashed.join(clashing, "ch")
        reps = rows.groupBy("ch", "t").agg(F.min("id").alias("rep"))
        apart = rows.join(reps, ["ch", "t"]).select("id", "ch", F.coalesce("rep", "id").alias("rep"))
        plain = plain.join(clashing, "ch", "left_anti").unionByName(apart)
    return plain.select(F.col("id").alias("doc_id"), F.col("rep").alias("group_id"), F.col("id").eqNullSafe(F.col("rep")).alias("keep"), F.col("ch").alias("content_hash"))


def op9(spark, sf_dir):
    return exact_groups(read(spark, sf_dir, "documents"))


OP9_SQL = """
SELECT doc_id, CASE WHEN text IS NULL THEN doc_id ELSE min(doc_id) OVER (PARTITION BY text) END AS group_id,
       (text IS NULL OR doc_id = min(doc_id) OVER (PARTITION BY text)) AS keep, md5(text) AS content_hash
FROM documents
"""
