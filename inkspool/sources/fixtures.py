"""Virtual words, panels and pages made from the driver's tables, so that spatial operators have input.

Layout: the tokens of a conversation's turn become words in blocks of six lines
of four words; see ``VIRTUAL_SQL`` for the same in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table, spread over the cores where its files make fewer tasks than there are (never so for large tables)."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def virtual_words(conversations: DataFrame) -> DataFrame:
    """(chapter_id, panel_id, word_idx, text, left, top, right, bottom, confidence)."""
    tokens = F.filter(F.split("text", r"\s+"), lambda t: t != "")
    w = conversations.select(F.col("conv_id").alias("chapter_id"), F.col("turn").cast("int").alias("panel_id"), F.posexplode(tokens).alias("word_idx", "text"))
    w = w.withColumns({"blk": F.expr("word_idx div 24"), "ln": F.expr("(word_idx % 24) div 4"), "width": 10 * F.least(F.length("text"), F.lit(14)) + 6, "height": 24 + 2 * (F.col("word_idx") % 3)})
    odd = ((F.col("chapter_id") + F.col("panel_id")) % 6 == 0) & (F.expr("(word_idx div 4) % 2") == 1)
    w = w.withColumn("step", F.col("width") + F.when(odd, 30).otherwise(8))
    line = W.partitionBy("chapter_id", "panel_id", "blk", "ln").orderBy("word_idx").rowsBetween(W.unboundedPreceding, -1)
    shift = F.when(((F.col("chapter_id") + F.col("panel_id")) % 5 == 2) & (F.col("ln") % 2 == 1), 420).otherwise(0)
    w = w.withColumn("left", (40 + (F.col("blk") % 2) * 1300 + shift + F.coalesce(F.sum("step").over(line), F.lit(0))).cast("int"))
    w = w.withColumn("top", (((F.col("chapter_id") * 7 + F.col("panel_id") * 3) % 5) * 20 + F.expr("blk div 2") * 324 + F.col("ln") * 34).cast("int"))
    return w.select("chapter_id", "panel_id", "word_idx", "text", "left", "top", (F.col("left") + F.col("width")).cast("int").alias("right"), (F.col("top") + F.col("height")).cast("int").alias("bottom"), F.lit(1.0).alias("confidence"))


def virtual_panels(conversations: DataFrame, words: DataFrame) -> DataFrame:
    """(chapter_id, panel_id, width, height) of every turn, also of those without a word."""
    size = words.groupBy("chapter_id", "panel_id").agg(F.max("right").alias("r"), F.max("bottom").alias("b"))
    all_ = conversations.select(F.col("conv_id").alias("chapter_id"), F.col("turn").cast("int").alias("panel_id"))
    joined = all_.join(size, ["chapter_id", "panel_id"], "left")
    return joined.select("chapter_id", "panel_id", (F.coalesce("r", F.lit(0)) + 40).cast("int").alias("width"), (F.coalesce("b", F.lit(0)) + ((F.col("chapter_id") + F.col("panel_id")) % 3) * 40).cast("int").alias("height"))


VIRTUAL_SQL = """
vt AS (SELECT conv_id AS chapter_id, CAST(turn AS INTEGER) AS panel_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda t: t <> '') AS ts FROM conversations),
v0 AS (SELECT chapter_id, panel_id, unnest(ts) AS text, unnest(range(len(ts))) AS wi FROM vt),
v1 AS (SELECT chapter_id, panel_id, CAST(wi AS INTEGER) AS word_idx, text, wi // 24 AS blk, (wi % 24) // 4 AS ln, 10 * least(length(text), 14) + 6 AS w, 24 + 2 * (wi % 3) AS h,
         CASE WHEN (chapter_id + panel_id) % 6 = 0 AND (wi // 4) % 2 = 1 THEN 30 ELSE 8 END AS sp FROM v0),
v2 AS (SELECT *, 40 + (blk % 2) * 1300 + CASE WHEN (chapter_id + panel_id) % 5 = 2 AND ln % 2 = 1 THEN 420 ELSE 0 END
         + coalesce(sum(w + sp) OVER (PARTITION BY chapter_id, panel_id, blk, ln ORDER BY word_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS l,
         ((chapter_id * 7 + panel_id * 3) % 5) * 20 + (blk // 2) * 324 + ln * 34 AS t FROM v1),
words AS (SELECT chapter_id, panel_id, word_idx, text, CAST(l AS INTEGER) AS "left", CAST(t AS INTEGER) AS top, CAST(l + w AS INTEGER) AS "right", CAST(t + h AS INTEGER) AS bottom FROM v2),
panels AS (SELECT c.conv_id AS chapter_id, CAST(c.turn AS INTEGER) AS panel_id, CAST(coalesce(max(w."right"), 0) + 40 AS INTEGER) AS width,
         CAST(coalesce(max(w.bottom), 0) + ((c.conv_id + c.turn) % 3) * 40 AS INTEGER) AS height
         FROM conversations c LEFT JOIN words w ON w.chapter_id = c.conv_id AND w.panel_id = c.turn GROUP BY c.conv_id, c.turn)"""
