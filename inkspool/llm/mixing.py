"""Mixing sources to target weights by nested hash thresholds (operator 1).

Every document has a 60-bit hash of its id. A source's sample for a token
budget is all its documents whose hash is below a threshold, so samples for
growing budgets are nested and a document's fate needs only its own hash.
Thresholds come from histograms of tokens by source and hash bucket: the
bucket in which a budget ends is known from the coarse histogram, and only
its documents are counted again in finer buckets. Nothing is sorted by hash
beyond the few documents of the last bucket.

Defined cases: a null text has 0 tokens; a null source is a source of its own;
a null id is hashed as the text "null"; equal ids have equal hashes and stay or
go together; a source that has less than its share is kept whole, and what it
lacks is not given to others, so that no other source exceeds its share; very
long texts are counted whole; an empty table gives an empty result; ids and
sources may have any type that can be cast to text, other columns any name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, fresh, hash60, named, read, word_count

BITS, LEVEL_BITS, LEVELS = 60, 12, 2

#: Nested budgets as shares of all tokens, smallest first.
BUDGETS = (0.25, 0.5, 1.0)

#: Above this many sources the threshold table is joined without a broadcast hint.
MAX_BROADCAST_SOURCES = 200_000


def token_table(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source") -> DataFrame:
    """One narrow row a document: id, source, tokens, hash. The only pass over the texts."""
    return docs.select(
        named(id_col).alias("id"),
        named(source_col).alias("src"),
        word_count(named(text_col)).alias("tok"),
        hash60(F.coalesce(named(id_col).cast("string"), F.lit("null"))).alias("h"),
    )


def targets(tokens: DataFrame, budgets=BUDGETS, weights: dict | None = None) -> DataFrame:
    """Token budget of every source at every level: (src, lvl, goal).

    Without ``weights`` a source weighs the square root of its tokens
    (temperature 2), which lifts small sources and curbs the hot one. Goals are
    floor(share * total * weight / sum of weights) in double arithmetic.
    """
    per = tokens.groupBy("src").agg(F.sum("tok").alias("has"))
    if weights is None:
        weight = F.floor(F.sqrt(F.col("has").cast("double"))).cast("double")
    else:
        table = F.create_map(*[F.lit(x) for k, v in weights.items() for x in (k, float(v))])
        weight = F.coalesce(F.try_element_at(table, F.coalesce("src", F.lit(""))), F.lit(0.0))
    per = per.withColumn("w", weight)
    all_of = per.agg(F.sum("has").cast("double").alias("total"), F.sum("w").alias("all_w"))
    levels = F.explode(F.array(*[F.struct(F.lit(i + 1).alias("lvl"), F.lit(float(b)).alias("share")) for i, b in enumerate(budgets)]))
    return (
        per.crossJoin(all_of)
        .select("src", "w", "total", "all_w", levels.alias("b"))
        .select("src", F.col("b.lvl").alias("lvl"), F.when(F.col("all_w") > 0, F.floor(F.col("b.share") * F.col("total") * F.col("w") / F.col("all_w"))).otherwise(F.lit(0)).cast("long").alias("goal"))
    )


def thresholds(tokens: DataFrame, goals: DataFrame) -> DataFrame:
    """(src, lvl, below): the largest prefix of hash order whose tokens fit the goal is h < below."""
    hist = cut(tokens.groupBy("src", F.shiftright("h", BITS - LEVEL_BITS).alias("b")).agg(F.sum("tok").alias("t")))
    open_ = goals.withColumn("base", F.lit(0).cast("long")).withColumn("prefix", F.lit(0).cast("long"))
    done = None
    for level in range(1, LEVELS + 2):
        last = level > LEVELS
        shift = 0 if last else BITS - LEVEL_BITS * level
        if level > 1:  # refine: only documents of the buckets in which a budget ends
            up = BITS - LEVEL_BITS * (level - 1)
            edge = open_.select("src", "prefix").distinct()
            inside = tokens.join(F.broadcast(edge) if edges <= MAX_BROADCAST_SOURCES else edge, tokens["src"].eqNullSafe(edge["src"]) & (F.shiftright(tokens["h"], up) == edge["prefix"]), "left_semi")
            hist = inside.groupBy("src", F.shiftright("h", up).alias("prefix"), F.shiftright("h", shift).alias("b")).agg(F.sum("tok").alias("t"))
        else:
            hist = hist.withColumn("prefix", F.lit(0).cast("long"))
        run = hist.withColumn("upto", F.sum("t").over(W.partitionBy("src", "prefix").orderBy("b")))
        o = open_.alias("o")
        r = run.alias("r")
        over = (
            o.join(r, F.col("o.src").eqNullSafe(F.col("r.src")) & (F.col("o.prefix") == F.col("r.prefix")) & (F.col("o.base") + F.col("r.upto") > F.col("o.goal")), "left")
            .groupBy("o.src", "o.lvl", "o.goal", "o.base")
            .agg(F.min(F.struct(F.col("r.b").alias("b"), F.col("r.upto").alias("upto"), F.col("r.t").alias("t"))).alias("first"))
        )
        over = cut(over)
        whole = over.where("first.b is null").select("src", "lvl", F.lit(1 << BITS).cast("long").alias("below"))
        rest = over.where("first.b is not null")
        if last:
            whole = whole.unionByName(rest.select("src", "lvl", F.col("first.b").alias("below")))
        else:
            open_ = rest.select("src", "lvl", "goal", (F.col("base") + F.col("first.upto") - F.col("first.t")).alias("base"), F.col("first.b").alias("prefix"))
            edges = open_.count()
        done = whole if done is None else done.unionByName(whole)
    return done


def mix_levels(tokens: DataFrame, budgets=BUDGETS, weights: dict | None = None) -> DataFrame:
    """(src, below_1 .. below_n): thresholds as one row a source."""
    limit = thresholds(tokens, targets(tokens, budgets, weights))
    picks = [F.max(F.when(F.col("lvl") == i + 1, F.col("below"))).alias(f"below_{i + 1}") for i in range(len(budgets))]
    return cut(limit.groupBy("src").agg(*picks))


def _with_limits(tokens: DataFrame, limits: DataFrame, n: int) -> DataFrame:
    few = limits.count() <= MAX_BROADCAST_SOURCES
    limits = limits.withColumnRenamed("src", "limit_source")
    return tokens.join(F.broadcast(limits) if few else limits, F.col("src").eqNullSafe(F.col("limit_source")))


def mix(docs: DataFrame, budgets=BUDGETS, weights: dict | None = None, id_col="doc_id", text_col="text", source_col="source") -> DataFrame:
    """(doc_id, source, n_tokens, mix_level): documents in the mix, at the smallest budget that has them."""
    tokens = cut(token_table(docs, id_col, text_col, source_col))
    joined = _with_limits(tokens, mix_levels(tokens, budgets, weights), len(budgets))
    level = F.coalesce(*[F.when(F.col("h") < F.col(f"below_{i + 1}"), F.lit(i + 1)) for i in range(len(budgets))])
    return joined.select(F.col("id").alias("doc_id"), F.col("src").alias("source"), F.col("tok").alias("n_tokens"), level.alias("mix_level")).where("mix_level is not null")


def mix_filter(docs: DataFrame, budget: float = 1.0, weights: dict | None = None, id_col="doc_id", text_col="text", source_col="source") -> DataFrame:
    """Rows of ``docs``, unchanged, that belong to the mix of one budget."""
    tokens = cut(token_table(docs, id_col, text_col, source_col))
    limits = mix_levels(tokens, (budget,), weights)
    few = limits.count() <= MAX_BROADCAST_SOURCES
    src, below = fresh(docs, "limit_source"), fresh(docs, "limit_below")
    limits = limits.select(F.col("src").alias(src), F.col("below_1").alias(below))
    h = hash60(F.coalesce(named(id_col).cast("string"), F.lit("null")))
    return docs.join(F.broadcast(limits) if few else limits, named(source_col).eqNullSafe(named(src)) & (h < named(below)), "left_semi")


def op1(spark, sf_dir):
    return mix(read(spark, sf_dir, "documents"))


OP1_SQL = """
WITH t AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\r\\f]+')) AS n_tokens,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 15) AS BIGINT) AS h
  FROM documents),
s AS (SELECT source, sum(n_tokens) AS has, floor(sqrt(CAST(sum(n_tokens) AS DOUBLE))) AS w FROM t GROUP BY source),
a AS (SELECT CAST(sum(has) AS DOUBLE) AS total, sum(w) AS all_w FROM s),
b AS (SELECT * FROM (VALUES (1, 0.25::DOUBLE), (2, 0.5::DOUBLE), (3, 1.0::DOUBLE)) AS v(lvl, share)),
g AS (SELECT source, lvl, CASE WHEN all_w > 0 THEN CAST(floor(share * total * w / all_w) AS BIGINT) ELSE 0 END AS goal FROM s, a, b),
c AS (SELECT *, sum(n_tokens) OVER (PARTITION BY source ORDER BY h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM t)
SELECT c.doc_id, c.source, CAST(c.n_tokens AS BIGINT) AS n_tokens, CAST(min(g.lvl) AS INTEGER) AS mix_level
FROM c JOIN g ON c.source IS NOT DISTINCT FROM g.source AND c.upto <= g.goal
GROUP BY c.doc_id, c.source, c.n_tokens, c.h, c.upto
"""
