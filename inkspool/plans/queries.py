"""One query for each operator, over tables made from the driver's data, and its SQL where SQL can say it."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import language as lng
from ..functions import text as txt
from ..operators import audio, classify, continuation, grouping
from ..operators.lineage import checkpointed, shared_folder
from ..params import DEFAULTS, TEXT_WEIGHTS, Params, scaled_text_weights
from ..sources import images, ocr
from ..sources.fixtures import VIRTUAL_SQL, table, virtual_panels, virtual_words
from . import chapter, sql

def r6(value) -> F.Column:
    """Six digits, halves of the last one settled before float noise can: so in the SQL."""
    return F.round((F.col(value) if isinstance(value, str) else value) + 1e-9, 6)


QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, oracle: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn

    return add


# ---- texts: documents with endings that exercise each rule

DECOR = [
    " WAIT....NOW!!! ok??? end..of it",
    " He||o~W0rld [x] & 5% @ #1 $2 a+b=c",
    " word - word long--dash  -  05suchan ab12 c3d",
    " *** stars** | lone — dash ! , ;",
    " HELLLLLO GOOOD H0W h1s H1S 0o0",
    " don't STOP…now",
    "",
]


def decorated(spark, sf_dir, every: int = 1):
    d = table(spark, sf_dir, "documents")
    extra = F.element_at(F.array(*[F.lit(x) for x in DECOR]), (F.col("doc_id") % len(DECOR) + 1).cast("int"))
    head = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("안녕 7 "), F.col("text"))).otherwise(F.col("text"))
    return d.select("doc_id", "lang", F.concat(head, extra).alias("text"))


DECORATED_SQL = f"d AS (SELECT doc_id, lang, CASE WHEN doc_id % 3 = 0 THEN '안녕 7 ' || text ELSE text END || [{', '.join(sql.q(x) for x in DECOR)}][doc_id % {len(DECOR)} + 1] AS text FROM documents)"


def _text_query(name, fn, oracle):
    @query(name, f"WITH {DECORATED_SQL} SELECT doc_id, {oracle('text')} AS out_text FROM d")
    def run(spark, sf_dir):
        return decorated(spark, sf_dir).select("doc_id", fn(F.col("text")).alias("out_text"))


_text_query("txt1_normalize_text", txt.normalize, sql.normalize)
_text_query("txt2_clean_ocr_artifacts", txt.clean_artifacts, sql.clean_artifacts)
_text_query("txt3_fix_common_ocr_errors", txt.fix_ocr_errors, sql.fix_ocr_errors)
_text_query("txt4_remove_repeated_characters", txt.limit_repeats, sql.limit_repeats)
_text_query("txt5_fix_ocr_corruptions", txt.fix_corruptions, sql.fix_corruptions)
_text_query("txt7_preprocess_for_tts", txt.for_speech, lambda x: f"CASE WHEN {sql.strip(x)} = '' THEN '' ELSE {sql.normalize(x)} END")
_text_query("txt12_fold", txt.fold, sql.fold)

CLASSIFICATION_SQL = f"""{DECORATED_SQL},
p1 AS (SELECT doc_id, lang, text, {sql.fix_ocr_errors(sql.clean_artifacts('lower(text)'))} AS x FROM d),
p2 AS (SELECT doc_id, lang, text, {sql.normalize('x')} AS x FROM p1),
p3 AS (SELECT doc_id, lang, text, {sql.limit_repeats('x')} AS x FROM p2),
p4 AS (SELECT doc_id, lang, text, {sql.fix_corruptions('x')} AS x FROM p3)"""


@query("txt6_preprocess_for_classification", f"WITH {CLASSIFICATION_SQL} SELECT doc_id, x AS out_text FROM p4")
def txt6(spark, sf_dir):
    return decorated(spark, sf_dir).select("doc_id", txt.for_classification(F.col("text")).alias("out_text"))


@query("txt8_preprocess_batch", f"WITH {CLASSIFICATION_SQL} SELECT doc_id, x AS for_classifier, {sql.normalize('text')} AS for_tts FROM p4")
def txt8(spark, sf_dir):
    t = F.col("text")
    return decorated(spark, sf_dir).select("doc_id", txt.preprocess(t).alias("for_classifier"), txt.preprocess(t, False).alias("for_tts"))


@query("txt9_text_functions", f"WITH {CLASSIFICATION_SQL} SELECT doc_id, length({sql.normalize('text')}) AS n_normalized, length(x) AS n_classified FROM p4")
def txt9(spark, sf_dir):
    t = F.col("text")
    return decorated(spark, sf_dir).select("doc_id", F.length(txt.normalize(t)).cast("long").alias("n_normalized"), F.length(txt.for_classification(t)).cast("long").alias("n_classified"))


@query("txt10_router_text", f"WITH {DECORATED_SQL} SELECT doc_id, {sql.normalize('text')} AS out_text FROM d WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, '' FROM d WHERE doc_id % 2 = 1")
def txt10(spark, sf_dir):
    d = decorated(spark, sf_dir)
    return d.select("doc_id", txt.for_speech(F.when(F.col("doc_id") % 2 == 0, F.col("text")).otherwise(F.lit(" \t "))).alias("out_text"))


@query("txt11_nonempty_texts", f"WITH {DECORATED_SQL}, m AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN '' WHEN doc_id % 4 = 1 THEN '***' ELSE text END AS text FROM d) SELECT doc_id, {sql.normalize('text')} AS out_text FROM m WHERE {sql.normalize('text')} <> ''")
def txt11(spark, sf_dir):
    d = decorated(spark, sf_dir)
    made = F.when(F.col("doc_id") % 4 == 0, "").when(F.col("doc_id") % 4 == 1, "***").otherwise(F.col("text"))
    return d.select("doc_id", txt.for_speech(made).alias("out_text")).where("out_text <> ''")


@query("txt13_tokenize", f"WITH {DECORATED_SQL} SELECT doc_id, len({sql.tokens('text')}) AS n_tokens, array_to_string({sql.tokens('text')}, ' ') AS toks FROM d")
def txt13(spark, sf_dir):
    t = txt.tokens(F.col("text"))
    return decorated(spark, sf_dir).withColumn("t", t).select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.array_join("t", " ").alias("toks"))


def _feature_query(name, fn, oracle, with_tokens=False):
    source = f"{DECORATED_SQL}, t AS (SELECT *, {sql.tokens('text')} AS tok FROM d)"

    @query(name, f"WITH {source} SELECT doc_id, round({oracle('tok' if with_tokens else 'text')} + 1e-9::DOUBLE, 6) AS score FROM t")
    def run(spark, sf_dir):
        return decorated(spark, sf_dir).select("doc_id", r6(fn(F.col("text"))).alias("score"))


_feature_query("lng1_dictionary_ratio", lng.dictionary_ratio, sql.dictionary_ratio, True)
_feature_query("lng2_alphabet_ratio", lng.alphabet_ratio, sql.alphabet_ratio)
_feature_query("lng3_word_frequency", lng.word_frequency, sql.word_frequency, True)
_feature_query("lng4_trigram_score", lng.trigram_score, sql.trigram_score)
_feature_query("lng5_ocr_noise", lng.ocr_noise, sql.ocr_noise)

JOIN5_SQL = f"WITH {DECORATED_SQL}, t AS (SELECT doc_id, unnest({sql.tokens('text')}) AS w FROM d) SELECT w AS word, count(*) AS n, coalesce({sql.table(sql.lexicon.WORD_SCORES)}[w], 0.5::DOUBLE) AS freq FROM t WHERE {sql.in_list('w', sql.lexicon.DICTIONARY)} GROUP BY w"


@query("join5_lexicon_lookup", JOIN5_SQL)
def join5(spark, sf_dir):
    lex = spark.createDataFrame([(w, sql.lexicon.WORD_SCORES.get(w, sql.lexicon.UNKNOWN_WORD)) for w in sorted(sql.lexicon.DICTIONARY)], "word string, freq double")
    t = decorated(spark, sf_dir).select(F.explode(txt.tokens(F.col("text"))).alias("word"))
    return t.groupBy("word").agg(F.count("*").alias("n")).join(lex, "word").select("word", "n", "freq")


RAW_SQL = f"""{DECORATED_SQL}, t AS (SELECT *, {sql.tokens('text')} AS tok FROM d),
f AS (SELECT doc_id, lang, 0.5::DOUBLE AS bbox_area, 3.0::DOUBLE AS aspect_ratio, 0.001::DOUBLE AS text_density, CAST(len(tok) AS DOUBLE) AS word_count, CAST({sql.punctuation_count('text')} AS DOUBLE) AS punctuation_count,
  {sql.dictionary_ratio('tok')} AS dictionary_ratio, {sql.alphabet_ratio('text')} AS alphabet_ratio, {sql.word_frequency('tok')} AS word_frequency_score, {sql.trigram_score('text')} AS trigram_language_score, {sql.ocr_noise('text')} AS ocr_noise_score FROM t)"""
NORM_SQL = """n AS (SELECT doc_id, lang,
  CASE WHEN bbox_area BETWEEN 0.01 AND 0.05 THEN 1.0 WHEN bbox_area BETWEEN 0.005 AND 0.10 THEN 0.7 WHEN bbox_area < 0.005 THEN 0.3 ELSE 0.2 END AS bbox_area,
  CASE WHEN aspect_ratio BETWEEN 2 AND 5 THEN 1.0 WHEN aspect_ratio BETWEEN 1 AND 7 THEN 0.7 ELSE 0.3 END AS aspect_ratio,
  CASE WHEN text_density BETWEEN 0.0005 AND 0.002 THEN 1.0 WHEN text_density BETWEEN 0.0002 AND 0.005 THEN 0.7 WHEN text_density > 0.01 THEN 0.2 ELSE 0.5 END AS text_density,
  CASE WHEN word_count = 0 THEN 0.0 WHEN word_count = 1 THEN 0.4 WHEN word_count = 2 THEN 0.6 ELSE least(1.0, 0.7::DOUBLE + (word_count - 3) * 0.1::DOUBLE) END AS word_count,
  CASE WHEN punctuation_count >= 1 THEN 1.0 ELSE 0.3 END AS punctuation_count,
  CASE WHEN dictionary_ratio >= 0.8::DOUBLE THEN 1.0 WHEN dictionary_ratio >= 0.5 THEN 0.7 WHEN dictionary_ratio >= 0.3::DOUBLE THEN 0.4 ELSE dictionary_ratio * 0.3::DOUBLE END AS dictionary_ratio,
  CASE WHEN alphabet_ratio >= 0.7::DOUBLE THEN 1.0 WHEN alphabet_ratio >= 0.5 THEN 0.8 WHEN alphabet_ratio >= 0.3::DOUBLE THEN 0.5 ELSE alphabet_ratio END AS alphabet_ratio,
  CASE WHEN word_frequency_score / 5.0::DOUBLE >= 0.6::DOUBLE THEN 1.0 WHEN word_frequency_score / 5.0::DOUBLE >= 0.4::DOUBLE THEN 0.8 ELSE word_frequency_score / 5.0::DOUBLE END AS word_frequency_score,
  trigram_language_score / 5.0::DOUBLE AS trigram_language_score, 1.0::DOUBLE - ocr_noise_score AS ocr_noise_score FROM f)"""
TEXT_SCORE_SQL = " + ".join(f"{w}::DOUBLE * CAST({k} AS DOUBLE)" for k, w in TEXT_WEIGHTS.items())


@query("lng6_language_features", f"WITH {RAW_SQL} SELECT doc_id, {', '.join(f'round({k} + 1e-9::DOUBLE, 6) AS {k}' for k in TEXT_WEIGHTS)} FROM f")
def lng6(spark, sf_dir):
    d = decorated(spark, sf_dir).withColumn("f", lng.extract(F.col("text")))
    return d.select("doc_id", *[r6(F.col("f")[k]).alias(k) for k in TEXT_WEIGHTS])


SHORT = ["No!", "OH NO", "stop", "Search", "well...", "WAIT", "Please?", "garden gate", "yes sir now", "..."]


@query(
    "lng7_short_dialogue",
    f"WITH s AS (SELECT doc_id, [{', '.join(sql.q(x) for x in SHORT)}][doc_id % {len(SHORT)} + 1] AS text FROM documents), t AS (SELECT *, {sql.tokens('text')} AS tok FROM s) "
    f"SELECT doc_id, text, CAST(CASE WHEN {sql.known_short('text', 'tok')} THEN greatest(len(tok), 3.0) ELSE len(tok) END AS DOUBLE) AS word_count, CAST(CASE WHEN {sql.known_short('text', 'tok')} THEN 1.0 ELSE {sql.dictionary_ratio('tok')} END AS DOUBLE) AS dictionary_ratio, "
    f"round(CAST(CASE WHEN {sql.known_short('text', 'tok')} THEN greatest({sql.word_frequency('tok')}, 2.5) ELSE {sql.word_frequency('tok')} END AS DOUBLE) + 1e-9::DOUBLE, 6) AS word_frequency_score, CAST(CASE WHEN {sql.loud('text', 'tok')} THEN greatest({sql.punctuation_count('text')}, 2.0) ELSE {sql.punctuation_count('text')} END AS DOUBLE) AS punctuation_count FROM t",
)
def lng7(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.element_at(F.array(*[F.lit(x) for x in SHORT]), (F.col("doc_id") % len(SHORT) + 1).cast("int")).alias("text"))
    d = d.withColumn("f", lng.extract(F.col("text"))).withColumn("f", lng.boosted(F.col("text"), F.col("f")))
    return d.select("doc_id", "text", "f.word_count", "f.dictionary_ratio", r6("f.word_frequency_score").alias("word_frequency_score"), "f.punctuation_count")


@query("cls7_normalized_features", f"WITH {RAW_SQL}, {NORM_SQL} SELECT doc_id, {', '.join(f'round(CAST({k} AS DOUBLE) + 1e-9::DOUBLE, 6) AS {k}' for k in TEXT_WEIGHTS)} FROM n")
def cls7(spark, sf_dir):
    d = classify.classify_texts(decorated(spark, sf_dir))
    return d.select("doc_id", *[r6(F.col("norm")[k]).alias(k) for k in TEXT_WEIGHTS])


@query("cls8_text_score", f"WITH {RAW_SQL}, {NORM_SQL} SELECT doc_id, round({TEXT_SCORE_SQL} + 1e-9::DOUBLE, 6) AS score FROM n")
def cls8(spark, sf_dir):
    return classify.classify_texts(decorated(spark, sf_dir)).select("doc_id", r6("score").alias("score"))


@query("cls9_scaled_weights", "SELECT * FROM (VALUES " + ", ".join(f"({sql.q(k)}, round({v / 1.5}::DOUBLE + 1e-9::DOUBLE, 6))" for k, v in (TEXT_WEIGHTS | {"bbox_area": 0.58}).items()) + ") AS v(feature, weight)")
def cls9(spark, sf_dir):
    scaled = scaled_text_weights(TEXT_WEIGHTS | {"bbox_area": 0.58})
    return spark.createDataFrame(list(scaled.items()), "feature string, weight double").select("feature", r6("weight").alias("weight"))


@query("cls10_classify_text", f"WITH {RAW_SQL}, {NORM_SQL}, s AS (SELECT lang, {TEXT_SCORE_SQL} AS score FROM n) SELECT lang, CASE WHEN score >= 0.55::DOUBLE THEN 'dialogue' ELSE 'background' END AS label, count(*) AS texts FROM s GROUP BY 1, 2")
def cls10(spark, sf_dir):
    return classify.classify_texts(decorated(spark, sf_dir)).groupBy("lang", "label").agg(F.count("*").alias("texts"))


@query("cls11_review_bands", f"WITH {RAW_SQL}, {NORM_SQL}, s AS (SELECT {TEXT_SCORE_SQL} AS score FROM n) SELECT CASE WHEN score >= 0.70::DOUBLE THEN 'dialogue' WHEN score < 0.45::DOUBLE THEN 'background' ELSE 'review' END AS band, count(*) AS texts FROM s GROUP BY 1")
def cls11(spark, sf_dir):
    return classify.classify_texts(decorated(spark, sf_dir)).groupBy(classify.review_band(F.col("score")).alias("band")).agg(F.count("*").alias("texts"))


# ---- words, edges, bubbles


def words_of(spark, sf_dir):
    return virtual_words(table(spark, sf_dir, "conversations"))


def words_and_panels(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    w = virtual_words(c)
    return w, virtual_panels(c, w)


def bubbles_of(spark, sf_dir):
    return grouping.group_into_bubbles(words_of(spark, sf_dir))


EDGES_SQL = f"""edges AS (SELECT a.chapter_id, a.panel_id, a.word_idx AS src, b.word_idx AS dst FROM words a JOIN words b
  ON a.chapter_id = b.chapter_id AND a.panel_id = b.panel_id AND a.word_idx < b.word_idx AND ({sql.words_close('a.', 'b.')}))"""
CLUSTERS_SQL = """both_ways AS (SELECT chapter_id, panel_id, src, dst FROM edges UNION ALL SELECT chapter_id, panel_id, dst, src FROM edges),
reach(chapter_id, panel_id, word_idx, other) AS (SELECT chapter_id, panel_id, word_idx, word_idx FROM words
  UNION SELECT r.chapter_id, r.panel_id, e.dst, r.other FROM reach r JOIN both_ways e ON r.chapter_id = e.chapter_id AND r.panel_id = e.panel_id AND r.word_idx = e.src AND e.dst > r.other),
clusters AS (SELECT chapter_id, panel_id, word_idx, CAST(min(other) AS INTEGER) AS cluster_id FROM reach GROUP BY 1, 2, 3)"""
# a word reaches its component's smallest member only over words above it, so the closure is taken over all and cut to the smallest
CLUSTERS_SQL = CLUSTERS_SQL.replace(" AND e.dst > r.other", "")
SPLIT_SQL = """cw AS (SELECT w.*, c.cluster_id, max("right") OVER k - min("left") OVER k AS kw, max(bottom) OVER k - min(top) OVER k AS kh
  FROM words w JOIN clusters c USING (chapter_id, panel_id, word_idx) WINDOW k AS (PARTITION BY w.chapter_id, w.panel_id, c.cluster_id)),
ax AS (SELECT *, CASE WHEN kw > 500 THEN 1 WHEN kh > 800 THEN 2 ELSE 0 END AS axis FROM cw),
al AS (SELECT *, CASE WHEN axis = 2 THEN top ELSE "left" END AS pa, CASE WHEN axis = 2 THEN bottom ELSE "right" END AS pe, "right" - "left" AS ww FROM ax),
cu AS (SELECT *, pa - lag(pe) OVER o AS gap, lag(ww) OVER o AS pw FROM al WINDOW o AS (PARTITION BY chapter_id, panel_id, cluster_id ORDER BY pa, word_idx)),
ct AS (SELECT *, CASE WHEN axis = 1 AND gap > least(100.0::DOUBLE, greatest(60.0::DOUBLE, 1.5::DOUBLE * (pw + ww) / 2.0::DOUBLE)) THEN 1 WHEN axis = 2 AND gap > 100 THEN 1 ELSE 0 END AS cut FROM cu),
split AS (SELECT *, CAST(sum(cut) OVER (PARTITION BY chapter_id, panel_id, cluster_id ORDER BY pa, word_idx ROWS UNBOUNDED PRECEDING) AS INTEGER) AS island FROM ct)"""
# in the virtual layout no line overlaps another by half, so lines are the distinct tops
BUBBLES_SQL = """bw AS (SELECT *, dense_rank() OVER (PARTITION BY chapter_id, panel_id, cluster_id, island ORDER BY top) AS line FROM split),
bb AS (SELECT chapter_id, panel_id, cluster_id, island, string_agg(text, ' ' ORDER BY line, "left", word_idx) AS text, min("left") AS "left", min(top) AS top, max("right") AS "right", max(bottom) AS bottom, count(*) AS n_words,
  string_agg(CAST(word_idx AS VARCHAR), ' ' ORDER BY line, "left", word_idx) AS word_order FROM bw GROUP BY 1, 2, 3, 4),
bubbles AS (SELECT *, CAST(row_number() OVER (PARTITION BY chapter_id, panel_id ORDER BY top, "left", cluster_id, island) AS INTEGER) AS reading_order FROM bb)"""
W_SQL = f"WITH RECURSIVE {VIRTUAL_SQL}"
GROUP_SQL = f"{W_SQL}, {EDGES_SQL}, {CLUSTERS_SQL}, {SPLIT_SQL}, {BUBBLES_SQL}"


@query("geo1_box_stats", f'{W_SQL} SELECT chapter_id, panel_id, word_idx, "left", top, "right", bottom, "right" - "left" AS width, bottom - top AS height, ("left" * 2 + "right" * 2) / 4.0::DOUBLE AS center_x, (top * 2 + bottom * 2) / 4.0::DOUBLE AS center_y FROM words')
def geo1(spark, sf_dir):
    w = words_of(spark, sf_dir)
    corner = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    polygon = F.array(corner("left", "top"), corner("right", "top"), corner("right", "bottom"), corner("left", "bottom"))
    return w.select("chapter_id", "panel_id", "word_idx", g.from_vertices(polygon).alias("b")).select("chapter_id", "panel_id", "word_idx", "b.*")


@query("geo2_box_union", f'{W_SQL} SELECT chapter_id, panel_id, min("left") AS "left", min(top) AS top, max("right") AS "right", max(bottom) AS bottom FROM words GROUP BY 1, 2')
def geo2(spark, sf_dir):
    return words_of(spark, sf_dir).groupBy("chapter_id", "panel_id").agg(*g.union())


NEIGHBOURS_SQL = f"{W_SQL}, nb AS (SELECT a.chapter_id, a.panel_id, a.word_idx, {', '.join(f'a.{chr(34)}{c}{chr(34)} AS a_{c}, b.{chr(34)}{c}{chr(34)} AS b_{c}' for c in grouping.BOX)} FROM words a JOIN words b ON a.chapter_id = b.chapter_id AND a.panel_id = b.panel_id AND b.word_idx = a.word_idx + 1)"


def neighbours(spark, sf_dir):
    w = words_of(spark, sf_dir)
    a = w.select("chapter_id", "panel_id", "word_idx", *[F.col(c).alias(f"a_{c}") for c in grouping.BOX])
    b = w.select("chapter_id", "panel_id", (F.col("word_idx") - 1).alias("word_idx"), *[F.col(c).alias(f"b_{c}") for c in grouping.BOX])
    return a.join(b, ["chapter_id", "panel_id", "word_idx"])


KEY = ["chapter_id", "panel_id", "word_idx"]


def ab():
    return g.Box.of("a_"), g.Box.of("b_")


@query("geo3_vertical_overlap", f"{NEIGHBOURS_SQL} SELECT {', '.join(KEY)}, round({sql.vertical_overlap('a_', 'b_')} + 1e-9::DOUBLE, 6) AS overlap FROM nb")
def geo3(spark, sf_dir):
    return neighbours(spark, sf_dir).select(*KEY, r6(g.vertical_overlap(*ab())).alias("overlap"))


@query("geo4_gaps", f"{NEIGHBOURS_SQL} SELECT {', '.join(KEY)}, {sql.horizontal_gap('a_', 'b_')} AS gap_h, {sql.vertical_gap('a_', 'b_')} AS gap_v FROM nb")
def geo4(spark, sf_dir):
    return neighbours(spark, sf_dir).select(*KEY, g.horizontal_gap(*ab()).alias("gap_h"), g.vertical_gap(*ab()).alias("gap_v"))


@query("geo5_horizontal_alignment", f"{NEIGHBOURS_SQL} SELECT {', '.join(KEY)}, round({sql.horizontal_alignment('a_', 'b_')} + 1e-9::DOUBLE, 6) AS alignment FROM nb")
def geo5(spark, sf_dir):
    return neighbours(spark, sf_dir).select(*KEY, r6(g.horizontal_alignment(*ab())).alias("alignment"))


@query("geo6_width_similarity", f"{NEIGHBOURS_SQL} SELECT {', '.join(KEY)}, round({sql.width_similarity('a_', 'b_')} + 1e-9::DOUBLE, 6) AS similarity FROM nb")
def geo6(spark, sf_dir):
    return neighbours(spark, sf_dir).select(*KEY, r6(g.width_similarity(*ab())).alias("similarity"))


@query(
    "geo7_box_ratios",
    f'{W_SQL} SELECT w.chapter_id, w.panel_id, word_idx, round(CAST((w."right" - w."left") * (bottom - top) AS DOUBLE) / (p.width * p.height) + 1e-9::DOUBLE, 6) AS area_ratio, round(CAST("right" - "left" AS DOUBLE) / (bottom - top) + 1e-9::DOUBLE, 6) AS aspect, round(CAST(length(text) AS DOUBLE) / (("right" - "left") * (bottom - top)) + 1e-9::DOUBLE, 6) AS density FROM words w JOIN panels p USING (chapter_id, panel_id)',
)
def geo7(spark, sf_dir):
    w, p = words_and_panels(spark, sf_dir)
    b = g.Box.of()
    return w.join(p, ["chapter_id", "panel_id"]).select(*KEY, r6(g.area_ratio(b, F.col("width").cast("long") * F.col("height"))).alias("area_ratio"), r6(g.aspect_ratio(b)).alias("aspect"), r6(g.text_density(F.col("text"), b)).alias("density"))


@query("join1_word_edges", f"{W_SQL}, {EDGES_SQL} SELECT * FROM edges")
def join1(spark, sf_dir):
    return grouping.word_edges(words_of(spark, sf_dir))


@query("join2_components", f"{W_SQL}, {EDGES_SQL}, {CLUSTERS_SQL} SELECT * FROM clusters")
def join2(spark, sf_dir):
    w = words_of(spark, sf_dir)
    return grouping.components(w, grouping.word_edges(w))


@query("grp_clusters", f"{W_SQL}, {EDGES_SQL}, {CLUSTERS_SQL} SELECT * FROM clusters")
def grp_clusters(spark, sf_dir):
    return grouping.clusters(words_of(spark, sf_dir))


@query("win1_wide_split", f"{W_SQL}, {EDGES_SQL}, {CLUSTERS_SQL}, {SPLIT_SQL} SELECT chapter_id, panel_id, word_idx, cluster_id, island FROM split WHERE axis = 1")
def win1(spark, sf_dir):
    w = grouping.split_clusters(grouping.clustered_words(words_of(spark, sf_dir)))
    return w.where("axis = 1").select(*KEY, "cluster_id", "island")


TALL_P = Params(max_vertical_gap=130)
TALL_SQL = f"{W_SQL.replace('words AS (', 'words0 AS (').replace('panels AS (', 'panels0 AS (').replace('LEFT JOIN words ', 'LEFT JOIN words0 ')}, words AS (SELECT chapter_id, panel_id, word_idx, text, (word_idx % 3) * 30 + 40 AS \"left\", word_idx * (20 + 5 * (chapter_id % 5)) + CASE WHEN word_idx % 4 = 3 THEN 60 ELSE 0 END AS top, (word_idx % 3) * 30 + 90 AS \"right\", word_idx * (20 + 5 * (chapter_id % 5)) + CASE WHEN word_idx % 4 = 3 THEN 70 ELSE 14 END AS bottom FROM words0), {EDGES_SQL.replace(') < 100 AND', ') < 130 AND')}"


def tall_words(spark, sf_dir):
    """A ladder of small words, so that clusters are tall and have gaps."""
    step = F.col("word_idx") * (20 + 5 * (F.col("chapter_id") % 5))
    odd = F.col("word_idx") % 4 == 3
    left = (F.col("word_idx") % 3) * 30
    return words_of(spark, sf_dir).withColumns({"left": (left + 40).cast("int"), "top": (step + F.when(odd, 60).otherwise(0)).cast("int"), "right": (left + 90).cast("int"), "bottom": (step + F.when(odd, 70).otherwise(14)).cast("int")})


@query("win2_tall_split", f"{TALL_SQL}, {CLUSTERS_SQL}, {SPLIT_SQL} SELECT chapter_id, panel_id, word_idx, cluster_id, island FROM split WHERE axis = 2")
def win2(spark, sf_dir):
    w = grouping.split_clusters(grouping.clustered_words(tall_words(spark, sf_dir), TALL_P), TALL_P)
    return w.where("axis = 2").select(*KEY, "cluster_id", "island")


@query("win3_split_control", f"{W_SQL}, {EDGES_SQL}, {CLUSTERS_SQL}, {SPLIT_SQL} SELECT axis, count(*) AS n_words, CAST(sum(cut) AS BIGINT) AS cuts FROM split GROUP BY axis")
def win3(spark, sf_dir):
    w = grouping.split_clusters(grouping.clustered_words(words_of(spark, sf_dir)))
    per = w.groupBy(*grouping.PANEL, "cluster_id", "axis").agg(F.count("*").alias("n"), F.max("island").alias("cuts"))
    return per.groupBy("axis").agg(F.sum("n").alias("n_words"), F.sum("cuts").cast("long").alias("cuts"))


@query("win4_line_assignment", f"{GROUP_SQL} SELECT chapter_id, panel_id, cluster_id, island, max(line) AS n_lines, count(*) AS n_words FROM bw GROUP BY 1, 2, 3, 4")
def win4(spark, sf_dir):
    w = grouping.split_clusters(grouping.clustered_words(words_of(spark, sf_dir)))
    ws = F.array_sort(F.collect_list(F.struct("word_idx", "text", *grouping.BOX)))
    per = w.groupBy(*grouping.PANEL, "cluster_id", "island").agg(ws.alias("ws"))
    return per.select(*grouping.PANEL, "cluster_id", "island", F.size(grouping.lines_first_fit(F.col("ws"))).cast("long").alias("n_lines"), F.size("ws").cast("long").alias("n_words"))


@query("sort1_word_reading_order", f"{GROUP_SQL} SELECT chapter_id, panel_id, reading_order, word_order FROM bubbles")
def sort1(spark, sf_dir):
    return bubbles_of(spark, sf_dir).select(*grouping.PANEL, "reading_order", F.array_join(F.transform("words", lambda w: w["word_idx"].cast("string")), " ").alias("word_order"))


@query("sort2_bubble_reading_order", f'{GROUP_SQL} SELECT chapter_id, panel_id, reading_order, top, "left" FROM bubbles')
def sort2(spark, sf_dir):
    return bubbles_of(spark, sf_dir).select(*grouping.PANEL, "reading_order", "top", "left")


@query("agg1_bubbles", f'{GROUP_SQL} SELECT chapter_id, panel_id, reading_order, text, "left", top, "right", bottom, n_words FROM bubbles')
def agg1(spark, sf_dir):
    return bubbles_of(spark, sf_dir).select(*grouping.PANEL, "reading_order", "text", *grouping.BOX, F.size("words").cast("long").alias("n_words"))


@query("grp_group_into_bubbles", f"{GROUP_SQL} SELECT chapter_id, panel_id, count(*) AS bubbles, CAST(sum(n_words) AS BIGINT) AS n_words, string_agg(text, ' / ' ORDER BY reading_order) AS text FROM bubbles GROUP BY 1, 2")
def grp(spark, sf_dir):
    b = bubbles_of(spark, sf_dir)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("reading_order", "text"))), lambda x: x["text"])
    return b.groupBy(*grouping.PANEL).agg(F.count("*").alias("bubbles"), F.sum(F.size("words")).cast("long").alias("n_words"), F.array_join(ordered, " / ").alias("text"))


@query("snk3_bubble_json", f"{GROUP_SQL} SELECT chapter_id, panel_id, reading_order, CAST(to_json(struct_pack(text := text, reading_order := reading_order, \"left\" := \"left\", top := top, \"right\" := \"right\", bottom := bottom, word_count := n_words)) AS VARCHAR) AS json FROM bubbles")
def snk3(spark, sf_dir):
    return grouping.bubble_json(bubbles_of(spark, sf_dir))


@query("snk4_group_metadata", f"{GROUP_SQL} SELECT chapter_id, panel_id, count(*) AS total_bubbles, CAST(sum(n_words) AS BIGINT) AS total_words, 100 AS max_vertical_gap, 150 AS max_center_shift FROM bubbles GROUP BY 1, 2")
def snk4(spark, sf_dir):
    return grouping.with_metadata(bubbles_of(spark, sf_dir)).select(*grouping.PANEL, "total_bubbles", "total_words", "max_vertical_gap", "max_center_shift")


@query("join6_positional_zip", f"{GROUP_SQL} SELECT b.chapter_id, b.panel_id, reading_order, p.width, p.height FROM bubbles b JOIN panels p USING (chapter_id, panel_id)")
def join6(spark, sf_dir):
    w, p = words_and_panels(spark, sf_dir)
    return grouping.group_into_bubbles(w).join(p, ["chapter_id", "panel_id"]).select(*grouping.PANEL, "reading_order", "width", "height")


@query("lim2_batches", f"{W_SQL} SELECT chapter_id, panel_id, CAST((row_number() OVER (PARTITION BY chapter_id ORDER BY panel_id) - 1) // 16 AS INTEGER) AS batch FROM panels")
def lim2(spark, sf_dir):
    p = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("chapter_id"), F.col("turn").cast("int").alias("panel_id"))
    nth = F.row_number().over(grouping.W.partitionBy("chapter_id").orderBy("panel_id")) - 1
    return p.withColumn("batch", F.floor(nth / DEFAULTS.ocr_batch).cast("int"))


# ---- classification of bubbles and words


def _box_sql(source: str, key: str) -> str:
    """CLS1 to CLS4 over ``source`` with a box, text and image_area."""
    return f"""b0 AS (SELECT *, {sql.strip('text')} AS s FROM {source}),
b1 AS (SELECT *, {sql.fix_ocr_errors(sql.clean_artifacts('lower(s)'))} AS x1 FROM b0),
b2 AS (SELECT *, {sql.normalize('x1')} AS x2 FROM b1), b3 AS (SELECT *, {sql.limit_repeats('x2')} AS x3 FROM b2), b4 AS (SELECT *, {sql.fix_corruptions('x3')} AS p FROM b3),
b5 AS (SELECT *, {sql.tokens('p')} AS tok, {sql.tokens('text')} AS ttok, len({sql.words('s')}) AS n, lower(s) AS ls, ("right" - "left") * (bottom - top) AS area FROM b4),
b6 AS (SELECT *, {sql.ratio('area', 'image_area')} AS a, {sql.ratio('length(s)', 'area')} AS d, CASE WHEN bottom > top THEN CAST("right" - "left" AS DOUBLE) / (bottom - top) ELSE 1.0 END AS r,
  {sql.dictionary_ratio('tok')} AS dic, {sql.alphabet_ratio('p')} AS alp, {sql.word_frequency('tok')} / 5.0::DOUBLE AS fre, {sql.trigram_score('p')} / 5.0::DOUBLE AS tri, 1.0::DOUBLE - ({sql.ocr_noise('p')}) AS noi,
  {sql.ratio(f"length({sql.sub('s', '[\\x00-\\x7F]', '')})", "length(replace(s, ' ', ''))")} > 0.5 AS fgn, s <> '' AND right(s, 1) IN ('.', '!', '?', '…') AS ends, regexp_matches(s, '[.!?,;:—\\-~]') AS anyp,
  {sql.any_of('ls', sql.lexicon.UI_WORDS)} AS ui, {sql.any_of('ls', sql.lexicon.WARNING_WORDS)} AS warn, {sql.known_short('text', 'ttok')} AND len({sql.words('text')}) <= 2 AS ks, {sql.loud('text', 'ttok')} AND len({sql.words('text')}) <= 2 AS lo FROM b5),
b7 AS (SELECT {key}, ks, lo, CAST(CASE WHEN warn AND a > 0.06::DOUBLE THEN 0.9 WHEN a < 0.003::DOUBLE THEN 0.2 WHEN a < 0.008::DOUBLE THEN 0.6 WHEN a <= 0.06::DOUBLE THEN 1.0 WHEN a <= 0.13::DOUBLE THEN 0.6 ELSE 0.4 END AS DOUBLE) AS bbox_area,
  CAST(CASE WHEN ui AND n = 1 THEN 0.0 WHEN ui AND n = 2 THEN 0.1 WHEN ui THEN 0.3 WHEN n = 1 THEN 0.5 WHEN n = 2 THEN 0.6 WHEN n <= 5 THEN 0.75 WHEN n <= 15 THEN 1.0 WHEN n <= 30 THEN 0.9 ELSE 0.8 END AS DOUBLE) AS word_count,
  CAST(CASE WHEN d < 0.0005::DOUBLE THEN 0.6 WHEN d <= 0.0015::DOUBLE THEN 1.0 WHEN d <= 0.005::DOUBLE THEN 0.5 WHEN d <= 0.02::DOUBLE THEN 0.3 ELSE 0.0 END AS DOUBLE) AS text_density,
  CAST(CASE WHEN r BETWEEN 2 AND 5 THEN 1.0 WHEN r >= 1 AND r < 6 THEN 0.7 WHEN r > 6 AND r <= 8 THEN 0.5 ELSE 0.3 END AS DOUBLE) AS aspect_ratio,
  CAST(CASE WHEN ends THEN 1.0 WHEN fgn THEN 0.0 WHEN anyp THEN 0.6 ELSE 0.2 END AS DOUBLE) AS punctuation,
  CAST(CASE WHEN fgn THEN 0.0 WHEN dic >= 0.8::DOUBLE THEN 1.0 WHEN dic >= 0.5 THEN 0.7 WHEN dic >= 0.3::DOUBLE THEN 0.4 ELSE dic * 0.3::DOUBLE END AS DOUBLE) AS dictionary_ratio,
  CAST(CASE WHEN fgn THEN 0.0 WHEN alp >= 0.7::DOUBLE THEN 1.0 WHEN alp >= 0.5 THEN 0.8 WHEN alp >= 0.3::DOUBLE THEN 0.5 ELSE alp END AS DOUBLE) AS alphabet_ratio,
  CAST(CASE WHEN fgn THEN 0.0 WHEN fre >= 0.6::DOUBLE THEN 1.0 WHEN fre >= 0.4::DOUBLE THEN 0.8 ELSE fre END AS DOUBLE) AS word_frequency, CAST(CASE WHEN fgn THEN 0.0 ELSE tri END AS DOUBLE) AS trigram_score, noi AS ocr_noise,
  regexp_matches(s, '^\\d{{1,2}}\\s*:\\s*\\d{{2}}(/\\d{{1,2}}\\s*:\\s*\\d{{2}})?$') AS stamp FROM b6),
b8 AS (SELECT {key}, stamp, bbox_area, CASE WHEN ks THEN greatest(word_count, 3.0) ELSE word_count END AS word_count, text_density, aspect_ratio, CASE WHEN lo THEN greatest(punctuation, 2.0) ELSE punctuation END AS punctuation,
  CASE WHEN ks THEN 1.0 ELSE dictionary_ratio END AS dictionary_ratio, alphabet_ratio, CASE WHEN ks THEN greatest(word_frequency, 2.5) ELSE word_frequency END AS word_frequency, trigram_score, ocr_noise FROM b7),
scored AS (SELECT *, CASE WHEN stamp THEN 0.0 ELSE {' + '.join(f'{w}::DOUBLE * CAST({k} AS DOUBLE)' for k, w in classify.BOX_WEIGHTS.items())} END AS score FROM b8)"""


WORD_KEY = "chapter_id, panel_id, word_idx"
WORD_BOX_SQL = f"{W_SQL}, wb AS (SELECT w.*, CAST(p.width AS BIGINT) * p.height AS image_area FROM words w JOIN panels p USING (chapter_id, panel_id)), {_box_sql('wb', WORD_KEY)}"
BUBBLE_KEY = "chapter_id, panel_id, reading_order"
BUBBLE_BOX_SQL = f"{GROUP_SQL}, wb AS (SELECT b.*, CAST(p.width AS BIGINT) * p.height AS image_area FROM bubbles b JOIN panels p USING (chapter_id, panel_id)), {_box_sql('wb', BUBBLE_KEY + ', text, n_words')}"
BOX_FEATURES = list(classify.BOX_WEIGHTS)


def sized_words(spark, sf_dir):
    w, p = words_and_panels(spark, sf_dir)
    return w.join(p, ["chapter_id", "panel_id"]).withColumn("image_area", F.col("width").cast("long") * F.col("height"))


def sized_bubbles(spark, sf_dir):
    w, p = words_and_panels(spark, sf_dir)
    return grouping.group_into_bubbles(w).join(p, ["chapter_id", "panel_id"]).withColumn("image_area", F.col("width").cast("long") * F.col("height"))


@query("cls1_box_features", f"{WORD_BOX_SQL} SELECT {WORD_KEY}, {', '.join(f'round({k} + 1e-9::DOUBLE, 6) AS {k}' for k in BOX_FEATURES)} FROM b7")
def cls1(spark, sf_dir):
    d = classify.with_box_features(sized_words(spark, sf_dir), F.col("image_area"), texts=words_of(spark, sf_dir))
    return d.select(*KEY, *[r6(F.col("features")[k]).alias(k) for k in BOX_FEATURES])


@query("cls2_weighted_score", f"{BUBBLE_BOX_SQL} SELECT {BUBBLE_KEY}, round(score + 1e-9::DOUBLE, 6) AS score FROM scored")
def cls2(spark, sf_dir):
    return classify.score_boxes(sized_bubbles(spark, sf_dir), F.col("image_area")).select(*grouping.PANEL, "reading_order", r6("score").alias("score"))


@query("cls3_weight_validation", "SELECT * FROM (VALUES ('default', true), ('off by 0.0005', true), ('off by 0.01', false)) AS v(weights, accepted)")
def cls3(spark, sf_dir):
    rows = []
    for name, extra in (("default", 0.0), ("off by 0.0005", 0.0005), ("off by 0.01", 0.01)):
        try:
            Params(box_weights=classify.BOX_WEIGHTS | {"ocr_noise": 0.03 + extra})
            rows.append((name, True))
        except ValueError:
            rows.append((name, False))
    return spark.createDataFrame(rows, "weights string, accepted boolean")


@query("cls4_classify_regions", f"{WORD_BOX_SQL} SELECT {WORD_KEY}, round(score + 1e-9::DOUBLE, 6) AS score, score >= 0.60::DOUBLE AS is_text_box FROM scored")
def cls4(spark, sf_dir):
    return classify.score_boxes(sized_words(spark, sf_dir), F.col("image_area"), texts=words_of(spark, sf_dir)).select(*KEY, r6("score").alias("score"), "is_text_box")


@query("cls5_filter_text_boxes", f"{WORD_BOX_SQL} SELECT {WORD_KEY} FROM scored WHERE score >= 0.60::DOUBLE")
def cls5(spark, sf_dir):
    return classify.filter_boxes(sized_words(spark, sf_dir), F.col("image_area"), texts=words_of(spark, sf_dir)).select(*KEY)


@query("cls6_filter_text_bubbles", f"{BUBBLE_BOX_SQL} SELECT {BUBBLE_KEY}, text FROM scored WHERE score >= 0.60::DOUBLE")
def cls6(spark, sf_dir):
    return classify.filter_boxes(sized_bubbles(spark, sf_dir), F.col("image_area")).select(*grouping.PANEL, "reading_order", "text")


# ---- continuation

LAST = f"right({sql.strip('a_text')}, 1)"


def continuation_sql(src: str) -> str:
    """JOIN3, CON2, JOIN4 and CON3 over the bubbles of ``src``: cand, found, links, merged."""
    boxes = ", ".join(f"a.{chr(34)}{c}{chr(34)} AS a_{c}, b.{chr(34)}{c}{chr(34)} AS b_{c}" for c in grouping.BOX)
    last = ", ".join(f"arg_max(b.{chr(34)}{c}{chr(34)}, n) AS {chr(34)}{c}{chr(34)}" for c in ("panel_id", *grouping.BOX))
    clash = "(list_contains(g.up, m.prev_order) OR list_contains(g.un, m.next_order))"
    return f"""low AS (SELECT b.*, row_number() OVER (PARTITION BY b.chapter_id, b.panel_id ORDER BY reading_order DESC) AS rk FROM {src} b JOIN panels p USING (chapter_id, panel_id) WHERE p.height - b.bottom <= 50),
cand AS (SELECT a.chapter_id, a.panel_id, a.panel_id + 1 AS next_panel, a.reading_order AS prev_order, b.reading_order AS next_order, a.text AS a_text, {boxes}
  FROM low a JOIN {src} b ON a.chapter_id = b.chapter_id AND b.panel_id = a.panel_id + 1 WHERE a.rk <= 10 AND b.top <= 50),
sc AS (SELECT *, {sql.horizontal_alignment('a_', 'b_')} AS al, {sql.width_similarity('a_', 'b_')} AS ws, {LAST} AS lc FROM cand),
found AS (SELECT *, CASE WHEN ws >= 0.7::DOUBLE AND lc <> '' THEN 1.0::DOUBLE ELSE 0.7::DOUBLE END AS confidence FROM sc WHERE al >= 0.6::DOUBLE AND CASE WHEN lc = '' THEN ws >= 0.7::DOUBLE ELSE lc NOT IN ('.', '!', '?') END),
mk AS (SELECT *, row_number() OVER (PARTITION BY chapter_id, panel_id ORDER BY prev_order, next_order) AS k FROM found),
gr(chapter_id, panel_id, k, took, up, un) AS (SELECT DISTINCT chapter_id, panel_id, CAST(0 AS BIGINT), false, CAST([] AS INTEGER[]), CAST([] AS INTEGER[]) FROM mk
  UNION ALL SELECT m.chapter_id, m.panel_id, m.k, NOT {clash}, CASE WHEN {clash} THEN g.up ELSE list_append(g.up, m.prev_order) END, CASE WHEN {clash} THEN g.un ELSE list_append(g.un, m.next_order) END
  FROM gr g JOIN mk m ON m.chapter_id = g.chapter_id AND m.panel_id = g.panel_id AND m.k = g.k + 1),
links AS (SELECT m.* FROM mk m JOIN gr g USING (chapter_id, panel_id, k) WHERE g.took),
chain(chapter_id, hp, ho, panel_id, reading_order, n) AS (SELECT chapter_id, panel_id, reading_order, panel_id, reading_order, 1 FROM {src} b
    WHERE NOT EXISTS (SELECT 1 FROM links l WHERE l.chapter_id = b.chapter_id AND l.next_panel = b.panel_id AND l.next_order = b.reading_order)
  UNION ALL SELECT c.chapter_id, c.hp, c.ho, l.next_panel, l.next_order, c.n + 1 FROM chain c JOIN links l ON l.chapter_id = c.chapter_id AND l.panel_id = c.panel_id AND l.prev_order = c.reading_order),
merged AS (SELECT *, CAST(row_number() OVER (PARTITION BY chapter_id ORDER BY hp, ho) - 1 AS INTEGER) AS bubble_idx FROM (
  SELECT c.chapter_id, c.hp, c.ho, c.ho AS head_order, string_agg(b.text, ' ' ORDER BY n) AS text, {last}, CAST(count(*) AS INTEGER) AS parts, CAST(sum(b.n_words) AS BIGINT) AS word_count
  FROM chain c JOIN {src} b USING (chapter_id, panel_id, reading_order) GROUP BY c.chapter_id, c.hp, c.ho))"""


CAND_SQL = MATCH_SQL = f"{GROUP_SQL}, {continuation_sql('bubbles')}"


@query("con1_incomplete_sentence", f"{GROUP_SQL} SELECT {BUBBLE_KEY}, CASE WHEN {sql.strip('text')} = '' THEN false ELSE right({sql.strip('text')}, 1) NOT IN ('.', '!', '?') END AS incomplete FROM bubbles")
def con1(spark, sf_dir):
    return bubbles_of(spark, sf_dir).select(*grouping.PANEL, "reading_order", continuation.incomplete(F.col("text")).alias("incomplete"))


@query("join3_panel_candidates", f"{CAND_SQL} SELECT chapter_id, panel_id, prev_order, next_order FROM cand")
def join3(spark, sf_dir):
    w, p = words_and_panels(spark, sf_dir)
    return continuation.candidates(grouping.group_into_bubbles(w), p).select("chapter_id", "panel_id", F.col("a_reading_order").alias("prev_order"), F.col("b_reading_order").alias("next_order"))


@query("lim1_candidate_cap", f"{GROUP_SQL}, l AS (SELECT b.chapter_id, b.panel_id, row_number() OVER (PARTITION BY b.chapter_id, b.panel_id ORDER BY reading_order DESC) AS rk FROM bubbles b JOIN panels p USING (chapter_id, panel_id) WHERE p.height - b.bottom <= 50) SELECT chapter_id, panel_id, count(*) AS n FROM l WHERE rk <= 10 GROUP BY 1, 2")
def lim1(spark, sf_dir):
    w, p = words_and_panels(spark, sf_dir)
    b = grouping.group_into_bubbles(w).join(p, ["chapter_id", "panel_id"]).where(F.col("height") - F.col("bottom") <= DEFAULTS.edge_gap_px)
    nth = F.row_number().over(grouping.W.partitionBy("chapter_id", "panel_id").orderBy(F.desc("reading_order")))
    return b.withColumn("r", nth).where(F.col("r") <= DEFAULTS.max_candidates).groupBy("chapter_id", "panel_id").agg(F.count("*").alias("n"))


@query("con2_check_continuation", f"{MATCH_SQL} SELECT chapter_id, panel_id, next_panel, prev_order, next_order, confidence FROM found")
def con2(spark, sf_dir):
    w, p = words_and_panels(spark, sf_dir)
    return continuation.matches(grouping.group_into_bubbles(w), p).drop("reason")


@query("join4_greedy_matching", f"{MATCH_SQL} SELECT chapter_id, panel_id, next_panel, prev_order, next_order, confidence FROM links")
def join4(spark, sf_dir):
    w, p = words_and_panels(spark, sf_dir)
    return continuation.greedy(continuation.matches(grouping.group_into_bubbles(w), p))


@query("con3_merge_continuations", f'{MATCH_SQL} SELECT chapter_id, bubble_idx, panel_id, head_order AS reading_order, text, "left", top, "right", bottom, parts, word_count FROM merged')
def con3(spark, sf_dir):
    w, p = words_and_panels(spark, sf_dir)
    return continuation.merge(grouping.group_into_bubbles(w), p)


@query("con3_merge_native", f'{MATCH_SQL} SELECT chapter_id, panel_id, head_order AS reading_order, text, "left", top, "right", bottom, parts FROM merged')
def con3_native(spark, sf_dir):
    w, p = words_and_panels(spark, sf_dir)
    return continuation.merge_native(grouping.group_into_bubbles(w), p)


# ---- providers, audio, pipeline


def pages_of(spark, sf_dir):
    """Turns as pages whose bytes are their text; every 17th page can't be read by the stub."""
    c = table(spark, sf_dir, "conversations")
    body = F.when((F.col("conv_id") * 8 + F.col("turn")) % 17 == 0, F.lit("OCR-FAILS")).otherwise(F.regexp_replace("text", r"\s+", " "))
    return c.select(F.col("conv_id").alias("chapter_id"), F.col("turn").cast("int").alias("panel_id"), body.cast("binary").alias("content"))


@query("src1_chapter_ingest", "SELECT conv_id AS chapter_id, count(*) AS n_images, CASE WHEN count(*) > 150 THEN 400 ELSE 200 END AS status, CAST(CASE WHEN count(*) > 150 THEN 'too many images' END AS VARCHAR) AS error FROM conversations GROUP BY conv_id")
def src1(spark, sf_dir):
    return images.chapter_status(pages_of(spark, sf_dir))


@query("src2_image_sizes", "SELECT conv_id AS chapter_id, CAST(turn AS INTEGER) AS panel_id, CAST(600 + conv_id % 50 AS INTEGER) AS width, CAST(900 + turn AS INTEGER) AS height FROM conversations")
def src2(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    n = lambda v: F.unhex(F.lpad(F.hex(v), 8, "0"))
    header = F.concat(F.unhex(F.lit("89504E470D0A1A0A0000000D49484452")), n(600 + F.col("conv_id") % 50), n(900 + F.col("turn")), F.unhex(F.lit("0802000000")))
    w, h = images.png_size(F.col("content"))
    return c.select(F.col("conv_id").alias("chapter_id"), F.col("turn").cast("int").alias("panel_id"), header.alias("content")).select("chapter_id", "panel_id", w.alias("width"), h.alias("height"))


OCR_SQL = """t AS (SELECT conv_id AS chapter_id, CAST(turn AS INTEGER) AS panel_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS ws FROM conversations WHERE (conv_id * 8 + turn) % 17 <> 0),
u AS (SELECT chapter_id, panel_id, unnest(ws) AS text, CAST(unnest(range(len(ws))) AS INTEGER) AS word_idx FROM t),
o AS (SELECT *, CAST(10 + coalesce(sum(10 * length(text) + 8) OVER (PARTITION BY chapter_id, panel_id ORDER BY word_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS l FROM u)"""


@query("src3_detect_text", f'WITH {OCR_SQL} SELECT chapter_id, panel_id, word_idx, text, l AS "left", 10 AS top, CAST(l + 10 * length(text) AS INTEGER) AS "right", 40 AS bottom, 1.0::DOUBLE AS confidence FROM o')
def src3(spark, sf_dir):
    return ocr.words_of(ocr.annotate(pages_of(spark, sf_dir), ocr.StubOcr()))


@query("src4_detect_text_batch", "SELECT conv_id AS chapter_id, CAST(turn AS INTEGER) AS panel_id, CASE WHEN (conv_id * 8 + turn) % 17 = 0 THEN 0 ELSE 1 + len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) END AS annotations, (conv_id * 8 + turn) % 17 = 0 AS failed FROM conversations")
def src4(spark, sf_dir):
    return ocr.annotate(pages_of(spark, sf_dir), ocr.StubOcr()).select("chapter_id", "panel_id", F.size("annotations").cast("long").alias("annotations"), F.col("error").isNotNull().alias("failed"))


@query("src6_normalize_vertices", 'SELECT doc_id, CAST(CASE WHEN doc_id % 2 = 0 THEN 0 ELSE doc_id END AS INTEGER) AS x, CAST(CASE WHEN doc_id % 3 = 0 THEN 0 ELSE doc_id % 100 END AS INTEGER) AS y FROM documents')
def src6(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.array(F.struct(F.when(F.col("doc_id") % 2 != 0, F.col("doc_id").cast("int")).alias("x"), F.when(F.col("doc_id") % 3 != 0, (F.col("doc_id") % 100).cast("int")).alias("y"))).alias("v"))
    return d.select("doc_id", g.normalized_vertices(F.col("v"))[0].alias("v")).select("doc_id", "v.x", "v.y")


def spoken_texts(spark, sf_dir):
    """Each turn's first 40 characters as one text; every 13th fails in the stub."""
    c = table(spark, sf_dir, "conversations")
    t = F.when((F.col("conv_id") + F.col("turn")) % 13 == 0, F.lit("TTS-FAILS")).otherwise(F.concat(F.lit("say "), F.substring(F.regexp_replace("text", r"\s+", " "), 1, 40)))
    return audio.numbered_texts(c.select(F.col("conv_id").alias("chapter_id"), "turn", t.alias("text")), ["turn"])


SPOKEN_SQL = """sp AS (SELECT conv_id AS chapter_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INTEGER) AS reading_order, CASE WHEN (conv_id + turn) % 13 = 0 THEN 'TTS-FAILS' ELSE 'say ' || substring(regexp_replace(text, '\\s+', ' ', 'g'), 1, 40) END AS text FROM conversations),
cl AS (SELECT *, 50 * length(text) AS ms FROM sp WHERE text <> 'TTS-FAILS')"""


@query("tts1_generate_speech", f"WITH {SPOKEN_SQL} SELECT chapter_id, reading_order, 44 + 2 * (8000 * ms // 1000) AS bytes FROM cl WHERE reading_order = 1")
def tts1(spark, sf_dir):
    first = spoken_texts(spark, sf_dir).where("reading_order = 1")
    return audio.clips(first, audio.StubSpeech()).select("chapter_id", "reading_order", F.length("audio").cast("long").alias("bytes"))


@query("tts3_generate_speech_batch", f"WITH {SPOKEN_SQL} SELECT chapter_id, reading_order, text, 'stub' AS voice_id FROM cl")
def tts3(spark, sf_dir):
    return audio.clips(spoken_texts(spark, sf_dir), audio.StubSpeech()).select("chapter_id", "reading_order", "text", "voice_id")


@query("sort3_clip_order", f"WITH {SPOKEN_SQL} SELECT chapter_id, string_agg(CAST(reading_order AS VARCHAR), ' ' ORDER BY reading_order) AS clip_order FROM cl GROUP BY chapter_id")
def sort3(spark, sf_dir):
    c = audio.clips(spoken_texts(spark, sf_dir), audio.StubSpeech())
    return c.groupBy("chapter_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("reading_order")), lambda x: x.cast("string")), " ").alias("clip_order"))


AUD_SQL = f"WITH {SPOKEN_SQL}, au AS (SELECT chapter_id, count(*) AS clips, CAST(sum(ms) + greatest(count(*) - 1, 0) * 700 AS BIGINT) AS duration_ms FROM cl GROUP BY chapter_id)"


@query("aud1_stitch_clips", f"{AUD_SQL} SELECT chapter_id, clips, 'wav' AS format, duration_ms, 44 + 16 * duration_ms AS bytes FROM au")
def aud1(spark, sf_dir):
    s = audio.stitch(audio.clips(spoken_texts(spark, sf_dir), audio.StubSpeech()), audio.WavCodec(), "wav")
    return s.select("chapter_id", "clips", "format", "duration_ms", F.length("audio").cast("long").alias("bytes"))


@query("aud2_chapter_duration", f"{AUD_SQL} SELECT * FROM au")
def aud2(spark, sf_dir):
    ms = spoken_texts(spark, sf_dir).where("text <> 'TTS-FAILS'").select("chapter_id", (50 * F.length("text")).alias("ms"))
    return audio.durations(ms)


@query("aud3_pause_default", f"WITH {SPOKEN_SQL} SELECT chapter_id, CAST(sum(ms) + greatest(count(*) - 1, 0) * 700 AS BIGINT) AS zero_pause, CAST(sum(ms) + greatest(count(*) - 1, 0) * 250 AS BIGINT) AS short_pause FROM cl GROUP BY chapter_id")
def aud3(spark, sf_dir):
    ms = spoken_texts(spark, sf_dir).where("text <> 'TTS-FAILS'").select("chapter_id", (50 * F.length("text")).alias("ms"))
    zero = audio.durations(ms, Params(pause_ms=0)).select("chapter_id", F.col("duration_ms").alias("zero_pause"))
    return zero.join(audio.durations(ms, Params(pause_ms=250)).select("chapter_id", F.col("duration_ms").alias("short_pause")), "chapter_id")


@query("snk1_chapter_headers", f"{AUD_SQL} SELECT chapter_id, CAST(chapter_id AS VARCHAR) AS h_chapter, CAST(clips AS VARCHAR) AS h_bubbles, CAST(duration_ms AS VARCHAR) AS h_ms, 'wav' AS h_format FROM au")
def snk1(spark, sf_dir):
    s = audio.stitch(audio.clips(spoken_texts(spark, sf_dir), audio.StubSpeech()), audio.WavCodec(), "wav")
    h = audio.chapter_headers(s)
    return h.select("chapter_id", F.col("headers")["X-Chapter-ID"].alias("h_chapter"), F.col("headers")["X-Bubble-Count"].alias("h_bubbles"), F.col("headers")["X-Duration-MS"].alias("h_ms"), F.col("headers")["X-Format"].alias("h_format"))


LINES_SQL = f"""{BUBBLE_BOX_SQL}, dlg AS (SELECT b.* FROM bubbles b JOIN scored s USING (chapter_id, panel_id, reading_order) WHERE s.score >= 0.60::DOUBLE), {continuation_sql('dlg')},
spoken AS (SELECT chapter_id, bubble_idx, {sql.normalize('text')} AS text FROM merged WHERE {sql.strip('text')} <> '' AND {sql.normalize('text')} <> '')"""
STATUS_SQL = f"""{LINES_SQL}, n AS (SELECT p.chapter_id, count(*) AS n_images, any_value((SELECT count(*) FROM words w WHERE w.chapter_id = p.chapter_id)) AS n_words,
  any_value((SELECT count(*) FROM dlg d WHERE d.chapter_id = p.chapter_id)) AS n_bubbles, any_value((SELECT count(*) FROM spoken s WHERE s.chapter_id = p.chapter_id)) AS n_texts FROM panels p GROUP BY p.chapter_id),
e AS (SELECT *, CASE WHEN n_images > 150 THEN 'too many images' WHEN n_bubbles = 0 THEN 'no bubbles' WHEN n_texts = 0 THEN 'no text after preprocessing' END AS error FROM n)
SELECT chapter_id, n_images, n_words, n_bubbles, n_texts, CASE WHEN error IS NULL THEN 200 ELSE 400 END AS status, error FROM e"""


@query("pipe_chapter_lines", f"{LINES_SQL} SELECT chapter_id, bubble_idx, text FROM spoken")
def pipe(spark, sf_dir):
    w, p = words_and_panels(spark, sf_dir)
    return chapter.lines(w, p)


@query("pipe_chapter_status", STATUS_SQL)
def pipe_status(spark, sf_dir):
    w, p = words_and_panels(spark, sf_dir)
    d = checkpointed(chapter.dialogue_bubbles(w, p))
    merged = continuation.merge(d, p)
    spoken = merged.select("chapter_id", txt.for_speech(F.col("text")).alias("text")).where(F.col("text") != "")
    return chapter.status(p, w, d, spoken)


@query("pipe_chapter_audio")
def pipe_audio(spark, sf_dir):
    """Pages of text, read by the stub, to audio; the stub's pages have no header, so sizes are given."""
    pages = pages_of(spark, sf_dir)
    sizes = pages.select("chapter_id", "panel_id", F.lit(4000).alias("width"), F.lit(1000).alias("height"))
    out = chapter.process(pages, ocr.StubOcr(), audio.StubSpeech(), audio.WavCodec(), "wav", sizes=sizes)
    return out.withColumn("bytes", F.length("audio").cast("long")).drop("audio")


@query("src5_retry_pauses", "WITH RECURSIVE r(attempt, pause, ends) AS (SELECT 1, 1.0::DOUBLE, 1.0::DOUBLE UNION ALL SELECT attempt + 1, least(2 * pause, 10), ends + least(2 * pause, 10) FROM r WHERE ends + least(2 * pause, 10) <= 60) SELECT * FROM r")
def src5(spark, sf_dir):
    """What a call that always fails waits before each new try."""
    pauses, now = [], [0.0]

    def sleep(s):
        now[0] += s
        pauses.append((len(pauses) + 1, float(s), now[0]))

    def fail():
        raise ocr.TransientError

    try:
        ocr.with_retry(fail, sleep=sleep, clock=lambda: now[0])
    except ocr.TransientError:
        return spark.createDataFrame(pauses, "attempt int, pause double, ends double")


SETTINGS = {"nothing": {}, "no such file": {"ocr_credentials": "/no/such/file"}, "a file": {"ocr_credentials": __file__}, "key only": {"tts_key": "k"}, "key and voice": {"tts_key": "k", "tts_voice": "v"}}


@query("src7_settings", "SELECT * FROM (VALUES ('nothing', false, false), ('no such file', false, false), ('a file', true, false), ('key only', false, false), ('key and voice', false, true)) AS v(settings, ocr_configured, tts_configured)")
def src7(spark, sf_dir):
    rows = [(k, Params(**v).ocr_configured, Params(**v).tts_configured) for k, v in SETTINGS.items()]
    return spark.createDataFrame(rows, "settings string, ocr_configured boolean, tts_configured boolean")


@query("api1_health", "SELECT 'healthy' AS status, false AS ocr_configured, false AS tts_configured")
def api1(spark, sf_dir):
    return spark.createDataFrame([("healthy", DEFAULTS.ocr_configured, DEFAULTS.tts_configured)], "status string, ocr_configured boolean, tts_configured boolean")


@query("snk2_audio_files", f"{AUD_SQL} SELECT chapter_id, 'wav' AS format, duration_ms, 44 + 16 * duration_ms AS bytes FROM au")
def snk2(spark, sf_dir):
    """One file a chapter in the shared folder, which is a mounted one in this query."""
    folder = shared_folder(spark).removeprefix("file:")
    path = f"{folder}/audio-{uuid.uuid4().hex}/{{chapter_id}}.wav"
    return audio.stitch_to_files(audio.clips(spoken_texts(spark, sf_dir), audio.StubSpeech()), audio.WavCodec(), path).drop("file")


@query("tts2_parallel_batch", f"WITH {SPOKEN_SQL} SELECT chapter_id, count(*) AS clips, CAST(sum(reading_order) AS BIGINT) AS orders FROM cl GROUP BY chapter_id")
def tts2(spark, sf_dir):
    c = audio.clips(spoken_texts(spark, sf_dir), audio.StubSpeech(), p=Params(tts_parallel=8))
    return c.groupBy("chapter_id").agg(F.count("*").alias("clips"), F.sum("reading_order").alias("orders"))


@query("tts4_one_at_a_time", f"WITH {SPOKEN_SQL} SELECT chapter_id, reading_order, text, 'stub' AS voice_id FROM cl")
def tts4(spark, sf_dir):
    return audio.clips(spoken_texts(spark, sf_dir), audio.StubSpeech(), p=Params(tts_parallel=1)).select("chapter_id", "reading_order", "text", "voice_id")


class NotBytes(audio.StubSpeech):
    def speak(self, text, voice):
        return 5


@query("tts5_not_bytes", f"WITH {SPOKEN_SQL} SELECT chapter_id, reading_order, 'TypeError: audio must be bytes, not int' AS error FROM sp")
def tts5(spark, sf_dir):
    return audio.clips(spoken_texts(spark, sf_dir), NotBytes(), keep_errors=True).select("chapter_id", "reading_order", "error")


@query("aud4_timeout", "SELECT 'encoder that hangs' AS codec, 'AudioStitchingTimeoutError' AS error")
def aud4(spark, sf_dir):
    slow = audio.EncoderCodec("wav", ["cat"], ["sleep", "20"], timeout_s=0.2)
    try:
        slow.join([audio.WavCodec.silence(10)], 5)
    except audio.AudioStitchingTimeoutError as e:
        return spark.createDataFrame([("encoder that hangs", type(e).__name__)], "codec string, error string")


@query(
    "pipe_dialogue_by_chapter",
    f"{BUBBLE_BOX_SQL} SELECT chapter_id, count(*) AS bubbles, count(*) FILTER (WHERE score >= 0.60::DOUBLE) AS dialogue, CAST(sum(CASE WHEN score >= 0.60::DOUBLE THEN n_words ELSE 0 END) AS BIGINT) AS words_in_dialogue FROM scored GROUP BY chapter_id",
)
def flagship(spark, sf_dir):
    w, p = words_and_panels(spark, sf_dir)
    return chapter.dialogue_by_chapter(w, p)
