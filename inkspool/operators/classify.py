"""Dialogue or background: the bubble classifier (CLS1-6) and the text classifier (CLS7-10)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import lexicon
from ..functions import geometry as g
from ..functions import language as lng
from ..functions.text import for_classification, rx, strip, tokens, words
from ..params import BOX_WEIGHTS, DEFAULTS, TEXT_WEIGHTS, Params


def computed(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that are computed once a row.

    They pass through a generator, so that neither a later filter nor a later
    projection is merged into them, which would repeat costly expressions for
    each use.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(k) for k, c in columns.items()]))))


def bands(value: Column, steps: list[tuple[Column, Column | float]], other: Column | float) -> Column:
    """First matching band wins."""
    out = None
    for cond, score in steps:
        score = score if isinstance(score, Column) else F.lit(float(score))
        out = F.when(cond, score) if out is None else out.when(cond, score)
    return out.otherwise(other if isinstance(other, Column) else F.lit(float(other)))


def contains_any(text: Column, parts) -> Column:
    """Substring test, not by word: "feedback" contains "back"."""
    return reduce(lambda a, b: a | b, [text.contains(x) for x in parts])


def is_timestamp(text: Column) -> Column:
    return text.rlike(rx(r"^\d{1,2}\s*:\s*\d{2}(/\d{1,2}\s*:\s*\d{2})?$"))


def non_ascii_share(text: Column) -> Column:
    shown = F.replace(text, F.lit(" "), F.lit(""))
    return lng.ratio(F.length(F.regexp_replace(text, r"[\x00-\x7F]", "")), F.length(shown))


def _of_text(df: DataFrame, text: str) -> DataFrame:
    """Adds what CLS1 and LNG7 need to know of a text without its box.

    The cleaned text and its tokens are columns of their own, so that no
    feature computes them again.
    """
    s, p, tok, t = F.col("__t"), F.col("__p"), F.col("__tok"), F.col(text)
    df = computed(df, __t=strip(t))
    df = computed(df, __p=for_classification(s))
    df = computed(df, __tok=tokens(p))
    return computed(
        df, __stamp=is_timestamp(s), __n=F.size(words(s)),
        __dict=lng.dictionary_ratio(p, tok), __alpha=lng.alphabet_ratio(p), __freq=lng.word_frequency(p, tok), __tri=lng.trigram_score(p), __noise=lng.ocr_noise(p),
        __foreign=non_ascii_share(s) > 0.5, __ends=F.coalesce(F.right(s, F.lit(1)).isin(".", "!", "?", "…"), F.lit(False)), __any=s.rlike(r"[.!?,;:—\-~]"), __ui=contains_any(F.lower(s), lexicon.UI_WORDS), __warn=contains_any(F.lower(s), lexicon.WARNING_WORDS),
        __short=F.array(F.size(words(t)) <= 2, *lng.short_dialogue(t)),
    ).drop("__p", "__tok")


def with_box_features(df: DataFrame, image_area: Column, text: str = "text", box: g.Box | None = None, texts: DataFrame | None = None) -> DataFrame:
    """CLS1: adds ``features``, the ten scores (null for a time stamp but for five zeros) and the raw values.

    ``texts`` is for texts that repeat, such as single words: a table whose
    column ``text`` has all of them, in any number. Each is then judged once,
    and rows are joined to what was found.
    """
    return _box_features(df, image_area, text, box, texts).drop("__short")


def _box_features(df: DataFrame, image_area: Column, text: str, box: g.Box | None, texts: DataFrame | None) -> DataFrame:
    box = box or g.Box.of()
    s = F.col("__t")
    if texts is None:
        df = _of_text(df, text)
    else:
        known = _of_text(texts.select(F.col(text).alias("__key")).distinct(), "__key")
        df = df.join(known, F.col(text).eqNullSafe(F.col("__key")), "left").drop("__key")
    df = computed(df, __area=g.area_ratio(box, image_area), __dens=g.text_density(s, box), __asp=g.aspect_ratio(box))
    a, n, d, r = (F.col(c) for c in ("__area", "__n", "__dens", "__asp"))
    dic, alp, fre = F.col("__dict"), F.col("__alpha"), F.col("__freq") / 5.0
    ui, foreign, ends = F.col("__ui"), F.col("__foreign"), F.col("__ends")
    zero = F.lit(0.0)
    scores = {
        "bbox_area": bands(a, [(F.col("__warn") & (a > 0.06), 0.9), (a < 0.003, 0.2), (a < 0.008, 0.6), (a <= 0.06, 1.0), (a <= 0.13, 0.6)], 0.4),
        "word_count": bands(n, [(ui & (n == 1), 0.0), (ui & (n == 2), 0.1), (ui, 0.3), (n == 1, 0.5), (n == 2, 0.6), (n <= 5, 0.75), (n <= 15, 1.0), (n <= 30, 0.9)], 0.8),
        "text_density": bands(d, [(d < 0.0005, 0.6), (d <= 0.0015, 1.0), (d <= 0.005, 0.5), (d <= 0.02, 0.3)], 0.0),
        "aspect_ratio": bands(r, [(r.between(2.0, 5.0), 1.0), ((r >= 1.0) & (r < 6.0), 0.7), ((r > 6.0) & (r <= 8.0), 0.5)], 0.3),
        "punctuation": bands(s, [(ends, 1.0), (foreign, 0.0), (F.col("__any"), 0.6)], 0.2),
        "dictionary_ratio": bands(dic, [(foreign, 0.0), (dic >= 0.8, 1.0), (dic >= 0.5, 0.7), (dic >= 0.3, 0.4)], dic * 0.3),
        "alphabet_ratio": bands(alp, [(foreign, 0.0), (alp >= 0.7, 1.0), (alp >= 0.5, 0.8), (alp >= 0.3, 0.5)], alp),
        "word_frequency": bands(fre, [(foreign, 0.0), (fre >= 0.6, 1.0), (fre >= 0.4, 0.8)], fre),
        "trigram_score": F.when(foreign, zero).otherwise(F.col("__tri") / 5.0),
        "ocr_noise": 1.0 - F.col("__noise"),
    }
    spatial = ("bbox_area", "word_count", "text_density", "aspect_ratio", "punctuation")
    stamp = F.col("__stamp")
    fields = [F.when(stamp, zero if k in spatial else F.lit(None)).otherwise(v).alias(k) for k, v in scores.items()]
    raw = {"raw_bbox_area": a, "raw_word_count": n, "raw_density": d, "raw_aspect_ratio": r, "raw_has_punctuation": ends, "raw_has_any_punct": F.col("__any")}
    for k, v in raw.items():
        none = F.lit(False) if k.startswith("raw_has") else F.lit(0).cast("int") if k == "raw_word_count" else zero
        fields.append(F.when(stamp, none).otherwise(v).alias(k))
    late = {"raw_dict_ratio": dic, "raw_alpha_ratio": alp, "raw_freq_score": F.col("__freq"), "raw_trigram": F.col("__tri"), "raw_noise": F.col("__noise")}
    fields += [F.when(~stamp, v).alias(k) for k, v in late.items()]
    fields.append(stamp.alias("is_timestamp"))
    return computed(df, features=F.struct(*fields)).drop("__t", "__stamp", "__n", "__area", "__dens", "__asp", "__dict", "__alpha", "__freq", "__tri", "__noise", "__foreign", "__ends", "__any", "__ui", "__warn")


def weighted(features: Column, weights: dict[str, float]) -> Column:
    """CLS2, CLS8: sum of weight times feature in the order of the weights; an absent feature counts 0."""
    return reduce(lambda a, b: a + b, [F.lit(w) * F.coalesce(features[k], F.lit(0.0)) for k, w in weights.items()])


def score_boxes(df: DataFrame, image_area: Column, p: Params = DEFAULTS, text: str = "text", texts: DataFrame | None = None) -> DataFrame:
    """CLS4: adds features, score and is_text_box. Texts of at most two words get their boosts (LNG7). ``texts`` as in CLS1."""
    df = _box_features(df, image_area, text, None, texts)
    f = F.col("features")
    short, known, loud = (F.col("__short")[i] for i in range(3))
    f2 = f.withField("word_count", F.when(short & known, F.greatest(f["word_count"], F.lit(3.0))).otherwise(f["word_count"]))
    f2 = f2.withField("dictionary_ratio", F.when(short & known, F.lit(1.0)).otherwise(f["dictionary_ratio"]))
    f2 = f2.withField("word_frequency", F.when(short & known, F.greatest(F.coalesce(f["word_frequency"], F.lit(0.0)), F.lit(2.5))).otherwise(f["word_frequency"]))
    f2 = f2.withField("punctuation", F.when(short & loud, F.greatest(f["punctuation"], F.lit(2.0))).otherwise(f["punctuation"]))
    df = computed(df.withColumn("__f2", f2).drop("features"), features=F.col("__f2")).drop("__short", "__f2")
    df = df.withColumn("score", weighted(F.col("features"), {k: p.box_weights[k] for k in BOX_WEIGHTS}))
    return df.withColumn("is_text_box", F.col("score") >= p.box_threshold)


def filter_boxes(df: DataFrame, image_area: Column, p: Params = DEFAULTS, text: str = "text", texts: DataFrame | None = None) -> DataFrame:
    """CLS5, CLS6: rows (words or bubbles) that are dialogue, with their columns."""
    return score_boxes(df, image_area, p, text, texts).where("is_text_box").select(*df.columns)


def normalized_text_features(f: Column) -> Column:
    """CLS7: the raw features of LNG6 on a scale to 1."""
    a, r, d, n = f["bbox_area"], f["aspect_ratio"], f["text_density"], f["word_count"]
    dic, alp, fre = f["dictionary_ratio"], f["alphabet_ratio"], f["word_frequency_score"] / 5.0
    return F.struct(
        bands(a, [(a.between(0.01, 0.05), 1.0), (a.between(0.005, 0.10), 0.7), (a < 0.005, 0.3)], 0.2).alias("bbox_area"),
        bands(r, [(r.between(2.0, 5.0), 1.0), (r.between(1.0, 7.0), 0.7)], 0.3).alias("aspect_ratio"),
        bands(d, [(d.between(0.0005, 0.002), 1.0), (d.between(0.0002, 0.005), 0.7), (d > 0.01, 0.2)], 0.5).alias("text_density"),
        bands(n, [(n == 0, 0.0), (n == 1, 0.4), (n == 2, 0.6), (n >= 3, F.least(F.lit(1.0), 0.7 + (n - 3) * 0.1))], 0.5).alias("word_count"),
        bands(n, [(f["punctuation_count"] >= 1, 1.0)], 0.3).alias("punctuation_count"),
        bands(dic, [(dic >= 0.8, 1.0), (dic >= 0.5, 0.7), (dic >= 0.3, 0.4)], dic * 0.3).alias("dictionary_ratio"),
        bands(alp, [(alp >= 0.7, 1.0), (alp >= 0.5, 0.8), (alp >= 0.3, 0.5)], alp).alias("alphabet_ratio"),
        bands(fre, [(fre >= 0.6, 1.0), (fre >= 0.4, 0.8)], fre).alias("word_frequency_score"),
        (f["trigram_language_score"] / 5.0).alias("trigram_language_score"),
        (1.0 - f["ocr_noise_score"]).alias("ocr_noise_score"),
    )


def text_score(norm: Column, p: Params = DEFAULTS) -> Column:
    """CLS8: weighted sum; a missing feature counts half its weight."""
    return reduce(lambda a, b: a + b, [F.lit(p.text_weights[k]) * F.coalesce(norm[k], F.lit(0.5)) for k in TEXT_WEIGHTS])


def classify_texts(df: DataFrame, p: Params = DEFAULTS, text: str = "text") -> DataFrame:
    """CLS10: adds raw features, score and label (dialogue or background) of plain texts."""
    df = computed(df, __tok=tokens(F.col(text)))
    df = computed(df, features=lng.extract(F.col(text), token_list=F.col("__tok"))).drop("__tok")
    df = computed(df, norm=normalized_text_features(F.col("features")))
    df = computed(df, score=text_score(F.col("norm"), p))
    return df.withColumn("label", F.when(F.col("score") >= p.text_threshold, "dialogue").otherwise("background"))


def review_band(score: Column) -> Column:
    """CLS11 (extension): sure dialogue from .70, background under .45, review between."""
    return F.when(score >= 0.70, "dialogue").when(score < 0.45, "background").otherwise("review")
