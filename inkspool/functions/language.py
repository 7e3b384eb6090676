"""Language features of a text as Catalyst expressions (LNG1 to LNG7)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import lexicon
from .text import fold, let, rx, strip, sub, tokens


def ratio(a: Column, b: Column, empty: float = 0.0) -> Column:
    return F.when(b > 0, a.cast("double") / b).otherwise(F.lit(empty))


def _table(scores: dict[str, float]) -> Column:
    return F.create_map(*[F.lit(x) for k, v in scores.items() for x in (k, v)])


def _mean(scores: Column, n: Column, empty: float) -> Column:
    total = F.aggregate(scores, F.lit(0.0), lambda a, x: a + x)
    return F.when(n > 0, total / n).otherwise(F.lit(empty))


def dictionary_ratio(text: Column, token_list: Column | None = None) -> Column:
    """LNG1: share of tokens in the dictionary."""
    known = sorted(lexicon.DICTIONARY)
    return let(tokens(text) if token_list is None else token_list, lambda t: ratio(F.size(F.filter(t, lambda w: w.isin(*known))), F.size(t)))


def alphabet_ratio(text: Column) -> Column:
    """LNG2: share of letters among characters other than the space."""
    shown = F.length(F.replace(text, F.lit(" "), F.lit("")))
    return ratio(F.length(sub(text, r"[^\p{L}]+", "")), shown)


def word_frequency(text: Column, token_list: Column | None = None) -> Column:
    """LNG3: mean score of the tokens."""
    table, known = _table(lexicon.WORD_SCORES), sorted(lexicon.WORD_SCORES)

    def score(w: Column) -> Column:
        return F.when(w.isin(*known), F.try_element_at(table, w)).otherwise(F.lit(lexicon.UNKNOWN_WORD))

    return let(tokens(text) if token_list is None else token_list, lambda t: _mean(F.transform(t, score), F.size(t), lexicon.UNKNOWN_WORD))


def _trigram_pattern() -> str:
    """Lookahead for the scored trigrams, branching on their first letter."""
    by_first: dict[str, list[str]] = {}
    for t in sorted(lexicon.TRIGRAM_SCORES):
        by_first.setdefault(t[0], []).append(t[1:])
    return "(?=(" + "|".join(f"{c}(?:{'|'.join(rest)})" for c, rest in by_first.items()) + "))"


def trigram_score(text: Column) -> Column:
    """LNG4: mean score of the trigrams of the letters a to z.

    One pass of a lookahead finds the scored trigrams; all others count the
    same, so positions are never cut out one by one.
    """
    table, pattern = _table(lexicon.TRIGRAM_SCORES), F.lit(_trigram_pattern())

    def score(s: Column, hits: Column) -> Column:
        n = F.length(s) - 2
        total = F.aggregate(hits, F.lit(0.0), lambda a, t: a + F.try_element_at(table, t))
        return F.when(n > 0, (total + (n - F.size(hits)) * lexicon.UNKNOWN_TRIGRAM) / n).otherwise(F.lit(lexicon.UNKNOWN_TRIGRAM))

    return let(sub(F.lower(text), "[^a-z]+", ""), lambda s: let(F.regexp_extract_all(s, pattern, 1), lambda hits: score(s, hits)))


def ocr_noise(text: Column) -> Column:
    """LNG5: 0 for clean text to 1 for noise. A run counts three characters, however long it is."""

    def noise(shown: Column, runs: Column, letters: Column, both: Column) -> Column:
        n = F.length(shown)
        symbols, alpha = ratio(n - both, n), ratio(letters, n)
        return (
            F.when(runs > 0, F.least(F.lit(1.0), runs * 3.0 / F.length(text)) * 0.4).otherwise(0.0)
            + F.when(symbols > 0.4, (symbols - 0.4) * 0.5).otherwise(0.0)
            + F.when(alpha < 0.3, (0.3 - alpha) * 0.3).otherwise(0.0)
            + F.when((F.size(F.array_distinct(F.split(shown, ""))) <= 2) & (F.length(strip(text)) > 2), 0.5).otherwise(0.0)
            + F.when((n > 0) & (both == 0), 0.6).otherwise(0.0)
        )

    parts = F.struct(
        F.replace(text, F.lit(" "), F.lit("")).alias("shown"),
        F.size(F.regexp_extract_all(text, F.lit(rx(r"(.)\1{2,}")), 0)).alias("runs"),
        F.length(sub(text, r"[^\p{L}]+", "")).alias("letters"),
        F.length(sub(text, r"[^\p{L}\p{N}]+", "")).alias("both"),
    )
    score = let(parts, lambda x: F.least(F.lit(1.0), noise(x["shown"], x["runs"], x["letters"], x["both"])))
    return F.when(text.isNull(), F.lit(None)).when(strip(text) == "", 1.0).otherwise(score)


def punctuation_count(text: Column) -> Column:
    return F.length(text) - F.length(F.translate(text, ".,!?;:-—…", ""))


def extract(text: Column, area_ratio: Column | None = None, aspect: Column | None = None, density: Column | None = None, token_list: Column | None = None) -> Column:
    """LNG6: struct of the ten raw features; without a box its three features have defaults."""
    t = tokens(text) if token_list is None else token_list
    return F.struct(
        F.coalesce(area_ratio, F.lit(0.5)).alias("bbox_area") if area_ratio is not None else F.lit(0.5).alias("bbox_area"),
        (aspect if aspect is not None else F.lit(3.0)).alias("aspect_ratio"),
        (density if density is not None else F.lit(0.001)).alias("text_density"),
        F.size(t).cast("double").alias("word_count"),
        punctuation_count(text).cast("double").alias("punctuation_count"),
        dictionary_ratio(text, t).alias("dictionary_ratio"),
        alphabet_ratio(text).alias("alphabet_ratio"),
        word_frequency(text, t).alias("word_frequency_score"),
        trigram_score(text).alias("trigram_language_score"),
        ocr_noise(text).alias("ocr_noise_score"),
    )


def short_dialogue(text: Column) -> tuple[Column, Column]:
    """LNG7: (is a known exclamation, calls out with ! ? or ...), both only for at most two tokens."""
    few = F.size(tokens(text)) <= 2
    known = sub(fold(text), r"[^a-z]", "").isin(*sorted(lexicon.SHORT_DIALOGUE))
    loud = text.contains("!") | text.contains("?") | text.contains("...")
    return few & known, few & loud


def boosted(text: Column, f: Column, frequency: str = "word_frequency_score", punctuation: str = "punctuation_count") -> Column:
    """LNG7 on a feature struct."""
    known, loud = short_dialogue(text)
    f = f.withField("word_count", F.when(known, F.greatest(f["word_count"], F.lit(3.0))).otherwise(f["word_count"]))
    f = f.withField("dictionary_ratio", F.when(known, F.lit(1.0)).otherwise(f["dictionary_ratio"]))
    f = f.withField(frequency, F.when(known, F.greatest(f[frequency], F.lit(2.5))).otherwise(f[frequency]))
    return f.withField(punctuation, F.when(loud, F.greatest(f[punctuation], F.lit(2.0))).otherwise(f[punctuation]))
