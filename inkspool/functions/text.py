"""Text normalisation as Catalyst expressions (TXT1 to TXT13); null stays null.

Patterns carry (?Ud): Unicode classes, and only LF ends a line, as in engines
whose strings are Unicode throughout. Patterns with something before them begin
with the rarer character and look back from behind it, so that most positions
fail on the first test.

Long chains of patterns are not run over a whole text: ``piecewise`` takes out
the runs of plain words first, which no rule changes, and puts them back.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Spoken form of symbols, in the order in which they are replaced.
SPOKEN = (("&", "and"), ("%", "percent"), ("@", "at"), ("#", "number"), ("$", "dollar"), ("+", "plus"), ("=", "equals"))


def rx(pattern: str) -> str:
    return "(?Ud)" + pattern


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often ``body`` uses it."""
    return F.transform(F.array(value), body)[0]


def sub(text: Column, pattern: str, by: str) -> Column:
    return F.regexp_replace(text, F.lit(rx(pattern)), F.lit(by))


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends (Spark's trim takes spaces only)."""
    return sub(text, r"^\s+|\s+$", "")


#: Stands for a run of plain words while the rest is worked on: neither a word character nor white space, in no pattern, and ASCII, as the JVM is slower with other texts.
MARK = "\x01"
#: Latin letters, the frequent ones first.
_LETTER = "[a-z[A-ZÀ-ÖØ-öø-ſ]]"
#: Words with few punctuation marks and one space or line end before the next. Possessive, so that a long run takes no stack.
PLAIN = rf"(?<=[a-zA-Z] )(?:{_LETTER}[a-z]*+(?:[A-ZÀ-ÖØ-öø-ſ'][a-z]*+)*+[.,;:]?+[!?]?+[!?]?+[ \n](?={_LETTER}))++"


def piecewise(text: Column, rules, plain) -> Column:
    """``rules(text)``, worked out without the runs of plain words (PLAIN).

    Every run has an ASCII letter and one space before it and a letter behind,
    and no rule of this module removes or adds either or matches across them;
    so what is left, with a mark for each run, becomes what it would become in
    the whole text. ``plain`` is what the rules do to a run itself, by itself. A
    text that has the mark already is worked on whole.
    """

    def worked(x: Column) -> Column:
        rest = F.array_join(F.filter(x["parts"], lambda _, i: i % 2 == 0), MARK)
        return F.struct(x["marked"].alias("marked"), rules(rest).alias("rest"), F.filter(x["parts"], lambda _, i: i % 2 == 1).alias("runs"))

    def joined(x: Column) -> Column:
        both = F.zip_with(F.split(x["rest"], MARK), x["runs"], lambda a, b: F.concat(a, F.coalesce(plain(b), F.lit(""))))
        return F.when(x["marked"], x["rest"]).otherwise(F.array_join(both, ""))

    def cut(t: Column) -> Column:
        parts = F.split(F.regexp_replace(t, F.lit(PLAIN), F.lit(f"{MARK}$0{MARK}")), MARK)
        return F.struct(t.contains(MARK).alias("marked"), F.when(t.contains(MARK), F.array(t)).otherwise(parts).alias("parts"))

    return let(text, lambda t: let(let(cut(t), worked), joined))


def one_line(run: Column) -> Column:
    """What TXT1 and TXT5 do to plain words: a line end is a space."""
    return F.replace(run, F.lit("\n"), F.lit(" "))


def having(text: Column, signs, body) -> Column:
    """``body`` of a text with one of the signs, without which it would change nothing."""
    return let(text, lambda t: F.when(reduce(or_, [t.contains(s) for s in signs]), body(t)).otherwise(t))


def normalize(text: Column) -> Column:
    """TXT1: pauses, noise, symbols and dashes for speech."""
    return piecewise(text, _normalize, one_line)


def _normalize(text: Column) -> Column:
    t = having(text, ["..."], lambda t: sub(t, r"\.{3,}", " "))
    t = F.replace(t, F.lit("…"), F.lit(" "))
    t = having(t, ["."], lambda t: sub(t, r"\.(?<=[a-zA-Z]\.)\.?(?=[a-zA-Z])", " "))
    t = having(t, ["!!!", "???"], lambda t: sub(t, r"([!?])\1{2,}", "$1"))
    t = having(t, "~`{}[]|\\", lambda t: sub(sub(t, r"[~`{}\[\]|\\](?<=[a-zA-Z].)[~`{}\[\]|\\]*(?=[a-zA-Z])", " "), r"[~`{}\[\]|\\]", ""))
    for symbol, word in SPOKEN:
        t = F.replace(t, F.lit(symbol), F.lit(f" {word} "))
    t = having(t, ["-"], lambda t: sub(sub(t, r"\s+-\s+", " "), r"-(?<=[a-zA-Z]-)-+(?=[a-zA-Z])", " "))
    t = strip(sub(t, r"\s+", " "))
    t = sub(t, r"\s+([!?.,;:])", "$1")
    t = sub(t, r"([.!?])([A-Z])", "$1 $2")
    return having(t, ["*"], lambda t: sub(t, r"\*+", " "))


def clean_artifacts(text: Column) -> Column:
    """TXT2: lone symbols and dashes between words."""
    t = sub(text, r"\s+[^\w\sIAia!?.,;:—-]\s+", " ")
    t = strip(sub(t, r"\s{2,}", " "))
    return having(t, "–—", lambda t: sub(t, r"\s+[–—]\s+", " "))


def fix_ocr_errors(text: Column) -> Column:
    """TXT3: digits read for letters, and numbers stuck before a word."""

    def letters(t: Column, digit: str, upper: str, lower: str) -> Column:
        return sub(sub(t, f"{digit}(?<=[A-Z]{digit})(?=[A-Z])", upper), f"{digit}(?<=[a-z]{digit})(?=[a-z])", lower)

    for digit, upper, lower in (("0", "O", "o"), ("1", "I", "l")):
        text = having(text, [digit], lambda t, x=(digit, upper, lower): letters(t, *x))
    return sub(text, r"\d(?<=\b\d)\d*(?=[a-zA-Z])", "")


def limit_repeats(text: Column, most: int = 2) -> Column:
    """TXT4: runs of one character are cut to ``most``."""
    return sub(text, rf"(.)\1{{{most},}}", "$1" * most)


def fix_corruptions(text: Column) -> Column:
    """TXT5: digits and symbols merged into words."""
    t = sub(text, r"\d(?<=\b\d)\d*(?=[a-zA-Z])", "")
    t = sub(t, r"\d(?<=[a-zA-Z]\d)\d*\b", "")
    t = sub(t, r"\d(?<=[a-zA-Z]\d)\d*(?=[a-zA-Z])", "")
    t = sub(t, r"^[^a-zA-Z]+(?=[a-zA-Z])", "")
    return strip(sub(t, r"\s+", " "))


def for_classification(text: Column) -> Column:
    """TXT6: lower case, then TXT2, TXT3, TXT1, TXT4, TXT5."""
    return piecewise(F.lower(text), lambda t: fix_corruptions(limit_repeats(_normalize(fix_ocr_errors(clean_artifacts(t))))), lambda run: limit_repeats(one_line(run)))


def for_speech(text: Column) -> Column:
    """TXT7, TXT10: a blank text gives '', any other TXT1."""
    return F.when(text.isNull(), F.lit(None)).when(~text.rlike(rx(r"\S")), F.lit("")).otherwise(normalize(text))


def preprocess(text: Column, for_classifier: bool = True) -> Column:
    """TXT8, TXT9: either preparation, over a whole column."""
    return for_classification(text) if for_classifier else for_speech(text)


def fold(text: Column) -> Column:
    """TXT12: lower case, single spaces."""
    return sub(strip(F.lower(text)), r"\s+", " ")


def words(text: Column) -> Column:
    """Parts between white space."""
    return F.filter(F.split(text, rx(r"\s+")), lambda w: w != "")


def tokens(text: Column) -> Column:
    """TXT13: lower-case words without apostrophes; other symbols but hyphens separate."""
    t = F.replace(F.lower(text), F.lit("'"), F.lit(""))
    return words(sub(t, r"[^\w\s-]", " "))
