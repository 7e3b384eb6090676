import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from inkspool.functions import language as lng
from inkspool.functions import text as txt


def apply(spark, fn, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r[0] for r in df.select("i", fn(F.col("t")).alias("o")).orderBy("i").select("o").collect()]


CASES = {
    txt.normalize: [("HELLO....THERE", "HELLO THERE"), ("WHAT?!?!", "WHAT?!?!"), ("NO!!!", "NO!"), ("NO!!", "NO!!"), ("5&5", "5 and 5"), ("End.Start", "End Start"), ("***", " "), ("He||o W0rld", "He o W0rld"), (None, None)],
    txt.for_speech: [("MEET ME @ 3PM", "MEET ME at 3PM"), (" \t", ""), (None, None)],
    txt.for_classification: [("HEll0.... | THERE!!!", "hell there!"), ("06suchan", "suchan"), ("-------", "--"), ("|||||||", ""), ("...", ""), ("!!!", "!"), ("안녕 HELLO!", "hello!"), ("####***@@@", "number number number number at at at")],
    txt.limit_repeats: [("HELLLLLO", "HELLO"), ("GOOOD", "GOOD"), ("a\n\n\n\nb", "a\n\n\n\nb")],
}


@pytest.mark.parametrize("fn", CASES, ids=lambda f: f.__name__)
def test_cases(spark, fn):
    assert apply(spark, fn, [a for a, _ in CASES[fn]]) == [b for _, b in CASES[fn]]


def model_noise(t):
    if not t or not t.strip():
        return 1.0
    shown = t.replace(" ", "")
    runs = len(re.findall(r"(.)\1{2,}", t))
    s = 0.4 * min(1, 3 * runs / len(t)) if runs else 0.0
    sym = sum(not c.isalnum() for c in shown) / len(shown)
    s += (sym - 0.4) * 0.5 if sym > 0.4 else 0
    alpha = sum(c.isalpha() for c in shown) / len(shown)
    s += (0.3 - alpha) * 0.3 if alpha < 0.3 else 0
    s += 0.5 if len(set(shown)) <= 2 and len(t.strip()) > 2 else 0
    s += 0.6 if not any(c.isalnum() for c in shown) else 0
    return min(1.0, s)


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text("ab !?#|.1-", max_size=25), min_size=30, max_size=60))
def test_noise_like_the_model(spark, values):
    got = apply(spark, lng.ocr_noise, values)
    assert got == pytest.approx([model_noise(v) for v in values])


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text("etharn ing'T-", max_size=40), min_size=30, max_size=60))
def test_trigrams_like_the_model(spark, values):
    from inkspool import lexicon

    def model(t):
        s = re.sub("[^a-z]", "", t.lower())
        g = [lexicon.TRIGRAM_SCORES.get(s[i : i + 3], 0.3) for i in range(len(s) - 2)]
        return sum(g) / len(g) if g else 0.3

    assert apply(spark, lng.trigram_score, values) == pytest.approx([model(v) for v in values])


def test_dictionary_and_short_dialogue(spark):
    assert apply(spark, lng.dictionary_ratio, ["Hello there friend", "I don't think we're ready yet", ""]) == pytest.approx([1 / 3, 4 / 6, 0.0])
    known = apply(spark, lambda t: lng.short_dialogue(t)[0], ["NO", "OH NO", "Stop!", "garden"])
    assert known == [True, False, True, False]
    assert apply(spark, lng.ocr_noise, ["|||||||", "-------", "HELLO THERE"])[0] == 1.0


def test_rules_on_pieces_equal_rules_on_the_whole(spark):
    import random

    rng = random.Random(5)
    plain = ["the", "a", "word", "über", "él", "É", "don't", "sooo", "aaab", "IT!!", "so?!", "end.", "one,", "Zz", "I", "İs", "σΣ"]
    odd = ["x9", "9x", "h1S", "A0B", "***", "*", "&", "%%%", "|", "-", "--", "a--b", "—", "…", "...", "a..b", "a.b", "!!!!", ".!!", ".A", "'", "'" * 4, "[x]", "~", "5", "안녕", "\u0301", "\x01", "^", "+"]
    gaps = [" "] * 12 + ["\n", "  ", "\n\n", "\t", "\u00a0", "", " \n"]
    texts = ["".join(rng.choice(plain if rng.random() < share else odd) + rng.choice(gaps) for _ in range(rng.randrange(1, 30))) for share in (0.5, 0.8, 0.95) for _ in range(3000)]
    texts += ["", " ", "\n", "the word " * 100_000, None]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    c = F.col("text")
    whole = txt.fix_corruptions(txt.limit_repeats(txt._normalize(txt.fix_ocr_errors(txt.clean_artifacts(F.lower(c))))))
    bad = df.where(~txt.normalize(c).eqNullSafe(txt._normalize(c)) | ~txt.for_classification(c).eqNullSafe(whole)).collect()
    assert not bad


def test_rules_see_no_plain_words(spark):
    text = "It is said: plain words,\nand so on, take no time but ab12 does, and so do the last."
    got = spark.range(1).select(txt.piecewise(F.lit(text), F.upper, txt.one_line)).first()[0]
    assert got == "IT is said: plain words, and so on, take no time but AB12 DOES, AND so do the LAST."
