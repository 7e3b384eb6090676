import pytest
from pyspark.sql import functions as F

from inkspool.operators import classify as c
from inkspool.params import BOX_WEIGHTS, Params, scaled_text_weights


def scores(spark, cases, image=1400 * 2000):
    df = spark.createDataFrame([(i, t, 0, 0, w, h) for i, (t, w, h) in enumerate(cases)], "i int, text string, left int, top int, right int, bottom int")
    return [(r.score, r.is_text_box, r.features) for r in c.score_boxes(df, F.lit(image)).orderBy("i").collect()]


def test_known_scores(spark):
    got = scores(spark, [("STOP!", 90, 30), ("NO", 150, 80), ("BAM!", 120, 80), ("EXIT", 80, 25), ("Search", 80, 25), ("Hey, what are you doing over there?", 400, 120)])
    assert [round(s, 3) for s, _, _ in got][:5] == [1.375, 1.112, 0.847, 0.420, 0.385]
    assert [ok for _, ok, _ in got] == [True, True, True, False, False, True]


def test_time_stamps_and_noise(spark):
    got = scores(spark, [("26:20/60:00", 300, 40), ("00:00", 300, 40), ("|||||||", 100, 100), ("-------", 100, 100), ("####***@@@", 300, 100)])
    assert [s for s, _, _ in got[:2]] == [0.0, 0.0]
    assert got[0][2].is_timestamp and got[0][2].dictionary_ratio is None
    assert got[2][2].raw_noise == 1.0
    assert got[3][2].raw_noise == pytest.approx(0.99 if got[3][2].raw_noise < 1 else 1.0, abs=0.02)
    assert got[4][2].raw_alpha_ratio == 1.0


def test_short_words_are_accepted(spark):
    assert all(ok for _, ok, _ in scores(spark, [(t, 150, 80) for t in ("NO", "YES", "WAIT", "STOP", "HEY", "OH", "WHAT?!")]))
    assert all(s < 0.7 for s, _, _ in scores(spark, [(t, 80, 25) for t in ("Search", "Follow", "Login", "Settings")]))


def test_weights():
    with pytest.raises(ValueError):
        Params(box_weights=BOX_WEIGHTS | {"ocr_noise": 0.5})
    scaled = scaled_text_weights({"a": 1.0, "b": 3.0})
    assert scaled == {"a": 0.25, "b": 0.75}


def test_zero_boxes(spark):
    (s, _, f), (s2, _, f2) = scores(spark, [("Hi you", 0, 0), ("", 10, 10)], image=0)
    assert f.raw_aspect_ratio == 1.0 and f.raw_density == 0.0 and f2.raw_dict_ratio == 0.0


def test_texts_that_repeat_are_judged_once(spark, monkeypatch):
    words = ["STOP!", "NO", None, "", " ", "26:20", "été", "Hey, what are you doing?", "NO "] * 3
    df = spark.createDataFrame([(i, t, 0, 0, 60 + 40 * i, 30) for i, t in enumerate(words)], "i int, text string, left int, top int, right int, bottom int")
    given, inner = [], c._of_text
    monkeypatch.setattr(c, "_of_text", lambda df, text: given.append(df) or inner(df, text))
    want = sorted(map(repr, c.score_boxes(df, F.lit(1e6)).collect()))
    got = c.score_boxes(df, F.lit(1e6), texts=df.select("text"))
    assert sorted(map(repr, got.select(*df.columns, "features", "score", "is_text_box").collect())) == want
    assert [x.count() for x in given] == [27, 9]
