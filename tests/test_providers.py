import struct

import pyarrow as pa
import pytest

from inkspool.operators import audio
from inkspool.params import Params
from inkspool.sources import images, ocr


class Flaky(ocr.StubOcr):
    def detect(self, image):
        if image == b"bad":
            raise ValueError("broken")
        return super().detect(image)


def pages(spark, bodies):
    return spark.createDataFrame([(1, i, b) for i, b in enumerate(bodies)], "chapter_id long, panel_id int, content binary")


def test_ocr_batch_keeps_failed_images(spark):
    out = ocr.annotate(pages(spark, [b"Hello world", b"bad", b"a b"]), Flaky()).orderBy("panel_id").collect()
    assert [max(0, len(r.annotations) - 1) for r in out] == [2, 0, 2]
    assert out[1].error.startswith("ValueError") and out[0].error is None
    words = ocr.words_of(ocr.annotate(pages(spark, [b"Hello world"]), Flaky())).orderBy("word_idx").collect()
    assert [(w.text, w.word_idx, w.confidence) for w in words] == [("Hello", 0, 1.0), ("world", 1, 1.0)]
    with pytest.raises(ValueError):
        ocr.annotate(pages(spark, [b"x"]), Flaky(), Params(ocr_batch=0))


def test_retry_pauses_grow_until_the_deadline():
    now, slept, calls = [0.0], [], []

    def sleep(s):
        slept.append(s)
        now[0] += s

    def fail():
        calls.append(1)
        raise ocr.TransientError

    with pytest.raises(ocr.TransientError):
        ocr.with_retry(fail, sleep=sleep, clock=lambda: now[0])
    assert slept[:5] == [1, 2, 4, 8, 10] and sum(slept) <= 60 and len(calls) == len(slept) + 1
    assert ocr.with_retry(lambda: 7) == 7


def test_image_sizes(spark):
    png = b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sII", 13, b"IHDR", 640, 480) + b"\0" * 5
    gif = b"GIF89a" + struct.pack("<HH", 30, 20) + b"\0" * 20
    jpg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x11\x08" + struct.pack(">HH", 90, 70) + b"\0" * 20
    got = images.with_sizes(pages(spark, [png, gif, jpg, b"junk", None])).orderBy("panel_id").collect()
    assert [(r.width, r.height) for r in got] == [(640, 480), (30, 20), (70, 90), (None, None), (None, None)]


def test_limits(spark):
    rows = [(1, i, b"x") for i in range(151)] + [(2, 0, b"x"), (3, 0, None)]
    got = {r.chapter_id: (r.status, r.error) for r in images.chapter_status(spark.createDataFrame(rows, "chapter_id long, panel_id int, content binary")).collect()}
    assert got == {1: (400, "too many images"), 2: (200, None), 3: (400, "unreadable image")}


def test_speech_batch_drops_failures_and_keeps_order(spark):
    t = spark.createDataFrame([(1, 1, "First"), (1, 2, "TTS-FAILS"), (1, 3, "Third"), (1, 4, " ")], "chapter_id long, reading_order int, text string")
    got = audio.clips(t, audio.StubSpeech()).orderBy("reading_order").collect()
    assert [(r.reading_order, r.text) for r in got] == [(1, "First"), (3, "Third")]
    assert audio.clips(t, audio.StubSpeech(), keep_errors=True).where("error is not null").count() == 2


def test_speak_checks():
    class Odd(audio.StubSpeech):
        def speak(self, text, voice):
            return 5

    class Parts(audio.StubSpeech):
        def speak(self, text, voice):
            return iter([b"a", b"b"])

    with pytest.raises(TypeError):
        audio.speak("x", Odd())
    with pytest.raises(ValueError):
        audio.speak(" ", audio.StubSpeech())
    assert audio.speak("x", Parts()) == b"ab"


def test_stitch(spark):
    wav = audio.WavCodec()
    rows = [(1, 2, wav.silence(300)), (1, 1, wav.silence(200)), (2, 1, wav.silence(100))]
    c = spark.createDataFrame(rows, "chapter_id long, reading_order int, audio binary")
    got = {r.chapter_id: r for r in audio.stitch(c, wav, "wav").collect()}
    assert (got[1].duration_ms, got[2].duration_ms) == (1200, 100)
    assert wav.duration_ms(bytes(got[1].audio)) == 1200


class Caught:
    """Stands in for a table, and keeps the function that its batches go through."""

    def mapInArrow(self, run, schema):
        self.run = run
        return self

    def __getattr__(self, name):
        return lambda *a, **k: self


class Long(audio.StubSpeech):
    def __init__(self):
        self.calls = 0

    def speak(self, text, voice):
        self.calls += 1
        return audio.WavCodec.silence(60_000)


def test_audio_is_passed_on_in_small_batches(spark):
    texts, speech, chapters = Caught(), Long(), Caught()
    audio.clips(texts, speech, keep_errors=True)
    batch = pa.RecordBatch.from_arrays([pa.array([i // 10 for i in range(100)]), pa.array(range(100), pa.int32()), pa.array(["a"] * 100)], ["chapter_id", "reading_order", "text"])
    found = texts.run([batch])
    got = [next(found)]
    assert speech.calls < 30  # the next clips aren't made before they are wanted
    got += found
    assert sum(b.num_rows for b in got) == speech.calls == 100 and all(b.nbytes < audio.AUDIO_AT_ONCE + 2_000_000 for b in got)
    assert [x for b in got for x in b.column(1).to_pylist()] == list(range(100))
    audio.stitch(chapters, audio.WavCodec(), "wav")
    out = list(chapters.run([b.select(["chapter_id", "audio"]) for b in got]))
    assert [(r["chapter_id"], r["clips"], r["duration_ms"]) for b in out for r in b.to_pylist()] == [(k, 10, 10 * 60_000 + 9 * 700) for k in range(10)]
    assert len(out) == 10
