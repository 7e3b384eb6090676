"""Pages to audio: statuses, files, formats."""

import pytest
from pyspark.sql import functions as F

from inkspool.operators import audio
from inkspool.params import TEXT_WEIGHTS, Params
from inkspool.plans import chapter
from inkspool.sources import images, ocr

PAGES = "chapter_id long, panel_id int, content binary"
TEXT = b"Where are you going tonight, my friend?\nI am going home to my mother."


class Off(ocr.StubOcr, audio.StubSpeech):
    def configured(self):
        return False


class Mute(audio.StubSpeech):
    def speak(self, text, voice):
        raise RuntimeError("no voice")


def run(spark, rows, reader=None, speaker=None, sizes=True):
    pages = spark.createDataFrame(rows, PAGES)
    size = pages.where("content <> cast('torn' as binary)").select("chapter_id", "panel_id", F.lit(1200).alias("width"), F.lit(600).alias("height")) if sizes else None
    out = chapter.process(pages, reader or ocr.StubOcr(), speaker or audio.StubSpeech(), audio.WavCodec(), "wav", sizes=size)
    return {r.chapter_id: r for r in out.collect()}


ROWS = [(1, 0, TEXT), (1, 1, TEXT), (2, 0, b"OCR-FAILS"), (3, None, None), (4, 0, TEXT), (4, 1, b""), (5, 0, TEXT), (5, 1, b"torn"), *[(6, i, TEXT) for i in range(151)]]


def test_statuses_and_audio(spark):
    got = run(spark, ROWS)
    assert {k: (r.status, r.error) for k, r in got.items()} == {1: (200, None), 2: (400, "no bubbles"), 3: (400, "no images"), 4: (400, "unreadable image"), 5: (400, "unreadable image"), 6: (400, "too many images")}
    one = got[1]
    assert one.clips == one.n_texts > 0 and one.format == "wav" and audio.WavCodec().duration_ms(bytes(one.audio)) == one.duration_ms
    assert got[2].audio is None and got[2].clips == 0


def test_headers_that_cant_be_read(spark):
    assert run(spark, [(1, 0, TEXT)], sizes=False)[1].error == "unreadable image"


def test_providers_without_settings(spark):
    got = run(spark, ROWS, reader=Off())
    assert (got[1].status, got[3].status, got[6].status) == (503, 400, 400) and "OCR" in got[1].error
    assert run(spark, ROWS[:2], speaker=Off())[1].error == "the speech provider isn't configured"
    with pytest.raises(ValueError, match="configured"):
        audio.clips(spark.createDataFrame([(1, 1, "a")], "chapter_id long, reading_order int, text string"), Off())


def test_no_clip_is_a_failure(spark):
    assert (run(spark, ROWS[:2], speaker=Mute())[1].status, run(spark, ROWS[:2], speaker=Mute())[1].error) == (500, "no audio")


def test_empty_table(spark):
    assert run(spark, []) == {}


def test_pages_are_found_by_their_whole_path(spark, tmp_path):
    for folder, body in (("c1", b"one"), ("c2", b"two"), ("c 3", b"three")):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "1.png").write_bytes(body)
    manifest = spark.createDataFrame([(1, 0, "c1/1.png"), (2, 0, "./c2/1.png"), (3, 0, "c 3/1.png"), (4, 0, "1.png")], "chapter_id long, panel_id int, path string")
    got = {r.chapter_id: r.content and bytes(r.content) for r in images.read_pages(spark, manifest, str(tmp_path)).collect()}
    assert got == {1: b"one", 2: b"two", 3: b"three", 4: None}


def test_formats_of_clips():
    wav = audio.WavCodec()
    stereo = wav._pack(bytes(4 * 8000), channels=2)
    low = wav._pack(bytes(11025), width=1, rate=11025)
    assert (wav.duration_ms(stereo), wav.duration_ms(low)) == (1000, 1000)
    assert wav.duration_ms(wav.join([stereo, stereo], 500)) == 2500
    pause = wav._open(wav.join([low, low], 100))[0]
    assert pause[11025 : 11025 + 1102] == b"\x80" * 1102
    with pytest.raises(ValueError, match="differ"):
        wav.join([stereo, low], 100)


def test_files(spark, tmp_path):
    wav = audio.WavCodec()
    c = spark.createDataFrame([(1, 2, wav.silence(300)), (1, 1, wav.silence(200)), (2, 1, wav.silence(100))], "chapter_id long, reading_order int, audio binary")
    for _ in range(2):  # a second run replaces the files
        got = {r.chapter_id: r for r in audio.stitch_to_files(c, wav, f"{tmp_path}/new/{{chapter_id}}.wav").collect()}
    assert sorted(x.name for x in (tmp_path / "new").iterdir()) == ["1.wav", "2.wav"]
    assert wav.duration_ms((tmp_path / "new/1.wav").read_bytes()) == got[1].duration_ms == 1200
    assert [audio.format_of(x) for x in ("a/b.WAV", "b.ogg", "b")] == ["wav", "ogg", "mp3"]
    with pytest.raises(ValueError, match="mp3"):
        audio.stitch_to_files(c, wav, f"{tmp_path}/{{chapter_id}}.mp3")
    with pytest.raises(ValueError, match="chapter_id"):
        audio.stitch_to_files(c, wav, f"{tmp_path}/all.wav")
    audio.write_audio(audio.stitch(c, wav, "wav"), f"{tmp_path}/table")
    with pytest.raises(Exception, match="exists"):
        audio.write_audio(audio.stitch(c, wav, "wav"), f"{tmp_path}/table")


def test_encoders(spark):
    same = audio.EncoderCodec("mp3", ["cat"], ["cat"])
    clip = audio.WavCodec.silence(100)
    assert same.configured() and same.duration_ms(same.join([clip, clip], 50)) == 250
    c = spark.createDataFrame([(1, 1, clip)], "chapter_id long, reading_order int, audio binary")
    assert audio.stitch(c, same, "mp3").first().format == "mp3"
    with pytest.raises(ValueError, match="no encoder"):
        audio.stitch(c, audio.EncoderCodec("mp3", ["no-such-decoder"], ["cat"]), "mp3")
    with pytest.raises(audio.AudioStitchingTimeoutError):
        audio.EncoderCodec("mp3", ["cat"], ["sleep", "9"], timeout_s=0.1).join([clip], 5)


def test_settings(tmp_path, monkeypatch):
    here = tmp_path / "key.json"
    assert not Params(ocr_credentials=str(here)).ocr_configured
    here.write_text("{}")
    assert Params(ocr_credentials=str(here)).ocr_configured and not Params().ocr_configured
    assert Params(tts_key="k", tts_voice="v").tts_configured and not Params(tts_key="k").tts_configured
    monkeypatch.setenv("INKSPOOL_TTS_KEY", "k"), monkeypatch.setenv("INKSPOOL_TTS_VOICE", "v"), monkeypatch.setenv("INKSPOOL_PAUSE_MS", "250")
    assert Params.from_env().tts_configured and Params.from_env().pause_ms == 250
    assert sum(Params(text_weights={k: 2 * v for k, v in TEXT_WEIGHTS.items()}).text_weights.values()) == pytest.approx(1)


def test_audio_is_packed_up_to_the_last_step(spark, monkeypatch):
    """What is written once, shuffled and joined is short, whatever the length of the audio."""
    kept, write = [], chapter.checkpointed
    monkeypatch.setattr(chapter, "checkpointed", lambda df: kept.append(write(df)) or kept[-1])
    one = run(spark, ROWS[:2])[1]
    longest = kept[-1].agg(F.max(F.length("audio"))).first()[0]
    assert len(one.audio) > 100_000 and longest < 2_000 and audio.WavCodec().duration_ms(bytes(one.audio)) == one.duration_ms
    assert [audio.unpacked(audio.packed(x)) for x in (b"", b"a", bytes(10**6))] == [b"", b"a", bytes(10**6)]
