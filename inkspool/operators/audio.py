"""Speech clips and their assembly (TTS1-5, AUD1-4, SNK1-2, SORT3), with pluggable provider and codec."""

from __future__ import annotations

import io
import os
import shutil
import subprocess
import uuid
import wave
from collections import deque
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..params import DEFAULTS, Params


class AudioStitchingTimeoutError(Exception):
    """AUD4: assembly took too long. For codecs that can tell."""


class SpeechProvider(Protocol):
    voice: str

    def configured(self) -> bool: ...

    def speak(self, text: str, voice: str) -> bytes: ...


class Codec(Protocol):
    """Decodes clips to PCM and encodes the joined PCM."""

    def duration_ms(self, clip: bytes) -> int: ...

    def join(self, clips: list[bytes], pause_ms: int) -> bytes: ...


RATE = 8000


class StubSpeech:
    """Silent WAV clips of 50 ms a character; a text with TTS-FAILS fails."""

    voice = "stub"

    def configured(self) -> bool:
        return True

    def speak(self, text: str, voice: str) -> bytes:
        if "TTS-FAILS" in text:
            raise RuntimeError("no speech for this text")
        return WavCodec.silence(50 * len(text))


class WavCodec:
    """WAV clips, joined with the standard library. All clips of a chapter must have one format."""

    format = "wav"

    @staticmethod
    def _pack(pcm: bytes, channels: int = 1, width: int = 2, rate: int = RATE) -> bytes:
        out = io.BytesIO()
        with wave.open(out, "wb") as w:
            w.setnchannels(channels), w.setsampwidth(width), w.setframerate(rate)
            w.writeframes(pcm)
        return out.getvalue()

    @classmethod
    def silence(cls, ms: int) -> bytes:
        return cls._pack(bytes(2 * (RATE * ms // 1000)))

    @staticmethod
    def _open(clip: bytes) -> tuple[bytes, tuple[int, int, int]]:
        """Frames, and (channels, bytes a sample, rate)."""
        with wave.open(io.BytesIO(clip)) as w:
            return w.readframes(w.getnframes()), w.getparams()[:3]

    def duration_ms(self, clip: bytes) -> int:
        pcm, (channels, width, rate) = self._open(clip)
        return len(pcm) // (channels * width) * 1000 // rate

    def join(self, clips: list[bytes], pause_ms: int) -> bytes:
        out, first, gap = io.BytesIO(), None, b""
        with wave.open(out, "wb") as w:
            for clip in clips:  # one by one, so that only what is joined is held twice
                pcm, kind = self._open(clip)
                if first is None:
                    first = channels, width, rate = kind
                    w.setnchannels(channels), w.setsampwidth(width), w.setframerate(rate)
                    silence = b"\x80" if width == 1 else b"\x00"  # samples of one byte are unsigned
                    gap = silence * (channels * width * (rate * pause_ms // 1000))
                elif kind != first:
                    raise ValueError("clips of one chapter differ in channels, sample width or rate")
                else:
                    w.writeframesraw(gap)
                w.writeframesraw(pcm)
        return out.getvalue()


class EncoderCodec:
    """Compressed clips through an encoder that is installed on the machines, WAV in between.

    ``decode`` and ``encode`` are commands that read a clip from standard input
    and write it to standard output, such as those of common audio tools.
    """

    def __init__(self, audio_format: str, decode: list[str], encode: list[str], timeout_s: float = 120):
        self.format, self.decode, self.encode, self.timeout_s = audio_format, decode, encode, timeout_s

    def configured(self) -> bool:
        return all(shutil.which(c[0]) for c in (self.decode, self.encode))

    def _run(self, command: list[str], data: bytes) -> bytes:
        try:
            return subprocess.run(command, input=data, capture_output=True, check=True, timeout=self.timeout_s).stdout
        except subprocess.TimeoutExpired as e:
            raise AudioStitchingTimeoutError(f"{command[0]} took more than {self.timeout_s} s") from e

    def duration_ms(self, clip: bytes) -> int:
        return WavCodec().duration_ms(self._run(self.decode, clip))

    def join(self, clips: list[bytes], pause_ms: int) -> bytes:
        return self._run(self.encode, WavCodec().join([self._run(self.decode, c) for c in clips], pause_ms))


def speak(text: str, provider: SpeechProvider, voice: str | None = None) -> bytes:
    """TTS1: speech of one text; blank texts, a provider without settings and non-bytes are errors."""
    if not provider.configured():
        raise ValueError("the speech provider isn't configured")
    if not text or not text.strip():
        raise ValueError("there is no text to speak")
    audio = provider.speak(text, voice or provider.voice)
    if isinstance(audio, bytes):
        return audio
    if hasattr(audio, "__next__"):
        return b"".join(audio)
    raise TypeError(f"audio must be bytes, not {type(audio).__name__}")


CLIPS = "chapter_id long, reading_order int, text string, voice_id string, audio binary, error string"


#: Bytes of audio that a batch on its way to the JVM holds; one clip or chapter may be longer.
AUDIO_AT_ONCE = 8 << 20


def numbered_texts(texts: DataFrame, order: list[str]) -> DataFrame:
    """SORT3: reading_order 1..n of the texts of a chapter."""
    return texts.withColumn("reading_order", F.row_number().over(W.partitionBy("chapter_id").orderBy(*order)))


def packed(sound: bytes) -> bytes:
    """Audio on its way through shuffles and checkpoints: its length, then zstd."""
    return len(sound).to_bytes(8, "big") + pa.compress(sound, codec="zstd", asbytes=True)


def unpacked(data: bytes) -> bytes:
    n = int.from_bytes(data[:8], "big")
    return pa.decompress(data[8:], decompressed_size=n, codec="zstd", asbytes=True) if n else b""


def unpack(df: DataFrame) -> DataFrame:
    """``df`` with its last column, packed audio or null, unpacked, in small batches."""

    def run(batches):
        for b in batches:
            at, size, done = 0, 0, []
            for value in b.column(b.num_columns - 1):
                done.append(unpacked(value.as_py()) if value.is_valid else None)
                size += len(done[-1] or b"")
                if size >= AUDIO_AT_ONCE or at + len(done) == b.num_rows:
                    part = b.slice(at, len(done))
                    yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(done, pa.binary())], b.schema.names)
                    at, size, done = at + len(done), 0, []

    return df.mapInArrow(run, df.schema)


def _in_turn(pool: ThreadPoolExecutor, call, values, ahead: int) -> Iterator:
    """Results in the order of the values; at most ``ahead`` of them wait to be taken."""
    waiting: deque = deque()
    for v in values:
        waiting.append(pool.submit(call, v))
        if len(waiting) >= ahead:
            yield waiting.popleft().result()
    while waiting:
        yield waiting.popleft().result()


def clips(texts: DataFrame, provider: SpeechProvider, voice: str | None = None, p: Params = DEFAULTS, keep_errors: bool = False, pack: bool = False) -> DataFrame:
    """TTS2-4: clips of numbered texts, up to ``tts_parallel`` calls at a time in a task.

    A text that fails is left out and leaves a gap in the order (kept with its
    error if ``keep_errors``). A provider without settings is an error at once.
    Clips are passed on in batches of ``AUDIO_AT_ONCE`` bytes, however many texts
    come at a time; as ``packed`` ones on request, for ``stitch``.
    """
    if not provider.configured():
        raise ValueError("the speech provider isn't configured")

    def one(text):
        try:
            sound = speak(text, provider, voice)
            return packed(sound) if pack else sound, None
        except Exception as e:  # a failed clip is dropped, as documented
            return None, f"{type(e).__name__}: {e}"

    def run(batches):
        with ThreadPoolExecutor(p.tts_parallel) as pool:
            for b in batches:
                at, size, done = 0, 0, []
                for audio, error in _in_turn(pool, one, b.column(2).to_pylist(), 2 * p.tts_parallel):
                    done.append((audio, error))
                    size += len(audio or b"")
                    if size >= AUDIO_AT_ONCE or at + len(done) == b.num_rows:
                        part = b.slice(at, len(done))
                        voices, sounds, errors = pa.array([voice or provider.voice] * len(done), pa.string()), pa.array([a for a, _ in done], pa.binary()), pa.array([e for _, e in done], pa.string())
                        at, size, done = at + len(done), 0, []
                        yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), voices, sounds, errors], ["chapter_id", "reading_order", "text", "voice_id", "audio", "error"])
                        del sounds

    out = texts.select("chapter_id", F.col("reading_order").cast("int").alias("reading_order"), "text").mapInArrow(run, CLIPS)
    return out if keep_errors else out.where("error is null").drop("error")


def durations(measured: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """AUD2: (chapter_id, clips, duration_ms): clips and the pauses between them. Input has ms."""
    return measured.groupBy("chapter_id").agg(F.count("*").alias("clips"), (F.sum("ms") + F.greatest(F.count("*") - 1, F.lit(0)) * p.pause_ms).alias("duration_ms"))


def stitch(clips_: DataFrame, codec: Codec, audio_format: str, p: Params = DEFAULTS, pack: bool = False) -> DataFrame:
    """AUD1: (chapter_id, clips, format, duration_ms, audio) with a pause between clips, in reading order.

    A clip that can't be decoded ends the job. Chapters without clips have no row.
    With ``pack``, clips come ``packed``, and chapters go so.
    """
    if audio_format != getattr(codec, "format", audio_format):
        raise ValueError(f"this codec doesn't write {audio_format}")
    if not getattr(codec, "configured", lambda: True)():
        raise ValueError(f"there is no encoder for {audio_format} on this machine")

    def chapters(batches):
        """(chapter, its clips); of the others no more is held than a batch."""
        chapter, parts = None, []
        for b in batches:
            for of, clip in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if parts and of != chapter:
                    yield chapter, parts
                    parts = []
                chapter = of
                parts.append(unpacked(clip.as_py()) if pack else clip.as_py())
        if parts:
            yield chapter, parts

    def run(batches):
        out, size = [], 0
        for chapter, parts in chapters(batches):
            n, ms = len(parts), sum(map(codec.duration_ms, parts)) + (len(parts) - 1) * p.pause_ms
            audio = codec.join(parts, p.pause_ms)
            parts.clear()
            audio = packed(audio) if pack else audio
            out.append((chapter, n, audio_format, ms, audio))
            size += len(audio)
            if size >= AUDIO_AT_ONCE:
                yield _stitched(out)
                out, size = [], 0
        if out:
            yield _stitched(out)

    ordered = clips_.select("chapter_id", "reading_order", "audio").repartition("chapter_id").sortWithinPartitions("chapter_id", "reading_order").select("chapter_id", "audio")
    return ordered.mapInArrow(run, "chapter_id long, clips long, format string, duration_ms long, audio binary")


def _stitched(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["chapter_id", "clips", "format", "duration_ms", "audio"])


def chapter_headers(stitched: DataFrame) -> DataFrame:
    """SNK1: what goes with the audio of a chapter, as header fields."""
    return stitched.select("chapter_id", F.create_map(F.lit("X-Chapter-ID"), F.col("chapter_id").cast("string"), F.lit("X-Bubble-Count"), F.col("clips").cast("string"), F.lit("X-Duration-MS"), F.col("duration_ms").cast("string"), F.lit("X-Format"), F.col("format")).alias("headers"))


def format_of(path: str) -> str:
    """SNK2: the audio format that a file's extension stands for; mp3 without one."""
    return os.path.splitext(path)[1].lstrip(".").lower() or DEFAULTS.audio_format


def stitch_to_files(clips_: DataFrame, codec: Codec, path: str, audio_format: str | None = None, p: Params = DEFAULTS) -> DataFrame:
    """SNK2: one audio file a chapter; (chapter_id, file, format, duration_ms, bytes) of what was written.

    ``path`` has ``{chapter_id}`` in it and an extension that gives the format,
    and names a folder that all machines share. A file that is there already is
    replaced, as a whole, so that a task that runs twice leaves one good file.
    """
    if "{chapter_id}" not in path:
        raise ValueError("the path needs {chapter_id}, as there is one file a chapter")
    kind = audio_format or format_of(path)

    def run(batches):
        for b in batches:
            files, sizes = [], []
            for chapter, audio in zip(b.column(0).to_pylist(), b.column(4).to_pylist(), strict=True):
                name = path.replace("{chapter_id}", str(chapter))
                os.makedirs(os.path.dirname(name) or ".", exist_ok=True)
                part = f"{name}.{uuid.uuid4().hex}"
                with open(part, "wb") as f:
                    f.write(audio)
                os.replace(part, name)
                files.append(name), sizes.append(len(audio))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(files, pa.string()), b.column(2), b.column(3), pa.array(sizes, pa.int64())], ["chapter_id", "file", "format", "duration_ms", "bytes"])

    return stitch(clips_, codec, kind, p).mapInArrow(run, "chapter_id long, file string, format string, duration_ms long, bytes long")


def write_audio(stitched: DataFrame, path: str, partitions: int | None = None, mode: str = "errorifexists") -> None:
    """One Parquet row a chapter, partitioned by format; a binary column keeps files few. What is at the path stays unless ``mode`` says otherwise."""
    out = stitched.repartition(partitions) if partitions else stitched
    out.write.mode(mode).partitionBy("format").parquet(path)
