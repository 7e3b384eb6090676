"""Text recognition through a provider (SRC3-6). The engine ships a deterministic stub; real ones are plugged in."""

from __future__ import annotations

import time
from collections.abc import Callable
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import normalized_vertices
from ..params import DEFAULTS, Params


class TransientError(Exception):
    """The service is unavailable, timed out or failed inside: worth another try."""


class OcrProvider(Protocol):
    """``detect(bytes)`` gives annotations, [(text, [(x, y), ...])]; the first one is the whole page."""

    def configured(self) -> bool: ...

    def detect(self, image: bytes) -> list[tuple[str, list[tuple[int | None, int | None]]]]: ...


class StubOcr:
    """Reads an image whose bytes are UTF-8 text: words on lines 30 high, 10 a letter."""

    def configured(self) -> bool:
        return True

    def detect(self, image: bytes):
        text = image.decode()
        if "OCR-FAILS" in text:
            raise ValueError("the image can't be read")
        out = [(text, [(0, 0), (1000, 0), (1000, 1000), (0, 1000)])]
        for row, line in enumerate(text.split("\n")):
            x = 10
            for w in line.split():
                r, t, b = x + 10 * len(w), 10 + 40 * row, 40 + 40 * row
                out.append((w, [(x, t), (r, t), (r, b), (x, b)]))
                x = r + 8
        return out


def with_retry(call: Callable, p: Params = DEFAULTS, sleep=time.sleep, clock=time.monotonic):
    """SRC5: repeats a call on TransientError with growing pauses until the deadline."""
    pause, end = p.ocr_retry_first_s, clock() + p.ocr_deadline_s
    while True:
        try:
            return call()
        except TransientError:
            if clock() + pause > end:
                raise
            sleep(pause)
            pause = min(pause * p.ocr_retry_factor, p.ocr_retry_max_s)


ANNOTATED = "chapter_id long, panel_id int, annotations array<struct<description string, vertices array<struct<x int, y int>>>>, error string"


def annotate(pages: DataFrame, provider: OcrProvider, p: Params = DEFAULTS) -> DataFrame:
    """SRC4: annotations of each image; one that fails has none and an error, the others go on."""
    if p.ocr_batch <= 0:
        raise ValueError("the batch size must be positive")
    if not provider.configured():
        raise ValueError("the OCR provider isn't configured")
    kind = pa.list_(pa.struct([("description", pa.string()), ("vertices", pa.list_(pa.struct([("x", pa.int32()), ("y", pa.int32())])))]))

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, p.ocr_batch):
                b = whole.slice(at, p.ocr_batch)
                found, errors = [], []
                for image in b.column(2).to_pylist():
                    try:
                        notes = with_retry(lambda image=image: provider.detect(image), p)
                        found.append([{"description": t, "vertices": [{"x": x, "y": y} for x, y in vs]} for t, vs in notes])
                        errors.append(None)
                    except Exception as e:  # one image must not end the job; its row says why
                        found.append([])
                        errors.append(f"{type(e).__name__}: {e}")
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, kind), pa.array(errors, pa.string())], ["chapter_id", "panel_id", "annotations", "error"])

    return pages.select("chapter_id", "panel_id", "content").mapInArrow(run, ANNOTATED)


def words_of(annotated: DataFrame) -> DataFrame:
    """SRC3, SRC6: words of the annotations; the first annotation, the whole page, is left out. Confidence is 1."""
    a = annotated.select("chapter_id", "panel_id", F.posexplode("annotations").alias("pos", "a")).where("pos >= 1")
    a = a.withColumn("v", normalized_vertices(F.col("a.vertices")))
    xs, ys = F.transform("v", lambda v: v["x"]), F.transform("v", lambda v: v["y"])
    return a.select("chapter_id", "panel_id", (F.col("pos") - 1).alias("word_idx"), F.col("a.description").alias("text"), F.array_min(xs).alias("left"), F.array_min(ys).alias("top"), F.array_max(xs).alias("right"), F.array_max(ys).alias("bottom"), F.lit(1.0).alias("confidence"))
