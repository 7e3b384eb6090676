"""Ordered page images: ingest, limits and sizes (SRC1, SRC2)."""

from __future__ import annotations

import struct

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..params import DEFAULTS, Params


def read_pages(spark: SparkSession, manifest: DataFrame, root: str) -> DataFrame:
    """SRC1: manifest(chapter_id, panel_id, path) with the files' bytes; absent files have null content.

    ``path`` is relative to ``root``, as chapter/1.png. Paths are compared as a
    whole, so files of one name in several folders are told apart.
    """
    folder = spark._jvm.org.apache.hadoop.fs.Path(root)
    base = folder.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(folder).toString().rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    files = files.select(F.substring(F.col("path"), F.lit(len(base) + 2), F.length("path")).alias("at"), "content")
    wanted = manifest.select("chapter_id", "panel_id", F.regexp_replace(F.col("path"), r"^(\./|/)+", "").alias("wanted"))
    return wanted.join(files, F.col("wanted") == F.col("at"), "left").select("chapter_id", "panel_id", "content")


def chapter_status(pages: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """(chapter_id, n_images, status, error): what an upload would be refused for."""
    per = pages.groupBy("chapter_id").agg(F.count("panel_id").alias("n_images"), F.count_if(F.col("panel_id").isNotNull() & (F.coalesce(F.length("content"), F.lit(0)) == 0)).alias("bad"))
    error = F.when(F.col("n_images") == 0, "no images").when(F.col("n_images") > p.max_images, "too many images").when(F.col("bad") > 0, "unreadable image")
    return per.select("chapter_id", "n_images", F.when(error.isNull(), 200).otherwise(400).alias("status"), error.alias("error"))


def _word(content, at: int, n: int = 4):
    return F.conv(F.hex(F.substring(content, at, n)), 16, 10).cast("int")


def png_size(content) -> tuple:
    """SRC2 for PNG: (width, height) from the header, in the JVM; null for other formats."""
    png = F.hex(F.substring(content, 1, 8)) == "89504E470D0A1A0A"
    return F.when(png, _word(content, 17)), F.when(png, _word(content, 21))


def image_size(raw: bytes | None) -> tuple[int, int] | None:
    """(width, height) of a PNG, GIF, BMP or JPEG, from its header."""
    if not raw or len(raw) < 24:
        return None
    if raw[:8] == b"\x89PNG\r\n\x1a\n":
        return struct.unpack(">II", raw[16:24])
    if raw[:4] == b"GIF8":
        return struct.unpack("<HH", raw[6:10])
    if raw[:2] == b"BM":
        w, h = struct.unpack("<ii", raw[18:26])
        return w, abs(h)
    if raw[:2] == b"\xff\xd8":
        at = 2
        while at + 9 < len(raw) and raw[at] == 0xFF:
            if raw[at + 1] in range(0xC0, 0xD0) and raw[at + 1] not in (0xC4, 0xC8, 0xCC):
                h, w = struct.unpack(">HH", raw[at + 5 : at + 9])
                return w, h
            at += 2 + struct.unpack(">H", raw[at + 2 : at + 4])[0]
    return None


def with_sizes(pages: DataFrame) -> DataFrame:
    """SRC2: (chapter_id, panel_id, width, height) for all formats; null where the header can't be read."""

    def run(batches):
        for b in batches:
            sizes = [image_size(v.as_buffer().to_pybytes() if v.is_valid else None) for v in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *[pa.array([s and s[k] for s in sizes], pa.int32()) for k in (0, 1)]], ["chapter_id", "panel_id", "width", "height"])

    return pages.select("chapter_id", "panel_id", "content").mapInArrow(run, "chapter_id long, panel_id int, width int, height int")
