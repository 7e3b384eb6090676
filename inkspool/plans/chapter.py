"""The chapter pipeline (PIPE): words to bubbles, dialogue, continuation and clean text, with a status per chapter."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import for_speech
from ..operators import audio, classify, continuation, grouping
from ..operators.lineage import checkpointed
from ..params import DEFAULTS, Params
from ..sources import images, ocr


def dialogue_bubbles(words: DataFrame, panels: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """GRP, then CLS6: bubbles that are dialogue, judged against their panel's size."""
    bubbles = grouping.group_into_bubbles(words, p)
    sized = bubbles.join(panels.select("chapter_id", "panel_id", (F.col("width").cast("long") * F.col("height")).alias("image_area")), ["chapter_id", "panel_id"])
    return classify.filter_boxes(sized, F.col("image_area"), p).drop("image_area")


def lines(words: DataFrame, panels: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Up to the spoken text: (chapter_id, bubble_idx, text); empty texts are left out (TXT11)."""
    merged = continuation.merge(dialogue_bubbles(words, panels, p), panels, p)
    spoken = merged.select("chapter_id", "bubble_idx", for_speech(F.col("text")).alias("text"))
    return spoken.where(F.col("text") != "")


def status(panels: DataFrame, words: DataFrame, dialogue: DataFrame, spoken: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """(chapter_id, n_images, n_words, n_bubbles, n_texts, status, error): nothing is thrown inside a job."""
    n = lambda df, name: df.groupBy("chapter_id").agg(F.count("*").alias(name))
    all_ = panels.groupBy("chapter_id").agg(F.count("panel_id").alias("n_images"))
    for df, name in ((words, "n_words"), (dialogue, "n_bubbles"), (spoken, "n_texts")):
        all_ = all_.join(n(df, name), "chapter_id", "left").withColumn(name, F.coalesce(name, F.lit(0).cast("long")))
    error = F.when(F.col("n_images") == 0, "no images").when(F.col("n_images") > p.max_images, "too many images").when(F.col("n_bubbles") == 0, "no bubbles").when(F.col("n_texts") == 0, "no text after preprocessing")
    return all_.select("chapter_id", "n_images", "n_words", "n_bubbles", "n_texts", F.when(error.isNull(), 200).otherwise(400).alias("status"), error.alias("error"))


RESULT = "chapter_id long, n_images long, n_words long, n_bubbles long, n_texts long, clips long, status int, error string, format string, duration_ms long, audio binary"


def process(pages: DataFrame, reader: ocr.OcrProvider, speaker: audio.SpeechProvider, codec: audio.Codec, audio_format: str, p: Params = DEFAULTS, sizes: DataFrame | None = None) -> DataFrame:
    """PIPE: pages(chapter_id, panel_id, content) to the audio of each chapter, one row a chapter with its status.

    400 for chapters without images, with too many, with one that can't be read
    or is empty, without bubbles or without text; 503 for valid ones if a
    provider isn't configured; 500 if no clip could be made. ``sizes``
    (chapter_id, panel_id, width, height) stands in for the images' headers.
    What providers return is written once, so that a lost executor doesn't make
    them work again; clips and chapters are packed until the end, so that the
    JVM holds no audio while it sorts and joins.
    """
    none = lambda name: F.lit(None).alias(name)
    zeros = [F.lit(0).cast("long").alias(c) for c in ("n_words", "n_bubbles", "n_texts", "clips")]
    asked = images.chapter_status(pages, p)
    silent = [none("format"), none("duration_ms").cast("long"), none("audio").cast("binary")]
    if not (reader.configured() and speaker.configured()):
        which = "OCR" if not reader.configured() else "speech"
        early = F.col("error").isin("no images", "too many images")
        out = asked.select("chapter_id", "n_images", *zeros, F.when(early, F.col("status")).otherwise(503).alias("status"), F.when(early, F.col("error")).otherwise(f"the {which} provider isn't configured").alias("error"), *silent)
        return _typed(out)
    given = pages.where("panel_id is not null").join(asked.where("status = 200").select("chapter_id"), "chapter_id", "left_semi")
    size = images.with_sizes(given) if sizes is None else given.select("chapter_id", "panel_id").join(sizes, ["chapter_id", "panel_id"], "left")
    panels = checkpointed(size)
    broken = panels.where("height is null").select("chapter_id").distinct()
    refused = asked.where("status <> 200").unionByName(asked.where("status = 200").join(broken, "chapter_id").withColumns({"status": F.lit(400), "error": F.lit("unreadable image")}))
    whole = given.join(broken, "chapter_id", "left_anti")
    words = checkpointed(ocr.words_of(ocr.annotate(whole, reader, p)))
    good = panels.join(broken, "chapter_id", "left_anti")
    dialogue = checkpointed(dialogue_bubbles(words, good, p))
    merged = continuation.merge(dialogue, good, p)
    spoken = merged.select("chapter_id", "bubble_idx", for_speech(F.col("text")).alias("text")).where("text <> ''")
    texts = checkpointed(audio.numbered_texts(spoken, ["bubble_idx"]).select("chapter_id", "reading_order", "text"))
    clips = checkpointed(audio.clips(texts, speaker, p=p, pack=True))
    done = status(good, words, dialogue, texts, p).join(audio.stitch(clips, codec, audio_format, p, pack=True), "chapter_id", "left")
    dumb = (F.col("status") == 200) & F.col("clips").isNull()
    made = done.withColumns({"status": F.when(dumb, 500).otherwise(F.col("status")), "error": F.when(dumb, "no audio").otherwise(F.col("error")), "clips": F.coalesce("clips", F.lit(0).cast("long"))})
    return audio.unpack(_typed(made)).unionByName(_typed(refused.select("chapter_id", "n_images", *zeros, "status", "error", *silent)))


def _typed(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(name).cast(kind).alias(name) for name, kind in (f.split() for f in RESULT.split(", "))])


def dialogue_by_chapter(words: DataFrame, panels: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Flagship: (chapter_id, bubbles, dialogue, words_in_dialogue)."""
    bubbles = grouping.group_into_bubbles(words, p)
    sized = bubbles.join(panels.select("chapter_id", "panel_id", (F.col("width").cast("long") * F.col("height")).alias("image_area")), ["chapter_id", "panel_id"])
    scored = classify.score_boxes(sized, F.col("image_area"), p)
    return scored.groupBy("chapter_id").agg(F.count("*").alias("bubbles"), F.count_if("is_text_box").alias("dialogue"), F.sum(F.when(F.col("is_text_box"), F.size("words")).otherwise(0)).alias("words_in_dialogue"))
