"""Small awkward tables: nulls, empty and long texts, ties, repeated rows, extra columns with names that operators use inside."""

from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
EXTRA = ("id", "t", "h", "src", "tok", "n", "shard", "score", "toxic", "keep", "group_id", "ch", "rep", "hh", "key", "tab", "a", "b", "root", "owner", "docs", "below_1", "lvl", "state", "prob", "kinds", "text2", "hash", "number", "found", "of", "gone", "lead", "twice", "part", "entries", "dropped_id", "limit_source", "limit_below", "lines_lost", "id_number", "a.b", "we`ird", "__ink_id", "__ink_h", "__ink_src", "__ink_below", "__ink_lost")


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, len(t or "")) for i, t, lang, s in rows], DOCS)


LONG = " ".join(f"longword{i}" for i in range(30_000)) + "\n" + "x" * 300_000

AWKWARD = [
    (1, "The first text of all.\nA shared line\nends here", "en", "s1"),
    (2, None, "en", "s1"),
    (3, "", "en", None),
    (4, " \n\t ", None, "s2"),
    (5, "The first text of all.\nA shared line\nends here", "en", "s2"),
    (5, "The first text of all.\nA shared line\nends here", "en", "s2"),
    (6, LONG, "en", "s1"),
    (7, "!!! ... ###", None, None),
    (None, "A text without an id\nA shared line", "en", "s1"),
    (None, None, None, None),
    (8, "Ünïcödé wörds ñandú çà et là 漢字 😀", "fr", "s2"),
    (9, "a", "en", "s3"),
    (10, "a", "en", "s3"),
    (-11, "A shared line", "en", "s3"),
    (2**62, "A shared line\n\n\nA shared line", "en", "s3"),
]


def awkward(spark, extra=True):
    df = docs(spark, AWKWARD)
    return df.select("*", *[F.lit(i).alias(c) for i, c in enumerate(EXTRA)]) if extra else df


def empty(spark):
    return docs(spark, [])
