"""Line dedup: both ways of probing, owners of any kind, near copies that are spared."""

import numpy as np
import pytest

from inkspool.llm import linededup

from .data import docs

LONG = "a passage of twelve words that two documents have word for word"


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_lines_go_from_two_documents_on(spark, limit):
    df = docs(spark, [(i, f"short one\n{LONG if i < 2 else i}\nown {i}", "en", "s") for i in range(4)])
    got = {r.doc_id: (r.text, r.lost) for r in linededup.dedup_lines(df, lost_col="lost", max_broadcast=limit).collect()}
    assert got == {0: (f"short one\n{LONG}\nown 0", 0), 1: ("own 1", 2), 2: ("2\nown 2", 1), 3: ("3\nown 3", 1)}


def brute(rows, min_docs):
    """rows: (id, text); ids of None own nothing that another has."""
    have = {}
    for i, t in rows:
        for x in {y.strip(" \t\r") for y in (t or "").split("\n")} - {""}:
            have.setdefault(x, []).append(i)
    owner = {x: min((i for i in v if i is not None), default=None) for x, v in have.items()}
    out = []
    for i, t in rows:
        gone = lambda x: len(have.get(x, [])) >= min_docs and owner[x] != i
        out.append((i, t if t is None else "\n".join(y for y in t.split("\n") if not gone(y.strip(" \t\r")))))
    return out


@pytest.mark.parametrize("kind", ["long", "string", "int"])
@pytest.mark.parametrize("limit", [1 << 20, 32 * 8, 0])
def test_all_ways_of_probing_equal_brute_force(spark, kind, limit):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(120):
        lines = [f"{' ' if rng.random() < 0.2 else ''}line {int(abs(rng.normal(0, 25)))}" if rng.random() < 0.9 else "" for _ in range(rng.integers(0, 12))]
        key = None if i % 20 == 7 else int(rng.integers(0, 100))
        rows.append((key if key is None or kind != "string" else f"doc{key:03d}", None if i == 50 else "\n".join(lines)))
    df = spark.createDataFrame(rows, f"doc_id {kind}, text string")
    got = [(r.doc_id, r.text) for r in linededup.dedup_lines(df, min_docs=3, max_broadcast=limit, lines_per_shard=4).collect()]
    assert sorted(got, key=repr) == sorted(brute(rows, 3), key=repr)


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_near_copies_are_spared(spark, limit):
    body = [f"sentence number {i} of the first text" for i in range(8)]
    rows = [(1, "\n".join([*body, "a footer that all have"])), (2, "\n".join([*body[:6], "two other", "lines here", "a footer that all have"])), (3, "\n".join([body[0], "something else altogether that is long enough", "and more of it, and yet more of it, so that little is shared", "a footer that all have"])), (0, "a footer that all have\nbut little else")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text.split("\n") for r in linededup.dedup_lines(df, max_broadcast=limit, spare=0.5).collect()}
    assert got[1] == body and got[2] == [*body[:6], "two other", "lines here"] and got[3] == rows[2][1].split("\n")[1:3] and len(got[0]) == 2


def test_a_name_that_is_taken_is_refused(spark):
    with pytest.raises(ValueError, match="already"):
        linededup.dedup_lines(docs(spark, [(1, "a", "en", "s")]), lost_col="TEXT")


def test_equal_keys_are_refused():
    with pytest.raises(ValueError, match="distinct"):
        linededup.build_mph(np.array([5, 5, 6], np.uint64))
