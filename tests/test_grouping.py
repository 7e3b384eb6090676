import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from inkspool.operators import grouping as gr
from inkspool.operators.groups import map_groups
from inkspool.params import Params

SCHEMA = "chapter_id long, panel_id int, word_idx int, text string, left int, top int, right int, bottom int"


def bubbles(spark, words, gap=100):
    rows = [(1, 0, i, *w) for i, w in enumerate(words)]
    out = gr.group_into_bubbles(spark.createDataFrame(rows, SCHEMA), Params(max_vertical_gap=gap))
    return [(r.text, r.left, r.top, r.right, r.bottom) for r in out.orderBy("reading_order").collect()]


def sized(*words):
    return [(t, x, y, x + w, y + h) for t, w, h, x, y in words]


CASES = [
    ([("Hello", 10, 20, 50, 40)], 35, ["Hello"]),
    ([("Hello", 10, 20, 50, 40), ("world", 10, 45, 50, 65)], 35, ["Hello world"]),
    ([("First", 10, 20, 50, 40), ("bubble", 10, 45, 50, 65), ("Second", 10, 120, 60, 140), ("bubble", 10, 145, 60, 165)], 35, ["First bubble", "Second bubble"]),
    ([("Left", 10, 20, 50, 40), ("Right", 150, 25, 200, 45)], 35, ["Left", "Right"]),
    ([("Bottom", 10, 150, 60, 170), ("Top", 10, 20, 40, 40), ("Middle", 10, 80, 60, 100)], 35, ["Top", "Middle", "Bottom"]),
    ([("Right", 100, 20, 150, 40), ("Left", 10, 20, 50, 40), ("Center", 60, 20, 95, 40)], 35, ["Left Center Right"]),
    ([("Overlap", 10, 20, 60, 40), ("ping", 50, 30, 90, 50)], 35, ["Overlap ping"]),
    ([("Line1", 10, 20, 50, 40), ("Line2", 10, 50, 50, 70)], 5, ["Line1", "Line2"]),
    ([("Left", 10, 20, 40, 40), ("Shift", 25, 45, 65, 65)], 35, ["Left Shift"]),
    (sized(("HELLO", 80, 30, 100, 100), ("WORLD", 80, 30, 190, 100), ("GOODBYE", 100, 30, 500, 100), ("FRIEND", 80, 30, 610, 100)), 100, ["HELLO WORLD", "GOODBYE FRIEND"]),
    (sized(("THIS", 60, 30, 100, 100), ("IS", 30, 30, 170, 100), ("MULTIPLE", 100, 30, 100, 150), ("LINES", 70, 30, 210, 150)), 100, ["THIS IS MULTIPLE LINES"]),
    (sized(("I", 20, 30, 100, 100), ("LOVE", 60, 30, 130, 100), ("YOU", 50, 30, 200, 100)), 100, ["I LOVE YOU"]),
]


@pytest.mark.parametrize("words,gap,want", CASES, ids=[c[2][0] for c in CASES])
def test_fixture(spark, words, gap, want):
    assert [b[0] for b in bubbles(spark, words, gap)] == want


def test_union_box_and_empty(spark):
    assert bubbles(spark, [("Top", 20, 10, 60, 30), ("Bottom", 10, 35, 70, 55)], 35)[0][1:] == (10, 10, 70, 55)
    assert bubbles(spark, []) == []


def random_panels(seed, n):
    rng = random.Random(seed)
    rows = []
    for panel in range(n):
        for i in range(rng.randrange(1, 40)):
            x, y = rng.randrange(0, 1200), rng.randrange(0, 900)
            rows.append((1, panel, i, f"w{i}", x, y, x + rng.randrange(0, 90), y + rng.randrange(0, 60)))
    return rows


def model_clusters(words, gap=100):
    def close(a, b):
        (l1, t1, r1, b1), (l2, t2, r2, b2) = a[4:], b[4:]
        w = ((r1 - l1) + (r2 - l2)) / 2
        gh = l1 - r2 if l1 > r2 else l2 - r1
        gv = t1 - b2 if t1 > b2 else t2 - b1
        if gh > max(100, 2.5 * w):
            return False
        tall = max(b1 - t1, b2 - t2)
        if tall and (min(b1, b2) - max(t1, t2)) / tall > 0.5:
            return gh < min(25, 0.8 * w)
        return gv < gap and (min(r1, r2) - max(l1, l2) > 0 or gh < 150)

    root = list(range(len(words)))
    for i in range(len(words)):
        for j in range(i + 1, len(words)):
            if close(words[i], words[j]):
                a, b = root[i], root[j]
                root = [min(a, b) if x in (a, b) else x for x in root]
    return root


def test_clusters_like_the_model_both_ways(spark):
    rows = random_panels(3, 25)
    words = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = {(r.panel_id, r.word_idx): r.cluster_id for r in gr.clusters(words).collect()}
    other = {(r.panel_id, r.word_idx): r.cluster_id for r in gr.components(words, gr.word_edges(words)).collect()}
    want = {}
    for panel in range(25):
        part = [r for r in rows if r[1] == panel]
        want |= {(panel, i): c for i, c in enumerate(model_clusters(part))}
    assert got == want
    assert other == want


def model_lines(ws):
    lines = []
    for w in ws:
        for line in lines:
            if any((h := max(v[7] - v[5], w[7] - w[5])) > 0 and (min(v[7], w[7]) - max(v[5], w[5])) / h > 0.5 for v in line):
                line.append(w)
                break
        else:
            lines.append([w])
    order = sorted(range(len(lines)), key=lambda i: (sum(w[5] for w in lines[i]) / len(lines[i]), i))
    return [w[2] for i in order for w in sorted(lines[i], key=lambda w: (w[4], w[2]))]


def test_reading_order_like_the_model(spark):
    rows = random_panels(9, 20)
    df = spark.createDataFrame(rows, SCHEMA)
    ws = F.array_sort(F.collect_list(F.struct("word_idx", "text", *gr.BOX)))
    got = df.groupBy("panel_id").agg(ws.alias("ws")).select("panel_id", F.transform(gr.reading_order(F.col("ws")), lambda w: w["word_idx"]).alias("o")).collect()
    for r in got:
        assert r.o == model_lines([x for x in rows if x[1] == r.panel_id])


def test_words_are_kept_and_numbered(spark):
    rows = random_panels(5, 12)
    out = gr.group_into_bubbles(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sum(len(b.words) for b in out) == len(rows)
    for panel in range(12):
        orders = sorted(b.reading_order for b in out if b.panel_id == panel)
        assert orders == list(range(1, len(orders) + 1))
    for b in out:
        assert (b.left, b.top, b.right, b.bottom) == (min(w.left for w in b.words), min(w.top for w in b.words), max(w.right for w in b.words), max(w.bottom for w in b.words))


def test_zero_gap_means_default():
    assert Params(max_vertical_gap=0).max_vertical_gap == 100
    assert Params(pause_ms=0).pause_ms == 700


def test_one_shuffle_equals_its_parts(spark):
    """group_into_bubbles against the operators one by one, also on boxes that are upside down, empty or repeated."""
    rows = [(1, p, i, t, x, y, r, b) for _, p, i, t, x, y, r, b in random_panels(7, 12)]
    rng = random.Random(8)
    rows += [(2, p, i, f"v{i}", x := rng.randrange(600), y := rng.randrange(400), x + rng.choice([0, 30, -5]), y + rng.choice([0, 20, -40])) for p in range(6) for i in range(30)]
    rows += [(3, 0, i, f"w{i}", 10 * (i % 70), 120 * (i // 70), 10 * (i % 70) + 9, 120 * (i // 70) + 20 + i % 3) for i in range(700)]
    words = spark.createDataFrame(rows, SCHEMA)
    for p in (Params(), Params(max_vertical_gap=130)):
        whole = gr.group_into_bubbles(words, p)
        parts = gr.build_bubbles(gr.split_clusters(gr.clustered_words(words, p), p), p).select(whole.columns)
        assert whole.count() and whole.exceptAll(parts).count() == 0 and parts.exceptAll(whole).count() == 0


def test_sweep_equals_all_pairs():
    rng = np.random.default_rng(9)
    for _ in range(20):
        n = int(rng.integers(1, 120))
        box = rng.integers(0, 500, (n, 4))
        box[:, 2:] = box[:, :2] + rng.integers(-10, 90, (n, 2))
        panel = np.sort(rng.integers(0, 3, n))
        i, j = np.triu_indices(n, 1)
        keep = gr._close(box[i], box[j], Params()) & (panel[i] == panel[j])
        a, b = gr.close_pairs(box, panel, Params())
        assert sorted(zip(a.tolist(), b.tolist(), strict=True)) == sorted(zip(i[keep].tolist(), j[keep].tolist(), strict=True))


def test_a_panel_of_twenty_thousand_words():
    n = 20_000
    x, y = 60 * (np.arange(n) % 100), 200 * (np.arange(n) // 100)
    box = np.column_stack([x, y, x + 40, y + 24])
    found = gr.bubbles_of_panels(box, np.array([0, n]), Params())
    assert sum(map(len, found[0])) == n and len(found[0]) >= 200


def test_panels_are_grouped_in_runs_of_few_words(monkeypatch):
    rng, seen, inner = np.random.default_rng(1), [], gr.bubbles_of_panels
    n = rng.integers(0, 40, 60)
    low = rng.integers(0, 900, (n.sum(), 2))
    box = np.column_stack([low, low + rng.integers(5, 60, (n.sum(), 2))]).astype(np.int32)
    bounds = np.r_[0, np.cumsum(n)]
    want = [[w.tolist() for w in panel] for panel in inner(box.astype(np.int64), bounds, Params())]
    monkeypatch.setattr(gr, "bubbles_of_panels", lambda box, bounds, p: seen.append(len(box)) or inner(box, bounds, p))
    monkeypatch.setattr(gr, "WORDS_AT_ONCE", 100)
    sides = [pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(box[:, k])) for k in range(4)]
    assert gr.bubble_lists(sides, Params()).to_pylist() == want
    assert sum(seen) == n.sum() and max(seen) <= 100
    assert gr.bubble_lists([x.slice(7, 9) for x in sides], Params()).to_pylist() == want[7:16]
    assert gr.bubble_lists([x.slice(0, 0) for x in sides], Params()).to_pylist() == []


def test_groups_come_whole_and_few_at_a_time():
    class Caught:
        def mapInArrow(self, run, schema):
            self.run = run
            return self

        def __getattr__(self, name):
            return lambda *a: self

    df, calls = Caught(), []

    def fn(table, bounds):
        calls.append((len(table), len(bounds) - 1))
        return pa.table({"k": [table.column("k")[a].as_py() for a in bounds[:-1].tolist()], "n": np.diff(bounds)})

    map_groups(df, ["k"], [], fn, "k long, n long", 20)
    k = np.sort(np.r_[np.random.default_rng(2).integers(0, 50, 300), np.full(500, 25)])  # one group over many batches
    out = [r for b in df.run(pa.RecordBatch.from_arrays([pa.array(x)], ["k"]) for x in np.array_split(k, 12)) for r in b.to_pylist()]
    assert [(r["k"], r["n"]) for r in out] == [(int(a), int(b)) for a, b in zip(*np.unique(k, return_counts=True), strict=True)]
    assert all(n <= 20 or groups == 1 for n, groups in calls)
