"""Words of a panel to speech bubbles: JOIN1-2, WIN1-4, SORT1-2, AGG1, GRP, SNK3-4.

Input: words(chapter_id, panel_id, word_idx, text, left, top, right, bottom).
Equal keys are settled by word_idx throughout.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..params import DEFAULTS, Params
from .groups import map_groups, runs_of_groups

PANEL = ["chapter_id", "panel_id"]
BOX = ["left", "top", "right", "bottom"]


def words_close(a: g.Box, b: g.Box, p: Params = DEFAULTS) -> Column:
    """JOIN1's predicate on two boxes of one panel."""
    gap = g.horizontal_gap(a, b)
    width = (a.width + b.width) / 2.0
    near_line = gap < F.least(F.lit(p.same_line_gap_px), p.same_line_gap_widths * width)
    shared = F.least(a.right, b.right) - F.greatest(a.left, b.left) > 0
    stacked = (g.vertical_gap(a, b) < p.max_vertical_gap) & (shared | (gap < p.stacked_gap_px))
    return F.when(gap > F.greatest(F.lit(p.wide_reject_px), p.wide_reject_widths * width), False).when(g.vertical_overlap(a, b) > p.same_line_overlap, near_line).otherwise(stacked)


def word_edges(words: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """JOIN1: (chapter_id, panel_id, src, dst), src < dst, of close words.

    Close words are never farther apart than the vertical limit and their own
    heights allow, so Catalyst joins on the panel and tests the rest in the
    join itself; pairs are not materialised.
    """
    a, b = (words.select(*PANEL, *[F.col(c).alias(f"{s}_{c}") for c in ("word_idx", *BOX)]) for s in "ab")
    cond = (a.a_word_idx < b.b_word_idx) & words_close(g.Box.of("a_"), g.Box.of("b_"), p)
    joined = a.join(b.withColumnsRenamed({k: f"b_{k}" for k in PANEL}), (F.col("chapter_id") == F.col("b_chapter_id")) & (F.col("panel_id") == F.col("b_panel_id")) & cond)
    return joined.select(*PANEL, F.col("a_word_idx").alias("src"), F.col("b_word_idx").alias("dst"))


def smallest_member(n: int, src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """Smallest member of each node's component: roots of edges join, and labels jump to their label's label."""
    label = np.arange(n)
    while len(src):
        a, b = label[src], label[dst]
        apart = a != b
        src, dst, a, b = src[apart], dst[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label[label] != label).any():
            label = label[label]
    return label


#: Pairs of words that are tested at a time.
PAIRS_AT_ONCE = 1 << 17
#: Words that are grouped at a time; a panel that has more is taken alone.
WORDS_AT_ONCE = 1 << 15


CLUSTER_SCHEMA = "chapter_id long, panel_id int, word_idx int, cluster_id int"


def _close(a: np.ndarray, b: np.ndarray, p: Params) -> np.ndarray:
    """JOIN1's predicate on rows of boxes; a comes before b in its panel."""
    (l1, t1, r1, b1), (l2, t2, r2, b2) = a.T, b.T
    gap = np.where(l1 > r2, l1 - r2, l2 - r1)
    width = ((r1 - l1) + (r2 - l2)) / 2.0
    keep = gap <= np.maximum(p.wide_reject_px, p.wide_reject_widths * width)
    down = np.where(t1 > b2, t1 - b2, t2 - b1)
    line = gap < np.minimum(p.same_line_gap_px, p.same_line_gap_widths * width)
    stacked = (down < p.max_vertical_gap) & ((np.minimum(r1, r2) - np.maximum(l1, l2) > 0) | (gap < p.stacked_gap_px))
    return keep & np.where(_overlap(a, b) > p.same_line_overlap, line, stacked)


def _overlap(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """GEO3 on rows of boxes."""
    tall = np.maximum(a[..., 3] - a[..., 1], b[..., 3] - b[..., 1])
    shared = np.minimum(a[..., 3], b[..., 3]) - np.maximum(a[..., 1], b[..., 1])
    return np.divide(shared, tall, out=np.zeros(np.broadcast(shared, tall).shape), where=tall > 0)


def close_pairs(box: np.ndarray, panel: np.ndarray, p: Params) -> tuple[np.ndarray, np.ndarray]:
    """JOIN1 on the words of many panels, whose numbers ascend: (i, j), i < j.

    Words are sorted by top, and each is tested with those whose top lies
    within its reach below: one that starts lower can't be close. So the work
    follows the words near each other, not the square of a panel.
    """
    n = len(box)
    order = np.lexsort((box[:, 1], panel))
    top, of = box[order, 1], panel[order]
    span = int(top.max() - top.min()) + 2 if n else 1
    place = of * span + (top - (top.min() if n else 0))
    reach = np.minimum(np.maximum(box[order, 3], top) + p.max_vertical_gap - (top.min() if n else 0), span - 1)
    last = np.searchsorted(place, of * span + reach, side="left")
    upside = np.isin(of, of[box[order, 3] < top])  # a box whose bottom lies above its top may be close to any
    last = np.where(upside, np.searchsorted(of, of, side="right"), last)
    count = np.maximum(last - np.arange(n) - 1, 0)
    run, src, dst, a = np.cumsum(count), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
    while a < n:
        e = max(a + 1, int(np.searchsorted(run, (run[a - 1] if a else 0) + PAIRS_AT_ONCE, side="right")))
        c = count[a:e]
        x = np.repeat(np.arange(a, e), c)
        y = x + 1 + np.arange(len(x)) - np.repeat(np.cumsum(c) - c, c)
        i, j = np.minimum(order[x], order[y]), np.maximum(order[x], order[y])
        keep = _close(box[i], box[j], p)
        src.append(i[keep]), dst.append(j[keep])
        a = e
    return np.concatenate(src), np.concatenate(dst)


def _first_rows(label: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Where in ``order``, which sorts by label, each label starts."""
    x = label[order]
    return np.flatnonzero(np.r_[len(x) > 0, x[1:] != x[:-1]])


def islands(box: np.ndarray, label: np.ndarray, p: Params) -> np.ndarray:
    """WIN1-3 on clusters of many panels: the running number of cuts for each word."""
    order = np.argsort(label, kind="stable")
    at = _first_rows(label, order)
    size = np.diff(np.r_[at, len(order)])
    low, high = (f.reduceat(box[order], at, axis=0) if len(at) else box for f in (np.minimum, np.maximum))
    axis = np.where(high[:, 2] - low[:, 0] > p.wide_bubble_px, 1, np.where(high[:, 3] - low[:, 1] > p.tall_bubble_px, 2, 0))
    each = np.empty(len(box), np.int64)
    each[order] = np.repeat(axis, size)
    from_, to = np.where(each == 2, box[:, 1], box[:, 0]), np.where(each == 2, box[:, 3], box[:, 2])
    order = np.lexsort((np.arange(len(box)), from_, label))
    b, k = box[order], each[order]
    gap = np.r_[0, from_[order][1:] - to[order][:-1]]
    width = b[:, 2] - b[:, 0]
    wide = np.minimum(p.wide_cut_px, np.maximum(p.wide_cut_floor_px, p.wide_cut_widths * (np.r_[0, width[:-1]] + width) / 2.0))
    cut = np.where(k == 1, gap > wide, (k == 2) & (gap > p.tall_cut_px))
    cut[at] = False
    run = np.cumsum(cut)
    out = np.empty(len(box), np.int64)
    out[order] = run - np.repeat(run[at], size)
    return out


def read_words(box: np.ndarray, p: Params) -> np.ndarray:
    """WIN4, SORT1: positions of one bubble's words in reading order."""
    n = len(box)
    if n < 2:
        return np.arange(n)
    over = _overlap(box[:, None], box[None, :]) > p.same_line_overlap if n <= 1024 else None
    line, lines = np.zeros(n, np.int64), 0
    for i in range(n):
        same = over[i, :i] if over is not None else _overlap(box[i], box[:i]) > p.same_line_overlap
        met = line[:i][same]
        if len(met):
            line[i] = met.min()
        else:
            line[i], lines = lines, lines + 1
    top = np.bincount(line, box[:, 1]) / np.bincount(line)
    return np.lexsort((np.arange(n), box[:, 0], line, top[line]))


def bubbles_of_panels(box: np.ndarray, bounds: np.ndarray, p: Params) -> list[list[np.ndarray]]:
    """Words of each panel, from bounds[k] to bounds[k + 1], as bubbles in reading order: positions of their words in theirs."""
    panel = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    label = smallest_member(len(box), *close_pairs(box, panel, p))
    island = islands(box, label, p)
    order = np.lexsort((np.arange(len(box)), island, label))
    key = np.column_stack([label, island])[order]
    at = np.flatnonzero(np.r_[len(key) > 0, (key[1:] != key[:-1]).any(axis=1)])
    parts = np.split(order, at[1:]) if len(at) else []
    low = np.minimum.reduceat(box[order], at, axis=0) if len(at) else box
    out: list[list[np.ndarray]] = [[] for _ in range(len(bounds) - 1)]
    for k in np.lexsort((key[at, 1], key[at, 0], low[:, 0], low[:, 1])).tolist():
        rows, of = parts[k], int(panel[parts[k][0]])
        out[of].append(rows[read_words(box[rows], p)] - bounds[of])
    return out


def bubble_lists(sides: list[pa.Array], p: Params) -> pa.Array:
    """``bubbles_of_panels`` on lists of the words' sides, one a panel; of few panels at a time, so that memory doesn't follow the batch."""
    bounds = sides[0].offsets.to_numpy().astype(np.int64)
    bounds = bounds - bounds[0]
    none = np.zeros(0, np.int32)
    places, sizes, counts = [none], [none], [none]
    for a, e in runs_of_groups(bounds, WORDS_AT_ONCE):
        box = np.column_stack([x.slice(a, e - a).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for x in sides])
        found = bubbles_of_panels(box, bounds[a : e + 1] - bounds[a], p)
        words_ = [w for panel in found for w in panel]
        places.append(np.concatenate([none, *words_]).astype(np.int32))
        sizes.append(np.array([len(w) for w in words_], np.int32))
        counts.append(np.array([len(x) for x in found], np.int32))
    lists = lambda n, values: pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(np.concatenate(n))].astype(np.int32)), values)
    return lists(counts, lists(sizes, pa.array(np.concatenate(places))))


def clusters(words: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """JOIN1 and JOIN2 in one: (chapter_id, panel_id, word_idx, cluster_id), cluster_id the smallest word_idx.

    Components never cross panels, so each is found inside its panel, in numpy.
    """

    def run(table: pa.Table, bounds: np.ndarray) -> pa.Table:
        box = np.column_stack([table.column(c).to_numpy().astype(np.int64) for c in BOX])
        idx = table.column("word_idx").to_numpy()
        panel = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        out = idx[smallest_member(len(idx), *close_pairs(box, panel, p))].astype(np.int32)
        return table.select([*PANEL, "word_idx"]).append_column("cluster_id", pa.array(out))

    return map_groups(words.select(*PANEL, "word_idx", *BOX), PANEL, ["word_idx"], run, CLUSTER_SCHEMA)


def components(words: DataFrame, edges: DataFrame) -> DataFrame:
    """JOIN2 on given edges: (chapter_id, panel_id, word_idx, cluster_id)."""
    rows = words.select(*PANEL, F.col("word_idx").alias("src"), F.col("word_idx").alias("dst")).unionByName(edges.select(*PANEL, "src", "dst"))

    def run(table: pa.Table, bounds: np.ndarray) -> pa.Table:
        src, dst = (table.column(c).to_numpy() for c in ("src", "dst"))
        row, label = [], []
        for a, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            nodes = np.unique(src[a:e])
            low = smallest_member(len(nodes), np.searchsorted(nodes, src[a:e]), np.searchsorted(nodes, dst[a:e]))
            row.append(a + np.flatnonzero(src[a:e] == dst[a:e]))
            label.append(nodes[low])
        picked = table.take(pa.array(np.concatenate(row)))
        return pa.table({"chapter_id": picked.column("chapter_id"), "panel_id": picked.column("panel_id"), "word_idx": picked.column("src"), "cluster_id": pa.array(np.concatenate(label).astype(np.int32))})

    return map_groups(rows, PANEL, ["src", "dst"], run, CLUSTER_SCHEMA)


def split_clusters(clustered: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """WIN1-3: adds ``island``, the running number of cuts in a cluster that is too wide, or else too tall.

    One pass; pieces are not tested again. Input: words with cluster_id.
    """
    key = [*PANEL, "cluster_id"]
    whole = W.partitionBy(*key)
    size = clustered.withColumns({"_w": F.max("right").over(whole) - F.min("left").over(whole), "_h": F.max("bottom").over(whole) - F.min("top").over(whole)})
    size = size.withColumn("axis", F.when(F.col("_w") > p.wide_bubble_px, 1).when(F.col("_h") > p.tall_bubble_px, 2).otherwise(0))
    # one ordering serves both axes: a cluster is cut along one of them only
    along = size.withColumns({"_a": F.when(F.col("axis") == 2, F.col("top")).otherwise(F.col("left")), "_e": F.when(F.col("axis") == 2, F.col("bottom")).otherwise(F.col("right"))})
    order = whole.orderBy("_a", "word_idx")
    gap = F.col("_a") - F.lag("_e").over(order)
    width = F.col("right") - F.col("left")
    wide = F.least(F.lit(p.wide_cut_px), F.greatest(F.lit(p.wide_cut_floor_px), p.wide_cut_widths * (F.lag(width).over(order) + width) / 2.0))
    along = along.withColumn("_cut", F.when(F.col("axis") == 1, gap > wide).when(F.col("axis") == 2, gap > p.tall_cut_px).otherwise(False))
    island = F.sum(F.coalesce(F.col("_cut").cast("int"), F.lit(0))).over(order.rowsBetween(W.unboundedPreceding, 0))
    return along.withColumn("island", island.cast("int")).drop("_w", "_h", "_a", "_e", "_cut")


def lines_first_fit(words: Column, p: Params = DEFAULTS) -> Column:
    """WIN4: array of words, by word_idx, to an array of lines; a word joins the first line with a word it overlaps."""

    def overlaps(a: Column, b: Column) -> Column:
        tall = F.greatest(a["bottom"] - a["top"], b["bottom"] - b["top"])
        shared = F.least(a["bottom"], b["bottom"]) - F.greatest(a["top"], b["top"])
        return F.when(tall > 0, shared / tall.cast("double") > p.same_line_overlap).otherwise(False)

    def place(lines: Column, w: Column) -> Column:
        fits = F.transform(lines, lambda line: F.exists(line, lambda v: overlaps(v, w)))
        at = F.array_position(fits, True)
        return F.when(at == 0, F.concat(lines, F.array(F.array(w)))).otherwise(F.transform(lines, lambda line, i: F.when(i + 1 == at, F.concat(line, F.array(w))).otherwise(line)))

    # the empty start has the type of the words: an array without any line of them
    return F.aggregate(words, F.slice(F.array(words), 1, 0), place)


def reading_order(words: Column, p: Params = DEFAULTS) -> Column:
    """SORT1: lines by mean top, words in a line by left; of equals the earlier line and word."""

    def mean_top(line: Column) -> Column:
        return F.aggregate(line, F.lit(0).cast("long"), lambda s, w: s + w["top"]) / F.size(line).cast("double")

    lines = F.transform(lines_first_fit(words, p), lambda line, i: F.struct(mean_top(line).alias("y"), i.alias("i"), F.array_sort(F.transform(line, lambda w: F.struct(w["left"].alias("left"), w["word_idx"].alias("word_idx"), w.alias("w")))).alias("ws")))
    return F.when(F.size(words) <= 1, words).otherwise(F.flatten(F.transform(F.array_sort(F.transform(lines, lambda x: F.struct(x["y"].alias("y"), x["i"].alias("i"), x["ws"].alias("ws")))), lambda x: F.transform(x["ws"], lambda v: v["w"]))))


def build_bubbles(split: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """AGG1, SORT2: bubbles(chapter_id, panel_id, reading_order, text, left, top, right, bottom, words)."""
    word = F.struct("word_idx", "text", *BOX)
    grouped = split.groupBy(*PANEL, "cluster_id", "island").agg(F.array_sort(F.collect_list(word)).alias("ws"), *g.union())
    read = grouped.withColumn("words", reading_order(F.col("ws"), p)).drop("ws")
    by_place = W.partitionBy(*PANEL).orderBy("top", "left", "cluster_id", "island")
    return read.select(*PANEL, F.row_number().over(by_place).alias("reading_order"), F.array_join(F.transform("words", lambda w: w["text"]), " ").alias("text"), *BOX, "words")


def clustered_words(words: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Words with cluster_id. Boxes travel to Python, texts don't."""
    return words.join(clusters(words, p), [*PANEL, "word_idx"])


def group_into_bubbles(words: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """GRP: JOIN1 and 2, WIN1 to 4, SORT1 and 2, AGG1 in one shuffle.

    A panel's words become one row; their boxes go to Python, which returns the
    bubbles as lists of positions; words are put in place in the JVM. Rows stay
    hashed by panel, so later steps by panel don't shuffle again. Gives the same
    as ``build_bubbles(split_clusters(clustered_words(words)))``.
    """

    @F.arrow_udf("array<array<int>>")
    def bubbles(left: pa.Array, top: pa.Array, right: pa.Array, bottom: pa.Array) -> pa.Array:
        return bubble_lists([left, top, right, bottom], p)

    word = F.struct("word_idx", "text", *BOX)
    panels = words.groupBy(*PANEL).agg(F.array_sort(F.collect_list(word)).alias("ws"))
    each = lambda words, c: F.transform(words, lambda w: w[c])
    one = panels.select(*PANEL, "ws", F.posexplode(bubbles(*[each("ws", c) for c in BOX])).alias("at", "found"))
    placed = one.select(*PANEL, (F.col("at") + 1).alias("reading_order"), F.transform("found", lambda i: F.get("ws", i)).alias("words"))
    box = [f(each("words", c)).alias(c) for f, c in zip((F.array_min, F.array_min, F.array_max, F.array_max), BOX, strict=True)]
    return placed.select(*PANEL, "reading_order", F.array_join(each("words", "text"), " ").alias("text"), *box, "words")


def with_metadata(bubbles: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """SNK4: one row a panel with its bubbles, their number, the number of words and the settings."""
    b = F.struct("reading_order", "text", *BOX, F.size("words").alias("word_count"))
    return bubbles.groupBy(*PANEL).agg(F.array_sort(F.collect_list(b)).alias("bubbles"), F.count("*").alias("total_bubbles"), F.sum(F.size("words")).alias("total_words")).withColumns({"max_vertical_gap": F.lit(p.max_vertical_gap), "max_center_shift": F.lit(p.max_center_shift)})


def box_json(box: g.Box) -> Column:
    """SNK3: a box as JSON."""
    return F.to_json(F.struct(box.left.alias("left"), box.top.alias("top"), box.right.alias("right"), box.bottom.alias("bottom"), box.width.alias("width"), box.height.alias("height")))


def bubble_json(bubbles: DataFrame) -> DataFrame:
    """SNK3: a bubble as JSON, with its number of words."""
    return bubbles.select(*PANEL, "reading_order", F.to_json(F.struct("text", "reading_order", *BOX, F.size("words").alias("word_count"))).alias("json"))
