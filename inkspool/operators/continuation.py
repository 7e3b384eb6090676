"""Speech that goes on in the next panel: CON1-3, JOIN3-4, LIM1.

Input: bubbles(chapter_id, panel_id, reading_order, text, left, top, right,
bottom) and panels(chapter_id, panel_id, height). A bubble continues if it
touches the bottom of its panel, the next panel's bubble touches the top, both
are aligned, and the text doesn't end a sentence.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions.text import strip
from ..params import DEFAULTS, Params
from .groups import map_groups

BOX = ["left", "top", "right", "bottom"]


def incomplete(text: Column) -> Column:
    """CON1: doesn't end with . ! or ?; blank texts are complete."""
    last = F.right(strip(text), F.lit(1))
    return F.when(last == "", False).otherwise(~last.isin(".", "!", "?"))


def continues(a: g.Box, b: g.Box, text: Column, p: Params = DEFAULTS) -> tuple[Column, Column]:
    """CON2 without the edge tests: (does it match, confidence).

    A sentence end never matches: its best confidence is 0.49. Other texts
    match by alignment alone; blank ones need a like width too.
    """
    aligned = g.horizontal_alignment(a, b) >= p.min_alignment
    wide = g.width_similarity(a, b) >= p.min_width_similarity
    last = F.right(strip(text), F.lit(1))
    match = aligned & F.when(last == "", wide).otherwise(~last.isin(".", "!", "?"))
    return match, F.when(match, F.when(wide & (last != ""), 1.0).otherwise(0.7))


def reason(a: g.Box, b: g.Box, text: Column, p: Params = DEFAULTS) -> Column:
    """CON2: what speaks for a match, in words."""
    part = lambda cond, words: F.when(cond, F.lit(words))
    return F.concat_ws(", ", part(g.horizontal_alignment(a, b) >= p.min_alignment, "aligned"), part(g.width_similarity(a, b) >= p.min_width_similarity, "similar width"), part(incomplete(text), "incomplete sentence"))


def candidates(bubbles: DataFrame, panels: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """JOIN3, LIM1: pairs of a bubble at the bottom of panel k and one at the top of panel k + 1.

    At most ``max_candidates`` bubbles at the bottom, the last ones, take part.
    Bubbles are read once: each goes to the border it touches, which is known
    by the panel above it, and the two sides of a border meet in one group.
    """
    b = F.struct("reading_order", "text", *BOX)
    low, high = F.col("height") - F.col("bottom") <= p.edge_gap_px, F.col("top") <= p.edge_gap_px
    nothing = F.lit(None)
    sides = F.array(F.struct(F.col("panel_id").alias("border"), F.when(low, b).alias("a"), F.when(nothing.isNotNull(), b).alias("b")), F.struct((F.col("panel_id") - 1).alias("border"), F.when(nothing.isNotNull(), b).alias("a"), F.when(high, b).alias("b")))
    h = panels.select("chapter_id", "panel_id", "height")
    at = bubbles.join(h, ["chapter_id", "panel_id"], "left").select("chapter_id", F.inline(sides)).where("a is not null or b is not null")
    # collect_list leaves nulls out
    borders = at.groupBy("chapter_id", "border").agg(F.sort_array(F.collect_list("a"), asc=False).alias("as"), F.collect_list("b").alias("bs")).where((F.size("as") > 0) & (F.size("bs") > 0))
    pairs = borders.select("chapter_id", "border", F.explode(F.slice("as", 1, p.max_candidates)).alias("a"), "bs").select("chapter_id", "border", "a", F.explode("bs").alias("b"))
    return pairs.select("chapter_id", F.col("border").alias("panel_id"), (F.col("border") + 1).alias("next_panel"), *[F.col(f"a.{c}").alias(f"a_{c}") for c in ("reading_order", "text", *BOX)], *[F.col(f"b.{c}").alias(f"b_{c}") for c in ("reading_order", *BOX)])


def matches(bubbles: DataFrame, panels: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """CON2 over JOIN3: accepted pairs with confidence and reason."""
    match, confidence = continues(g.Box.of("a_"), g.Box.of("b_"), F.col("a_text"), p)
    why = reason(g.Box.of("a_"), g.Box.of("b_"), F.col("a_text"), p)
    found = candidates(bubbles, panels, p).withColumns({"confidence": confidence, "reason": why}).where(match)
    return found.select("chapter_id", "panel_id", "next_panel", F.col("a_reading_order").alias("prev_order"), F.col("b_reading_order").alias("next_order"), "confidence", "reason")


def greedy(found: DataFrame) -> DataFrame:
    """JOIN4: each earlier bubble, in order, takes its first match that is still free. JVM only."""
    per = found.groupBy("chapter_id", "panel_id", "next_panel").agg(F.array_sort(F.collect_list(F.struct("prev_order", "next_order", "confidence"))).alias("ms"))
    start = F.struct(F.slice(F.col("ms"), 1, 0).alias("taken"))

    def step(acc: Column, m: Column) -> Column:
        clash = F.exists(acc["taken"], lambda t: (t["prev_order"] == m["prev_order"]) | (t["next_order"] == m["next_order"]))
        return F.struct(F.when(clash, acc["taken"]).otherwise(F.concat(acc["taken"], F.array(m))).alias("taken"))

    taken = per.withColumn("t", F.explode(F.aggregate("ms", start, step)["taken"]))
    return taken.select("chapter_id", "panel_id", "next_panel", "t.prev_order", "t.next_order", "t.confidence")


MERGED = "chapter_id long, bubble_idx int, panel_id int, reading_order int, text string, left int, top int, right int, bottom int, parts int, word_count long"


def fold_chapter(rows: list[dict], p: Params = DEFAULTS) -> list[dict]:
    """CON3 for one chapter, exactly as it is defined: panels in order, one list of merged bubbles.

    ``rows`` has panels in order, each with height (None: edges aren't tested)
    and its list of bubbles. A merged bubble keeps its place and reading order,
    gets the later box, panel and the joined text.
    """
    out: list[dict] = []
    before = None
    alone = len(rows) == 1
    for k, panel in enumerate(rows):
        new = panel["bubbles"]
        if not new:
            continue
        used: set[int] = set()
        if before is not None and before == k - 1 and not alone:
            height = rows[before]["height"]
            slots = []
            for i in range(len(out) - 1, -1, -1):
                if height is not None and height - out[i]["bottom"] > p.edge_gap_px:
                    continue
                slots.append(i)
                if len(slots) == p.max_candidates:
                    break
            tops = [j for j, b in enumerate(new) if height is None or b["top"] <= p.edge_gap_px]
            for i in reversed(slots):
                for j in tops:
                    if j in used or (out[i]["panel_id"] >= 0 and new[j]["panel_id"] >= 0 and new[j]["panel_id"] - out[i]["panel_id"] > 1):
                        continue
                    if _matches(out[i], new[j], p):
                        old, b = out[i], new[j]
                        out[i] = b | {"text": f"{old['text']} {b['text']}", "reading_order": old["reading_order"], "parts": old["parts"] + 1, "word_count": old["word_count"] + b["word_count"]}
                        used.add(j)
                        break
        out += [dict(b) for j, b in enumerate(new) if j not in used]
        before = k
    return out


def _matches(a: dict, b: dict, p: Params) -> bool:
    wa, wb = a["right"] - a["left"], b["right"] - b["left"]
    shared = max(0, min(a["right"], b["right"]) - max(a["left"], b["left"]))
    if not shared or not min(wa, wb):
        return False
    share, mean = shared / min(wa, wb), (wa + wb) / 2
    apart = abs((a["left"] + a["right"]) / 2 - (b["left"] + b["right"]) / 2)
    if mean > 0 and apart > 0.5 * mean:
        share *= 1 - 0.5 * min(1.0, apart / mean)
    if min(1.0, share) < p.min_alignment:
        return False
    last = a["text"].strip()[-1:]
    if not last:
        return max(wa, wb) > 0 and min(wa, wb) / max(wa, wb) >= p.min_width_similarity
    return last not in ".!?"


def merge(bubbles: DataFrame, panels: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """CON3: exact fold per chapter. Panels without bubbles take part, as they break adjacency."""
    b = bubbles if "word_count" in bubbles.columns else bubbles.withColumn("word_count", F.size("words").cast("long"))
    item = F.struct("panel_id", "reading_order", "text", *BOX, F.lit(1).alias("parts"), F.col("word_count").cast("long").alias("word_count"))
    lists = b.groupBy("chapter_id", "panel_id").agg(F.collect_list(item).alias("bubbles"))
    rows = panels.select("chapter_id", "panel_id", "height").join(lists, ["chapter_id", "panel_id"], "left")

    def run(table: pa.Table, bounds) -> pa.Table:
        out = []
        for a, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            part = table.slice(a, e - a).to_pylist()
            for r in part:
                r["bubbles"] = sorted(r["bubbles"] or [], key=lambda x: x["reading_order"])
            out += [x | {"chapter_id": part[0]["chapter_id"], "bubble_idx": i} for i, x in enumerate(fold_chapter(part, p))]
        names = [f.split()[0] for f in MERGED.split(", ")]
        types = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64()]
        return pa.table({n: pa.array([x[n] for x in out], t) for n, t in zip(names, types, strict=True)})

    return map_groups(rows, ["chapter_id"], ["panel_id"], run, MERGED, most=512)  # panels; they become Python objects


def merge_native(bubbles: DataFrame, panels: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """CON3 without Python: greedy matches per pair of panels, then chains along them.

    Which pairs match depends on original bubbles only, so all pairs of panels
    are matched at once. A chapter's matches, in the order of panels, are then
    folded into a map from each bubble to the first one of its chain. Differs
    from the fold only where more than ``max_candidates`` bubbles wait at one
    edge.
    """
    name = lambda panel, order: panel.cast("long") * 1_000_000 + order
    links = greedy(matches(bubbles, panels, p))
    per = links.groupBy("chapter_id").agg(F.array_sort(F.collect_list(F.struct("panel_id", "prev_order", "next_panel", "next_order"))).alias("ls"))

    def follow(heads: Column, x: Column) -> Column:
        before, after = name(x["panel_id"], x["prev_order"]), name(x["next_panel"], x["next_order"])
        return F.map_concat(heads, F.create_map(after, F.coalesce(F.try_element_at(heads, before), before)))

    heads = per.select("chapter_id", F.aggregate("ls", F.expr("cast(map() as map<bigint, bigint>)"), follow).alias("heads"))
    node = bubbles.select("chapter_id", "panel_id", "reading_order", "text", *BOX).join(heads, "chapter_id", "left")
    own = name(F.col("panel_id"), F.col("reading_order"))
    node = node.withColumn("head", F.coalesce(F.try_element_at("heads", own), own)).drop("heads")
    part = F.struct("panel_id", "reading_order", "text", *BOX)
    chains = node.groupBy("chapter_id", "head").agg(F.array_sort(F.collect_list(part)).alias("ps"))
    last = F.element_at("ps", -1)
    return chains.select("chapter_id", last["panel_id"].alias("panel_id"), F.col("ps")[0]["reading_order"].alias("reading_order"), F.array_join(F.transform("ps", lambda x: x["text"]), " ").alias("text"), *[last[c].alias(c) for c in BOX], F.size("ps").alias("parts"))
