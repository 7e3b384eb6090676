"""SQL forms of the expressions, for DuckDB. Its regular expressions have no lookaround and no back-references.

A pattern between two letters is therefore replaced with the letters captured,
twice, as one letter may serve two matches; runs of one character are found in
lists of characters.
"""

from __future__ import annotations

from .. import lexicon
from ..functions.text import SPOKEN


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sub(x: str, pattern: str, by: str) -> str:
    return f"regexp_replace({x}, {q(pattern)}, {q(by)}, 'g')"


def between(x: str, a: str, pattern: str, b: str, by: str) -> str:
    for _ in range(2):
        x = sub(x, f"([{a}]){pattern}([{b}])", rf"\1{by}\2")
    return x


def strip(x: str) -> str:
    return sub(x, r"^\s+|\s+$", "")


def normalize(x: str) -> str:
    az = "a-zA-Z"
    x = sub(x, r"\.{3,}", " ")
    x = f"replace({x}, '…', ' ')"
    x = between(x, az, r"\.{1,2}", az, " ")
    x = sub(sub(x, "!{3,}", "!"), r"\?{3,}", "?")
    x = between(x, az, r"[~`{}\[\]|\\]+", az, " ")
    x = sub(x, r"[~`{}\[\]|\\]", "")
    for s, w in SPOKEN:
        x = f"replace({x}, {q(s)}, {q(f' {w} ')})"
    x = sub(x, r"\s+-\s+", " ")
    x = between(x, az, "--+", az, " ")
    x = strip(sub(x, r"\s+", " "))
    x = sub(x, r"\s+([!?.,;:])", r"\1")
    x = sub(x, r"([.!?])([A-Z])", r"\1 \2")
    return sub(x, r"\*+", " ")


def clean_artifacts(x: str) -> str:
    x = sub(x, r"\s+[^\pL\pN_\s!?.,;:—-]\s+", " ")
    x = strip(sub(x, r"\s{2,}", " "))
    return sub(x, r"\s+[–—]\s+", " ")


def fix_ocr_errors(x: str) -> str:
    for d, u, w in (("0", "O", "o"), ("1", "I", "l")):
        x = between(between(x, "A-Z", d, "A-Z", u), "a-z", d, "a-z", w)
    return sub(x, r"\b\d+([a-zA-Z])", r"\1")


def shifted(x: str, back: int) -> str:
    """List of structs: each character of x, then the ones before it."""
    lists, prior = [f"string_split({x}, '')"], f"string_split({x}, '')"
    for _ in range(back):
        prior = f"list_prepend(NULL, {prior})"
        lists.append(prior)
    return f"list_zip({', '.join(lists)})"


RUN = "z[1] IS NOT NULL AND z[1] <> chr(10) AND z[1] IS NOT DISTINCT FROM z[2] AND z[1] IS NOT DISTINCT FROM z[3]"


def limit_repeats(x: str) -> str:
    kept = f"list_filter({shifted(x, 2)}, lambda z: z[1] IS NOT NULL AND NOT ({RUN}))"
    return f"array_to_string(list_transform({kept}, lambda z: z[1]), '')"


def fix_corruptions(x: str) -> str:
    x = sub(x, r"\b\d+([a-zA-Z])", r"\1")
    x = sub(x, r"([a-zA-Z])\d+\b", r"\1")
    x = between(x, "a-zA-Z", r"\d+", "a-zA-Z", "")
    x = sub(x, r"^[^a-zA-Z]+([a-zA-Z])", r"\1")
    return strip(sub(x, r"\s+", " "))


def fold(x: str) -> str:
    return sub(strip(f"lower({x})"), r"\s+", " ")


def words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '\\s+'), lambda w: w <> '')"


def tokens(x: str) -> str:
    return words(sub(f"replace(lower({x}), '''', '')", r"[^\pL\pN_\s-]", " "))


def in_list(x: str, items) -> str:
    return f"{x} IN ({', '.join(q(i) for i in sorted(items))})"


def ratio(a: str, b: str) -> str:
    return f"CASE WHEN {b} > 0 THEN CAST({a} AS DOUBLE) / {b} ELSE 0.0 END"


def dictionary_ratio(tok: str) -> str:
    return ratio(f"len(list_filter({tok}, lambda w: {in_list('w', lexicon.DICTIONARY)}))", f"len({tok})")


def alphabet_ratio(x: str) -> str:
    return ratio(f"length({sub(x, '[^\\pL]', '')})", f"length(replace({x}, ' ', ''))")


def table(scores: dict[str, float]) -> str:
    return "MAP {" + ", ".join(f"{q(k)}: {v}::DOUBLE" for k, v in sorted(scores.items())) + "}"


def word_frequency(tok: str) -> str:
    return f"CASE WHEN len({tok}) > 0 THEN list_sum(list_transform({tok}, lambda w: coalesce({table(lexicon.WORD_SCORES)}[w], {lexicon.UNKNOWN_WORD}))) / len({tok}) ELSE {lexicon.UNKNOWN_WORD} END"


def trigram_score(x: str) -> str:
    s = sub(fold(x), "[^a-z]", "")
    grams = f"list_transform(list_filter({shifted(s, 2)}, lambda z: z[1] IS NOT NULL AND z[3] IS NOT NULL), lambda z: z[3] || z[2] || z[1])"
    return f"CASE WHEN length({s}) > 2 THEN list_sum(list_transform({grams}, lambda g: coalesce({table(lexicon.TRIGRAM_SCORES)}[g], {lexicon.UNKNOWN_TRIGRAM}))) / (length({s}) - 2) ELSE {lexicon.UNKNOWN_TRIGRAM} END"


def ocr_noise(x: str) -> str:
    shown = f"replace({x}, ' ', '')"
    n, an = f"length({shown})", f"length({sub(x, '[^\\pL\\pN]', '')})"
    runs = f"len(list_filter({shifted(x, 3)}, lambda z: {RUN} AND z[1] IS DISTINCT FROM z[4]))"
    sym, alpha = ratio(f"({n} - {an})", n), alphabet_ratio(x)
    return f"""CASE WHEN {strip(x)} = '' THEN 1.0 ELSE least(1.0,
      CASE WHEN {runs} > 0 THEN least(1.0, {runs} * 3.0::DOUBLE / length({x})) * 0.4::DOUBLE ELSE 0.0 END
      + CASE WHEN ({sym}) > 0.4::DOUBLE THEN (({sym}) - 0.4::DOUBLE) * 0.5 ELSE 0.0 END
      + CASE WHEN ({alpha}) < 0.3::DOUBLE THEN (0.3::DOUBLE - ({alpha})) * 0.3::DOUBLE ELSE 0.0 END
      + CASE WHEN len(list_distinct(string_split({shown}, ''))) <= 2 AND length({strip(x)}) > 2 THEN 0.5 ELSE 0.0 END
      + CASE WHEN {n} > 0 AND {an} = 0 THEN 0.6::DOUBLE ELSE 0.0 END) END"""


def punctuation_count(x: str) -> str:
    return f"(length({x}) - length(translate({x}, '.,!?;:-—…', '')))"


def known_short(x: str, tok: str) -> str:
    return f"(len({tok}) <= 2 AND {in_list(sub(fold(x), '[^a-z]', ''), lexicon.SHORT_DIALOGUE)})"


def loud(x: str, tok: str) -> str:
    return f"(len({tok}) <= 2 AND (contains({x}, '!') OR contains({x}, '?') OR contains({x}, '...')))"


def any_of(x: str, parts) -> str:
    return "(" + " OR ".join(f"contains({x}, {q(p)})" for p in parts) + ")"


# boxes: columns named <prefix>left and so on


def col(p: str, n: str) -> str:
    return f'{p}"{n}"' if not p or p.endswith(".") else f'"{p}{n}"'


def box(p: str) -> dict[str, str]:
    d = {n: col(p, n) for n in ("left", "top", "right", "bottom")}
    return d | {"w": f"({d['right']} - {d['left']})", "h": f"({d['bottom']} - {d['top']})"}


def vertical_overlap(a: str, b: str) -> str:
    x, y = box(a), box(b)
    return ratio(f"(least({x['bottom']}, {y['bottom']}) - greatest({x['top']}, {y['top']}))", f"greatest({x['h']}, {y['h']})")


def horizontal_gap(a: str, b: str) -> str:
    x, y = box(a), box(b)
    return f"CASE WHEN {x['left']} > {y['right']} THEN {x['left']} - {y['right']} ELSE {y['left']} - {x['right']} END"


def vertical_gap(a: str, b: str) -> str:
    x, y = box(a), box(b)
    return f"CASE WHEN {x['top']} > {y['bottom']} THEN {x['top']} - {y['bottom']} ELSE {y['top']} - {x['bottom']} END"


def words_close(a: str, b: str) -> str:
    x, y = box(a), box(b)
    gap, mean = f"({horizontal_gap(a, b)})", f"(({x['w']} + {y['w']}) / 2.0::DOUBLE)"
    return f"""CASE WHEN {gap} > greatest(100.0::DOUBLE, 2.5::DOUBLE * {mean}) THEN false
      WHEN ({vertical_overlap(a, b)}) > 0.5 THEN {gap} < least(25.0::DOUBLE, 0.8::DOUBLE * {mean})
      ELSE ({vertical_gap(a, b)}) < 100 AND (least({x['right']}, {y['right']}) - greatest({x['left']}, {y['left']}) > 0 OR {gap} < 150) END"""


def horizontal_alignment(a: str, b: str) -> str:
    x, y = box(a), box(b)
    ov = f"greatest(0, least({x['right']}, {y['right']}) - greatest({x['left']}, {y['left']}))"
    narrow, mean = f"least({x['w']}, {y['w']})", f"(({x['w']} + {y['w']}) / 2.0::DOUBLE)"
    apart = f"abs(({x['left']} + {x['right']}) / 2.0::DOUBLE - ({y['left']} + {y['right']}) / 2.0::DOUBLE)"
    share = f"(CAST({ov} AS DOUBLE) / {narrow})"
    return f"CASE WHEN {ov} = 0 OR {narrow} = 0 THEN 0.0 ELSE least(1.0, CASE WHEN {mean} > 0 AND {apart} > 0.5 * {mean} THEN {share} * (1 - 0.5 * least(1.0, {apart} / {mean})) ELSE {share} END) END"


def width_similarity(a: str, b: str) -> str:
    x, y = box(a)["w"], box(b)["w"]
    return f"CASE WHEN {x} = 0 OR {y} = 0 THEN 0.0 ELSE CAST(least({x}, {y}) AS DOUBLE) / greatest({x}, {y}) END"
