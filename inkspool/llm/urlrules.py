"""URL filtering by pattern rules indexed by their rarest literal token (operator 3).

Rules use the common ad-block notation: ``||host`` anchors at a host label,
``|`` at the start or end, ``*`` matches anything, ``^`` a separator or the
end, ``@@`` makes an exception. ``/…/`` is a regular expression over the whole
URL. Options after ``$`` aren't supported and refused. A rule's literal tokens are the runs of [a-z0-9] that must stand in a URL
as a whole token. The rule is filed under the one that is rarest in the corpus
of URLs; the tokens of a URL fetch the rules filed under them, and only those
run their regular expression. Rules without such a token are candidates always.

Matching ignores case. A URL's verdict is "allow" if any exception matches,
else "block" if any rule does, else "none"; ``rules`` lists all that match.

Defined cases: a null URL has the verdict "none" and no rules, like an empty
one; repeated rows get one result each; ``rules`` is sorted by rule number;
very long URLs are searched whole; an empty table gives an empty result; ids
may have any type, other columns any name.
"""

from __future__ import annotations

import re
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import named, read, with_id

RULES = (
    "||ads-track.example.com^",
    "||casino-win.example.com^",
    "||cheap-pills.example.com^",
    "||free-bets.example.com^",
    "-casino-",
    "/banner/*/img^",
    "/ads/*.html|",
    "utm_source=feed|",
    "|http://m.",
    "/de/*?page=2^ref=x",
    "@@||example.org^",
    "@@/en/*#top|",
    r"/^https?:\/\/[^\/]*\d{3,}/",
    r"/\/(fr|es)\/[0-9]{1,3}(\.html)?$/",
)

_TOKEN = re.compile(r"[a-z0-9]+")


class Rule:
    """One parsed rule: number, exception or not, regular expression, tokens for the index."""

    def __init__(self, number: int, text: str):
        self.number, self.text = number, text
        if "$" in text and not (text.endswith("/") and text.removeprefix("@@").startswith("/")):
            raise ValueError(f"options after $ aren't supported: {text}")
        self.allow = text.startswith("@@")
        body = text[2:].lower() if self.allow else text.lower() if not text.startswith("/") or not text.endswith("/") else text
        if len(body) > 1 and body.startswith("/") and body.endswith("/"):
            self.pattern, self.tokens = body[1:-1].replace(r"\/", "/"), []
            return
        out, host, start = "", body.startswith("||"), body.startswith("|")
        end = body.endswith("|") and len(body) > 1
        core = body[2:] if host else body[1:] if start else body
        core = core[:-1] if end else core
        if host:
            out = r"^[a-z][a-z0-9+.-]*://([^/?#]*\.)?"
        elif start:
            out = "^"
        for c in core:
            out += ".*" if c == "*" else r"([^a-z0-9_.%-]|$)" if c == "^" else c if c.isalnum() or c in "_-:/=" else "[" + c + "]"
        self.pattern = out + ("$" if end else "")
        self.tokens = []
        for m in _TOKEN.finditer(core):
            left = m.start() > 0 and core[m.start() - 1] != "*" or m.start() == 0 and (host or start)
            right = m.end() < len(core) and core[m.end()] != "*" or m.end() == len(core) and end
            if left and right:
                self.tokens.append(m.group())


def parse(rules=RULES) -> list[Rule]:
    return [Rule(i, r) for i, r in enumerate(rules)]


def token_counts(pages: DataFrame, rules: list[Rule], url_col: str) -> dict[str, int]:
    """URLs that have each of the rules' tokens; at most one row a token reaches the driver."""
    wanted = pages.sparkSession.createDataFrame([(t,) for t in sorted({t for r in rules for t in r.tokens})], "token string")
    tokens = pages.select(F.explode(F.array_distinct(F.split(F.lower(named(url_col)), "[^a-z0-9]+"))).alias("token"))
    return {r.token: r.n for r in tokens.join(wanted, "token", "left_semi").groupBy("token").agg(F.count("*").alias("n")).collect()}


def build_index(rules: list[Rule], counts: dict[str, int]) -> tuple[dict[str, list[Rule]], list[Rule]]:
    """(rules by their rarest token, rules without a token)."""
    index, always = defaultdict(list), []
    for r in rules:
        if r.tokens:
            index[min(r.tokens, key=lambda t: (counts.get(t, 0), -len(t), t))].append(r)
        else:
            always.append(r)
    return dict(index), always


def verdicts(pages: DataFrame, rules=RULES, id_col="page_id", url_col="url") -> DataFrame:
    """(page_id, url, verdict, rules)."""
    parsed = parse(rules)
    shared = pages.sparkSession.sparkContext.broadcast(build_index(parsed, token_counts(pages, parsed, url_col)))

    def run(batches):
        index, always = shared.value
        compiled: dict = {}

        def matches(r, url):  # a rule is compiled when a URL first asks for it
            if r.number not in compiled:
                compiled[r.number] = re.compile(r.pattern, re.ASCII | re.I)
            return compiled[r.number].search(url)

        for b in batches:
            verdict, hit = [], []
            for url in b.column(1).to_pylist():
                found = []
                if url:
                    candidates = [*always, *(r for t in set(_TOKEN.findall(url.lower())) for r in index.get(t, ()))]
                    found = sorted((r for r in candidates if matches(r, url)), key=lambda r: r.number)
                verdict.append("allow" if any(r.allow for r in found) else "block" if found else "none")
                hit.append(",".join(str(r.number) for r in found))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(verdict, pa.string()), pa.array(hit, pa.string())], ["page_id", "url", "verdict", "rules"])

    base = pages.select(named(id_col).alias("page_id"), named(url_col).alias("url"))
    return base.mapInArrow(run, with_id(base, "url string, verdict string, rules string"))


def op3(spark, sf_dir):
    return verdicts(read(spark, sf_dir, "pages"))


def oracle(rules=RULES) -> str:
    """Every rule on every URL."""
    def quoted(s):
        return "'" + s.replace("'", "''") + "'"

    values = ", ".join(f"({r.number}, {str(r.allow).upper()}, {quoted(r.pattern)})" for r in parse(rules))
    return f"""
WITH r AS (SELECT * FROM (VALUES {values}) AS v(n, allow, pattern)),
u AS (SELECT DISTINCT url FROM pages),
m AS (SELECT u.url, r.n, r.allow FROM u, r WHERE u.url <> '' AND regexp_matches(u.url, r.pattern, 'i')),
g AS (SELECT url, bool_or(allow) AS a, string_agg(CAST(n AS VARCHAR), ',' ORDER BY n) AS rules FROM m GROUP BY url)
SELECT p.page_id, p.url, CASE WHEN g.a THEN 'allow' WHEN g.url IS NOT NULL THEN 'block' ELSE 'none' END AS verdict, coalesce(g.rules, '') AS rules
FROM pages p LEFT JOIN g ON p.url = g.url
"""


OP3_SQL = oracle()
