"""Format-preserving pseudonyms for personal data (operator 8).

Values that pass their validation are replaced by a keyed permutation of their
own format: a Feistel network over the number of values that the format has,
walked until it lands inside. So a card number stays a valid card number, a
date a date in the same notation, and equal values, however they are written,
get equal pseudonyms in every document, which keeps records linked. With the
key the permutation can be undone. Dates keep what their notation
shows: digits of day and month, and whether the day is beyond 12.

Found: card numbers (13 to 19 digits, Luhn), IBANs (mod 97),
IPv4 addresses (octets), dates (calendar, 1900 to 2099), US social security
numbers, phone numbers, e-mail addresses (local part), and quoted secrets after
a word such as token or password. Anything else stays as it is, byte for byte.

Defined cases: a null text stays null; values are searched in the whole text,
left to right, and never overlap; very long texts too; rows with one id get one
result each, and repeated values one pseudonym; an empty table gives an empty
result; ids may have any type, other columns any name.
"""

from __future__ import annotations

import calendar
import datetime
import hashlib
import re
from functools import lru_cache
from math import isqrt

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import named, read, with_id

#: Key of the query over the synthetic tables. It is public: real data need a key of their own.
TEST_KEY = b"inkspool-test-key"
ROUNDS = 10
DATE_0, DATE_1 = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()


def _noise(key: bytes, tweak: str, i: int, value: int, below: int) -> int:
    size = (below.bit_length() + 7) // 8 + 8
    text = b"%d:%s|%s|%d|%d" % (len(key), key, tweak.encode(), i, value)
    return int.from_bytes(hashlib.shake_256(text).digest(size), "big") % below


def permute(x: int, n: int, key: bytes, tweak: str, back: bool = False) -> int:
    """Keyed permutation of 0 .. n - 1: unbalanced Feistel on a grid of at least n cells, with cycle walking."""
    if n < 2:
        return x
    a = isqrt(n - 1) + 1
    b = -(-n // a)
    while True:
        left, right = divmod(x, b)
        for i in reversed(range(ROUNDS)) if back else range(ROUNDS):
            sign = -1 if back else 1
            if i % 2:
                right = (right + sign * _noise(key, tweak, i, left, b)) % b
            else:
                left = (left + sign * _noise(key, tweak, i, right, a)) % a
        x = left * b + right
        if x < n:
            return x


def luhn_digit(body: str) -> int:
    total = 0
    for i, c in enumerate(reversed(body)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return -total % 10


def luhn_ok(digits: str) -> bool:
    return luhn_digit(digits[:-1]) == int(digits[-1])


def _digits(digits: str, key: bytes, tweak: str, back: bool) -> str:
    n = len(digits)
    return f"{permute(int(digits), 10**n, key, f'{tweak}{n}', back):0{n}d}"


def _refill(form: str, chars: str) -> str:
    """``form`` with its letters and digits replaced in turn."""
    it = iter(chars)
    return "".join(next(it) if c.isalnum() else c for c in form)


def _mixed(text: str, key: bytes, tweak: str, back: bool) -> str:
    """Permutes ASCII letters and digits within their kinds; other characters stay."""
    sets = ["0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"]
    kinds = [next((s for s in sets if c in s), None) for c in text]
    n = x = 0
    n = 1
    for c, s in zip(text, kinds, strict=True):
        if s:
            x, n = x * len(s) + s.index(c), n * len(s)
    shape = "".join("-" if s is None else "dlu"[sets.index(s)] for s in kinds)
    x = permute(x, n, key, f"{tweak}:{shape}", back)
    out = []
    for c, s in zip(reversed(text), reversed(kinds), strict=True):
        if s:
            x, d = divmod(x, len(s))
            c = s[d]
        out.append(c)
    return "".join(reversed(out))


def card(v: str, key: bytes, back=False) -> str:
    d = re.sub(r"\D", "", v)
    if not luhn_ok(d):
        return v
    body = _digits(d[:-1], key, "card", back)
    return _refill(v, body + str(luhn_digit(body)))


def ip(v: str, key: bytes, back=False) -> str:
    parts = v.split(".")
    if any(int(p) > 255 or p != str(int(p)) for p in parts):
        return v
    x = permute(int.from_bytes(bytes(map(int, parts)), "big"), 1 << 32, key, "ip", back)
    return ".".join(map(str, x.to_bytes(4, "big")))


def _kind(day: datetime.date) -> tuple[bool, bool, bool]:
    """What a notation shows of a date: whether day and month have one digit, and whether the day could be a month."""
    return day.month < 10, day.day < 10, day.day <= 12


@lru_cache(1)
def _days() -> tuple[dict, dict[int, int]]:
    """Days of each kind, and the place of each day among its kind."""
    kinds, place = {}, {}
    for x in range(DATE_0, DATE_1 + 1):
        kind = kinds.setdefault(_kind(datetime.date.fromordinal(x)), [])
        place[x] = len(kind)
        kind.append(x)
    return kinds, place


def date(v: str, key: bytes, back=False) -> str:
    """A date in its own notation, permuted within its kind.

    So a numeric date with the month first (recognised by a day beyond 12) is
    read with the month first again, one that could be either is read with the
    day first before and after, and each part keeps its number of digits.
    """
    a, sep, b, _, c = re.fullmatch(r"(\d+)([-/.])(\d+)([-/.])(\d+)", v).groups()
    orders = [(0, 1, 2)] if len(a) == 4 else [(2, 1, 0), (2, 0, 1)]
    part = [int(a), int(b), int(c)]
    for o in orders:
        y, m, d = (part[i] for i in o)
        if 1900 <= y <= 2099 and 1 <= m <= 12 and 1 <= d <= calendar.monthrange(y, m)[1]:
            day = datetime.date(y, m, d)
            kinds, place = _days()
            days = kinds[_kind(day)]
            tweak = "date%d%d%d" % _kind(day)
            new = datetime.date.fromordinal(days[permute(place[day.toordinal()], len(days), key, tweak, back)])
            fields = [0, 0, 0]
            for i, x in zip(o, (new.year, new.month, new.day), strict=True):
                fields[i] = x
            return sep.join(f"{x:0{len(s)}d}" for x, s in zip(fields, (a, b, c), strict=True))
    return v


def ssn(v: str, key: bytes, back=False) -> str:
    area, group, serial = map(int, v.split("-"))
    if area in (0, 666) or area > 899 or not group or not serial:
        return v
    x = ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1
    x = permute(x, 898 * 99 * 9999, key, "ssn", back)
    x, serial = divmod(x, 9999)
    area, group = divmod(x, 99)
    return f"{area + 1 + (area >= 665):03d}-{group + 1:02d}-{serial + 1:04d}"


def phone(v: str, key: bytes, back=False) -> str:
    head = re.match(r"\+\d{1,3}(?=[ (.-])", v)
    k = head.end() if head else 0
    d = re.sub(r"\D", "", v[k:])
    return v[:k] + _refill(v[k:], _digits(d, key, "phone", back))


def iban_check(country: str, bban: str) -> str:
    number = "".join(str(int(c, 36)) for c in bban + country + "00")
    return f"{98 - int(number) % 97:02d}"


def iban(v: str, key: bytes, back=False) -> str:
    plain = v.replace(" ", "")
    country, check, bban = plain[:2], plain[2:4], plain[4:]
    if not 15 <= len(plain) <= 34 or iban_check(country, bban) != check:
        return v
    new = _mixed(bban, key, "iban" + country, back)
    return _refill(v, country + iban_check(country, new) + new)


def email(v: str, key: bytes, back=False) -> str:
    local, _, host = v.rpartition("@")
    return _mixed(local, key, "email", back) + "@" + host


def secret(v: str, key: bytes, back=False) -> str:
    return _mixed(v, key, "secret", back)


KINDS = {"secret": secret, "ip": ip, "date": date, "ssn": ssn, "phone": phone, "card": card, "iban": iban, "email": email}

_NUMBERS = re.compile(
    r"(?P<secret>(?<=[\"'])[0-9A-Za-z_+/=-]{16,}(?=[\"']))"
    r"|(?P<ip>(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\.?\d))"
    r"|(?P<date>(?<![\d./-])(?:\d{4}([-/.])\d{1,2}\4\d{1,2}|\d{1,2}([-/.])\d{1,2}\5\d{4})(?![\d/-]))"
    r"|(?P<ssn>(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-]))"
    r"|(?P<phone>\+\d{1,3}[ .-]?\(?\d{1,4}\)?(?:[ .-]?\d{2,4}){2,4}(?!\d)|\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)|(?<![\d.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\d.-]*\d))"
    r"|(?P<card>(?<!\d)(?:\d{13,19}|\d{4}([ -])\d{4}\9\d{4}\9\d{1,7}|\d{4}[ -]\d{6}[ -]\d{5})(?!\d))"
    r"|(?P<iban>(?<![A-Z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Z0-9]))",
    re.ASCII,
)
_NAMED = re.compile(r"(?:token|secret|password|passwd|api[_-]?key|key)\s*[:=]\s*[\"']$", re.ASCII | re.I)
_EMAIL = re.compile(r"(?<![\w.+%-])[\w.+%-]+@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}")
_DIGIT = re.compile(r"\d", re.ASCII)


def pseudonymize(text: str, key: bytes, back: bool = False, cache=None) -> tuple[str, list[str]]:
    """(text with pseudonyms, kinds replaced in order)."""
    kinds: list[str] = []
    replace = cache or (lambda kind, v: KINDS[kind](v, key, back))

    def one(kind: str, v: str) -> str:
        new = replace(kind, v)
        if new != v:
            kinds.append(kind)
        return new

    def number(m: re.Match) -> str:
        kind, v = m.lastgroup, m.group()
        if kind == "secret" and not _NAMED.search(text, max(0, m.start() - 24), m.start()):
            return one("card", v) if re.fullmatch(r"\d{13,19}", v) else v
        return one(kind, v)

    if _DIGIT.search(text):
        text = _NUMBERS.sub(number, text)
    if "@" in text:
        text = _EMAIL.sub(lambda m: one("email", m.group()), text)
    return text, kinds


def pseudonyms(docs: DataFrame, key: bytes, id_col="doc_id", text_col="text") -> DataFrame:
    """(doc_id, text, kinds): kinds lists what was replaced, as a sorted set; null for a null text."""

    def run(batches):
        cache = lru_cache(1 << 16)(lambda kind, v: KINDS[kind](v, key))
        for b in batches:
            texts, kinds = [], []
            for t in b.column(1).to_pylist():
                t, k = (None, None) if t is None else pseudonymize(t, key, cache=cache)
                texts.append(t)
                kinds.append(k if k is None else ",".join(sorted(set(k))))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), pa.array(kinds, pa.string())], ["doc_id", "text", "kinds"])

    base = docs.select(named(id_col).alias("doc_id"), named(text_col).alias("t"))
    return base.mapInArrow(run, with_id(base, "text string, kinds string"))


def op8(spark, sf_dir):
    return pseudonyms(read(spark, sf_dir, "documents"), TEST_KEY)
