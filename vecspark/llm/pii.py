"""Format-preserving pseudonyms for personal numbers, dates and addresses.

Candidates are found by pattern and checked (check digits, ranges, calendar).
A keyed Feistel network permutes each within its own format, so a pseudonym
is as valid as its original and equal values stay equal in all documents.
"""

from __future__ import annotations

import bisect
import datetime
import hashlib
import hmac
import math
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from vecspark.llm.support import ship_package

ROUNDS = 10
#: Longest run of a name that is permuted as one number: the longest legal name of an address.
NAME_PIECE = 64
FIRST_DAY = datetime.date(1900, 1, 1).toordinal()
DAYS = datetime.date(2100, 1, 1).toordinal() - FIRST_DAY


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def luhn_digit(body: str) -> str:
    return next(c for c in "0123456789" if luhn(body + c))


def iban_number(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4]))


class Permuter:
    """Keyed permutations of ``range(n)`` for any n; ``kind`` separates the formats."""

    def __init__(self, key: bytes):
        self.key = key
        self.known: dict[tuple[str, str], str] = {}

    def _round(self, tweak: bytes, number: int, value: int, bound: int) -> int:
        size = (value.bit_length() + 7) // 8 or 1
        digest = hmac.new(self.key, tweak + bytes([number]) + value.to_bytes(size, "big"), hashlib.sha256).digest()
        return int.from_bytes(digest, "big") % bound

    def permute(self, kind: str, value: int, n: int) -> int:
        """Feistel rounds over the pair (value div b, value mod b); values beyond n walk on to the next in range."""
        if n <= 1:
            return value
        b = math.isqrt(n - 1) + 1
        a = -(-n // b)
        tweak = f"{kind}/{n}/".encode()
        while True:
            left, right = divmod(value, b)  # left < a, right < b
            for i in range(ROUNDS):
                if i % 2:
                    right = (right + self._round(tweak, i, left, b)) % b
                else:
                    left = (left + self._round(tweak, i, right, a)) % a
            value = left * b + right
            if value < n:
                return value

    def digits(self, kind: str, text: str) -> str:
        """Permute the digits of ``text`` among all of that length; other characters stay."""
        found = [c for c in text if c in "0123456789"]
        new = iter(str(self.permute(kind, int("".join(found)), 10 ** len(found))).zfill(len(found))) if found else iter("")
        return "".join(next(new) if c in "0123456789" else c for c in text)

    def letters_and_digits(self, kind: str, text: str) -> str:
        """Each ASCII letter or digit stays of its class and case; together they are permuted."""
        classes = [(26, "a") if "a" <= c <= "z" else (26, "A") if "A" <= c <= "Z" else (10, "0") if "0" <= c <= "9" else None for c in text]
        value, n = 0, 1
        for c, k in zip(text, classes):
            if k:
                value, n = value * k[0] + ord(c) - ord(k[1]), n * k[0]
        value = self.permute(kind + "".join(k[1] if k else "." for k in classes), value, n)
        out = []
        for c, k in zip(reversed(text), reversed(classes)):
            if k:
                value, d = divmod(value, k[0])
                c = chr(ord(k[1]) + d)
            out.append(c)
        return "".join(reversed(out))

    def name(self, kind: str, text: str) -> str:
        """Letters and digits of a name of any length, in pieces of at most NAME_PIECE characters."""
        pieces = [text[i : i + NAME_PIECE] for i in range(0, len(text), NAME_PIECE)]
        return "".join(self.letters_and_digits(kind if i == 0 else f"{kind}{i}", piece) for i, piece in enumerate(pieces))


def _card(p: Permuter, text: str) -> str | None:
    digits = re.sub(r"\D", "", text)
    if not 13 <= len(digits) <= 19 or len(set(digits)) == 1 or not luhn(digits):
        return None
    body = p.digits(f"card {digits[0]}", digits[1:-1])  # the first digit (the scheme) stays
    new = iter(digits[0] + body + luhn_digit(digits[0] + body))
    return "".join(next(new) if c.isdigit() else c for c in text)


def _iban(p: Permuter, text: str) -> str | None:
    plain = text.replace(" ", "")
    if not 15 <= len(plain) <= 34 or iban_number(plain) % 97 != 1:
        return None
    body = p.letters_and_digits("iban " + plain[:2], plain[4:])
    check = 98 - iban_number(plain[:2] + "00" + body) % 97
    new = iter(plain[:2] + f"{check:02d}" + body)
    return "".join(c if c == " " else next(new) for c in text)


def _social(p: Permuter, text: str) -> str | None:
    """Area 001-899 without 666, group 01-99, serial 0001-9999."""
    area, group, serial = (int(x) for x in (text[:3], text[4:6], text[7:]))
    if not 1 <= area <= 899 or area == 666 or not group or not serial:
        return None
    rank = ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1
    rank, serial = divmod(p.permute("social", rank, 898 * 99 * 9999), 9999)
    area, group = divmod(rank, 99)
    area += 1 + (area >= 665)
    return f"{area:03d}{text[3]}{group + 1:02d}{text[6]}{serial + 1:04d}"


def _address(p: Permuter, text: str) -> str | None:
    parts = text.split(".")
    if any(int(x) > 255 or (len(x) > 1 and x[0] == "0") for x in parts):
        return None
    value = p.permute("ip", int.from_bytes(bytes(map(int, parts)), "big"), 1 << 32)
    return ".".join(map(str, value.to_bytes(4, "big")))


def _phone(p: Permuter, text: str) -> str | None:
    """Country code and grouping stay, the rest of the digits is permuted."""
    digits = re.sub(r"\D", "", text)
    if not 8 <= len(digits) <= 15:
        return None
    head = re.match(r"\+\d{1,3}(?=\D)", text)
    at = head.end() if head else 0
    return text[:at] + p.digits("phone " + text[:at], text[at:])


def _mail(p: Permuter, text: str) -> str | None:
    name, _, host = text.rpartition("@")
    return p.name("mail", name) + "@" + host


def _date(year: int, month: int, day: int) -> Callable[[Permuter, str], str | None]:
    """Dates from 1900 to 2099, with the places of year, month and day among the numbers of the pattern."""

    def run(p: Permuter, text: str) -> str | None:
        numbers = re.findall(r"\d+", text)
        try:
            given = datetime.date(int(numbers[year]), int(numbers[month]), int(numbers[day])).toordinal() - FIRST_DAY
        except ValueError:
            return None
        if not 0 <= given < DAYS:
            return None
        new = datetime.date.fromordinal(FIRST_DAY + p.permute("date", given, DAYS))
        by_place = {year: f"{new.year:04d}", month: f"{new.month:02d}", day: f"{new.day:02d}"}
        places = iter(range(3))
        return re.sub(r"\d+", lambda m: by_place[next(places)], text)

    return run


#: Kinds with pattern and rule, in order of precedence; mail addresses, found by ``addresses``, precede them.
RULES: list[tuple[str, str, Callable[[Permuter, str], str | None]]] = [
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", _iban),
    ("ip", r"(?<![\d.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?![\d]|\.\d)", _address),
    ("date_iso", r"(?<![\d-])(?:19|20)\d{2}-\d{2}-\d{2}(?![\d-])", _date(0, 1, 2)),
    ("date_dmy", r"(?<![\d.])\d{2}\.\d{2}\.(?:19|20)\d{2}(?!\d)", _date(2, 1, 0)),
    ("date_mdy", r"(?<![\d/])\d{2}/\d{2}/(?:19|20)\d{2}(?![\d/])", _date(2, 0, 1)),
    ("social", r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])", _social),
    ("card", r"(?<!\d)(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{4}|\d{4}([ -])\d{6}\2\d{5})(?!\d)", _card),
    ("phone", r"(?<![\w+])(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]\d{3,4}(?!\d)|(?<![\w+])\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?!\d)|(?<![\w-])\d{3}-\d{3}-\d{4}(?![\d-])", _phone),
]
_in_name = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_host = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*", re.ASCII)
_top = re.compile(r"[A-Za-z]{2,}", re.ASCII)
_patterns = [(kind, re.compile(pattern, re.ASCII), rule) for kind, pattern, rule in RULES]
#: Every value of every kind has a digit followed or preceded by one of these, or an at sign.
_worth = re.compile(r"@|\d[ .()/-]*\d", re.ASCII)


#: Characters of an IBAN by country.
IBAN_LENGTHS = {
    country: length
    for length, countries in {
        15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
        22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
        26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE",
        31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for country in countries.split()
}


def addresses(text: str) -> Iterator[tuple[int, int]]:
    """Mail addresses: from each ``@`` the name to its left and the host to its right.

    A name begins with a letter or digit; a host ends with a label that begins with two letters or
    more, and with these. Every character is read a bounded number of times, however long a run is.
    """
    free = 0
    at = text.find("@")
    while at >= 0:
        begin = at
        while begin > free and text[begin - 1] in _in_name:
            begin -= 1
        while begin < at and text[begin] in "._%+-":
            begin += 1
        end = _host_end(text, at + 1) if begin < at else None
        if end is not None:
            yield begin, end
            free = end
        else:
            free = at + 1
        at = text.find("@", free)


def _host_end(text: str, begin: int) -> int | None:
    """End of the host that begins here: after the letters that begin its last label with two letters in front."""
    m = _host.match(text, begin)
    if m is None:
        return None
    dot = text.rfind(".", begin, m.end())
    while dot > begin:
        top = _top.match(text, dot + 1, m.end())
        if top:
            return top.end()
        dot = text.rfind(".", begin, dot)
    return None


def _ends(kind: str, m: re.Match) -> list[int]:
    """Where a candidate may end: an IBAN's pattern may take words that follow the number, so its country's length comes first."""
    text, ends = m.group() + " ", [m.end()]
    if kind == "iban":
        length = IBAN_LENGTHS.get(text[:2])
        ends = [m.start() + i for i, c in enumerate(text) if c == " " and i - text.count(" ", 0, i) == length] + ends
    return list(dict.fromkeys(ends))


def pseudonymise(text: str, permuter: Permuter) -> tuple[str, dict[str, int]]:
    """The text with its values replaced, and how many of each kind."""
    counts: dict[str, int] = {}
    if not _worth.search(text):
        return text, counts
    spans: list[tuple[int, int, str]] = []  # in order and apart from each other

    def taken(a: int, b: int) -> bool:
        i = bisect.bisect_left(spans, (b,))
        return i > 0 and spans[i - 1][1] > a

    def replaced(kind: str, value: str, rule: Callable[[Permuter, str], str | None]) -> str | None:
        known = permuter.known.get((kind, value))
        if known is None:
            known = rule(permuter, value)
            if known is not None:
                if len(permuter.known) > 100_000:
                    permuter.known.clear()
                permuter.known[kind, value] = known
        return known

    for a, b in addresses(text):
        spans.append((a, b, replaced("email", text[a:b], _mail)))
    if spans:
        counts["email"] = len(spans)
    for kind, pattern, rule in _patterns:
        fresh = []
        at = 0
        while m := pattern.search(text, at):
            at = m.end()
            for end in _ends(kind, m):
                if taken(m.start(), end):
                    continue
                known = replaced(kind, text[m.start() : end], rule)
                if known is None:
                    continue
                fresh.append((m.start(), end, known))
                at = end
                break
            else:
                if kind == "iban":  # another may begin within
                    at = m.start() + 1
        if fresh:
            counts[kind] = len(fresh)
            spans = sorted(spans + fresh)
    if not spans:
        return text, counts
    out, at = [], 0
    for a, b, new in spans:
        out += [text[at:a], new]
        at = b
    return "".join([*out, text[at:]]), counts


def pseudonymise_documents(docs: DataFrame, key: str) -> DataFrame:
    """The columns of ``docs`` with ``text`` replaced, and ``n_replaced`` and ``kinds`` (map of counts) added.

    Whoever knows ``key`` can undo the mapping, so it is for the caller to choose and to keep. Columns of ``docs`` with
    the names of the added ones are replaced by them. Rows are independent; repeated ones give equal results.

    A null text stays null, an empty one empty. A value is replaced only if it is
    valid in its format; everything else in a text is left as it is. The mapping is
    one to one within a format and depends on ``key`` alone; a value may in rare
    cases (one in the size of its format) map to itself.
    """
    ship_package(docs.sparkSession)
    docs = docs.drop("n_replaced", "kinds")
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        permuter = Permuter(key.encode())
        for whole in batches:
            for begin in range(0, whole.num_rows, 1024):
                batch = whole.slice(begin, 1024)
                found = [(None, {}) if x is None else pseudonymise(x, permuter) for x in batch.column(at).to_pylist()]
                columns = list(batch.columns)
                columns[at] = pa.array([f[0] for f in found], batch.schema.field(at).type)
                kinds = pa.array([list(f[1].items()) for f in found], pa.map_(pa.string(), pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array([sum(f[1].values()) for f in found], pa.int32()), kinds],
                    names=[*batch.schema.names, "n_replaced", "kinds"],
                )

    added = [T.StructField("n_replaced", T.IntegerType()), T.StructField("kinds", T.MapType(T.StringType(), T.IntegerType()))]
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *added]))
