"""Format-preserving pseudonyms for personal numbers and dates.

Every kind of value has a pattern and a check (Luhn, mod 97, calendar, ranges). A value that passes is
numbered within its format, that number is permuted by a keyed Feistel network that cycle-walks into the
format's range, and the result is written with the value's own separators. The permutation depends on the
key, the kind and the length only, so equal values get equal pseudonyms in every document and notation, and the key undoes it.
An international phone number keeps its country code, a date stays within or outside 1900 to 2099, a secret may have any length.
"""

from __future__ import annotations

import datetime
import hashlib
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
# Dates of this span get images in it, all others of the years 1 to 9999 get images outside.
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()
SPAN, DAYS = LAST_DAY - FIRST_DAY + 1, datetime.date.max.toordinal()
# Characters of a long secret that are permuted as one number.
CHUNK = 128


class Permutation:
    """A keyed permutation of 0..n-1 without fixed points (n > 1).

    A Feistel network E over the next even number of bits, walked until the value is below n; the
    permutation is E, plus one, and E undone: one single cycle through all values.
    """

    def __init__(self, key: bytes, tweak: str, n: int) -> None:
        self.n, self.half = n, max(1, ((n - 1).bit_length() + 1) // 2)
        self.mask, self.size = (1 << self.half) - 1, (self.half + 7) // 8
        self.key, self.tweak = key, f"{tweak}:{n}:".encode()

    def _mix(self, turn: int, side: int) -> int:
        data = self.tweak + bytes([turn]) + side.to_bytes(self.size, "big")
        return int.from_bytes(hashlib.blake2b(data, key=self.key, digest_size=min(64, self.size + 8)).digest(), "big") & self.mask

    def _walk(self, value: int, turns: list[int]) -> int:
        while True:
            left, right = value >> self.half, value & self.mask
            for turn in turns:
                left, right = right, left ^ self._mix(turn, right)
            value = right << self.half | left  # swapped, so that the turns backwards undo it
            if value < self.n:
                return value

    def apply(self, value: int, step: int = 1) -> int:
        """The image of `value`; with step -1, the value whose image it is."""
        inner = self._walk(value, list(range(ROUNDS)))
        return self._walk((inner + step) % self.n, list(range(ROUNDS))[::-1])


@lru_cache(maxsize=4096)
def _permutation(key: bytes, tweak: str, n: int) -> Permutation:
    return Permutation(key, tweak, n)


def _moved(key: bytes, tweak: str, n: int, value: int, step: int, good: Callable[[int], bool] = lambda v: True) -> int:
    """The next value along the permutation that is `good`, as the given one is."""
    permutation = _permutation(key, tweak, n)
    value = permutation.apply(value, step)
    while not good(value):
        value = permutation.apply(value, step)
    return value


def _refill(shape: str, digits: str) -> str:
    """`shape` with its digits replaced one by one."""
    rest = iter(digits)
    return "".join(next(rest) if c.isdigit() else c for c in shape)


def _digits(text: str) -> str:
    return "".join(c for c in text if c.isdigit())


def _luhn(body: str) -> str:
    """The check digit that follows `body`."""
    total = sum(sum(divmod(int(d) * 2, 10)) if i % 2 == 0 else int(d) for i, d in enumerate(reversed(body)))
    return str(-total % 10)


# Each takes (key, match, step) and gives the pseudonym, or None when the value fails its check.

def _card(key: bytes, m: re.Match, step: int) -> str | None:
    digits = _digits(m[0])
    if _luhn(digits[:-1]) != digits[-1] or len(set(digits)) == 1:
        return None
    n = len(digits) - 1
    uniform = lambda v: len(set(f"{v:0{n}}" + _luhn(f"{v:0{n}}"))) > 1
    body = f"{_moved(key, f'card{n}', 10**n, int(digits[:-1]), step, uniform):0{n}}"
    return _refill(m[0], body + _luhn(body))


def _phone(key: bytes, m: re.Match, step: int) -> str | None:
    code = len(_country_code(_digits(m[0]))) if m["code"] else 0
    at = 0  # where the number without its country code begins, however it is written
    while code:
        code -= m[0][at].isdigit()
        at += 1
    lead, rest = m[0][:at], m[0][at:]
    digits = _digits(rest)
    if not 7 <= len(digits) <= 14:
        return None
    return lead + _refill(rest, f"{_moved(key, f'phone{len(digits)}', 10 ** len(digits), int(digits), step):0{len(digits)}}")


def _is_ssn(value: int) -> bool:
    area, group, serial = value // 1_000_000, value // 10_000 % 100, value % 10_000
    return area not in (0, 666) and area < 900 and group > 0 and serial > 0


def _ssn(key: bytes, m: re.Match, step: int) -> str | None:
    value = int(_digits(m[0]))
    return _refill(m[0], f"{_moved(key, 'ssn', 10**9, value, step, _is_ssn):09}") if _is_ssn(value) else None


def _ip(key: bytes, m: re.Match, step: int) -> str | None:
    parts = m[0].split(".")
    if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
        return None
    value = _moved(key, "ip", 1 << 32, int.from_bytes(bytes(map(int, parts)), "big"), step)
    return ".".join(map(str, value.to_bytes(4, "big")))


def _calendar(year: int, month: int, day: int) -> int | None:
    try:
        return datetime.date(year, month, day).toordinal()
    except ValueError:
        return None


def _moved_day(key: bytes, at: int, step: int) -> datetime.date:
    """The image of the day with number `at`. Days over 12 stay so."""
    recent = FIRST_DAY <= at <= LAST_DAY
    day_of = lambda v: datetime.date.fromordinal(v + FIRST_DAY if recent else v + 1 if v + 1 < FIRST_DAY else v + 1 + SPAN)
    place = at - FIRST_DAY if recent else at - 1 if at < FIRST_DAY else at - 1 - SPAN
    late = lambda v: (day_of(v).day > 12) == (day_of(place).day > 12)
    return day_of(_moved(key, "date" if recent else "other date", SPAN if recent else DAYS - SPAN, place, step, late))


def _date(key: bytes, m: re.Match, step: int) -> str | None:
    """Year first, or day first; month first only where the day could not be a month.

    Days over 12 stay so in every notation, so that the image depends on the date alone.
    """
    first, second, last = re.split(r"[-/.]", m[0])
    year_first = len(first) == 4
    at = _calendar(int(first), int(second), int(last)) if year_first else _calendar(int(last), int(second), int(first))
    month_first = at is None and not year_first
    if month_first:
        at = _calendar(int(last), int(first), int(second))
    if at is None:
        return None
    day = _moved_day(key, at, step)
    two = (lambda x: f"{x:02}") if all(len(p) > 1 for p in (first, second, last)) else str
    parts = [f"{day.year:04}", two(day.month), two(day.day)]
    parts = parts if year_first else [parts[1], parts[2], parts[0]] if month_first else parts[::-1]
    marks = re.findall(r"[-/.]", m[0])
    return parts[0] + marks[0] + parts[1] + marks[1] + parts[2]


def _iban(key: bytes, m: re.Match, step: int) -> str | None:
    plain = m[0].replace(" ", "")
    value = lambda text: int("".join(str(int(c, 36)) for c in text))
    if not 15 <= len(plain) <= 34 or value(plain[4:] + plain[:4]) % 97 != 1:
        return None
    body = _digits(plain[4:])
    if len(body) < 4:
        return None
    body = iter(f"{_moved(key, f'iban{len(body)}', 10 ** len(body), int(body), step):0{len(body)}}")
    account = "".join(next(body) if c.isdigit() else c for c in plain[4:])
    chars = iter(plain[:2] + f"{98 - value(account + plain[:2] + '00') % 97:02}" + account)
    return "".join(c if c == " " else next(chars) for c in m[0])


_CLASSES = (("abcdefghijklmnopqrstuvwxyz", 26), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", 26), ("0123456789", 10))


def _by_class(key: bytes, tweak: str, text: str, step: int, classes: tuple = _CLASSES) -> str:
    """`text` with letters of each case and digits permuted as one number, everything else kept."""
    kinds = [next((c for c in classes if ch in c[0]), None) for ch in text]
    value, n = 0, 1
    for ch, kind in zip(text, kinds, strict=True):
        if kind:
            value, n = value * kind[1] + kind[0].index(ch), n * kind[1]
    if n == 1:
        return text
    shape = "".join("." if k is None else "aA0"[_CLASSES.index(k)] if k in _CLASSES else "x" for k in kinds)
    value, out = _moved(key, f"{tweak}{shape}", n, value, step), []
    for ch, kind in zip(reversed(text), reversed(kinds), strict=True):
        if kind:
            value, at = divmod(value, kind[1])
            ch = kind[0][at]
        out.append(ch)
    return "".join(reversed(out))


def _email(key: bytes, m: re.Match, step: int) -> str | None:
    local, _, domain = m[0].rpartition("@")
    return f"{_by_class(key, 'email', local, step)}@{domain}"


def _secret(key: bytes, m: re.Match, step: int) -> str | None:
    digits = "0123456789abcdef" if m["hex"].islower() or m["hex"].isdigit() else "0123456789ABCDEF"
    if any(c not in digits for c in m["hex"]):
        return None
    parts = (m["hex"][at : at + CHUNK] for at in range(0, len(m["hex"]), CHUNK))
    return m["lead"] + "".join(_by_class(key, f"hex{i or ''}", part, step, ((digits, 16),)) for i, part in enumerate(parts))


# How long IBANs are, by country, and the most digits of a phone number after some country codes.
IBAN_LENGTHS = {country: n for n, countries in {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
    28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC", 33: "RU"}.items() for country in countries.split()}
PHONE_DIGITS = {"1": 10, "7": 10, "30": 10, "31": 9, "32": 9, "33": 9, "34": 9, "41": 9, "44": 10, "45": 8, "46": 10, "47": 8, "48": 9, "52": 10, "55": 11, "61": 9, "81": 10, "91": 10, "351": 9}


# The country codes of one and two digits; all others have three.
SHORT_CODES = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())


def _country_code(digits: str) -> str:
    """The country code an international number begins with."""
    return next((digits[:k] for k in (1, 2) if digits[:k] in SHORT_CODES), digits[:3])


def _iban_end(m: re.Match) -> int:
    """The end of the IBAN: where the country's length is reached, if groups end there."""
    wanted, n = IBAN_LENGTHS.get(m[0][:2]), 0
    for i, c in enumerate(m[0]):
        n += c != " "
        if n == wanted and m[0][i + 1 : i + 2] in ("", " "):
            return m.start() + i + 1
    return m.end()


def _phone_end(m: re.Match) -> int:
    """The end of the phone number: trailing numbers after a space that are too many for the country are not part of it."""
    if not m["code"]:
        return m.end()
    code = _country_code(_digits(m[0]))
    end = len(m[0])
    while code in PHONE_DIGITS and len(_digits(m[0][:end])) > len(code) + PHONE_DIGITS[code] and " " in m[0][:end]:
        end = m[0].rindex(" ", 0, end)
    return m.start() + end if end > len(m["code"]) else m.end()


ENDS: dict[str, Callable[[re.Match], int]] = {"iban": _iban_end, "phone": _phone_end}


def _matches(kind: str, pattern: re.Pattern, text: str) -> Iterator[re.Match]:
    """Matches from left to right, shortened to the end of the value; what a shorter one leaves is looked at again."""
    if kind not in ENDS:
        yield from pattern.finditer(text)
        return
    at = 0
    while m := pattern.search(text, at):
        end = ENDS[kind](m)
        m = (pattern.fullmatch(text, m.start(), end) if end < m.end() else None) or m
        yield m
        at = m.end()


# Tried in this order at every place. The formats of the values.
KINDS: dict[str, tuple[str, Callable[[bytes, re.Match, int], str | None]]] = {
    "secret": (r"(?P<lead>(?i:token|secret|key|password)[\"']?\s{0,3}[=:]\s{0,3}[\"']?)(?P<hex>[0-9a-fA-F]{32,})(?![0-9a-zA-Z])", _secret),
    "email": (r"(?<![\w.+-])[\w.%+-]{1,64}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}", _email),
    "iban": (r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", _iban),
    "date": (r"(?<![\d./-])(?:\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}\.\d{1,2}\.\d{4}|\d{1,2}-\d{1,2}-\d{4})(?![\d/-]|\.\d)", _date),
    "ip": (r"(?<![\d.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\d|\.\d)", _ip),
    "ssn": (r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])", _ssn),
    "card": (r"(?<!\d)(?:\d{4}([ -])\d{4}\1\d{4}\1\d{1,7}|\d{4}([ -])\d{6}\2\d{5}|\d{13,19})(?!\d)", _card),
    "phone": (r"(?<![\w+])(?:(?P<code>\+\d{1,3})[ .-]?\(?\d{1,4}\)?(?:[ .-]?\d{2,4}){2,4}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?!\d)", _phone),
}
# A text without any of these holds no value of any kind.
_HINT = re.compile(r"[0-9@]")


class Pseudonymiser:
    """Replaces values of the given kinds in texts."""

    def __init__(self, key: bytes, kinds: tuple[str, ...] = tuple(KINDS)) -> None:
        self.key = hashlib.blake2b(key, digest_size=32).digest()
        self.kinds = [(kind, *KINDS[kind]) for kind in kinds]
        self.patterns = [(kind, re.compile(pattern), change) for kind, pattern, change in self.kinds]

    def values(self, text: str) -> Iterator[tuple[int, int, str, re.Match, Callable]]:
        """Candidates from left to right: at a place, of overlapping ones that of the first kind."""
        found = [(m.start(), rank, m.end(), kind, m, change) for rank, (kind, pattern, change) in enumerate(self.patterns) for m in _matches(kind, pattern, text)]
        found.sort(key=lambda f: f[:2])
        for start, _, end, kind, m, change in found:
            yield start, end, kind, m, change

    def replace(self, text: str, step: int = 1) -> tuple[str, list[tuple[str, int, int]]]:
        """The text with pseudonyms, and (kind, start, end) of each in it; step -1 puts the values back."""
        if not _HINT.search(text):
            return text, []
        out, spans, at, length = [], [], 0, 0
        for start, end, kind, m, change in self.values(text):
            if start < at or (kind != "email" and not m[0].isascii()):
                continue
            new = change(self.key, m, step)
            if new is None:
                continue
            out += [text[at:start], new]
            length += start - at + len(new)
            spans.append((kind, length - len(new), length))
            at = end
        return ("".join([*out, text[at:]]), spans) if spans else (text, [])


def pseudonymise(docs: DataFrame, key: bytes, doc_id: str = "doc_id", text: str = "text", kinds: tuple[str, ...] = tuple(KINDS), undo: bool = False) -> DataFrame:
    """(doc_id, text, found) for every row: the text with pseudonyms, and their (kind, start, end) in it.

    A null text stays null. Numbers that fail their check are left alone. Rows do not move. With
    `undo`, texts that were pseudonymised with the key get their values back.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker = Pseudonymiser(key, kinds)
        for batch in batches:
            done = [(None, []) if t is None else worker.replace(t, -1 if undo else 1) for t in (x.as_py() for x in batch.column(1))]
            found = pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in d[1]] for d in done],
                             pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([d[0] for d in done], pa.string()), found], ["id", "text", "found"])

    kind = docs.schema[doc_id].dataType.simpleString()
    out = docs.select(F.col(doc_id), F.col(text)).mapInArrow(run, f"id {kind}, text string, found array<struct<kind:string,start:int,end:int>>")
    return out.withColumnRenamed("id", doc_id)
