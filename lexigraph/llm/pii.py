"""Personal data by format-preserving pseudonyms.

Candidates are found by pattern and validated: card numbers by their check digit, IBANs by theirs, social security numbers by the
ranges in use, addresses by their octets, dates by the calendar. A valid value is permuted within its own format by a keyed Feistel
network (see `feistel`): a card number becomes another of the same length and issuer digit with a right check digit, a date another
date written the same way, a mail address another with the same last label. The permutation depends on key and kind (and on a
date's way of writing), so equal values have equal pseudonyms in all documents, however they are spaced, different values have
different ones, and with the key it can be undone.

A null or empty text has no findings. A null id is a row like any other, as is a repeated row. A text of any length is read whole.
An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from datetime import date
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import id_and_text
from .feistel import permute

KINDS = ("email", "iban", "card", "ssn", "phone", "ip", "date")
EMAIL = re.compile(r"[A-Za-z0-9](?:[A-Za-z0-9._%+-]{0,62}[A-Za-z0-9])?@(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.)+[A-Za-z]{2,24}(?![A-Za-z0-9])")
IBAN = r"[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,4})?"
#: Cards, social security numbers, telephone numbers, addresses and dates all start with a digit, `+` or `(`.
NUMBERS = {
    "date": r"[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}",
    "ip": r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}",
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
    "card": r"[0-9](?:[ -]?[0-9]){12,18}",
    "phone": r"\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?(?:[ .-]?[0-9]{2,4}){2,4}|\([0-9]{3}\)[ ]?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}",
}
#: Where a value may start, and for each kind, in order of trial, its form and what may not follow.
NUMBER_START = re.compile(rf"(?<![A-Za-z0-9_+])(?<![0-9][.-])(?={'|'.join(NUMBERS.values())})")
IBAN_START = re.compile(rf"(?<![A-Za-z0-9])(?={IBAN})")
#: Digits set apart in two ways are a card's only if they aren't a telephone number and another.
_TRIED = [*((k, NUMBERS[k]) for k in ("date", "ip", "ssn")), ("card", r"[0-9](?:[ ]?[0-9]){12,18}"), ("card", r"[0-9](?:-?[0-9]){12,18}"), ("phone", NUMBERS["phone"]), ("card", NUMBERS["card"])]
NUMBER_FORMS = [(k, re.compile(v), re.compile(r"[A-Za-z0-9_]|[.-][0-9]")) for k, v in _TRIED]
IBAN_FORMS = [("iban", re.compile(IBAN), re.compile(r"[A-Za-z0-9]"))]
FIRST_DAY, LAST_DAY = date(1900, 1, 1).toordinal(), date(2099, 12, 31).toordinal()


def luhn(digits: str) -> int:
    """The sum whose last digit is 0 for a valid number."""
    return sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits)))


def _digits(value: str) -> str:
    return "".join(c for c in value if c.isdigit())


def _refill(value: str, digits: str) -> str:
    """The value with these digits in place of its own."""
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in value)


def _number(digits: str, key: bytes, kind: str, back: bool) -> str:
    n = len(digits)
    return str(permute(int(digits), 10**n, key, f"{kind}{n}".encode(), back=back)).zfill(n)


def _card(value: str, key: bytes, back: bool) -> str | None:
    d = _digits(value)
    if luhn(d) % 10 or len(set(d)) == 1:
        return None
    body = d[0] + _number(d[1:-1], key, "card" + d[0], back)
    return _refill(value, body + str(-luhn(body + "0") % 10))


def _rearranged(iban: str) -> int:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4]))


def _iban(value: str, key: bytes, back: bool) -> str | None:
    plain = value.replace(" ", "")
    if not 15 <= len(plain) <= 34 or _rearranged(plain) % 97 != 1:
        return None
    body = plain[4:]
    body = _refill(body, _number(_digits(body), key, "iban" + plain[:2], back)) if _digits(body) else body
    check = 98 - _rearranged(plain[:2] + "00" + body) % 97
    new = iter(f"{plain[:2]}{check:02d}{body}")
    return "".join(c if c == " " else next(new) for c in value)


def _ssn(value: str, key: bytes, back: bool) -> str | None:
    valid = lambda d: d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"
    d = _digits(value)
    if not valid(d):
        return None
    while True:  # along the cycle to the next number in use
        d = _number(d, key, "ssn", back)
        if valid(d):
            return _refill(value, d)


def _phone(value: str, key: bytes, back: bool) -> str | None:
    d = _digits(value)
    if not 8 <= len(d) <= 15:
        return None
    code = len(re.match(r"\+?([0-9]*)", value)[1]) if value[0] == "+" and re.match(r"\+[0-9]{1,3}[ .(-]", value) else 0
    return _refill(value, d[:code] + _number(d[code:], key, "phone", back))


def _ip(value: str, key: bytes, back: bool) -> str | None:
    parts = value.split(".")
    if any(int(x) > 255 or (len(x) > 1 and x[0] == "0") for x in parts):
        return None
    n = permute(int.from_bytes(bytes(map(int, parts))), 2**32, key, b"ip", back=back)
    return ".".join(map(str, n.to_bytes(4)))


def _shown(new: date, order: tuple[int, int, int]) -> list[str]:
    """Day and month as written without leading zeros, in the order of the format."""
    parts = [str(new.year), str(new.month), str(new.day)]
    return [parts[order.index(k)] for k in range(3)]


def _date(value: str, key: bytes, back: bool) -> str | None:
    """Another date of the same length, written the same way. Unless all fields have two digits, each keeps its number of digits and
    its leading zero or lack of one; a month-first date stays one."""
    mark = next(c for c in value if not c.isdigit())
    fields = value.split(mark)
    parts = [int(x) for x in fields]
    order = (0, 1, 2) if mark == "-" else (2, 1, 0)  # where year, month and day stand
    if mark == "/" and parts[1] > 12:
        order = (2, 0, 1)  # month first
    try:
        day = date(*(parts[k] for k in order)).toordinal()
    except ValueError:
        return None
    if not FIRST_DAY <= day <= LAST_DAY:
        return None
    wide = all(len(x) >= 2 for x in fields)
    form = lambda xs: bytes(2 * len(x) + (x[0] == "0") for x in xs)
    tweak = (b"date" if mark != "/" else b"date/" + bytes(order)) + (b"" if wide else form(fields))
    while True:  # along the cycle to the next date of this form
        day = FIRST_DAY + permute(day - FIRST_DAY, LAST_DAY - FIRST_DAY + 1, key, tweak, back=back)
        new = date.fromordinal(day)
        shown = [x.zfill(len(y)) for x, y in zip(_shown(new, order), fields, strict=True)]
        if (order != (2, 0, 1) or new.day > 12) and (wide or form(shown) == form(fields)):
            return mark.join(shown)


def _letters(value: str, key: bytes, kind: str, back: bool) -> str:
    """Letters become letters of the same case, digits digits; what else there is stays."""
    signs = [c for c in value if c.isalnum()]
    sizes = [26 if c.isalpha() else 10 for c in signs]
    size, x = 1, 0
    for c, n in zip(signs, sizes, strict=True):
        x, size = x * n + (ord(c.lower()) - 97 if n == 26 else int(c)), size * n
    shape = "".join("a" if c.isalpha() else "0" if c.isdigit() else c for c in value)
    x, out = permute(x, size, key, kind.encode() + shape.encode(), back=back), []
    for n in reversed(sizes):
        x, r = divmod(x, n)
        out.append(chr(97 + r) if n == 26 else str(r))
    new = iter(reversed(out))
    return "".join((y.upper() if c.isupper() else y) if c.isalnum() and (y := next(new)) else c for c in value)


def _email(value: str, key: bytes, back: bool) -> str | None:
    """The local part and each label of the domain, but the last, which stays."""
    local, _, domain = value.partition("@")
    *labels, last = domain.split(".")
    return _letters(local, key, "email", back) + "@" + ".".join([*(_letters(x, key, "label", back) for x in labels), last])


MAKERS: dict[str, Callable[[str, bytes, bool], str | None]] = {"email": _email, "iban": _iban, "card": _card, "ssn": _ssn, "phone": _phone, "ip": _ip, "date": _date}


@lru_cache(200_000)
def pseudonym(kind: str, value: str, key: bytes, back: bool = False) -> str | None:
    """The pseudonym of a value, or none if it isn't valid; `back` undoes it."""
    return MAKERS[kind](value, key, back)


def valid_at(text: str, start: int, forms: list, key: bytes, back: bool) -> tuple[int, str, str] | None:
    """(end, kind, pseudonym) of the value that starts here: of the first kind that has a valid one, the longest."""
    for kind, form, no_more in forms:
        stop = len(text)
        while m := form.match(text, start, stop):
            stop = m.end() - 1
            if not no_more.match(text, m.end()) and (new := pseudonym(kind, m[0], key, back)) is not None:
                return m.end(), kind, new
    return None


def replaced(text: str, key: bytes, back: bool = False) -> tuple[str, list[tuple[int, int, str]]]:
    """The text with pseudonyms, and (start, end, kind) of what was replaced, in the original; the leftmost, then longest wins.

    Where nothing valid starts, the next start is tried, also one inside what was refused. With `back` values are undone as they
    are read, which for a number right before another may be with another end."""
    starts = [(m.start(), 1, NUMBER_FORMS) for m in NUMBER_START.finditer(text)]
    starts += [(m.start(), 2, IBAN_FORMS) for m in IBAN_START.finditer(text)]
    if "@" in text:
        starts += [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    parts, spans, at, best, place = [], [], 0, None, -1

    def take() -> None:
        nonlocal at, best
        if best:
            e, kind, new = best
            parts.extend((text[at:place], new))
            spans.append((place, e, kind))
            at, best = e, None

    for s, family, forms in sorted(starts, key=lambda x: x[:2]):
        if s != place:
            take()
        if s < at:
            continue
        place = s
        found = (forms, "email", pseudonym("email", text[s:forms], key, back)) if family == 0 else valid_at(text, s, forms, key, back)
        if found and found[2] is not None and (best is None or found[0] > best[0]):
            best = found
    take()
    return "".join([*parts, text[at:]]) if spans else text, spans


REPORT = "doc_id long, n_found long, spans string, text string"


def pseudonymised(docs: DataFrame, *, key: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_found, spans (kind:start:end in code points of the original, comma-joined), text (with pseudonyms)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [replaced(x or "", key) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(s) for _, s in done], pa.int64()), pa.array([",".join(f"{k}:{a}:{b}" for a, b, k in s) for _, s in done], pa.string()), pa.array([t for t, _ in done], pa.string())],
                [x.split()[0] for x in REPORT.split(", ")],
            )

    return id_and_text(docs, id_col, text_col).mapInArrow(run, REPORT)
