"""Format-preserving pseudonyms for personal data: keyed Feistel permutations of validated values."""

from __future__ import annotations

import datetime as dt
import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from math import isqrt

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
KINDS = ("email", "iban", "secret", "card", "ip", "phone", "ssn", "date")
FIND = re.compile(
    r"""(?P<email>(?<![\w.+-])[\w.+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8})
    |(?P<iban>\b[A-Z]{2}\d{2}(?:\ ?[A-Z0-9]{4}){2,7}(?:\ ?[A-Z0-9]{1,3})?\b)
    |(?:(?i:password|passwd|token|secret|api_?key)\s*[=:]\s*["']?(?P<secret>[0-9A-Fa-f]{12,128})\b)
    |(?P<card>(?<![\d.-])\d(?:[ -]?\d){12,18}(?![\d-]))
    |(?P<ip>(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?![\d.]*\d))
    |(?P<phone>(?:(?<![\d+])\+?1[ .-]?)?(?:\(\d{3}\)[ ]?|(?<![\d-])\d{3}[ .-])[2-9]\d\d[ .-]\d{4}(?!\d))
    |(?P<ssn>(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-]))
    |(?P<date>(?<![\d./-])(?:\d{4}-\d{2}-\d{2}|\d{2}[./]\d{2}[./]\d{4})(?![\d/-]))""",
    re.X,
)
LEAST = {"card": 13, "iban": 12}  # letters and digits of kinds that groups beside them are taken for parts of
FIRST_DAY, LAST_DAY = dt.date(1900, 1, 1).toordinal(), dt.date(2099, 12, 31).toordinal()


def _mix(key: bytes, tweak: str, i: int, value: int, size: int) -> int:
    """A number in [0, size), from 64 bytes more than size needs at least 8."""
    data = f"{tweak}|{i}|{value}".encode()
    return int.from_bytes(hashlib.shake_256(key + b"|" + data).digest((size.bit_length() + 7) // 8 + 8)) % size


def permute(value: int, size: int, key: bytes, tweak: str, inverse: bool = False) -> int:
    """A keyed permutation of [0, size): an alternating Feistel network on a * b >= size, walked until inside."""
    if size < 2:
        return value
    a = isqrt(size - 1) + 1
    b = -(-size // a)
    while True:
        left, right = divmod(value, b)
        for i in reversed(range(ROUNDS)) if inverse else range(ROUNDS):
            sign = -1 if inverse else 1
            if i % 2:
                right = (right + sign * _mix(key, tweak, i, left, b)) % b
            else:
                left = (left + sign * _mix(key, tweak, i, right, a)) % a
        value = left * b + right
        if value < size:
            return value


def _class(c: str) -> str | None:
    for digits in ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"):
        if c in digits:
            return digits
    return None


def _letters(text: str, key: bytes, tweak: str, inverse: bool, alphabet: str = "") -> str:
    """Each letter or digit stays one of its class; other characters stay. All of them are one mixed-radix number."""
    classes = [alphabet or _class(c) for c in text]
    value, size = 0, 1
    for c, digits in zip(text, classes, strict=True):
        if digits:
            value, size = value * len(digits) + digits.index(c), size * len(digits)
    shape = "".join(d[0] if d else "_" for d in classes)
    value, out = permute(value, size, key, f"{tweak}|{shape}", inverse), []
    for c, digits in zip(reversed(text), reversed(classes), strict=True):
        if digits:
            value, r = divmod(value, len(digits))
            c = digits[r]
        out.append(c)
    return "".join(reversed(out))


def _hex(text: str, key: bytes, inverse: bool) -> str:
    """Hex digits stay lower, upper or mixed case: the permutation is walked until the image is of the value's own case."""
    if not re.search("[A-F]", text):
        return _letters(text, key, "secret", inverse, "0123456789abcdef")
    mixed = bool(re.search("[a-f]", text))
    while True:
        text = _letters(text, key, "secret", inverse, "0123456789abcdefABCDEF" if mixed else "0123456789ABCDEF")
        if re.search("[A-F]", text) and (not mixed or re.search("[a-f]", text)):
            return text


def _refill(form: str, digits: str) -> str:
    """form with its digits replaced in turn."""
    it = iter(digits)
    return re.sub(r"\d", lambda _: next(it), form)


def luhn(payload: str) -> str:
    """The check digit after payload."""
    total = sum((d * 2 - 9 if d > 4 else d * 2) if i % 2 == 0 else d for i, d in enumerate(map(int, reversed(payload))))
    return str(-total % 10)


def _iban_check(country: str, bban: str) -> str:
    return f"{98 - int(''.join(str(int(c, 36)) for c in bban + country + '00')) % 97:02d}"


def pseudonym(kind: str, text: str, key: bytes, inverse: bool = False) -> str | None:
    """The value's pseudonym in the same format, valid by the same rules; None where the value isn't valid."""
    if kind == "email":
        local, at, domain = text.partition("@")
        return _letters(local, key, "email|" + domain, inverse) + at + domain
    if kind == "secret":
        return _hex(text, key, inverse)
    if kind == "iban":
        flat = text.replace(" ", "")
        if _iban_check(flat[:2], flat[4:]) != flat[2:4]:
            return None
        bban = _letters(flat[4:], key, "iban" + flat[:2], inverse)
        it = iter(flat[:2] + _iban_check(flat[:2], bban) + bban)
        return "".join(c if c == " " else next(it) for c in text)
    if kind == "ip":
        parts = [int(x) for x in text.split(".")]
        if max(parts) > 255 or any(str(int(x)) != x for x in text.split(".")):
            return None
        return ".".join(map(str, permute(int.from_bytes(bytes(parts)), 1 << 32, key, "ip", inverse).to_bytes(4)))
    digits = re.sub(r"\D", "", text)
    if kind == "card":
        if luhn(digits[:-1]) != digits[-1]:
            return None
        n = len(digits) - 2  # the first digit tells the kind of card and stays
        body = f"{permute(int(digits[1:-1]), 10**n, key, f'card{digits[0]}{n}', inverse):0{n}d}"
        return _refill(text, digits[0] + body + luhn(digits[0] + body))
    if kind == "phone":
        own = digits[-10:]
        first, areas, tweak = (200, 800, "phone") if own[0] > "1" else (0, 200, "phone01")  # area codes that exist, and others
        area, exchange, rest = int(own[:3]) - first, int(own[3:6]) - 200, int(own[6:])
        value = permute((area * 800 + exchange) * 10_000 + rest, areas * 800 * 10_000, key, tweak, inverse)
        area, exchange, rest = value // 8_000_000, value // 10_000 % 800, value % 10_000
        return _refill(text, f"{digits[:-10]}{area + first:03d}{exchange + 200}{rest:04d}")
    if kind == "ssn":
        area, group, serial = int(digits[:3]), int(digits[3:5]), int(digits[5:])
        if area in (0, 666) or area > 899 or not group or not serial:
            return None
        rank = area - 1 - (area > 666)
        value = permute((rank * 99 + group - 1) * 9999 + serial - 1, 898 * 99 * 9999, key, "ssn", inverse)
        rank, group, serial = value // (99 * 9999), value // 9999 % 99 + 1, value % 9999 + 1
        return _refill(text, f"{rank + 1 + (rank >= 665):03d}{group:02d}{serial:04d}")
    return _date(text, digits, key, inverse)


def _date(text: str, digits: str, key: bytes, inverse: bool) -> str | None:
    """Year-month-day, day.month.year or month/day/year; a day of 1900 to 2099 becomes another."""
    order = (0, 4, 6) if "-" in text else (4, 2, 0) if "." in text else (4, 0, 2)
    try:
        day = dt.date(int(digits[order[0] : order[0] + 4]), int(digits[order[1] : order[1] + 2]), int(digits[order[2] : order[2] + 2]))
    except ValueError:
        return None
    if not FIRST_DAY <= day.toordinal() <= LAST_DAY:
        return None
    new = dt.date.fromordinal(FIRST_DAY + permute(day.toordinal() - FIRST_DAY, LAST_DAY - FIRST_DAY + 1, key, "date", inverse))
    return new.strftime("%Y-%m-%d" if "-" in text else "%d.%m.%Y" if "." in text else "%m/%d/%Y")


def replace(text: str, key: bytes, inverse: bool = False) -> tuple[str, Counter]:
    """text with every valid value replaced, and how many of each kind."""
    found: Counter = Counter()
    if not re.search("[0-9@]", text):
        return text, found
    out, done, at = [], 0, 0
    while m := FIND.search(text, at):
        kind = m.lastgroup
        a, b = m.span(kind)
        new = pseudonym(kind, m[kind], key, inverse)
        if new is None and kind in LEAST:
            a, b, new = _within(kind, text, a, b, key, inverse)
        if new is None:
            border = re.search("[ -]", m[kind]) if kind in LEAST else None  # a value may begin behind its first group
            at = m.start(kind) + border.end() if border else m.end()
            continue
        found[kind] += 1
        out += [text[done:a], new]
        done = at = b
    return "".join([*out, text[done:]]), found


def _within(kind: str, text: str, a: int, b: int, key: bytes, inverse: bool) -> tuple[int, int, str | None]:
    """The first and longest run of whole groups of text[a:b] that is valid, though the whole isn't, and its pseudonym."""
    borders = [(a + m.start(), a + m.end()) for m in re.finditer("[ -]", text[a:b])]
    begins = [a] + ([end for _, end in borders] if kind == "card" else [])
    for begin in begins:
        for end in [b, *(start for start, _ in reversed(borders))]:
            if sum(c.isalnum() for c in text[begin:end]) < LEAST[kind]:
                break
            if new := pseudonym(kind, text[begin:end], key, inverse):
                return begin, end, new
    return a, b, None


def pseudonymise(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text", inverse: bool = False) -> DataFrame:
    """(id, text, n_<kind> for each of KINDS): whole texts with personal values replaced by pseudonyms.

    A value is permuted within its format by a key that is kept apart from the data: the same value has the same pseudonym
    in all documents, however its digits are grouped, and the key takes it back (inverse). Card numbers must pass the Luhn
    test, IBANs theirs, IP octets, SSN parts and dates must be possible; others stay as they are. Where a run of digit groups
    fails, its first and longest part of whole groups that passes is the value; a pseudonym that happens to pass together
    with the groups beside it is not taken back. Area codes 000 to 199 stay among themselves.

    The formats are the limit: dates as year-month-day, day.month.year or month/day/year, phones of three, three and four digits
    with or without +1, IPv4 addresses. Of kinds that overlap the one that begins first is taken, then the first of KINDS.

    A null text stays null, an empty one empty; a very long one is searched whole, in time that grows with its length; ids may
    be null or repeat; other columns are not looked at. There is no shuffle.
    """
    schema = pa.schema([pa.field("id", pa.int64()), pa.field("text", pa.string()), *(pa.field(f"n_{k}", pa.int32()) for k in KINDS)])
    secret = key.encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.slice(at, 500)
                done = [(None, Counter()) if t is None else replace(t, secret, inverse) for t in part.column(1).to_pylist()]
                counts = [pa.array([c[k] for _, c in done], pa.int32()) for k in KINDS]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([t for t, _ in done], pa.string()), *counts], schema=schema)

    columns = "id bigint, text string, " + ", ".join(f"n_{k} int" for k in KINDS)
    return docs.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(run, columns)
