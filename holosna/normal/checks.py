"""Whether dates, numerals and identifiers of a single text are valid."""

from __future__ import annotations

from holosna.normal import rx
from holosna.functions import tables as T

# --- fixed values: figures of Roman numerals, weights of the check digit of a VIN -----------------------------------------------
ROMAN = {"I": 1, "V": 5, "X": 10, "L": 50, "C": 100, "D": 500, "M": 1000}
VIN_WEIGHTS = [8, 7, 6, 5, 4, 3, 2, 10, 0, 9, 8, 7, 6, 5, 4, 3, 2]
VIN_VALUES = dict(zip("0123456789ABCDEFGHJKLMNPRSTUVWXYZ", [*range(10), *range(1, 9), *range(1, 6), 7, 9, *range(2, 10)], strict=True))


def compact(text: str) -> str:
    return rx.sub("[^0-9A-Z]", "", rx.sub("[a-z]", lambda m: m[0].upper(), text))


def roman(text: str) -> int:
    """The value by subtraction of a figure before a greater one; other letters count nothing."""
    values = [ROMAN.get(c, 0) for c in text]
    return max(0, sum(-v if v < after else v for v, after in zip(values, [*values[1:], 0], strict=True)))


def valid_roman(text: str) -> bool:
    """Of the classic shape; the empty string is."""
    return rx.fullmatch("M{0,4}(?:CM|CD|D?C{0,3})(?:XC|XL|L?X{0,3})(?:IX|IV|V?I{0,3})", text) is not None


def is_leap(year: int) -> bool:
    return year % 4 == 0 and (year % 100 != 0 or year % 400 == 0)


def valid_date(day: int, month: int, year: int) -> bool:
    most = (31, 29 if is_leap(year) else 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)
    return 1 <= month <= 12 and 1 <= day <= most[month - 1]


def valid_week(year: int, week: int) -> bool:
    p = year - 1
    first = (p + p // 4 - p // 100 + p // 400 + 1) % 7
    return 1 <= week <= 52 or (week == 53 and (first == 4 or (first == 3 and is_leap(year))))


def _descending(text: str) -> bool:
    """Digits, the last of which may be X, weighted down to 1, sum to a multiple of 11."""
    values = [10 if c == "X" else int(c) for c in text]
    return sum(v * w for v, w in zip(values, range(len(values), 0, -1), strict=True)) % 11 == 0


def valid_isbn(text: str) -> bool:
    c = compact(text)
    if rx.fullmatch("[0-9]{9}[0-9X]", c):
        return _descending(c)
    return rx.fullmatch("97[89][0-9]{10}", c) is not None and sum(int(d) * (1, 3)[i % 2] for i, d in enumerate(c)) % 10 == 0


def valid_issn(text: str) -> bool:
    c = compact(text)
    return rx.fullmatch("[0-9]{7}[0-9X]", c) is not None and _descending(c)


def valid_iban(text: str) -> bool:
    c = compact(text)
    if not rx.fullmatch("[A-Z]{2}[0-9]{2}[0-9A-Z]{11,30}", c) or T.IBAN_LENGTHS.get(c[:2], len(c)) != len(c):
        return False
    return int("".join(str(int(x, 36)) for x in c[4:] + c[:4])) % 97 == 1


def valid_luhn(text: str) -> bool:
    """12 to 19 digits; blanks and hyphens may stand between them."""
    digits = rx.sub("[ -]", "", text)
    if not rx.fullmatch("[0-9]{12,19}", digits):
        return False
    return sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def valid_vin(text: str) -> bool:
    """17 characters; the check digit is binding for North America (first character 1 to 5)."""
    c = compact(text)
    if len(c) != 17 or not set(c) <= set(VIN_VALUES):
        return False
    rest = sum(VIN_VALUES[x] * w for x, w in zip(c, VIN_WEIGHTS, strict=True)) % 11
    return c[0] not in "12345" or c[8] == "0123456789X"[rest]


def valid_uuid(text: str) -> bool:
    """32 hex digits, all zero or of a known version and variant."""
    return rx.fullmatch("0{32}|[0-9A-F]{12}[1-8][0-9A-F]{3}[89AB][0-9A-F]{15}", compact(text)) is not None


def valid_hash_length(algorithm: str, digest: str) -> bool:
    c = compact(digest)
    return T.HASH_LENGTHS.get(compact(algorithm)) == len(c) and rx.fullmatch("[0-9A-F]*", c) is not None
