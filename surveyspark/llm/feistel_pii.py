"""Format-preserving pseudonyms for personal data, by keyed Feistel permutations.

Validated numbers (payment cards with a right check digit, phone numbers, IPv4 addresses), dates,
e-mail names and secret keys are replaced inside their own format: a balanced Feistel network over
the domain's size, walked until the result lies in the domain, permutes all values of a format with
one key. The same value becomes the same pseudonym in every document, different values stay
different, lengths and separators stay, cards keep a right check digit and dates stay dates. Keys of
hex digits keep their case, and a phone number its country code, however it is grouped; without one,
the groupings of North America and those with a leading zero are known.
Numbers that fail validation are left alone. `reveal` runs the rounds backwards.

Edge cases: a null text stays null, an empty one empty; repeated rows are changed alike; texts of
any length are read whole; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
import hmac
import re
from collections.abc import Callable
from datetime import date, timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, per_text

#: Key of the registered queries; a real run passes its own secret.
KEY = "key of the examples"
ROUNDS = 10
#: Dates are permuted among the days of these years.
FIRST_DAY, LAST_DAY = date(1900, 1, 1), date(2099, 12, 31)

_DIGITS, _LOWER = "0123456789", "abcdefghijklmnopqrstuvwxyz"
_UPPER = _LOWER.upper()

#: One pass finds all kinds; the alternatives start with different characters or are told apart by shape.
FINDER = re.compile(
    r"""
      (?P<email>[A-Za-z0-9][A-Za-z0-9._+-]*@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,})
    | (?P<aws>(?<![A-Za-z0-9])AKIA[A-Z0-9]{16}(?![A-Za-z0-9]))
    | (?P<secret>(?<![A-Za-z0-9])[0-9a-fA-F]{40}(?![A-Za-z0-9]))
    | (?P<phone>
        (?<![\w+])\+(?:
            \d{1,3}[ -]?\(?\d{2,4}\)?[ -]?\d{3}[ -]?\d{4}
          | \d{1,3}[ .-]\(?\d{1,5}\)?[ .-]\d{3,4}[ .-]\d{3,4}
          | \d{1,3}[ .-]\(?\d{1,4}\)?(?:[ .-]\d{2}){3,5}
          | \d{1,3}[ .-]?\(?\d{1,5}\)?[ .-]\d{5,9}
          | \d{8,15}
        )(?!\d)
      | (?<![\w(+])\(\d{3}\)[ -]?\d{3}[ .-]\d{4}(?!\d)
      | (?<![\w.+/-])(?<!\d[ ])\d{3}(?P<mark>[.-])\d{3}(?P=mark)\d{4}(?![\w/-]|[. ]\d)
      | (?<![\w.+/-])(?<!\d[ ])0\d{1,4}[ /-]\d{6,8}(?![\w/-]|[. ]\d)
      | (?<![\w.+/-])(?<!\d[ ])0\d(?:[ ]\d\d){4}(?![\w/-]|[. ]\d)
      )
    | (?P<ip>(?<![\d.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?![\d]|\.\d))
    | (?P<date>(?<![\d/.-])(?:\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{2}\.\d{2}\.\d{4}|\d{2}/\d{2}/\d{4})(?![\d]|[/-]\d))
    | (?P<ssn>(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-]))
    | (?P<card>(?<![\dA-Za-z])\d(?:[ -]?\d){12,18}(?![\dA-Za-z]))
    """,
    re.VERBOSE,
)
#: Cheap test: a text without any of these holds no kind.
_ANY = re.compile(r"[0-9@]|AKIA|[A-Fa-f]{40}")
#: Country codes of one and of two digits; all others have three.
_CODE = re.compile(r"\+(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})")


def _round(key: bytes, tweak: bytes, step: int, half: int, size: int) -> int:
    message = tweak + b"|%d|%d|%d" % (step, size, half)
    return int.from_bytes(hmac.digest(key, message, hashlib.sha256)[:16], "big")


def permute(value: int, size: int, key: bytes, tweak: bytes, back: bool = False) -> int:
    """A keyed permutation of `range(size)`: Feistel rounds on two halves, walked into the range."""
    if size < 2:
        return value
    side = max(2, int(size**0.5))
    while side * side < size:
        side += 1
    while True:
        left, right = divmod(value, side)
        for step in reversed(range(ROUNDS)) if back else range(ROUNDS):
            if back:
                left, right = (right - _round(key, tweak, step, left, size)) % side, left
            else:
                left, right = right, (left + _round(key, tweak, step, right, size)) % side
        value = left * side + right
        if value < size:
            return value


def _in_alphabets(text: str, key: bytes, tweak: bytes, back: bool) -> str:
    """Permute letters, capitals and digits in their places; other characters stay."""
    sets = [next((a for a in (_DIGITS, _LOWER, _UPPER) if c in a), None) for c in text]
    size = value = 1
    value = 0
    for c, a in zip(text, sets):
        if a:
            value, size = value * len(a) + a.index(c), size * len(a)
    value = permute(value, size, key, tweak + b"|" + "".join(a[0] if a else c for c, a in zip(text, sets)).encode(), back)
    out = []
    for c, a in zip(reversed(text), reversed(sets)):
        if a:
            value, at = divmod(value, len(a))
            c = a[at]
        out.append(c)
    return "".join(reversed(out))


def _with_digits(shape: str, digits: str) -> str:
    rest = iter(digits)
    return "".join(next(rest) if c.isdigit() else c for c in shape)


def check_digit(body: str) -> str:
    """The digit that completes a payment card number."""
    total = 0
    for k, c in enumerate(reversed(body)):
        d = int(c) * (2 - k % 2)
        total += d - 9 if d > 9 else d
    return str(-total % 10)


def _card(text: str, key: bytes, back: bool) -> str | None:
    digits = re.sub(r"\D", "", text)
    if check_digit(digits[:-1]) != digits[-1]:
        return None
    n = len(digits) - 1
    body = f"{permute(int(digits[:-1]), 10**n, key, b'card%d' % n, back):0{n}d}"
    return _with_digits(text, body + check_digit(body))


def _phone(text: str, key: bytes, back: bool) -> str:
    """The country code, or the zero that leads a number without one, stays; the digits behind are permuted."""
    digits = re.sub(r"\D", "", text)
    if text[0] == "+":
        code = _CODE.match("+" + digits).group()
    else:
        code = "0" if text[0] == "0" else ""
    rest = digits[len(code.lstrip("+")) :]
    n = len(rest)
    new = f"{permute(int(rest), 10**n, key, b'phone' + code.encode(), back):0{n}d}"
    return _with_digits(text, code.lstrip("+") + new)


def _ip(text: str, key: bytes, back: bool) -> str | None:
    parts = [int(p) for p in text.split(".")]
    if max(parts) > 255 or any(len(p) > 1 and p[0] == "0" for p in text.split(".")):
        return None
    value = permute(int.from_bytes(bytes(parts), "big"), 2**32, key, b"ip", back)
    return ".".join(map(str, value.to_bytes(4, "big")))


def _date(text: str, key: bytes, back: bool) -> str | None:
    if text[4] in "-/":
        order, mark = "ymd", text[4]
    else:
        order, mark = "dmy", text[2]
    parts = dict(zip(order, map(int, text.split(mark))))
    if mark == "/" and order == "dmy" and parts["m"] > 12:  # month first
        order = "mdy"
        parts["d"], parts["m"] = parts["m"], parts["d"]
    try:
        day = date(parts["y"], parts["m"], parts["d"])
    except ValueError:
        return None
    if not FIRST_DAY <= day <= LAST_DAY:
        return None
    # one permutation of days for all writings; days above the 12th stay so, as they tell month-first texts apart
    size, late = (LAST_DAY - FIRST_DAY).days + 1, day.day > 12
    while True:
        day = FIRST_DAY + timedelta(permute((day - FIRST_DAY).days, size, key, b"date", back))
        if (day.day > 12) == late:
            break
    values = {"y": f"{day.year:04d}", "m": f"{day.month:02d}", "d": f"{day.day:02d}"}
    return mark.join(values[c] for c in order)


def _ssn(text: str, key: bytes, back: bool) -> str:
    return _with_digits(text, f"{permute(int(text.replace('-', '')), 10**9, key, b'ssn', back):09d}")


def _email(text: str, key: bytes, back: bool) -> str:
    """Letters stay letters, so the case of each is laid over the pseudonym of the lower-case address."""
    name, _, host = text.partition("@")
    new = _in_alphabets(name.lower(), key, b"email|" + host.lower().encode(), back)
    return f"{''.join(n.upper() if c.isupper() else n for c, n in zip(name, new))}@{host}"


def _aws(text: str, key: bytes, back: bool) -> str:
    letters = _UPPER + _DIGITS
    value = 0
    for c in text[4:]:
        value = value * 36 + letters.index(c)
    value, out = permute(value, 36**16, key, b"aws", back), []
    for _ in range(16):
        value, at = divmod(value, 36)
        out.append(letters[at])
    return "AKIA" + "".join(reversed(out))


def _secret(text: str, key: bytes, back: bool) -> str:
    """Digits and letters of one case are permuted together; in mixed case each stays what it is."""
    if text.lower() == text or text.upper() == text:
        value = int(text, 16)
        while True:
            value = permute(value, 16**40, key, b"secret", back)
            new = f"{value:040x}"
            if new.isdigit() == text.isdigit():  # the case could not be told from digits alone
                return new if text.lower() == text else new.upper()
    sets = ["abcdef" if c.islower() else "ABCDEF" if c.isupper() else _DIGITS for c in text]
    value, size = 0, 1
    for c, a in zip(text, sets):
        value, size = value * len(a) + a.index(c), size * len(a)
    value = permute(value, size, key, b"secret|" + "".join(a[0] for a in sets).encode(), back)
    out = []
    for a in reversed(sets):
        value, at = divmod(value, len(a))
        out.append(a[at])
    return "".join(reversed(out))


KINDS: dict[str, Callable[[str, bytes, bool], str | None]] = {
    "email": _email,
    "aws": _aws,
    "secret": _secret,
    "phone": _phone,
    "ip": _ip,
    "date": _date,
    "ssn": _ssn,
    "card": _card,
}


@functools.lru_cache(maxsize=100_000)
def pseudonym(kind: str, value: str, key: str, back: bool = False) -> str | None:
    """The pseudonym of a value, or None where it fails validation."""
    return KINDS[kind](value, key.encode(), back)


def replace(text: str | None, key: str, back: bool = False) -> tuple[str | None, int]:
    """The text with pseudonyms, and how many there are."""
    if text is None or not _ANY.search(text):
        return text, 0
    count = 0

    def swap(match: re.Match) -> str:
        nonlocal count
        kind = next(k for k in KINDS if match[k] is not None)
        new = pseudonym(kind, match.group(), key, back)
        count += new is not None
        return match.group() if new is None else new

    return FINDER.sub(swap, text), count


def pseudonymise(df: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`doc_id`, `text` with pseudonyms and `n_replaced` for every document."""
    return per_text(id_and_text(df, id_col, text_col), "text string, n_replaced long", lambda t: replace(t, key))


def reveal(df: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The inverse of `pseudonymise` under the same key."""
    return per_text(
        id_and_text(df, id_col, text_col), "text string, n_replaced long", lambda t: replace(t, key, True)
    )


def with_pseudonyms(df: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """All columns of `df`, with pseudonyms in the text."""

    @F.pandas_udf("string")
    def changed(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: replace(t, key)[0], na_action="ignore")

    return df.withColumn(text_col, changed(F.col(text_col).cast("string")))
