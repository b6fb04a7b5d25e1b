"""Operator 6: format-preserving Feistel pseudonyms for personal data.

Values are found by pattern, validated, and permuted by a keyed Feistel network within the
set of valid values of their format: a card number stays one of its network with a right
check digit, a date a date, an address an address. The permutation depends on the key and the
value alone, so equal values stay equal over all documents and runs, and different ones
different. Telephone numbers keep their country code, dates their width. What looks like a value but isn't a valid one (a long number without a card's
prefix and check digit, an impossible date or social security number, a code of no country, four
numbers of a version) is left alone. An
email keeps its domain, which is part of its format.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from datetime import date, timedelta
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import real_id, texts

ROUNDS = 10
DAY_0, DAYS = date(1900, 1, 1), (date(2100, 1, 1) - date(1900, 1, 1)).days
KINDS = ["email", "secret", "iban", "date", "ip", "ssn", "phone", "card"]
#: Patterns by kind; in this order the first that fits a place is tried.
PATTERNS = {
    "email": r"(?<![\w.+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63})+",
    "secret": r"(?<![A-Za-z0-9])(?:[A-Z]{4}[A-Z0-9]{16}|[0-9a-f]{32,64}|[0-9A-F]{32,64})(?![A-Za-z0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?(?![A-Za-z0-9])",
    "date": r"(?<![\d./-])(?:\d{4}-\d{2}-\d{2}|\d{1,2}[./]\d{1,2}[./]\d{4})(?![\d/-])",
    "ip": r"(?<![\d.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?![\d]|\.\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"(?<![\d+])(?:\+1[ .-]?)?(?:\(\d{3}\)[ .-]?|(?<!\d)\d{3}[ .-])\d{3}[ .-]\d{4}(?!\d)|(?<![\w+])\+[1-9]\d{0,2}(?:[ .-]?\(\d{1,5}\))?(?:[ .-]?\d){4,14}(?!\d)",
    "card": r"(?<![\w.])(?:\d{13,19}|\d{4}(?P<four>[ -])\d{4}(?P=four)\d{4}(?P=four)\d{1,7}|\d{4}(?P<six>[ -])\d{6}(?P=six)\d{4,5})(?!\w|\.\d)",
}
#: Card networks with the ranges of their numbers' first digits, and the lengths that they have.
NETWORKS = [
    ("visa", [("4", "4")], (13, 16, 19)),
    ("mastercard", [("51", "55"), ("2221", "2720")], (16,)),
    ("american express", [("34", "34"), ("37", "37")], (15,)),
    ("discover", [("6011", "6011"), ("644", "649"), ("65", "65")], (16, 19)),
    ("diners", [("300", "305"), ("36", "36"), ("38", "39")], (14,)),
    ("jcb", [("3528", "3589")], (16, 19)),
    ("unionpay", [("62", "62")], (16, 17, 18, 19)),
]
FINDER = re.compile("|".join(f"(?P<{k}>{PATTERNS[k]})" for k in KINDS))
#: Country codes of telephone numbers, but for 1, in the numbering plan of each world zone. The others of a zone have three digits.
COUNTRIES = {"7"} | set("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
#: First two digits of the country codes of three.
COUNTRIES_3 = set("21 22 23 24 25 26 29 35 37 38 42 50 59 67 68 69 80 85 87 88 96 97 99".split())
#: Codes of three digits that no country has.
FREE = set("210 214 215 217 219 259 292 293 294 295 296 384 693 694 695 696 697 698 699 801 802 803 804 805 806 807 809 851 854 857 858 859 871 872 873 874 875 876 877 879 884 885 887 889 969 978 990 999".split())
#: What stands before four numbers of a version, not of an address.
VERSION = re.compile(r"(?:\bv|version|release|build|section|chapter)[ :=.]*$", re.IGNORECASE)
#: First letters of access keys, which may have no digit.
ACCESS_KEYS = ("AKIA", "ASIA")
#: Every pattern has an @, a digit or such first letters.
WORTH = "[0-9@]|AKIA|ASIA"


def permute(value: int, size: int, key: bytes, tweak: bytes) -> int:
    """A keyed permutation of range(size): a balanced Feistel network, walked until it is back inside."""
    if size < 2:
        return value
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1
    while True:
        left, right = value >> half, value & mask
        for i in range(ROUNDS):
            seen = blake2b(tweak + bytes([i]) + right.to_bytes(half // 8 + 1, "little"), key=key, digest_size=64).digest()
            left, right = right, left ^ (int.from_bytes(seen, "little") & mask)
        value = left << half | right
        if value < size:
            return value


def _walk(value: int, size: int, key: bytes, tweak: bytes, alike: Callable[[int], object]) -> int:
    """``permute`` walked on to the next value of the same class: a permutation of each class."""
    kind, out = alike(value), permute(value, size, key, tweak)
    while alike(out) != kind:
        out = permute(out, size, key, tweak)
    return out


def luhn(digits: str) -> int:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10


def network(digits: str) -> str | None:
    """The card network that has numbers of this length with these first digits."""
    for name, ranges, lengths in NETWORKS:
        if len(digits) in lengths and any(a <= digits[: len(a)] <= b for a, b in ranges):
            return name
    return None


def _refill(shape: str, symbols: str) -> str:
    """``shape`` with its letters and digits replaced by ``symbols`` in order, letters in the old case."""
    left = iter(symbols)
    return "".join((x.upper() if c.isupper() else x) if c.isalnum() and (x := next(left)) is not None else c for c in shape)


def _mixed(value: str, key: bytes, tweak: bytes, letters: str = "abcdefghijklmnopqrstuvwxyz") -> str:
    """Letters stay letters and digits digits, in any mix."""
    n, size = 0, 1
    for c in value:
        own = "0123456789" if c.isdigit() else letters
        n, size = n * len(own) + own.index(c), size * len(own)
    n, out = permute(n, size, key, tweak), []
    for c in reversed(value):
        own = "0123456789" if c.isdigit() else letters
        n, i = divmod(n, len(own))
        out.append(own[i])
    return "".join(reversed(out))


def _digits(n: int, k: int) -> str:
    return str(n).rjust(k, "0")


def _email(s, key):
    user, _, domain = s.partition("@")
    plain = re.sub(r"[^a-z0-9]", "", user.lower())
    return _refill(user, _mixed(plain, key, b"email" + domain.lower().encode())) + "@" + domain


def _secret(s, key):
    if re.fullmatch("[A-Z]{4}[A-Z0-9]{16}", s):
        if not re.search(r"\d", s) and s[:4] not in ACCESS_KEYS:
            return None
        return s[:4] + _refill(s[4:], _mixed(s[4:].lower(), key, s[:4].encode()))
    low = s.lower()
    if low.isdigit() or low.isalpha():
        return None
    n = _walk(int(low, 16), 16 ** len(low), key, b"hex", lambda x: (h := f"{x:0{len(low)}x}").isdigit() or h.isalpha())
    out = f"{n:0{len(low)}x}"
    return out.upper() if s.isupper() else out


def _iban(s, key):
    plain = s.replace(" ", "")
    number = lambda x: int("".join(str(int(c, 36)) for c in x))
    if not 15 <= len(plain) <= 34 or number(plain[4:] + plain[:4]) % 97 != 1:
        return None
    body = _mixed(plain[4:].lower(), key, b"iban" + plain[:2].encode()).upper()
    return _refill(s, plain[:2] + _digits(98 - number(body + plain[:2] + "00") % 97, 2) + body)


def _date(s, key):
    parts = [int(x) for x in re.split(r"\D", s)]
    orders = [(0, 1, 2)] if s[4:5] == "-" else [(2, 1, 0), (2, 0, 1)]
    for order in orders:
        try:
            at = (date(*(parts[i] for i in order)) - DAY_0).days
        except ValueError:
            continue
        if not 0 <= at < DAYS:
            return None
        # A day-month order that is also a month-day order must stay one, to be read the same way again.
        both = lambda n: len(orders) == 2 and (DAY_0 + timedelta(n)).day > 12
        new = DAY_0 + timedelta(_walk(at, DAYS, key, b"date", both))
        values = {order[0]: new.year, order[1]: new.month, order[2]: new.day}
        seps = re.findall(r"\D", s)
        # Dates written without leading zeros stay so; the value, and so its link, is the same in either format.
        written = re.split(r"\D", s)
        wide = 1 if any(len(x) == 1 for x in written) else 2
        texts_ = [_digits(values[i], 4 if i == order[0] else 2 if written[i][0] == "0" else wide) for i in range(3)]
        return texts_[0] + seps[0] + texts_[1] + seps[1] + texts_[2]
    return None


def _ip(s, key):
    octets = [int(x) for x in s.split(".")]
    if max(octets) > 255:
        return None
    n = permute(int.from_bytes(bytes(octets), "big"), 1 << 32, key, b"ip")
    return ".".join(map(str, n.to_bytes(4, "big")))


def _ssn(s, key):
    plain = s.replace("-", "")
    ok = lambda n: (d := _digits(n, 9))[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"
    if not ok(int(plain)):
        return None
    return _refill(s, _digits(_walk(int(plain), 10**9, key, b"ssn", ok), 9))


def country(digits: str) -> str | None:
    """The country code that an international number starts with, if there is one of its digits."""
    if digits[:1] == "1" or digits[:1] in COUNTRIES:
        return digits[0]
    if digits[:2] in COUNTRIES:
        return digits[:2]
    return digits[:3] if digits[:2] in COUNTRIES_3 and digits[:3] not in FREE else None


def _phone(s, key):
    if s[0] == "+" and "(0)" in s:
        # The trunk prefix is no part of the number.
        out = _phone(s.replace("(0)", "()", 1), key)
        return out and out.replace("()", "(0)", 1)
    plain = re.sub(r"\D", "", s)
    head = country(plain) if s[0] == "+" else ""
    if head is None:
        return None
    own = plain[len(head) :]
    k = len(own)
    # Ten digits with 1 or no code: with neither area nor exchange from 0 or 1 they can be dialled. Others need
    # the code to be taken for a number, and must not have zeros alone there. Elsewhere it is 8 to 15 digits with
    # the code; a first zero is the trunk prefix or none, and stays.
    dials = lambda d: d[0] > "1" and d[3] > "1"
    if not head:
        ok = lambda d: len(d) == 10 and dials(d)
    elif head == "1":
        ok = lambda d: len(d) == 10 and dials(d) == dials(own) and d[:3] != "000" != d[3:6]
    else:
        ok = lambda d: 8 <= len(head) + k <= 15 and (d[0] == "0") == (own[0] == "0")
    if not ok(own):
        return None
    return _refill(s, head + _digits(_walk(int(own), 10**k, key, b"phone" + head.encode(), lambda n: ok(_digits(n, k))), k))


def _card(s, key):
    plain = re.sub(r"\D", "", s)
    own, k = network(plain), len(plain) - 1
    if own is None or luhn(plain):
        return None
    # All digits but the last are permuted within the network's numbers; the last one is the check digit.
    body = _digits(_walk(int(plain[:-1]), 10**k, key, b"card%d" % k, lambda n: network(_digits(n, k) + "0") == own), k)
    return _refill(s, body + str(-luhn(body + "0") % 10))


MAKERS = {"email": _email, "secret": _secret, "iban": _iban, "date": _date, "ip": _ip, "ssn": _ssn, "phone": _phone, "card": _card}


@lru_cache(1 << 16)
def pseudonym(kind: str, value: str, key: bytes) -> str | None:
    """The pseudonym of a value, or None if it isn't a valid one of its kind."""
    return MAKERS[kind](value, key)


def rewrite(text: str, key: bytes) -> tuple[str, list[int]]:
    """``text`` with all values replaced, and how many of each kind of KINDS."""
    counts = [0] * len(KINDS)

    def put(m: re.Match) -> str:
        if m.lastgroup == "ip" and VERSION.search(text, max(0, m.start() - 16), m.start()):
            return m.group()
        new = pseudonym(m.lastgroup, m.group(), key)
        if new is None:
            return m.group()
        counts[KINDS.index(m.lastgroup)] += 1
        return new

    return FINDER.sub(put, text), counts


def _batch(texts_: pa.Array, key: bytes) -> tuple[pa.Array, np.ndarray]:
    worth = np.asarray(pc.match_substring_regex(texts_, WORTH))
    out, counts = texts_.to_pylist() if worth.any() else None, np.zeros((len(texts_), len(KINDS)), np.int64)
    for i in np.flatnonzero(worth):
        out[i], counts[i] = rewrite(out[i], key)
    return (texts_ if out is None else pa.array(out, texts_.type)), counts


def pseudonymise(docs: DataFrame, key: bytes) -> DataFrame:
    """``doc_id, text, n_values, n_<kind>...`` of each row of ``docs``.

    Null text comes back empty; a null id null; a text of any length is read whole; repeated
    rows give a row each; an empty table gives an empty result; other columns are not used.
    """

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new, counts = _batch(batch["text"], key)
            yield pa.record_batch({"doc_id": batch["doc_id"], "text": new, "n_values": pa.array(counts.sum(1)), **{f"n_{k}": pa.array(counts[:, i]) for i, k in enumerate(KINDS)}})

    schema = "doc_id long, text string, n_values long, " + ", ".join(f"n_{k} long" for k in KINDS)
    return texts(docs).mapInArrow(put, schema).withColumn("doc_id", real_id())


def rewrite_texts(docs: DataFrame, key: bytes) -> DataFrame:
    """``docs`` with ``text`` rewritten and ``n_chars``, if there, counted anew; all other columns as they are.

    Null and empty texts stay so, as does a null id; a text of any length is read whole; rows,
    repeated ones too, are rewritten each by itself; an empty table gives an empty result.
    """
    worth = re.compile(WORTH).search

    @F.pandas_udf("string")
    def put(column: pd.Series) -> pd.Series:
        return column.map(lambda t: rewrite(t, key)[0] if worth(t) else t, na_action="ignore")

    out = docs.withColumn("text", put("text"))
    return out.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else out
