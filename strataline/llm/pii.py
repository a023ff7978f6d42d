"""Operator 8: format-preserving Feistel pseudonyms for personal data.

What is found is validated first (card numbers by Luhn, IBANs by mod 97, addresses by octet, social security numbers by
their reserved ranges, dates by the calendar, phone numbers by length) and then permuted by a key within the set of
strings of its format, by rank in that set. The tweak is the kind and shape alone, so equal values get equal pseudonyms
in every document, different ones of a shape different ones, and the key restores them.

    email   local part (the domain stays)       card   all but the check digit, which is computed anew
    phone   digits after the country code       ip     octets of as many digits, with leading zeros or without
    ssn     within the valid numbers            iban   the account part, check digits computed anew
    date    1900 .. 2099, the same order of year, parts of as many digits; dd/mm and mm/dd are one set of written dates
    secret  letters and digits of a token, key or long hex string; what reads as hex stays hex, nothing else becomes it

Letters of an email or secret keep their case; in secrets of 32 characters or more, a piece that reads as hex stays so. a-z, digits and the accented letters of Latin-1 are permuted whatever
their case, any other letter or digit among those of its category in its 64 code points. A value none of whose characters
has another to become stays as it was; all others change.

A number that fails its check is left alone; an IBAN has the length of its country and check digits 02 to 98, a phone
number any groups up to 15 digits, so letters and numbers that follow don't hide either; secrets, hex strings and local parts
have no longest length (they are permuted in pieces of PIECE characters); a date may have a time after it. Not found: keys and
bearer tokens without a word before them that says so, unless they read as hex, and addresses of version 6. Only the digits 0-9 count as digits. Of
overlapping finds the first in the order email, secret, iban, card, ip, ssn, date, phone stays.

The key is an argument, or the session's setting `spark.strataline.pii.key`. Without either, each application draws a
key of its own that nobody knows: its pseudonyms link documents within the application, and can't be undone after it.

Defined results: a null text stays null with no finds, an empty one empty; texts of any length are scanned whole in
linear time; repeated rows are treated alike; columns besides text are passed on as they are, whatever their names, but
for n_pii and pii_kinds, which the report replaces.
"""

from __future__ import annotations

import re
import secrets
import unicodedata
from bisect import bisect_right
from calendar import monthrange
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataline.llm.common import documents, mapped
from strataline.llm.feistel import Permutation, permute_digits

PIECE = 64
KEY_SETTING = "spark.strataline.pii.key"
_DRAWN: dict[str, bytes] = {}
_ANY = re.compile(r"[0-9@=:]")
_LATIN = "àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ"
_LOWER = "abcdefghijklmnopqrstuvwxyz"
_YEARS = range(1900, 2100)

_SECRET = re.compile(r"(?<![^\W_])(?ai:(?:token|secret|api[_-]?key|access[_-]?key|password|passwd)[\"']?\s{0,3}[:=]\s{0,3}[\"']?)([A-Za-z0-9_\-./+]{8,})")
_HEX = re.compile(r"(?<![A-Za-z0-9])[0-9A-Fa-f]{32,}(?![A-Za-z0-9])")
# Every start: what one swallows may hold another.
_IBAN = re.compile(r"(?<![A-Za-z0-9])(?=([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}))")
_IBAN_LENGTHS = {
    n: countries.split()
    for n, countries in {
        15: "NO", 16: "BE", 18: "DK FI FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
        23: "AE GI IL IQ TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB PL SV",
        29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC",
    }.items()
}
_IBAN_LENGTH = {c: n for n, countries in _IBAN_LENGTHS.items() for c in countries}
_CARD = re.compile(r"(?<![\w.-])(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}|[0-9]{4}([ -])[0-9]{6}\2[0-9]{5})(?!\w)")
_IP = re.compile(r"(?<![\w.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\w)(?!\.[0-9])")
_SSN = re.compile(r"(?<![\w-])([0-9]{3})-([0-9]{2})-([0-9]{4})(?![\w-])")
_DATE = re.compile(r"(?<![\w./-])(?:([0-9]{4})([-/.])([0-9]{1,2})\2([0-9]{1,2})|([0-9]{1,2})([-/.])([0-9]{1,2})\6([0-9]{4}))(?:(?![\w/-])|(?=[Tt][0-9]{2}:))(?!\.[0-9])")
_PHONE = re.compile(r"(?<![\w+])(?:(\+[0-9]{1,3})(?:[ .-]?(?:\([0-9]{1,4}\)|[0-9])){4,14}|\([0-9]{3}\)[ .-]?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4})(?!\w)")
_DECIMAL = re.compile(r"\+[0-9]+\.[0-9]+")
_NATIONAL = {"1": 10, "7": 10, "30": 10, "33": 9, "34": 9, "41": 9, "45": 8, "47": 8, "48": 9, "61": 9, "351": 9, "420": 9}  # digits after the country code, where all numbers have as many

Found = tuple[int, int, str]


def luhn(digits: str) -> int:
    """The sum that is a multiple of ten for a valid number."""
    odd = digits[-1::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10


def _mod97(iban: str) -> int:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def _emails(text: str) -> Iterator[Found]:
    at = text.find("@")
    while at >= 0:
        a, b = at, at + 1
        while a > 0 and (text[a - 1].isalnum() or text[a - 1] in "._%+-"):
            a -= 1
        while b < len(text) and (text[b].isalnum() or text[b] in ".-"):
            b += 1
        end = at + 1 + len(text[at + 1 : b].rstrip(".-"))
        host, _, top = text[at + 1 : end].rpartition(".")
        while a < at and text[a] in ".-+%":
            a += 1
        if a < at and host and len(top) >= 2 and top.isalpha() and any(c.isalnum() for c in text[a:at]):
            yield a, at, "email"
        at = text.find("@", at + 1)


@lru_cache(maxsize=64)
def _written(shape: tuple[bool, int, int, str]) -> tuple[list[tuple[int, int]], list[tuple[int, int]], list[int]]:
    """Of the written dates of a shape: the pairs of parts in a common and in a leap year, and how many dates come before each year.

    A shape is whether the year leads, how many digits the two parts have, and how a part of two digits beside one of one
    is written: 0 with a leading zero, 1 without; where both have two, either way goes.
    """
    year_first, *sizes, style = shape

    def fits(part: int, size: int) -> bool:
        return part < 10 if size == 1 or style == "0" else style != "1" or part >= 10

    def pairs(year: int) -> list[tuple[int, int]]:
        days = {(m, d) for m in range(1, 13) for d in range(1, monthrange(year, m)[1] + 1)}
        days |= set() if year_first else {(d, m) for m, d in days}
        return sorted((x, y) for x, y in days if fits(x, sizes[0]) and fits(y, sizes[1]))

    common, leap = pairs(1999), pairs(2000)
    before = [0]
    for y in _YEARS:
        before.append(before[-1] + len(leap if monthrange(y, 2)[1] == 29 else common))
    return common, leap, before


def _date_parts(m: re.Match) -> tuple[tuple, int, tuple[int, int]]:
    """Shape, year and the two other parts, in the order they stand."""
    year, x, y = (m[1], m[3], m[4]) if m[1] else (m[8], m[5], m[7])
    two = {len(p): p for p in (x, y)}
    style = "" if len(two) == 1 else "0" if two[2][0] == "0" else "1"
    return (bool(m[1]), len(x), len(y), style), int(year), (int(x), int(y))


def _date_rank(m: re.Match) -> int | None:
    """Its place among the written dates of its shape; None if it is no date."""
    shape, year, pair = _date_parts(m)
    if year not in _YEARS:
        return None
    common, leap, before = _written(shape)
    days = leap if monthrange(year, 2)[1] == 29 else common
    at = bisect_right(days, pair) - 1
    return before[year - _YEARS[0]] + at if at >= 0 and days[at] == pair else None


def _date_text(shape: tuple, separator: str, rank: int) -> str:
    common, leap, before = _written(shape)
    k = bisect_right(before, rank) - 1
    x, y = (leap if monthrange(_YEARS[k], 2)[1] == 29 else common)[rank - before[k]]
    parts = [f"{x:0{shape[1]}d}", f"{y:0{shape[2]}d}"]
    return separator.join([f"{_YEARS[k]}", *parts] if shape[0] else [*parts, f"{_YEARS[k]}"])


def _ssn_ok(m: re.Match) -> bool:
    return 0 < int(m[1]) < 900 and m[1] != "666" and m[2] != "00" and m[3] != "0000"


def _ends(text: str, start: int, end: int) -> Iterator[int]:
    """Where text[start:end] may end, longest first: before a character that is no letter or digit."""
    for e in range(end, start, -1):
        if text[e - 1] not in " .-" and (e == len(text) or not (text[e].isalnum() or text[e] == "_")):
            yield e


def _ibans(text: str) -> Iterator[Found]:
    """Of the length of the country; for a country without one here, the longest that passes."""
    for m in _IBAN.finditer(text):
        length = _IBAN_LENGTH.get(m[1][:2])
        for e in _ends(text, *m.span(1)):
            raw = text[m.start() : e].replace(" ", "")
            if (len(raw) == length if length else 15 <= len(raw) <= 34) and 2 <= int(raw[2:4]) <= 98 and _mod97(raw) == 1:
                yield m.start(), e, "iban"
                break


def _phones(text: str) -> Iterator[Found]:
    """7 to 15 digits: as many as the country's numbers have if a group ends there, else as many groups as fit."""
    at = 0
    while m := _PHONE.search(text, at):
        at = m.end()
        if m[1]:
            ends = {}
            for e in _ends(text, *m.span()):
                value = text[m.start() : e]
                n = sum(c.isdigit() for c in value)
                if 7 <= n <= 15 and value.count("(") == value.count(")") and not _DECIMAL.fullmatch(value):
                    ends.setdefault(n - len(m[1]) + 1 - value.count("(0)"), e)
            if not ends:
                at = m.end(1)
                continue
            at = ends.get(_NATIONAL.get(m[1][1:]), max(ends.values()))
        yield m.start(), at, "phone"


def find(text: str) -> list[Found]:
    """(start, end, kind), in order, without overlaps."""
    if not _ANY.search(text):
        return []
    got: list[Found] = list(_emails(text))
    got += [(m.start(1), m.end(1), "secret") for m in _SECRET.finditer(text) if any(c.isdigit() for c in m[1])]
    got += [(m.start(), m.end(), "secret") for m in _HEX.finditer(text) if not m[0].isdigit() and any(c.isdigit() for c in m[0])]
    got += _ibans(text)
    got += [(m.start(), m.end(), "card") for m in _CARD.finditer(text) if luhn("".join(c for c in m[0] if c.isdigit())) == 0]
    got += [(m.start(), m.end(), "ip") for m in _IP.finditer(text) if all(int(x) < 256 for x in m[0].split("."))]
    got += [(m.start(), m.end(), "ssn") for m in _SSN.finditer(text) if _ssn_ok(m)]
    got += [(m.start(), m.end(), "date") for m in _DATE.finditer(text) if _date_rank(m) is not None]
    got += _phones(text)
    kept: list[Found] = []
    taken = bytearray(len(text)) if len(got) > 1 else None
    for a, b, kind in got:
        if taken is not None:
            if any(taken[a:b]):
                continue
            taken[a:b] = b"\1" * (b - a)
        kept.append((a, b, kind))
    return sorted(kept)


def hex_like(value: str) -> bool:
    return _HEX.fullmatch(value) is not None and (value.islower() or value.isupper())


@lru_cache(maxsize=4096)
def _alphabet(c: str) -> str:
    """What a letter or digit may become; it is in it itself, in lower case if case does not matter."""
    low = c.lower()
    for own in ("0123456789", _LOWER, _LATIN):
        if low in own and c in (low, low.upper()):
            return own
    if not c.isalnum():
        return c
    first, kind = ord(c) & ~63, unicodedata.category(c)
    return "".join(x for x in map(chr, range(first, first + 64)) if unicodedata.category(x) == kind and x.isalnum() and not (x.lower() in _LOWER + _LATIN and x in (x.lower(), x.lower().upper())))


def _hex_class(block: str) -> str:
    """How a piece of a hex string reads: d digits only; l, u with letters of one case; n none."""
    if not set(block) <= set("0123456789abcdefABCDEF"):
        return "n"
    return "d" if block.isdigit() else "l" if block.islower() else "u" if block.isupper() else "n"


def _block(key: bytes, tweak: bytes, value: str, back: bool, may_be_hex: bool) -> str:
    """Letters and digits of up to PIECE characters permuted within their alphabets; case and all else stay, and the hex class."""
    of = _hex_class(value) if may_be_hex else ""
    both = of in ("l", "u") and any(c.isdigit() for c in value)
    alphabets = ["0123456789abcdef" if both else "abcdef" if of in ("l", "u") else _alphabet(c) for c in value]
    where = [i for i, a in enumerate(alphabets) if len(a) > 1]
    blind = [value[i] not in alphabets[i] or of in ("l", "u") for i in where]  # its lower case stands in the alphabet
    upper = [of == "u" if of in ("l", "u") else b for b in blind]

    def text(digits: list[int]) -> str:
        out = list(value)
        for i, d, up in zip(where, digits, upper):
            out[i] = alphabets[i][d].upper() if up else alphabets[i][d]
        return "".join(out)

    def same_kind(digits: list[int]) -> bool:
        new = text(digits)
        return _hex_class(new) == of and (not both or any(c.isdigit() for c in new))

    own = [alphabets[i].index(value[i].lower() if b else value[i]) for i, b in zip(where, blind)]
    return text(permute_digits(key, tweak, [len(alphabets[i]) for i in where], own, back, same_kind if of else None))


def _characters(key: bytes, kind: str, value: str, back: bool) -> str:
    """Pieces of PIECE characters, each under a tweak of its place and of what comes before it: no character stays by its place."""
    out, plain = [], b""
    for at in range(0, len(value), PIECE):
        piece = value[at : at + PIECE]
        tweak = kind.encode() + (b"" if not at else b"+%d" % at + plain)
        new = _block(key, tweak, piece, back, kind == "secret" and len(value) >= 32)
        out.append(new)
        plain = blake2b(plain + (new if back else piece).encode(), digest_size=16).digest()
    return "".join(out)


def _octets(value: str) -> list[range]:
    """The values each octet may take with the digits it has, leading zeros or none."""
    return [range(10 ** (len(o) - 1)) if o[0] == "0" and len(o) > 1 else range((0, 10, 100)[len(o) - 1], (10, 100, 256)[len(o) - 1]) for o in value.split(".")]


def _refill(value: str, digits: list[int]) -> str:
    it = iter(digits)
    return "".join(str(next(it)) if c.isdigit() else c for c in value)


def replace(value: str, kind: str, key: bytes, back: bool = False) -> str:
    """The pseudonym of a found value; with back, the value of a pseudonym."""
    digits = [int(c) for c in value if c in "0123456789"]
    if kind in ("email", "secret"):
        return _characters(key, kind, value, back)
    if kind == "card":
        head = permute_digits(key, b"card", [10] * (len(digits) - 1), digits[:-1], back)
        return _refill(value, [*head, (10 - luhn("".join(map(str, head)) + "0")) % 10])
    if kind == "ip":
        ranges, shown = _octets(value), [len(o) for o in value.split(".")]
        new = permute_digits(key, b"ip" + repr(ranges).encode(), [len(r) for r in ranges], [int(o) - r[0] for o, r in zip(value.split("."), ranges)], back)
        return ".".join(f"{r[d]:0{n}d}" for r, d, n in zip(ranges, new, shown))
    if kind == "ssn":
        area, group, serial = (int(x) for x in value.split("-"))
        area, group, serial = permute_digits(key, b"ssn", [898, 99, 9999], [area - 1 - (area > 666), group - 1, serial - 1], back)
        area += 1
        return f"{area + (area >= 666):03d}-{group + 1:02d}-{serial + 1:04d}"
    if kind == "iban":
        raw = value.replace(" ", "")
        radices = [10 if c.isdigit() else 26 for c in raw[4:]]
        own = permute_digits(key, b"iban" + raw[:2].encode(), radices, [int(c) if c.isdigit() else ord(c) - 65 for c in raw[4:]], back)
        body = "".join(str(d) if r == 10 else chr(65 + d) for r, d in zip(radices, own))
        it = iter(f"{raw[:2]}{98 - _mod97(f'{raw[:2]}00{body}'):02d}{body}")
        return "".join(c if c == " " else next(it) for c in value)
    if kind == "date":
        m = _DATE.fullmatch(value)
        shape, *_ = _date_parts(m)
        p = Permutation(key, b"date" + repr(shape).encode(), _written(shape)[2][-1])
        return _date_text(shape, m[2] or m[6], (p.back if back else p.forward)(_date_rank(m)))
    code = len(_PHONE.fullmatch(value)[1] or "+") - 1
    return _refill(value, digits[:code] + permute_digits(key, b"phone", [10] * (len(digits) - code), digits[code:], back))


def key_of(spark: SparkSession) -> bytes:
    """The session's key, or one drawn for this application."""
    named = spark.conf.get(KEY_SETTING, None)
    return named.encode() if named else _DRAWN.setdefault(spark.sparkContext.applicationId, secrets.token_bytes(32))


def pseudonymise_text(text: str | None, key: bytes, memo: dict | None = None) -> tuple[str | None, list[Found]]:
    """The text with pseudonyms, and what was found in the original."""
    found = find(text) if text else []
    if not found:
        return text, []
    out, at = [], 0
    for a, b, kind in found:
        value = text[a:b]
        new = memo.get((kind, value)) if memo is not None else None
        if new is None:
            new = replace(value, kind, key)
            if memo is not None and len(memo) < 100_000:
                memo[kind, value] = new
        out += [text[at:a], new]
        at = b
    return "".join([*out, text[at:]]), found


def pseudonymise(docs: DataFrame, key: bytes | None = None, report: bool = False) -> DataFrame:
    """docs with the column text pseudonymised; with report, also n_pii and pii_kinds (sorted, comma-joined)."""
    key = key or key_of(docs.sparkSession)
    frame = docs.withColumn("text", F.col("text").cast("string"))
    if report:
        frame = frame.drop("n_pii", "pii_kinds")
    at = next(k for k, c in enumerate(frame.columns) if c.lower() == "text")
    extra = [F.lit(0).alias("n_pii"), F.lit("").alias("pii_kinds")] if report else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict = {}
        for b in batches:
            done = [pseudonymise_text(t, key, memo) for t in b.column(at).to_pylist()]
            columns = list(b.columns)
            columns[at] = pa.array([t for t, _ in done], pa.string())
            if report:
                columns += [pa.array([len(f) for _, f in done], pa.int32()), pa.array([",".join(sorted({k for *_, k in f})) for _, f in done], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [*b.schema.names, "n_pii", "pii_kinds"][: len(columns)])

    return mapped(frame, run, frame.select("*", *extra).schema)


def op8_pii_feistel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(documents(spark, sf_dir).select("doc_id", "text"), report=True)

