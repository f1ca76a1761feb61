"""PII: format-preserving Feistel pseudonyms.

Personal data and secrets are found by pattern and check (Luhn digit, IBAN remainder, calendar date, octet range) and
replaced by a keyed permutation of the values of the same format: digits stay digits and letters letters, in their
places; a valid card number, IBAN or date becomes another valid one. The permutation depends on the key and the
format alone, so equal values have equal pseudonyms in all documents, and without the key they cannot be undone.

Defined results: null text stays null; empty text stays empty; text without findings is returned as it is; repeated
rows get equal results; an empty table gives no rows; other columns are kept as they are unless ``keep`` says less.
The permutation is one to one within a format, so two values never share a pseudonym: values that pass a check (national numbers, cards,
dates by how they can be read) are permuted among themselves, and those that fail among theirs. Like any permutation drawn at random
it leaves about one value of each format as it is. One date written with and without zeros is one value. Letters and digits outside ASCII
have no place in a format and are mapped to ASCII ones. A very long text is one row in memory and is searched whole; very long values are
permuted in pieces. Where two kinds fit, the first of ``_PATTERNS`` counts. Dates with years of two digits are not looked for.
"""

from __future__ import annotations

import bisect
import datetime
import re
import secrets
from collections.abc import Iterator
from hashlib import blake2b

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import table

ROUNDS = 8
LONGEST = 64  #: characters permuted together; longer values are permuted in pieces chained by their tweaks
KEY = "pitchframe.pii.secret"  #: the session's setting, by a name that Spark keeps out of its logs and pages

_PATTERNS = {
    "assigned": r"(?i:(?<![\w])(?:api[_-]?key|access[_-]?key|auth|bearer|credential|passwd|password|private[_-]?key|pwd|secret|token))"
    r"[\"']?[ \t|]*[=:][ \t|]*[\"']?(?P<value>[A-Za-z0-9+/_\-.~=]{6,})",
    "email": r"(?<![\w.+%-])[\w.+%-]+@[\w-]+(?:\.[\w-]+)+",
    "hexadecimal": r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,}|[0-9A-F]{32,})(?![0-9A-Za-z])",
    "secret": r"(?<![\w])(?:(?:AKIA|ASIA)[A-Z0-9]{16}|(?:sk|pk|rk|ghp|gho|glpat|xox[abprs])[-_][A-Za-z0-9_\-]{16,}|AIza[\w\-]{35})(?![\w])",
    "pem": r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY-----(?P<body>[A-Za-z0-9+/=\s]{16,}?)-----END",
    "signed": r"(?<![\w.-])eyJ[\w-]{8,}\.[\w-]{8,}\.[\w-]{8,}(?![\w-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "address6": r"(?<![\w:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![\w:])",
    "short6": r"(?<![\w:])(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6}(?![\w:])",
    "mac": r"(?<![\w:-])(?:[0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}(?![\w:-])",
    "address4": r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\.?\d)",
    "date": r"(?<![\d/.-])(?:\d{4}(?P<by1>[-/.])\d{1,2}(?P=by1)\d{1,2}|\d{1,2}(?P<by2>[-/.])\d{1,2}(?P=by2)\d{4})(?![\d/-]|\.\d)",
    "national": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "card": r"(?<![\d])(?:\d{13,19}|\d{4}(?P<by3>[ -])\d{4}(?P=by3)\d{4}(?P=by3)\d{1,7}|\d{4}(?P<by4>[ -])\d{6}(?P=by4)\d{5})(?!\d)",
    "phone": r"(?<![\w+])(?:\+\d{1,3}[ .-]?)?\(?\d{3}\)?[ .-]\d{3}[ .-]\d{4}(?!\d)|(?<![\w+])\+\d{1,3}(?:[ .-]?\(?\d{1,4}\)?){2,5}(?!\d)",
    "number": r"(?<![\w.,])\d{9,}(?![\w])",
}
_FINDER = None
#: In every text with a value of any kind: most kinds need one of the first characters, the others are spelled out.
_HINT = re.compile(
    r"[\d@=:]|eyJ|-----BEGIN |AKIA|ASIA|AIza|(?:sk|pk|rk|ghp|gho|glpat|xox[abprs])[-_]|[a-f]{32}|[A-F]{32}|[A-Fa-f]{2}-[A-Fa-f]{2}-"
)
#: Characters of an IBAN by country.
_IBAN_LENGTHS = {
    country: int(length)
    for length, countries in re.findall(
        r"(\d+)((?: [A-Z]{2})+)",
        "15 NO 16 BE 18 DK FI FO GL NL 19 MK SI 20 AT BA EE KZ LT LU XK 21 CH HR LI LV 22 BG BH CR DE GB GE IE ME RS VA "
        "23 AE GI IL IQ TL 24 AD CZ ES MD PK RO SA SE SK TN VG 25 LY PT ST 26 IS TR 27 FR GR IT MC MR SM "
        "28 AL AZ BY CY DO GT HU LB PL SV 29 BR EG PS QA UA 30 JO KW MU 31 MT SC 32 LC",
    )
    for country in countries.split()
}
_EPOCH, _DAYS = datetime.date(1900, 1, 1).toordinal(), 73_049  #: dates permuted: 1900-01-01 to 2099-12-31


def _finder() -> re.Pattern:
    global _FINDER
    _FINDER = _FINDER or re.compile("|".join(f"(?P<{kind}>{pattern})" for kind, pattern in _PATTERNS.items()))
    return _FINDER


class Pseudonyms:
    """Keyed permutations of values within their formats."""

    def __init__(self, key: str):
        self.key = blake2b(key.encode(), digest_size=32).digest()

    def permuted(self, value: int, size: int, tweak: str) -> int:
        """A permutation of 0 .. size-1: a Feistel network over pairs of half-blocks, walked until in range."""
        if size < 2:
            return value
        half = max(1, ((size - 1).bit_length() + 1) // 2)
        mask, width = (1 << half) - 1, (half + 7) // 8
        while True:
            left, right = value >> half, value & mask
            for n in range(ROUNDS):
                got = blake2b(
                    f"{n}|{size}|{tweak}|{right}".encode(), key=self.key, digest_size=min(64, width + 8)
                ).digest()
                left, right = right, left ^ (int.from_bytes(got, "big") & mask)
            value = left << half | right
            if value < size:
                return value

    @staticmethod
    def chained(tweak: str, piece: str) -> str:
        """The tweak of the piece after ``piece``, as long for the last piece as for the second."""
        return blake2b(f"{tweak}>{piece}".encode(), digest_size=32).hexdigest()

    def characters(self, text: str, tweak: str, hexadecimal: bool = False) -> str:
        """Letters and digits permuted together within their kinds; everything else stays."""
        if len(text) > LONGEST:
            out = []
            for at in range(0, len(text), LONGEST):
                out.append(self.characters(text[at : at + LONGEST], tweak, hexadecimal))
                tweak = self.chained(tweak, out[-1])
            return "".join(out)
        kinds = []
        for c in text:
            if hexadecimal and c in "0123456789abcdefABCDEF":
                kinds.append("0123456789ABCDEF" if text.upper() == text else "0123456789abcdef")
            elif "0" <= c <= "9":
                kinds.append("0123456789")
            elif "a" <= c <= "z":
                kinds.append("abcdefghijklmnopqrstuvwxyz")
            elif "A" <= c <= "Z":
                kinds.append("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
            elif c.isalpha():  # letters outside ASCII become ASCII ones
                kinds.append("abcdefghijklmnopqrstuvwxyz")
            else:
                kinds.append("")
        value, size = 0, 1
        for c, kind in zip(text, kinds, strict=True):
            if kind:
                at = kind.find(c if not hexadecimal or c in kind else c.swapcase())
                value, size = value * len(kind) + (at if at >= 0 else ord(c) % len(kind)), size * len(kind)
        shape = "".join(str(len(k)) if k else c for c, k in zip(text, kinds, strict=True))
        value = self.permuted(value, size, f"{tweak}|{shape}")
        out = []
        for c, kind in zip(reversed(text), reversed(kinds), strict=True):
            if kind:
                value, at = divmod(value, len(kind))
                out.append(kind[at])
            else:
                out.append(c)
        return "".join(reversed(out))

    def digits(self, text: str, tweak: str, start: int = 0) -> str:
        """The digits from the ``start``-th on permuted as one number, long ones in pieces; everything else stays."""
        found = [c for c in text if c.isdigit()]
        rest, out = "".join(found[start:]), found[:start]
        tweak = f"{tweak}|{len(found)}|{''.join(out)}"
        for at in range(0, len(rest), LONGEST):
            part = rest[at : at + LONGEST]
            piece = str(self.permuted(int(part), 10 ** len(part), tweak)).zfill(len(part))
            out.extend(piece)
            tweak = self.chained(tweak, piece)
        new = iter(out)
        return "".join(next(new) if c.isdigit() else c for c in text)


def luhn(digits: str) -> int:
    """The digit that makes ``digits`` followed by it a valid card number."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return -total % 10


def iban_check(country: str, account: str) -> str:
    number = "".join(str(int(c, 36)) for c in f"{account}{country}00")
    return f"{98 - int(number) % 97:02d}"


def _card(p: Pseudonyms, text: str) -> str:
    digits = "".join(c for c in text if c.isdigit())
    if luhn(digits[:-1]) != int(digits[-1]):
        new = p.digits(digits, "account")
        while luhn(new[:-1]) == int(new[-1]):  # on to the next that is no card either
            new = p.digits(new, "account")
        new = iter(new)
        return "".join(next(new) if c.isdigit() else c for c in text)
    new = p.digits(digits[:-1], "card", 1)
    new = iter(new + str(luhn(new)))
    return "".join(next(new) if c.isdigit() else c for c in text)


def valid_iban(text: str) -> str | None:
    """The valid IBAN that ``text`` is or begins with, up to a space: of the country's length if there is one, or the longest."""
    ends = [m.start() for m in re.finditer(" |$", text)]
    found = [packed for end in ends if 15 <= len(packed := text[:end].replace(" ", "")) <= 34 and iban_check(packed[:2], packed[4:]) == packed[2:4]]
    if not found:
        return None
    best = max(found, key=lambda packed: (len(packed) == _IBAN_LENGTHS.get(packed[:2]), len(packed)))
    return next(text[:end] for end in ends if text[:end].replace(" ", "") == best)


def _iban(p: Pseudonyms, text: str) -> str | None:
    packed = text.replace(" ", "")
    if not 15 <= len(packed) <= 34 or iban_check(packed[:2], packed[4:]) != packed[2:4]:
        return None
    account = p.characters(packed[4:], f"iban{packed[:2]}")
    new = iter(packed[:2] + iban_check(packed[:2], account) + account)
    return "".join(c if c == " " else next(new) for c in text)


def _month_first(day: datetime.date) -> int:
    """Of the dates from the epoch that are behind the twelfth of their month, how many come before ``day``, which is one."""
    return day.toordinal() - _EPOCH - 12 * (12 * (day.year - 1900) + day.month)


def _month_first_date(number: int) -> datetime.date:
    at = bisect.bisect_right(range(12 * 200), number, key=lambda m: _month_first(datetime.date(1900 + m // 12, m % 12 + 1, 13))) - 1
    first = datetime.date(1900 + at // 12, at % 12 + 1, 13)
    return first + datetime.timedelta(days=number - _month_first(first))


def _date(p: Pseudonyms, text: str) -> str | None:
    """Dates with the year or the day in front are permuted together, so that one date has one pseudonym however it is written. Dates that only
    make sense with the month in front, as the day is behind the twelfth, are permuted among themselves."""
    parts, by = re.split(r"[-/.]", text), re.search(r"[-/.]", text)[0]
    year_first = len(parts[0]) == 4
    year, a, b = int(parts[0 if year_first else 2]), int(parts[1 if year_first else 0]), int(parts[2 if year_first else 1])
    padded = all(len(x) > 1 for x in parts)
    show = (lambda x: f"{x:02d}") if padded else str
    if not 1900 <= year <= 2099:
        return None
    for month, day, ours in [(a, b, True)] if year_first else [(b, a, True), (a, b, False)]:
        try:
            date = datetime.date(year, month, day)
        except ValueError:
            continue
        if ours:
            new = datetime.date.fromordinal(_EPOCH + p.permuted(date.toordinal() - _EPOCH, _DAYS, "date"))
            return by.join([f"{new.year}", show(new.month), show(new.day)] if year_first else [show(new.day), show(new.month), f"{new.year}"])
        new = _month_first_date(p.permuted(_month_first(date), _DAYS - 12 * 12 * 200, "month first"))
        return by.join([show(new.month), show(new.day), f"{new.year}"])
    return None


def _address4(p: Pseudonyms, text: str) -> str | None:
    octets = [int(x) for x in text.split(".")]
    if max(octets) > 255:
        return None
    value = p.permuted(int.from_bytes(bytes(octets), "big"), 1 << 32, "address4")
    return ".".join(str(x) for x in value.to_bytes(4, "big"))


def _email(p: Pseudonyms, text: str) -> str:
    local, _, domain = text.rpartition("@")
    host, _, top = domain.rpartition(".")
    return f"{p.characters(local, 'local@' + domain)}@{p.characters(host, 'host')}.{top}"


def _national(p: Pseudonyms, text: str) -> str:
    valid = re.compile(r"(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}")
    new = p.digits(text, "national")
    while bool(valid.fullmatch(text)) != bool(valid.fullmatch(new)):
        new = p.digits(new, "national")
    return new


def _short6(p: Pseudonyms, text: str) -> str | None:
    """Short forms of an address: at most seven groups, one of them long and with a digit, unlike names joined by colons."""
    groups = [g for g in text.split(":") if g]
    if len(groups) > 7 or text.count("::") != 1 or not any(len(g) > 2 and re.search(r"\d", g) for g in groups):
        return None
    return p.characters(text, "hexadecimal", True)


def _phone(p: Pseudonyms, text: str) -> str | None:
    digits = [c for c in text if c.isdigit()]
    if not 7 <= len(digits) <= 15:
        return None
    code = re.match(r"\+(\d{1,3})[ .(-]", text)
    return p.digits(text, "phone", len(code[1]) if code else 0)


def pseudonym(p: Pseudonyms, kind: str, text: str) -> str | None:
    """The pseudonym of a value; None if the value fails its kind's check."""
    if kind == "card":
        return _card(p, text)
    if kind == "iban":
        return _iban(p, text)
    if kind == "date":
        return _date(p, text)
    if kind == "address4":
        return _address4(p, text)
    if kind == "email":
        return _email(p, text)
    if kind == "national":
        return _national(p, text)
    if kind == "phone":
        return _phone(p, text)
    if kind == "short6":
        return _short6(p, text)
    if kind == "number":
        return p.digits(text, "number")
    hexadecimal = kind in ("hexadecimal", "mac", "address6") or bool(re.fullmatch(r"[0-9a-f]{16,}|[0-9A-F]{16,}", text))
    return p.characters(text, "hexadecimal" if hexadecimal else "secret", hexadecimal)


def pseudonymised(p: Pseudonyms, text: str, known: dict[tuple[str, str], str | None]) -> tuple[str, list[dict]]:
    """(the text with pseudonyms, spans of the values found in the text as it was). ``known``: a bounded cache."""
    if not _HINT.search(text):
        return text, []
    out, spans, at, done = [], [], 0, 0
    find = _finder().search
    while m := find(text, at):
        kind = next(k for k in _PATTERNS if m[k] is not None)
        start, end = m.span({"assigned": "value", "pem": "body"}.get(kind, kind))
        if kind == "iban":  # the pattern may take in a word that follows
            end = start + len(valid_iban(text[start:end]) or text[start:end])
        value = text[start:end]
        if (kind, value) not in known:
            if len(known) > 50_000:
                known.clear()
            known[kind, value] = pseudonym(p, kind, value)
        new = known[kind, value]
        if new is None:  # not a valid value: go on behind its first run of letters or digits
            at = start + max(1, re.match(r"\w*", value).end())
            continue
        out += [text[done:start], new]
        spans.append({"kind": kind, "start": start, "length": end - start})
        at = done = end
    return "".join([*out, text[done:]]) if spans else text, spans


SPANS = "array<struct<kind: string, start: int, length: int>>"


def pseudonymise(docs: DataFrame, key: str, column: str = "text", spans: str | None = None) -> DataFrame:
    """``docs`` with pseudonyms in ``column``; ``spans`` names a column for what was found, if wanted."""
    if spans in docs.columns:
        raise ValueError(f"the column {spans} is there already; give the spans another name")

    def replace(batches: Iterator) -> Iterator:
        import pyarrow as pa

        p, known = Pseudonyms(key), {}
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("length", pa.int32())]))
        for batch in batches:
            got = [(None, []) if t is None else pseudonymised(p, t, known) for t in batch.column(column).to_pylist()]
            new = pa.array([t for t, _ in got], pa.string())
            arrays = [new if n == column else batch.column(n) for n in batch.schema.names]
            found = [pa.array([s for _, s in got], kind)] if spans else []
            yield pa.RecordBatch.from_arrays([*arrays, *found], [*batch.schema.names, *([spans] if spans else [])])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(replace, schema + (f", `{spans}` {SPANS}" if spans else ""))


def session_key(spark: SparkSession) -> str:
    """The key that the session names; where it names none, a secret one drawn for this session alone, so that no
    pseudonym can be undone. Name one to have the same pseudonyms in every run."""
    key = spark.conf.get(KEY, None)
    if not key:
        key = secrets.token_hex(32)
        spark.conf.set(KEY, key)
    return key


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pseudonymise(docs, session_key(spark), spans="spans")
    return found.select("doc_id", "text", F.size("spans").alias("n_found"))
