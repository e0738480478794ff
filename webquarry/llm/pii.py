"""Personal data: format-preserving Feistel pseudonyms.

Validated numbers (payment cards by Luhn, bank accounts by their check digits, phone
numbers, national ids, IP addresses of both versions), calendar dates, e-mail addresses and
secrets are found and replaced by a keyed permutation of their own format: digits stay
digits, letters letters of their case, separators stay, cards and accounts stay valid, dates
stay dates. Equal values get equal pseudonyms in all documents and, as the map is a
permutation, different ones different; whoever holds the key can reverse it. Dates and IPv6
addresses are permuted as values: 12/03/1990 and March 12, 1990 stay the same day. The key
is no part of this module, see ``key_of``.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import hmac
import ipaddress
import os
import re
import secrets
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

#: Where the key of the pseudonyms stands: a setting of the session, or of the driver's environment.
KEY_SETTING, KEY_VARIABLE = "spark.webquarry.pii.key", "WEBQUARRY_PII_KEY"
ROUNDS = 8
#: Characters that are permuted as one number.
PIECE = 256
MONTHS = "January February March April May June July August September October November December".split()

#: What names a secret, up to its value: the quotes around the name and before the value are part of it.
_NAMED = r"(?i:(?:password|passwd|secret|api_key|apikey|token)[\"']?\s?[=:]\s?)"

_MONTH = "(?:" + "|".join(f"{m}|{m.upper()}|{m[:3]}|{m[:3].upper()}" for m in MONTHS) + r")\.?"

#: Kinds in the order of their precedence where they begin at the same place.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)+",
    "secret": r"(?:AKIA|ASIA)[A-Z0-9]{16}\b|\bgh[pousr]_[A-Za-z0-9]{20,}|\bsk[-_][A-Za-z0-9_-]{16,}|" + _NAMED + r"(?:\"[^\s\"]{6,}(?=\")|'[^\s']{6,}(?=')|[\"']?[^\s\"'<>,;]{6,})",
    "iban": r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b",
    "ipv6": r"(?<![\w:.])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![\w:])",
    "ip": r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9])(?!\.[0-9])",
    "date": r"(?<![0-9/.-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})(?![0-9])",
    "day": rf"(?<![0-9A-Za-z])(?:[0-9]{{1,2}}(?:st|nd|rd|th)? {_MONTH},? [0-9]{{4}}|{_MONTH} [0-9]{{1,2}}(?:st|nd|rd|th)?,? [0-9]{{4}})(?![0-9A-Za-z])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone": r"(?<![0-9A-Za-z+])(?:\+[0-9]{1,3}[ .-]?)?\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])|(?<![0-9A-Za-z+])\+[0-9]{1,3}(?:[ .-]?\(?[0-9]{2,4}\)?){2,5}(?![0-9])",
    "card": r"(?<![0-9.-])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])",
}
KINDS = tuple(PATTERNS)
#: Kinds written in groups: a match of them may have taken in groups of what follows.
GROUPED = ("iban", "phone", "card")
_EACH = {k: re.compile(p) for k, p in PATTERNS.items()}
_FIND = re.compile("|".join(f"(?P<{k}>{p})" for k, p in PATTERNS.items()))
_GATE = re.compile(r"[0-9@]|(?i:password|passwd|secret|api_key|apikey|token)|\bsk[-_]|\bgh[pousr]_|AKIA|ASIA")
_DAY0, _DAYS = dt.date(1900, 1, 1).toordinal(), dt.date(2100, 1, 1).toordinal() - dt.date(1900, 1, 1).toordinal()
_DATES = {"-": "%Y-%m-%d", "/": "%m/%d/%Y", ".": "%d.%m.%Y"}


_session_key: list[bytes] = []


def key_of(spark: SparkSession) -> bytes:
    """The key that the session or the environment names; where neither does, a random one that lasts as long as the driver's Python.

    With a random key equal values are linked within the session only, and nobody can reverse them later.
    """
    named = spark.conf.get(KEY_SETTING, None) or os.environ.get(KEY_VARIABLE)
    if named:
        return named.encode()
    if not _session_key:
        _session_key.append(secrets.token_bytes(32))
    return _session_key[0]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def luhn_digit(body: str) -> str:
    """The digit that makes ``body`` and it valid."""
    return next(c for c in "0123456789" if luhn(body + c))


def _mod97(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text)) % 97


def permute(n: int, x: int, key: bytes, tweak: str, back: bool = False) -> int:
    """Keyed permutation of 0..n-1: a balanced Feistel network over the next even number of bits, walked until it is below n."""
    half = max(1, (max(1, n - 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1
    width = half // 8 + 1

    def turn(r: int, v: int) -> int:
        h = hmac.new(key, f"{tweak}|{n}|{r}|".encode() + v.to_bytes(width, "big"), hashlib.sha256).digest()
        while len(h) < width:
            h += hashlib.sha256(h).digest()
        return int.from_bytes(h[:width], "big") & mask

    while True:
        left, right = x >> half, x & mask
        for r in reversed(range(ROUNDS)) if back else range(ROUNDS):
            left, right = (right ^ turn(r, left), left) if back else (right, left ^ turn(r, right))
        x = left << half | right
        if x < n:
            return x


_CLASSES = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_CLASS = {c: k for k in _CLASSES for c in k}


def permute_format(text: str, key: bytes, tweak: str, back: bool = False) -> str:
    """Digits to digits, letters to letters of their case; the rest stays. The format is part of the tweak.

    Texts longer than ``PIECE`` are permuted piece by piece, each with the pieces before it as
    part of its tweak.
    """
    if len(text) <= PIECE:
        return _permute_piece(text, key, tweak, back)
    out, known = [], hashlib.sha256()
    for at in range(0, len(text), PIECE):
        piece = text[at : at + PIECE]
        new = _permute_piece(piece, key, f"{tweak}|{known.hexdigest()}", back)
        known.update((new if back else piece).encode())
        out.append(new)
    return "".join(out)


def _permute_piece(text: str, key: bytes, tweak: str, back: bool) -> str:
    classes = [_CLASS.get(c) for c in text]
    n = x = 0
    size = 1
    for c, k in zip(text, classes):
        if k:
            x, size, n = x * len(k) + k.index(c), size * len(k), n + 1
    if not n:
        return text
    shape = "".join("." if k is None else k[0] for k in classes)
    x = permute(size, x, key, f"{tweak}|{shape}", back)
    out = []
    for c, k in zip(reversed(text), reversed(classes)):
        if k:
            x, i = divmod(x, len(k))
            c = k[i]
        out.append(c)
    return "".join(reversed(out))


def _ordinal(day: int) -> str:
    return "th" if 10 < day < 14 else {1: "st", 2: "nd", 3: "rd"}.get(day % 10, "th")


_NAMED_DAY = re.compile(r"(?P<d>[0-9]{1,2})(?P<th>[a-z]{2})?(?![0-9])|(?P<m>[A-Z][A-Za-z]{2,})|(?P<y>[0-9]{4})")


def _named_day(value: str) -> tuple[dt.date | None, dict[str, re.Match]]:
    """The date that a day with the name of its month says, and where its parts stand."""
    parts = {k: m for m in _NAMED_DAY.finditer(value) for k in ("d", "m", "y") if m[k]}
    month = [x[:3].upper() for x in MONTHS].index(parts["m"][0][:3].upper()) + 1
    try:
        day = dt.date(int(parts["y"][0]), month, int(parts["d"]["d"]))
    except ValueError:
        return None, parts
    return day if parts["d"]["th"] in (None, _ordinal(day.day)) else None, parts


def _rename_day(value: str, day: dt.date) -> str:
    """``value`` with its parts replaced by those of ``day``, written as they were."""
    _, parts = _named_day(value)
    old_day, old_month = parts["d"], parts["m"][0]
    month = MONTHS[day.month - 1] if len(old_month) > 3 or old_month.upper() == "MAY" else MONTHS[day.month - 1][:3]
    number = f"{day.day:02d}" if old_day["d"][0] == "0" else str(day.day)
    new = {
        "d": number + (_ordinal(day.day) if old_day["th"] else ""), "m": month.upper() if old_month.isupper() else month, "y": f"{day.year:04d}",
    }
    out, at = [], 0
    for k, m in sorted(parts.items(), key=lambda p: p[1].start()):
        out += [value[at : m.start()], new[k]]
        at = m.end()
    return "".join([*out, value[at:]])


def _refill(pattern: str, digits: str) -> str:
    it = iter(digits)
    return "".join(next(it) if c.isalnum() else c for c in pattern)


def valid(kind: str, value: str) -> bool:
    digits = "".join(c for c in value if "0" <= c <= "9")
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits) and len(set(digits)) > 1
    if kind == "iban":
        bare = value.replace(" ", "")
        return 15 <= len(bare) <= 34 and _mod97(bare[4:] + bare[:4]) == 1
    if kind == "ip":
        return all(int(p) < 256 and str(int(p)) == p for p in value.split("."))
    if kind == "ipv6":
        try:
            ipaddress.IPv6Address(value)
        except ValueError:
            return False
        return sum(map(bool, value.split(":"))) > 2 and bool(digits)
    if kind == "day":
        day = _named_day(value)[0]
        return day is not None and 0 <= day.toordinal() - _DAY0 < _DAYS
    if kind == "ssn":
        a, b, c = value.split("-")
        return a not in ("000", "666") and a < "900" and b != "00" and c != "0000"
    if kind == "phone":
        return 10 <= len(digits) <= 15
    if kind == "date":
        try:
            day = dt.datetime.strptime(value, _DATES[next(c for c in value if c in _DATES)]).date()
        except ValueError:
            return False
        return 0 <= day.toordinal() - _DAY0 < _DAYS
    return True


def _north_american(code: str, digits: str) -> bool:
    return code in ("", "+1") and len(digits) == 10 and digits[0] > "1" and digits[3] > "1"


def pseudonym(kind: str, value: str, key: bytes, back: bool = False) -> str:
    """The pseudonym of a valid value, or with ``back`` the value of a pseudonym."""
    digits = "".join(c for c in value if c.isalnum())
    if kind == "card":
        body = permute_format(digits[1:-1], key, f"card{digits[0]}", back)
        return _refill(value, digits[0] + body + luhn_digit(digits[0] + body))
    if kind == "iban":
        body = permute_format(digits[4:], key, "iban" + digits[:2], back)
        return _refill(value, f"{digits[:2]}{98 - _mod97(body + digits[:2] + '00'):02d}{body}")
    if kind == "ip":
        x = 0
        for part in value.split("."):
            x = x << 8 | int(part)
        x = permute(1 << 32, x, key, "ip", back)
        return ".".join(str(x >> s & 255) for s in (24, 16, 8, 0))
    if kind == "ipv6":
        new = str(ipaddress.IPv6Address(permute(1 << 128, int(ipaddress.IPv6Address(value)), key, "ipv6", back)))
        return new.upper() if value.upper() == value != value.lower() else new
    if kind == "day":
        day = permute(_DAYS, _named_day(value)[0].toordinal() - _DAY0, key, "date", back)
        return _rename_day(value, dt.date.fromordinal(_DAY0 + day))
    if kind == "date":
        form = _DATES[next(c for c in value if c in _DATES)]
        day = dt.datetime.strptime(value, form).toordinal() - _DAY0
        return dt.date.fromordinal(_DAY0 + permute(_DAYS, day, key, "date", back)).strftime(form)
    if kind == "ssn":
        new = value
        while True:  # walks the permutation until the number is valid again
            new = permute_format(new, key, "ssn", back)
            if valid("ssn", new):
                return new
    if kind == "phone":
        # the country code stays; the rest is permuted as one number, whatever parts it
        cut = re.match(r"\+[0-9]{1,3}(?=[ .(-])", value)
        at = cut.end() if cut else 2 if value[0] == "+" else 0
        code, new = value[:at], "".join(c for c in value[at:] if "0" <= c <= "9")
        rest = new
        while True:  # numbers of the +1 plan walk on among such numbers, others among others
            new = permute_format(new, key, "phone" + code, back)
            if _north_american(code, new) == _north_american(code, rest):
                return code + _refill(value[at:], new)
    if kind == "email":
        local, _, domain = value.rpartition("@")
        host, _, top = domain.rpartition(".")
        return f"{permute_format(local, key, 'local', back)}@{permute_format(host, key, 'host', back)}.{top}"
    mark = re.match(_NAMED + r"[\"']?|AKIA|ASIA|gh[pousr]_|sk[-_]", value)
    return mark[0] + permute_format(value[mark.end() :], key, "secret", back)


def _longest_card(text: str, start: int, end: int) -> int:
    """As ``_longest`` for the card digits in [start, end): sums with every other digit doubled, from the first or the second on, check all lengths at once."""
    sums, digits, best = [0, 0], 0, 0
    first, other = text[start], False
    for at in range(start, end):
        if not "0" <= (c := text[at]) <= "9":
            continue
        digits += 1
        other = other or c != first
        x = int(c)
        twice = 2 * x - 9 * (x > 4)
        sums[digits % 2] += twice
        sums[1 - digits % 2] += x
        # the last digit counts once: the sum in which it was not doubled
        if digits > 12 and other and (at + 1 == end or not text[at + 1].isalnum()) and sums[1 - digits % 2] % 10 == 0:
            best = at + 1
    return best


def _longest(kind: str, text: str, start: int) -> int:
    """End of the longest valid value of a kind that begins at ``start`` and ends with one of its groups; 0 if there is none."""
    m = _EACH[kind].match(text, start)
    if m and kind == "card":
        return _longest_card(text, start, m.end())
    if not m or valid(kind, m[0]):
        return m.end() if m else 0
    for end in range(m.end() - 1, start, -1) if kind in GROUPED else ():
        if not text[end].isalnum() and (m := _EACH[kind].fullmatch(text, start, end)) and valid(kind, m[0]):
            return end
    return 0


def _longer_card(text: str, start: int, end: int) -> tuple[int, int]:
    """The longest card that begins with a group of [start, end): digits before a card may make up a shorter one with its beginning."""
    size = lambda s, e: sum(c.isdigit() for c in text[s:e])
    spans = [(s, _longest("card", text, s)) for s in range(start + 1, end) if text[s].isdigit() and not text[s - 1].isdigit()]
    return max([(start, end), *spans], key=lambda x: (size(*x), -x[0]))


def find(text: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, kind) of the valid values of a whole text, left to right, none overlapping.

    A match that is not valid is searched for shorter ones that end with a group, then for other
    kinds at its place, then again from its second character on, so that it hides nothing.
    """
    at = 0
    while m := _FIND.search(text, at):
        start = m.start()
        if valid(m.lastgroup, m[0]):
            yield start, m.end(), m.lastgroup
            at = m.end()
            continue
        for kind in KINDS[KINDS.index(m.lastgroup) :]:
            if end := _longest(kind, text, start):
                if kind == "card":
                    start, end = _longer_card(text, start, end)
                yield start, end, kind
                at = end
                break
        else:
            at = start + 1


def pseudonymise(text: str, key: bytes) -> tuple[str, list[tuple[int, int, str]]]:
    """The text with pseudonyms, and where they stand in it."""
    if not _GATE.search(text):
        return text, []
    parts, spans, at, size = [], [], 0, 0
    for start, end, kind in find(text):
        new = pseudonym(kind, text[start:end], key)
        parts += [text[at:start], new]
        size += start - at
        spans.append((size, size + len(new), kind))
        size += len(new)
        at = end
    return ("".join([*parts, text[at:]]), spans) if spans else (text, [])


def _replace(key: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())])
        for batch in C.slices(batches):
            made = [(None, []) if t is None else pseudonymise(t, key) for t in batch.column(1).to_pylist()]
            spans = [[{"start": a, "end": b, "kind": k} for a, b, k in s] for _, s in made]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([t for t, _ in made], pa.string()), pa.array([len(s) for s in spans], pa.int64()), pa.array(spans, pa.list_(span))],
                names=["doc_id", "text", "n_found", "spans"],
            )

    return run


def feistel_pseudonyms(docs: DataFrame, key: bytes) -> DataFrame:
    """Rows (doc_id, text, n_found, spans), one for each row of ``docs``. An empty ``key`` is an error.

    ``text`` is the whole text with each value replaced, ``spans`` tells where in it (code
    points) and of which kind. Null texts stay null; texts without such values stay as they
    are; other columns are not read; an empty table gives no rows.
    """
    if not key:
        raise ValueError("pseudonyms need a key")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        _replace(key), "doc_id long, text string, n_found long, spans array<struct<start:long,end:long,kind:string>>"
    )
