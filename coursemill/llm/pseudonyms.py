"""Format-preserving pseudonyms for personal data.

Validated values are permuted within their own format by a keyed Feistel network: a card number
becomes another card number that passes its check digit, a date another date, an address another
address. The permutation depends on the key and on the kind alone, so equal values stay linked
across documents, different values stay different, and the holder of the key can go back.

What a kind's values count is numbered 0 to N-1; the network runs on the next even number of bits
and walks its cycle until it is below N again.

The key comes from the session setting ``spark.coursemill.pseudonym.secret``, without which nothing runs.

All notations of a day have the same pseudonym. So that each keeps its form and can be read back, a
day goes to one of the same class: months of one or two digits, days of one digit, 10 to 12, and 13
and more. A pseudonym shows that class of its day.

Left as they are: IPv6 addresses, days written with names of months or without marks between their
parts, social security and telephone numbers without marks, cards with dots or no-break spaces.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from datetime import date, timedelta
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coursemill.session import ship

#: The session setting that holds the key. Spark masks settings with ``secret`` in their names where it shows or logs them.
KEY_SETTING = "spark.coursemill.pseudonym.secret"
ROUNDS = 8


def key_from(text: str) -> bytes:
    return hashlib.blake2b(text.encode(), digest_size=32).digest()


def session_key(spark: SparkSession) -> bytes:
    """The key of the session, a hash of the setting's text. Without the setting there is none: a key drawn for the session would cut every link to earlier and later jobs."""
    given = spark.conf.get(KEY_SETTING, None)
    if not given:
        raise ValueError(f"set {KEY_SETTING}")
    return key_from(given)


def feistel(value: int, size: int, kind: str, key: bytes, back: bool = False) -> int:
    """The keyed permutation of 0..size-1, or its inverse."""
    if size < 2:
        return value
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask, n_bytes = (1 << half) - 1, (half + 7) // 8

    def word(k: int, right: int) -> int:
        h = hashlib.blake2b(right.to_bytes(n_bytes, "big"), key=key, salt=bytes([k]), person=kind.encode()[:16], digest_size=max(8, n_bytes))
        return int.from_bytes(h.digest(), "big") & mask

    while True:
        left, right = value >> half, value & mask
        if back:
            for k in reversed(range(ROUNDS)):
                left, right = right ^ word(k, left), left
        else:
            for k in range(ROUNDS):
                left, right = right, left ^ word(k, right)
        value = left << half | right
        if value < size:
            return value


def luhn_digit(digits: str) -> str:
    """The check digit that makes digits + it pass the Luhn test."""
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (2 - k % 2)
        total += n - 9 * (n > 9)
    return str(-total % 10)


def _digits_into(shape: str, digits: str) -> str:
    """The digits put in the places of the digits of ``shape``."""
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in shape)


def _permuted(digits: str, kind: str, key: bytes, back: bool) -> str:
    """Digits as a number of as many digits."""
    return str(feistel(int(digits), 10 ** len(digits), f"{kind}{len(digits)}", key, back)).zfill(len(digits))


def card(text: str, key: bytes, back: bool) -> str | None:
    """Payment card numbers of 13 to 19 digits that pass the Luhn test. The first digit, which names the network, stays."""
    digits = re.sub(r"[ -]", "", text)
    if not 13 <= len(digits) <= 19 or digits[0] == "0" or luhn_digit(digits[:-1]) != digits[-1]:
        return None
    body = digits[0] + _permuted(digits[1:-1], "card" + digits[0], key, back)
    return _digits_into(text, body + luhn_digit(body))


def card_places(run: str) -> list[tuple[int, int]]:
    """Where card numbers stand in a run of digit groups: from each group on, the longest one of 19 to 13 digits that passes its test."""
    groups = [m.span() for m in re.finditer(r"\d+", run)]
    found, k = [], 0
    while k < len(groups):
        ends, n = [], 0
        for j in range(k, len(groups)):
            n += groups[j][1] - groups[j][0]
            if n > 19:
                break
            if n >= 13:
                ends.append(j)
        for j in reversed(ends):
            digits = re.sub(r"[ -]", "", run[groups[k][0] : groups[j][1]])
            if digits[0] != "0" and luhn_digit(digits[:-1]) == digits[-1]:
                found.append((groups[k][0], groups[j][1]))
                k = j
                break
        k += 1
    return found


def cards(run: str, key: bytes, back: bool) -> list[tuple[int, int, str]]:
    """(start, end, new value) of every card number in a run of digit groups.

    A new number with which the run would be read otherwise is permuted again, so that the way back
    finds the same places; only then does a number's pseudonym depend on its neighbours.
    """
    places = card_places(run)
    for start, end in reversed(places) if back else places:
        while True:
            run = run[:start] + card(run[start:end], key, back) + run[end:]
            if card_places(run) == places:
                break
    return [(start, end, run[start:end]) for start, end in places]


def phone(text: str, key: bytes, back: bool) -> str | None:
    """North American numbers: area and exchange begin with 2-9. A country code 1 stays."""
    digits = re.sub(r"\D", "", text)
    head, rest = digits[:-10], digits[-10:]
    if head not in ("", "1") or rest[0] < "2" or rest[3] < "2":
        return None
    # area 200-999, exchange 200-999, line 0000-9999
    number = ((int(rest[:3]) - 200) * 800 + int(rest[3:6]) - 200) * 10_000 + int(rest[6:])
    number = feistel(number, 800 * 800 * 10_000, "phone", key, back)
    made = f"{number // 8_000_000 + 200}{number // 10_000 % 800 + 200}{number % 10_000:04d}"
    return _digits_into(text, head + made)


def international(text: str, key: bytes, back: bool) -> str | None:
    """Other numbers with a plus sign, 8 to 15 digits (E.164). The first two digits stay, as they hold the country code."""
    digits = re.sub(r"\D", "", text)
    if not 8 <= len(digits) <= 15:
        return None
    return _digits_into(text, digits[:2] + _permuted(digits[2:], "tel" + digits[:2], key, back))


def ip_address(text: str, key: bytes, back: bool) -> str | None:
    """IPv4 addresses in dotted form."""
    parts = text.split(".")
    if any(int(p) > 255 or p != str(int(p)) for p in parts):
        return None
    number = feistel(int.from_bytes(bytes(map(int, parts)), "big"), 1 << 32, "ip", key, back)
    return ".".join(map(str, number.to_bytes(4, "big")))


def social_security(text: str, key: bytes, back: bool) -> str | None:
    """US social security numbers: area 001-899 without 666, group 01-99, serial 0001-9999."""
    area, group, serial = map(int, text.split("-"))
    if not 0 < area < 900 or area == 666 or not group or not serial:
        return None
    at = ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1
    at = feistel(at, 898 * 99 * 9999, "ssn", key, back)
    area = at // (99 * 9999) + 1
    return f"{area + (area >= 666):03d}-{at // 9999 % 99 + 1:02d}-{at % 9999 + 1:04d}"


def iban(text: str, key: bytes, back: bool) -> str | None:
    """International bank account numbers that pass the mod-97 test, with check digits 02 to 98, as they are issued. Country and the kind of each character stay."""
    plain = text.replace(" ", "")
    remainder = lambda s: int("".join(str(int(c, 36)) for c in s)) % 97
    if not 15 <= len(plain) <= 34 or not "02" <= plain[2:4] <= "98" or remainder(plain[4:] + plain[:4]) != 1:
        return None
    body = _characters(plain[4:], "iban" + plain[:2], key, back)
    made = f"{plain[:2]}{98 - remainder(body + plain[:2] + '00'):02d}{body}"
    it = iter(made)
    return "".join(c if c == " " else next(it) for c in text)


def _lower(text: str | None) -> str | None:
    return text and text.lower()


def _characters(text: str, kind: str, key: bytes, back: bool) -> str:
    """Letters and digits permuted among texts of the same pattern of digits, capitals and small letters; other characters stay."""
    classes = ("0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    places = [(k, cls) for k, c in enumerate(text) for cls in classes if c in cls]
    size, number = 1, 0
    for k, cls in places:
        number = number * len(cls) + cls.index(text[k])
        size *= len(cls)
    pattern = "".join("dUl"[classes.index(cls)] for _, cls in places)
    number = feistel(number, size, hashlib.blake2b(f"{kind}:{pattern}".encode(), digest_size=8).hexdigest(), key, back)
    out = list(text)
    for k, cls in reversed(places):
        number, digit = divmod(number, len(cls))
        out[k] = cls[digit]
    return "".join(out)


def email(text: str, key: bytes, back: bool) -> str | None:
    """Mail addresses with a local part of up to 64 characters, which is permuted; the domain stays."""
    local, _, domain = text.partition("@")
    return f"{_characters(local, 'email@' + domain.lower(), key, back)}@{domain}"


def hex_token(text: str, key: bytes, back: bool) -> str | None:
    """Hexadecimal secrets of 32 or more digits. The case of letters goes with the whole token."""
    if not (text == text.lower() or text == text.upper()) or not re.search(r"\d", text) or not re.search(r"[a-fA-F]", text):
        return None
    made = f"{feistel(int(text, 16), 16 ** len(text), f'hex{len(text)}', key, back):0{len(text)}x}"
    return made.upper() if text == text.upper() else made


def access_key(text: str, key: bytes, back: bool) -> str | None:
    """Other secrets: letters and digits permuted, if there are both."""
    return _characters(text, "access key", key, back) if re.search(r"[0-9]", text) and re.search(r"[A-Za-z]", text) else None


FIRST_DAY, LAST_DAY = date(1900, 1, 1), date(2099, 12, 31)


def day_class(day: date) -> tuple[bool, int]:
    """What every notation of a day shows of it: digits of month and of day, and whether the day can be read as a month."""
    return day.month > 9, (day.day > 9) + (day.day > 12)


@cache
def _days() -> tuple[dict[tuple[bool, int], list[date]], dict[date, int]]:
    """The days of each class in order, and each day's place in its class."""
    classes: dict[tuple[bool, int], list[date]] = {}
    places = {}
    for n in range((LAST_DAY - FIRST_DAY).days + 1):
        day = FIRST_DAY + timedelta(n)
        own = classes.setdefault(day_class(day), [])
        places[day] = len(own)
        own.append(day)
    return classes, places


def other_day(day: date, key: bytes, back: bool) -> date:
    """The pseudonym of a day: one permutation for all notations, within the day's class. So a notation without leading zeros keeps its length, and a slash date is read in the same order as before."""
    classes, places = _days()
    kind = day_class(day)
    return classes[kind][feistel(places[day], len(classes[kind]), f"date{int(kind[0])}{kind[1]}", key, back)]


def _date(order: str, least_day: int = 1) -> Callable[[str, bytes, bool], str | None]:
    def change(text: str, key: bytes, back: bool) -> str | None:
        """Calendar dates from 1900 to 2099, in the same notation; those from ``least_day`` of their month on."""
        parts = re.split(r"[-./]", text)
        y, m, d = (int(parts[order.index(c)]) for c in "ymd")
        try:
            day = date(y, m, d)
        except ValueError:
            return None
        if not FIRST_DAY <= day <= LAST_DAY or d < least_day:
            return None
        new = other_day(day, key, back)
        values = {"y": new.year, "m": new.month, "d": new.day}
        mark = text[len(parts[0])]
        return mark.join(f"{values[c]:0{len(p)}d}" for c, p in zip(order, parts, strict=True))

    return change


#: Kind, pattern, change. A change returns None where the value doesn't pass its test; then later kinds are tried.
KINDS: list[tuple[str, str, Callable[[str, bytes, bool], str | None]]] = [
    ("email", r"(?<![\w.+%-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)+", email),
    ("secret", r"(?<![0-9A-Za-z])[0-9a-fA-F]{32,128}(?![0-9A-Za-z])", hex_token),
    ("secret", r"(?<![0-9A-Za-z])(?:AKIA|ASIA)([0-9A-Z]{16})(?![0-9A-Za-z])", access_key),
    ("secret", r"(?<![0-9A-Za-z-])(?:sk|pk)[-_](?:(?:live|test|proj)[-_])?([0-9A-Za-z]{20,128})(?![0-9A-Za-z_-])", access_key),
    ("secret", r"(?<![0-9A-Za-z])(?:api_?key|token|secret|password)[ \t]?[=:][ \t]?[\"']?([0-9A-Za-z_-]{16,128})(?![0-9A-Za-z_-])", access_key),
    ("iban", r"(?<![0-9A-Za-z])[A-Z]{2}\d\d(?: ?[0-9A-Z]{4}){2,7}(?: ?[0-9A-Z]{1,3})?(?![0-9A-Za-z])", iban),
    ("iban", r"(?<![0-9A-Za-z])[a-z]{2}\d\d(?: ?[0-9a-z]{4}){2,7}(?: ?[0-9a-z]{1,3})?(?![0-9A-Za-z])", lambda text, key, back: _lower(iban(text.upper(), key, back))),
    ("date", r"(?<![\w.-])(?:\d{4}-\d{2}-\d{2})(?:(?=[Tt]\d{2})|(?![\w-]))", _date("ymd")),
    ("date", r"(?<![\w./])(?:\d{4}/\d{1,2}/\d{1,2})(?![\w/])", _date("ymd")),
    ("date", r"(?<![\w.])(?:\d{1,2}\.\d{1,2}\.\d{4})(?!\w|\.\d)", _date("dmy")),
    ("date", r"(?<![\w/])(?:\d{1,2}/\d{1,2}/\d{4})(?![\w/])", _date("mdy")),
    ("date", r"(?<![\w/])(?:\d{1,2}/\d{1,2}/\d{4})(?![\w/])", _date("dmy", 13)),  # where the month can't come first
    ("ip", r"(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?!\w|\.\d)", ip_address),
    ("ssn", r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])", social_security),
    ("card", r"(?<![\w.-])\d+(?:[ -]\d+)*(?![\w-])", card),  # a run of digit groups, see cards()
    ("phone", r"(?<![\w.+-])(?:\+?1[ .-]?)?(?:\([2-9]\d\d\) ?|[2-9]\d\d[ .-])[2-9]\d\d[ .-]\d{4}(?![\w-])", phone),
    ("phone", r"(?<![\w+])\+[1-9]\d{0,2}(?:[ .-]?\(?\d{1,4}\)?){2,5}(?![\w-])", international),
]
NAMES = list(dict.fromkeys(k for k, _, _ in KINDS))
#: Any value holds one of these.
HINT = re.compile(r"[0-9@]")
_PATTERNS = [(kind, re.compile(pattern, re.ASCII), change) for kind, pattern, change in KINDS]
_PHONE = next(pattern for _, pattern, change in _PATTERNS if change is phone)


def spans(text: str, key: bytes, back: bool = False) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, new value) of every validated value, from left to right; earlier kinds win where two overlap.

    Both the values of earlier kinds and the matches of a kind go from left to right, so one walk
    along both finds the overlaps.
    """
    found: list[tuple[int, int, str, str]] = []
    for kind, pattern, change in _PATTERNS:
        new_ones, at = [], 0
        if change is card:
            for start, run in _runs(text, pattern, found):
                new_ones += [(start + a, start + b, kind, new) for a, b, new in cards(run, key, back)]
        else:
            for m in pattern.finditer(text):
                start, end = m.span(pattern.groups)  # the group, where there is one
                while at < len(found) and found[at][1] <= start:
                    at += 1
                if at < len(found) and found[at][0] < end:
                    continue
                new = change(text[start:end], key, back)
                if new is not None:
                    new_ones.append((start, end, kind, new))
        found = sorted(found + new_ones)
    return found


def _runs(text: str, pattern: re.Pattern, found: list[tuple[int, int, str, str]]) -> Iterator[tuple[int, str]]:
    """Runs of digit groups that may hold a card number, cut at values found before and at telephone numbers beside 13 digits or more."""
    first = 0
    for m in pattern.finditer(text):
        digits = sum(map(str.isdigit, m.group()))
        if digits < 13:
            continue
        while first < len(found) and found[first][1] <= m.start():
            first += 1
        last = first
        while last < len(found) and found[last][0] < m.end():
            last += 1
        cuts = [x[:2] for x in found[first:last]]
        if digits >= 13 + 10:
            cuts += [x.span() for x in _PHONE.finditer(text, m.start(), m.end())]
        at = m.start()
        for a, b in [*sorted(cuts), (m.end(), m.end())]:
            if a > at:
                yield at, text[at:a]
            at = max(at, b)


#: Only stretches of a text this near to a digit or @ go through the patterns; they are cut at spaces.
_NEAR = 160


def _stretches(text: str) -> Iterator[tuple[int, int]]:
    """Stretches that hold every digit and @ of a text, cut at places that no value goes over."""
    start = end = -1
    for m in HINT.finditer(text):
        if m.start() < end:
            continue
        if start >= 0 and m.start() - end > _NEAR:
            yield start, end
            start = -1
        if start < 0:
            start = max(text.rfind(" ", 0, max(0, m.start() - _NEAR)) + 1, 0)
        cut = text.find(" ", m.start() + _NEAR)
        end = len(text) if cut < 0 else cut
    if start >= 0:
        yield start, end


def pseudonymize(text: str, key: bytes, back: bool = False) -> tuple[str, dict[str, int]]:
    """The text with its values replaced, and how many of each kind."""
    counts = dict.fromkeys(NAMES, 0)
    parts, at = [], 0
    for first, past in _stretches(text):
        for start, end, kind, new in spans(text[first:past], key, back):
            if first + start < at:
                continue
            parts += [text[at : first + start], new]
            at = first + end
            counts[kind] += 1
    return ("".join([*parts, text[at:]]) if parts else text), counts


def pseudonymize_documents(docs: DataFrame, key: bytes | None = None, back: bool = False) -> DataFrame:
    """doc_id, text with pseudonyms, and n_<kind> for every kind.

    A null text stays null and has no values; texts of any length are taken whole; repeated rows give
    equal results; other columns are ignored, whatever their names; an empty table gives no rows. Rows are mapped one by one: no shuffle. With ``back``,
    pseudonyms become the values again. key: the session's by default.
    """
    ship(docs.sparkSession)
    key = key or session_key(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                rows = batch.slice(at, 512)
                texts, counts = [], []
                for text in rows.column(1).to_pylist():
                    new, n = pseudonymize(text, key, back) if text and HINT.search(text) else (text, None)
                    texts.append(new)
                    counts.append([n[k] for k in NAMES] if n else [0] * len(NAMES))
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(texts, pa.string()), *(pa.array(c, pa.int32()) for c in zip(*counts, strict=True))], names=["doc_id", "text", *(f"n_{k}" for k in NAMES)])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, text string, " + ", ".join(f"n_{k} int" for k in NAMES))
