"""Format-preserving pseudonyms for personal data.

Validated numbers (payment cards, bank accounts, telephone numbers, addresses
of hosts, social security numbers), dates and mail addresses are found in whole
texts and replaced by a keyed permutation of the values of their own format.
The permutation is a Feistel network over pairs of residues with cycle walking,
so it is a bijection: equal values get equal pseudonyms in every document,
different values different ones, and whoever holds the key can go back. A value
is what it says, not how it is spelled: a day has one pseudonym in every notation, a
mail address in upper and lower case, a number with and without its separators, a
telephone number's digits with and without the country, whose code is read from the digits by the table of codes.
Only where a rejected candidate overlaps a value, and the usual pseudonym would
make that candidate valid, another pseudonym is taken, so that going back works.
Check digits are computed anew, so a pseudonym passes the validation of its kind.

One pass over the rows in Arrow batches, no shuffle; the state is one key.
Null texts stay null, empty ones empty, very long ones are worked on whole;
repeated rows are treated alike; of candidates at one place the first kind
of ``KINDS`` that is valid counts; no rows give no rows; other columns stay.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

KINDS = ("email", "iban", "date", "ip", "ssn", "card", "phone")
ROUNDS = 10


class Feistel:
    """A keyed permutation of ``range(size)`` for each tweak."""

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def _round(self, tweak: bytes, i: int, value: int, size: int) -> int:
        data = b"%d|%d|" % (i, value) + tweak
        wide = hashlib.blake2b(data, key=self.key, digest_size=16 + (size.bit_length() + 7) // 8).digest()
        return int.from_bytes(wide, "big") % size

    def _pass(self, tweak: bytes, value: int, a: int, b: int, back: bool) -> int:
        x, y = divmod(value, b)  # x in range(a), y in range(b)
        for i in reversed(range(ROUNDS)) if back else range(ROUNDS):
            if i % 2 == 0:
                r = self._round(tweak, i, y, a)
                x = (x - r if back else x + r) % a
            else:
                r = self._round(tweak, i, x, b)
                y = (y - r if back else y + r) % b
        return x * b + y

    def permute(self, tweak: bytes, value: int, size: int, back: bool = False) -> int:
        """The image of ``value``; a value of a set of one stays."""
        if size < 2:
            return value
        a = math.isqrt(size - 1) + 1
        b = -(-size // a)
        while True:
            value = self._pass(tweak, value, a, b, back)
            if value < size:  # cycle walking: a * b is hardly more than size
                return value


def _luhn(digits: str) -> int:
    """The check digit that follows ``digits``."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return -total % 10


def _refill(shape: str, digits: str) -> str:
    """``shape`` with its digits replaced in turn."""
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in shape)


def _digits(p: Feistel, tweak: str, digits: str, back: bool) -> str:
    return str(p.permute(tweak.encode(), int(digits), 10 ** len(digits), back)).zfill(len(digits))


def _card(p: Feistel, s: str, back: bool) -> str | None:
    d = re.sub(r"\D", "", s)
    if not 13 <= len(d) <= 19 or _luhn(d[:-1]) != int(d[-1]) or len(set(d)) == 1:
        return None
    body = _digits(p, f"card{len(d)}", d[:-1], back)
    return _refill(s, body + str(_luhn(body)))


#: Country codes of one and two digits; all others have three. None begins another.
_CODES = {
    "1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "53", "54", "55", "56", "57", "58",
    "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "92", "93", "94", "95", "98",
}
#: Digits behind the country code, where a country's numbers have one length or two.
_LENGTHS = {
    "1": (10,), "7": (10,), "30": (10,), "31": (9,), "32": (8, 9), "33": (9,), "34": (9,), "41": (9,), "44": (9, 10), "45": (8,), "47": (8,), "48": (9,), "52": (10,), "55": (10, 11), "61": (9,), "81": (9, 10), "86": (10, 11), "91": (10,),
}
_TRUNK = re.compile(r"(\+\d{1,3}[ .-]?)(\(0\))(.*)\Z", re.DOTALL)


def _country(digits: str) -> str:
    """The country code that begins the digits after a plus sign."""
    return next((digits[:n] for n in (1, 2) if digits[:n] in _CODES), digits[:3])


def _phone_parts(s: str) -> tuple[str, str, str, str]:
    """``(before, kept, after, country)``: what is refilled, a trunk zero in brackets, and the code if the number begins with a plus sign."""
    trunk = _TRUNK.match(s)
    before, kept, after = trunk.groups() if trunk else (s, "", "")
    return before, kept, after, _country(re.sub(r"\D", "", before + after)) if s.startswith("+") else ""


def _phone(p: Feistel, s: str, back: bool) -> str | None:
    """The country's digits stay; the others are permuted alike with and without the country, and in every grouping."""
    before, kept, after, country = _phone_parts(s)
    d = re.sub(r"\D", "", before + after)
    local = d[len(country) :]
    if not 7 <= len(local) <= 12:
        return None
    new = _refill(before + after, country + _digits(p, f"phone{len(local)}", local, back))
    return new[: len(before)] + kept + new[len(before) :]


def _phone_forms(s: str) -> Iterator[str]:
    """The candidate up to the end of a group where it has the length of its country's numbers, longest first; then all of it."""
    *_, country = _phone_parts(s)
    for m in reversed([*re.finditer(r"(?<=\d)(?=[ .-]|\Z)", s)]) if country in _LENGTHS else ():
        form = s[: m.start()]
        before, _, after, _ = _phone_parts(form)
        if len(re.sub(r"\D", "", before + after)) - len(country) in _LENGTHS[country]:
            yield form
    yield s


def _iban_forms(s: str) -> Iterator[str]:
    """The candidate, and what is left without its last words, which may only look like groups of the number."""
    while s:
        yield s
        s = re.split(r"[ \n](?=[^ \n]*\Z)", s)[0] if re.search("[ \n]", s) else ""


def _ip(p: Feistel, s: str, back: bool) -> str | None:
    parts = s.split(".")
    if any(int(x) > 255 or (len(x) > 1 and x[0] == "0") for x in parts):
        return None
    n = p.permute(b"ip4", int.from_bytes(bytes(map(int, parts)), "big"), 2**32, back)
    return ".".join(map(str, n.to_bytes(4, "big")))


#: Numbers that were never issued are no social security numbers; the rest is one range.
def _ssn(p: Feistel, s: str, back: bool) -> str | None:
    area, group, serial = int(s[:3]), int(s[4:6]), int(s[7:])
    if area in (0, 666) or area >= 900 or not group or not serial:
        return None
    area -= 1 + (area > 666)
    n = p.permute(b"ssn", (area * 99 + group - 1) * 9999 + serial - 1, 898 * 99 * 9999, back)
    n, serial = divmod(n, 9999)
    area, group = divmod(n, 99)
    area += 1 + (area >= 665)
    return f"{area:03}{s[3]}{group + 1:02}{s[6]}{serial + 1:04}"


def _mod97(s: str) -> int:
    return int("".join(str(int(c, 36)) for c in s)) % 97


def _spell(p: Feistel, tweak: str, s: str, back: bool) -> str:
    """Permute a string among those with a digit, upper- or lower-case letter at the same places."""
    sizes, value = [], 0
    for c in s:
        size, base = (10, "0") if "0" <= c <= "9" else (26, "A") if "A" <= c <= "Z" else (26, "a") if "a" <= c <= "z" else (1, c)
        sizes.append((size, base))
        value = value * size + (ord(c) - ord(base))
    shape = "".join(b for _, b in sizes)
    value = p.permute(f"{tweak}{shape}".encode(), value, math.prod(n for n, _ in sizes), back)
    out = []
    for size, base in reversed(sizes):
        value, k = divmod(value, size)
        out.append(chr(ord(base) + k))
    return "".join(reversed(out))


def _iban(p: Feistel, s: str, back: bool) -> str | None:
    flat = re.sub(r"\s", "", s)
    if not 15 <= len(flat) <= 34 or _mod97(flat[4:] + flat[:4]) != 1:
        return None
    body = _spell(p, f"iban{flat[:2]}", flat[4:], back)
    whole = iter(flat[:2] + f"{98 - _mod97(body + flat[:2] + '00'):02}" + body)
    return "".join(c if c.isspace() else next(whole) for c in s)


_FIRST, _DAYS = dt.date(1900, 1, 1).toordinal(), (dt.date(2100, 1, 1) - dt.date(1900, 1, 1)).days


def _date(p: Feistel, s: str, back: bool) -> str | None:
    sep = re.sub(r"\d", "", s)[0]
    a, b, c = s.split(sep)
    order = "ymd" if len(a) == 4 else "mdy" if sep == "/" else "dmy"
    got = dict(zip(order, (a, b, c), strict=True))
    try:
        n = dt.date(int(got["y"]), int(got["m"]), int(got["d"])).toordinal() - _FIRST
    except ValueError:
        return None
    if not 0 <= n < _DAYS:
        return None
    day = dt.date.fromordinal(_FIRST + p.permute(b"date", n, _DAYS, back))
    value = {"y": f"{day.year:04}", "m": f"{day.month:02}", "d": f"{day.day:02}"}
    return sep.join(value[x] for x in order)


def _email(p: Feistel, s: str, back: bool) -> str | None:
    local, _, domain = s.rpartition("@")
    host, dot, top = domain.rpartition(".")
    new = _spell(p, "mail", local.lower(), back) + "@" + _spell(p, "host", host.lower(), back)
    return "".join(c.upper() if old.isupper() else c for c, old in zip(new, s, strict=False)) + dot + top


#: What is tried at a place, in this order. A candidate that fails its kind's validation hides nothing: the kinds after it are tried at its place, then all of them at the places within it.
_FOUND: dict[str, tuple[str, Callable[[Feistel, str, bool], str | None]]] = {
    "email": (r"(?<![\w.+%-])[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}", _email),
    "iban": (r"(?<!\w)[A-Z]{2}\d{2}(?:[ \n]?[A-Z0-9]{4}){2,7}(?:[ \n]?[A-Z0-9]{1,4})?(?!\w)", _iban),
    "date": (r"(?<![\w./-])(?:\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}|\d{2}\.\d{2}\.\d{4})(?:(?=T\d)|(?![\w/-]))", _date),
    "ip": (r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?!\w|\.\d)", _ip),
    "ssn": (r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])", _ssn),
    "card": (r"(?<![\w-])(?:\d{13,19}|(?:\d{4}[ \n]){3}\d{4}|(?:\d{4}-){3}\d{4}|\d{4}[ \n]\d{6}[ \n]\d{5}|\d{4}-\d{6}-\d{5})(?![\w-])", _card),
    "phone": (
        r"(?<![\w+])(?:(?:\+\d{1,3}[ \n.-]?)?\(\d{2,4}\)[ \n.-]?\d{3,4}[ \n.-]?\d{3,4}|\+\d{1,3}(?:[ .-]?\(0\))?(?:[ .-]?\d){5,14}|\d{3}[.-]\d{3}[.-]\d{4})(?!\w)",
        _phone,
    ),
}
_ONE = {k: re.compile(pattern, re.ASCII) for k, (pattern, _) in _FOUND.items()}
_ALL = re.compile("|".join(f"(?P<{k}>{pattern})" for k, (pattern, _) in _FOUND.items()), re.ASCII)
#: Where candidates lie: each token of one holds a digit or an at-sign, or is a letter group of an account number; between tokens is one blank or line end.
_TOKEN = r"[^\s0-9@]*[0-9@]\S*"
_REGION = re.compile(rf"(?<!\S){_TOKEN}(?:[ \n](?:[A-Z]{{1,4}}(?![A-Za-z0-9_])\S*|{_TOKEN}))*")


#: More characters than any candidate that can fail has, with what it looks at beyond its end.
_AROUND = 64


@dataclass
class _Hit:
    start: int
    end: int
    kind: str
    new: str
    reach: int  # where the last candidate ends that failed before this one was found


def _valid(p: Feistel, m: re.Match[str], kind: str, back: bool) -> tuple[int, str] | None:
    """Where the candidate's valid form ends and what replaces it."""
    forms = {"iban": _iban_forms, "phone": _phone_forms}.get(kind, lambda s: iter((s,)))
    for s in forms(m.group()):
        new = _FOUND[kind][1](p, s, back)
        if new is not None:
            return m.start() + len(s), new
    return None


def _next(p: Feistel, text: str, at: int, stop: int, back: bool) -> _Hit | None:
    """The first valid candidate from ``at`` on."""
    reach = at
    while m := _ALL.search(text, at, stop):
        kind = m.lastgroup
        for k in KINDS[KINDS.index(kind) :]:
            one = m if k == kind else _ONE[k].match(text, m.start(), stop)
            if one is None:
                continue
            if found := _valid(p, one, k, back):
                return _Hit(one.start(), found[0], k, found[1], reach if found[0] == one.end() else max(reach, one.end()))
            reach = max(reach, one.end())
        at = m.start() + 1
    return None


def _walk(p: Feistel, text: str, hits: list[_Hit], begin: int, stop: int, back: bool) -> list[str]:
    """What replaces each hit.

    Where failed candidates cover a hit, its pseudonym might make one of them
    valid, and nobody could go back. There the permutation is walked on until
    the same hits are found in the new text: a bijection of the values that leave
    them found. Going back undoes the hits in the opposite order.
    """
    now = [text[h.start : h.end] for h in hits]
    for i in reversed(range(len(hits))) if back else range(len(hits)):
        hit = hits[i]
        first, j = i + 1, i
        while j >= 0 and hits[j].start > hit.start - _AROUND:
            if hits[j].reach > hit.start:
                first = j
            j -= 1
        value = hit.new
        while first <= i and not _same(p, text, hits, now, first, i, value, begin, stop):
            value = _FOUND[hit.kind][1](p, value, back)
        now[i] = value
    return now


def _same(p: Feistel, text: str, hits: list[_Hit], now: list[str], first: int, i: int, value: str, begin: int, stop: int) -> bool:
    """Whether hits ``first`` to ``i`` are found again when ``value`` replaces the last of them."""
    at = hits[first - 1].end if first else begin
    head = (now[first - 1] if first else text[max(0, begin - 2) : begin])[-2:]
    parts, places, size = [head], [], len(head)
    for k in range(first, len(hits) + 1):
        limit = hits[k].start if k < len(hits) else stop
        gap = text[at : min(limit, at + _AROUND)] if k > i else text[at:limit]
        parts.append(gap)
        size += len(gap)
        if k == len(hits) or k > i and size - places[-1][1] >= _AROUND:
            break
        word = value if k == i else now[k]
        if k <= i:
            places.append((size, size + len(word), hits[k].kind))
        parts.append(word)
        size += len(word)
        at = hits[k].end
    local, at = "".join(parts), len(head)
    for place in places:
        found = _next(p, local, at, len(local), False)
        if found is None or (found.start, found.end, found.kind) != place:
            return False
        at = found.end
    return True


def pseudonymise(text: str, p: Feistel, back: bool = False) -> tuple[str, dict[str, int]]:
    """The text with its personal data replaced (or put back), and how many of each kind."""
    counts = dict.fromkeys(KINDS, 0)
    out, done = [], 0
    for region in _REGION.finditer(text):
        hits, at = [], region.start()
        while hit := _next(p, text, at, region.end(), back):
            hits.append(hit)
            counts[hit.kind] += 1
            at = hit.end
        whole = any(h.reach > h.start for h in hits)
        for hit, new in zip(hits, _walk(p, text, hits, region.start(), region.end(), back) if whole else [h.new for h in hits], strict=True):
            out += [text[done : hit.start], new]
            done = hit.end
    return "".join(out) + text[done:], counts


def pseudonyms(docs: DataFrame, key: bytes, text: str = "text", counts: bool = True, back: bool = False) -> DataFrame:
    """``docs`` with the text pseudonymised and, if asked for, ``n_<kind>`` counts.

    Columns of the input with the names of the counts are replaced. Whoever
    publishes the result keeps ``key``; ``back`` undoes the permutation.
    """
    if not key:
        raise ValueError("a key is needed")
    new = [f"n_{k}" for k in KINDS] if counts else []
    columns = [c for c in docs.columns if c not in new]
    schema = docs.select(columns).schema
    for c in new:
        schema = schema.add(c, "long", False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = Feistel(key)
        for batch in batches:
            found = [pseudonymise(x, p, back) if x else (x, dict.fromkeys(KINDS, 0)) for x in batch.column(text).to_pylist()]
            arrays = [batch.column(c) if c != text else pa.array([t for t, _ in found], batch.column(c).type) for c in columns]
            arrays += [pa.array([n[k] for _, n in found], pa.int64()) for k in KINDS] if counts else []
            yield pa.RecordBatch.from_arrays(arrays, [*columns, *new])

    return docs.select(columns).mapInArrow(run, schema)


def session_key(spark: SparkSession, default: bytes | None = None) -> bytes:
    """The key that the session names in ``spark.marlstone.pii.key``, else ``default``; an error where there is neither."""
    named = spark.conf.get("spark.marlstone.pii.key", None)
    if not named and not default:
        raise ValueError("spark.marlstone.pii.key must name a key")
    return named.encode() if named else default
