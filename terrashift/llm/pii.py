"""Format-preserving pseudonyms for personal data, by a keyed Feistel permutation.

Found and validated: payment cards (13-19 digits, Luhn), IBANs (modulo 97),
IPv4 addresses, calendar dates from 1900 to 2099, US social security numbers,
international and ``(area) local`` phone numbers, e-mail addresses, and
secrets (hexadecimal strings of 32 digits and more, and the value after a word
such as token, secret, password or api key).

Each value is mapped within its own format: digits to digits, letters to
letters of the same case, separators stay; a card gets its Luhn digit again, an
IBAN its check digits, a date is another day between 1900 and 2099 in the same
notation. The map is a permutation of the format that depends only on key and
kind, so equal values stay equal and different ones different, in every
document and on every executor, and nothing has to be shared or looked up.

Dates whose day is beyond 12 stay such, and the others too: only the former
show whether day or month stands first, so both kinds are closed in every
notation, and no result can be read as another date's. A date has the same
pseudonym in every notation with two-digit days and months; notations with a
one-digit day or month are closed sets of their own, as widths are kept.
Where day or month may come first (both up to 12) the day is read first.

The permutation is x -> P^-1(P(x) + s), with P an alternating Feistel network
whose round function is keyed BLAKE2b: it has no fixed point, so no value
stays as it was. Values that fail validation after the map are walked along
the cycle until one is valid, which is a permutation of the valid values.

Each text is one row's work: nothing is shuffled. Defined results: null stays
null, text without such values stays the very same; digits that are not valid
(a 16-digit number that fails Luhn, 31 February) are left alone. Other columns
pass through, but for one that has the name of the counts: they replace it.
Values over ``CHUNK`` characters are permuted part by part, each under a label
that the parts before it make, in time proportional to their length.
"""

from __future__ import annotations

import datetime
import re
import unicodedata
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import lru_cache
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame

ROUNDS = 8
CHUNK = 64  # characters that one permutation takes; longer values are chains of them
LOWER = "abcdefghijklmnopqrstuvwxyz"
ACCENTED = "".join(chr(c) for c in range(0xE0, 0xFF) if c != 0xF7)  # the letters of Latin-1 that have a capital there
FIRST_DAY = datetime.date(1900, 1, 1).toordinal()
DAYS = datetime.date(2099, 12, 31).toordinal() - FIRST_DAY + 1


class Permutation:
    """Keyed permutations of 0 .. n - 1 without fixed points (n > 1)."""

    def __init__(self, key: bytes):
        self.key = blake2b(key, digest_size=32).digest()

    def _round(self, label: str, n: int, k: int, x: int, m: int) -> int:
        data = b"%s|%d|%x|%x" % (label.encode(), k, n, x)
        size = min(64, (m.bit_length() + 7) // 8 + 8)
        out, part = b"", 0
        while len(out) < size or len(out) * 8 < m.bit_length() + 64:
            out += blake2b(data + b"|%d" % part, key=self.key, digest_size=64).digest()
            part += 1
        return int.from_bytes(out, "big") % m

    def _sides(self, n: int) -> tuple[int, int]:
        """a * b >= n, about equal."""
        a = 1 << (n.bit_length() + 1) // 2
        return a, -(-n // a)

    def _once(self, x: int, label: str, n: int, back: bool) -> int:
        a, b = self._sides(n)
        left, right = x % a, x // a  # left in [0, a), right in [0, b)
        order = range(ROUNDS - 1, -1, -1) if back else range(ROUNDS)
        sign = -1 if back else 1
        for k in order:
            if k % 2 == 0:
                left = (left + sign * self._round(label, n, k, right, a)) % a
            else:
                right = (right + sign * self._round(label, n, k, left, b)) % b
        return right * a + left

    def _walk(self, x: int, label: str, n: int, back: bool) -> int:
        x = self._once(x, label, n, back)
        while x >= n:
            x = self._once(x, label, n, back)
        return x

    def map(self, x: int, label: str, n: int) -> int:
        if n < 2:
            return x
        shift = 1 + self._round(label + "|shift", n, ROUNDS, 0, n - 1) if n > 2 else 1
        return self._walk((self._walk(x, label, n, False) + shift) % n, label, n, True)


def luhn_digit(digits: str) -> str:
    """The digit that completes ``digits`` to a valid number."""
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (2 if k % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return str(-total % 10)


def iban_check(country: str, rest: str) -> str:
    number = "".join(str(int(c, 36)) for c in rest + country + "00")
    return f"{98 - int(number) % 97:02d}"


def calendar_day(y: str, m: str, d: str) -> int | None:
    """The day counted from 1900-01-01, or None if there is no such day."""
    try:
        day = datetime.date(int(y), int(m), int(d)).toordinal() - FIRST_DAY
    except ValueError:
        return None
    return day if 0 <= day < DAYS else None


@lru_cache(None)
def days_like(late: bool, month_width: int, day_width: int) -> tuple[int, ...]:
    """The days beyond the 12th of their month, or the others, that can be written in these widths."""
    found = []
    for day in range(DAYS):
        d = datetime.date.fromordinal(FIRST_DAY + day)
        if (d.day > 12) == late and (month_width > 1 or d.month < 10) and (day_width > 1 or d.day < 10):
            found.append(day)
    return tuple(found)


def _kin(c: str) -> tuple[int, str]:
    """Block of 128 code points and category: letters of one script and case, or digits."""
    return ord(c) >> 7, unicodedata.category(c)


@lru_cache(None)
def _kindred(block: int, category: str) -> str:
    return "".join(c for c in map(chr, range(block << 7, block + 1 << 7)) if unicodedata.category(c) == category)


# One alternation; each kind is validated by its function, which may leave the value alone.
PATTERN = re.compile(
    r"(?<![\w.+%\-])(?P<email>[\w.+%\-]++@[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,})"
    r"|(?P<secret>(?i:\b(?:api[_ \-]?key|access[_ \-]?key|token|secret|passwd|password)\b)[\"']?\s{0,3}[=:]\s{0,3}[\"']?)(?P<value>[A-Za-z0-9_\-./+]{8,})"
    r"|(?<![0-9A-Za-z])(?P<hex>[0-9a-f]{32,}|[0-9A-F]{32,})(?![0-9A-Za-z])"
    r"|(?<![0-9A-Za-z])(?P<iban>[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)(?![0-9A-Za-z])"
    r"|(?<![0-9A-Za-z.])(?P<ip>\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})(?![0-9A-Za-z]|\.\d)"
    r"|(?<![0-9A-Za-z])(?P<ymd>\d{4}(?P<s>[\-/.])\d{1,2}(?P=s)\d{1,2})(?![0-9A-Za-z])"
    r"|(?<![0-9A-Za-z])(?P<dmy>\d{1,2}(?P<z>[\-/.])\d{1,2}(?P=z)\d{4})(?![0-9A-Za-z])"
    r"|(?<![0-9A-Za-z])(?P<ssn>\d{3}-\d{2}-\d{4})(?![0-9A-Za-z\-])"
    r"|(?<![0-9A-Za-z])(?P<card>\d{13,19}|\d{4}(?P<gap>[ \-])\d{4}(?P=gap)\d{4}(?P=gap)\d{4}|\d{4}(?P<bar>[ \-])\d{6}(?P=bar)\d{5})(?![0-9A-Za-z])"
    r"|(?<![0-9A-Za-z])(?P<phone>(?:\+1[ .\-]?)?\(\d{3}\) ?\d{3}[ .\-]\d{4}|\+1[ .\-]?\d{3}[ .\-]?\d{3}[ .\-]?\d{4}"
    r"|\+(?!1[ (.\-])\d{1,3}(?:[ .\-]?\(?\d{2,4}\)?){2,4})(?![0-9A-Za-z])"
)
HINT = re.compile(r"[0-9@]|(?i:token|secret|passw|key)")


class Pseudonyms:
    """Texts to texts under one key."""

    def __init__(self, key: bytes):
        self.permutation = Permutation(key)
        self.cached = lru_cache(100_000)(self._value)

    def replace(self, text: str) -> tuple[str, dict[str, int]]:
        """The text with pseudonyms, and how many values of each kind it held."""
        counts: dict[str, int] = {}

        def one(m: re.Match) -> str:
            kind = next(k for k in KINDS if m[k] is not None)
            new = self.cached(kind, m["value"] if kind == "secret" else m[kind])
            if new is None:
                return m[0]
            name = "date" if kind in ("ymd", "dmy") else "secret" if kind == "hex" else kind
            counts[name] = counts.get(name, 0) + 1
            return m["secret"] + new if kind == "secret" else new

        if not HINT.search(text):
            return text, counts
        lines = text.split("\n")
        for k, line in enumerate(lines):
            if HINT.search(line):
                lines[k] = PATTERN.sub(one, line)
        return "\n".join(lines), counts

    def _value(self, kind: str, value: str) -> str | None:
        """The pseudonym, or None if the value isn't valid."""
        return getattr(self, f"_{kind}")(value)

    # Permuting characters by class: each class's characters form one number of that class's radix.

    def _chars(self, label: str, value: str, alphabet: str, fold: bool = False) -> str:
        low = [c.lower() if fold and len(c.lower()) == 1 else c for c in value]
        index = {c: k for k, c in enumerate(alphabet)}
        at = [k for k, c in enumerate(low) if c in index]
        out = list(value)
        seen = blake2b(digest_size=16)
        for first in range(0, len(at), CHUNK):  # what stands before is part of the label: still a permutation of the whole
            part = at[first : first + CHUNK]
            x = 0
            for k in part:
                x = x * len(alphabet) + index[low[k]]
            mark = f"|{first}|{seen.hexdigest()}" if first else ""
            x = self.permutation.map(x, f"{label}|{len(part)}{mark}", len(alphabet) ** len(part))
            seen.update("".join(low[k] for k in part).encode())
            for k in reversed(part):
                x, r = divmod(x, len(alphabet))
                c = alphabet[r]
                out[k] = c.upper() if value[k] != low[k] and len(c.upper()) == 1 else c
        return "".join(out)

    def _alnum(self, label: str, value: str, letters: str) -> str:
        return self._chars(f"{label}-d", self._chars(f"{label}-l", value, letters, fold=True), "0123456789")

    def _walked(self, value: str, step: Callable[[str], str], valid: Callable[[str], bool]) -> str:
        out = step(value)
        while not valid(out):
            out = step(out)
        return out

    def _email(self, value: str) -> str | None:
        name, _, domain = value.rpartition("@")
        for kin in sorted({_kin(c) for c in name if c.isalnum() and c > "\u00ff"}):
            name = self._chars(f"email-{kin}", name, _kindred(*kin))
        name = self._chars("email-a", name, ACCENTED, fold=True)
        new = f"{self._alnum('email', name, LOWER)}@{domain}"
        return new if new != value else None  # no letter or digit in the name

    def _secret(self, value: str) -> str:
        return self._alnum("secret", value, LOWER)

    def _hex(self, value: str) -> str:
        upper = value.upper() == value
        out = self._chars("hex", value.lower(), "0123456789abcdef")
        return out.upper() if upper else out

    def _card(self, value: str) -> str | None:
        digits = re.sub(r"[ \-]", "", value)
        if luhn_digit(digits[:-1]) != digits[-1]:
            return None
        new = self._chars("card", digits[:-1], "0123456789")
        left = iter(new + luhn_digit(new))
        return "".join(next(left) if c.isdigit() else c for c in value)

    def _iban(self, value: str) -> str | None:
        plain = value.replace(" ", "")
        if not 15 <= len(plain) <= 34 or iban_check(plain[:2], plain[4:]) != plain[2:4]:
            return None
        body = self._chars("iban-d", plain[4:], "0123456789")
        body = self._chars("iban-l", body, LOWER.upper())
        left = iter(plain[:2] + iban_check(plain[:2], body) + body)
        return "".join(c if c == " " else next(left) for c in value)

    def _ip(self, value: str) -> str | None:
        parts = [int(p) for p in value.split(".")]
        if max(parts) > 255:
            return None
        x = self.permutation.map(int.from_bytes(bytes(parts), "big"), "ip", 1 << 32)
        return ".".join(map(str, x.to_bytes(4, "big")))

    def _day(self, day: int, month_width: int, day_width: int) -> datetime.date:
        late = datetime.date.fromordinal(FIRST_DAY + day).day > 12
        like = days_like(late, month_width, day_width)
        new = self.permutation.map(bisect_left(like, day), f"date|{late}|{month_width}|{day_width}", len(like))
        return datetime.date.fromordinal(FIRST_DAY + like[new])

    def _ymd(self, value: str) -> str | None:
        y, m, d = re.split(r"[\-/.]", value)
        day = calendar_day(y, m, d)
        if day is None:
            return None
        new, sep = self._day(day, len(m), len(d)), value[4]
        return f"{new.year}{sep}{new.month:0{len(m)}d}{sep}{new.day:0{len(d)}d}"

    def _dmy(self, value: str) -> str | None:
        a, b, y = re.split(r"[\-/.]", value)
        sep = value[len(a)]
        if (day := calendar_day(y, b, a)) is not None:  # day first; else month first
            new = self._day(day, len(b), len(a))
            a, b = f"{new.day:0{len(a)}d}", f"{new.month:0{len(b)}d}"
        elif (day := calendar_day(y, a, b)) is not None:
            new = self._day(day, len(a), len(b))
            a, b = f"{new.month:0{len(a)}d}", f"{new.day:0{len(b)}d}"
        else:
            return None
        return f"{a}{sep}{b}{sep}{new.year}"

    def _ssn(self, value: str) -> str | None:
        def valid(v: str) -> bool:
            return v[:3] not in ("000", "666") and v[0] != "9" and v[4:6] != "00" and v[7:] != "0000"

        return self._walked(value, lambda v: self._chars("ssn", v, "0123456789"), valid) if valid(value) else None

    def _phone(self, value: str) -> str | None:
        digits = sum(c.isdigit() for c in value)
        if not 8 <= digits <= 15:
            return None
        head = re.match(r"\+\d{1,3}(?=[ .\-(])|", value)[0] or ("+" if value[0] == "+" else "")
        return head + self._chars("phone", value[len(head) :], "0123456789")


KINDS = ("email", "secret", "hex", "iban", "ip", "ymd", "dmy", "ssn", "card", "phone")


def pseudonymised(docs: DataFrame, key: bytes, text: str = "text", found: str = "private") -> DataFrame:
    """``docs`` with pseudonyms in ``text``, and the column ``found``: MAP of kind to count."""
    docs = docs.drop(found)
    at = docs.columns.index(text)
    names = [*docs.columns, found]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pseudonyms = Pseudonyms(key)
        for batch in batches:
            texts, counts = [], []
            for x in batch.column(at):
                value = x.as_py()
                new, n = (None, {}) if value is None else pseudonyms.replace(value)
                texts.append(new)
                counts.append(list(n.items()))
            cols = [*batch.columns[:at], pa.array(texts, batch.schema.field(at).type), *batch.columns[at + 1 :]]
            cols.append(pa.array(counts, pa.map_(pa.string(), pa.int32())))
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return docs.mapInArrow(run, _schema(docs, found))


def _schema(docs: DataFrame, found: str):
    from pyspark.sql import types as T

    fields = [*docs.schema.fields, T.StructField(found, T.MapType(T.StringType(), T.IntegerType()))]
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in fields])
