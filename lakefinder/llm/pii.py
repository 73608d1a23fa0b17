"""Format-preserving pseudonyms for private values, by Feistel networks keyed with a secret.

A value that validates (check digits, ranges, calendar) is read as a number within the set
of all values of its kind, that number is permuted by the key, and the result is written
in the same format: same length, same separators, valid again.  A permutation depends on
the kind and the size of the set only, so equal values become equal pseudonyms in every
document and in every way of writing them, different ones stay different, and who holds the
key can turn them back.
"""

from __future__ import annotations

import bisect
import datetime
import functools
import hashlib
import math
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from lakefinder.llm.arrow import tidy

ROUNDS = 8


class Permutation:
    """A keyed permutation of 0 .. size - 1: an unbalanced Feistel network, walked until it is back in range."""

    def __init__(self, key: bytes, tweak: str, size: int):
        self.size = size
        self.a = max(1, math.isqrt(size))
        self.b = -(-size // self.a)
        self.key = hashlib.blake2b(f"{tweak}/{size}".encode(), key=key[:64], digest_size=32).digest()
        self.width = (max(self.a, self.b).bit_length() + 7) // 8

    def _noise(self, r: int, x: int) -> int:
        return int.from_bytes(hashlib.blake2b(bytes([r]) + x.to_bytes(self.width + 1, "big"), key=self.key, digest_size=min(64, self.width + 8)).digest(), "big")

    def __call__(self, x: int, back: bool = False) -> int:
        if self.size < 2:
            return x
        while True:
            u, v = divmod(x, self.b)
            for r in reversed(range(ROUNDS)) if back else range(ROUNDS):
                sign = -1 if back else 1
                if r % 2:
                    v = (v + sign * self._noise(r, u)) % self.b
                else:
                    u = (u + sign * self._noise(r, v)) % self.a
            x = u * self.b + v
            if x < self.size:
                return x


@functools.lru_cache(maxsize=64)
def block(c: str) -> str:
    """The letters of the 128 code points among which ``c`` is."""
    first = ord(c) & ~127
    return "".join(x for x in map(chr, range(first, first + 128)) if x > "\x7f" and x.isalpha())


def luhn(digits: str) -> int:
    """The check digit of the digits before it."""
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (2 - k % 2)
        total += d - 9 * (d > 9)
    return -total % 10


def refill(shape: str, digits: str) -> str:
    """``shape`` with its digits replaced one by one."""
    more = iter(digits)
    return "".join(next(more) if c.isdigit() else c for c in shape)


#: Alphabets by which characters of a secret are permuted: each character stays in its own.
ALPHABETS = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
HEX = "0123456789abcdef"
#: Lengths of the groups in which cards are written.
GROUPED = ((4, 4, 4, 4), (4, 6, 5), (4, 6, 4), (4, 4, 4, 4, 3), *((n,) for n in range(13, 20)))
FIRST_DAY = datetime.date(1900, 1, 1).toordinal()
DAYS = datetime.date(2100, 1, 1).toordinal() - FIRST_DAY

#: What may be private, each with the method that validates it; the first that matches at a place is tried there.
KINDS = {
    "email": r"(?<![\w.+-])\w[\w.%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "secret": r"(?i:password|passwd|token|secret|api_?key)\s*[=:]\s*[\"']?(?P<secret_value>[A-Za-z0-9_\-]{8,})",
    "access_key": r"(?<![A-Za-z0-9_])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9_])",
    "iban": r"(?<![A-Za-z0-9_])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9_])",
    "address": r"(?<![A-Za-z0-9_.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\.?[0-9])",
    "date": r"(?<![0-9/.-])(?:[0-9]{4}(?P<date_sep>[-/.])[0-9]{2}(?P=date_sep)[0-9]{2}|[0-9]{2}(?P<sep2>[-/.])[0-9]{2}(?P=sep2)[0-9]{4})(?![0-9]|[-/.][0-9])",
    "social": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9]|-[0-9])",
    "phone": r"(?<![A-Za-z0-9_-])(?:\+?1[ .-]?)?(?P<phone_no>\([0-9]{3}\) ?[0-9]{3}[ .-]?[0-9]{4}|[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4})(?![0-9]|-[0-9])",
    "card": r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])",
}
PRIVATE = re.compile("|".join(f"(?P<{k}>{v})" for k, v in KINDS.items()))
#: Kinds whose match may go on past the value, into groups that follow; their pseudonyms are as long as the value.
LEADING = ("iban", "card")


def is_card(shape: str) -> bool:
    d = re.sub(r"\D", "", shape)
    return 13 <= len(d) <= 19 and luhn(d[:-1]) == int(d[-1]) and len(set(d)) > 1


def card_begins(shape: str) -> int:
    """The group of ``shape`` at which a valid card written in the usual groups begins; 0 if none does."""
    groups = re.split("[ -]", shape)
    for k in range(len(groups)):
        for form in GROUPED:
            some = groups[k : k + len(form)]
            if tuple(map(len, some)) == form and is_card("".join(some)):
                return k
    return 0


def is_iban(shape: str) -> bool:
    plain = shape.replace(" ", "")
    return 15 <= len(plain) <= 34 and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def leading(shape: str, valid: Callable[[str], bool], make: Callable[[str], str]) -> str | None:
    """The pseudonym of the longest valid value that ``shape`` begins with and that ends with a group; None if there is none.

    Where that value and groups that follow would read as a longer valid one, the pseudonym's own pseudonym
    is taken, and so on, so that the way back finds the same characters.
    """
    ends = [len(shape), *(i for i in range(len(shape) - 1, 0, -1) if shape[i] in " -")]
    for k, end in enumerate(ends):
        if valid(shape[:end]):
            new = make(shape[:end])
            while any(valid(new + shape[end:e]) for e in ends[:k]):
                new = make(new)
            return new
    return None


class Pseudonyms:
    """Replaces private values in texts; one for each worker."""

    def __init__(self, key: bytes, back: bool = False):
        if not key:
            raise ValueError("a key is needed")
        self.key, self.back = key, back
        self.late_days: list[int] = []
        self.made: dict[tuple[str, int], Permutation] = {}

    def permute(self, kind: str, x: int, size: int) -> int:
        p = self.made.get((kind, size))
        if p is None:
            if len(self.made) > 10_000:
                self.made.clear()
            p = self.made[kind, size] = Permutation(self.key, kind, size)
        return p(x, self.back)

    def digits(self, kind: str, digits: str) -> str:
        return str(self.permute(kind, int(digits), 10 ** len(digits))).zfill(len(digits))

    def letters(self, kind: str, text: str, alphabets: tuple[str, ...], beyond: bool = False) -> str:
        """Permute the characters that are in an alphabet, as one number in mixed radix; beyond: letters beyond ASCII too, each in its block."""
        own = [next((a for a in alphabets if c in a), block(c) if beyond and c > "\x7f" and c.isalpha() else None) for c in text]
        x, size = 0, 1
        for c, a in zip(text, own, strict=True):
            if a:
                x, size = x * len(a) + a.index(c), size * len(a)
        x = self.permute(f"{kind}/{''.join('-' if a is None else str(alphabets.index(a)) if a in alphabets else a[0] for a in own)}", x, size)
        out = []
        for c, a in zip(reversed(text), reversed(own), strict=True):
            if a:
                x, d = divmod(x, len(a))
                c = a[d]
            out.append(c)
        return "".join(reversed(out))

    # Each of the following gives the pseudonym of a match, or None where the value is not valid; card and iban
    # perhaps that of the match's first groups only.

    def card(self, m: re.Match) -> str | None:
        # a number may stand before the card's own groups: these are looked at when the search comes to them
        return None if card_begins(m[0]) else leading(m[0], is_card, self.new_card)

    def new_card(self, shape: str) -> str:
        body = self.digits("card", re.sub(r"\D", "", shape)[:-1])
        return refill(shape, body + str(luhn(body)))

    def iban(self, m: re.Match) -> str | None:
        return leading(m[0], is_iban, self.new_iban)

    def new_iban(self, shape: str) -> str:
        plain = shape.replace(" ", "")
        body = self.letters("iban", plain[4:], ALPHABETS)
        check = 98 - int("".join(str(int(c, 36)) for c in body + plain[:2] + "00")) % 97
        more = iter(plain[:2] + f"{check:02d}" + body)
        return "".join(" " if c == " " else next(more) for c in shape)

    def phone(self, m: re.Match) -> str | None:
        d = re.sub(r"\D", "", m["phone_no"])
        return m[0][: m.start("phone_no") - m.start()] + refill(m["phone_no"], self.digits("phone", d))

    def social(self, m: re.Match) -> str | None:
        a, b, c = m[0].split("-")
        if a in ("000", "666") or a[0] == "9" or b == "00" or c == "0000":
            return None
        # number the valid ones: areas 001 to 899 but for 666, groups 01 to 99, serials 0001 to 9999
        area = int(a) - 1 - (int(a) > 666)
        x = self.permute("social", (area * 99 + int(b) - 1) * 9999 + int(c) - 1, 898 * 99 * 9999)
        x, serial = divmod(x, 9999)
        area, group = divmod(x, 99)
        return f"{area + 1 + (area >= 665):03d}-{group + 1:02d}-{serial + 1:04d}"

    def address(self, m: re.Match) -> str | None:
        parts = list(map(int, m[0].split(".")))
        if max(parts) > 255 or any(p != str(int(p)) for p in m[0].split(".")):
            return None
        x = self.permute("address", int.from_bytes(bytes(parts), "big"), 1 << 32)
        return ".".join(map(str, x.to_bytes(4, "big")))

    def date(self, m: re.Match) -> str | None:
        """A day from 1900 to 2099: year first, or else day first; month first only where the second number is above 12."""
        sep = m["date_sep"] or m["sep2"]
        x, y, z = m[0].split(sep)
        month_first = len(z) == 4 and int(y) > 12
        try:
            day = datetime.date(int(x), int(y), int(z)) if len(x) == 4 else datetime.date(int(z), int(x), int(y)) if month_first else datetime.date(int(z), int(y), int(x))
        except ValueError:
            return None
        if not 1900 <= day.year < 2100:
            return None
        if month_first:  # within the days that are read so: the 13th and later
            days = [d for d in range(DAYS) if datetime.date.fromordinal(FIRST_DAY + d).day > 12] if not self.late_days else self.late_days
            self.late_days = days
            new = datetime.date.fromordinal(FIRST_DAY + days[self.permute("late date", bisect.bisect_left(days, day.toordinal() - FIRST_DAY), len(days))])
            return f"{new.month:02d}{sep}{new.day:02d}{sep}{new.year:04d}"
        new = datetime.date.fromordinal(FIRST_DAY + self.permute("date", day.toordinal() - FIRST_DAY, DAYS))
        return f"{new.year:04d}{sep}{new.month:02d}{sep}{new.day:02d}" if len(x) == 4 else f"{new.day:02d}{sep}{new.month:02d}{sep}{new.year:04d}"

    def email(self, m: re.Match) -> str | None:
        local, host = m[0].rsplit("@", 1)
        return self.letters("email", local, ALPHABETS, beyond=True) + "@" + host

    def access_key(self, m: re.Match) -> str | None:
        return m[0][:4] + self.letters("access key", m[0][4:], ("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789",))

    def secret(self, m: re.Match) -> str | None:
        value = m["secret_value"]
        hexes = all(c in HEX for c in value)
        lead = m.start("secret_value") - m.start()
        new = self.letters("secret", value, (HEX,) if hexes else ALPHABETS)
        return m[0][:lead] + new + m[0][lead + len(value) :]

    def text(self, text: str) -> tuple[str, list[tuple[str, int, int]]]:
        """The text with pseudonyms, and (kind, first, end) of each in it."""
        out: list[str] = []
        found: list[tuple[str, int, int]] = []
        at = done = size = 0
        while m := PRIVATE.search(text, at):
            kind = next(k for k in KINDS if m[k] is not None)
            new = getattr(self, kind)(m)
            if new is None:  # not valid: something else may begin after its first character
                at = m.start() + 1
                continue
            out += [text[done : m.start()], new]
            size += m.start() - done
            found.append((kind, size, size + len(new)))
            size += len(new)
            at = done = m.start() + len(new) if kind in LEADING else m.end()
        return "".join([*out, text[done:]]), found


#: A text without any of these characters holds nothing private.
HINT = re.compile(r"[0-9@=:]")


def pseudonymise(docs: DataFrame, key: bytes, text_col: str = "text", back: bool = False) -> DataFrame:
    """Replace the private values of each text by pseudonyms; the other columns stay.

    Found are: e-mail addresses (the part before @), passwords and tokens that are assigned,
    access keys, IBANs, IPv4 addresses, dates, US social security numbers, North American
    telephone numbers and payment cards; numbers only where their check digits or ranges are
    valid, but telephone numbers by their form alone: ten digits in groups, whatever the digits
    (neither such without separators nor numbers of other countries).  Where a number stands before
    a card's usual groups, the card is told by them.  Of a card or IBAN with more groups behind it the longest valid part is taken, if not
    all of it is valid; there a value's pseudonym may be another than elsewhere, in about one of ten
    (cards) or a hundred (IBANs), and a private number in those groups may keep ``back`` from
    finding the value as often.  Adds ``private`` (array of kind, first and end character in the new text) in place
    of a column of that name.  With ``back`` pseudonyms become the values again.  Null stays
    null, with null ``private``; rows are looked at singly, so repeated rows get the same text.
    A secret with a single valid value of its kind stays as it is.
    """
    kept = [f for f in docs.schema if f.name not in (text_col, "private")]
    schema = T.StructType([*kept, *T.StructType.fromDDL(", ".join([f"`{text_col}` string", "private array<struct<kind:string,first:int,end:int>>"]))])
    shared = docs.sparkSession.sparkContext.broadcast((key, back))
    span = pa.list_(pa.struct([("kind", pa.string()), ("first", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = Pseudonyms(*shared.value)
        for batch in batches:
            texts, spans = [], []
            for x in batch.column(len(kept)):
                text = x.as_py()
                if text is None:
                    texts.append(None)
                    spans.append(None)
                    continue
                new, found = names.text(text) if HINT.search(text) else (text, [])
                texts.append(new)
                spans.append([dict(zip(("kind", "first", "end"), f, strict=True)) for f in found])
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(texts, pa.string()), pa.array(spans, span)], [*(f.name for f in kept), text_col, "private"])

    return docs.select(*(F.col(f"`{f.name}`") for f in kept), F.col(text_col).alias("__text")).mapInArrow(tidy(run), schema)
