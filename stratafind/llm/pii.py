"""PII: format-preserving Feistel pseudonyms of validated numbers, dates and addresses."""

from __future__ import annotations

import hashlib
import os
import re
import unicodedata
from datetime import date, timedelta
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import LongType, StructField, StructType

from .common import bounded_batches, chunks, release, shared_root

KINDS = ("email", "card", "iban", "phone", "ip", "ssn", "date")
ROUNDS = 8
FIRST_DAY, DAYS = date(1900, 1, 1), (date(2100, 1, 1) - date(1900, 1, 1)).days

#: Letters of an e-mail's local part that are permuted together.
LOCAL_BLOCK = 64
# Country codes of telephone numbers that have one or two digits (all others have three), and
# the length of an IBAN by country.
_ONE_DIGIT, _TWO_DIGITS = "17", "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()
_IBAN_LENGTHS = dict(
    x.split(":")
    for x in (
        "AD:24 AE:23 AL:28 AT:20 AZ:28 BA:20 BE:16 BG:22 BH:22 BR:29 BY:28 CH:21 CR:22 CY:28 CZ:24 DE:22 DK:18 DO:28 EE:20 EG:29 ES:24 FI:18 FO:18 FR:27 GB:22 GE:22 "
        "GI:23 GL:18 GR:27 GT:28 HR:21 HU:28 IE:22 IL:23 IQ:23 IS:26 IT:27 JO:30 KW:30 KZ:20 LB:28 LC:32 LI:21 LT:20 LU:20 LV:21 LY:25 MC:27 MD:24 ME:22 MK:19 MR:27 "
        "MT:31 MU:30 NL:18 NO:15 PK:24 PL:28 PS:29 PT:25 QA:29 RO:24 RS:22 SA:24 SC:31 SD:18 SE:24 SI:19 SK:24 SM:27 ST:25 SV:28 TL:23 TN:24 TR:26 UA:29 VA:22 VG:24 XK:20"
    ).split()
)

_EMAIL = re.compile(r"(?<![\w.%+-])([\w.%+-]+)(@(?:[\w-]{1,63}\.)+[A-Za-z]{2,24})(?![\w-])")
#: Numbers by layout. A card or an IBAN may end at any group, so theirs are listed by length.
_LAYOUTS = {
    "phone": [r"\+\d{1,3}[ .-]?(?:\(\d{2,4}\)|\d{2,4})[ .-]?\d{3,4}[ .-]?\d{3,4}", r"\+\d{1,3}[ .-]\d{1,2}(?:[ .-]\d{2}){3,5}", r"\+\d{8,15}", r"\(\d{3}\) ?\d{3}[ .-]\d{4}"],
    "ymd": [r"\d{4}(?:-\d{2}-|/\d{2}/|\.\d{2}\.)\d{2}"],
    "dmy": [r"\d{1,2}(?:-\d{1,2}-|/\d{1,2}/|\.\d{1,2}\.)\d{4}"],
    "ip": [r"\d{1,3}(?:\.\d{1,3}){3}"],
    "ssn": [r"\d{3}-\d{2}-\d{4}"],
    "card": [rf"\d(?:[ -]?\d){{{n - 1}}}" for n in range(19, 12, -1)],
    "iban": [rf"[{c}]{{2}}\d{{2}}(?: ?[{c}0-9]{{4}}){{{n // 4}}}" + (rf" ?[{c}0-9]{{{n % 4}}}" if n % 4 else "") for c in ("A-Z", "a-z") for n in range(30, 10, -1)],
}
_USUAL_CARD = [r"\d{4}(?:(?: \d{4}){3}|(?:-\d{4}){3})", r"\d{4}(?: \d{6} |-\d{6}-)\d{5}", r"\d{13,19}"]
_IBAN = "|".join(rf"[{c}]{{2}}\d{{2}}(?: ?[{c}0-9]{{4}}){{2,7}}(?: ?[{c}0-9]{{1,3}})?" for c in ("A-Z", "a-z"))
_REST = {k: v for k, v in _LAYOUTS.items() if k != "iban"}
_ANY = "|".join([*[p for k, v in _REST.items() if k != "card" for p in v], r"\d(?:[ -]?\d){12,18}"])


def _pass(before: str, after: str, places: str, layouts: dict) -> tuple:
    """A pattern of places with a candidate, and every layout that may be valid there."""
    ends = {"ymd": rf"(?:(?=T\d\d:?\d\d)|{after})"}  # a time may follow a date
    stamp = f"|{layouts['ymd'][0]}{ends['ymd']}" if "ymd" in layouts else ""
    return re.compile(f"{before}(?:(?:{places}){after}{stamp})"), [(k, re.compile(p + ends.get(k, after))) for k, ps in layouts.items() for p in ps]


#: What one pass leaves goes to the next: IBANs, cards as they are printed, numbers that stand
#: by themselves, numbers that a mark (but a decimal point) joins to other digits.
_PASSES = [
    _pass(r"(?<!\w)", r"(?!\w)", _IBAN, {"iban": _LAYOUTS["iban"]}),
    _pass(r"(?<![\w+])(?<!\d\.)", r"(?!\w|\.\d)", "|".join(_USUAL_CARD), {"card": _USUAL_CARD}),
    _pass(r"(?<!\w)(?<!\d[./-])", r"(?!\w|[./-]\d)", _ANY, _REST),
    _pass(r"(?<!\w)(?<!\d\.)", r"(?!\w|\.\d)", _ANY, _REST),
]
_DIGIT = re.compile(r"\d")
_ALPHABETS = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "".join(map(chr, [*range(0xDF, 0xF7), *range(0xF8, 0x100)])), "".join(map(chr, [*range(0xC0, 0xD7), *range(0xD8, 0xDF)]))]
_CLASS = {c: (i, a) for a in _ALPHABETS for i, c in enumerate(a)}


@lru_cache(maxsize=1 << 16)
def _alphabet(c: str) -> tuple[int, str, str] | None:
    """(place, alphabet, its name) of a letter or digit: others than Latin ones share it with their kind among 128 neighbours."""
    if c in _CLASS:
        at, alphabet = _CLASS[c]
        return at, alphabet, str(_ALPHABETS.index(alphabet))
    if not c.isalnum():
        return None
    first, kind = ord(c) & ~127, unicodedata.category(c)
    alphabet = "".join(x for x in map(chr, range(first, first + 128)) if x not in _CLASS and x.isalnum() and unicodedata.category(x) == kind)
    return alphabet.index(c), alphabet, f"{first:x}{kind}"


class Pseudonyms:
    """Keyed permutations: one of every domain (kind and size), by a Feistel network.

    The network runs on an even number of bits; values beyond the domain walk on through it
    until they fall inside, so each domain is permuted and equal values stay equal everywhere.
    """

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def permute(self, kind: str, value: int, size: int) -> int:
        if size < 2:
            return value
        half = max(1, ((size - 1).bit_length() + 1) // 2)
        width, mask = (half + 7) // 8, (1 << half) - 1
        tag = hashlib.blake2b(f"{kind}:{size}".encode(), digest_size=8, key=self.key).digest()
        while True:
            left, right = value >> half, value & mask
            for turn in range(ROUNDS):
                drawn = hashlib.blake2b(bytes([turn]) + tag + right.to_bytes(width, "big"), digest_size=min(64, width + 1), key=self.key).digest()
                left, right = right, left ^ (int.from_bytes(drawn, "big") & mask)
            value = left << half | right
            if value < size:
                return value

    def letters(self, kind: str, text: str) -> str:
        """Permutes the letters and digits of text within their classes; the rest stays."""
        value, size, classes = 0, 1, [_alphabet(c) for c in text]
        for found in classes:
            if found:
                value, size = value * len(found[1]) + found[0], size * len(found[1])
        value, out = self.permute(kind + ":" + "".join(found[2] if found else "-" for found in classes), value, size), []
        for c, found in zip(reversed(text), reversed(classes)):
            if found:
                value, at = divmod(value, len(found[1]))
                c = found[1][at]
            out.append(c)
        return "".join(reversed(out))

    def local(self, text: str) -> str:
        """The pseudonym of an e-mail's local part: its letters are permuted in lower case, a block after the
        other, and shown in the case that was found, as mail hardly ever tells cases apart."""
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        new = "".join(self.letters(f"email{at}", low[at : at + LOCAL_BLOCK]) for at in range(0, len(low), LOCAL_BLOCK))
        return "".join(c.upper() if old != before and len(c.upper()) == 1 else c for c, old, before in zip(new, text, low))

    def number(self, kind: str, text: str) -> str | None:
        """The pseudonym of a candidate, or None where it is not valid."""
        digits = re.sub(r"\D", "", text)
        if kind == "card":
            if not luhn(digits):
                return None
            body = str(self.permute(f"card{len(digits)}", int(digits[:-1]), 10 ** (len(digits) - 1))).zfill(len(digits) - 1)
            check = next(d for d in "0123456789" if luhn(body + d))
            return _filled(text, body + check)
        if kind == "phone":
            # without + it is one of the numbering plan of country code 1; the digits alone make the key
            country = "1" if text[0] != "+" else digits[: 1 if digits[0] in _ONE_DIGIT else 2 if digits[:2] in _TWO_DIGITS else 3]
            own = digits[len(country) :] if text[0] == "+" else digits
            if not 4 <= len(own) <= 14:
                return None
            new = str(self.permute(f"phone{country}:{len(own)}", int(own), 10 ** len(own))).zfill(len(own))
            return _filled(text, country + new if text[0] == "+" else new)
        if kind == "ip":
            parts = text.split(".")
            if any(int(x) > 255 or (len(x) > 1 and x[0] == "0") for x in parts):
                return None
            value = self.permute("ip", int.from_bytes(bytes(map(int, parts)), "big"), 1 << 32)
            return ".".join(map(str, value.to_bytes(4, "big")))
        if kind == "ssn":
            area, group, serial = map(int, text.split("-"))
            if area in (0, 666) or area > 899 or not group or not serial:
                return None
            rank = (area - 1 - (area > 666)) * 99 * 9999 + (group - 1) * 9999 + serial - 1
            rank, serial = divmod(self.permute("ssn", rank, 898 * 99 * 9999), 9999)
            area, group = divmod(rank, 99)
            return f"{area + 1 + (area + 1 >= 666):03d}-{group + 1:02d}-{serial + 1:04d}"
        if kind == "iban":
            plain = text.replace(" ", "").upper()
            if not 15 <= len(plain) <= 34 or _mod97(plain) != 1:
                return None
            # small letters are those of words too: there the length has to be that of the country
            small = text[:2].islower()
            if small and _IBAN_LENGTHS.get(plain[:2]) != str(len(plain)):
                return None
            body = self.letters("iban" + plain[:2], plain[4:])
            new = _filled(text, plain[:2] + f"{98 - _mod97(plain[:2] + '00' + body):02d}" + body)
            return new.lower() if small else new
        parts = re.split(r"[-/.]", text)
        # the places of year, month and day: a date that is not day-first may be month-first
        for order in [(0, 1, 2)] if kind == "ymd" else [(2, 1, 0), (2, 0, 1)]:
            try:
                day = date(*(int(parts[i]) for i in order))
            except ValueError:
                continue
            if not 0 <= (day - FIRST_DAY).days < DAYS:
                return None
            new = FIRST_DAY + timedelta(days=self.permute("date", (day - FIRST_DAY).days, DAYS))
            shown = dict(zip(order, (f"{new.year}", f"{new.month:02d}", f"{new.day:02d}")))
            return re.search(r"[-/.]", text).group().join(shown[i] for i in range(3))
        return None

    def text(self, text: str, counts: dict | None = None) -> str:
        """text with every validated value replaced by its pseudonym."""
        counts = {} if counts is None else counts

        def email(m):
            counts["email"] = counts.get("email", 0) + 1
            return self.local(m.group(1)) + m.group(2)

        if _DIGIT.search(text):
            text = self._numbers(text, counts)
        if "@" in text:
            text = _EMAIL.sub(email, text)
        return text

    def _numbers(self, text: str, counts: dict) -> str:
        """text with its valid numbers replaced, a pass after the other over what is left.

        Where no layout at a place is valid the search goes on one character later, so a number
        is found behind and before other digits.
        """
        taken: list[tuple[int, int, str]] = []
        for places, layouts in _PASSES:
            found, ends = [], [(a, b) for a, b, _ in taken] + [(len(text), len(text))]
            at = 0
            for stop, after in ends:
                while m := places.search(text, at, stop):
                    at = m.start() + 1
                    for kind, layout in layouts:
                        if (c := layout.match(text, m.start(), stop)) and (new := self.number(kind, c.group())) is not None:
                            name = "date" if kind in ("ymd", "dmy") else kind
                            counts[name] = counts.get(name, 0) + 1
                            found.append((m.start(), c.end(), new))
                            at = c.end()
                            break
                at = after
            taken = sorted(taken + found) if found else taken
        out, at = [], 0
        for a, b, new in taken:
            out += text[at:a], new
            at = b
        return "".join([*out, text[at:]]) if taken else text


#: Digits as themselves and as the digit sums of their doubles, as bytes.
_ONCE, _TWICE = (bytes.maketrans(b"0123456789", bytes(sum(divmod(f * d, 10)) for d in range(10))) for f in (1, 2))


def luhn(digits: str) -> bool:
    raw = (digits if digits.isascii() else "".join(str(int(d)) for d in digits)).encode()
    return (sum(raw[-1::-2].translate(_ONCE)) + sum(raw[-2::-2].translate(_TWICE))) % 10 == 0


def _mod97(iban: str) -> int:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def _filled(form: str, chars: str) -> str:
    """chars at the places of form's letters and digits."""
    it = iter(chars)
    return "".join(next(it) if c.isalnum() else c for c in form)


def pseudonym_key(spark: SparkSession) -> bytes:
    """The secret key: spark.stratafind.pseudonym.key of the session, else one that is drawn once and kept in
    the shared folder for its owner alone, so that all runs that share the folder link the same values."""
    given = spark.conf.get("spark.stratafind.pseudonym.key", None)
    if given:
        return given.encode()
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_root(spark)}/pseudonym-key")
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(path):
        drawn = jvm.org.apache.hadoop.fs.Path(f"{shared_root(spark)}/.pseudonym-key-{os.urandom(8).hex()}")
        out = files.create(drawn, False)
        out.write(bytearray(os.urandom(32).hex().encode()))
        out.close()
        files.setPermission(drawn, jvm.org.apache.hadoop.fs.permission.FsPermission("600"))
        if files.exists(path) or not files.rename(drawn, path):  # another run was faster
            files.delete(drawn, False)
    source = files.open(path)
    try:
        return bytes(source.readNBytes(1024))
    finally:
        source.close()


def pseudonymise(docs: DataFrame, key: bytes | None = None, counted: bool = True) -> DataFrame:
    """docs with pseudonyms in text, and, if counted, n_<kind> counts of what was replaced. Without a key, pseudonym_key() has it.

    Validated are: card numbers (13 to 19 digits, Luhn; the check digit is made anew), IBANs
    (mod 97, made anew; in small letters only of the country's length), IPv4 addresses, phone
    numbers (+, country code and 2-4, 3-4 and 3-4 digits, pairs as in +33 6 12 34 56 78, or
    digits alone; without + as (017) 555-7713, of country code 1), national numbers of the form 3-2-4,
    dates from 1900 to 2099 (permuted among those days, same layout: year-month-day, also before
    a time T00:00, day-month-year, else month-day-year; joined by -, / or .), and the local part
    of e-mail addresses (letters and digits of any script, of any length, without regard to case). A
    pseudonym is again valid in its format and has the layout of what it replaces. Equal values
    have equal pseudonyms in all documents, whatever the separators, the layout of a date or the
    case; invalid numbers stay. A valid number next to other
    digits or words, behind or before a blank, - or /, is replaced too: IBANs first, then
    cards of 4-4-4-4, 4-6-5 or one group, then the first from the left and its longest form.
    Digits next to a decimal point and more digits are no number.

    A null text stays null with counts 0, an empty one stays empty, a very long one is read
    whole. Every row is its own: repeated rows (which get equal texts), null ids and an empty
    table need nothing special. Other columns pass
    through; columns named n_<kind> are replaced if those are counted. No shuffle; memory is one batch.
    """
    bounded_batches(docs.sparkSession)
    key = key or pseudonym_key(docs.sparkSession)
    added = [f"n_{k}" for k in KINDS] if counted else []
    base = docs.drop(*added)
    schema = StructType([*base.schema.fields, *[StructField(c, LongType()) for c in added]])
    names = base.columns
    at = names.index("text")

    def run(batches):
        own = Pseudonyms(key)
        for batch in batches:
            for a, b, texts in chunks(batch.column(at)):
                out, counts = [], {k: [] for k in KINDS}
                for text in texts:
                    got: dict[str, int] = {}
                    out.append(own.text(text, got) if text else text)
                    for k in KINDS:
                        counts[k].append(got.get(k, 0))
                arrays = [pa.array(out, pa.string()) if i == at else c.slice(a, b - a) for i, c in enumerate(batch.columns)]
                yield pa.RecordBatch.from_arrays([*arrays, *[pa.array(counts[c[2:]], pa.int64()) for c in added]], names=[*names, *added])
        release()

    return base.mapInArrow(run, schema)
