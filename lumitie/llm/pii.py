"""Personal data: detection and surrogate generation.

A surrogate depends on a key and the entity alone, so an entity has the same one in every text.  It comes from
a keyed permutation of all values of the same format (a Feistel network over the mixed radix of
its characters), so different entities of a format get different surrogates.  Scripts, case, digits and
punctuation stay; card and bank numbers keep valid check digits; listed given names turn into
names of the same gender.  A check over the distinct entities of the corpus finds surrogates that two
entities share or that equal their entity (possible only across formats), and re-keys those.

Both passes over the texts are narrow; only distinct entities are shuffled.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lumitie.llm.batches import small_batches
from lumitie.sources.stage import Stage

KINDS = ("email", "ipv4", "ipv6", "iban", "ssn", "card", "phone", "name")
ROUNDS = 8
#: Entities whose surrogates had to be re-keyed, at most; they are sent to every task.
MAX_REKEYED = 100_000

# Titles by gender, and common given names and surnames.
MALE_TITLES = "Mr Mister Herr Herrn Monsieur Señor Sr Don Sir Lord"
FEMALE_TITLES = "Mrs Ms Miss Frau Madame Mme Mlle Señora Señorita Sra Srta Doña Lady"
OTHER_TITLES = "Dr Prof Professor"
MALE = ("Adam Albert Alexander Andreas Antonio Arthur Carlos Charles Christian Daniel David Diego Edward Eric Fernando "
        "Francisco Frank George Günther Hans Henry Jack James Jean Johann John Jorge José Juan Karl Klaus Louis Lucas Luis "
        "Manuel Marcel Martin Matthew Michael Michel Miguel Nicolas Oliver Oscar Otto Pablo Patrick Paul Pedro Peter Philippe "
        "Pierre Ricardo Richard Robert Samuel Stefan Thomas Tobias Walter William Wolfgang").split()
FEMALE = ("Alice Amélie Amy Ana Andrea Angela Anna Barbara Beatriz Camille Carmen Caroline Catherine Charlotte Chloé Claire "
          "Claudia Cristina Diana Elena Elisabeth Elizabeth Emily Emma Eva Françoise Gabriela Greta Hannah Heidi Helen Ingrid "
          "Isabel Jane Jeanne Jennifer Jessica Julia Karen Katharina Laura Lucía Maria Marie Mary María Monika Nicole Olivia "
          "Petra Rosa Sabine Sandra Sarah Sofía Sophie Susan Teresa Ursula Victoria").split()
SURNAMES = ("Anderson Bauer Becker Bernard Brown Clark Davis Dubois Durand Fernández Fischer Fournier García Girard González "
            "Gómez Harris Hernández Hoffmann Jackson Johnson Jones Klein Koch Laurent Lefebvre Leroy Lewis López Martínez Meyer "
            "Miller Moore Moreau Morel Müller Pérez Petit Richter Rivera Robinson Rodríguez Roux Ruiz Schmidt Schneider Schulz "
            "Simon Smith Sánchez Taylor Thompson Torres Vincent Wagner Walker Weber White Williams Wilson Wolf Young").split()
LISTS = {"m": MALE, "f": FEMALE, "s": SURNAMES}
# Characters that stand for each other; the first row is used for names alone.
NAME_CLASSES = ("aeiou", "bcdfghjklmnpqrstvwxyz", "AEIOU", "BCDFGHJKLMNPQRSTVWXYZ")
CLASSES = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
           "àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿßœ", "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞŒ",
           "абвгдежзийклмнопрстуфхцчшщъыьэюя", "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ",
           "αβγδεζηθικλμνξοπρστυφχψω", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ")
#: First and last character of other scripts whose letters stand for each other.
SCRIPT_RANGES = ((0x05D0, 0x05EA), (0x0621, 0x063A), (0x0905, 0x0939), (0x3041, 0x3093), (0x30A1, 0x30F3), (0x4E00, 0x9FFF), (0xAC00, 0xD7A3))

EMAIL = re.compile(r"(?<![\w.%+-])[\w.%+-]{1,64}@[\w-]{1,63}(?:\.[\w-]{1,63}){1,8}")
IPV4 = re.compile(r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?![\w]|\.\d)")
IPV6 = re.compile(r"[0-9A-Fa-f]{0,4}:[0-9A-Fa-f:]{2,38}(?![\w:])")
IBAN = re.compile(r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")
SSN = re.compile(r"\d{3}-\d{2}-\d{4}(?![\w-])")
CARD = re.compile(r"\d{13,19}(?![\w-])|\d{4}([ -])\d{4}\1\d{4}\1\d{1,7}(?![\w-])|\d{4}([ -])\d{6}\2\d{5}(?![\w-])")
PHONES = (re.compile(r"\+1[ .-]?\(?\d{3}\)?[ .-]?\d{3}[ .-]?\d{4}(?!\w)|\+\d{1,3}(?:[ .-]?\(?\d{2,4}\)?){2,5}(?!\w)"),
          re.compile(r"\(\d{2,5}\) ?\d{2,4}[ .-]?\d{2,5}(?![\w-])"), re.compile(r"\d{3}[ .-]\d{3}[ .-]\d{4}(?![\w-])"))
UPPER = "A-ZÀ-ÖØ-ÞĀĆČŁŚŠŻŽΑ-ΩЁА-Я"
TITLE = "|".join(f"{MALE_TITLES} {FEMALE_TITLES} {OTHER_TITLES}".split())
WORD = f"(?!(?:{TITLE})\\b)[{UPPER}][^\\W\\d_]+(?:[-'’][{UPPER}][^\\W\\d_]+)*"
TITLED = re.compile(rf"(?:({'|'.join(MALE_TITLES.split())})|({'|'.join(FEMALE_TITLES.split())})|({'|'.join(OTHER_TITLES.split())}))"
                    rf"\b\.?[  ]({WORD}(?:[  ]{WORD}){{0,2}})")
FULL_NAME = re.compile(rf"({'|'.join(MALE + FEMALE)})[  ]({WORD})")

_PLACE = {c: (chars, i) for chars in CLASSES for i, c in enumerate(chars)}
_NAME_PLACE = _PLACE | {c: (chars, i) for chars in NAME_CLASSES for i, c in enumerate(chars)}


def _place(char: str, table: dict) -> tuple[str | range, int] | None:
    """The characters that may stand for this one, and its place among them."""
    if (found := table.get(char)) is not None:
        return found
    for low, high in SCRIPT_RANGES:
        if low <= ord(char) <= high:
            return range(low, high + 1), ord(char) - low
    return None


class Surrogates:
    """Keyed surrogates; ``rekeyed`` maps (kind, value) to the number of the attempt that had no collision."""

    def __init__(self, key: bytes, rekeyed: dict[tuple[str, str], int] | None = None):
        self.key, self.rekeyed = hashlib.blake2b(key, digest_size=32).digest(), rekeyed or {}

    def _number(self, *parts: object) -> int:
        data = "\0".join(map(str, parts)).encode("utf-8", "surrogatepass")
        return int.from_bytes(hashlib.blake2b(data, key=self.key, digest_size=32).digest(), "big")

    def permute(self, digits: list[int], radices: list[int], tweak: str) -> list[int]:
        """A keyed permutation of all digit sequences with these radices."""
        half = len(digits) // 2
        sides, sizes = [0, 0], [1, 1]
        for i, (d, r) in enumerate(zip(digits, radices)):
            sides[i >= half] = sides[i >= half] * r + d
            sizes[i >= half] *= r
        for turn in range(ROUNDS):
            at = turn % 2
            # several blocks of pseudo-random bits where a side is longer than one
            blocks = -(-sizes[at].bit_length() // 192)
            noise = sum(self._number(tweak, radices, turn, sides[1 - at], b) << (192 * b) for b in range(blocks))
            sides[at] = (sides[at] + noise) % sizes[at]
        out = []
        for i in range(len(digits) - 1, -1, -1):
            sides[i >= half], d = divmod(sides[i >= half], radices[i])
            out.append(d)
        return out[::-1]

    def text(self, value: str, tweak: str, table: dict = _PLACE) -> str:
        """Every letter and digit replaced by one of its class; the rest stays."""
        places = [_place(c, table) for c in value]
        new = iter(self.permute([p[1] for p in places if p], [len(p[0]) for p in places if p],
                                tweak + "".join("*" if p else c for p, c in zip(places, value))))
        out = []
        for p, c in zip(places, value):
            x = p[0][next(new)] if p else c
            out.append(chr(x) if isinstance(x, int) else x)
        return "".join(out)

    def digits(self, value: str, tweak: str) -> str:
        return "".join(map(str, self.permute([int(c) for c in value], [10] * len(value), tweak)))

    def _refill(self, value: str, digits: str) -> str:
        new = iter(digits)
        return "".join(next(new) if c.isdecimal() else c for c in value)

    def name_part(self, value: str, listed: str, tweak: str) -> str:
        """A listed name turns into another of the same list, others keep vowels, consonants and case."""
        names = LISTS.get(listed, ())
        where = {n.casefold(): i for i, n in enumerate(names)}
        at = where.get(value.casefold())
        if at is None:
            return self.text(value, "name" + tweak, _NAME_PLACE)
        new = names[self.permute([at], [len(names)], "list" + listed + tweak)[0]]
        return new.upper() if value.isupper() and len(value) > 1 else new

    def surrogate(self, kind: str, value: str) -> str:
        attempt = self.rekeyed.get((kind, value), 0)
        tweak = f"{kind}{attempt}" if attempt else kind
        digits = "".join(c for c in value if c.isdecimal())
        if kind == "email":
            local, _, domain = value.rpartition("@")
            site, _, top = domain.rpartition(".")
            return f"{self.text(local, tweak)}@{self.text(site, tweak + 'site')}.{top}"
        if kind == "ipv4":
            return ".".join(map(str, self.permute([int(x) for x in value.split(".")], [256] * 4, tweak)))
        if kind == "ipv6":
            whole = ipaddress.IPv6Address(value).packed
            new = bytes(self.permute(list(whole), [256] * 16, tweak))
            return ipaddress.IPv6Address(new).exploded if len(value) > 36 else str(ipaddress.IPv6Address(new))
        if kind == "iban":
            plain = value.replace(" ", "")
            body = self.text(plain[4:], tweak + plain[:2])
            new = iter(plain[:2] + f"{98 - _mod97(body + plain[:2] + '00'):02d}" + body)
            return "".join(next(new) if c != " " else c for c in value)
        if kind == "ssn":
            return self._refill(value, self.digits(digits, tweak))
        if kind == "card":
            body = digits[0] + self.digits(digits[1:-1], tweak + digits[0])
            return self._refill(value, body + _luhn_digit(body))
        if kind == "phone":
            # the same number has the same digits in every format
            country = re.match(r"\+(\d{1,3})(?=[ .(-])", value)
            kept = country[1] if country else ""
            return self._refill(value, kept + self.digits(digits[len(kept):], tweak + kept))
        gender, _, words = value.partition(":")
        parts = re.split(r"([  ])", words)
        names = [i for i, p in enumerate(parts) if p.strip()]
        for i in names:
            first = i == names[0] and len(names) > 1
            kinds = [gender] if first else ["s"]
            parts[i] = self.name_part(parts[i], next((k for k in kinds if k in LISTS), "s"), str(attempt or ""))
        return f"{gender}:{''.join(parts)}"


def _mod97(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text)) % 97


def _luhn_digit(body: str) -> str:
    total = sum(sum(divmod(int(c) * (2 - i % 2), 10)) for i, c in enumerate(reversed(body)))
    return str(-total % 10)


def _free(text: str, at: int, more: str = "") -> bool:
    """Nothing before a match that it would be a part of."""
    return at == 0 or not (text[at - 1].isalnum() or text[at - 1] in "_" + more)


def _gender(word: str) -> str:
    folded = word.casefold()
    for gender in "mf":
        if any(n.casefold() == folded for n in LISTS[gender]):
            return gender
    return "u"


def detect(text: str) -> list[tuple[int, int, str, str]]:
    """Start, end, kind and value of the entities of a text, none overlapping, by start.

    Where two overlap the kind that comes first in KINDS stands.  The value of a name is its gender
    (m, f or u), a colon and the words.
    """
    found: list[tuple[int, int, str, str]] = []
    if "@" in text:
        found += [(m.start(), m.end(), "email", m[0]) for m in EMAIL.finditer(text)]
    for m in IPV4.finditer(text):
        if _free(text, m.start(), ".") and all(int(x) < 256 for x in m[0].split(".")):
            found.append((m.start(), m.end(), "ipv4", m[0]))
    if text.count(":") > 1:
        for m in IPV6.finditer(text):
            if _free(text, m.start(), ":") and m[0].count(":") > 1:
                try:
                    ipaddress.IPv6Address(m[0])
                except ValueError:
                    continue
                found.append((m.start(), m.end(), "ipv6", m[0]))
    for m in IBAN.finditer(text):
        plain = m[0].replace(" ", "")
        if _free(text, m.start()) and 15 <= len(plain) <= 34 and _mod97(plain[4:] + plain[:4]) == 1:
            found.append((m.start(), m.end(), "iban", m[0]))
    found += [(m.start(), m.end(), "ssn", m[0]) for m in SSN.finditer(text) if m[0].isascii() and _free(text, m.start(), "-")]
    for m in CARD.finditer(text):
        digits = "".join(c for c in m[0] if c.isdecimal())
        if _free(text, m.start(), ".-+") and digits.isascii() and digits[0] in "3456" and _luhn_digit(digits[:-1]) == digits[-1]:
            found.append((m.start(), m.end(), "card", m[0]))
    for pattern in PHONES:
        for m in pattern.finditer(text):
            if m[0].isascii() and _free(text, m.start(), ".-+") and 7 <= sum(map(str.isdecimal, m[0])) <= 15:
                found.append((m.start(), m.end(), "phone", m[0]))
    words: dict[str, str] = {}
    for m in TITLED.finditer(text):
        if _free(text, m.start()):
            gender = "m" if m[1] else "f" if m[2] else _gender(re.split("[  ]", m[4])[0])
            found.append((m.start(4), m.end(4), "name", f"{gender}:{m[4]}"))
            words.setdefault(re.split("[  ]", m[4])[-1], gender)
    for m in FULL_NAME.finditer(text):
        if _free(text, m.start()):
            found.append((m.start(), m.end(), "name", f"{_gender(m[1])}:{m[0]}"))
            words.setdefault(m[2], _gender(m[1]))
    if words:  # a surname by itself refers to the person named in full or with a title
        alone = re.compile(rf"\b(?:{'|'.join(map(re.escape, sorted(words, key=len, reverse=True)))})\b")
        found += [(m.start(), m.end(), "name", f"{words[m[0]]}:{m[0]}") for m in alone.finditer(text) if len(m[0]) > 2]
    order = {k: i for i, k in enumerate(KINDS)}
    out: list[tuple[int, int, str, str]] = []
    taken: list[tuple[int, int]] = []
    import bisect

    for span in sorted(found, key=lambda s: (order[s[2]], s[0], -s[1])):
        k = bisect.bisect_left(taken, (span[0], span[1]))
        if (k == 0 or taken[k - 1][1] <= span[0]) and (k == len(taken) or taken[k][0] >= span[1]):
            taken.insert(k, (span[0], span[1]))
            out.append(span)
    return sorted(out)


def replace(text: str, keyed: Surrogates) -> tuple[str, list[tuple[str, str, str]]]:
    """The text with surrogates, and kind, value and surrogate of each entity."""
    parts, used, at = [], [], 0
    for start, end, kind, value in detect(text):
        new = keyed.surrogate(kind, value)
        parts += [text[at:start], new.partition(":")[2] if kind == "name" else new]
        used.append((kind, value, new))
        at = end
    return ("".join([*parts, text[at:]]), used) if used else (text, used)


def entities(docs: DataFrame, keyed: Surrogates, text: str = "text") -> DataFrame:
    """Distinct kind, value, surrogate of the entities in all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                some = {e for t in batch.column(0).slice(at, 512).to_pylist() if t for e in replace(t, keyed)[1]}
                if some:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*sorted(some))], ["kind", "value", "surrogate"])

    return docs.select(F.col(text).alias("t")).mapInArrow(run, "kind string, value string, surrogate string").distinct()


def collisions(found: DataFrame) -> DataFrame:
    """Kind and value of entities that must be re-keyed: all but the smallest that share a surrogate, and those equal to it."""
    counted = found.groupBy("kind", "surrogate").agg(F.min("value").alias("_first"), F.count(F.lit(1)).alias("_n"))
    shared = counted.where("_n > 1").join(found, ["kind", "surrogate"]).where(F.col("value") != F.col("_first")).select("kind", "value")
    return shared.unionByName(found.where(F.col("value") == F.col("surrogate")).select("kind", "value")).distinct()


def settled(docs: DataFrame, key: bytes, stage: Stage, text: str = "text") -> Surrogates:
    """Surrogates without collisions over the corpus."""
    small_batches(docs.sparkSession)
    keyed = Surrogates(key)
    found = stage.write(entities(docs, keyed, text), "entities")
    while True:
        again = [(r["kind"], r["value"]) for r in collisions(found).limit(MAX_REKEYED + 1).collect()]
        if not again:
            return keyed
        if len(again) + len(keyed.rekeyed) > MAX_REKEYED:
            raise ValueError(f"more than {MAX_REKEYED} collisions")
        keyed.rekeyed.update({e: keyed.rekeyed.get(e, 0) + 1 for e in again})
        changed = found.sparkSession.createDataFrame([(*e, keyed.surrogate(*e)) for e in again], "kind string, value string, _new string")
        found = stage.write(found.join(changed, ["kind", "value"], "left").select(
            "kind", "value", F.coalesce("_new", "surrogate").alias("surrogate")), "entities")


def pseudonymise(docs: DataFrame, key: bytes, stage: Stage, text: str = "text") -> DataFrame:
    """``docs`` with surrogates in ``text``, and new columns n_entities and entities (``kind:count``, by kind).

    A null text stays null, an empty one empty; other columns stay as they are, but for earlier
    ones of those two names.  Every row stands for itself.
    """
    shared = docs.sparkSession.sparkContext.broadcast(settled(docs, key, stage, text))  # MAX_REKEYED entries at most
    kept = [c for c in docs.columns if c not in ("n_entities", "entities")]
    where = kept.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                piece = batch.slice(at, 512)
                done = [(None, []) if t is None else replace(t, shared.value) for t in piece.column(where).to_pylist()]
                counts = [",".join(f"{k}:{n}" for k in KINDS if (n := sum(e[0] == k for e in used))) for _, used in done]
                columns = [pa.array([d[0] for d in done], pa.string()) if i == where else c for i, c in enumerate(piece.columns)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([len(d[1]) for d in done], pa.int32()), pa.array(counts, pa.string())],
                                                 [*kept, "n_entities", "entities"])

    part = docs.select(*kept)
    return part.mapInArrow(run, StructType(list(part.schema.fields)).add("n_entities", "integer").add("entities", "string"))
