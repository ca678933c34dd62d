"""Personal data replaced by keyed surrogates.

Detected e-mail addresses, telephone numbers, card numbers, bank account numbers, IPv4 addresses, social security numbers
and personal names get surrogates of their type, script, gender and format, drawn by HMAC-SHA-256 from a secret key.  One
original has one surrogate wherever it occurs, in whatever spelling of the same value; two originals never share one, and
no surrogate is itself an original: those that would are drawn again until none is left.
"""

from __future__ import annotations

import hmac
import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as tx
from ._scratch import store

# Titles by the gender they tell, and given names that introduce a full name.
TITLES = {
    "m": ["Mr", "Mister", "Sir", "Lord", "Herr", "Señor", "Sr", "Don", "Monsieur", "Господин", "Κύριος"],
    "f": ["Mrs", "Ms", "Miss", "Madam", "Lady", "Frau", "Señora", "Sra", "Señorita", "Doña", "Madame", "Mme", "Mlle", "Госпожа", "Κυρία"],
    "x": ["Dr", "Prof", "Professor", "Doktor", "Doctor", "Docteur"],
}
GIVEN = {
    "m": ["James", "John", "Robert", "Michael", "William", "David", "Richard", "Joseph", "Thomas", "Daniel", "Hans", "Jürgen", "Wolfgang", "Stefan", "Carlos", "José", "Javier", "Pierre", "Jean", "François"],
    "f": ["Mary", "Patricia", "Jennifer", "Linda", "Elizabeth", "Barbara", "Susan", "Jessica", "Sarah", "Karen", "Ursula", "Heike", "Sabine", "Carmen", "Lucía", "Pilar", "Marie", "Claire", "Sophie", "Chloé"],
}
# Consonants, vowels and endings from which names of a script are drawn.
SOUNDS = {
    "latin": ("bdfglmnprstv", "aeiou", {"m": ["n", "r", "s", "k"], "f": ["a", "ia", "ina"], "x": ["en", "el", "is"], "s": ["son", "man", "ler", "ard", "ez"]}),
    "cyrillic": ("бвгдлмнпрст", "аеио", {"m": ["н", "р", "й"], "f": ["а", "ия", "ина"], "x": ["ен", "ел"], "s": ["ов", "ин", "ский", "ова", "ина", "ская"]}),
    "greek": ("βγδλμνπρστ", "αειο", {"m": ["ος", "ης"], "f": ["α", "η"], "x": ["ων", "ις"], "s": ["ου", "ιδης", "ακης"]}),
}
_NAME = r"[^\W\d_a-zа-яα-ω][^\W\d_]+(?:[-'’][^\W\d_]+)?"
_PATTERNS = (
    ("email", re.compile(r"(?<![\w.+-])[A-Za-z0-9][\w.+-]{0,63}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63})*\.[A-Za-z]{2,24}(?![\w-])", re.ASCII)),
    ("iban", re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")),
    ("ip", re.compile(r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?![\d.]*\d)")),
    ("card", re.compile(r"(?<![\w.-])\d(?:[ -]?\d){12,18}(?![\w-])")),
    ("ssn", re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])")),
    ("phone", re.compile(r"(?<![\w.+-])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])\d{3,4}[ .-]?\d{2,4}(?:[ .-]?\d{2,4})?(?![\w-])|(?<![\w.+-])\+\d{8,14}(?!\w)")),
)
_TITLED = re.compile(rf"(?<!\w)({'|'.join(sorted((t for x in TITLES.values() for t in x), key=len, reverse=True))})(?:\.\s?|\s)({_NAME}(?: {_NAME}){{0,2}})")
_GIVEN = re.compile(rf"(?<!\w)({'|'.join(sorted((t for x in GIVEN.values() for t in x), key=len, reverse=True))})((?: {_NAME}){{1,2}})")
_GENDER = {t: g for table in (TITLES, GIVEN) for g, names in table.items() for t in names}
#: What any entity holds; texts without it are not looked at further.  For Java, where only (?U) makes \d that of Python.
MAYBE = rf"(?U)@|\d|\b(?:{'|'.join(sorted(_GENDER, key=len, reverse=True))})\b"


def _digits(s: str) -> str:
    return re.sub(r"\D", "", s)


def _luhn(digits: str) -> int:
    """The sum that is 0 for a valid card number."""
    return sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10


def _script(word: str) -> str:
    name = unicodedata.name(word[0], "")
    return "cyrillic" if name.startswith("CYRILLIC") else "greek" if name.startswith("GREEK") else "latin"


def detect(text: str) -> list[tuple[int, int, str, str]]:
    """Entities (start, end, kind, value), in order, without overlaps; an earlier kind of ``_PATTERNS`` goes first.

    ``value`` is the same for all spellings: digits alone, lower case.  A name gives one entity for each of its words, so
    that a surname alone refers to the same person's; the kind tells given name (by gender) or surname.
    """
    found: list[tuple[int, int, str, str]] = []
    starts: list[int] = []  # of what is taken, in order, and the ends
    ends: list[int] = []

    def add(a: int, b: int, kind: str, value: str) -> None:
        i = bisect_left(ends, a + 1)  # the first that ends beyond a
        if i == len(starts) or b <= starts[i]:
            found.append((a, b, kind, value))
            starts.insert(i, a)
            ends.insert(i, b)

    for kind, pattern in _PATTERNS:
        for m in pattern.finditer(text):
            s = m[0]
            if kind == "email":
                add(*m.span(), kind, s.lower())
            elif kind == "iban":
                flat = s.replace(" ", "")
                if 15 <= len(flat) <= 34 and int("".join(str(int(c, 36)) for c in flat[4:] + flat[:4])) % 97 == 1:
                    add(*m.span(), kind, flat)
            elif kind == "ip":
                if all(int(x) < 256 for x in s.split(".")):
                    add(*m.span(), kind, ".".join(str(int(x)) for x in s.split(".")))
            elif kind == "card":
                if _luhn(_digits(s)) == 0 or s.isdigit() and len(s) in (15, 16):
                    add(*m.span(), kind, _digits(s))
            elif kind == "ssn":
                add(*m.span(), kind, _digits(s))
            elif 7 <= len(d := _digits(s)) <= 15:
                add(*m.span(), kind, d[1:] if len(d) == 11 and d[0] == "1" else d)
    for pattern in (_TITLED, _GIVEN):
        for m in pattern.finditer(text):
            words = [(w.start() + m.start(2), w[0]) for w in re.finditer(_NAME, m[2])]
            if pattern is _GIVEN:
                words.insert(0, (m.start(1), m[1]))
            gender = _GENDER[m[1]]
            for i, (at, w) in enumerate(words):
                given = i < len(words) - 1
                of = _GENDER.get(w, gender) if given else "s"
                add(at, at + len(w), f"name_{of}_{_script(w)}", w.casefold())
    return sorted(found)


class _Stream:
    """Keyed numbers: the same for the same key, kind, value and attempt."""

    def __init__(self, key: bytes, kind: str, value: str, attempt: int):
        self.key, self.seed, self.n, self.held = key, f"{kind}\0{value}\0{attempt}".encode(), 0, b""

    def below(self, n: int) -> int:
        if len(self.held) < 8:
            self.held += hmac.digest(self.key, self.seed + self.n.to_bytes(4, "big"), "sha256")
            self.n += 1
        x, self.held = int.from_bytes(self.held[:8], "big"), self.held[8:]
        return x % n


def draw(key: bytes, kind: str, value: str, attempt: int = 0) -> str:
    """The surrogate value of an original; another one for each ``attempt``.

    Formats are kept as long as they have room: after four attempts a telephone number may be any of its length, and after
    eight, numbers get a digit more for every four attempts, names and addresses letters, and IPv4 addresses become IPv6
    ones of the prefix for documentation.  So the room grows without bound and some attempt finds a free surrogate.
    """
    r = _Stream(key, kind, value, attempt)
    extra = max(0, attempt // 4 - 1)
    digits = lambda n: "".join(pick("0123456789") for _ in range(n))
    pick = lambda s: s[r.below(len(s))]
    like = lambda s: "".join(pick("0123456789") if c.isdigit() else pick("abcdefghijklmnopqrstuvwxyz") if c.isalpha() else c for c in s)
    more = "".join(pick("abcdefghijklmnopqrstuvwxyz") for _ in range(attempt // 4))  # crowded formats grow
    if kind == "email":
        local, _, domain = value.partition("@")
        host = _Stream(key, "host", domain, 0)  # addresses of one domain stay together
        return f"{like(local)}{more}@{''.join('bcdfghklmnprstvz'[host.below(16)] + 'aeiou'[host.below(5)] for _ in range(5))}.example.{domain.rpartition('.')[2]}"
    if kind == "ip" and extra:
        return "2001:db8:" + ":".join(f"{r.below(65536):x}" for _ in range(6))
    if kind == "ip":
        return ".".join(map(str, (240 + r.below(15), r.below(256), r.below(256), r.below(256))))  # never routed
    if kind == "card":
        body = value[0] + digits(len(value) - 2 + extra)
        return body + str(-_luhn(body + "0") % 10) if _luhn(value) == 0 else body + pick("0123456789")
    if kind == "ssn":
        return "9" + digits(len(value) - 1 + extra)  # never issued
    if kind == "iban":
        body = "".join(pick("0123456789") if c.isdigit() else pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ") for c in value[4:]) + digits(extra)
        check = 98 - int("".join(str(int(c, 36)) for c in body + value[:2] + "00")) % 97
        return f"{value[:2]}{check:02d}{body}"
    if kind == "phone":
        if attempt >= 4:
            return pick("23456789") + digits(len(value) - 1 + extra)
        return pick("23456789") + digits(2) + "555" + digits(4) if len(value) == 10 else value[:2] + digits(len(value) - 2)
    _, gender, script = kind.split("_")
    consonants, vowels, endings = SOUNDS[script]
    body = "".join(pick(consonants) + pick(vowels) for _ in range(2 + r.below(2) + attempt // 4))
    feminine = lambda s: s.endswith(("а", "я", "ου"))
    fit = endings[gender] if gender != "s" or script == "latin" else [e for e in endings["s"] if feminine(e) == feminine(value)]
    return body + pick(fit)


def render(kind: str, surface: str, surrogate: str) -> str:
    """``surrogate`` in the format of ``surface``: its separators, grouping, prefix and case."""
    if kind in ("card", "ssn", "phone", "iban"):
        n = len(_digits(surface)) if kind != "iban" else len(surface.replace(" ", ""))
        left = iter(surrogate if n <= len(surrogate) else "1" + surrogate)
        return "".join(next(left) if c.isalnum() else c for c in surface) + "".join(left)
    if kind.startswith("name_"):
        return surrogate.upper() if surface.isupper() and len(surface) > 1 else surrogate[0].upper() + surrogate[1:]
    return surrogate.upper() if kind == "email" and surface.isupper() else surrogate


@dataclass(frozen=True)
class Surrogates:
    """``occurrences``: digest of the text, span, kind, value and surface; ``mapping``: kind, value, surrogate."""

    occurrences: DataFrame
    mapping: DataFrame


def _digest(text) -> list:
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2")]


def find_entities(docs: DataFrame, text: str = "text") -> DataFrame:
    """Distinct entities of the texts: digest of the text (k1, k2), start, end (characters), kind, value, surface."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, _, _ in tx.blocks(batches, "_text"):
            rows = [(i, *e) for i, t in enumerate(block.column(2).to_pylist()) for e in ((a, b, kind, value, t[a:b]) for a, b, kind, value in detect(t))]
            of, *rest = zip(*rows, strict=True) if rows else [()] * 6
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([block.column(k).take(pa.array(of, pa.int64())) for k in range(2)] + [pa.array(x, k) for x, k in zip(rest, kinds, strict=True)], ["k1", "k2", "start", "end", "kind", "value", "surface"])

    body = docs[text].cast("string")
    return docs.where(body.rlike(MAYBE)).select(*_digest(body), body.alias("_text")).mapInArrow(run, "k1 long, k2 long, start long, end long, kind string, value string, surface string").distinct()


def assign(entities: DataFrame, key: bytes) -> DataFrame:
    """A surrogate for each distinct (kind, value), no two alike in a kind's family and none equal to an original.

    Rounds of a draw, a grouping by what was drawn, and a join; those that clash go to the next round, where what earlier
    rounds settled stands.
    """
    family = F.element_at(F.split("kind", "_"), 1)
    originals = store(entities.select("kind", "value").distinct().withColumn("family", family), "originals")
    settled: DataFrame | None = None
    waiting, attempt = originals, 0
    while True:

        def run(batches: Iterator[pa.RecordBatch], attempt=attempt) -> Iterator[pa.RecordBatch]:
            for b in batches:
                drawn = [draw(key, k, v, attempt) for k, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(drawn, pa.string())], [*b.schema.names, "surrogate"])

        drawn = waiting.select("kind", "value", "family").mapInArrow(run, "kind string, value string, family string, surrogate string")
        best = drawn.groupBy("family", "surrogate").agg(F.min(F.struct("kind", "value")).alias("first"))
        clear = best.join(originals.select("family", F.col("value").alias("surrogate")), ["family", "surrogate"], "left_anti")
        if settled is not None:
            clear = clear.join(settled.select("family", "surrogate"), ["family", "surrogate"], "left_anti")
        won = store(clear.select("first.kind", "first.value", "family", "surrogate"), "settled")
        settled = won if settled is None else settled.unionByName(won)
        waiting = store(waiting.join(won, ["kind", "value"], "left_anti"), "waiting")
        attempt += 1
        if waiting.isEmpty():
            return settled.select("kind", "value", "surrogate")


def pseudonymise(docs: DataFrame, key: bytes, text: str = "text") -> DataFrame:
    """``docs`` with the personal data of their texts replaced, and ``n_entities``, the number of replacements.

    The column ``text`` keeps its place; a column ``n_entities`` is replaced; others pass unchanged.  Null, empty and other
    texts without entities stay as they are with 0 entities.  Equal texts get equal results, however often rows or keys
    repeat.  An empty table gives an empty one.  Texts of any length are taken whole, in blocks of bounded bytes or one text.
    """
    rest = docs.drop("n_entities")
    found = store(find_entities(rest, text), "entities")
    mapping = assign(found, key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            new = [render(*x) for x in zip(*(b.column(k).to_pylist() for k in (4, 5, 6)), strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(4)), pa.array(new, pa.string())], ["k1", "k2", "start", "end", "new"])

    placed = found.join(mapping, ["kind", "value"]).select("k1", "k2", "start", "end", "kind", "surface", "surrogate").mapInArrow(run, "k1 long, k2 long, start long, end long, new string")
    edits = placed.groupBy("k1", "k2").agg(F.sort_array(F.collect_set(F.struct("start", "end", "new"))).alias("_edits"))
    body = F.col(text).cast("string")
    maybe = F.coalesce(body.rlike(MAYBE), F.lit(False))
    names = rest.columns
    looked = rest.where(maybe).select("*", *(x.alias(f"_{x_name}") for x, x_name in zip(_digest(body), ("k1", "k2"), strict=True)))
    joined = looked.join(edits.select(F.col("k1").alias("_k1"), F.col("k2").alias("_k2"), "_edits"), ["_k1", "_k2"], "left").select(*names, "_edits")
    at = names.index(text)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, _, _ in tx.blocks(batches, text):
            out, n = [], []
            for t, edits in zip(b.column(at).to_pylist(), b.column(len(names)).to_pylist(), strict=True):
                parts, last = [], 0
                for e in edits or ():
                    parts += [t[last : e["start"]], e["new"]]
                    last = e["end"]
                out.append("".join(parts) + t[last:])
                n.append(len(edits or ()))
            columns = [pa.array(out, pa.string()) if k == at else b.column(k) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n, pa.int64())], [*names, "n_entities"])

    fields = ", ".join(f"`{f.name}` {'string' if f.name == text else f.dataType.simpleString()}" for f in rest.schema)
    changed = joined.mapInArrow(apply, f"{fields}, n_entities long")
    same = rest.where(~maybe).withColumn(text, body).withColumn("n_entities", F.lit(0).cast("long"))
    return changed.unionByName(same)
