"""Secret scans through a trigram inverted index.

Each rule's regular expression gives a Boolean query over lower-cased trigrams.  Every block of texts is an index
segment: postings of the rules' trigrams, intersected and united as the query says; only the texts that remain are
verified by the expression.  A rule without mandatory trigrams scans every text.  Segments are local to a task, so the
index covers all rows and nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import product
from re import _constants as sre
from re import _parser as sre_parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import _text as tx

#: Exact strings that a part of an expression may stand for before it counts as unknown.
MAX_EXACT = 64


@dataclass(frozen=True)
class Rule:
    """A kind of secret.  ``least``: characters that ``group`` must have, else the match is dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    any_case: bool = False

    @property
    def regex(self) -> re.Pattern[bytes]:
        return re.compile(self.pattern.encode(), re.IGNORECASE if self.any_case else 0)


BASE_RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", group=2, least=6, any_case=True),
    Rule("access", r"AKIA[A-Z0-9]+", least=20),
    Rule("hex", r"[0-9a-f]+", least=24),
)

MORE_RULES = (
    Rule("private_key", r"-----BEGIN (RSA |EC |DSA |OPENSSH |PGP |ENCRYPTED )?PRIVATE KEY( BLOCK)?-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("github", r"(ghp|gho|ghu|ghs|ghr)_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{60,}"),
    Rule("gitlab", r"glpat-[A-Za-z0-9_-]{20,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("stripe", r"(sk|rk)_live_[A-Za-z0-9]{16,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("npm", r"npm_[A-Za-z0-9]{36}"),
    Rule("sas", r"[?&]sig=[A-Za-z0-9%+/=]{20,}"),
    Rule("url_password", r"[a-z][a-z0-9+.-]*://[^\s/:@]+:[^\s/:@]+@[A-Za-z0-9.-]+"),
    Rule("bearer", r"bearer\x20+[A-Za-z0-9._~+/-]{20,}", any_case=True),
)

# A Boolean query: None holds for every text; a trigram; or ("and" | "or", parts).
Query = None | bytes | tuple[str, tuple]


def _all(parts: list[Query]) -> Query:
    got = tuple(dict.fromkeys(p for p in parts if p is not None))
    return got[0] if len(got) == 1 else ("and", got) if got else None


def _any(parts: list[Query]) -> Query:
    got = list(dict.fromkeys(parts))
    if not got or None in got:
        return None
    asks = [frozenset(q[1]) if q[0] == "and" else frozenset([q]) for q in got]
    got = [q for q, a in zip(got, asks, strict=True) if not any(b < a for b in asks)]  # what asks for more adds nothing
    return got[0] if len(got) == 1 else ("or", tuple(got))


def _spelled(strings: set[bytes]) -> Query:
    return _any([_all([s[i : i + 3] for i in range(len(s) - 2)]) for s in sorted(strings)])


@dataclass
class _Part:
    """``exact``: the strings it can match, lower-cased, if they are few; ``needs``: what any match holds."""

    exact: set[bytes] | None
    needs: Query = field(default=None)


def _one(op: object, arg: object) -> _Part:
    if op is sre.LITERAL:
        return _Part({chr(arg).lower().encode()})
    if op is sre.IN:
        chars: set[int] = set()
        for kind, x in arg:
            if kind is sre.LITERAL:
                chars.add(x)
            elif kind is sre.RANGE:
                chars.update(range(x[0], x[1] + 1))
            else:
                return _Part(None)
            if len(chars) > MAX_EXACT:
                return _Part(None)
        return _Part({chr(x).lower().encode() for x in chars} if len(chars) <= 8 else None)
    if op is sre.SUBPATTERN:
        return _sequence(arg[3])
    if op is sre.BRANCH:
        parts = [_sequence(x) for x in arg[1]]
        if all(p.exact is not None for p in parts) and len(union := set().union(*(p.exact for p in parts))) <= MAX_EXACT:
            return _Part(union)
        return _Part(None, _any([p.needs if p.exact is None else _spelled(p.exact) for p in parts]))
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
        least, most, inner = arg
        p = _sequence(inner)
        if p.exact is not None and most == 1:
            return _Part(p.exact | {b""} if not least else p.exact)
        if p.exact is not None and least == most and len(p.exact) ** least <= MAX_EXACT:
            return _Part({b"".join(x) for x in product(p.exact, repeat=least)})
        return _Part(None, (p.needs if p.exact is None else _spelled(p.exact)) if least else None)
    if op is sre.AT:
        return _Part({b""})
    return _Part(None)


def _sequence(items: object) -> _Part:
    run: set[bytes] = {b""}
    needs: list[Query] = []
    whole = True
    for op, arg in items:
        p = _one(op, arg)
        if p.exact is not None and len(run) * len(p.exact) <= MAX_EXACT:
            run = {a + b for a in run for b in p.exact}
            continue
        whole = False
        needs += [_spelled(run), p.needs]
        run = p.exact if p.exact is not None else {b""}
    return _Part(run) if whole else _Part(None, _all([*needs, _spelled(run)]))


def trigram_query(pattern: str) -> Query:
    """What trigrams any text with a match of ``pattern`` holds, upper and lower case alike; None if nothing is sure."""
    p = _sequence(sre_parser.parse(pattern))
    return p.needs if p.exact is None else _spelled(p.exact)


def _trigrams(q: Query) -> set[bytes]:
    return set() if q is None else {q} if isinstance(q, bytes) else set().union(*map(_trigrams, q[1]))


_LOWER = np.arange(256, dtype=np.uint32)
_LOWER[65:91] += 32


class Segment:
    """Postings of chosen trigrams over one block of texts."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, number: np.ndarray, trigrams: list[bytes]):
        self.rows = np.arange(len(offsets) - 1)
        self.postings: dict[bytes, np.ndarray] = {t: self.rows[:0] for t in trigrams}
        if len(data) < 3 or not trigrams:
            return
        low = _LOWER[data]
        which = number[low[:-2] << 16 | low[1:-1] << 8 | low[2:]]
        at = np.flatnonzero(which)
        row = np.searchsorted(offsets, at, "right") - 1
        inside = at + 3 <= offsets[row + 1]
        both = np.unique(which[at[inside]].astype(np.int64) * len(offsets) + row[inside])
        ids, rows = both // len(offsets), both % len(offsets)
        for i, t in enumerate(trigrams, 1):
            lo, hi = np.searchsorted(ids, [i, i + 1])
            self.postings[t] = rows[lo:hi]

    def rows_for(self, q: Query) -> np.ndarray:
        if q is None:
            return self.rows
        if isinstance(q, bytes):
            return self.postings[q]
        lists = sorted((self.rows_for(x) for x in q[1]), key=len)
        out = lists[0]
        for x in lists[1:]:
            out = np.intersect1d(out, x, assume_unique=True) if q[0] == "and" else np.union1d(out, x)
        return out


def find_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = BASE_RULES + MORE_RULES) -> DataFrame:
    """The secrets in every row of ``docs``: its key and ``secrets``, an array of kind, rule, start and end.

    Matches of a rule are leftmost and don't overlap; those with fewer than ``least`` characters in the group are
    dropped.  ``start`` and ``end`` count code points, the end exclusive; the array is sorted by start, then by the rule's
    place.  A null or empty text has none; repeated rows give repeated results; an empty table gives an empty one; other
    columns are ignored.
    """
    queries = [trigram_query(r.pattern) for r in rules]
    trigrams = sorted(set().union(*map(_trigrams, queries)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = np.zeros(1 << 24, np.uint16)
        for i, t in enumerate(trigrams, 1):
            number[t[0] << 16 | t[1] << 8 | t[2]] = i
        compiled = [r.regex for r in rules]
        kind = pa.list_(pa.struct([("kind", pa.string()), ("rule", pa.int32()), ("start", pa.int64()), ("end", pa.int64())]))
        for block, data, offsets in tx.blocks(batches, "_text"):
            index = Segment(data, offsets, number, trigrams)
            found: list[list[tuple[int, int, int]]] = [[] for _ in range(block.num_rows)]
            raw = data.tobytes()
            for k, (rule, regex, query) in enumerate(zip(rules, compiled, queries, strict=True)):
                for r in index.rows_for(query).tolist():
                    a, b = int(offsets[r]), int(offsets[r + 1])
                    for m in regex.finditer(raw, a, b):
                        lo, hi = m.span(rule.group)
                        if hi - lo >= rule.least:
                            found[r].append((m.start(), k, m.end()))
            out = []
            for r, hits in enumerate(found):
                if hits:
                    body = tx.code_points(data[offsets[r] : offsets[r + 1]])
                    points = np.zeros(len(body) + 1, np.int64)
                    np.cumsum(body, out=points[1:])
                out.append([{"kind": rules[k].kind, "rule": k, "start": int(points[s - offsets[r]]), "end": int(points[e - offsets[r]])} for s, k, e in sorted(hits)])
            yield pa.RecordBatch.from_arrays([block.column(0), pa.array(out, kind)], [key, "secrets"])

    frame = docs.select(docs[key], docs[text].cast("string").alias("_text"))
    return frame.mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, secrets array<struct<kind:string,rule:int,start:long,end:long>>")
