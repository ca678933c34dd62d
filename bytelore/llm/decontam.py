"""Benchmark decontamination by a generalised suffix automaton of the normalised test items.

The items' words form one automaton for each bounded block of items; its flat arrays are broadcast.  Training words are
streamed through it, tracking the longest match that ends at each word.  Map-only over the documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as tx

#: Words of test items in one automaton, and automata in one pass.  They bound what a pass broadcasts (about 40 bytes a word).
BLOCK_WORDS = 250_000
PASS_BLOCKS = 8


def item_words(texts: list[str | None]) -> list[np.ndarray]:
    """Hashes of the normalised words of each text."""
    out: list[np.ndarray] = []
    for _, data, offsets in tx.blocks(iter([pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])])):
        starts, ends, bounds = tx.spans(data, offsets, tx.NOT_ALNUM)
        h = tx.hash_spans(data, starts, ends, fold=True)
        out += [h[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    return out


@dataclass
class Automaton:
    """Flat arrays of a generalised suffix automaton; state 0 is the root."""

    window: int
    vocabulary: np.ndarray  # sorted word hashes; a word's number is its place
    pairs: np.ndarray  # sorted hashes of consecutive words
    keys: np.ndarray  # state << 32 | word, sorted
    targets: np.ndarray
    length: np.ndarray
    link: np.ndarray
    whole: dict[int, list[tuple[int, str | None]]]  # state: short items (words, id) that it spells
    items: dict[int, list[str]]  # state with strings of ``window`` words: items that hold them
    shortest: int

    @staticmethod
    def build(ids: list[str | None], words: list[np.ndarray], window: int) -> Automaton:
        kept = [(i, w) for i, w in zip(ids, words, strict=True) if len(w)]
        vocabulary = np.unique(np.concatenate([w for _, w in kept])) if kept else np.empty(0, np.uint64)
        nxt: list[dict[int, int]] = [{}]
        length, link = [0], [-1]

        def state(size: int, of: int, out: dict[int, int]) -> int:
            nxt.append(out)
            length.append(size)
            link.append(of)
            return len(nxt) - 1

        def split(p: int, c: int, q: int) -> int:
            """A copy of ``q`` for the strings that reach it through ``p``."""
            copy = state(length[p] + 1, link[q], dict(nxt[q]))
            while p >= 0 and nxt[p].get(c) == q:
                nxt[p][c] = copy
                p = link[p]
            link[q] = copy
            return copy

        def extend(last: int, c: int) -> int:
            q = nxt[last].get(c)
            if q is not None:
                return q if length[q] == length[last] + 1 else split(last, c, q)
            new, p = state(length[last] + 1, 0, {}), last
            while p >= 0 and c not in nxt[p]:
                nxt[p][c] = new
                p = link[p]
            if p >= 0:
                q = nxt[p][c]
                link[new] = q if length[q] == length[p] + 1 else split(p, c, q)
            return new

        numbered = [(i, np.searchsorted(vocabulary, w).tolist()) for i, w in kept]
        for _, w in numbered:
            last = 0
            for c in w:
                last = extend(last, c)
        whole: dict[int, list[tuple[int, str | None]]] = {}
        items: dict[int, set[str]] = {}
        for i, w in numbered:
            s = 0
            for n, c in enumerate(w, 1):
                s = nxt[s][c]
                while length[link[s]] >= window:
                    s = link[s]
                if n >= window and i is not None:
                    items.setdefault(s, set()).add(i)
            if len(w) < window:
                whole.setdefault(s, []).append((len(w), i))
        flat = sorted((s << 32 | c, t) for s, out in enumerate(nxt) for c, t in out.items())
        pairs = np.unique(np.concatenate([np.empty(0, np.uint64), *(tx.windows(w, np.array([0, len(w)]), 2)[0] for _, w in kept)]))
        return Automaton(
            window, vocabulary, pairs, np.array([k for k, _ in flat], np.uint64), np.array([t for _, t in flat], np.int64), np.array(length), np.array(link),
            whole, {s: sorted(x) for s, x in items.items()}, min([window, *(len(w) for _, w in kept)]),
        )


class Scanner:
    """Streams words through an automaton."""

    def __init__(self, a: Automaton):
        self.a = a
        self.step = dict(zip(a.keys.tolist(), a.targets.tolist(), strict=True))
        self.length, self.link = a.length.tolist(), a.link.tolist()
        self.filter = np.zeros(1 << 20, bool)
        self.filter[(a.vocabulary >> np.uint64(44)).astype(np.int64)] = True
        # the nearest state up the links, itself included, that spells a short item
        self.near = [-1] * len(self.length)
        for s in np.argsort(a.length, kind="stable").tolist():
            self.near[s] = s if s in a.whole else (self.near[self.link[s]] if self.link[s] >= 0 else -1)

    def runs(self, h: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, list[int]]]:
        """Stretches of a row that can hold a match: each word is an item's, and so is each pair of neighbours."""
        vocabulary, pairs = self.a.vocabulary, self.a.pairs
        if not len(vocabulary) or not len(h):
            return
        maybe = np.flatnonzero(self.filter[(h >> np.uint64(44)).astype(np.int64)])
        place = np.minimum(np.searchsorted(vocabulary, h[maybe]), len(vocabulary) - 1)
        right = vocabulary[place] == h[maybe]
        at, word = maybe[right], place[right]
        if not len(at):
            return
        rows = np.searchsorted(bounds, at, "right")
        joined = np.zeros(len(at), bool)
        near = np.flatnonzero((at[1:] == at[:-1] + 1) & (rows[1:] == rows[:-1]))
        if len(near) and len(pairs):
            two, _ = tx.windows(np.stack([h[at[near]], h[at[near] + 1]], 1).ravel(), np.arange(0, 2 * len(near) + 1, 2), 2)
            joined[near + 1] = pairs[np.minimum(np.searchsorted(pairs, two), len(pairs) - 1)] == two
        begin = np.flatnonzero(~joined)
        size = np.diff(np.append(begin, len(at)))
        for b, n in zip(begin[size >= self.a.shortest].tolist(), size[size >= self.a.shortest].tolist(), strict=True):
            yield int(at[b]), word[b : b + n].tolist()

    def scan(self, h: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, int, int, list[str]]]:
        """For each word where a window ends: the end, the window's words, the longest match's words, and the items."""
        step, length, link, window, whole = self.step, self.length, self.link, self.a.window, self.a.whole
        for start, words in self.runs(h, bounds):
            s = n = 0
            for i, c in enumerate(words, start + 1):
                while (t := step.get(s << 32 | c)) is None and s:
                    s = link[s]
                    n = length[s]
                if t is None:
                    s = n = 0
                    continue
                s, n = t, n + 1
                if n >= window:
                    v = s
                    while length[link[v]] >= window:
                        v = link[v]
                    yield i, window, n, self.a.items.get(v, [])
                v = self.near[s]
                while v >= 0:
                    for size, item in whole[v]:
                        if size <= n:
                            yield i, size, n, [] if item is None else [item]
                    v = self.near[link[v]] if link[v] >= 0 else -1


def automata(benchmark: DataFrame, key: str = "item_id", text: str = "text", window: int = 10, block_words: int = BLOCK_WORDS) -> Iterator[Automaton]:
    """An automaton for each block of at most ``block_words`` words (or one item); one block at a time is on the driver."""
    ids: list[str | None] = []
    words: list[np.ndarray] = []
    held = 0
    for row in benchmark.select(F.col(key).cast("string"), F.col(text).cast("string")).toLocalIterator():
        w = item_words([row[1]])[0]
        if held and held + len(w) > block_words:
            yield Automaton.build(ids, words, window)
            ids, words, held = [], [], 0
        ids.append(row[0])
        words.append(w)
        held += len(w)
    if held:
        yield Automaton.build(ids, words, window)


def find_contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_key: str = "item_id", window: int = 10, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` with columns that tell where test items occur in each text.

    Texts and items lower-case A-Z and split into words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``.  A window is any
    ``window`` consecutive words of an item, or a whole shorter item.  Adds ``n_words``, ``longest_match`` (words of the
    longest item string found where a window ends), ``hit_spans`` (array of start and end, in characters of the text, of
    unions of occurring windows, with ``words`` in each) and ``hit_items`` (item ids as strings, sorted, distinct).

    A null or empty text has no words and no hit; items without words match nothing; an item without an id marks words
    but is not listed; repeated items count once; an empty benchmark gives no hit.  Other columns pass unchanged, and
    columns of those four names are replaced.
    """
    added = "n_words long, longest_match long, hit_spans array<struct<start:long,end:long,words:long>>, hit_items array<string>"
    fresh = ["n_words", "longest_match", "hit_spans", "hit_items"]
    spark = docs.sparkSession
    out = docs.drop(*fresh)
    names = out.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema)
    at = names.index(text)

    def scan_pass(blocks: list[Automaton], earlier: bool):
        sent = spark.sparkContext.broadcast(blocks)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            scanners = [Scanner(a) for a in sent.value]
            spans_kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("words", pa.int64())]))
            for rows, data, offsets in tx.blocks(batches, names[at]):
                n = rows.num_rows
                starts, ends, bounds = tx.spans(data, offsets, tx.NOT_ALNUM)
                h = tx.hash_spans(data, starts, ends, fold=True)
                edge, longest, items = np.zeros(len(h) + 1, np.int64), np.zeros(n, np.int64), [set() for _ in range(n)]
                points = np.zeros(len(data) + 1, np.int64)
                np.cumsum(tx.code_points(data), out=points[1:])
                if earlier:
                    was = rows.select(fresh).to_pylist()
                    for r, x in enumerate(was):
                        longest[r] = x["longest_match"]
                        items[r].update(x["hit_items"])
                        for sp in x["hit_spans"]:
                            lo = np.searchsorted(starts, np.searchsorted(points, points[offsets[r]] + sp["start"] + 1) - 1)
                            edge[lo] += 1
                            edge[lo + sp["words"]] -= 1
                for scanner in scanners:
                    for i, size, run_of, found in scanner.scan(h, bounds):
                        r = int(np.searchsorted(bounds, i - 1, "right")) - 1
                        edge[i - size] += 1
                        edge[i] -= 1
                        longest[r] = max(longest[r], run_of)
                        items[r].update(found)
                hit = np.cumsum(edge[:-1]) > 0
                first = hit.copy()
                first[1:] &= ~hit[:-1]
                cut = bounds[(bounds > 0) & (bounds < len(hit))]
                first[cut] = hit[cut]
                last = hit.copy()
                last[:-1] &= ~hit[1:]
                last[cut - 1] = hit[cut - 1]
                b, e = np.flatnonzero(first), np.flatnonzero(last) + 1
                row = np.searchsorted(bounds, b, "right") - 1
                base = points[offsets[row]]
                spans: list[list[dict[str, int]]] = [[] for _ in range(n)]
                for r, x, y, w in zip(row.tolist(), (points[starts[b]] - base).tolist(), (points[ends[e - 1]] - base).tolist(), (e - b).tolist(), strict=True):
                    spans[r].append({"start": x, "end": y, "words": w})
                new = [pa.array(np.diff(bounds), pa.int64()), pa.array(longest), pa.array(spans, spans_kind), pa.array([sorted(x) for x in items], pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([*(rows.column(k) for k in range(len(names))), *new], [*names, *fresh])

        return run

    held: list[Automaton] = []
    passes = 0
    for a in automata(benchmark, item_key, "text", window, block_words):
        held.append(a)
        if len(held) == PASS_BLOCKS:
            out = out.mapInArrow(scan_pass(held, passes > 0), f"{schema}, {added}")
            held, passes = [], passes + 1
    if held or not passes:
        out = out.mapInArrow(scan_pass(held, passes > 0), f"{schema}, {added}")
    return out


def remove_contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", window: int = 10, max_fraction: float = 0.5) -> DataFrame:
    """``docs`` with occurring windows of test items cut out of their texts.

    Rows with over ``max_fraction`` of their words in such windows go whole.  Clean rows stay as they are; the columns are
    those of ``docs``.  Nulls, empty tables and repeats behave as in ``find_contamination``.
    """
    marked = {"n_words": "_n_words_in", "longest_match": "_longest_match_in", "hit_spans": "_hit_spans_in", "hit_items": "_hit_items_in"}
    found = find_contamination(docs.withColumnsRenamed({k: v for k, v in marked.items() if k in docs.columns}), benchmark, text, window=window)
    hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda n, s: n + s["words"])
    body = F.col(text)
    # what stands between the spans, in order
    kept = F.transform(
        F.sequence(F.lit(0), F.size("hit_spans")),
        lambda i: body.substr(
            (F.when(i == 0, F.lit(0)).otherwise(F.get("hit_spans", i - 1)["end"]) + 1).cast("int"),
            (F.when(i == F.size("hit_spans"), F.length(body)).otherwise(F.get("hit_spans", i)["start"]) - F.when(i == 0, F.lit(0)).otherwise(F.get("hit_spans", i - 1)["end"])).cast("int"),
        ),
    )
    clean = found.where(hit <= F.lit(max_fraction) * F.col("n_words")).withColumn(text, F.when(F.size("hit_spans") > 0, F.concat_ws("", kept)).otherwise(body))
    return clean.drop(*marked).withColumnsRenamed({v: k for k, v in marked.items()}).select(docs.columns)
