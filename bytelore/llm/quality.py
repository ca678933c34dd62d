"""Quality rules over repetition, by suffix array.

The words of each text get a suffix array (prefix doubling over ranks, kept only for suffixes that still tie), whose
longest-common-prefix intervals give the maximal repeated word strings.  The union of their spans and the longest of
them are limited.  Map-only: a text never leaves its partition.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import _text as tx


@dataclass(frozen=True)
class RepetitionLimits:
    """Limits of the verdict.  A repeat counts from ``least_words`` on."""

    least_words: int = 10
    covered_fraction: float = 0.30
    longest_words: int = 200


def _ties(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of the keys, the group start of each in that order, and whether its group has others."""
    order = np.argsort(key, kind="stable")
    k = key[order]
    new = np.ones(len(k), bool)
    new[1:] = k[1:] != k[:-1]
    begin = np.flatnonzero(new)
    size = np.diff(np.append(begin, len(k)))
    return order, np.repeat(begin, size), np.repeat(size > 1, size)


def repeats(h: np.ndarray, bounds: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """For each word, the length of the longest string that begins there and occurs elsewhere in its row.

    Zero where that is below ``least``.  Returns the lengths and the suffix array of the suffixes that repeat.
    """
    n, rows = len(h), tx.rows_of(bounds)
    longest = np.zeros(n, np.int64)
    if not n:
        return longest, np.empty(0, np.int64)
    end = bounds[1:][rows]
    keyed = tx.mix(h ^ tx.mix(rows.astype(np.uint64) + np.uint64(1)))
    order, group, tied = _ties(keyed)
    rank = np.empty(n, np.int64)
    rank[order] = group
    slot = group  # the place in the suffix array from which a group's members are numbered
    at, k = order[tied], 1
    final: list[tuple[np.ndarray, np.ndarray]] = []
    while len(at):
        nxt = at + k
        inside = nxt < end[at]
        second = np.where(inside, rank[np.minimum(nxt, n - 1)] + 1, 0)
        key = rank[at].astype(np.uint64) << np.uint64(32) | second.astype(np.uint64)
        order, group, tied = _ties(key)
        at = at[order]
        first = rank[at]
        new = np.ones(len(at), bool)
        new[1:] = first[1:] != first[:-1]
        slot = first + (group - np.repeat(np.flatnonzero(new), np.diff(np.append(np.flatnonzero(new), len(at)))))
        # a suffix that ends here can't tie again: its second rank is 0, and no other of the row is as long
        rank[at] = slot
        k *= 2
        if k >= least:  # before that, what no longer ties can't share ``least`` words
            done = ~tied
            if done.any():
                final.append((slot[done], at[done]))
        elif not tied.any():
            return longest, np.empty(0, np.int64)
        at = at[tied]
        if k < least:
            continue
    if not final:
        return longest, np.empty(0, np.int64)
    places, array = (np.concatenate(x) for x in zip(*final, strict=True))
    array = array[np.argsort(places, kind="stable")]
    # common prefixes of neighbours, by halving steps over prefix sums of a polynomial of the words
    up = tx._powers(0xD6E8FEB86659FD93, n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(tx.mix(h.copy()) * up[:n], out=sums[1:])
    a, b = array[:-1], array[1:]
    room = np.where(rows[a] == rows[b], np.minimum(end[a] - a, end[b] - b), 0)
    lcp, step = np.zeros(len(a), np.int64), 1 << int(max(1, room.max(initial=1))).bit_length()
    while step:
        to = lcp + step
        ok = to <= room
        t = np.where(ok, to, 0)
        # sums are scaled to one place, so equal strings give equal values
        lo, hi = np.minimum(a, b), np.maximum(a, b)
        same = (sums[lo + t] - sums[lo]) * up[hi - lo] == sums[hi + t] - sums[hi]
        lcp = np.where(ok & same, to, lcp)
        step >>= 1
    deepest = np.zeros(len(array), np.int64)  # the depth of the innermost interval that holds the suffix
    deepest[:-1] = lcp
    deepest[1:] = np.maximum(deepest[1:], lcp)
    longest[array] = np.where(deepest >= least, deepest, 0)
    return longest, array


def _covered(length: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Words of each row inside the union of the spans that begin at each word with that length."""
    edge = np.zeros(len(length) + 1, np.int64)
    at = np.flatnonzero(length)
    edge[at] += 1
    np.add.at(edge, at + length[at], -1)
    return tx.per_row(np.cumsum(edge[:-1]) > 0, bounds)


def measure(data: np.ndarray, offsets: np.ndarray, least: int) -> dict[str, np.ndarray]:
    """The counts of each row of a block."""
    rows = len(offsets) - 1
    starts, ends, bounds = tx.spans(data, offsets, tx.SPACE)
    h = tx.hash_spans(data, starts, ends, fold=False)
    head = np.zeros(len(data) + 1, np.int64)
    np.cumsum(tx.code_points(data), out=head[1:])
    chars = head[ends] - head[starts]
    symbol = np.zeros(256, bool)
    symbol[list(b"#*$%&|<>")] = True
    # lines with a word, and how many of them are new in their text
    line_at, line_to, per = tx.spans(data, offsets, tx.NEWLINE)
    first_word = np.searchsorted(starts, line_at)
    worded = np.append(starts, len(data))[first_word] < line_to
    row_of_line = tx.rows_of(per)[worded]
    lines = tx.hash_spans(data, line_at[worded], line_to[worded], fold=False)
    new = np.unique(tx.mix(lines ^ tx.mix(row_of_line.astype(np.uint64) + np.uint64(1))), return_index=True)[1]
    n_lines = np.bincount(row_of_line, minlength=rows)
    # words inside windows of five that occur twice or more
    w, at = tx.windows(h, bounds, 5)
    row_of_word = tx.rows_of(bounds)
    _, _, tied = order_tied = _ties(tx.mix(w ^ tx.mix(row_of_word[at].astype(np.uint64) + np.uint64(1))))
    five = np.zeros(len(h), np.int64)
    five[at[order_tied[0][tied]]] = 5
    longest, _ = repeats(h, bounds, least)
    top = np.zeros(rows, np.int64)
    np.maximum.at(top, row_of_word[longest > 0], longest[longest > 0])
    return {
        "n_words": np.diff(bounds),
        "word_chars": tx.per_row(chars, bounds),
        "n_symbols": tx.per_row(symbol[data], offsets),
        "n_dup_lines": n_lines - np.bincount(row_of_line[new], minlength=rows),
        "n_repeat_words": _covered(five, bounds),
        "covered_words": _covered(longest, bounds),
        "longest_repeat": top,
    }


def repetition_quality(docs: DataFrame, key: str = "doc_id", text: str = "text", limits: RepetitionLimits = RepetitionLimits()) -> DataFrame:
    """Repetition counts and a verdict for every row of ``docs``.

    Words are ``[^\\x20\\x09-\\x0D]+``, compared exactly.  Returns ``key``, ``n_words``, ``word_chars``, ``n_symbols``,
    ``n_dup_lines``, ``n_repeat_words``, ``covered_words``, ``longest_repeat``, ``base_failed`` and ``kept``.
    ``base_failed``: under 10 words, or over 20 % of the words in windows of five that recur.  ``kept``: not that, the
    repeats of ``limits.least_words`` or more cover at most ``limits.covered_fraction`` of the words, and none is longer
    than ``limits.longest_words``.

    A null or empty text has no words and fails.  Rows are judged one by one: repeated rows and keys give repeated
    results, a null key stays null, an empty table gives an empty one, other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in tx.blocks(batches, "_text"):
            m = measure(data, offsets, limits.least_words)
            n = m["n_words"]
            failed = (n < 10) | (100 * m["n_repeat_words"] > 20 * n)
            kept = ~failed & (m["covered_words"] <= limits.covered_fraction * n) & (m["longest_repeat"] <= limits.longest_words)
            columns = [rows.column(0), *(pa.array(x, pa.int64()) for x in m.values()), pa.array(failed), pa.array(kept)]
            yield pa.RecordBatch.from_arrays(columns, [key, *m, "base_failed", "kept"])

    kind = docs.schema[key].dataType.simpleString()
    counts = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, covered_words long, longest_repeat long"
    return docs.select(docs[key], docs[text].cast("string").alias("_text")).mapInArrow(run, f"`{key}` {kind}, {counts}, base_failed boolean, kept boolean")
