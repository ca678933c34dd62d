"""Order-preserving packing of documents into training sequences by dynamic programming.

The token stream of a partition is cut into windows of at most ``length`` tokens.  A cut costs nothing at the end of a
document, a little at the end of a sentence and more elsewhere; a window costs its padding, which is none at a power of
two.  The cheapest cuts come from one pass over the allowed places: the padded transition takes the least of a sliding
window, kept in a monotone queue, and the unpadded ones look up one place for each power of two.  Map-only.
"""

from __future__ import annotations

import os
import zlib
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from ..sources.blob import bound_batches
from . import _text as tx

#: Distinct pieces whose ids a worker remembers (about 50 bytes each).
CACHE = 1_000_000
#: Pieces that the tokenizer encodes, places whose cuts are looked up, and tokens that go into an output batch, at a time.
ENCODED_AT_ONCE, PLACES_AT_ONCE, TOKENS_AT_ONCE = 1 << 12, 1 << 12, 1 << 18


@dataclass(frozen=True)
class Packing:
    """``sentence_cut`` and ``word_cut``: tokens of padding that a cut at a sentence's end, or elsewhere, is worth."""

    length: int = 4096
    sentence_cut: int = 2
    word_cut: int = 24
    stride: int = 512
    end_id: int = 2
    #: Tokens that are packed together; memory is bounded by them and by the longest document.
    buffer_tokens: int = 1 << 22


class Encoder:
    """Ids of texts by a tokenizer that lower-cases and whose pre-tokens never hold white space.

    Texts are cut at spaces and line feeds, and before a full stop or comma that ends a chunk after an ASCII letter; each
    distinct piece, A-Z and a-z alike, is encoded once and remembered by its 64-bit hash.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.forget()

    def forget(self) -> None:
        self.keys, self.begin, self.size = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
        self.ids = np.empty(0, np.uint32)

    def learn(self, keys: np.ndarray, pieces: list[str]) -> None:
        """Encode ``pieces``, whose hashes ``keys`` are sorted and new."""
        if len(self.keys) + len(keys) > CACHE and len(self.keys):
            raise MemoryError
        sizes, ids = [], [self.ids]
        for first in range(0, len(pieces), ENCODED_AT_ONCE):  # the tokenizer's results are much larger than the ids
            got = [e.ids for e in self.tokenizer.encode_batch_fast(pieces[first : first + ENCODED_AT_ONCE], add_special_tokens=False)]
            sizes.append(np.fromiter(map(len, got), np.int64, len(got)))
            ids.append(np.fromiter(chain.from_iterable(got), np.uint32, int(sizes[-1].sum())))
        size = np.concatenate(sizes)
        begin = len(self.ids) + np.append(0, np.cumsum(size))[:-1]
        self.ids = np.concatenate(ids)
        keys = np.concatenate([self.keys, keys])
        order = np.argsort(keys, kind="stable")
        self.keys, self.begin, self.size = keys[order], np.concatenate([self.begin, begin])[order], np.concatenate([self.size, size])[order]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all rows, the rows' bounds in them, and whether a sentence ends before each id (or at the end)."""
        breaks = np.zeros(256, bool)
        breaks[[0x20, 0x0A]] = True
        starts, ends, bounds = tx.spans(data, offsets, breaks)
        if not len(starts):
            return np.empty(0, np.uint32), bounds, np.zeros(1, bool)
        last = data[ends - 1]
        full_stop = np.isin(last, np.frombuffer(b".!?", np.uint8))
        follows = ends < len(data)
        full_stop[follows] |= data[ends[follows]] == 0x0A
        before = data[np.maximum(ends - 2, starts)] | 0x20
        apart = ((last == 0x2E) | (last == 0x2C)) & (ends - starts > 1) & (before >= 0x61) & (before <= 0x7A)
        # a chunk whose mark stands apart becomes two pieces
        at = np.append(0, np.cumsum(1 + apart))
        cut_starts, cut_ends = np.empty(at[-1], np.int64), np.empty(at[-1], np.int64)
        cut_starts[at[:-1]], cut_ends[at[1:] - 1] = starts, ends
        cut_ends[at[:-1][apart]] = cut_starts[at[1:][apart] - 1] = ends[apart] - 1
        raw = data.tobytes()
        h = tx.hash_spans(data, cut_starts, cut_ends, fold=b"<|" not in raw)  # special tokens stand for themselves in one case
        kinds, first, which = np.unique(h, return_index=True, return_inverse=True)
        for _ in range(2):
            place = np.minimum(np.searchsorted(self.keys, kinds), max(0, len(self.keys) - 1))
            new = np.flatnonzero(self.keys[place] != kinds) if len(self.keys) else np.arange(len(kinds))
            if not len(new):
                break
            try:
                self.learn(kinds[new], [raw[a:b].decode() for a, b in zip(cut_starts[first[new]].tolist(), cut_ends[first[new]].tolist(), strict=True)])
            except MemoryError:  # the memory is full: begin again with this block's pieces
                self.forget()
                self.learn(kinds, [raw[a:b].decode() for a, b in zip(cut_starts[first].tolist(), cut_ends[first].tolist(), strict=True)])
        place = np.searchsorted(self.keys, kinds)
        per = self.size[place][which]
        to = np.append(0, np.cumsum(per))
        take = np.arange(to[-1]) - np.repeat(to[:-1] - self.begin[place][which], per)
        sentence = np.zeros(int(to[-1]) + 1, bool)
        sentence[to[at[1:][full_stop]]] = True
        return self.ids[take], to[at[bounds]], sentence


_encoders: dict[str, Encoder] = {}


def encoder_for(path: str) -> Encoder:
    """The worker's encoder for a tokenizer file, kept from one task to the next."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def best_cuts(total: int, document_ends: np.ndarray, sentence_ends: np.ndarray, p: Packing) -> list[int]:
    """Ends of the windows that cut ``total`` tokens at least cost.  The ends given are token counts before the cut."""
    if not total:
        return []
    cost = np.full(total + 1, p.word_cut, np.int32)
    cost[sentence_ends] = p.sentence_cut
    cost[document_ends] = 0
    cost[total] = 0
    allowed = np.zeros(total + 1, bool)
    allowed[sentence_ends] = allowed[document_ends] = True
    allowed[:: p.stride] = True
    allowed[max(0, total - p.length) :] = True  # what remains at the end can go by powers of two
    allowed[0] = True
    places = np.flatnonzero(allowed)
    places_list, cost_list = places.tolist(), cost[places].tolist()
    del cost, allowed
    best = [0.0] * len(places_list)
    back = [0] * len(places_list)
    powers = [1 << k for k in range(p.length.bit_length()) if 1 << k < p.length]

    def earlier(some: np.ndarray) -> list[list[int]]:
        """For each place and each power, the index of the place that far before, or -1."""
        wanted = some[:, None] - np.array(powers, np.int64)
        i = np.searchsorted(places, wanted)
        return np.where(places[np.minimum(i, len(places) - 1)] == wanted, i, -1).tolist()

    # best[j] = cost[j] + length - place[j] + min(best[i] + place[i]) over the window of places i
    queue: deque[tuple[float, int]] = deque()
    low = 0
    length = p.length
    for j in range(1, len(places_list)):
        if j % PLACES_AT_ONCE == 0 or j == 1:
            chunk = j - j % PLACES_AT_ONCE
            before = earlier(places[chunk : chunk + PLACES_AT_ONCE])
        i = j - 1
        value = best[i] + places_list[i]
        while queue and queue[-1][0] >= value:
            queue.pop()
        queue.append((value, i))
        at = places_list[j]
        while places_list[queue[0][1]] < at - length:
            queue.popleft()
        value, i = queue[0]
        value += length - at
        for k in before[j - chunk]:
            if k >= 0 and best[k] < value:
                value, i = best[k], k
        best[j] = value + cost_list[j]
        back[j] = i
    out, j = [], len(places_list) - 1
    while j > 0:
        out.append(places_list[j])
        j = back[j]
    return out[::-1]


def pack_sequences(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", packing: Packing = Packing(), with_ids: bool = True) -> DataFrame:
    """Pieces of the documents of ``docs`` in sequences of at most ``packing.length`` tokens, in the order of the rows.

    A document's tokens are the ids of its text by the tokenizer file ``tokenizer`` without special tokens, then
    ``packing.end_id``.  Returns for each piece: ``key``, ``start`` (its document's ids before it), ``length``,
    ``ids_crc32``, ``doc_tokens``, ``sequence_id``, ``offset`` in its sequence, ``row`` (a number of the document's row that
    no other row has, since keys can repeat) and, if ``with_ids``, ``ids``.

    The tokenizer must split at spaces and line feeds and drop them.  A null or empty text is the end id alone.  Repeated
    rows and keys are packed each on their own; null keys stay null; an empty table gives an empty one; other columns are
    ignored.  Each partition packs its own rows, so the result depends on the partitions but not on which task ran them:
    read the rows from files, or a stored table, where a lost executor may force a second run.
    """
    p = packing
    names = [key, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "row", *["ids"] * with_ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_for(tokenizer)
        base = TaskContext.get().partitionId() << 36
        sequences = rows_before = 0
        held: list[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]] = []
        tokens = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal sequences, rows_before
            keys = pa.concat_arrays([h[0] for h in held])
            ids = np.concatenate([h[1] for h in held])
            shift = np.append(0, np.cumsum([len(h[1]) for h in held]))
            ends = np.concatenate([h[2] + s for h, s in zip(held, shift[:-1], strict=True)])  # after each document's end id
            sentences = np.concatenate([h[3] + s for h, s in zip(held, shift[:-1], strict=True)])
            held.clear()
            cuts = np.array(best_cuts(len(ids), ends, sentences, p), np.int64)
            stops = np.union1d(ends, cuts)
            starts = np.append(0, stops[:-1])
            doc, seq = np.searchsorted(ends, stops), np.searchsorted(cuts, stops)
            doc_start, seq_start = np.append(0, ends[:-1]), np.append(0, cuts[:-1])
            # in batches of bounded size, each ending with a piece
            edges = np.unique(np.append(np.searchsorted(starts, np.arange(0, len(ids), TOKENS_AT_ONCE)), len(stops)))
            for a, b in pairwise(edges.tolist()):
                d, some = doc[a:b], ids[starts[a] : stops[b - 1]]
                at, to = starts[a:b] - starts[a], stops[a:b] - starts[a]
                raw = memoryview(np.ascontiguousarray(some, "<u4")).cast("B")
                crc = [zlib.crc32(raw[4 * x : 4 * y]) for x, y in zip(at.tolist(), to.tolist(), strict=True)]
                columns = [
                    keys.take(pa.array(d)), starts[a:b] - doc_start[d], to - at, np.array(crc, np.int64), (ends - doc_start)[d],
                    base + sequences + seq[a:b], starts[a:b] - seq_start[seq[a:b]], base + rows_before + d,
                ]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.append(at, len(some)).astype(np.int32)), pa.array(some.astype(np.int64))))
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, pa.int64()) for c in columns], names)
            sequences += len(cuts)
            rows_before += len(ends)

        for block, data, offsets in tx.blocks(batches, "_text"):
            ids, bounds, sentence = encoder.encode(data, offsets)
            # the end id after each row's own
            n, rows = len(ids), block.num_rows
            out = np.full(n + rows, p.end_id, np.uint32)
            place = np.arange(n) + tx.rows_of(bounds)
            out[place] = ids
            ends = bounds[1:] + np.arange(1, rows + 1)
            cut = np.flatnonzero(sentence[1:]) + 1  # ids before the cut, of which the last is in the cut's row
            own = block.column(0).take(pa.array(np.arange(rows)))  # a slice would keep the batch with its texts
            held.append((own, out, ends, place[cut - 1] + 1 if n else cut))
            tokens += len(out)
            if tokens >= p.buffer_tokens:
                yield from flush()
                tokens = 0
        if held:
            yield from flush()

    bound_batches(docs.sparkSession)
    frame = docs.select(docs[key], docs[text].cast("string").alias("_text"))
    kind = docs.schema[key].dataType.simpleString()
    return frame.mapInArrow(run, f"`{key}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, row long" + ", ids array<long>" * with_ids)
