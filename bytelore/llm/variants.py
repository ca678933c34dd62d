"""Spelling variants of a corpus: every string one edit away from a word is generated and looked up in the vocabulary.

A word's whole neighbourhood is its distinct deletions, replacements and insertions over the letters that the vocabulary
has.  What of it is in the vocabulary is near by construction, so no distance is worked out.  Neighbours are made as 64-bit
hashes in numpy, whole batches of equally long words at once; a bitmap of the vocabulary's hashes, of bounded size, drops
those that are surely no words, the others become strings and meet the vocabulary in a hash join.  The bitmap only saves
shuffling: a false hit finds no partner in the join, and no word is ever missed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._scratch import store
from ._text import _powers, mix

#: Letters of which words are made; all are in Latin-1, so a word is held as one byte a letter.
RUN = "[A-Za-zÀ-ÿ]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bits of the bitmap for a word, and its least and greatest size as a power of two (128 KiB and 64 MiB).
BITS_PER_WORD, LEAST_BITS, MOST_BITS = 32, 20, 29
#: Words whose neighbourhoods one task works out.
WORDS_A_TASK = 1 << 15
#: Neighbours that are worked out at a time.
AT_ONCE = 1 << 21
_BUCKET = 1 << 15

_PRIME = 0x9E3779B97F4A7C15
_INVERSE = np.uint64(pow(_PRIME, -1, 2**64))
_LETTER = np.random.default_rng(20250213).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def words(docs: DataFrame, key: str = "doc_id", text: str = "text", least_letters: int = 7, least_count: int = 2, mutate: int | None = None) -> DataFrame:
    """``word`` and ``n``: the lower-cased runs of letters of at least ``least_letters`` letters with ``n >= least_count``.

    Only A-Z are lower-cased.  With ``mutate``, a run loses the letter at ``h % length`` before it is counted where
    ``mutate`` divides h, the CRC-32 of ``<key>:<run>``; a null key counts as empty there.  Null texts have no words.
    """
    run = F.explode(F.filter(F.regexp_extract_all(F.translate(F.col("text"), _UPPER, _LOWER), F.lit(RUN), F.lit(0)), lambda w: F.length(w) >= least_letters))
    runs = docs.select(F.coalesce(docs[key].cast("string"), F.lit("")).alias("key"), docs[text].cast("string").alias("text")).select("key", run.alias("run"))
    word: Column = F.col("run")
    if mutate:
        h = F.crc32(F.concat("key", F.lit(":"), "run"))
        at = (h % F.length("run")).cast("int")
        word = F.when(h % mutate == 0, F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))).otherwise(word)
    counted = runs.select(word.alias("word")).where(F.length("word") >= least_letters)
    return counted.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def _matrices(column: pa.Array, most: int) -> Iterator[np.ndarray]:
    """The words of a column as matrices of Latin-1 bytes, a row for each word, words of one length together.

    A matrix has at most ``most`` bytes, unless one word alone is longer.
    """
    by_length: dict[int, list[bytes]] = {}
    for word in column.to_pylist():
        raw = word.encode("latin-1")
        by_length.setdefault(len(raw), []).append(raw)
    for length, group in by_length.items():
        step = max(1, most // length)
        for i in range(0, len(group), step):
            yield np.frombuffer(b"".join(group[i : i + step]), np.uint8).reshape(-1, length)


def _prefixes(letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row the polynomial hashes of its prefixes, from none to all of it, and the powers that they use."""
    powers = _powers(_PRIME, letters.shape[1] + 2)
    sums = np.zeros((len(letters), letters.shape[1] + 1), np.uint64)
    np.cumsum(_LETTER[letters] * powers[: letters.shape[1]], axis=1, out=sums[:, 1:])
    return sums, powers


def _positions(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two places in a bitmap of ``2 ** bits`` bits."""
    h = mix(h.copy())
    return (h >> np.uint64(64 - bits)).astype(np.int64), (h & np.uint64((1 << bits) - 1)).astype(np.int64)


def bitmap(vocabulary: DataFrame, bits: int) -> np.ndarray:
    """The bitmap of ``word``: built by Spark in pieces of 32,768 bits, of which the driver gathers at most ``2 ** (bits - 15)``."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for letters in _matrices(batch.column("word"), AT_ONCE):
                h = _prefixes(letters)[0][:, -1]
                yield pa.RecordBatch.from_pydict({"at": np.concatenate(_positions(h, bits)) + 1})

    at = vocabulary.select("word").mapInArrow(places, "at long")
    pieces = at.groupBy(F.bitmap_bucket_number("at").alias("piece")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("held"))
    out = np.zeros(1 << (bits - 3), np.uint8)
    for piece, held in pieces.toLocalIterator():
        # pieces and the places in them are counted from 1
        first = (piece - 1) * _BUCKET // 8
        out[first : first + len(held)] = np.frombuffer(held, np.uint8)
    return out


def _known(held: np.ndarray, bits: int, h: np.ndarray) -> np.ndarray:
    """Which hashes may be of words."""
    first, second = _positions(h, bits)
    hit = np.flatnonzero((held[first >> 3] >> (first & 7).astype(np.uint8)) & 1)
    return hit[((held[second[hit] >> 3] >> (second[hit] & 7).astype(np.uint8)) & 1).astype(bool)]


def neighbourhood(letters: np.ndarray, alphabet: np.ndarray, keep) -> Iterator[tuple[int, bytes]]:  # noqa: ANN001
    """The row and the string of each distinct deletion, replacement and insertion of which ``keep(hashes)`` gives the index.

    Where neighbouring letters are equal, the same deletion and insertion arise at several places; the first counts.
    """
    sums, powers = _prefixes(letters)
    m, length = letters.shape
    whole, codes = sums[:, -1:], _LETTER[alphabet]
    # what follows a place, as it hashes one place further on or back
    step = max(1, AT_ONCE // (m * max(1, len(alphabet))))
    for a in range(0, length + 1, step):
        b = min(length + 1, a + step)
        before, place = sums[:, a:b], powers[a:b]
        again = np.zeros((m, b - a), bool)  # the same letter stands before this place
        e = min(b, length)
        if e > a:
            here = letters[:, a:e]
            again[:, max(0, 1 - a) : e - a] = letters[:, max(a, 1) : e] == letters[:, max(a, 1) - 1 : e - 1]
            h = before[:, : e - a] + (whole - sums[:, a + 1 : e + 1]) * _INVERSE
            row, i = np.nonzero(~again[:, : e - a])
            for k in keep(h[row, i]):
                r, p = row[k], a + i[k]
                yield r, letters[r, :p].tobytes() + letters[r, p + 1 :].tobytes()
            h = (whole - _LETTER[here] * place[: e - a])[:, :, None] + codes * place[: e - a, None]
            row, i, c = np.nonzero(here[:, :, None] != alphabet)
            for k in keep(h[row, i, c]):
                r, p = row[k], a + i[k]
                yield r, letters[r, :p].tobytes() + alphabet[c[k] : c[k] + 1].tobytes() + letters[r, p + 1 :].tobytes()
        h = (before + (whole - before) * np.uint64(_PRIME))[:, :, None] + codes * place[:, None]
        new = np.ones((m, b - a, len(alphabet)), bool)
        first = max(0, 1 - a)
        new[:, first:] = letters[:, a + first - 1 : b - 1, None] != alphabet
        row, i, c = np.nonzero(new)
        for k in keep(h[row, i, c]):
            r, p = row[k], a + i[k]
            yield r, letters[r, :p].tobytes() + alphabet[c[k] : c[k] + 1].tobytes() + letters[r, p:].tobytes()


def candidates(vocabulary: DataFrame, alphabet: str, held: Broadcast, bits: int) -> DataFrame:
    """``word`` and ``candidate``: the neighbours of each word but those that the bitmap knows to be no words."""
    letters_of = np.frombuffer(alphabet.encode("latin-1"), np.uint8)

    def generate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = lambda h: _known(held.value, bits, h)
        most = max(1, AT_ONCE // max(1, len(letters_of)))
        for batch in batches:
            for letters in _matrices(batch.column("word"), most):
                word, near = [], []
                for r, s in neighbourhood(letters, letters_of, keep):
                    word.append(letters[r].tobytes().decode("latin-1"))
                    near.append(s.decode("latin-1"))
                yield pa.RecordBatch.from_pydict({"word": pa.array(word, pa.string()), "candidate": pa.array(near, pa.string())})

    return vocabulary.select("word").mapInArrow(generate, "word string, candidate string")


def near_words(vocabulary: DataFrame) -> DataFrame:
    """``word``, ``near``, ``near_n``: the words of ``vocabulary`` (``word``, ``n``; each word once) one edit apart, both ways."""
    spark = vocabulary.sparkSession
    # at most 90 letters, however large the vocabulary is
    letters = sorted(r.c for r in vocabulary.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c")).where("c <> ''").distinct().collect())
    size = vocabulary.count()
    bits = min(MOST_BITS, max(LEAST_BITS, (size * BITS_PER_WORD).bit_length()))
    # a word's neighbourhood is much work for few bytes, so tasks take so many words, whatever the table's files are
    found = candidates(vocabulary.select("word").repartition(size // WORDS_A_TASK + 1), "".join(letters), spark.sparkContext.broadcast(bitmap(vocabulary, bits)), bits)
    known = vocabulary.select(F.col("word").alias("candidate"), F.col("n").alias("near_n"))
    return found.join(known, "candidate").select("word", F.col("candidate").alias("near"), "near_n")


def _roots(forms: DataFrame, most: int) -> DataFrame:
    """``word`` and ``root``: the last form that is reached from each word of ``forms`` (``word``, ``form``).

    A form is ``most`` times rarer at least with each step back, so chains are short; each round doubles what it follows.
    """
    reached, steps, depth = forms.select("word", F.col("form").alias("root")), 1, max(1, most)
    while steps < depth:
        onward = reached.select(F.col("word").alias("root"), F.col("root").alias("next"))
        reached = store(reached.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")
        steps *= 2
    return reached


def spelling_variants(docs: DataFrame, key: str = "doc_id", text: str = "text", least_letters: int = 7, least_count: int = 2, ratio: int = 10, mutate: int | None = None) -> DataFrame:
    """One row for each word (see ``words``): ``word, n, n_near, form, form_n, root``.

    Two words are near if one inserted, deleted or replaced letter makes one of the other; ``n_near`` counts them.  ``form``
    is the near word with the largest count, of equally frequent ones the first by code points, if that count is at least
    ``ratio`` (2 or more) times the word's; else it and ``form_n`` are null.  ``root`` follows forms to the last.

    Null and empty texts have no words, repeated rows count each, other columns are ignored; an empty table gives no rows.
    Texts and words of any length take part; a word's neighbourhood is worked out a stretch at a time.
    """
    if ratio < 2:
        raise ValueError("ratio must be 2 or more, or forms could lead in circles")
    vocabulary = store(words(docs, key, text, least_letters, least_count, mutate), "vocabulary")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near"))
    of_word = near_words(vocabulary).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    joined = vocabulary.join(of_word, "word", "left")
    formed = F.col("best.less") <= -ratio * F.col("n")
    linked = store(
        joined.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(formed, F.col("best.near")).alias("form"), F.when(formed, -F.col("best.less")).alias("form_n")),
        "linked",
    )
    highest, depth = linked.agg(F.max("n")).first()[0] or 1, 0
    while highest >= least_count * ratio:
        highest, depth = highest // ratio, depth + 1
    roots = _roots(linked.where("form is not null").select("word", "form"), depth)
    return linked.join(roots, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
