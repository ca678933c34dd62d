"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts are summed by Spark over all training rows; the matrix of log probabilities, of a size fixed by the number of
languages and buckets, is broadcast; texts are scored in numpy, one gather for each n-gram.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _text as tx

#: Buckets for each length, and lengths of n-grams.
BITS = 15
LENGTHS = (1, 2, 3)
#: Languages at most; the model has ``MAX_LANGUAGES << BITS`` values for each length at most.
MAX_LANGUAGES = 512

_CODES = 0x3000
_fold: np.ndarray | None = None


def _folds() -> np.ndarray:
    """For each code point under 0x3000: 0 if no letter, else its lower case (the first code point of that)."""
    global _fold
    if _fold is None:
        _fold = np.array([ord(chr(i).lower()[0]) if chr(i).isalpha() else 0 for i in range(_CODES)], np.uint32)
    return _fold


def _letters(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Folded code points (0: no letter) and the rows' bounds in them."""
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "replace"), np.uint32)
    head = np.zeros(len(data) + 1, np.int64)
    np.cumsum(tx.code_points(data), out=head[1:])
    out = _folds()[np.minimum(points, _CODES - 1)]
    high = np.flatnonzero(points >= _CODES)
    if len(high):
        kinds, back = np.unique(points[high], return_inverse=True)
        out[high] = np.array([x if unicodedata.category(chr(x))[0] == "L" else 0 for x in kinds.tolist()], np.uint32)[back]
    return out, head[offsets]


def _grams(letters: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length, buckets of the n-grams and the rows' bounds among them.

    Runs of what is no letter count as one space; n-grams of one space alone are left out.
    """
    keep = letters > 0
    keep[1:] |= letters[:-1] > 0
    keep[bounds[:-1][bounds[:-1] < len(keep)]] = True
    sums = np.zeros(len(keep) + 1, np.int64)
    np.cumsum(keep, out=sums[1:])
    code, edge = letters[keep].astype(np.uint64), sums[bounds]
    end = np.repeat(edge[1:], np.diff(edge))
    h = np.zeros(len(code), np.uint64)
    for n in range(1, max(LENGTHS) + 1):
        m = max(0, len(code) - n + 1)
        h = h[:m] * np.uint64(0x100000001B3) + code[n - 1 :]
        if n in LENGTHS:
            ok = np.arange(n, m + n) <= end[:m]
            if n == 1:
                ok &= code > 0
            seen = np.zeros(m + 1, np.int64)
            np.cumsum(ok, out=seen[1:])
            yield ((h[ok] * np.uint64(0x9E3779B97F4A7C15 + 2 * n)) >> np.uint64(64 - BITS)).astype(np.int64), seen[np.minimum(edge, m)]


@dataclass
class LanguageModel:
    """``weights[k][bucket, language]``: log probabilities for the k-th length; ``prior``: the languages' own."""

    languages: list[str]
    prior: np.ndarray
    weights: list[np.ndarray]


def train(rows: DataFrame, text: str = "text", lang: str = "lang", alpha: float = 0.1, max_languages: int = MAX_LANGUAGES) -> LanguageModel:
    """Fit on all ``rows`` with a language.  Empty or null texts count for the prior alone.

    Over ``max_languages`` languages raise: the matrix would outgrow its bound.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        seen: dict[str, int] = {}
        for block, data, offsets in tx.blocks(batches, "_text"):
            code = block.column(0).dictionary_encode()
            names, of = code.dictionary.to_pylist(), code.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            for i, n in enumerate(np.bincount(of, minlength=len(names)).tolist()):
                seen[names[i]] = seen.get(names[i], 0) + n
            letters, bounds = _letters(data, offsets)
            for k, (bucket, edge) in enumerate(_grams(letters, bounds)):
                both = bucket + (np.repeat(of, np.diff(edge)) << BITS)
                counts = np.bincount(both, minlength=len(names) << BITS).reshape(len(names), -1)
                for i, name in enumerate(names):
                    sums.setdefault(name, np.zeros((len(LENGTHS), 1 << BITS), np.int64))[k] += counts[i]
        for name, total in seen.items():
            flat = sums.get(name, np.zeros((len(LENGTHS), 1 << BITS), np.int64)).ravel()
            at = np.flatnonzero(flat)
            yield pa.RecordBatch.from_arrays([pa.array([name] * (len(at) + 1), pa.string()), pa.array(np.append(at, -1), pa.int64()), pa.array(np.append(flat[at], total), pa.int64())], ["lang", "bucket", "n"])

    named = rows.where(F.col(lang).isNotNull()).select(F.col(lang).cast("string").alias("_lang"), F.col(text).cast("string").alias("_text"))
    counts = named.mapInArrow(run, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    # a row for each language, with its counts packed: as many as there are languages, checked against the bound
    packed = counts.groupBy("lang").agg(F.collect_list(F.struct("bucket", "n")).alias("c")).limit(max_languages + 1)
    totals: dict[str, np.ndarray] = {}
    seen: dict[str, int] = {}
    for table in packed.toLocalIterator():
        c = np.array([(x[0], x[1]) for x in table["c"]], np.int64).reshape(-1, 2)
        full = np.zeros(len(LENGTHS) << BITS, np.int64)
        full[c[c[:, 0] >= 0, 0]] = c[c[:, 0] >= 0, 1]
        totals[table["lang"]], seen[table["lang"]] = full, int(c[c[:, 0] < 0, 1].sum())
    if len(totals) > max_languages:
        raise ValueError(f"more than {max_languages} languages to learn")
    languages = sorted(totals)
    if not languages:
        return LanguageModel([], np.empty(0), [])
    table = np.stack([totals[x] for x in languages], 1).reshape(len(LENGTHS), 1 << BITS, -1) + alpha
    prior = np.array([seen[x] for x in languages], float)
    return LanguageModel(languages, np.log(prior / prior.sum()), [np.log(t / t.sum(0)).astype(np.float32) for t in table])


def predict(docs: DataFrame, model: LanguageModel, key: str | Column = "doc_id", text: str = "text") -> DataFrame:
    """The likeliest language of every row: its key, ``lang_pred``, ``score`` (its posterior, 0 to 1) and ``n_grams``.

    ``lang_pred`` is ``und`` with score 0 where the text is null or has no letter, or nothing was learned.  Ties take the
    first name in order.  Rows are scored one by one: repeats give repeats, an empty table gives an empty one.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for block, data, offsets in tx.blocks(batches, "_text"):
            n = block.num_rows
            letters, bounds = _letters(data, offsets)
            grams = np.zeros(n, np.int64)
            total = np.tile(m.prior, (n, 1)) if m.languages else np.zeros((n, 1))
            for k, (bucket, edge) in enumerate(_grams(letters, bounds)):
                grams += np.diff(edge)
                if m.languages and len(bucket):
                    full = np.flatnonzero(np.diff(edge))
                    total[full] += np.add.reduceat(np.take(m.weights[k], bucket, axis=0), edge[:-1][full], axis=0, dtype=np.float64)
            best = total.argmax(1)
            score = 1 / np.exp(total - total.max(1, keepdims=True)).sum(1)
            und = tx.per_row(letters > 0, bounds) == 0 if m.languages else np.ones(n, bool)
            names = np.array([*m.languages, "und"], object)[np.where(und, len(m.languages), best)]
            yield pa.RecordBatch.from_arrays([block.column(0), pa.array(names, pa.string()), pa.array(np.where(und, 0.0, score)), pa.array(grams)], ["key", "lang_pred", "score", "n_grams"])

    by = docs[key] if isinstance(key, str) else key
    frame = docs.select(by.alias("key"), docs[text].cast("string").alias("_text"))
    out = frame.mapInArrow(run, f"key {frame.schema['key'].dataType.simpleString()}, lang_pred string, score double, n_grams long")
    return out.withColumnRenamed("key", key) if isinstance(key, str) else out
