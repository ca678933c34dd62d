"""Toxic passages by maximum-scoring segments of token log-odds.

Each word's log-odds come from labelled counts under a chain of Dirichlet priors: the word's counts are drawn to those of
its first 7 bytes, these to the first 6, and so on to the corpus.  Log-odds are capped and shifted, so that an ordinary
word scores below zero; a linear scan then finds every maximal segment of a text.  Karlin-Altschul extreme-value
statistics of untoxic texts turn a segment's score and the text's length into an expected number of chance segments as
high; a logistic curve over the best segment's extreme-value score gives the document's score.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as tx

#: Labelled rows that training uses at most; they are chosen by a hash of the key, alike at every size.
MAX_TRAINING = 200_000
#: Buckets of each level's counts, and the leading bytes of a word that its levels take; the last is the whole word.
BITS = 20
LEVELS = (4, 5, 6, 7, 1 << 30)
#: Strength of each level's prior, in words.
STRENGTH = 5.0
CAP, SHIFT = 16.0, 2.0
_BLOCK = 16
_GRID = np.arange(1, 33) / 10
_EULER = 0.5772156649


@dataclass
class ToxicityModel:
    toxic: np.ndarray  # level, bucket: words of toxic rows
    words: np.ndarray  # the same of all rows
    base: float  # fraction of words in toxic rows
    rate: float = 1.0  # the extreme-value rate (lambda)
    size: float = 0.0  # log of the extreme-value size constant (log K)
    slope: float = 0.0
    offset: float = 0.0

    def extreme(self, best: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Extreme-value score: minus the log of the number of chance segments as high in ``n`` words."""
        return self.rate * best - self.size - np.log(np.maximum(n, 1))

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * x + self.offset, -500, 500)))


def _buckets(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    return [(tx.hash_spans(data, starts, np.minimum(ends, starts + n), fold=True) >> np.uint64(64 - BITS)).astype(np.int64) for n in LEVELS]


def word_scores(m: ToxicityModel, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    f = np.full(len(starts), m.base)
    for k, b in enumerate(_buckets(data, starts, ends)):
        f = (m.toxic[k][b] + STRENGTH * f) / (m.words[k][b] + STRENGTH)
    f = np.clip(f, 1e-12, 1 - 1e-12)
    return np.minimum(np.log(f / (1 - f)) - np.log(m.base / (1 - m.base)), CAP) - SHIFT


def maximal_segments(score: np.ndarray) -> list[tuple[int, int, float]]:
    """Every maximal scoring segment (start, end, score) of a sequence, in order, in linear time.

    Only words above zero are visited; each keeps the total before and after it.  A segment joins the nearest earlier one
    whose total before it is lower, if its own total after it is higher.
    """
    total = np.concatenate([[0.0], np.cumsum(score)])
    out: list[tuple[int, int, float, float]] = []  # start, end, total before, total after
    below: list[int] = []  # for each of ``out``, the nearest earlier one with a lower total before
    for i in np.flatnonzero(score > 0).tolist():
        start, end, left, right = i, i + 1, total[i], total[i + 1]
        while True:
            j = len(out) - 1
            while j >= 0 and out[j][2] >= left:
                j = below[j]
            if j < 0 or out[j][3] >= right:
                out.append((start, end, left, right))
                below.append(j)
                break
            start, left = out[j][0], out[j][2]
            del out[j:], below[j:]
    return [(a, b, float(r - x)) for a, b, x, r in out]


def _counts(labelled: DataFrame) -> ToxicityModel:
    """``labelled``: _text, _toxic."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: list[dict[str, np.ndarray]] = []
        held: list[list[np.ndarray]] = [[] for _ in LEVELS]

        def flush() -> Iterator[pa.RecordBatch]:
            for k, parts in enumerate(held):
                if not parts:
                    continue
                both, n = np.unique(np.concatenate(parts), return_counts=True)
                block = both >> (_BLOCK + 1)
                cut = np.append(np.flatnonzero(np.append(True, block[1:] != block[:-1])), len(both))
                for a, b in zip(cut[:-1], cut[1:], strict=True):
                    yield pa.RecordBatch.from_arrays([
                        pa.array([k << 16 | int(block[a])], pa.int64()), pa.array([(both[a:b] & ((2 << _BLOCK) - 1)).astype(np.uint32).tobytes()], pa.binary()),
                        pa.array([n[a:b].astype(np.uint32).tobytes()], pa.binary())], ["part", "at", "n"])
                parts.clear()

        words = 0
        for block, data, offsets in tx.blocks(batches, "_text"):
            starts, ends, bounds = tx.spans(data, offsets, tx.NOT_ALNUM)
            label = np.repeat(block.column(1).to_numpy(zero_copy_only=False).astype(np.int64), np.diff(bounds))
            for k, b in enumerate(_buckets(data, starts, ends)):
                held[k].append(b << 1 | label)
            words += len(starts)
            if words > 4_000_000:
                yield from flush()
                words = 0
        yield from flush()

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(2 << _BLOCK, np.int64)
        for at, n in zip(pdf["at"], pdf["n"], strict=True):
            total[np.frombuffer(at, np.uint32)] += np.frombuffer(n, np.uint32)
        # most buckets of most inputs are empty, and one task may hold all parts
        return pd.DataFrame({"part": [pdf["part"].iloc[0]], "total": [zlib.compress(total.astype(np.float32).tobytes(), 1)]})

    # the groups are blocks of buckets: their rows are bounded by MAX_TRAINING
    sums = labelled.mapInArrow(run, "part long, at binary, n binary").groupBy("part").applyInPandas(add, "part long, total binary")
    toxic, words = (np.zeros((len(LEVELS), 1 << BITS), np.float32) for _ in range(2))
    for part, total in sums.toLocalIterator():
        k, lo = part >> 16, (part & 0xFFFF) << _BLOCK
        pair = np.frombuffer(zlib.decompress(total), np.float32).reshape(-1, 2)
        toxic[k, lo : lo + (1 << _BLOCK)] = pair[:, 1]
        words[k, lo : lo + (1 << _BLOCK)] = pair.sum(1)
    all_words = float(words[-1].sum())
    return ToxicityModel(toxic, words, min(max(float(toxic[-1].sum()) / max(all_words, 1), 1e-6), 1 - 1e-6))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> tuple[float, float]:
    """Slope and offset of the likeliest logistic curve, the slope of standardised ``x`` drawn to zero by ``ridge``.

    Newton steps, halved until the penalised likelihood rises, so that separable labels converge too.
    """
    mean, width = float(x.mean()), float(x.std()) or 1.0
    z = (x - mean) / width
    w = np.array([0.0, np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))])

    def loss(w: np.ndarray) -> float:
        t = w[0] * z + w[1]
        return float((np.logaddexp(0, t) - y * t).sum() + ridge * w[0] ** 2 / 2)

    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(w[0] * z + w[1], -500, 500)))
        v = p * (1 - p)
        g = np.array([((p - y) * z).sum() + ridge * w[0], (p - y).sum()])
        h = np.array([[(v * z * z).sum() + ridge, (v * z).sum()], [(v * z).sum(), v.sum() + 1e-9]])
        step, rate, now = np.linalg.solve(h, g), 1.0, loss(w)
        while rate > 1e-9 and loss(w - rate * step) > now:
            rate /= 2
        w = w - rate * step
        if np.abs(rate * step).max() < 1e-7:
            break
    return float(w[0] / width), float(w[1] - w[0] * mean / width)


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", max_training: int = MAX_TRAINING) -> ToxicityModel:
    """Fit on ``docs`` joined to ``labels`` (``key``, ``label`` 0 or 1).

    Labels that are null are left out; of repeated keys the highest label holds.  Over ``max_training`` labelled keys are
    thinned by a hash of the key, so what is broadcast is bounded (16 bytes a key).  A fifth of them, by a hash of the
    text, calibrates; the others are counted.  Without labelled rows, every score is 0.
    """
    known = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(key).alias("_key")).agg((F.max(label) > 0).cast("int").alias("_toxic"))
    share = min(1.0, max_training / max(1, known.count()))
    some = known.where(F.pmod(F.xxhash64("_key"), F.lit(1 << 20)) < int(share * (1 << 20)))
    rows = docs.select(docs[key].alias("_key"), docs[text].cast("string").alias("_text")).join(F.broadcast(some), "_key")
    fold = F.pmod(F.xxhash64(F.coalesce("_text", F.lit(""))), F.lit(5)) == 0
    model = _counts(rows.where(~fold).select("_text", "_toxic"))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, data, offsets in tx.blocks(batches, "_text"):
            starts, ends, bounds = tx.spans(data, offsets, tx.NOT_ALNUM)
            s = word_scores(sent.value, data, starts, ends)
            total = np.concatenate([[0.0], np.cumsum(s)])
            best = np.array([(total[a : b + 1] - np.minimum.accumulate(total[a : b + 1])).max() for a, b in zip(bounds[:-1], bounds[1:], strict=True)])
            grid = np.stack([tx.per_row(np.exp(g * s), bounds) for g in _GRID], 1)
            yield pa.RecordBatch.from_arrays([block.column(1), pa.array(np.diff(bounds), pa.int64()), pa.array(best), pa.array([g.tobytes() for g in grid], pa.binary())], ["y", "n", "best", "grid"])

    # at most a fifth of max_training keys, give or take; of rows that repeat a key one
    held = rows.where(fold).groupBy("_key").agg(F.max("_text").alias("_text"), F.max("_toxic").alias("_toxic"))
    got = held.select("_text", "_toxic").mapInArrow(run, "y int, n long, best double, grid binary").toPandas()
    sent.unpersist()
    if not len(got):
        model.offset = -500.0
        return model
    y, n, best = got["y"].to_numpy(float), got["n"].to_numpy(float), got["best"].to_numpy()
    clean = (y == 0) & (n > 0)
    if clean.any():
        mean = np.log(np.maximum(np.frombuffer(b"".join(got["grid"][clean]), np.float64).reshape(-1, len(_GRID)).sum(0) / n[clean].sum(), 1e-300))
        above = np.flatnonzero(mean > 0)
        model.rate = float(_GRID[above[0]]) if len(above) else float(_GRID[-1])
        model.size = float((model.rate * best[clean] - np.log(n[clean])).mean() - _EULER)
    model.slope, model.offset = _logistic(model.extreme(best, n), y)
    return model


def score_toxicity(docs: DataFrame, model: ToxicityModel, text: str = "text", significance: float = 1e-3) -> DataFrame:
    """``docs`` with ``toxicity`` (0 to 1) and ``toxic_passages``: every maximal segment with at most ``significance``
    expected chance segments as high in a text as long.

    Passages hold start and end (characters of the text), the segment's score and ``expected``.  Null and empty texts have
    no passage and the score of no evidence.  Rows are scored one by one: ties and repeated rows give equal results, an
    empty table gives an empty one; other columns pass unchanged, and columns of those two names are replaced.
    """
    fresh = ["toxicity", "toxic_passages"]
    rest = docs.drop(*fresh)
    names = rest.columns
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("expected", pa.float64())]))
        for block, data, offsets in tx.blocks(batches, text):
            starts, ends, bounds = tx.spans(data, offsets, tx.NOT_ALNUM)
            s = word_scores(m, data, starts, ends)
            points = np.zeros(len(data) + 1, np.int64)
            np.cumsum(tx.code_points(data), out=points[1:])
            best, found = np.zeros(block.num_rows), []
            for r, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
                segments = maximal_segments(s[a:b])
                passages = []
                for i, j, x in segments:
                    best[r] = max(best[r], x)
                    expected = float(np.exp(min(50.0, -m.extreme(np.array(x), np.array(b - a)))))
                    if expected <= significance:
                        passages.append({"start": int(points[starts[a + i]] - points[offsets[r]]), "end": int(points[ends[a + j - 1]] - points[offsets[r]]), "score": x, "expected": expected})
                found.append(passages)
            score = m.probability(m.extreme(best, np.diff(bounds)))
            yield pa.RecordBatch.from_arrays([*(block.column(k) for k in range(len(names))), pa.array(score), pa.array(found, kind)], [*names, *fresh])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema)
    return rest.mapInArrow(run, f"{schema}, toxicity double, toxic_passages array<struct<start:long,end:long,score:double,expected:double>>")
