"""Language-model scores by a hashed maximum-entropy model with a class-factored softmax.

The last two bytes of a word (its ending) give its class, the hash of all of it its member number in the class.  Words with
one ending are mostly of one language, script and part of speech, so what stands before tells more of such classes than of
classes by hash alone.  P(class | context) and P(member | class, context) are log-linear in hashed features of the context:
the word before, its ending, the endings of the two before, and the ending of the one two before (a skip).  P(word | member)
comes from discounted counts, with one symbol for all unknown words, so the whole is a distribution over the training
vocabulary and that symbol.

Word counts are exact: each group of documents sends its distinct words to their counts and gets these back, so neither
the vocabulary nor a text is ever in one place.  Weights are trained by rounds of distributed gradient updates: every
shard descends from the weights sent out and Spark sums its changes, parameter by parameter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import _text as tx
from ._scratch import store

#: Classes, and members of each, as bits of the hash; hashed contexts of each feature, as bits.
CLASS_BITS, MEMBER_BITS, CONTEXT_BITS = 6, 2, 11
CLASSES, MEMBERS, CONTEXTS = 1 << CLASS_BITS, 1 << MEMBER_BITS, 1 << CONTEXT_BITS
FEATURES = 4
#: Low bits of a token that hold its ending, hashed; the others hold the hash of the word.
ENDING = np.uint64((1 << 12) - 1)
#: Bytes of text in a group of documents, whose distinct words travel together.
GROUP_BYTES = 16 << 20
DISCOUNT = 0.6
END = np.uint64(0x5851F42D4C957F2D)
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += np.uint64(32)
_SALT = (np.arange(FEATURES, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Model:
    """``by_class``: feature, context, class; ``by_member``: feature, context with class, member; ``tokens``, ``kinds``:
    training tokens and distinct ones of each bucket (class, member)."""

    by_class: np.ndarray
    by_member: np.ndarray
    tokens: np.ndarray
    kinds: np.ndarray

    def priors(self) -> tuple[np.ndarray, np.ndarray]:
        n = self.tokens.reshape(CLASSES, MEMBERS) + 1.0
        return np.log(n.sum(1) / n.sum()).astype(np.float32), np.log(n / n.sum(1, keepdims=True)).astype(np.float32)


def _tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's words and then its end, as hashes with the ending in the low bits, and the rows' bounds."""
    starts, ends, bounds = tx.spans(data, offsets, tx.SPACE)
    h = tx.hash_spans(data, starts, ends, fold=True)
    last = _LOWER[data[ends - 1]]
    before = np.where(ends - starts > 1, _LOWER[data[np.maximum(ends - 2, 0)]], np.uint64(0))
    h = (h & ~ENDING) | (tx.mix(last * np.uint64(256) + before + np.uint64(1)) & ENDING)
    out = np.full(len(h) + len(bounds) - 1, END, np.uint64)
    out[np.arange(len(h)) + tx.rows_of(bounds)] = h
    return out, bounds + np.arange(len(bounds))


def _outcome(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (tx.mix(h & ENDING) >> np.uint64(64 - CLASS_BITS)).astype(np.int64), (tx.mix(h.copy()) >> np.uint64(64 - MEMBER_BITS)).astype(np.int64)


def _contexts(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Feature keys (token, feature) of what stands before each token of its row."""
    one, two = np.zeros_like(h), np.zeros_like(h)
    one[1:], two[2:] = h[:-1], h[:-2]
    first = bounds[:-1][bounds[:-1] < len(h)]
    one[first] = two[first] = 1
    second = first + 1
    two[second[second < len(h)]] = 1
    near, far = one & ENDING, two & ENDING
    return np.stack([one, near, near * (ENDING + np.uint64(1)) + far, far], 1) + _SALT


def _places(keys: np.ndarray, classes: np.ndarray | None = None) -> np.ndarray:
    k = keys if classes is None else keys + (classes.astype(np.uint64)[:, None] + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F)
    return (tx.mix(k.copy()) >> np.uint64(64 - CONTEXT_BITS)).astype(np.int64) + np.arange(FEATURES) * CONTEXTS


def _softmax(weights: np.ndarray, at: np.ndarray, prior: np.ndarray) -> np.ndarray:
    """Probabilities of the outcomes; ``weights`` has a row for each feature's context."""
    z = prior + weights[at[:, 0]]
    for k in range(1, FEATURES):
        z += weights[at[:, k]]
    z -= z.max(1, keepdims=True)
    np.exp(z, out=z)
    z /= z.sum(1, keepdims=True)
    return z


def _descend(m: Model, parts: Iterator[tuple[np.ndarray, np.ndarray]], rate: float, batch: int) -> tuple[np.ndarray, int]:
    """Adagrad over the tokens of a shard: the changes of all weights, flat, and the number of tokens."""
    w = [m.by_class.reshape(-1, CLASSES).copy(), m.by_member.reshape(-1, MEMBERS).copy()]
    begun = [x.copy() for x in w]
    seen = [np.full_like(x, 1e-4) for x in w]
    prior, inner = m.priors()
    n = 0
    for h, bounds in parts:
        classes, members = _outcome(h)
        keys = _contexts(h, bounds)
        for a in range(0, len(h), batch):
            c, y, k = classes[a : a + batch], members[a : a + batch], keys[a : a + batch]
            for j, (at, before, target) in enumerate(((_places(k), prior, c), (_places(k, c), inner[c], y))):
                p = _softmax(w[j], at, before)
                p[np.arange(len(p)), target] -= 1
                width = p.shape[1]
                flat = (at[:, :, None] * width + np.arange(width)).ravel()
                g = np.bincount(flat, np.repeat(p, FEATURES, axis=0).ravel(), minlength=w[j].size).reshape(w[j].shape).astype(np.float32)
                seen[j] += g * g
                w[j] -= rate * g / np.sqrt(seen[j])
        n += len(h)
    return np.concatenate([(x - b).ravel() for x, b in zip(w, begun, strict=True)]), n


def _log10_outcomes(m: Model, h: np.ndarray, bounds: np.ndarray, batch: int = 1 << 15) -> np.ndarray:
    """The model's log10 P(class, member | context) of each token."""
    prior, inner = m.priors()
    classes, members = _outcome(h)
    keys = _contexts(h, bounds)
    out = np.empty(len(h))
    for a in range(0, len(h), batch):
        c, y, k = classes[a : a + batch], members[a : a + batch], keys[a : a + batch]
        rows = np.arange(len(c))
        p = _softmax(m.by_class, _places(k), prior)[rows, c].astype(float)
        q = _softmax(m.by_member, _places(k, c), inner[c])[rows, y].astype(float)
        out[a : a + batch] = np.log10(np.maximum(p, 1e-30)) + np.log10(np.maximum(q, 1e-30))
    return out


def _grouped(docs: DataFrame) -> DataFrame:
    """``docs`` (key, train, _text) stored with a group number: rows of a partition in order, GROUP_BYTES at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, held = TaskContext.get().partitionId() << 24, 0
        for block, data, _ in tx.blocks(batches, "_text"):
            if held and held + len(data) > GROUP_BYTES:
                g, held = g + 1, 0
            held += len(data)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(block.num_rows, g)), *block.columns], ["g", *block.schema.names])

    kind = docs.schema["key"].dataType.simpleString()
    return store(docs.mapInArrow(run, f"g long, key {kind}, train boolean, _text string"), "groups")


def _counted(groups: DataFrame, n_groups: int) -> DataFrame:
    """For each group: its distinct tokens and their training counts, packed (g, h, c).

    Rows with a null ``g`` hold training tokens (n) and distinct ones (v) of a bucket, to be summed.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, size = -1, [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            h = np.concatenate([x for x, _ in held])
            train = np.concatenate([y for _, y in held])
            kinds, which = np.unique(h, return_inverse=True)
            n = np.bincount(which, train, len(kinds)).astype(np.int64)
            to = (tx.mix(kinds.copy()) % np.uint64(n_groups)).astype(np.int64)
            order = np.argsort(to, kind="stable")
            kinds, n, to = kinds[order], n[order], to[order]
            cut = np.append(np.flatnonzero(np.append(True, to[1:] != to[:-1])), len(to))
            pieces = list(zip(cut[:-1], cut[1:], strict=True))
            yield pa.RecordBatch.from_arrays([
                pa.array(to[cut[:-1]]), pa.array([now] * len(pieces), pa.int64()),
                pa.array([kinds[a:b].tobytes() for a, b in pieces], pa.binary()), pa.array([n[a:b].tobytes() for a, b in pieces], pa.binary())], ["part", "g", "h", "n"])
            held.clear()

        for block, data, offsets in tx.blocks(batches, "_text"):
            of = block.column(0).to_numpy()
            h, bounds = _tokens(data, offsets)
            train = np.repeat(block.column(2).to_numpy(zero_copy_only=False).astype(float), np.diff(bounds))
            edge = np.append(np.flatnonzero(np.append(True, of[1:] != of[:-1])), len(of))
            for a, b in zip(edge[:-1], edge[1:], strict=True):
                if held and (of[a] != now or size > GROUP_BYTES):
                    yield from flush()
                    size = 0
                now = int(of[a])
                held.append((h[bounds[a] : bounds[b]], train[bounds[a] : bounds[b]]))
                size += int(offsets[b] - offsets[a])
        if held:
            yield from flush()

    def count(table: pa.Table) -> pa.Table:
        gs = table.column("g").to_pylist()
        hs = [np.frombuffer(x, np.uint64) for x in table.column("h").to_pylist()]
        ns = [np.frombuffer(x, np.int64) for x in table.column("n").to_pylist()]
        kinds, which = np.unique(np.concatenate(hs), return_inverse=True)
        total = np.bincount(which, np.concatenate(ns), len(kinds)).astype(np.int64)
        at = np.append(0, np.cumsum([len(x) for x in hs]))
        back = [total[which[a:b]].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
        known = total > 0
        c, y = _outcome(kinds[known])
        bucket = c * MEMBERS + y
        v = np.bincount(bucket, minlength=CLASSES * MEMBERS)
        n = np.bincount(bucket, total[known], CLASSES * MEMBERS).astype(np.int64)
        some = np.flatnonzero(v)
        return pa.table({
            "g": pa.array([*gs, *[None] * len(some)], pa.int64()), "h": pa.array([*(x.tobytes() for x in hs), *[None] * len(some)], pa.binary()), "c": pa.array([*back, *[None] * len(some)], pa.binary()),
            "bucket": pa.array([*[None] * len(gs), *some.tolist()], pa.int32()), "n": pa.array([*[None] * len(gs), *n[some].tolist()], pa.int64()), "v": pa.array([*[None] * len(gs), *v[some].tolist()], pa.int64()),
        })

    sent = groups.mapInArrow(send, "part long, g long, h binary, n binary")
    return store(sent.groupBy("part").applyInArrow(count, "g long, h binary, c binary, bucket int, n long, v long"), "counts")


def _train(groups: DataFrame, tokens: np.ndarray, kinds: np.ndarray, n_groups: int, rounds: int, rate: float, batch: int) -> Model:
    size = FEATURES * CONTEXTS
    m = Model(np.zeros((size, CLASSES), np.float32), np.zeros((size, MEMBERS), np.float32), tokens, kinds)
    shards = max(12, n_groups // 4)
    for k in range(rounds):
        sent = groups.sparkSession.sparkContext.broadcast(m)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            change, n = _descend(sent.value, (_tokens(data, offsets) for _, data, offsets in tx.blocks(batches, "_text")), rate, batch)
            some = np.flatnonzero(change)
            if n:
                yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1), pa.int32()), pa.array(np.append(change[some].astype(float) * n, n))], ["i", "x"])

        part = groups.where("train").where(F.pmod(F.xxhash64(F.coalesce("_text", F.lit(""))), F.lit(rounds)) == k)
        # as many rows as there are weights
        got = part.coalesce(shards).mapInArrow(run, "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).toPandas()
        change = np.zeros(size * (CLASSES + MEMBERS))
        weight = float(got.loc[got["i"] == -1, "x"].sum())
        if weight:
            some = got[got["i"] >= 0]
            change[some["i"].to_numpy()] = some["x"].to_numpy() / weight
            m.by_class += change[: size * CLASSES].reshape(-1, CLASSES).astype(np.float32)
            m.by_member += change[size * CLASSES :].reshape(-1, MEMBERS).astype(np.float32)
        sent.unpersist()
    return m


def score_texts(docs: DataFrame, train: str = "train", key: str = "doc_id", text: str = "text", rounds: int = 2, rate: float = 0.1, batch: int = 4096) -> DataFrame:
    """Log probabilities of the text of every row, learned from the rows whose column ``train`` is true.

    Lower-cases A-Z; tokens are the words ``[^\\x20\\x09-\\x0D]+``, then one end.  Returns ``key``, ``n_tokens``,
    ``n_known`` (tokens that training has), ``train_tokens`` (N), ``base_score`` (sum of log10((c + 1) / (N + V + 1)) over
    the tokens; c: the token's training count, V: distinct training tokens) and ``score`` (the model's log10 probability of
    the tokens).

    Null and empty texts are an end alone.  A null ``train`` is false.  Without training rows N and V are 0.  Repeated
    rows count each time and keys need not be unique; an empty table gives an empty one; other columns are ignored.
    """
    groups = _grouped(docs.select(docs[key].alias("key"), F.coalesce(docs[train], F.lit(False)).alias("train"), docs[text].cast("string").alias("_text")))
    n_groups = max(1, groups.select("g").distinct().count())
    counts = _counted(groups, n_groups)
    tokens, kinds = (np.zeros(CLASSES * MEMBERS) for _ in range(2))
    for row in counts.where("g is null").groupBy("bucket").agg(F.sum("n"), F.sum("v")).collect():  # a row for each bucket
        tokens[row[0]], kinds[row[0]] = row[1], row[2]
    sent = docs.sparkSession.sparkContext.broadcast(_train(groups, tokens, kinds, n_groups, rounds, rate, batch))
    names = ["key", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    schema = pa.schema([("key", to_arrow_type(groups.schema["key"].dataType)), *((x, pa.int64()) for x in names[1:4]), *((x, pa.float64()) for x in names[4:])])

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        m = sent.value
        total, vocabulary = float(m.tokens.sum()), float(m.kinds.sum())
        h = np.concatenate([np.empty(0, np.uint64), *(np.frombuffer(x, np.uint64) for x in right.column("h").to_pylist())])
        c = np.concatenate([np.empty(0, np.int64), *(np.frombuffer(x, np.int64) for x in right.column("c").to_pylist())])
        order = np.argsort(h)
        h, c = h[order], c[order]
        out = []
        for block, data, offsets in tx.blocks(iter(left.to_batches()), "_text"):
            t, bounds = _tokens(data, offsets)
            n = c[np.searchsorted(h, t)].astype(float)
            base = np.log10((n + 1) / (total + vocabulary + 1))
            classes, members = _outcome(t)
            bucket = classes * MEMBERS + members
            size, kinds_in = m.tokens[bucket], m.kinds[bucket]
            # discounted counts; without any, the bucket is the unknown symbol alone
            word = np.where(n > 0, n - DISCOUNT, DISCOUNT * kinds_in) / np.maximum(size, 1)
            word = np.where(size > 0, word, 1.0)
            full = _log10_outcomes(m, t, bounds) + np.log10(word)
            columns = [block.column(1), np.diff(bounds), tx.per_row(n > 0, bounds), np.full(block.num_rows, int(total)), tx.per_row(base, bounds), tx.per_row(full, bounds)]
            out.append(pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns], names))
        return pa.Table.from_batches(out, out[0].schema) if out else schema.empty_table()

    kind = groups.schema["key"].dataType.simpleString()
    both = groups.groupBy("g").cogroup(counts.where("g is not null").select("g", "h", "c").groupBy("g"))
    return both.applyInArrow(score, f"key {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double").withColumnRenamed("key", key)
