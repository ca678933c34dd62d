"""Near-duplicate documents by a chosen-path set-similarity join.

A document is the set of its word shingles.  In each of several independent trees a document goes to the child of a node
that its minwise token (the least shingle under a hash of that branch) names.  A node splits by further tokens while it is
large; small nodes are compared exhaustively.  Two sets of similarity s meet in a child with probability s for each token,
so the trees' number sets the recall.

All steps are joins and groupings.  Equal sets are folded to one class first.  A node's members are first tried against
its least member, which needs one row for each member; nodes whose members then lie in one component need nothing more, so
a large group of near copies never becomes all of its pairs.  Candidates pass an estimate from 64 minwise tokens of a byte
each, which travel with the members, and are then confirmed on the full sets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _text as tx
from ._scratch import drop, store

#: Rows of edges that a task takes at least, unless that would leave cores idle: few edges make few tasks, however many
#: partitions the session has.
TASK_EDGES = 100_000
#: Bits of a bitmap for an id, and its least and greatest size as a power of two (128 KiB and 64 MiB).
BITS_PER_ID, LEAST_BITS, MOST_BITS = 16, 20, 29
#: Minwise tokens of four bytes, one for the root of each tree; tokens of a byte, for splits and for the estimate.
HEADS, TWIGS = 12, 64
_rng = np.random.default_rng(77)
_MULTIPLY = _rng.integers(1, 2**31, HEADS + TWIGS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_ADD = _rng.integers(0, 2**32, HEADS + TWIGS, dtype=np.uint32)


@dataclass(frozen=True)
class Join:
    """Parameters.  ``trees`` (HEADS at most): 0.2 ** trees is the chance to miss a pair of similarity 0.8 outside large
    nodes, 1e-7 with 10.

    ``small``: members that a node compares exhaustively.  A larger node splits by one token, or two in a quarter of the
    nodes: 1.25 children, so that pairs of similarity 0.8 keep meeting and less similar ones die out.  After two splits,
    what fits into ``blocks`` blocks of ``small`` is compared in pairs of blocks; what doesn't splits on, ``depth`` times at
    most, and is then compared so too, so nothing is left out.  ``least``: tokens that must agree before the full sets are
    read; pairs of similarity 0.8 agree in 51 of 64, with a deviation of 3.2, so 36 loses a few in a million of them.
    """

    trees: int = 10
    small: int = 1024
    blocks: int = 8
    depth: int = 12
    least: int = 36
    percent: int = 80


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> list[np.ndarray]:
    """Each row's sorted distinct shingle hashes; a text of fewer words is one shingle, one without words has none."""
    starts, ends, bounds = tx.spans(data, offsets, tx.SPACE)
    h = tx.hash_spans(data, starts, ends, fold=True)
    w, at = tx.windows(h, bounds, size)
    edge = np.searchsorted(at, bounds)
    out = []
    for r in range(len(bounds) - 1):
        a, b = edge[r], edge[r + 1]
        if b > a:
            out.append(np.unique(w[a:b]))
        elif bounds[r + 1] > bounds[r]:
            few = h[bounds[r] : bounds[r + 1]]
            out.append(tx.windows(few, np.array([0, len(few)]), len(few))[0] ^ np.uint64(len(few)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def _sketches(docs: DataFrame, size: int) -> DataFrame:
    """_id, n, two 64-bit digests of the set, and its minwise tokens: of the first hashes whole (``heads``), of the next ones
    a byte (``twigs``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, data, offsets in tx.blocks(batches, "_text"):
            sets = shingle_sets(data, offsets, size)
            n = np.array([len(s) for s in sets], np.int64)
            full = np.flatnonzero(n)
            a, b = (np.zeros(len(sets), np.int64) for _ in range(2))
            tokens: list[tuple[bytes, bytes] | tuple[None, None]] = [(None, None)] * len(sets)
            if len(full):
                items, at = np.concatenate(sets), np.append(0, np.cumsum(n))[full]
                a[full] = np.add.reduceat(tx.mix(items.copy()), at).view(np.int64)
                b[full] = np.add.reduceat(tx.mix(items * np.uint64(0xA24BAED4963EE407)), at).view(np.int64)
                for r in full.tolist():
                    tokens[r] = _tokens(sets[r])
            heads, twigs = (pa.array(x, pa.binary()) for x in zip(*tokens, strict=True))
            yield pa.RecordBatch.from_arrays([block.column(0), pa.array(n), pa.array(a), pa.array(b), heads, twigs], ["_id", "n", "a", "b", "heads", "twigs"])

    return docs.mapInArrow(run, "_id long, n long, a long, b long, heads binary, twigs binary")


def _tokens(items: np.ndarray) -> tuple[bytes, bytes]:
    short = (items >> np.uint64(32)).astype(np.uint32)
    least = np.full(HEADS + TWIGS, 0xFFFFFFFF, np.uint32)
    for a in range(0, len(short), 1024):
        least = np.minimum(least, (short[a : a + 1024, None] * _MULTIPLY + _ADD).min(0))
    return least[:HEADS].tobytes(), (least[HEADS:] >> np.uint32(4)).astype(np.uint8).tobytes()


def _bytes(twigs: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(twigs), np.uint8).reshape(-1, TWIGS)


def _place(bits: int) -> Column:
    """The place of ``_id`` in a bitmap of ``2 ** bits`` bits."""
    return F.pmod(F.xxhash64("_id"), F.lit(1 << bits))


def _bitmap(ids: DataFrame, bits: int) -> np.ndarray:
    """The bitmap of ``_id``: built by Spark in pieces of 32,768 bits, of which the driver gathers at most ``2 ** (bits - 15)``."""
    at = _place(bits) + 1  # pieces and the places in them are counted from 1
    pieces = ids.groupBy(F.bitmap_bucket_number(at).alias("piece")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("held"))
    out = np.zeros(1 << (bits - 3), np.uint8)
    for piece, held in pieces.collect():
        out[(piece - 1) * 4096 : (piece - 1) * 4096 + len(held)] = np.frombuffer(held, np.uint8)
    return out


def _full_sets(docs: DataFrame, ids: DataFrame, size: int) -> DataFrame:
    """The sets of rows with one of ``ids`` and of a few others that a bitmap of the ids takes for such; no text is shuffled."""
    bits = min(MOST_BITS, max(LEAST_BITS, (ids.count() * BITS_PER_ID).bit_length()))
    wanted = docs.sparkSession.sparkContext.broadcast(_bitmap(ids, bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = wanted.value

        def kept() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = batch.column(2).to_numpy()
                yield batch.filter(pa.array((held[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)))

        for block, data, offsets in tx.blocks(kept(), "_text"):
            sets = [s.view(np.int64) for s in shingle_sets(data, offsets, size)]
            yield pa.RecordBatch.from_arrays([block.column(0), pa.array(sets, pa.list_(pa.int64()))], ["_id", "items"])

    return docs.select("_id", "_text", _place(bits).alias("_at")).mapInArrow(run, "_id long, items array<long>")


def _agreeing(pairs: DataFrame, least: int) -> DataFrame:
    """Of rows (x, y, p, q), those whose tokens p and q agree in ``least`` places: x, y, agree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            if rows.num_rows:
                p, q = (_bytes(rows.column(k).to_pylist()) for k in (2, 3))
                agree = (p == q).sum(1, dtype=np.int32)
                yield pa.RecordBatch.from_arrays([*rows.columns[:2], pa.array(agree)], ["x", "y", "agree"]).filter(pa.array(agree >= least))

    return pairs.select("x", "y", "p", "q").mapInArrow(run, "x long, y long, agree int")


def _sets_of(ids: DataFrame, docs: DataFrame, size: int, name: str) -> DataFrame:
    """The sets of the documents ``ids`` (_id, each once); of rows that repeat a key the largest."""
    ids = store(ids, "ids")
    sets = _full_sets(docs, ids, size).groupBy("_id").agg(F.max_by("items", F.size("items")).alias("items"))
    return store(sets.join(ids, "_id", "left_semi"), f"{name}-sets")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int, name: str) -> DataFrame:
    """Of ``pairs`` (x, y), those whose full sets are similar enough."""
    both = pairs.join(sets.select(F.col("_id").alias("y"), F.col("items").alias("q")), "y").join(sets.select(F.col("_id").alias("x"), F.col("items").alias("p")), "x")
    common = F.size(F.array_intersect("p", "q"))
    return store(both.where(100 * common >= percent * (F.size("p") + F.size("q") - common)).select("x", "y"), f"{name}-links")


def components(links: DataFrame) -> DataFrame:
    """The least id that each linked id reaches: ``_id``, ``root``.  ``links``: x, y.

    Alternates two steps until nothing changes: every id's larger neighbours are tied to its least neighbour, then its
    smaller ones are.  Each is a grouping and a join; rounds grow with the log of the longest chain.  Tasks are as many as the
    edges need (``TASK_EDGES``).
    """
    edges = store(links.where("x <> y").select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct(), "edges")
    digest = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
    was = digest(edges)
    while was[0]:
        tasks = max(edges.sparkSession.sparkContext.defaultParallelism, -(-was[0] // TASK_EDGES))
        edges = edges.coalesce(tasks)
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").coalesce(tasks).distinct().coalesce(tasks)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        tied = F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v"))))
        edges = store(large.join(low, "u").select(tied.alias("e")).select("e.u", "e.v").where("u > v").coalesce(tasks).distinct().coalesce(tasks), "edges")
        now = digest(edges)
        if now == was:
            break
        was = now
    return edges.select(F.col("u").alias("_id"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("_id"), F.col("v").alias("root")).distinct())


def _children(level: int) -> Column:
    """The children that a member's minwise tokens name; the node chooses the tokens."""
    place = lambda k: F.pmod(F.xxhash64("node", F.lit(level), F.lit(k)), F.lit(TWIGS)).cast("int")
    child = lambda k: F.xxhash64("node", F.lit(k), F.col("twigs").substr(place(k) + 1, F.lit(1)))
    return F.when(F.pmod(F.xxhash64("node", F.lit(level)), F.lit(4)) == 0, F.array(child(0), child(1))).otherwise(F.array(child(0)))


def _mixed(nodes: DataFrame, p: Join, name: str) -> DataFrame:
    """Nodes with members of several components, with their sizes, as a table.  Of small nodes with the same members one is enough."""
    sizes = nodes.groupBy("node").agg(F.count("*").alias("size"), F.min("root").alias("low"), F.max("root").alias("high"), F.bit_xor(F.xxhash64("rep")).alias("who")).where("low < high")
    once = sizes.groupBy("size", "who", F.when(F.col("size") > p.small, F.col("node")).alias("large")).agg(F.min("node").alias("node"))
    return store(nodes.join(once.select("node", "size"), "node"), name)


def _groups(nodes: DataFrame, p: Join) -> DataFrame:
    """Rows of (node, i, j): groups that are compared exhaustively.

    A node of ``small`` members is one group.  The members of one that is larger after all splits are dealt into blocks by
    hash and each pair of blocks is a group, so that no group outgrows about two blocks.
    """
    about = ["rep", "n", "root", "twigs"]
    whole = nodes.where(F.col("size") <= p.small).select("node", F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(False).alias("side"), *about)
    blocks = F.ceil(F.col("size") / p.small).cast("int")
    own = F.pmod(F.xxhash64("rep"), blocks).cast("int")
    part = F.transform(F.sequence(F.lit(0), blocks - 1), lambda j: F.struct(F.least(own, j).alias("i"), F.greatest(own, j).alias("j"), (own > j).alias("side")))
    dealt = nodes.where(F.col("size") > p.small).withColumn("at", F.explode(part)).select("node", "at.i", "at.j", "at.side", *about)
    return whole.unionByName(dealt)


#: What tells a group.
_GROUP = ["node", "i", "j"]


def _by_group(rows: DataFrame, work: Callable[[pa.Table], pa.Table], kind: str) -> DataFrame:
    """``work`` on the rows of every group at once.  Groups are bounded and many, so a task gets them sorted, as one stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_rows: pa.Table | None = None
        for batch in chain(batches, [None]):
            if batch is not None and batch.num_rows:
                table = pa.Table.from_batches([batch])
                open_rows = table if open_rows is None else pa.concat_tables([open_rows, table])
            if open_rows is None or batch is not None and not batch.num_rows:
                continue
            keys = np.stack([open_rows.column(k).to_numpy() for k in _GROUP])
            edges = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1
            bounds = [0, *edges.tolist(), *([open_rows.num_rows] if batch is None else [])]
            done = [work(open_rows.slice(x, y - x)) for x, y in zip(bounds[:-1], bounds[1:], strict=True) if y - x > 1]
            open_rows = open_rows.slice(bounds[-1])
            if some := [d for d in done if d.num_rows]:
                yield from pa.concat_tables(some).combine_chunks().to_batches()

    return rows.repartition(*_GROUP).sortWithinPartitions(*_GROUP).mapInArrow(run, kind)


def _near(rows: pa.Table, p: Join) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a group's rows worth confirming: of different components, of sizes and tokens close enough."""
    ids, n, root, side = (rows.column(c).to_numpy() for c in ("rep", "n", "root", "side"))
    none = np.empty(0, np.int64)
    if (root == root[0]).all():
        return none, none
    twigs = _bytes(rows.column("twigs").to_pylist())
    out: list[tuple[np.ndarray, np.ndarray]] = []
    apart = rows.column("i")[0].as_py() != rows.column("j")[0].as_py()
    for r in range(len(ids)):
        other = np.flatnonzero((root != root[r]) & (ids > ids[r]) & (100 * np.minimum(n, n[r]) >= p.percent * np.maximum(n, n[r])) & ((side != side[r]) | (not apart)))
        if len(other) and len(other := other[(twigs[other] == twigs[r]).sum(1) >= p.least]):
            out.append((np.full(len(other), r), other))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (none, none)


def _compared(nodes: DataFrame, docs: DataFrame, size: int, p: Join) -> DataFrame:
    """Links (x, y) between components among the members of ``nodes``, confirmed on full sets.

    First the tokens tell which members of a group can have a link; these alone get their sets, and within the group
    every pair is confirmed that doesn't already hang together.  No step makes a row for each pair.
    """
    kind = "node long, i int, j int, side boolean, rep long, n long, root long, twigs binary"

    def flag(rows: pa.Table) -> pa.Table:
        return rows.take(pa.array(np.unique(np.concatenate(_near(rows, p)))))

    def confirm(rows: pa.Table) -> pa.Table:
        x, y = _near(rows, p)
        items = rows.column("items").combine_chunks()
        bounds, values = items.offsets.to_numpy(), items.values.to_numpy()
        part = np.unique(rows.column("root").to_numpy(), return_inverse=True)[1]
        values = np.unique(values[bounds[0] : bounds[-1]], return_inverse=True)[1]  # items as numbers from 0, for a mark on each
        bounds = bounds - bounds[0]
        n, marked = np.diff(bounds), np.zeros(len(values), bool)

        ids, links = rows.column("rep").to_pylist(), []
        firsts = np.flatnonzero(np.diff(x, prepend=-1))
        for r, others in zip(x[firsts].tolist(), np.split(y, firsts[1:]) if len(x) else [], strict=True):
            others = others[part[others] != part[r]]
            if not len(others):
                continue
            own = values[bounds[r] : bounds[r + 1]]
            marked[own] = True
            held = marked[np.concatenate([values[bounds[k] : bounds[k + 1]] for k in others])]
            marked[own] = False
            common = np.add.reduceat(held, np.cumsum(n[others]) - n[others], dtype=np.int64)
            for k in others[100 * common >= p.percent * (n[r] + n[others] - common)].tolist():
                if part[k] != part[r]:
                    part[part == part[k]] = part[r]
                    links.append((ids[r], ids[k]))
        return pa.table({"x": pa.array([a for a, _ in links], pa.int64()), "y": pa.array([b for _, b in links], pa.int64())})

    flagged = store(_by_group(_groups(nodes, p), flag, kind), "flagged")
    # of groups left with the same members one is enough
    once = flagged.groupBy(*_GROUP).agg(F.count("*").alias("m"), F.bit_xor(F.xxhash64("rep", "side")).alias("who")).groupBy("m", "who").agg(F.min(F.struct(*_GROUP)).alias("g")).select("g.*")
    kept = store(flagged.join(once, _GROUP), "kept")
    sets = _sets_of(kept.select(F.col("rep").alias("_id")).distinct(), docs, size, "rest")
    full = kept.join(sets.select(F.col("_id").alias("rep"), "items"), "rep")
    links = store(_by_group(full, confirm, "x long, y long").distinct(), "rest-links")
    drop(flagged, kept, sets)
    return links


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 5, join: Join = Join()) -> DataFrame:
    """The class of each document among those that near-duplicate links connect.

    Lower-cases A-Z, takes words ``[^\\x20\\x09-\\x0D]+`` and the distinct shingles of ``shingle`` words; a text of fewer
    words is one shingle.  Documents are linked whose intersection is at least ``join.percent`` per cent of the union.
    Returns one row for each row of ``docs``: ``key`` (as a long), ``n_shingles``, ``component_id`` (the least key it
    reaches, itself included) and ``kept`` (it has that key).

    Texts that are null or have no words are linked with nothing.  Rows that repeat a key are one document: what is equal
    to any of its texts is linked with it, and so is what is similar to the one with most shingles.  Rows with a null key
    take part in nothing and are kept, their component null.  An empty table gives an empty one; other columns are ignored.
    """
    p = join
    every = docs.select(docs[key].cast("long").alias("_id"), docs[text].cast("string").alias("_text"))
    named = every.where("_id is not null")
    sketches = store(_sketches(every, shingle), "sketches")
    # equal sets are one class, named by its least key
    digest = ["n", "a", "b"]
    tokens = [F.first(c).alias(c) for c in ("heads", "twigs")]
    sets = store(sketches.where("n > 0 and _id is not null").groupBy(*digest).agg(F.min("_id").alias("rep"), *tokens), "classes")
    reps = sets.groupBy("rep").agg(F.max(F.struct("n", "a", "heads", "twigs")).alias("s")).select("rep", "s.n", "s.heads", "s.twigs")
    of_row = sketches.select("_id", *digest).join(sets.select(*digest, "rep"), digest, "left")
    bridges = of_row.where("rep <> _id").groupBy("_id").agg(F.min("rep").alias("x"), F.max("rep").alias("y")).where("x < y").select("x", "y").unionByName(
        of_row.where("rep <> _id").join(sets.select(F.col("rep").alias("_id")).distinct(), "_id", "left_semi").select(F.col("rep").alias("x"), F.col("_id").alias("y")).distinct()
    )

    # the roots' children in every tree: their members against the least one
    token = F.explode(F.transform(F.sequence(F.lit(0), F.lit(p.trees - 1)), lambda t: F.xxhash64(t, F.col("heads").substr(t * 4 + 1, F.lit(4))))).alias("node")
    member = F.struct("rep", "n", "twigs")
    first = reps.select(token, "rep", "n", "twigs")
    shared = first.groupBy("node").agg(F.count("*").alias("size"), F.min(member).alias("pivot")).where("size > 1").select("node", "pivot")
    star = first.join(shared, "node").where(f"rep <> pivot.rep and 100 * least(n, pivot.n) >= {p.percent} * greatest(n, pivot.n)")
    near = store(_agreeing(star.select(F.col("pivot.rep").alias("x"), F.col("rep").alias("y"), F.col("pivot.twigs").alias("p"), F.col("twigs").alias("q")), p.least).distinct(), "near")
    near_sets = _sets_of(near.select(F.explode(F.array("x", "y")).alias("_id")).distinct(), named, shingle, "near")
    # each member's most promising pair settles most; the others are tried where they would join components
    best = near.groupBy("y").agg(F.max(F.struct("agree", "x")).alias("s")).select("s.x", "y")
    links = _confirmed(best, near_sets, p.percent, "best").unionByName(bridges)
    found = components(links)
    root = lambda d, of, name: d.join(found.select(F.col("_id").alias(of), F.col("root").alias(name)), of, "left").withColumn(name, F.coalesce(name, of))
    others = root(root(near.join(best, ["x", "y"], "left_anti"), "x", "rx"), "y", "ry").where("rx <> ry").select("x", "y")
    more = _confirmed(others, near_sets, p.percent, "other")
    drop(near, near_sets)
    if not more.isEmpty():
        found = components(found.select(F.col("_id").alias("x"), F.col("root").alias("y")).unionByName(more))

    # nodes that still hold several components
    rooted = store(reps.join(found.select(F.col("_id").alias("rep"), "root"), "rep", "left").withColumn("root", F.coalesce("root", "rep")), "rooted")
    nodes = _mixed(rooted.select(token, "rep", "n", "root", "twigs"), p, "nodes")
    drop(rooted)
    todo = []
    for level in range(p.depth):
        settled = F.col("size") <= (p.small if level < 2 else p.small * p.blocks)
        todo.append(nodes.where(settled))
        nodes = nodes.where(~settled)
        if nodes.isEmpty():
            break
        nodes = _mixed(nodes.select(F.explode(_children(level)).alias("node"), "rep", "n", "root", "twigs"), p, "nodes")
    else:
        todo.append(nodes)
    every_node = todo[0]
    for later in todo[1:]:
        every_node = every_node.unionByName(later)
    more = _compared(every_node, named, shingle, p)
    if not more.isEmpty():
        found = components(found.select(F.col("_id").alias("x"), F.col("root").alias("y")).unionByName(more))

    out = of_row.join(found.select(F.col("_id").alias("rep"), "root"), "rep", "left")
    component = F.when(F.col("_id").isNotNull(), F.coalesce("root", "rep", "_id"))
    return out.select(F.col("_id").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("_id"), F.lit(True)).alias("kept"))
