"""Near-duplicate lines across a corpus: an exact set-similarity join in DataFrame operations alone.

A line is the set of its words, ordered from rare to common.  Two sets as similar as asked share a word in short prefixes
of that order, so only lines matter that share a prefix word with another, where the sizes, the places of that word and a
sketch of the words allow the overlap.  Their words are worked out again where the texts are, behind a bitmap of such lines,
so texts are not shuffled.  Each is verified against the first
line of every prefix word's group, which settles most; the others are verified against all of the group by a semi-join.
No step makes a row for each pair, so large groups of near copies cost no more than their members.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._scratch import drop, store

#: Hash buckets in which words are counted; a word is as rare as its bucket.
BUCKET_BITS = 20
_BLANK = " \t\n\x0b\f\r"


def _spaced(text: Column) -> Column:
    """A text in lower case with spaces for all blanks but line feeds, so that words come by a split at one character."""
    low = F.lower(text)
    odd = reduce(Column.__or__, (low.contains(blank) for blank in "\t\x0b\f\r"))
    return F.when(odd, F.regexp_replace(low, "[\\t\\x0B\\f\\r]", " ")).otherwise(low)


def _ranks(rows: DataFrame) -> DataFrame:
    """One row with one array: for each bucket of words a number from 0 (rare) to 127 that grows with the log of the bucket's count.

    It counts all words of ``_text``.  The array has 2 ** BUCKET_BITS bytes whatever the input.
    """
    text = rows.select(F.replace(_spaced(F.col("_text")), F.lit("\n"), F.lit(" ")).alias("text"))
    bucket = F.xxhash64("w").bitwiseAND((1 << BUCKET_BITS) - 1)
    counts = text.select(F.explode(F.split("text", " ")).alias("w")).groupBy(bucket.alias("id")).agg(F.count("*").alias("c"))
    level = F.least(F.floor(F.log2(F.coalesce("c", F.lit(0)) + 1) * 4), F.lit(127)).cast("tinyint")
    return _array(counts.select("id", level.alias("cell")), BUCKET_BITS, F.lit(0).cast("tinyint"))


def _array(cells: DataFrame, bits: int, empty: Column) -> DataFrame:
    """One row with one array of 2 ** ``bits`` elements: each ``cell`` at its ``id``, elsewhere ``empty``."""
    all_cells = cells.sparkSession.range(1 << bits).join(cells, "id", "left")
    parts = all_cells.select(F.shiftright("id", bits // 2).alias("part"), F.struct("id", F.coalesce("cell", empty).alias("cell")).alias("at"))
    inner = parts.groupBy("part").agg(F.transform(F.array_sort(F.collect_list("at")), lambda x: x["cell"]).alias("cells"))
    return inner.agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("part", "cells"))), lambda x: x["cells"])).alias("all"))


def _spot(bits: int) -> Column:
    """Where a line is in a bitmap of 2 ** ``bits`` bits."""
    return F.xxhash64(*LINE).bitwiseAND((1 << bits) - 1)


def _bitmap(lines: DataFrame, bits: int) -> DataFrame:
    """One row with a bitmap of ``lines``, as an array of 64-bit numbers."""
    at = lines.select(_spot(bits).alias("spot")).select(F.shiftright("spot", 6).alias("id"), _bit(F.col("spot")).alias("bit"))
    return _array(at.groupBy("id").agg(F.bit_or("bit").alias("cell")), bits - 6, F.lit(0).cast("long"))


def _bit(number: Column) -> Column:
    """A 64-bit number with one bit, by the last six bits of ``number``."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), number.bitwiseAND(63).cast("int"))


class _Variable:
    """A value as a session variable, so that expressions name it in place of spelling it out; the name goes at the end."""

    def __init__(self, one_row: DataFrame) -> None:
        self.spark, self.name = one_row.sparkSession, f"bytelore_{uuid.uuid4().hex}"
        one_row.createOrReplaceTempView(self.name)
        self.spark.sql(f"declare variable {self.name} {one_row.dtypes[0][1]}")

    def __enter__(self) -> Column:
        self.spark.sql(f"set var {self.name} = (select * from {self.name})")
        self.spark.catalog.dropTempView(self.name)
        return F.expr(self.name)

    def __exit__(self, *_: object) -> None:
        self.spark.sql(f"drop temporary variable {self.name}")


def _hashes(line: Column) -> Column:
    """The distinct words of a line of a ``_spaced`` text as 64-bit hashes; none for a blank line."""
    return F.array_remove(F.array_distinct(F.transform(F.split(line, " "), lambda w: F.xxhash64(w))), F.xxhash64(F.lit("")))


def _keys(hashes: Column, ranks: Column) -> Column:
    """Hashes of words as 63-bit numbers that sort from rare to common."""
    # never null, so that arrays are of plain numbers and sort fast
    rank = lambda h: F.coalesce(F.get(ranks, h.bitwiseAND((1 << BUCKET_BITS) - 1).cast("int")).cast("long"), F.lit(0).cast("long"))
    return F.sort_array(F.transform(hashes, lambda h: F.shiftleft(rank(h), 56).bitwiseOR(F.shiftrightunsigned(h, 8))))


def _at_least(percent: int, n: Column) -> Column:
    return F.ceil(n * percent / F.lit(100.0) - F.lit(1e-9)).cast("int")


def _prefix(percent: int) -> Column:
    """The places and words (31 bits) of the prefix of ``keys``."""
    return F.transform(F.slice("keys", 1, F.col("n") - _at_least(percent, F.col("n")) + 1), lambda k: k.bitwiseAND(0x7FFFFFFF).cast("int"))


#: Four bits for a count, of which as many differ between two counts as these are apart on a circle of eight.
_CODES = 0x8CEF7310


def _bounds(words: int) -> list[Column]:
    """What parts 64-bit hashes into equal ranges, 16 for each of ``words`` numbers of a sketch."""
    ranges = 16 * words
    return [F.lit((1 << 64) // ranges * t - (1 << 63)).cast("long") for t in range(1, ranges)]


def _sketches(words: int) -> Column:
    """``words`` 64-bit numbers, as an array: four bits for how many words of a line hash into each of equal ranges.

    The ranges' bounds are sorted in with the hashes as ``among``, where their places tell the counts, so no step is taken
    for each word but that sort.  Sets differ in at least as many words as their sketches do in bits.
    """
    at = [F.lit(0).cast("long"), *(F.array_position("among", x) for x in _bounds(words)), F.size("among").cast("long") + 1]
    code = lambda t: F.call_function("shiftright", F.lit(_CODES).cast("long"), F.shiftleft((at[t + 1] - at[t] - 1).bitwiseAND(7), 2).cast("int")).bitwiseAND(15)
    return F.array(*(reduce(Column.bitwiseOR, (F.shiftleft(code(16 * j + t), 4 * t) for t in range(16))) for j in range(words)))


def _may_match(percent: int, words: int) -> Column:
    """Whether lines l and r, whose first common word is at places i, can be similar enough."""
    n = F.col("l.n") + F.col("r.n")
    sizes = 100 * F.least("l.n", "r.n") >= percent * F.greatest("l.n", "r.n")
    room = F.least(F.col("l.n") - F.col("l.i"), F.col("r.n") - F.col("r.i"))  # of the first common word: no earlier one is common
    places = room * (100 + percent) >= n * percent
    apart = sum(F.bit_count(F.col(f"l.b{j}").bitwiseXOR(F.col(f"r.b{j}"))) for j in range(words))
    return sizes & places & (apart * (100 + percent) <= n * (100 - percent))


def _similar(p: Column, q: Column, percent: int) -> Column:
    common = F.size(F.array_intersect(p, q))
    return 100 * common >= percent * (F.size(p) + F.size(q) - common)


def _postings(lines: DataFrame, who: list[str], words: int) -> DataFrame:
    """A row for each word of each line's prefix, with the columns ``who``; ``words`` numbers make a sketch."""
    return lines.select(*who, "n", *(F.get("bits", F.lit(j)).alias(f"b{j}") for j in range(words)), F.posexplode("prefix").alias("i", "word"))


#: What tells a line from all others: rows that repeat a key are told apart by their text.
LINE = ["doc", "line_no", "text_hash"]


def _place(side: str) -> Column:
    """Where a line comes in order; lines of rows that repeat a key may share a place."""
    return F.struct(f"{side}.doc", f"{side}.line_no")


def _line(side: str) -> Column:
    return F.struct(*(f"{side}.{c}" for c in LINE))


#: 64-bit numbers of a line's sketch, while all lines are candidates and when few are.
NARROW, WIDE = 2, 4
#: Bits of the bitmap for a candidate line, and its least and greatest size as a power of two (8 KiB and 8 MiB).
BITS_PER_LINE, LEAST_BITS, MOST_BITS = 16, 16, 26


def later_matches(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 80, least_words: int = 1) -> DataFrame:
    """Lines that an earlier line matches: ``key`` (as a long), ``text_hash`` (xxhash64 of the row's text) and ``line_no``
    (from 0), each once.

    Lines are split at line feeds, words at ``[ \\t-\\r]+``, in lower case.  Lines with ``least_words`` distinct words or
    more take part, by default all that are not blank; two match if their words' Jaccard similarity is at least ``percent`` per
    cent.  Order is by key, then by line; lines at one place (rows that repeat a key) are not later than each other.  Null
    texts and keys, blank and short lines match nothing; an empty table has no matches; other columns are ignored.  A line
    is held as an array of its words' hashes, so one line of any length must fit in a task's memory.
    """
    rows = docs.select(docs[key].cast("long").alias("doc"), docs[text].cast("string").alias("_text")).where("doc is not null")
    with _Variable(store(_ranks(rows), "ranks")) as ranks:
        return _later_matches(rows, ranks, percent, least_words).withColumnRenamed("doc", key)


def _later_matches(rows: DataFrame, ranks: Column, percent: int, least_words: int) -> DataFrame:
    line, digest = LINE, ["a", "b"]
    spaced = rows.select("doc", F.xxhash64("_text").alias("text_hash"), _spaced(F.col("_text")).alias("text"))
    split = spaced.select("doc", "text_hash", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))

    def hashed(lines: DataFrame, words: int) -> DataFrame:
        hashes = lines.select(*line, _hashes(F.col("line")).alias("hashes"))
        among = F.sort_array(F.concat("hashes", F.array(*_bounds(words)))).alias("among")
        return hashes.select("*", _keys(F.col("hashes"), ranks).alias("keys"), F.size("hashes").alias("n"), among)

    digests = [F.xxhash64("keys").alias("a"), F.xxhash64(F.lit(1), "keys").alias("b")]
    # blank and short lines are left out when the table is read: a filter before would work the keys out a second time
    numbered = hashed(split, NARROW).select(F.monotonically_increasing_id().alias("id"), *line, "n", _sketches(NARROW).alias("bits"), _prefix(percent).alias("prefix"), *digests)
    marked = store(numbered, "lines")
    taking_part = marked.where((F.col("n") >= least_words) & (F.col("n") > 0))

    # equal sets are one, at their first place; those that may match another set, by the number that the table gave a line
    sets = taking_part.groupBy(*digest).agg(F.min(F.struct(*line, "id", "n", "bits", "prefix")).alias("s")).select("s.*")
    # a set too small to match another one (with a word more or less the share of common words is too low) has settled by now
    posted = _postings(sets.where(100 * F.col("n") >= percent * (F.col("n") + 1)), ["id"], NARROW)
    # both sides have the same columns, and so are shuffled once
    partner = (F.col("l.word") == F.col("r.word")) & (F.col("l.id") != F.col("r.id")) & _may_match(percent, NARROW)
    maybe = store(posted.alias("l").join(posted.alias("r"), partner, "left_semi").select("id").distinct(), "maybe")
    named = store(taking_part.join(maybe, "id", "left_semi").select(*line), "named")
    drop(maybe)

    # their words, where the texts are: a bitmap lets few other lines through, the join none
    bits = min(MOST_BITS, max(LEAST_BITS, (named.count() * BITS_PER_LINE).bit_length()))
    with _Variable(store(_bitmap(named, bits), "bitmap")) as bitmap:
        there = F.get(bitmap, F.shiftright(_spot(bits), 6).cast("int")).bitwiseAND(_bit(_spot(bits))) != 0
        again = hashed(split.where(there).join(named, line, "left_semi"), WIDE)
        words = store(again.select(*line, "n", _sketches(WIDE).alias("bits"), _prefix(percent).alias("prefix"), *digests, "keys"), "words").where((F.col("n") >= least_words) & (F.col("n") > 0))
    few = _postings(words, line, WIDE)

    # against the first line of each group
    whole = F.struct(*few.drop("word").columns)
    firsts_of = few.groupBy("word").agg(F.min(whole).alias("first"))
    pair = few.join(firsts_of, "word").select(whole.alias("l"), F.col("first").alias("r")).where((_place("r") < _place("l")) & _may_match(percent, WIDE))
    side = lambda name, keys: words.select(F.struct(*line).alias(name), F.col("keys").alias(keys))
    pairs = pair.select(_line("r").alias("x"), _line("l").alias("y")).distinct().join(side("y", "q"), "y").join(side("x", "p"), "x")
    settled = store(pairs.where(_similar(F.col("p"), F.col("q"), percent)).select(*(f"y.{c}" for c in line)).distinct(), "settled")

    # the others against all earlier ones of their groups: first which lines that takes, then with their words
    earlier = (F.col("l.word") == F.col("r.word")) & (_place("r") < _place("l")) & _may_match(percent, WIDE)
    left = store(few.join(settled, line, "left_anti").alias("l").join(few.alias("r"), earlier, "left_semi").select(*few.columns), "left")
    right = few.alias("r").join(left.alias("l"), earlier, "left_semi").select(*few.columns)
    with_keys = lambda d: d.join(words.select(*line, "keys"), line)
    others = with_keys(left).alias("l").join(with_keys(right).alias("r"), earlier & _similar(F.col("l.keys"), F.col("r.keys"), percent), "left_semi").select(*line).distinct()
    matched = store(settled.unionByName(others).join(words.select(*line, *digest), line).select(*digest).distinct().withColumn("hit", F.lit(True)), "matched")
    drop(named, settled, left)

    place = F.struct("doc", "line_no")
    firsts = taking_part.groupBy(*digest).agg(F.min(place).alias("s"), F.count("*").alias("c")).join(matched, digest, "left").where("c > 1 or hit")
    gone = taking_part.join(firsts, digest).where(F.col("hit").isNotNull() | (place != F.col("s")))
    return gone.select("doc", "text_hash", "line_no").distinct()


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 80, least_words: int = 1, drop_emptied: bool = True) -> DataFrame:
    """``docs`` without the lines that an earlier line matches (see ``later_matches``); the columns are those of ``docs``.

    With ``drop_emptied``, rows go that had words and have none left.  Rows without a match stay as they are, whatever is
    null or empty in them.
    """
    found = later_matches(docs, key, text, percent, least_words)
    gone = found.groupBy(F.col(key).alias("_key"), F.col("text_hash").alias("_hash")).agg(F.collect_set("line_no").alias("_gone"))
    whole = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("_row"))  # so that no other column's name can clash
    old = F.col("_row")[text].cast("string")
    joined = whole.join(gone, (F.col("_row")[key].cast("long") == F.col("_key")) & (F.xxhash64(old) == F.col("_hash")), "left")
    body = F.when(F.col("_gone").isNull(), old).otherwise(F.array_join(F.filter(F.split(old, "\n"), lambda line, i: ~F.array_contains("_gone", i)), "\n"))
    if drop_emptied:
        joined = joined.where(F.col("_gone").isNull() | (F.btrim(body, F.lit(_BLANK)) != ""))
    return joined.select(*(body.alias(c) if c == text else F.col("_row")[c].alias(c) for c in docs.columns))
