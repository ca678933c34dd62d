"""Ranking of type candidates: scores, one candidate for each type, the primary one and its alternatives."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The score that each confidence begins with and the range it stays in.
BASE = {"High": 90, "Medium": 70, "Low": 50}
RANGE = {"High": (80, 100), "Medium": (60, 79), "Low": (40, 59)}
MAX_ALTERNATIVES, PRIMARY_MARGIN, TIE_MARGIN, DECLARED_BOOST = 5, 6, 2, 3


def candidate(ext: Column | str, confidence: Column | str, adjust: Column | int = 0, details: Column | str | None = None) -> Column:
    as_col = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(as_col(ext).alias("ext"), as_col(confidence).alias("confidence"), as_col(adjust).cast("int").alias("adjust"), as_col(details).cast("string").alias("details"))


def scored(candidates: Column, declared: Column) -> Column:
    """Candidates with their scores and places: base, adjustment and a boost of the declared type, within the range."""

    def one(c: Column, i: Column) -> Column:
        pick = lambda table, other: F.coalesce(*(F.when(c["confidence"] == k, F.lit(v)) for k, v in table.items()), F.lit(other))
        raw = pick(BASE, 40) + c["adjust"] + F.when(c["ext"] == declared, DECLARED_BOOST).otherwise(0)
        low, high = pick({k: v[0] for k, v in RANGE.items()}, 0), pick({k: v[1] for k, v in RANGE.items()}, 100)
        return F.struct(c["ext"].alias("ext"), c["confidence"].alias("confidence"), F.least(high, F.greatest(low, raw)).alias("score"), i.alias("place"), c["details"].alias("details"))

    return F.transform(candidates, one)


def ranked(candidates: Column, declared: Column) -> Column:
    """One candidate for each type, the best first; ties keep the order in which they were given."""
    by_rank = F.array_sort(scored(candidates, declared), lambda a, b: F.when(a["score"] != b["score"], b["score"] - a["score"]).otherwise(a["place"] - b["place"]))
    first = lambda all_of: F.filter(all_of, lambda c, i: ~F.exists(F.slice(all_of, 1, F.greatest(i, F.lit(1))), lambda x: (x["ext"] == c["ext"]) & (x["place"] != c["place"]) & ((x["score"] > c["score"]) | ((x["score"] == c["score"]) & (x["place"] < c["place"])))))
    return first(by_rank)


def choose(primary: Column, ranked: Column, declared: Column) -> Column:
    """The type to report: the best candidate if it leads the primary type's own score by the margin, else the primary.

    A generic primary also yields to the declared type where that is within the tie margin of the best.
    """
    best = F.get(ranked, 0)
    own = F.coalesce(F.get(F.filter(ranked, lambda c: c["ext"] == primary), 0)["score"], F.lit(0))
    named = F.get(F.filter(ranked, lambda c: c["ext"] == declared), 0)
    generic = primary.isin("txt", "log", "ini", "xml", "csv")
    tie = generic & named["score"].isNotNull() & (best["score"] - named["score"] <= TIE_MARGIN)
    return F.when(best.isNull(), primary).when(best["score"] >= own + PRIMARY_MARGIN, F.when(tie, named["ext"]).otherwise(best["ext"])).when(tie, named["ext"]).otherwise(primary)


def alternatives(ranked: Column, chosen: Column) -> Column:
    return F.slice(F.filter(ranked, lambda c: c["ext"] != chosen), 1, MAX_ALTERNATIVES)
