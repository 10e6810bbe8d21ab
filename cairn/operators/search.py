"""Ranked search over a positional inverted index.

The index has a row for each term and document with the term's positions, so a frequent term is many small rows. A query
takes from it only the rows of its own terms; phrases are positions that meet once each is moved back by its place in the
phrase. Rows with equal documents meet in one aggregation, whose size is that of the query.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEPARATORS = r"[^\p{L}\p{N}]+"
#: Fixed values of the rank: a position's weight, positions of a term that it counts, the limit of the sum of 1/n^2, and the fall with distance.
WEIGHT, MOST_POSITIONS, LIMIT = 0.1, 256, 1.64493406685
FAR, FAR_WEIGHT, NEAR, SLOPE, SPREAD, SHIFT = 100, 1e-30, 1.005, 0.05, 1.5, 2.0

Phrase = tuple[str, ...]


@dataclass(frozen=True)
class Clause:
    """Phrases, most of one word, that a document must have, and those that it must not."""
    has: tuple[Phrase, ...]
    lacks: tuple[Phrase, ...]


def clauses(query: str) -> list[Clause]:
    """A web-style query as alternatives: words and quoted phrases are all wanted, a minus excludes, ``or`` begins another alternative."""
    out: list[tuple[list[Phrase], list[Phrase]]] = [([], [])]
    for minus, quoted, word in re.findall(r'(-?)(?:"([^"]*)"?|([^\s"]+))', query):
        if word.lower() == "or" and not minus:
            out.append(([], []))
        elif phrase := tuple(re.findall(r"[^\W_]+", (quoted or word).lower())):
            out[-1][1 if minus else 0].append(phrase)
    return [Clause(tuple(has), tuple(lacks)) for has, lacks in out if has or lacks]


def terms_of(query: list[Clause]) -> list[str]:
    return sorted({t for c in query for phrase in c.has + c.lacks for t in phrase})


def activity_text() -> Column:
    """What of an activity is searched: title, summary and tags."""
    return F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("summary", F.lit("")), F.array_join("tags", " "))


def postings(docs: DataFrame, key: str, text: Column) -> DataFrame:
    """(term, key, positions) of whole texts; positions count words from 1. A filter on ``term`` goes below the aggregation."""
    words = F.filter(F.split(F.lower(text), SEPARATORS), lambda w: w != "")
    return docs.select(F.col(key), F.posexplode(words).alias("at", "term")).groupBy("term", key).agg(F.array_sort(F.collect_list(F.col("at") + 1)).alias("positions"))


def write_index(docs: DataFrame, key: str, text: Column, path: str, partitions: int) -> None:
    """The index as files sorted by term, so that statistics and Bloom filters of the files leave a query few row groups to read. A term of very
    many documents is spread over files by ``key``.
    """
    index = postings(docs, key, text).repartitionByRange(partitions, "term", key).sortWithinPartitions("term", key)
    index.write.option("parquet.bloom.filter.enabled#term", "true").parquet(path)


def _positions(by_term: Column, term: str) -> Column:
    return F.coalesce(by_term[term], F.array().cast("array<int>"))


def _holds(by_term: Column, phrase: Phrase) -> Column:
    def back(term: str, steps: int) -> Column:
        return F.transform(_positions(by_term, term), lambda p: p - steps)

    return F.size(reduce(F.array_intersect, [back(t, i) for i, t in enumerate(phrase)])) > 0


def _apart(a: Column, b: Column) -> Column:
    """Weight of two words at positions a and b, falling with their distance."""
    d = F.abs(a - b)
    by_distance = F.when(d > FAR, F.lit(FAR_WEIGHT)).otherwise(1.0 / (F.lit(NEAR) + SLOPE * F.exp(d / SPREAD - SHIFT)))
    return WEIGHT * F.sqrt(by_distance)


def _all_rank(by_term: Column, terms: list[str]) -> Column:
    """For words that are all wanted: pairs of occurrences of two terms count as independent chances."""
    def counted(term: str) -> Column:
        return F.slice(_positions(by_term, term), 1, MOST_POSITIONS)

    def missed(a: str, b: str) -> Column:
        return F.aggregate(counted(a), F.lit(1.0), lambda out, p: out * F.aggregate(counted(b), F.lit(1.0), lambda inner, q: inner * (1.0 - _apart(p, q))))

    miss = reduce(lambda x, y: x * y, [missed(a, b) for k, b in enumerate(terms) for a in terms[:k]])
    return 1.0 - miss


def _any_rank(by_term: Column, terms: list[str]) -> Column:
    """For alternatives: the mean over the query's terms of their occurrences, the n-th counting 1/n^2."""
    each = [F.aggregate(F.sequence(F.lit(1), F.size(F.slice(_positions(by_term, t), 1, MOST_POSITIONS))), F.lit(0.0), lambda out, j: out + WEIGHT / (j * j)) for t in terms]
    each = [F.when(F.size(_positions(by_term, t)) > 0, e).otherwise(0.0) for t, e in zip(terms, each, strict=True)]
    return reduce(lambda a, b: a + b, each) / LIMIT / len(terms)


def found(index: DataFrame, key: str, query: str, everyone: DataFrame | None = None) -> DataFrame:
    """(key, rank) of the documents that match ``query``; without a word in it none does.

    ``everyone`` (key) has the documents that an alternative of nothing but exclusions is about; such a query needs it. Documents without
    any of the terms match it with rank 0. Repeated keys of ``everyone`` count once.
    """
    asked, terms = clauses(query), terms_of(clauses(query))
    hits = index.where(F.col("term").isin(terms)).groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("term", "positions"))).alias("by_term"))
    if any(not c.has for c in asked):
        if everyone is None:
            raise ValueError("a query of exclusions alone needs the table of all documents")
        hits = everyone.select(key).distinct().join(hits, key, "left").withColumn("by_term", F.coalesce("by_term", F.create_map().cast("map<string,array<int>>")))
    by_term = F.col("by_term")
    match = F.lit(False)
    for c in asked:
        match = match | reduce(lambda a, b: a & b, [*(_holds(by_term, p) for p in c.has), *(~_holds(by_term, p) for p in c.lacks)])
    rank = F.lit(0.0) if not terms else _all_rank(by_term, terms) if len(asked) == 1 and len(terms) > 1 and asked[0].has else _any_rank(by_term, terms)
    return hits.where(match).select(key, rank.alias("rank"))


def first(hits: DataFrame, limit: int, *order: Column) -> DataFrame:
    """The best ``limit`` hits, 1 to 100, with their place; ``order`` breaks ties."""
    order = (F.round("rank", 6).desc(), *order)
    top = hits.orderBy(*order).limit(max(1, min(limit, 100)))
    return top.withColumn("place", F.row_number().over(Window.orderBy(*order)))  # over at most 100 rows


def search_activities(activities: DataFrame, project: str, query: str, limit: int = 25) -> DataFrame:
    """The best activities (activity_id, project_id, title, summary, tags, occurred_at, source_item_id) of a project: by rank, then the latest, then the greatest item."""
    own = activities.where(F.col("project_id") == project)
    hits = found(postings(own, "activity_id", activity_text()), "activity_id", query, own)
    return first(own.join(hits, "activity_id"), limit, F.desc("occurred_at"), F.desc("source_item_id"), F.desc("activity_id"))


def search_literal(activities: DataFrame, project: str, query: str, limit: int = 25) -> DataFrame:
    """Where no index can be used: activities that hold the query as it is, in any case, the latest first."""
    pattern = "%" + re.sub(r"([\\%_])", r"\\\1", query) + "%"
    return activities.where((F.col("project_id") == project) & activity_text().ilike(pattern)).orderBy(
        F.desc("occurred_at"), F.desc("source_item_id"), F.desc("activity_id")).limit(max(1, min(limit, 100)))
