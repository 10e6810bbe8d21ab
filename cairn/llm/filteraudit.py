"""Interaction audit of quality filters by inclusion-exclusion.

One aggregation counts, for each part of the corpus and every set of filters, the documents
that fail all of the set: sums of products of flags. Möbius inversion of these joint failures
gives what survives any set of filters, and with that what every filter removes at every place
of every order, what it alone removes, and its Shapley value, whose Harsanyi dividends are the
joint failures with alternating signs. Orders are never run over documents.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import materialise

WORD = r"[^\x20\x09-\x0D]+"
#: Letter of the filter that finds repeated texts; its flag comes from all documents, the others' from one text.
REPEATED = "E"


def failures(text: Column) -> dict[str, Column]:
    """Whether a text, not null, fails each filter that needs no other document: length, variety, capitals, symbols."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    return {"A": F.size(words) < 200, "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
            "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > 2 * F.char_length(text), "D": text.rlike(r"[#$%&*|]")}


def flagged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, A, B, C, D, E, good, toxic, n): flags as 0 or 1, with the number of documents that share a row's id, text and source.

    A document fails E if a smaller id has the same text: its id is then not the smallest of its text. Ids
    are matched together with the text's digest, so no text and no source is one task's work; rows that repeat
    an id are counted together before they meet its labels. A null id is smaller than none and none is smaller.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    flags = [F.coalesce(f, F.lit(False)).cast("int").alias(k) for k, f in failures(text).items()]
    names = list(failures(text))
    rows = docs.select(F.col("doc_id"), F.coalesce(F.col("source"), F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"), *flags)
    rows = materialise(rows.groupBy("doc_id", "part", "digest", *names).agg(F.count(F.lit(1)).alias("n")), "audit-flags")
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("is_first", F.lit(1))
    marked = rows.join(first, ["doc_id", "digest"], "left").withColumn(
        REPEATED, F.when(F.col("doc_id").isNull() | F.col("is_first").isNotNull(), 0).otherwise(1))
    each = marked.groupBy("doc_id", "part", *names, REPEATED).agg(F.sum("n").alias("n"))
    said = labels.groupBy("doc_id").agg(*(F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(as_) for c, as_ in (("quality", "good"), ("toxic", "toxic"))))
    return each.join(said, "doc_id", "left").select("part", *names, REPEATED, F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"), "n")


def subsets(n: int) -> list[tuple[int, ...]]:
    """The sets of filters by mask: bit k of the index says whether filter k is in."""
    return [tuple(k for k in range(n) if mask >> k & 1) for mask in range(1 << n)]


def joint_failures(rows: DataFrame, filters: str, weights: dict[str, str]) -> DataFrame:
    """For each part and each weight, an SQL expression, an array by mask: the weighted number of documents that fail every filter of the set."""
    def sums(weight: str) -> str:
        return ", ".join(f"sum({' * '.join([weight, *(filters[k] for k in s)])})" for s in subsets(len(filters)))

    return rows.groupBy("part").agg(*(F.expr(f"array({sums(w)})").alias(name) for name, w in weights.items()))


def _sign(mask: Column) -> Column:
    return 1 - 2 * (F.bit_count(mask) % 2)


def survivors(joint: Column, inside: Column, n: int) -> Column:
    """How many fail no filter of the set with mask ``inside``: the alternating sum of its subsets' joint failures."""
    return F.aggregate(F.sequence(F.lit(0), F.lit((1 << n) - 1)), F.lit(0).cast("long"), lambda out, s: out + F.when(
        s.bitwiseAND(F.bitwise_not(inside)) == 0, _sign(s) * F.get(joint, s)).otherwise(F.lit(0).cast("long")))


def shapley(joint: Column, own: Column, n: int) -> Column:
    """What the filter with bit ``own`` removes, summed over all n! orders. Each set's dividend, its joint failures with
    the sign of odd sizes, is shared alike by its members; every size up to n divides n!.
    """
    return F.aggregate(F.sequence(F.lit(1), F.lit((1 << n) - 1)), F.lit(0).cast("long"), lambda out, s: out + F.when(
        s.bitwiseAND(own) != 0, -_sign(s) * F.floor(F.lit(factorial(n)) / F.bit_count(s)) * F.get(joint, s)).otherwise(F.lit(0).cast("long")))


def interactions(joint: DataFrame, filters: str) -> DataFrame:
    """One row for each part, order of the filters and step, from the arrays ``docs``, ``good`` and ``toxic`` of joint failures.

    Columns: part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.
    """
    n = len(filters)
    orders = F.explode(F.split(F.lit(",".join("".join(p) for p in permutations(filters))), ","))
    steps = joint.select("*", orders.alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("step"))
    earlier = F.substring(F.col("filter_order"), F.lit(1), F.col("step") - 1)
    before = sum((F.when(F.contains(earlier, F.lit(f)), 1 << k).otherwise(0) for k, f in enumerate(filters)), F.lit(0))
    placed = steps.select("*", before.alias("before"), F.expr(f"shiftleft(1, position(substring(filter_order, step, 1), '{filters}') - 1)").alias("own"))
    after = F.col("before") + F.col("own")
    left = placed.select("*", survivors(F.col("docs"), after, n).alias("kept"), *(
        (survivors(F.col(c), F.col("before"), n) - survivors(F.col(c), after, n)).alias(f"{c}_lost") for c in ("docs", "good", "toxic")))
    every = F.lit((1 << n) - 1)
    return left.select(
        "part", "filter_order", "step", "kept", F.col("docs_lost").alias("removed"), (F.get(F.col("docs"), F.col("own")) - F.col("docs_lost")).alias("redundant"),
        (survivors(F.col("docs"), every - F.col("own"), n) - survivors(F.col("docs"), every, n)).alias("unique_fails"),
        "good_lost", "toxic_lost", shapley(F.col("docs"), F.col("own"), n).alias("shapley"))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of filters A to E over ``docs`` (doc_id, text, source) and ``labels`` (doc_id, quality, toxic).

    A part for each source, a null source being the empty one; 600 rows a part, zeros included. A null text is empty. Texts
    are judged whole, whatever their length. Rows that share an id count each; where labels repeat
    an id, one row with a 1 suffices; documents without a label are neither good nor toxic. Repeated rows with one id and text are all
    of them first. An empty table gives none; other columns play no part.
    """
    rows = flagged(docs, labels)
    return interactions(joint_failures(rows, "ABCDE", {"docs": "n", "good": "n * good", "toxic": "n * toxic"}), "ABCDE")
