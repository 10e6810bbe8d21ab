"""Document fingerprints by SpotSigs (DataFrame functions only).

A signature is a common word (the anchor) with the chain of content words that
follow it. A document's fingerprint is its set of signatures, each cut to 64 bits.
Likenesses are exact Jaccards. Whether two documents are near copies is decided by
length partitions first: only sets of neighbouring partitions are compared.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Common words of the languages served; they anchor chains and are skipped inside them.
ANCHORS = tuple(
    "a an and are as at be but by for from has have he her his i in is it not of on or she that the this to was were which with you "
    "au aux avec ce dans des du elle en est et il la le les ne pas pour que qui sur un une "
    "als auf aus das dem den der des die ein eine er es im ist mit nicht sich sie und von war wie zu zum "
    "al como con de del el es está fue la las lo los mi no para pero por se su una y".split())
CHAIN = 2
#: A chain may pass over so many further anchors.
REACH = 3
#: Near copies are at least so alike.
NEAR = 0.75
#: Rows of one range of ids, and the most ranges.
RANGE_ROWS, MOST_RANGES = 4096, 1 << 16


def signatures(text: Column) -> Column:
    """Sorted distinct signatures (16 hex digits each) of a text.

    A text without anchors has one signature, made of all its words; one without
    letters but with other characters has that of the text itself; an empty or null text none.
    """
    text = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(F.lower(text), r"[^\p{L}]+"), lambda w: w != "")
    marked = F.concat(F.array_join(F.transform(words, lambda w: F.when(w.isin(*ANCHORS), F.concat(F.lit("#"), w)).otherwise(w)), " "), F.lit(" "))
    pieces = F.split(marked, "#")

    def chains(parts: Column) -> Column:
        tails = F.transform(parts, lambda s: F.substr(s, F.instr(s, " ") + 1))

        def at(i: Column, t: Column) -> Column:
            ahead = F.concat(*[F.coalesce(F.get(t, i + k), F.lit("")) for k in range(REACH + 1)])
            return F.concat(F.substring_index(F.get(parts, i), " ", 1), F.lit(":"), F.substring_index(ahead, " ", CHAIN))

        return F.get(F.transform(F.array(tails), lambda t: F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: at(i, t))), 0)

    whole = F.when(text == "", F.array().cast("array<string>")).otherwise(F.array(F.when(F.trim(marked) == "", text).otherwise(marked)))
    chosen = F.get(F.transform(F.array(pieces), lambda p: F.when(F.size(p) > 1, chains(p)).otherwise(whole)), 0)
    return F.array_sort(F.array_distinct(F.transform(F.array_distinct(chosen), lambda s: F.substring(F.md5(s.cast("binary")), 1, 16))))


def length_partition(n: Column, least: float = NEAR) -> Column:
    """Partition of a set length: sets two or more partitions apart differ in length by more than a factor of 1/least."""
    return F.when(n > 0, F.floor(F.log(n.cast("double")) / F.lit(-math.log(least) * 1.001))).otherwise(F.lit(-2))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard of two signature sets, 1 for two empty ones."""
    m, n = F.size(a), F.size(b)
    shared = F.size(F.array_intersect(a, b))
    return F.when((m == 0) & (n == 0), F.lit(1.0)).when((m == 0) | (n == 0), F.lit(0.0)).otherwise(shared / (m + n - shared))


def near(a: Column, b: Column, least: float = NEAR) -> Column:
    """Whether the likeness is ``least`` or more. Sets whose length partitions are no neighbours, or whose lengths rule it out, aren't compared."""
    m, n = F.size(a), F.size(b)
    apart = (F.abs(length_partition(m, least) - length_partition(n, least)) > 1) | (F.least(m, n) < F.greatest(m, n) * F.lit(least))
    return F.when(apart, F.lit(False)).otherwise(likeness(a, b) >= least)


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row with its signatures and its successor's in descending id order (the last is followed by the first).

    Columns: the id, ``text`` (null: empty), ``sigs``, ``next_text``, ``next_sigs``. Null ids order last;
    rows of one id follow each other by descending text.

    Ids are cut into ranges at approximate quantiles, so each range is ordered by a task
    of its own; the row after a range's last is looked up among the ranges' first rows.
    """
    lowest = F.lit(-(1 << 63)).cast("long")
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), lowest).alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    n = docs.count()
    ranges = max(1, min(MOST_RANGES, n // RANGE_ROWS))
    bounds = sorted(set(rows.select(F.percentile_approx("key", [i / ranges for i in range(1, ranges)], max(10_000, 4 * ranges))).first()[0])) if ranges > 1 and n else []
    if bounds:
        steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(bounds).bit_length()))])
        cuts = F.lit(bounds)
        found = F.aggregate(steps, F.lit(0), lambda at, step: F.when(
            (at + step <= len(bounds)) & (F.get(cuts, at + step - 1) <= F.col("key")), at + step).otherwise(at))
    else:
        found = F.lit(0)
    rows = rows.withColumn("range", found)
    heads = rows.groupBy("range").agg(F.max("key").alias("head"))
    down = Window.orderBy(F.col("range").desc())
    everywhere = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    follow = heads.select("range", F.coalesce(F.lead("head").over(down), F.max("head").over(everywhere)).alias("head"))
    # at most MOST_RANGES + 1 rows, which bounds the broadcast
    after = rows.select("key", F.col("text").alias("after_text")).join(
        F.broadcast(follow.withColumnRenamed("range", "after")), F.col("key") == F.col("head")).groupBy("after").agg(
        F.max("after_text").alias("after_text")).withColumn("after_sigs", signatures(F.col("after_text")))
    order = Window.partitionBy("range").orderBy(F.col("key").desc(), F.col("text").desc())
    seen = rows.repartition("range").withColumn("sigs", signatures(F.col("text"))).select(
        "*", F.lead("text").over(order).alias("lead_text"), F.lead("sigs").over(order).alias("lead_sigs"))
    return seen.join(after, F.col("range") == F.col("after"), "left").select(
        F.when(F.col("key") > lowest, F.col("key")).alias(id_col), "text", "sigs",
        F.coalesce("lead_text", "after_text").alias("next_text"), F.coalesce("lead_sigs", "after_sigs").alias("next_sigs"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every whole text and of its edited text, and likenesses.

    The edited text has its last floor(n/3) code points replaced by the first as many
    (or all) of the next document. Columns: the id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint (signatures joined), near_edited, near_next, n_signatures, copy_of_next (whether near_next is NEAR or more). Null texts
    are empty; equal texts, repeated rows included, have equal fingerprints; other columns
    of the input play no part; an empty table gives an empty result.
    """
    n = F.char_length("text").cast("long")
    cut = F.floor(n / 3).cast("int")
    edited = with_next(docs, id_col, text_col).select(
        id_col, n.alias("n_chars"), "sigs", "next_sigs",
        F.concat(F.left("text", F.char_length("text") - cut), F.left("next_text", cut)).alias("edited"))
    both = edited.withColumn("edited_sigs", signatures(F.col("edited")))
    return both.select(
        id_col, "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        F.array_join("sigs", "").alias("fingerprint"), F.array_join("edited_sigs", "").alias("edited_fingerprint"),
        likeness(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"),
        likeness(F.col("sigs"), F.col("next_sigs")).alias("near_next"), F.size("sigs").cast("long").alias("n_signatures"),
        near(F.col("sigs"), F.col("next_sigs")).alias("copy_of_next"))
