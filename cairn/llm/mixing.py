"""Mixing sources to target weights by systematic sampling.

Every document of a source has the same expected number of copies, the source's
target over its size. Along a fixed order these expectations are prefix-summed,
one offset drawn from the seed is added, and a document is emitted once for each
integer that the sum crosses on it. Ordering by size makes a source's taken words
differ from its target by less than the size of its largest document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialise

WORD = r"[^\x20\x09-\x0D]+"
#: Documents of one source and size are numbered in so many parts at once.
SALTS = 64


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def offset(seed: str, source: Column) -> Column:
    """Number in [0, 1) that seed and source decide; nulls draw as the word ``null`` with a mark that no text shares."""
    name = F.coalesce(F.concat(F.lit(f"{seed}:"), source), F.lit(f"{seed};null"))
    return F.conv(F.substring(F.md5(name.cast("binary")), 1, 8), 16, 10).cast("long") / F.lit(float(1 << 32))


def targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: int = 2) -> DataFrame:
    """``sizes``: (source, source_size), one row a source. Adds ``target``.

    Water filling in closed form: with sources ordered by cap over weight, a source is
    capped if its cap is at most its part of what the capped ones before it leave. The
    windows run over one row a source, never over documents.
    """
    every = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    named = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.select(
        "source", "source_size",
        F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(named) - 1) % len(weights) + 1).cast("long").alias("w"),
        (F.col("source_size") * most).alias("cap"), (F.sum("source_size").over(every) * F.lit(share)).alias("budget"))
    by_ratio = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before, rest = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    filled = ranked.withColumn("full", F.col("cap") * F.sum("w").over(rest).cast("double")
                               <= (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0))) * F.col("w"))
    level = ((F.col("budget") - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(every), F.lit(0)))
             / F.nullif(F.coalesce(F.sum(F.when(~F.col("full"), F.col("w"))).over(every), F.lit(0)), F.lit(0)))
    return filled.select("source", "source_size", F.when(F.col("full"), F.col("cap").cast("double"))
                         .otherwise(F.least(level * F.col("w"), F.col("cap").cast("double"))).alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: int = 2, seed: str = "mix",
        carry: bool = False) -> DataFrame:
    """How often the mix takes each document of ``docs`` (doc_id, text, source).

    Columns: doc_id, size (words; null text 0), source_size, target, copies, taken
    (words, copies * size); with ``carry`` also ``row``, the input row as a struct,
    so that columns of any name survive. Null sources form a source of their own,
    the last. Rows that share an id are ordered by a hash of their text. A source without words has target 0 and gives no copy. Repeated rows are
    documents of their own. An empty table gives an empty result. ``targets`` keeps every
    target at ``most`` times its source's size, so a document has at most ``most`` copies.

    Rows are shuffled once, by (source, size, salt), so no source is one task's work; places of
    these parts come from their counts, summed within bands of size and over a source's bands.
    Texts are read once, with ``carry`` twice; what is kept of them meanwhile is four numbers a row.
    """
    rows = docs.select(
        F.col("doc_id"), F.col("source"), word_count(F.col("text")).alias("size"),
        F.xxhash64("text").alias("mark"), F.pmod(F.coalesce(F.col("doc_id"), F.xxhash64("text")), F.lit(SALTS)).cast("int").alias("salt"),
        *([F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if carry else []))
    rows = rows if carry else materialise(rows, "mixing-sizes")
    cells = materialise(rows.groupBy("source", "size", "salt").agg(F.count(F.lit(1)).alias("n")), "mixing-cells")
    goal = targets(cells.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, share, most)
    # a source's cells are summed by bands of size, the bands of a source being few
    band = F.floor(F.log2(F.col("size") + 1.0) * 8).cast("int")
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    bands = cells.groupBy("source", band.alias("band")).agg(F.sum("n").alias("n")).select(
        F.col("source").alias("b_source"), F.col("band").alias("b_band"), F.coalesce(F.sum("n").over(before.partitionBy("source").orderBy("band")), F.lit(0)).alias("b_start"))
    inner = F.coalesce(F.sum("n").over(before.partitionBy("source", "band").orderBy("size", "salt")), F.lit(0))
    places = cells.withColumn("band", band).withColumn("inner", inner).join(
        bands, F.col("source").eqNullSafe(F.col("b_source")) & (F.col("band") == F.col("b_band"))).select("source", "size", "salt", (F.col("b_start") + F.col("inner")).alias("start"))
    places = places.join(goal.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left").select(
        F.col("source").alias("c_source"), F.col("size").alias("c_size"), F.col("salt").alias("c_salt"), "start", "source_size", "target")
    order = Window.partitionBy("source", "size", "salt").orderBy(F.col("doc_id").asc_nulls_first(), "mark")
    placed = rows.withColumn("nth", F.row_number().over(order)).join(
        places, F.col("source").eqNullSafe(F.col("c_source")) & (F.col("size") == F.col("c_size")) & (F.col("salt") == F.col("c_salt")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    upper = F.floor(rate * (F.col("start") + F.col("nth")) + offset(seed, F.col("source")))
    lower = F.floor(rate * (F.col("start") + F.col("nth") - 1) + offset(seed, F.col("source")))
    copies = F.when(upper - lower <= most, upper - lower).otherwise(F.raise_error(F.lit(f"a document is due more than {most} times"))).cast("long")
    return placed.select("doc_id", "size", "source_size", "target", copies.alias("copies"),
                         (copies * F.col("size")).alias("taken"), *(["row"] if carry else []))


def emit(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as it is taken, with the columns of ``docs``."""
    taken = mix(docs, carry=True, **how).where(F.col("copies") > 0)
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")
