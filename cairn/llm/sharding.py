"""Sharding by jump consistent hashing (DataFrame functions only).

A row's shard depends on its key and on the number of shards alone; no ring or
table is kept. Appending a shard moves rows only into the new shard, each with
probability 1/(n+1).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Multiplier of the generator, and salts that number the rows of a shard in parallel.
MULTIPLIER = 2862933555777941757
SALTS = 1024

_M32 = 0xFFFFFFFF
_C_HI, _C_LO = MULTIPLIER >> 32, MULTIPLIER & _M32


def _words(key: Column) -> tuple[Column, Column]:
    """High and low 32 bits of a long, as non-negative longs."""
    return F.shiftrightunsigned(key, 32), key.bitwiseAND(F.lit(_M32))


def _next(hi: Column, lo: Column) -> tuple[Column, Column]:
    """key * MULTIPLIER + 1 modulo 2^64 in 16- and 32-bit parts, so that no product overflows under ANSI rules."""
    a0, a1 = lo.bitwiseAND(F.lit(0xFFFF)), F.shiftright(lo, 16)
    t, s = a1 * F.lit(_C_LO), a1 * F.lit(_C_HI)
    low = a0 * F.lit(_C_LO) + F.shiftleft(t.bitwiseAND(F.lit(0xFFFF)), 16) + F.lit(1)
    h0, h1 = hi.bitwiseAND(F.lit(0xFFFF)), F.shiftright(hi, 16)
    cross = h0 * F.lit(_C_LO) + F.shiftleft((h1 * F.lit(_C_LO)).bitwiseAND(F.lit(0xFFFF)), 16)
    high = (F.shiftright(low, 32) + F.shiftright(t, 16)
            + (a0 * F.lit(_C_HI)).bitwiseAND(F.lit(_M32)) + F.shiftleft(s.bitwiseAND(F.lit(0xFFFF)), 16)
            + cross.bitwiseAND(F.lit(_M32)))
    return high.bitwiseAND(F.lit(_M32)), low.bitwiseAND(F.lit(_M32))


def jump_hash(key: Column, shards: int) -> Column:
    """Shard 0..shards-1 of a long key. Each jump passes at least one shard, so ``shards`` steps always suffice."""
    if shards < 1:
        raise ValueError("at least one shard is needed")
    hi, lo = _words(key)
    state = F.struct(hi.alias("hi"), lo.alias("lo"), F.lit(-1).cast("long").alias("b"), F.lit(0).cast("long").alias("j"))

    def step(at: Column, _: Column) -> Column:
        h, low = _next(at["hi"], at["lo"])
        drawn = F.struct(h.alias("hi"), low.alias("lo"), at["j"].alias("b"), at["j"].alias("j"))
        jumped = F.floor((at["j"] + 1) * (F.lit(float(1 << 31)) / (F.shiftright(h, 1) + 1).cast("double"))).cast("long")
        return F.when(at["j"] < shards, drawn.withField("j", jumped)).otherwise(at)

    return F.aggregate(F.sequence(F.lit(1), F.lit(shards)), state, step, lambda at: at["b"].cast("int"))


def shard(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Shard, place in the shard and shard after growth of every row.

    Columns: the id, ``size`` (UTF-8 bytes + 1; a null text has none), ``text_crc32``
    (of an empty text for null), ``law`` = key, ``shard``, ``slot`` (gapless from 0 in
    each shard), ``grown_shard`` (with one more shard). A null id counts as key -1.
    Equal ids share a shard and get slots of their own; other columns of the input,
    whatever their names, play no part. An empty table gives an empty result.

    Slots: rows are numbered within (shard, salt), salt being bits of the mixed key,
    and each such part starts where the parts before it end. So a shard of any size
    is numbered by SALTS tasks; the table of starts has at most shards * SALTS rows,
    which bounds the broadcast.
    """
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(-1).cast("long"))
    salt = _next(*_words(key))[0].bitwiseAND(F.lit(SALTS - 1)).cast("int")
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(key.alias("key"), jump_hash(key, shards).alias("shard"), salt.alias("salt"))
    upto = Window.partitionBy("shard").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = keyed.groupBy("shard", "salt").count().select(
        "shard", "salt", F.coalesce(F.sum("count").over(upto), F.lit(0)).alias("start"))
    rows = docs.select(
        F.col(id_col).alias(id_col), key.alias("key"), (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), jump_hash(key, shards).alias("shard"), salt.alias("salt"),
        jump_hash(key, shards + 1).alias("grown_shard"))
    order = Window.partitionBy("shard", "salt").orderBy("key", "text_crc32", "size")
    numbered = rows.withColumn("at", F.row_number().over(order) - 1)
    return numbered.join(F.broadcast(starts), ["shard", "salt"]).select(
        id_col, "size", "text_crc32", F.lit("key").alias("law"), "shard",
        (F.col("start") + F.col("at")).cast("long").alias("slot"), "grown_shard")
