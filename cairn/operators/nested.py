"""Walks through nested values: of JSON texts level by level as variants, of typed columns by their schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shared import drop, materialise

#: Parts of a key, in lower case, whose value nobody may see.
SENSITIVE = ("password", "token", "secret", "authorization", "api_key", "access_key")


def json_entries(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, depth, field, kind, value) of everything inside the JSON texts of ``rows``: fields of objects by name, elements of arrays with a null name.

    ``kind`` is the value's type and ``value`` its text: a string as it is, else JSON. A text that isn't JSON has no entries. One round
    goes one level deeper for all texts at once, and is written to the shared folder; there are as many rounds as the deepest text has levels.
    """
    spark = rows.sparkSession
    now = rows.select(F.col(key).alias("key"), F.try_parse_json(F.col(text).cast("string")).alias("v")).where("v IS NOT NULL")
    found, made, depth = None, [], 0
    while True:
        view = f"nested_{id(now)}"
        now.createOrReplaceTempView(view)
        below = spark.sql(f"SELECT t.key, e.key AS field, e.value AS v FROM {view} t, LATERAL variant_explode(t.v) e")
        level = materialise(below.select("key", F.lit(depth).alias("depth"), "field", F.schema_of_variant("v").alias("kind"), F.coalesce(F.try_variant_get("v", "$", "string"), F.to_json("v")).alias("value"), F.to_json("v").alias("json")), "nested")
        spark.catalog.dropTempView(view)
        made.append(level)
        found = level if found is None else found.union(level)
        inner = level.where("kind LIKE 'OBJECT%' OR kind LIKE 'ARRAY%'")
        if inner.isEmpty():
            break
        now, depth = inner.select("key", F.parse_json("json").alias("v")), depth + 1
    out = materialise(found.select("key", "depth", "field", "kind", "value"), "nested-entries")
    drop(spark, *made)
    return out.withColumnRenamed("key", key)


def json_strings(rows: DataFrame, key: str, text: str, field: str) -> DataFrame:
    """(key, values): the distinct string values, in order, of ``field``, in any case, at any depth of each JSON text; none for rows without any."""
    hits = json_entries(rows.select(key, text), key, text).where((F.lower("field") == field.lower()) & (F.col("kind") == "STRING"))
    own = hits.groupBy(key).agg(F.array_sort(F.collect_set("value")).alias("values"))
    return rows.select(key).distinct().join(own, key, "left").select(key, F.coalesce("values", F.array().cast("array<string>")).alias("values"))


def hidden(value: Column, secret: str | None) -> Column:
    """What stands for a value: ``***``, or with ``secret`` a digest under it, by which equal values can be told."""
    if secret is None:
        return F.lit("***")
    return F.substring(F.sha2(F.concat(F.lit(secret + "\n"), F.coalesce(value, F.lit("null"))).cast("binary"), 256), 1, 16)


def _text(value: Column, kind: T.DataType) -> Column:
    return F.to_json(value) if isinstance(kind, (T.StructType, T.ArrayType, T.MapType)) else value.cast("string")


def redacted(value: Column, kind: T.DataType, secret: str | None = None, fragments: tuple[str, ...] = SENSITIVE) -> Column:
    """A column of any type without what lies under a sensitive key, at any depth: fields of structs by their schema, maps by the keys of each row.

    Everything under such a key becomes one string; a map some of whose values may do so has strings for values. Nulls stay null but under a sensitive key.
    """
    def sensitive(name: str) -> bool:
        return any(f in name.lower() for f in fragments)

    if isinstance(kind, T.StructType):
        if not kind.fields:
            return value
        parts = [(hidden(_text(value[f.name], f.dataType), secret) if sensitive(f.name) else redacted(value[f.name], f.dataType, secret, fragments)).alias(f.name) for f in kind.fields]
        return F.when(value.isNotNull(), F.struct(*parts))
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: redacted(x, kind.elementType, secret, fragments))
    if isinstance(kind, T.MapType):
        pattern = "|".join(fragments)  # fragments are plain words
        return F.transform_values(value, lambda k, v: F.when(F.lower(k.cast("string")).rlike(pattern), hidden(_text(v, kind.valueType), secret)).otherwise(
            _text(redacted(v, kind.valueType, secret, fragments), kind.valueType)))
    return value


def without_secrets(rows: DataFrame, secret: str | None = None, fragments: tuple[str, ...] = SENSITIVE) -> DataFrame:
    """All columns of ``rows`` redacted; a column whose own name is sensitive is hidden whole."""
    whole = redacted(F.struct(*(F.col(f"`{c}`") for c in rows.columns)), rows.schema, secret, fragments)
    return rows.select(whole.alias("row")).select("row.*")
