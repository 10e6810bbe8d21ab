"""Queries of walks through nested values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import nested as N
from .registry import query


def _rules(g) -> DataFrame:
    """Events as rules whose effects lie at several depths, some with escapes, in nested arrays, or of another type."""
    half = F.when(F.col("event_id") % 2 == 1, F.concat(F.lit('"'), "event_type", F.lit('"'))).otherwise("null")
    return g.events.select("event_id", F.concat(F.lit('{"if": [{"Effect": "de\\"ny '), "event_type", F.lit('"}, [[{"effect": {"effect": "audit"}}]]], "then": {"effect": '), half, F.lit('}, "props": '), "props", F.lit("}")).alias("rule"))


query("x15_json_values", """SELECT event_id, list_sort(list_filter(['audit', 'de"ny ' || event_type, CASE WHEN event_id % 2 = 1 THEN event_type END], lambda x: x IS NOT NULL)) AS effects FROM {events}""")(
    lambda g: N.json_strings(_rules(g), "event_id", "rule", "effect").select("event_id", F.col("values").alias("effects")))
query("x15_json_entries", """SELECT depth, field, kind, count(*) AS n FROM (SELECT 0 AS depth, 'if' AS field, 'ARRAY' AS kind FROM {events} UNION ALL SELECT 0, 'then', 'OBJECT' FROM {events} UNION ALL SELECT 0, 'props', 'OBJECT' FROM {events}
    UNION ALL SELECT 1, NULL, 'OBJECT' FROM {events} UNION ALL SELECT 1, NULL, 'ARRAY' FROM {events} UNION ALL SELECT 1, 'k', 'BIGINT' FROM {events} UNION ALL SELECT 1, 'effect', CASE WHEN event_id % 2 = 1 THEN 'STRING' ELSE 'VOID' END FROM {events}
    UNION ALL SELECT 2, 'Effect', 'STRING' FROM {events} UNION ALL SELECT 2, NULL, 'ARRAY' FROM {events} UNION ALL SELECT 3, NULL, 'OBJECT' FROM {events} UNION ALL SELECT 4, 'effect', 'OBJECT' FROM {events} UNION ALL SELECT 5, 'effect', 'STRING' FROM {events})
    GROUP BY ALL""")(lambda g: N.json_entries(_rules(g), "event_id", "rule").groupBy("depth", "field", F.regexp_extract("kind", "^[A-Z]+", 0).alias("kind")).agg(F.count(F.lit(1)).alias("n")))


def _accounts(g) -> DataFrame:
    """Customers with secrets in structs, arrays of structs and maps."""
    return g.customer.select("c_custkey", F.struct(F.col("c_name").alias("note"), F.struct(F.col("c_name").alias("api_key"), F.col("c_nationkey").alias("port")).alias("login")).alias("settings"),
                             F.array(F.struct(F.col("c_mktsegment").alias("clientSecret"), F.lit("x").alias("kind"))).alias("clients"), F.create_map(F.lit("Authorization"), F.col("c_acctbal").cast("int"), F.lit("limit"), F.col("c_nationkey")).alias("free"))


_flat = lambda df: df.select("c_custkey", F.col("settings.note").alias("note"), F.col("settings.login.api_key").alias("login"), F.col("settings.login.port").alias("port"), F.col("clients")[0]["clientSecret"].alias("client"),
                             F.col("clients")[0]["kind"].alias("kind"), F.col("free")["Authorization"].alias("authorization"), F.col("free")["limit"].alias("limit_"))
query("f14_redaction", """SELECT c_custkey, c_name AS note, '***' AS login, c_nationkey AS port, '***' AS client, 'x' AS kind, '***' AS authorization, c_nationkey::VARCHAR AS limit_ FROM {customer}""")(
    lambda g: _flat(N.without_secrets(_accounts(g))))
query("f14_keyed", """SELECT c_custkey, c_name AS note, substr(sha256('salt' || chr(10) || c_name), 1, 16) AS login, c_nationkey AS port, substr(sha256('salt' || chr(10) || c_mktsegment), 1, 16) AS client, 'x' AS kind,
    substr(sha256('salt' || chr(10) || trunc(c_acctbal)::INT), 1, 16) AS authorization, c_nationkey::VARCHAR AS limit_ FROM {customer}""")(lambda g: _flat(N.without_secrets(_accounts(g), "salt")))
