"""Queries of sinks and streams that deliver once or route what can't be delivered."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import fresh_dir
from ..sources import insert_once as Z
from ..streaming import routing as R
from .registry import query


def _items(g) -> DataFrame:
    """Orders as items of batches: a customer's orders are a batch of the customer's nation, some with a wrong digest."""
    text = F.col("o_orderpriority")
    return g.orders.join(g.customer, F.col("o_custkey") == F.col("c_custkey")).select(
        F.concat(F.lit("n"), F.col("c_nationkey")).alias("project"), F.col("o_custkey").cast("string").alias("batch"), F.concat(F.lit("o/"), F.col("o_orderkey") % 200).alias("path"), text.alias("content"),
        F.when(F.col("o_orderkey") % 97 == 3, F.lit("0" * 64)).otherwise(F.sha2(text.cast("binary"), 256)).alias("sha256"), F.octet_length(text).cast("long").alias("bytes"), F.lit(False).alias("tombstone"))


def _inserted(g) -> DataFrame:
    """Two epochs, each delivered twice, then all batches again as a third, into a new store; what is stored."""
    items, write, root = _items(g), None, fresh_dir(g.spark, "sync-batches")
    write = Z.sink(root, most_items=16)
    for epoch, part in ((0, "CAST(batch AS INT) % 2 = 0"), (1, "CAST(batch AS INT) % 2 = 1"), (0, "CAST(batch AS INT) % 2 = 0"), (1, "CAST(batch AS INT) % 2 = 1"), (2, "true")):
        write(items.where(part), epoch)
    return Z.Store(g.spark, root).read().select("project", "batch_id", "items", "bytes", "epoch")


query("s18_inserted", """WITH i AS (SELECT concat('n', c_nationkey) AS project, o_custkey AS batch, concat('o/', o_orderkey % 200) AS path, o_orderpriority AS content, o_orderkey % 97 = 3 AS wrong FROM {orders} JOIN {customer} ON o_custkey = c_custkey),
    b AS (SELECT project, batch, count(*) AS items, '{"snapshots":[' || string_agg('{"bytes":' || strlen(content) || ',"content":"' || content || '","path":"' || path || '","sha256":"' || sha256(content) || '"}', ',' ORDER BY path) || '],"tombstones":[]}' AS payload
    FROM i GROUP BY 1, 2 HAVING count(*) <= 16 AND NOT bool_or(wrong) AND count(DISTINCT path) = count(*))
    SELECT project, sha256(project || chr(10) || payload) AS batch_id, items::INT AS items, strlen(payload)::BIGINT AS bytes, min(batch % 2)::INT AS epoch FROM b GROUP BY ALL""")(_inserted)
query("s18_reasons", """WITH i AS (SELECT concat('n', c_nationkey) AS project, o_custkey AS batch, concat('o/', o_orderkey % 200) AS path, o_orderkey % 97 = 3 AS wrong FROM {orders} JOIN {customer} ON o_custkey = c_custkey)
    SELECT project, batch::VARCHAR AS batch, CASE WHEN count(*) > 16 THEN 'too many items' WHEN count(DISTINCT path) < count(*) THEN 'conflicting path' WHEN bool_or(wrong) THEN 'content does not match its digest' END AS reason
    FROM i GROUP BY 1, 2 HAVING reason IS NOT NULL""")(lambda g: Z.batches(_items(g), 16).where("reason IS NOT NULL").select("project", "batch", "reason"))

#: Events as entries: a sign-up publishes its user's job, a purchase or an error is an outcome, a click can't be read, a view publishes with a payload by hour.
_entries = lambda g: R.readable(g.events.select(F.col("ts").alias("at"), F.when(F.col("event_type") == "click", F.concat(F.lit("{click "), "event_id")).otherwise(F.to_json(F.struct(
    F.concat(F.lit("j"), "user_id").alias("job_id"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "signup", "signup").when(F.col("event_type") == "view", F.concat(F.lit("view "), F.hour("ts") % 2)).alias("payload"),
    F.when(F.col("event_type").isin("purchase", "error"), F.col("event_type") == "purchase").alias("ok")))).alias("value")))
_ROUTED = """e AS (SELECT concat('j', user_id) AS job_id, event_id AS seq, CASE event_type WHEN 'signup' THEN 'signup' WHEN 'view' THEN concat('view ', hour(ts) % 2) END AS payload,
      CASE event_type WHEN 'purchase' THEN true WHEN 'error' THEN false END AS ok FROM {events} WHERE event_type <> 'click'),
    f AS (SELECT *, first_value(payload IGNORE NULLS) OVER w AS was, count(payload) OVER w AS k FROM e WINDOW w AS (PARTITION BY job_id ORDER BY seq ROWS UNBOUNDED PRECEDING)),
    c AS (SELECT *, sum((ok IS NOT NULL AND was IS NOT NULL AND NOT ok)::INT) OVER w AS bad, coalesce(max((ok IS NOT NULL AND was IS NOT NULL AND ok)::INT) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS won FROM f WINDOW w AS (PARTITION BY job_id ORDER BY seq)),
    r AS (SELECT *, bad - (ok IS NOT NULL AND was IS NOT NULL AND NOT ok)::INT AS bad_before FROM c)"""
query("t05_quarantine", f"""WITH {_ROUTED} SELECT job_id, seq, CASE WHEN was IS NULL THEN 'job was never published' ELSE 'attempts are spent' END AS reason, CASE WHEN was IS NOT NULL THEN 3 END::INT AS attempt FROM r
    WHERE ok IS NOT NULL AND (was IS NULL OR NOT ok AND bad = 3 AND won = 0)
    UNION ALL SELECT 'unreadable-' || md5('{{click ' || event_id), NULL, 'unreadable entry', NULL FROM {{events}} WHERE event_type = 'click'""")(
    lambda g: R.routed(_entries(g)).where("output = 'quarantine'").select("job_id", "seq", "reason", "attempt"))
query("t01_publications", f"""WITH {_ROUTED} SELECT job_id, seq, CASE WHEN k = 1 THEN 'published' WHEN payload = was THEN 'existing' ELSE 'conflict' END AS output FROM r WHERE payload IS NOT NULL""")(
    lambda g: R.routed(_entries(g)).where("output IN ('published', 'existing', 'conflict')").select("job_id", "seq", "output"))
query("t04_attempts", f"""WITH {_ROUTED} SELECT job_id, seq, CASE WHEN won = 1 OR bad_before >= 3 THEN 'ignored' WHEN ok THEN 'done' ELSE 'retrying' END AS output,
    CASE WHEN won = 1 OR bad_before >= 3 THEN NULL ELSE bad + ok::INT END::INT AS attempt, CASE WHEN won = 0 AND bad_before < 3 AND NOT ok THEN least(30.0, pow(2, bad - 1)) END::DOUBLE AS pause_s FROM r
    WHERE ok IS NOT NULL AND was IS NOT NULL AND NOT (NOT ok AND bad = 3 AND won = 0)""")(
    lambda g: R.routed(_entries(g)).where("output IN ('done', 'retrying', 'ignored')").select("job_id", "seq", "output", "attempt", "pause_s"))


def _cascade(g) -> DataFrame:
    """The rows that are left of every table once two files are deleted."""
    from ..graph_model import KEYS, RELATIONS
    from ..sources import parted_graph as P

    root = fresh_dir(g.spark, "parted-graph")
    P.create(g.spark, root, g, 8).delete_files(g.file.where("path IN ('s/3', 's/5')"))
    left, out = P.PartedGraph(g.spark, root), None
    for name in [*KEYS, *RELATIONS]:
        a, b = (F.col("src"), F.col("dst")) if name in RELATIONS else (F.col(KEYS[name]), F.lit(None).cast("string"))
        rows = left[name].select(F.lit(name).alias("table_name"), a.alias("a"), b.alias("b"))
        out = rows if out is None else out.union(rows)
    return out


_GONE = """f AS (SELECT unnest(['s/3', 's/5']) AS gone), s AS (SELECT qualified_name AS gone FROM {symbol} WHERE file_path IN (SELECT gone FROM f)),
    v AS (SELECT qualified_name AS gone FROM {variable} WHERE file_path IN (SELECT gone FROM f) OR scope_qname IN (SELECT gone FROM s))"""


def _kept(name: str, source: str, target: str) -> str:
    where = [f"{c} NOT IN (SELECT gone FROM {x})" for c, x in (("src", source), ("dst", target)) if x]
    return f"SELECT '{name}' AS table_name, src AS a, dst AS b FROM {{{name}}}" + (f" WHERE {' AND '.join(where)}" if where else "")


query("s15_cascade_delete", f"""WITH {_GONE} SELECT 'repository' AS table_name, path AS a, NULL::VARCHAR AS b FROM {{repository}} UNION ALL SELECT 'file', path, NULL FROM {{file}} WHERE path NOT IN (SELECT gone FROM f)
    UNION ALL SELECT 'symbol', qualified_name, NULL FROM {{symbol}} WHERE qualified_name NOT IN (SELECT gone FROM s) UNION ALL SELECT 'variable', qualified_name, NULL FROM {{variable}} WHERE qualified_name NOT IN (SELECT gone FROM v)
    UNION ALL {" UNION ALL ".join(_kept(*x) for x in (("contains", "", "f"), ("defines", "f", "s"), ("imports", "f", "f"), ("calls", "s", "s"), ("uses_variable", "s", "v"), ("flows_to", "v", "v")))}""")(_cascade)
