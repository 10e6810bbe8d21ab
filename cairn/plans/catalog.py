"""Registered queries over the driver's tables, each with the SQL of the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as X
from ..operators import aggregates as A
from ..operators import graph as G
from ..operators import joins as J
from ..operators import lookup as L
from ..operators import readiness as D
from ..operators import scoring as E
from ..operators import sets as U
from ..operators import windows as W
from ..shared import materialise
from ..sources import edge_store as B
from ..views import Graph
from .registry import oracle_sql, queries, query

__all__ = ["oracle_sql", "queries"]

# --- scans, sources and sinks -------------------------------------------------

query("s04_label_counts", "SELECT kind, count(*) AS n FROM {node} GROUP BY kind")(lambda g: A.kind_counts(g.node))
query("s05_index_lookup", "SELECT qualified_name, name, file_path FROM {symbol} WHERE qualified_name = 'p.7'")(
    lambda g: L.by_key(g.symbol, "qualified_name", "p.7").select("qualified_name", "name", "file_path"))
query("s06_snapshot_scan", """SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM {events}""")(
    lambda g: g.events.select("event_id", F.from_json("props", "k INT")["k"].alias("k")))
query("s07_optional_filters", "SELECT id, path FROM {audit} WHERE scope = 'api' AND lower(actor_name) LIKE '%actor1%'")(
    lambda g: L.optional_filter(g.audit, {"scope": "api", "project_name": None}, {"actor_name": "ACTOR1", "path": None}).select("id", "path"))
query("s10_tree_scan", """SELECT coalesce(o.id, n.id) AS id, CASE WHEN o.id IS NULL THEN 'created' WHEN n.id IS NULL THEN 'deleted' ELSE 'modified' END AS change
    FROM (SELECT * FROM {resource_old} WHERE kind LIKE 'Brand#1%') o FULL JOIN (SELECT * FROM {resource_new} WHERE kind LIKE 'Brand#1%') n ON o.id = n.id
    WHERE o.content_hash IS DISTINCT FROM n.content_hash""")(
    lambda g: J.diff(*(t.where(F.col("kind").rlike("^Brand#1")) for t in (g.resource_old, g.resource_new))).select("id", "change"))
query("s14_upsert", """SELECT id, content_hash FROM {resource_new} UNION ALL SELECT id, content_hash FROM {resource_old} o
    WHERE NOT EXISTS (SELECT 1 FROM {resource_new} n WHERE n.id = o.id)""")(
    lambda g: g.resource_new.select("id", "content_hash").union(g.resource_old.join(g.resource_new.select("id"), "id", "left_anti").select("id", "content_hash")))
query("s16_export_page", "SELECT qualified_name, name FROM {symbol} WHERE qualified_name > 'p.15' ORDER BY qualified_name LIMIT 51")(
    lambda g: W.page_after(g.symbol.select("qualified_name", "name"), "qualified_name", "p.15", 50))
query("s20_retention", """SELECT id, project_id FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY occurred_at DESC, id DESC) AS r FROM {activity}) WHERE r <= 5""")(
    lambda g: W.latest(g.activity, ["project_id"], [F.desc("occurred_at"), F.desc("id")], 5).select("id", "project_id"))

# --- filters ------------------------------------------------------------------

query("f01_find_symbol", "SELECT qualified_name, name, symbol_type, file_path FROM {symbol} WHERE name = 'red widget' OR contains(qualified_name, 'red widget') ORDER BY qualified_name LIMIT 20")(
    lambda g: L.named(g.symbol, "red widget").select("qualified_name", "name", "symbol_type", "file_path"))
query("f02_find_variable", "SELECT qualified_name, role, scope_qname FROM {variable} WHERE name = 'view' OR contains(qualified_name, 'view') ORDER BY qualified_name LIMIT 20")(
    lambda g: L.named(g.variable, "view").select("qualified_name", "role", "scope_qname"))
query("f03_retrieve_context", """SELECT qualified_name, symbol_type, file_path, f.language FROM {symbol} s JOIN {file} f ON s.file_path = f.path
    WHERE contains(s.name, 'bolt') OR contains(qualified_name, 'bolt')""")(lambda g: L.context(g.symbol, g.file, "bolt").select("qualified_name", "symbol_type", "file_path", "language"))
query("f04_viewer_search", "SELECT kind, id, name FROM {node} WHERE contains(lower(coalesce(id, '')), 'ring') OR contains(lower(coalesce(name, '')), 'ring')")(
    lambda g: L.viewer_search(g.node, "RING"))
query("f05_audit_filter", "SELECT id, actor_name, path FROM {audit} WHERE lower(actor_name) LIKE '%r2%' AND lower(path) LIKE '%queue%'")(
    lambda g: L.optional_filter(g.audit, None, {"actor_name": "R2", "path": "Queue"}).select("id", "actor_name", "path"))
query("f06_report_filter", """SELECT id, project_id, event_type FROM {activity} WHERE occurred_at >= TIMESTAMP '2024-01-05' AND occurred_at < TIMESTAMP '2024-01-12'
    AND project_id IN ('proj1', 'proj2') AND event_type = 'view' AND coalesce(status, 'unspecified') = 'open' AND contains(lower(title || ' ' || summary), 'ticket')""")(
    lambda g: L.report_filter(g.activity, "2024-01-05", "2024-01-12", ["proj1", "proj2"], "view", "open", "TICKET").select("id", "project_id", "event_type"))
query("f07_masked_columns", "SELECT id, event_type, CASE WHEN event_type = 'signup' THEN summary ELSE '' END AS summary FROM {activity}")(
    lambda g: L.masked(g.activity.select("id", "event_type", "summary"), F.col("event_type") == "signup", ["summary"]))
query("f08_correlation", "SELECT id FROM {activity} WHERE (contains(lower(owner), '12') OR contains(lower(props), '12') OR contains(lower(source_item_id), '12')) AND (contains(lower(event_type), 'click'))")(
    lambda g: L.correlated(L.correlated(g.activity, F.array("owner", "props", "source_item_id"), {"item": "12"}), F.array("event_type"), {"type": "CLICK"}).select("id"))
query("f09_edge_kinds", "SELECT kind, src, dst FROM {edge} WHERE kind IN ('CALLS', 'IMPORTS')")(lambda g: L.of_kinds(g.edge, ["CALLS", "IMPORTS"], {"CALLS", "IMPORTS", "DEFINES", "CONTAINS", "USES_VARIABLE", "FLOWS_TO"}))
query("f10_orphans", "SELECT kind, id FROM {node} WHERE id IN (SELECT src FROM {calls} UNION SELECT dst FROM {calls})")(lambda g: L.without_orphans(g.node, g.calls).select("kind", "id"))
query("f12_credentials", "SELECT doc_id FROM {documents} WHERE regexp_matches(text, '" + L.CREDENTIAL + "')")(
    lambda g: g.documents.where(L.has_credential(F.col("text"))).select("doc_id"))
_CATEGORY = """CASE WHEN status_code >= 400 OR method NOT IN ('GET', 'HEAD') OR regexp_matches(path, '/(login|logout|users|tokens|runtime-config|updates|audit-retention)(/|$)') THEN 'protected'
    WHEN path IN ('/api/auth/projects/index-status', '/api/auth/audit', '/api/auth/audit/paged', '/api/admin/schedules') THEN 'polling' ELSE 'request' END"""
query("f15_retention_predicate", f"""SELECT id, category FROM (SELECT id, created_at, {_CATEGORY} AS category FROM {{audit}}) WHERE created_at < TIMESTAMP '2024-01-20' - to_days(CASE category WHEN 'protected' THEN 15 WHEN 'polling' THEN 3 ELSE 10 END)""")(
    lambda g: L.expired(g.audit, "2024-01-20", {"protected": 15, "polling": 3, "request": 10}).select("id", "category"))
query("f16_visible_rows", "SELECT id FROM {activity} WHERE project_id IN (SELECT 'proj' || n_nationkey FROM {nation} WHERE n_regionkey = 1)")(
    lambda g: L.visible(g.activity, g.nation.where("n_regionkey = 1").select(F.concat(F.lit("proj"), "n_nationkey").alias("project_id"))).select("id"))

# --- joins --------------------------------------------------------------------

query("j01_callers", "SELECT s.qualified_name, s.name, s.file_path FROM {calls} c JOIN {symbol} s ON c.src = s.qualified_name WHERE c.dst = 'p.10' ORDER BY 1 LIMIT 20")(lambda g: B.callers(B.of(g), "p.10"))
query("j02_callees", "SELECT s.qualified_name, s.name, s.file_path FROM {calls} c JOIN {symbol} s ON c.dst = s.qualified_name WHERE c.src = 'p.10' ORDER BY 1 LIMIT 20")(lambda g: B.callees(B.of(g), "p.10"))
query("j03_file_imports", "SELECT path, language FROM {imports} i JOIN {file} f ON i.dst = f.path WHERE i.src = 's/5' ORDER BY path LIMIT 20")(lambda g: B.file_imports(B.of(g), "s/5", 20))
query("j04_file_dependents", "SELECT path, language FROM {imports} i JOIN {file} f ON i.src = f.path WHERE i.dst = 's/5'")(lambda g: B.file_imports(B.of(g), "s/5", None, True))
query("j05_dependency_overview", "SELECT i.src, a.language AS src_language, i.dst, b.language AS dst_language FROM {imports} i JOIN {file} a ON i.src = a.path JOIN {file} b ON i.dst = b.path ORDER BY 1, 3 LIMIT 30")(
    lambda g: J.dependency_overview(g.imports, g.file))
query("j06_relation_flows", """SELECT f.src AS source, f.dst AS target, v.file_path AS far_path, v.line_number::BIGINT AS line, f.scope_qname, f.line_number, f.flow_type FROM {flows_to} f JOIN {variable} v ON f.dst = v.qualified_name
    WHERE f.src = 'u.8:click' ORDER BY 1, 2, 5, 6, 7 LIMIT 21""")(lambda g: B.relation(B.of(g), "flows_to", "u.8:click"))
query("j06_relation_callers", """SELECT c.src AS source, c.dst AS target, s.file_path AS far_path, s.line_start::BIGINT AS line, NULL AS scope_qname, NULL::BIGINT AS line_number, NULL AS flow_type FROM {calls} c JOIN {symbol} s ON c.src = s.qualified_name
    WHERE c.dst = 'p.3' ORDER BY 1, 2 LIMIT 21""")(lambda g: B.relation(B.of(g), "calls", "p.3", "incoming"))
query("j06_relation_contains", """SELECT c.src AS source, c.dst AS target, f.path AS far_path, NULL::BIGINT AS line, NULL AS scope_qname, NULL::BIGINT AS line_number, NULL AS flow_type FROM {contains} c JOIN {file} f ON c.dst = f.path
    WHERE c.src = 'n/3' ORDER BY 1, 2 LIMIT 21""")(lambda g: B.relation(B.of(g), "contains", "n/3"))
query("j07_file_dependencies", """SELECT a.src AS from_file, b.src AS to_file, count(DISTINCT c.src) AS callers, count(DISTINCT c.dst) AS callees, count(*) AS calls
    FROM {calls} c JOIN {defines} a ON c.src = a.dst JOIN {defines} b ON c.dst = b.dst WHERE a.src <> b.src GROUP BY 1, 2""")(lambda g: J.file_call_dependencies(g.defines, g.calls, None))
query("j08_variable_lineage", """SELECT v.qualified_name, coalesce((SELECT list_sort(list(DISTINCT src)) FROM {flows_to} f WHERE f.dst = v.qualified_name), []) AS sources,
    coalesce((SELECT list_sort(list(DISTINCT dst)) FROM {flows_to} f WHERE f.src = v.qualified_name), []) AS targets FROM {variable} v""")(lambda g: J.lineage(g.variable, g.flows_to))
_METRICS = """SELECT v.qualified_name, v.scope_qname, v.role, coalesce(i.n, 0) AS flows_in, coalesce(o.n, 0) AS flows_out FROM {variable} v
    LEFT JOIN (SELECT dst, scope_qname, count(DISTINCT src) AS n FROM {flows_to} GROUP BY 1, 2) i ON i.dst = v.qualified_name AND i.scope_qname = v.scope_qname
    LEFT JOIN (SELECT src, scope_qname, count(DISTINCT dst) AS n FROM {flows_to} GROUP BY 1, 2) o ON o.src = v.qualified_name AND o.scope_qname = v.scope_qname"""
query("j09_scope_metrics", _METRICS)(lambda g: J.scope_metrics(g.variable, g.flows_to))
query("j10_missing_names", """SELECT user_id AS key, count(*) AS total, count(*) FILTER (event_id % 3000 >= (SELECT count(*) FROM {part})) AS missing,
    round(count(*) FILTER (event_id % 3000 >= (SELECT count(*) FROM {part}))::DOUBLE / count(*), 4) AS share FROM {events} GROUP BY user_id""")(
    lambda g: J.missing_share(g.events.select(F.col("user_id").alias("key"), F.concat(F.lit("p."), F.col("event_id") % 3000).alias("name")), g.symbol))
query("j11_scope_parameters", """SELECT scope_qname, parameter_index, line_number, name FROM {variable} WHERE role = 'parameter' AND scope_qname IN (SELECT concat('u.', user_id) FROM {events} WHERE value > 300)""")(
    lambda g: J.scope_parameters(g.variable, g.events.where("value > 300").select(F.concat(F.lit("u."), "user_id").alias("scope_qname"))))
query("j12_resolve_calls", """WITH r AS (SELECT call_id, min(a.file_path) AS file_path, min(b.name) AS callee_name FROM {raw_call} c JOIN {symbol} a ON c.src = a.qualified_name JOIN {symbol} b ON c.dst = b.qualified_name GROUP BY call_id),
    t AS (SELECT call_id, 1 AS tier, count(*) AS n, min(qualified_name) AS target FROM r JOIN {symbol} s ON s.name = r.callee_name AND s.file_path = r.file_path GROUP BY 1
      UNION ALL SELECT call_id, 2, count(*), min(qualified_name) FROM r JOIN {imports} i ON i.src = r.file_path JOIN {symbol} s ON s.name = r.callee_name AND s.file_path = i.dst GROUP BY 1
      UNION ALL SELECT call_id, 3, count(*), min(qualified_name) FROM r JOIN {symbol} s ON s.name = r.callee_name GROUP BY 1),
    f AS (SELECT *, row_number() OVER (PARTITION BY call_id ORDER BY tier) AS k FROM t) SELECT call_id, target, tier FROM f WHERE k = 1 AND n = 1""")(
    lambda g: J.resolve_calls(g.raw_call.join(g.symbol.select(F.col("qualified_name").alias("src"), "file_path"), "src").join(
        g.symbol.select(F.col("qualified_name").alias("dst"), F.col("name").alias("callee_name")), "dst").groupBy("call_id").agg(
        F.min("file_path").alias("file_path"), F.min("callee_name").alias("callee_name")), g.symbol, g.imports))
query("j13_resolve_imports", """WITH r AS (SELECT DISTINCT concat('n/', c_nationkey) AS src, concat('s/', c_custkey % 150) AS module FROM {customer}),
    k AS (SELECT path AS p FROM {file} WHERE path NOT LIKE '%7' UNION SELECT path || '.py' FROM {file} WHERE path LIKE '%7')
    SELECT src, module, coalesce((SELECT p FROM k WHERE p = module), (SELECT p FROM k WHERE p = module || '.py')) AS dst FROM r
    WHERE module IN (SELECT p FROM k) OR module || '.py' IN (SELECT p FROM k)""")(
    lambda g: J.resolve_imports(g.customer.select(F.concat(F.lit("n/"), "c_nationkey").alias("src"), F.concat(F.lit("s/"), F.col("c_custkey") % 150).alias("module")).distinct(),
                                g.file.select(F.when(F.col("path").endswith("7"), F.concat("path", F.lit(".py"))).otherwise(F.col("path")).alias("path"))))
query("j14_label_enrichment", "SELECT o_orderkey AS id, c_name AS label FROM {orders} LEFT JOIN {customer} ON o_custkey = c_custkey")(
    lambda g: J.labelled(g.orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("k")), g.customer.select(F.col("c_custkey").alias("k"), F.col("c_name").alias("label")), "k").select("id", "label"))
query("j15_active_tokens", "SELECT c_custkey AS token, c_nationkey AS project_id FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey WHERE c_acctbal > 0 AND n_regionkey < 3")(
    lambda g: J.active_tokens(g.customer.select(F.col("c_custkey").alias("token"), F.col("c_nationkey").alias("project_id"), (F.col("c_acctbal") > 0).cast("int").alias("token_active")),
                              g.nation.select(F.col("n_nationkey").alias("project_id"), (F.col("n_regionkey") < 3).cast("int").alias("project_active"))).select("token", "project_id"))
query("j16_snapshot_diff", """SELECT coalesce(o.id, n.id) AS id, CASE WHEN o.id IS NULL THEN 'created' WHEN n.id IS NULL THEN 'deleted' ELSE 'modified' END AS change, o.content_hash AS before, n.content_hash AS after
    FROM {resource_old} o FULL JOIN {resource_new} n ON o.id = n.id WHERE o.id IS NULL OR n.id IS NULL OR o.content_hash IS DISTINCT FROM n.content_hash""")(lambda g: J.diff(g.resource_old, g.resource_new))
query("j17_relation_summary", """SELECT s.qualified_name, coalesce((SELECT list_sort(list(src)) FROM (SELECT src FROM {calls} c WHERE c.dst = s.qualified_name ORDER BY src LIMIT 3)), []) AS callers,
    coalesce((SELECT list_sort(list(dst)) FROM (SELECT dst FROM {calls} c WHERE c.src = s.qualified_name ORDER BY dst LIMIT 3)), []) AS callees FROM {symbol} s WHERE s.name = 'red widget'""")(
    lambda g: J.relation_summary(g.symbol.where("name = 'red widget'"), g.calls))
query("j18_induced_edges", "SELECT src, dst FROM {calls} WHERE src IN (SELECT qualified_name FROM {symbol} WHERE line_start < 15) AND dst IN (SELECT qualified_name FROM {symbol} WHERE line_start < 15)")(
    lambda g: J.induced(g.calls, g.symbol.where("line_start < 15").select(F.col("qualified_name").alias("id"))).select("src", "dst"))
query("j19_release_collection", """SELECT o.id, o.kind, n.content_hash AS collected FROM {resource_old} o LEFT JOIN {resource_new} n ON o.id = n.id AND o.kind = n.kind""")(
    lambda g: g.resource_old.select("id", "kind").join(g.resource_new.select("id", "kind", F.col("content_hash").alias("collected")), ["id", "kind"], "left"))
query("j20_scope_fallback", "SELECT path FROM {file} WHERE repo = 'n/1'")(lambda g: J.scope_or_fallback(g.file.where("repo = 'none'"), g.file.where("repo = 'n/1'")).select("path"))
query("j21_enrich_references", """WITH a AS (SELECT DISTINCT event_id AS id, unnest([user_id, event_id % 50]) AS ref FROM {events} WHERE event_type = 'error'), c AS (SELECT c_custkey AS ref, c_name AS details FROM {customer} WHERE c_custkey % 3 = 0)
    SELECT id, coalesce(list_sort(list(details) FILTER (details IS NOT NULL)), []) AS details, count(*) FILTER (details IS NULL) AS to_fetch FROM a LEFT JOIN c ON a.ref = c.ref GROUP BY id""")(
    lambda g: J.enrich(g.events.where("event_type = 'error'").select(F.col("event_id").alias("id"), F.array("user_id", F.col("event_id") % 50).alias("refs")),
                       g.customer.select(F.col("c_custkey").alias("ref"), F.col("c_name").alias("details"), F.when(F.col("c_custkey") % 3 == 0, F.lit("2024-02-01")).otherwise("2023-01-01").cast("timestamp").alias("expires_at")), "2024-01-01"))
query("j22_accessible_projects", "SELECT DISTINCT c_custkey AS \"user\", s_suppkey AS project_id FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey JOIN {supplier} ON s_nationkey = n_nationkey WHERE n_regionkey = 2")(
    lambda g: J.accessible(g.customer.select(F.col("c_custkey").alias("user"), F.col("c_nationkey").alias("group_id")), g.nation.select(F.col("n_nationkey").alias("group_id"), (F.col("n_regionkey") == 2).cast("int").alias("active")),
                           g.supplier.select(F.col("s_nationkey").alias("group_id"), F.col("s_suppkey").alias("project_id"))))

# --- aggregates ---------------------------------------------------------------

query("a01_stats", "SELECT (SELECT count(*) FROM {symbol}) AS symbols, (SELECT count(*) FROM {file}) AS files, (SELECT count(*) FROM {variable}) AS variables, (SELECT count(*) FROM {calls}) AS calls, (SELECT count(*) FROM {flows_to}) AS flows")(
    lambda g: A.graph_stats(g.node, g.edge))
query("a02_edge_counts", "SELECT kind, count(*) AS n FROM {edge} GROUP BY kind")(lambda g: A.kind_counts(g.edge))
query("a03_live_stats", "SELECT (SELECT count(*) FROM {node}) AS nodes, (SELECT count(*) FROM {edge} WHERE kind <> 'IMPORTS') AS edges")(lambda g: A.live_stats(g.node, g.edge))
_FILES = """SELECT f.path, f.language, coalesce(s.n, 0) AS symbols, coalesce(i.n, 0) AS incoming, coalesce(o.n, 0) AS calling FROM {file} f
    LEFT JOIN (SELECT src, count(*) AS n FROM {defines} GROUP BY 1) s ON s.src = f.path
    LEFT JOIN (SELECT b.src, count(DISTINCT c.src) AS n FROM {calls} c JOIN {defines} a ON c.src = a.dst JOIN {defines} b ON c.dst = b.dst WHERE a.src <> b.src GROUP BY 1) i ON i.src = f.path
    LEFT JOIN (SELECT d.src, count(DISTINCT d.dst) AS n FROM {defines} d JOIN {calls} c ON c.src = d.dst GROUP BY 1) o ON o.src = f.path"""
query("a04_file_stats", _FILES)(lambda g: A.file_stats(g.file, g.defines, g.calls))
query("a05_key_modules", f"SELECT *, symbols * 0.3::DOUBLE + incoming * 0.7::DOUBLE AS score FROM ({_FILES}) ORDER BY score DESC, path LIMIT 10")(lambda g: A.key_modules(g.file, g.defines, g.calls))
query("a06_architecture", f"""SELECT count(*) AS files, sum(symbols)::BIGINT AS symbols, count(DISTINCT language) AS languages, count(*) FILTER (incoming > 0) AS files_called, round(avg(symbols), 2) AS avg_symbols,
    round(avg(incoming), 2) AS avg_callers FROM ({_FILES})""")(lambda g: A.architecture(g.file, g.defines, g.calls))
query("a07_import_surface", """SELECT f.path, coalesce(o.n, 0) AS imports_out, coalesce(i.n, 0) AS imports_in FROM {file} f LEFT JOIN (SELECT src, count(*) AS n FROM {imports} GROUP BY 1) o ON o.src = f.path
    LEFT JOIN (SELECT dst, count(DISTINCT src) AS n FROM {imports} GROUP BY 1) i ON i.dst = f.path ORDER BY 2 DESC, 3 DESC, 1 LIMIT 15""")(lambda g: A.import_surface(g.file, g.imports))
query("a08_fan_in_of", "SELECT DISTINCT src AS neighbour FROM {calls} WHERE dst = 'p.3'")(lambda g: A.neighbours(g.calls, "p.3", True))
_FAN = "SELECT symbol, count(DISTINCT caller) AS fan_in, count(DISTINCT callee) AS fan_out FROM (SELECT dst AS symbol, src AS caller, NULL AS callee FROM {calls} UNION ALL SELECT src, NULL, dst FROM {calls}) GROUP BY symbol"
query("a09_fan", _FAN)(lambda g: A.fan(g.calls))
query("a11_critical", f"""SELECT symbol, fan_in, fan_out, round((fan_in * 0.6::DOUBLE + fan_out / greatest(max(fan_out) OVER (), 1) * 0.4::DOUBLE) * 100)::BIGINT AS score FROM ({_FAN}) ORDER BY score DESC, symbol LIMIT 10""")(lambda g: A.critical(g.calls))
query("a12_critical_normalised", f"""SELECT symbol, floor(round(raw * 100, 9))::BIGINT AS score FROM (SELECT symbol, fan_in / greatest(max(fan_in) OVER (), 1) * 0.6::DOUBLE + fan_out / greatest(max(fan_out) OVER (), 1) * 0.5::DOUBLE * 0.4::DOUBLE AS raw FROM ({_FAN}))
    ORDER BY raw DESC, symbol LIMIT 10""")(lambda g: A.critical_normalised(g.calls))
query("a13_briefing", """SELECT 'event_type' AS facet, event_type AS value, count(*) AS n FROM {activity} GROUP BY 2 UNION ALL SELECT 'status', status, count(*) FROM {activity} WHERE status IS NOT NULL GROUP BY 2
    UNION ALL SELECT 'project', project_id, count(*) FROM {activity} GROUP BY 2""")(lambda g: A.briefing(g.activity))
query("a14_scenarios", """WITH k AS (SELECT event_type, tag, count(*) AS k FROM (SELECT event_type, unnest([props, source_system]) AS tag FROM {activity}) GROUP BY 1, 2),
    t AS (SELECT event_type, list(tag ORDER BY r) AS top_tags FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY k DESC, tag) AS r FROM k) WHERE r <= 5 GROUP BY 1)
    SELECT a.event_type, count(*) AS n, max(occurred_at) AS latest, count(*) FILTER (status = 'open') AS open, count(*) FILTER (status = 'done') AS done, count(*) FILTER (status = 'blocked') AS blocked, any_value(t.top_tags) AS top_tags
    FROM {activity} a JOIN t ON a.event_type = t.event_type GROUP BY 1""")(lambda g: A.scenarios(g.activity, F.array("props", "source_system")))
query("a15_report_counts", """SELECT 'type' AS facet, event_type AS value, count(*) AS n FROM {activity} GROUP BY 2 UNION ALL SELECT 'status', coalesce(status, 'unspecified'), count(*) FROM {activity} GROUP BY 2
    UNION ALL SELECT 'project', project_id, count(*) FROM {activity} GROUP BY 2 UNION ALL SELECT 'day', CAST(CAST(occurred_at AS DATE) AS VARCHAR), count(*) FROM {activity} GROUP BY 2""")(lambda g: A.report_counts(g.activity))
query("a17_weekly", """SELECT time_bucket(INTERVAL 7 DAYS, occurred_at, TIMESTAMP '1970-01-01') AS week, project_id, event_type, coalesce(status, 'unspecified') AS status, count(*) AS n FROM {activity} GROUP BY 1, 2, 3, 4""")(lambda g: A.weekly(g.activity))
query("a18_suspected_duplicates", r"""SELECT project_id, event_type, trim(regexp_replace(lower(title), '\s+', ' ', 'g')) AS title, CAST(occurred_at AS DATE) AS day, count(*) AS n, count(DISTINCT source_item_id) AS sources, count(DISTINCT content_hash) AS hashes
    FROM {activity} GROUP BY 1, 2, 3, 4 HAVING count(*) >= 2 AND NOT (count(DISTINCT source_item_id) < 2 AND count(DISTINCT content_hash) < 2)""")(lambda g: A.suspected_duplicates(g.activity))
query("a19_compliance_totals", "SELECT project_id, count(*) FILTER (status = 'open') AS open, count(*) FILTER (status = 'done') AS done, count(*) FILTER (status = 'blocked') AS blocked, count(*) AS total FROM {activity} GROUP BY 1")(
    lambda g: A.bucket_totals(g.activity, "project_id", "status", ["open", "done", "blocked"]))
query("a20_worst_severity", """SELECT project_id, count(*) AS n, arg_max(CASE WHEN value > 300 THEN 'critical' WHEN value > 100 THEN 'medium' ELSE 'info' END, CASE WHEN value > 300 THEN 4 WHEN value > 100 THEN 2 ELSE 0 END) AS worst FROM {activity} GROUP BY 1""")(
    lambda g: A.worst(g.activity.withColumn("severity", F.when(F.col("value") > 300, "critical").when(F.col("value") > 100, "medium").otherwise("info")), "project_id", "severity"))
query("a21_guid_consistency", "SELECT scope, count(DISTINCT kind) AS n FROM {resource_old} GROUP BY 1 HAVING count(DISTINCT kind) > 1")(lambda g: A.inconsistent(g.resource_old, "scope", "kind"))
query("a22_average_duration", "SELECT floor(coalesce(avg(seconds) FILTER (state = 'done' AND seconds > 0 AND seconds < 7200), 30.0))::BIGINT AS seconds FROM {job}")(lambda g: A.average_duration(g.job))
query("a23_precision_at_5", """WITH h AS (SELECT o_custkey AS case_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rank, o_orderstatus = 'F' AS hit FROM {orders}),
    e AS (SELECT case_id, count(*) FILTER (hit) AS expected FROM h GROUP BY 1) SELECT h.case_id, count(*) FILTER (hit) AS hits, count(*) FILTER (hit)::DOUBLE / least(5, greatest(1, any_value(expected))) AS precision
    FROM h JOIN e ON h.case_id = e.case_id WHERE rank <= 5 GROUP BY 1""")(
    lambda g: (lambda h: A.precision_at(h.join(h.groupBy("case_id").agg(F.count(F.when(F.col("hit"), 1)).alias("expected")), "case_id")))(W.first_seen(g.orders.select(F.col("o_custkey").alias("case_id"), "o_orderkey", (F.col("o_orderstatus") == "F").alias("hit")), ["case_id"], ["o_orderkey"]).withColumn(
        "rank", F.row_number().over(Window.partitionBy("case_id").orderBy("o_orderkey")))))
query("a24_percentiles", """WITH n AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS r, count(*) OVER (PARTITION BY event_type) AS n FROM {events})
    SELECT event_type, max(value) FILTER (r = greatest(1, floor(n * 50 / 100.0))) AS p50, max(value) FILTER (r = greatest(1, floor(n * 95 / 100.0))) AS p95, max(value) FILTER (r = greatest(1, floor(n * 99 / 100.0))) AS p99 FROM n GROUP BY 1""")(
    lambda g: A.odd_percentile(g.events, "event_type", "value"))
query("a26_quality_summary", "SELECT event_type, round(avg(value), 2) AS avg_value, count(*) AS n FROM {events} GROUP BY 1")(lambda g: A.means(g.events, ["event_type"], ["value"]))
query("a27_project_deltas", """SELECT b.project_id, round(s.v - b.v, 2) AS delta, (s.v - b.v) < 0 AS regressed FROM (SELECT project_id, avg(value) AS v FROM {activity} WHERE event_type = 'view' GROUP BY 1) b
    JOIN (SELECT project_id, avg(value) AS v FROM {activity} WHERE event_type = 'click' GROUP BY 1) s ON b.project_id = s.project_id""")(
    lambda g: g.activity.groupBy("project_id").agg(F.avg(F.when(F.col("event_type") == "view", F.col("value"))).alias("b"), F.avg(F.when(F.col("event_type") == "click", F.col("value"))).alias("s")).where(
        "b is not null and s is not null").select("project_id", F.round(F.col("s") - F.col("b"), 2).alias("delta"), ((F.col("s") - F.col("b")) < 0).alias("regressed")))
query("a29_throughput", "SELECT event_type, round(count(*) / sum(value), 4) AS rate, round(avg(value), 3) AS mean FROM {events} GROUP BY 1")(
    lambda g: g.events.groupBy("event_type").agg(F.round(F.count(F.lit(1)) / F.sum("value"), 4).alias("rate"), F.round(F.avg("value"), 3).alias("mean")))
query("a30_run_summary", "SELECT count(*) FILTER (event_type <> 'error') AS ok, count(*) FILTER (event_type = 'error') AS failed, sum(event_id % 3)::BIGINT AS retries, round(count(*) / 60.0::DOUBLE, 3) AS qps FROM {events}")(
    lambda g: A.run_summary(g.events.select((F.col("event_type") != "error").alias("ok"), (F.col("event_id") % 3).alias("retries")), 60))
query("a31_retention_preview", f"""SELECT category, count(*) AS n FROM (SELECT created_at, {_CATEGORY} AS category FROM {{audit}}) WHERE created_at < TIMESTAMP '2024-01-20' - to_days(CASE category WHEN 'protected' THEN 15 WHEN 'polling' THEN 3 ELSE 10 END) GROUP BY 1""")(
    lambda g: A.kind_counts(L.expired(g.audit, "2024-01-20", {"protected": 15, "polling": 3, "request": 10}), "category"))
query("a32_storage_stats", "SELECT count(*) AS n, min(created_at) AS oldest FROM {audit}")(lambda g: g.audit.agg(F.count(F.lit(1)).alias("n"), F.min("created_at").alias("oldest")))
query("a34_degree", """SELECT kind, n.id, coalesce(degree, 0) AS degree, greatest(CASE kind WHEN 'Repository' THEN 4 WHEN 'Symbol' THEN 3 WHEN 'File' THEN 2 ELSE 1 END, CASE WHEN degree >= 24 THEN 4 WHEN degree >= 10 THEN 3 WHEN degree >= 4 THEN 2 ELSE 1 END) AS tier
    FROM {node} n LEFT JOIN (SELECT id, count(*) AS degree FROM (SELECT src AS id FROM {edge} UNION ALL SELECT dst FROM {edge}) GROUP BY 1) d ON n.id = d.id""")(lambda g: A.degree(g.node, g.edge))
_SIGNALS = "SELECT event_type AS dimension, CASE WHEN value > 200 THEN 'fail' WHEN value > 60 THEN 'warn' WHEN value > 1 THEN 'ok' ELSE 'unknown' END AS status, 'fix ' || (user_id % 12) AS recommendation, event_id AS pos FROM {events}"
_signals = lambda g: g.events.select(F.col("event_type").alias("dimension"), F.when(F.col("value") > 200, "fail").when(F.col("value") > 60, "warn").when(F.col("value") > 1, "ok").otherwise("unknown").alias("status"),
                                     F.concat(F.lit("fix "), F.col("user_id") % 12).alias("recommendation"), F.col("event_id").alias("pos"))
query("a35_readiness", f"""SELECT dimension, score, CASE WHEN score IS NULL THEN 'unknown' WHEN score >= 80 THEN 'ok' WHEN score >= 50 THEN 'warn' ELSE 'fail' END AS status FROM (SELECT dimension,
    round_even(avg(CASE status WHEN 'ok' THEN 100.0 WHEN 'warn' THEN 50.0 WHEN 'fail' THEN 0.0 END), 0)::BIGINT AS score FROM ({_SIGNALS}) GROUP BY 1)""")(lambda g: A.readiness(_signals(g)))
query("a36_next_actions", f"SELECT recommendation, min(pos) AS pos FROM ({_SIGNALS}) WHERE status <> 'ok' GROUP BY 1 ORDER BY 2 LIMIT 8")(lambda g: A.next_actions(_signals(g)))
query("a37_gate", f"SELECT dimension, CASE max(CASE status WHEN 'fail' THEN 2 WHEN 'warn' THEN 1 ELSE 0 END) WHEN 2 THEN 'fail' WHEN 1 THEN 'warn' ELSE 'ok' END AS status FROM ({_SIGNALS}) WHERE status <> 'unknown' GROUP BY 1")(
    lambda g: A.gate(_signals(g).where("status <> 'unknown'"), "dimension"))
query("a38_folder_counts", "SELECT split_part(id, '/', 1) AS folder, count(*) AS n FROM {node} WHERE contains(id, '/') GROUP BY 1")(lambda g: A.folder_counts(g.node.where(F.col("id").contains("/")), "id"))

# --- windows, order and pages -------------------------------------------------

query("w01_exact_duplicates", """SELECT id, rn, copies FROM (SELECT id, row_number() OVER (w ORDER BY synced_at DESC, occurred_at DESC, id DESC) AS rn, count(*) OVER w AS copies FROM {activity}
    WINDOW w AS (PARTITION BY plugin_id, project_id, source_type, content_hash)) WHERE rn > 1""")(lambda g: W.exact_duplicates(g.activity).select("id", "rn", "copies"))
query("w01_cleaned", """SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY plugin_id, project_id, source_type, content_hash ORDER BY synced_at DESC, occurred_at DESC, id DESC) AS rn FROM {activity}) WHERE rn = 1""")(
    lambda g: W.cleaned(g.activity).select("id"))
query("w03_budget_prefix", "SELECT conv_id, turn, used FROM (SELECT *, sum(greatest(1, length(text) // 4)) OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT AS used FROM {conversations} WHERE text <> '') WHERE used <= 300")(
    lambda g: W.budget_prefix(g.conversations.where("text <> ''"), "conv_id", ["turn"], X.tokens_simple(F.col("text")), 300).select("conv_id", "turn", "used"))
query("w05_queue_positions", "SELECT job_id, project, row_number() OVER (PARTITION BY project ORDER BY created_at, job_id) - 1 AS position, (row_number() OVER (PARTITION BY project ORDER BY created_at, job_id) - 1) * 30 AS eta FROM {job} WHERE state = 'pending'")(
    lambda g: W.queue_positions(g.job).select("job_id", "project", "position", "eta"))
query("w06_latest_per_key", "SELECT source_item_id, arg_max(id, struct_pack(a := occurred_at, b := id)) AS id FROM {activity} GROUP BY 1")(
    lambda g: W.latest(g.activity, ["source_item_id"], [F.desc("occurred_at"), F.desc("id")]).select("source_item_id", "id"))
query("w07_even_sample", """WITH n AS (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS "at", count(*) OVER (PARTITION BY event_type) AS n FROM {events})
    SELECT event_type, event_id FROM n WHERE n <= 7 OR list_contains(list_transform(range(0, 7), lambda i: CAST(round_even(i * (n - 1) / 6.0::DOUBLE, 0) AS BIGINT)), "at")""")(
    lambda g: W.even_sample(g.events.select("event_type", "event_id"), "event_type", ["event_id"], 7))
query("w08_parameter_positions", """SELECT qualified_name, (k - 1)::BIGINT AS position FROM (SELECT qualified_name, role, sum((name IN ('signup', 'view'))::INT) OVER (PARTITION BY scope_qname ORDER BY line_number, qualified_name) AS k, name FROM {variable}) WHERE name IN ('signup', 'view')""")(
    lambda g: W.parameter_positions(g.variable.withColumn("role", F.when(F.col("name").isin("signup", "view"), "parameter").otherwise("local"))).select("qualified_name", "position"))
query("w09_first_seen", "SELECT doc_id, row_number() OVER (PARTITION BY text ORDER BY doc_id) > 1 AS repeated FROM {documents}")(
    lambda g: W.first_seen(g.documents.select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("h")), ["h"], ["doc_id"]).select("doc_id", "repeated"))
query("l02_recent", "SELECT id, occurred_at FROM {activity} ORDER BY occurred_at DESC, synced_at DESC, source_item_id DESC, id DESC LIMIT 50")(lambda g: W.recent(g.activity, 50).select("id", "occurred_at"))
query("l03_look_ahead", "SELECT qualified_name FROM {symbol} ORDER BY qualified_name LIMIT 26")(lambda g: W.page_after(g.symbol.select("qualified_name"), "qualified_name", "", 25))
query("l04_keyset_page", "SELECT id, path FROM {audit} WHERE id > 100 ORDER BY id LIMIT 31")(lambda g: W.page_after(g.audit.select("id", "path"), "id", 100, 30))
query("l05_offset_page", "SELECT id, actor_name FROM {audit} ORDER BY created_at DESC, id DESC LIMIT 20 OFFSET 40")(lambda g: W.page_at(g.audit, [F.desc("created_at"), F.desc("id")], 40, 20).select("id", "actor_name"))
query("l08_due_tasks", "SELECT o_orderkey AS task_id, TIMESTAMP '1998-01-01' + to_minutes(o_custkey % 60) AS \"then\" FROM {orders} WHERE o_orderstatus = 'O' AND o_orderdate <= TIMESTAMP '1998-01-01' ORDER BY o_orderdate, o_orderkey LIMIT 50")(
    lambda g: W.due(g.orders.select(F.col("o_orderkey").alias("task_id"), (F.col("o_orderstatus") == "O").alias("enabled"), F.col("o_orderdate").alias("next_run"), (F.col("o_custkey") % 60).cast("int").alias("minutes")), "1998-01-01").select("task_id", "then"))
query("l09_key_intermediates", f"SELECT qualified_name, flows_in + flows_out AS score FROM ({_METRICS}) WHERE role = 'local' AND flows_in > 0 AND flows_out > 0 ORDER BY 2 DESC, 1 LIMIT 20")(
    lambda g: W.key_intermediates(J.scope_metrics(g.variable, g.flows_to)).select("qualified_name", "score"))
query("l09_unused_parameters", f"SELECT qualified_name FROM ({_METRICS}) WHERE role = 'parameter' AND flows_out = 0")(lambda g: W.unused_parameters(J.scope_metrics(g.variable, g.flows_to)).select("qualified_name"))
query("l10_top_bars", "SELECT project_id, count(*) AS n FROM {activity} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 12")(lambda g: g.activity.groupBy("project_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "project_id").limit(12))

# --- sets ---------------------------------------------------------------------

query("u01_key_sets", "SELECT coalesce(o.id, n.id) AS id, CASE WHEN o.id IS NULL THEN 'created' WHEN n.id IS NULL THEN 'deleted' ELSE 'common' END AS side FROM {resource_old} o FULL JOIN {resource_new} n ON o.id = n.id")(
    lambda g: U.key_sets(g.resource_old, g.resource_new, "id"))
query("u02_evidence", """SELECT o_custkey AS id, list_sort(list_intersect(f, e)) AS covered, list_sort(list_filter(e, lambda x: NOT list_contains(f, x))) AS missing, list_sort(list_filter(f, lambda x: NOT list_contains(e, x))) AS unsupported FROM
    (SELECT o_custkey, list(DISTINCT o_orderpriority) AS f, ['1-URGENT', '5-LOW', 'none'] AS e FROM {orders} GROUP BY 1)""")(
    lambda g: g.orders.groupBy(F.col("o_custkey").alias("id")).agg(F.collect_set("o_orderpriority").alias("f")).select("id", U.evidence(F.col("f"), F.array(F.lit("1-URGENT"), F.lit("5-LOW"), F.lit("none"))).alias("e")).select("id", "e.*"))
query("u03_tombstones", "SELECT id FROM {resource_old} WHERE id NOT IN (SELECT id FROM {resource_new})")(lambda g: U.tombstones(g.resource_old, g.resource_new, "id").select("id"))
query("u04_new_events", """SELECT id, scope FROM {resource_new} n WHERE coalesce(CASE WHEN length(scope) > 9 THEN id END, kind || '|' || scope) NOT IN (SELECT coalesce(CASE WHEN length(scope) > 9 THEN id END, kind || '|' || scope) FROM {resource_old})""")(
    lambda g: (lambda f: U.new_events(f(g.resource_old), f(g.resource_new), ["kind", "scope"], "key").select("id", "scope"))(lambda t: t.withColumn("key", F.when(F.length("scope") > 9, F.col("id")))))
query("u05_union_dedupe", "SELECT job_id, project FROM {job} WHERE state = 'pending' OR project = 'proj3'")(
    lambda g: g.job.where("state = 'pending'").unionByName(g.job.where("project = 'proj3'")).dropDuplicates(["job_id"]).select("job_id", "project"))
query("u06_first_wins", """WITH e AS (SELECT src AS a, dst AS target, 1 AS depth, 1 AS priority FROM {calls} UNION ALL SELECT dst, src, 1, 2 FROM {calls}), r AS (SELECT *, row_number() OVER (PARTITION BY a, target ORDER BY depth, priority) AS r FROM e)
    SELECT a, target, depth, priority FROM r WHERE r = 1""")(
    lambda g: U.first_wins([g.calls.select(F.col(x).alias("a"), F.col(y).alias("target"), F.lit(1).alias("depth"), F.lit(p).alias("priority")) for p, x, y in ((1, "src", "dst"), (2, "dst", "src"))], ["a", "target"], ["depth", "priority"]))
query("u07_overlay", """WITH c AS (SELECT concat('r/', p_partkey) AS path, CASE WHEN p_partkey % 2 = 0 THEN 'exemption' ELSE 'override' END AS kind, p_name AS content, p_partkey AS seq FROM {part} WHERE p_partkey % 10 < 4 AND p_partkey % 3 <> 0)
    SELECT coalesce(b.id, c.path) AS path, CASE WHEN c.path IS NOT NULL THEN c.content ELSE b.content_hash END AS content FROM {resource_old} b FULL JOIN c ON b.id = c.path WHERE c.kind IS NULL OR c.kind <> 'exemption'""")(
    lambda g: U.overlay(g.resource_old.select(F.col("id").alias("path"), F.col("content_hash").alias("content")), g.part.where("p_partkey % 10 < 4").select(
        F.concat(F.lit("r/"), "p_partkey").alias("path"), F.when(F.col("p_partkey") % 2 == 0, "exemption").otherwise("override").alias("kind"), F.col("p_name").alias("content"), F.col("p_partkey").alias("seq"),
        F.when(F.col("p_partkey") % 3 == 0, F.lit("2020-01-01")).cast("timestamp").alias("expires_at")), "2024-01-01"))
query("u08_layered_settings", """SELECT n_nationkey AS id, k AS key, CASE WHEN k = 'b' AND n_regionkey > 2 THEN n_name ELSE 'g' END AS value, CASE WHEN k = 'b' AND n_regionkey > 2 THEN 'project' ELSE 'global' END AS layer FROM {nation}, (VALUES ('a'), ('b')) t(k)""")(
    lambda g: g.nation.select(F.col("n_nationkey").alias("id"), F.explode(U.layered(F.create_map(F.lit("a"), F.lit("g"), F.lit("b"), F.lit("g")), F.when(F.col("n_regionkey") > 2, F.create_map(F.lit("b"), F.col("n_name"))).otherwise(
        F.create_map().cast("map<string,string>")))).alias("key", "v")).select("id", "key", "v.value", "v.layer"))

# --- paths and reach ----------------------------------------------------------

query("g01_call_graph", """SELECT s.qualified_name, s.name, s.file_path, 'caller' AS way FROM {calls} c JOIN {symbol} s ON c.src = s.qualified_name WHERE c.dst = 'p.3'
    UNION ALL SELECT s.qualified_name, s.name, s.file_path, 'callee' FROM {calls} c JOIN {symbol} s ON c.dst = s.qualified_name WHERE c.src = 'p.3'""")(lambda g: B.call_graph(B.of(g), "p.3"))
query("g02_dependency_chain", """WITH a AS (SELECT dst AS x FROM {defines} WHERE src = 's/1'), b AS (SELECT dst AS y FROM {defines} WHERE src = 's/2')
    SELECT hops, count(*) AS paths FROM (SELECT 1 AS hops FROM {calls} c WHERE c.src IN (SELECT x FROM a) AND c.dst IN (SELECT y FROM b)
    UNION ALL SELECT 2 FROM {calls} c JOIN {calls} d ON c.dst = d.src WHERE c.src IN (SELECT x FROM a) AND d.dst IN (SELECT y FROM b)
    UNION ALL SELECT 3 FROM {calls} c JOIN {calls} d ON c.dst = d.src JOIN {calls} e ON d.dst = e.src WHERE c.src IN (SELECT x FROM a) AND e.dst IN (SELECT y FROM b) AND NOT (c.src = e.src AND c.dst = e.dst)) GROUP BY hops""")(
    lambda g: G.dependency_chain(g.defines, g.calls, "s/1", "s/2"))
query("g03_return_influence", """WITH RECURSIVE e AS (SELECT DISTINCT src, dst FROM {flows_to}), p AS (SELECT scope_qname, qualified_name AS parameter, qualified_name AS at, [qualified_name] AS path FROM {variable} WHERE role = 'parameter'
    UNION ALL SELECT p.scope_qname, p.parameter, e.dst, list_append(p.path, e.dst) FROM p JOIN e ON p.at = e.src WHERE NOT list_contains(p.path, e.dst))
    SELECT p.scope_qname, p.parameter, p.path, (len(p.path) - 1)::INT AS hops FROM p JOIN {variable} v ON p.at = v.qualified_name AND v.role = 'return' AND v.scope_qname = p.scope_qname""")(lambda g: G.return_influence(g.variable, g.flows_to))
query("g04_flow_narrative", f"""WITH m AS ({_METRICS}) SELECT v.scope_qname, concat(v.scope_qname, ' has ', v.n, ' variables (', v.p, ' parameters) and ', coalesce(f.f, 0), ' flows; ', coalesce(u.u, 0), ' parameters are unused.') AS narrative
    FROM (SELECT scope_qname, count(*) AS n, count(*) FILTER (role = 'parameter') AS p FROM {{variable}} GROUP BY 1) v LEFT JOIN (SELECT scope_qname, count(*) AS f FROM {{flows_to}} GROUP BY 1) f ON v.scope_qname = f.scope_qname
    LEFT JOIN (SELECT scope_qname, count(*) AS u FROM m WHERE role = 'parameter' AND flows_out = 0 GROUP BY 1) u ON v.scope_qname = u.scope_qname""")(lambda g: G.flow_narrative(g.variable, g.flows_to, J.scope_metrics(g.variable, g.flows_to)))
query("g08_focus_scope", """WITH RECURSIVE r AS (SELECT 'p.3' AS n, 0 AS d UNION SELECT c.dst, r.d + 1 FROM r JOIN {calls} c ON r.n = c.src WHERE r.d < 2) SELECT src, dst FROM {calls} WHERE src IN (SELECT n FROM r) AND dst IN (SELECT n FROM r)""")(lambda g: G.focus(g.calls, "p.3", 2))
query("g09_neighbourhood", """WITH RECURSIVE cu AS (SELECT src AS a, dst AS b FROM {calls} UNION SELECT dst, src FROM {calls}), iu AS (SELECT src AS a, dst AS b FROM {imports} UNION SELECT dst, src FROM {imports}),
    r AS (SELECT 'CALLS' AS relation, 'p.3' AS n, 0 AS d UNION SELECT 'CALLS', b, d + 1 FROM r JOIN cu ON n = a WHERE d < 2), q AS (SELECT 'IMPORTS' AS relation, file_path AS n, 0 AS d FROM {symbol} WHERE qualified_name = 'p.3' UNION SELECT 'IMPORTS', b, d + 1 FROM q JOIN iu ON n = a WHERE d < 2)
    SELECT relation, n AS node, min(d) AS depth FROM (SELECT * FROM r UNION ALL SELECT * FROM q) GROUP BY 1, 2 HAVING min(d) > 0""")(lambda g: B.neighbourhood(B.of(g), "p.3"))
query("g09_flow_leg", """SELECT DISTINCT 'FLOWS_TO' AS relation, dst AS node, 1 AS depth FROM {flows_to} WHERE scope_qname = 'u.8' AND src IN (SELECT dst FROM {uses_variable} WHERE src = 'u.8')""")(
    lambda g: B.neighbourhood(B.of(g), "u.8", flows=True))
query("g10_scope_flows", "SELECT src, dst, line_number, flow_type FROM {flows_to} WHERE scope_qname = 'u.8' ORDER BY line_number, src, dst LIMIT 50")(lambda g: G.scope_flows(g.flows_to, "u.8").select("src", "dst", "line_number", "flow_type"))

# --- scores -------------------------------------------------------------------

_chunks = lambda g: g.chunk.select("case_id", "mode", "pos", "text", "useful", F.array(F.concat(F.lit("e"), "evidence")).alias("evidence"), F.array("sym", F.concat(F.lit("pkg:"), "sym")).alias("syms"))
_gold = lambda g: g.chunk.select("case_id").distinct().select("case_id", F.array(F.concat(F.lit("e"), "case_id"), F.concat(F.lit("e"), F.col("case_id") + 100)).alias("gold"))
_targets = lambda g: g.chunk.select("case_id").distinct().select("case_id", F.array(F.concat(F.lit("src"), "case_id")).alias("targets"))
_PRESSURE = r"""SELECT case_id, mode, tokens, useful_tokens, duplicate_tokens, symbol_hits, ambiguous_hits, round(100 * (0.45 * (1 - coverage) + 0.35 * noise + 0.1 * redundancy + 0.1 * ambiguity), 2) AS score, round(coverage, 4) AS coverage,
    round(precision, 4) AS precision, round(noise, 4) AS noise, round(redundancy, 4) AS redundancy, round(ambiguity, 4) AS ambiguity FROM (SELECT *, covered / 2.0::DOUBLE AS coverage, useful_tokens / tokens AS precision, (tokens - useful_tokens) / tokens AS noise,
    duplicate_tokens / tokens AS redundancy, CASE WHEN symbol_hits > 0 THEN ambiguous_hits / symbol_hits ELSE 0 END AS ambiguity FROM (SELECT case_id, mode, sum(t)::BIGINT AS tokens, coalesce(sum(t) FILTER (useful OR evidence = case_id), 0)::BIGINT AS useful_tokens,
    coalesce(sum(t) FILTER (r > 1 AND x <> ''), 0)::BIGINT AS duplicate_tokens, count(DISTINCT evidence) FILTER (evidence = case_id) AS covered, (2 * count(*) FILTER (sym = concat('src', case_id)))::BIGINT AS symbol_hits, count(*) FILTER (sym = concat('src', case_id)) AS ambiguous_hits
    FROM (SELECT *, CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, length(text) // 4) END AS t, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS x, row_number() OVER (PARTITION BY case_id, mode, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) ORDER BY pos) AS r FROM {chunk}) GROUP BY 1, 2))"""
query("e01_pressure", _PRESSURE)(lambda g: E.pressure(_chunks(g), _gold(g), _targets(g)))
query("e02_ambiguity", "SELECT doc_id, split_part(replace(concat('a.b::', source), '::', '.'), '.', 3) AS simple FROM {documents}")(lambda g: g.documents.select("doc_id", E.simple_name(F.concat(F.lit("a.b::"), "source")).alias("simple")))
query("e03_comparison", f"""WITH s AS ({_PRESSURE}) SELECT a.case_id, CASE WHEN a.tokens > 0 THEN round((a.tokens - b.tokens) / a.tokens * 100, 2) ELSE 0.0 END AS token_reduction, CASE WHEN a.score > 0 THEN round((a.score - b.score) / a.score * 100, 2) ELSE 0.0 END AS score_reduction,
    round(b.coverage - a.coverage, 4) AS coverage_delta, round(b.precision - a.precision, 4) AS precision_delta FROM s a JOIN s b ON a.case_id = b.case_id AND a.mode = 'baseline' AND b.mode = 'scoped'""")(lambda g: E.compared(E.pressure(_chunks(g), _gold(g), _targets(g))))
query("e04_answers", """WITH a AS (SELECT o_custkey AS id, list(DISTINCT o_orderpriority) AS cited, list(DISTINCT o_orderstatus) AS s, ['1-URGENT', '2-HIGH'] AS gold, ['1-URGENT', '2-HIGH', '3-MEDIUM'] AS ev FROM {orders} GROUP BY 1),
    b AS (SELECT *, list_intersect(cited, ev) AS grounded, list_intersect(list_intersect(gold, cited), ev) AS covered, CASE WHEN list_contains(s, 'F') THEN 'it calls the parser' ELSE 'recalls nothing' END AS answer FROM a)
    SELECT id, (answer LIKE 'it%' AND len(covered) = 2 AND len(grounded) = len(cited)) AS passed, CASE WHEN answer LIKE 'it%' THEN 1.0 ELSE 0.0 END::DOUBLE AS fact_coverage, round(len(covered) / 2.0::DOUBLE, 4) AS citation_coverage, round(len(covered) / len(cited), 4) AS citation_precision,
    round(len(grounded) / len(cited), 4) AS citation_grounding, 1.0::DOUBLE AS evidence_coverage FROM b""")(
    lambda g: E.answers(g.orders.groupBy(F.col("o_custkey").alias("id")).agg(F.collect_set("o_orderpriority").alias("citations"), F.collect_set("o_orderstatus").alias("s")).select(
        "id", "citations", F.when(F.array_contains("s", "F"), "it calls the parser").otherwise("recalls nothing").alias("answer"), F.array(F.lit("call")).alias("facts"),
        F.array(F.lit("1-URGENT"), F.lit("2-HIGH")).alias("gold"), F.array(F.lit("1-URGENT"), F.lit("2-HIGH"), F.lit("3-MEDIUM")).alias("evidence"))))
query("e05_calibration", """WITH s AS (SELECT value AS score, value < 30 OR event_type = 'view' AS passed FROM {events} WHERE value IS NOT NULL), g AS (SELECT score, count(*) FILTER (passed) AS p, count(*) FILTER (NOT passed) AS f FROM s GROUP BY 1),
    k AS (SELECT score, sum(p) OVER w AS kept, sum(f) OVER w AS lost, sum(p) OVER () AS p, sum(f) OVER () AS f FROM g WINDOW w AS (ORDER BY score) UNION ALL SELECT min(score) - 0.01, 0, 0, sum(p), sum(f) FROM g)
    SELECT round(score, 2) AS threshold, round(accuracy, 4) AS accuracy, (f - lost)::BIGINT AS caught, kept::BIGINT AS kept FROM (SELECT *, ((f - lost) / f + kept / p) / 2 AS accuracy FROM k) ORDER BY accuracy DESC, score LIMIT 1""")(
    lambda g: E.calibrate(g.events.select(F.col("value").alias("score"), ((F.col("value") < 30) | (F.col("event_type") == "view")).alias("passed"))))
_ITEMS = """SELECT symbol_type AS bundle, qualified_name, least(1.0, CASE WHEN contains(name, 'red') THEN 1 ELSE 0 END / 2.0::DOUBLE * 0.5::DOUBLE + CASE WHEN line_start > 20 THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END + least(0.2::DOUBLE, (line_start % 7) * 0.05::DOUBLE) + 0.1::DOUBLE) AS score, line_start > 20 AS has_snippet FROM {symbol}"""
_items = lambda g: g.symbol.select(F.col("symbol_type").alias("bundle"), "qualified_name", E.item_score(F.col("name").contains("red").cast("int"), F.lit(2), F.col("line_start") > 20, F.col("line_start") % 7, F.lit(True)).alias("score"),
                                   (F.col("line_start") > 20).alias("has_snippet"))
query("e06_item_scores", f"SELECT qualified_name, round(score, 6) AS score FROM ({_ITEMS})")(lambda g: _items(g).select("qualified_name", F.round("score", 6).alias("score")))
query("e07_bundles", f"""SELECT bundle, items, matched, snippets, round(mean, 3) AS mean, quality, CASE WHEN items < 3 THEN 'insufficient_graph_hits' WHEN quality < 0.55 THEN 'low_graph_quality' ELSE 'graph_context_sufficient' END AS decision FROM (SELECT *, round(least(1.0::DOUBLE, mean + least(0.15::DOUBLE, items * 0.03::DOUBLE) + CASE WHEN snippets THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END), 3) AS quality
    FROM (SELECT bundle, avg(score) AS mean, count(*) AS items, count(*) FILTER (score >= 0.45) AS matched, bool_or(has_snippet) AS snippets FROM ({_ITEMS}) GROUP BY 1))""")(lambda g: E.bundle_score(_items(g), "bundle"))
query("e08_expansion", """SELECT event_id, (len(reasons) > 0 AND event_id % 3 < 2) AS expand, reasons, CASE WHEN event_type <> 'error' THEN NULL WHEN value < 50 THEN 'missing_retrieval_evidence' WHEN user_id % 2 = 0 THEN 'model_variance_or_reasoning' ELSE 'task_or_model_failure' END AS failure FROM
    (SELECT *, list_filter([CASE WHEN value < 50 THEN 'missing_evidence' END, CASE WHEN value > 60 THEN 'hps_above_calibrated_threshold' END, CASE WHEN event_type = 'error' THEN 'answer_failed' END, CASE WHEN event_type = 'error' AND value <= 60 THEN 'hps_outcome_gap' END], lambda x: x IS NOT NULL) AS reasons FROM {events})""")(
    lambda g: (lambda p, c: g.events.select("event_id", E.expansion(F.col("value"), c, F.lit(60.0), p, F.col("event_id") % 3).alias("x"), E.failure_class(p, c, F.col("user_id") % 2 == 0).alias("failure")).select("event_id", "x.expand", "x.reasons", "failure"))(
        F.col("event_type") != "error", F.when(F.col("value") < 50, 0.5).otherwise(1.0)))
query("e10_savings", "SELECT doc_id, (n_chars - length(source)) AS saved, CASE WHEN n_chars > 0 THEN round((n_chars - length(source)) / n_chars * 100, 2) ELSE 0.0 END AS percent, CASE WHEN length(source) > 0 THEN round(n_chars / length(source), 3) END AS ratio FROM {documents}")(
    lambda g: g.documents.select("doc_id", E.savings(F.col("n_chars"), F.length("source").cast("long")).alias("s")).select("doc_id", "s.*"))
_SIGNAL_NOW = """sig AS (SELECT project_id, kind, CASE WHEN trim(lower(status)) = 'passed' THEN 'ok' WHEN trim(lower(status)) = 'failed' THEN 'fail' ELSE 'warn' END AS s FROM {project_signal}
    QUALIFY row_number() OVER (PARTITION BY project_id, kind ORDER BY created_at DESC, id DESC) = 1),
    f AS (SELECT p.*, (SELECT s FROM sig WHERE sig.project_id = p.project_id AND kind = 'ci') AS ci, (SELECT s FROM sig WHERE sig.project_id = p.project_id AND kind = 'pr') AS pr,
    (SELECT s FROM sig WHERE sig.project_id = p.project_id AND kind = 'benchmark') AS bench FROM {project_facts} p)"""
_CHECKS = f"""WITH {_SIGNAL_NOW}, g AS (SELECT *, CASE WHEN NOT graph_available THEN 'unknown' WHEN files > 0 AND symbols > 0 THEN 'ok' WHEN files > 0 THEN 'warn' ELSE 'fail' END AS graph FROM f)
    SELECT project_id, 'context' AS dimension, 'repo_path' AS key, CASE WHEN repo_exists THEN 'ok' WHEN repo_path IS NOT NULL THEN 'fail' ELSE 'unknown' END AS status FROM g
    UNION ALL SELECT project_id, 'context', 'adc_core_files', CASE WHEN adc_required = 0 THEN 'unknown' WHEN adc_present = 4 THEN 'ok' WHEN adc_present > 0 THEN 'warn' ELSE 'fail' END FROM g
    UNION ALL SELECT project_id, 'context', 'graph_index', graph FROM g
    UNION ALL SELECT project_id, 'context', 'index_job', CASE index_status WHEN 'done' THEN 'ok' WHEN 'processing' THEN 'warn' WHEN 'stale' THEN 'fail' ELSE 'unknown' END FROM g
    UNION ALL SELECT project_id, 'verification', 'test_surface', CASE WHEN has_tests THEN 'ok' WHEN repo_exists THEN 'warn' ELSE 'unknown' END FROM g
    UNION ALL SELECT project_id, 'verification', 'ci_workflows', CASE WHEN ci_workflows > 0 THEN 'ok' WHEN repo_exists THEN 'warn' ELSE 'unknown' END FROM g
    UNION ALL SELECT project_id, 'verification', 'ci_signal', coalesce(ci, 'unknown') FROM g
    UNION ALL SELECT project_id, 'workflow', 'work_briefing', CASE WHEN activity_count > 0 THEN 'ok' ELSE 'warn' END FROM g
    UNION ALL SELECT project_id, 'workflow', 'learn_prepare_execute', 'unknown' FROM g
    UNION ALL SELECT project_id, 'workflow', 'pr_signal', coalesce(pr, 'unknown') FROM g
    UNION ALL SELECT project_id, 'governance', 'mcp_token', CASE WHEN active_tokens > 0 THEN 'ok' ELSE 'warn' END FROM g
    UNION ALL SELECT project_id, 'governance', 'policy_profile', CASE profile WHEN 'observe-only' THEN 'warn' ELSE 'ok' END FROM g
    UNION ALL SELECT project_id, 'roi', 'context_efficiency', CASE WHEN bench IS NOT NULL THEN bench WHEN graph = 'ok' THEN 'warn' ELSE 'unknown' END FROM g
    UNION ALL SELECT project_id, 'roi', 'outcome_metrics', CASE WHEN coalesce(ci, pr) IS NOT NULL THEN 'warn' ELSE 'unknown' END FROM g"""
query("e12_readiness_checks", _CHECKS)(lambda g: D.checks(g.project_facts, g.project_signal))
query("e12_readiness_dimensions", _CHECKS.replace("SELECT project_id, 'context' AS dimension", "c AS (SELECT project_id, 'context' AS dimension", 1).replace("AS graph FROM f)", "AS graph FROM f),", 1) + """),
    d AS (SELECT project_id, dimension, round_even(avg(CASE status WHEN 'ok' THEN 100.0 WHEN 'warn' THEN 50.0 WHEN 'fail' THEN 0.0 END), 0)::BIGINT AS score FROM c GROUP BY 1, 2)
    SELECT project_id, dimension, score, CASE WHEN score IS NULL THEN 'unknown' WHEN score >= 80 THEN 'ok' WHEN score >= 50 THEN 'warn' ELSE 'fail' END AS status,
    round_even(avg(score) OVER (PARTITION BY project_id), 0)::BIGINT AS overall FROM d""")(lambda g: D.dimensions(D.checks(g.project_facts, g.project_signal)))
_GATES = f"""WITH {_SIGNAL_NOW}, gate AS (SELECT project_id, 'saved_evidence_pack' AS key, CASE WHEN evidence_pack IS NULL THEN 'warn' ELSE 'ok' END AS status, level IN ('L3', 'L4') AS strict FROM f WHERE level <> 'L0'
    UNION ALL SELECT project_id, 'ci_signal', coalesce(ci, 'warn'), level IN ('L3', 'L4') FROM f WHERE level <> 'L0' UNION ALL SELECT project_id, 'pr_signal', coalesce(pr, 'warn'), level IN ('L3', 'L4') FROM f WHERE level <> 'L0'
    UNION ALL SELECT project_id, 'benchmark_signal', coalesce(bench, 'warn'), false FROM f WHERE level <> 'L0' UNION ALL SELECT project_id, 'work_briefing_activity', CASE WHEN activity_count > 0 THEN 'ok' ELSE 'warn' END, false FROM f WHERE level <> 'L0')"""
query("e12_readiness_gates", _GATES + " SELECT project_id, key, status, CASE WHEN strict THEN 'required' ELSE 'warning' END AS severity FROM gate")(lambda g: D.gates(g.project_facts, g.project_signal))
query("e12_gate_summary", _GATES + """ SELECT f.project_id, CASE WHEN f.level = 'L0' THEN 'observe' ELSE 'warning_gates' END AS mode,
    CASE WHEN EXISTS (SELECT 1 FROM gate WHERE gate.project_id = f.project_id AND status = 'fail') THEN 'fail' WHEN EXISTS (SELECT 1 FROM gate WHERE gate.project_id = f.project_id AND status = 'warn') THEN 'warn' ELSE 'ok' END AS overall_status FROM f""")(
    lambda g: D.gate_summary(g.project_facts, D.gates(g.project_facts, g.project_signal)))

# --- scalar functions ---------------------------------------------------------

query("x01_tokens_simple", "SELECT doc_id, CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, length(text) // 4) END AS tokens FROM {documents}")(lambda g: g.documents.select("doc_id", X.tokens_simple(F.col("text")).alias("tokens")))
query("x02_tokens_mixed", "SELECT doc_id, CASE WHEN n = 0 THEN 0 ELSE floor((n - c) / 4.0::DOUBLE + c / 1.6::DOUBLE + 0.999999::DOUBLE)::BIGINT END AS tokens FROM (SELECT doc_id, length(text) AS n, len(regexp_extract_all(text, '[㐀-䶿一-鿿぀-ヿ가-힯]')) AS c FROM {documents})")(
    lambda g: g.documents.select("doc_id", X.tokens_mixed(F.col("text")).alias("tokens")))
query("x03_hashes", "SELECT doc_id, sha256(text) AS full_hash, substr(sha256(source), 1, 16) AS short_hash FROM {documents}")(lambda g: g.documents.select("doc_id", X.file_hash(F.col("text")).alias("full_hash"), X.short_hash(F.col("source")).alias("short_hash")))
query("x04_set_hash", "SELECT src AS symbol, sha256(string_agg(dst, chr(10) ORDER BY dst) || chr(10)) AS calls_hash FROM {calls} GROUP BY 1")(lambda g: g.calls.groupBy(F.col("src").alias("symbol")).agg(X.set_hash(F.collect_list("dst")).alias("calls_hash")))
query("x05_module_of", r"SELECT page_id, array_to_string(list_filter(string_split(regexp_replace(p, '\.(py|pyi|ts|tsx|js|jsx|go|rs|java|ps1)$', ''), '/'), lambda x: x <> 'src' AND x <> ''), '.') AS module FROM (SELECT page_id, concat('src/a', page_id % 7, '/src/b', page_id, '.py') AS p FROM {pages})")(
    lambda g: g.pages.select("page_id", X.module_of(F.concat(F.lit("src/a"), F.col("page_id") % 7, F.lit("/src/b"), "page_id", F.lit(".py"))).alias("module")))
query("x06_name_parts", "SELECT qualified_name, split_part(qualified_name, ':', -1) AS last_colon, split_part(qualified_name, '.', -1) AS last_dot FROM {variable}")(
    lambda g: g.variable.select("qualified_name", X.last_part(F.col("qualified_name"), ":").alias("last_colon"), X.last_part(F.col("qualified_name"), ".").alias("last_dot")))
query("x07_plain_text", r"SELECT id, trim(regexp_replace(lower(title), '\s+', ' ', 'g')) AS plain FROM {activity}")(lambda g: g.activity.select("id", X.plain(F.col("title")).alias("plain")))
query("x08_snippet", r"SELECT doc_id, CASE WHEN length(s) > 120 THEN substr(s, 1, 117) || '...' ELSE s END AS snippet FROM (SELECT doc_id, trim(array_to_string(string_split(text, chr(10))[1:5], chr(10)), chr(32) || chr(9) || chr(10) || chr(13)) AS s FROM {documents})")(
    lambda g: g.documents.select("doc_id", X.snippet(F.col("text"), F.lit(2), F.lit(2), 3, 120).alias("snippet")))
query("x09_tags", "SELECT p_partkey, list_sort(list_distinct([p_name, p_type, 'x'])) AS tags FROM {part}")(
    lambda g: g.part.select("p_partkey", F.array_sort(X.tags(F.array(F.concat(F.lit(" "), "p_name"), "p_type", F.lit("x "), F.lit("x"), F.lit(" ")))).alias("tags")))
query("x10_safe_url", r"SELECT page_id, CASE WHEN regexp_matches(url, '^https?://') THEN regexp_replace(regexp_replace(url, '[?#].*$', ''), '^(https?://)[^/@]*@', '\1') END AS url FROM {pages}")(lambda g: g.pages.select("page_id", X.safe_url(F.col("url")).alias("url")))
query("x11_utc_times", "SELECT event_id, CAST(strftime(ts, '%Y-%m-%d %H:%M:%S') AS TIMESTAMP) AS at FROM {events}")(lambda g: g.events.select("event_id", F.to_timestamp(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("at")))
query("x13_identifiers", "SELECT event_id, list_sort(list_filter(list_distinct(regexp_extract_all(concat(event_type, ' + f(x, ', event_type, ') if y else None'), '[A-Za-z_][A-Za-z0-9_]*')), lambda w: w NOT IN ('if', 'else', 'None'))) AS names FROM {events}")(
    lambda g: g.events.select("event_id", X.identifiers(F.concat("event_type", F.lit(" + f(x, "), "event_type", F.lit(") if y else None")), ("if", "else", "None")).alias("names")))
query("x14_slug", "SELECT id, trim(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM {activity}")(lambda g: g.activity.select("id", X.slug(F.col("title")).alias("slug")))
query("x14_fnv1a", "SELECT n_nationkey, list_reduce(list_prepend(2166136261::UBIGINT, list_transform(range(0, length(n_name)), lambda i: ascii(substr(n_name, i + 1, 1))::UBIGINT)), lambda h, b: (xor(h, b) * 16777619) & 4294967295)::BIGINT AS hash FROM {nation}")(
    lambda g: g.nation.select("n_nationkey", X.fnv1a(F.col("n_name")).alias("hash")))
query("x16_widened", "SELECT a.path AS old, b.path AS new FROM (SELECT concat('s/', s_suppkey, '/x') AS path FROM {supplier}) a JOIN {file} b ON starts_with(a.path, b.path || '/')")(
    lambda g: g.supplier.select(F.concat(F.lit("s/"), "s_suppkey", F.lit("/x")).alias("old")).withColumn("k", F.substring_index("old", "/", 2)).join(g.file.select(F.col("path").alias("new")), F.col("k") == F.col("new")).where(
        X.widened(F.col("old"), F.col("new"))).select("old", "new"))
query("x17_text_match", r"""SELECT doc_id FROM (SELECT doc_id, string_split_regex(lower(text), '[^\p{L}\p{N}]+') AS w FROM {documents}) WHERE list_contains(w, 'the') AND list_contains(w, 'and') AND NOT list_contains(w, 'stupid')""".replace("{L}", "{{L}}").replace("{N}", "{{N}}").replace("{{", "{").replace("}}", "}"))(
    lambda g: g.documents.where(X.matches(F.col("text"), "the and -stupid")).select("doc_id"))
query("x18_embedding_text", "SELECT id, 'Project: ' || project_id || chr(10) || 'Event: ' || event_type || chr(10) || 'Title: ' || title || CASE WHEN status IS NOT NULL THEN chr(10) || 'Status: ' || status ELSE '' END || chr(10) || 'Summary: ' || summary || chr(10) || 'Tags: ' || props || ', ' || owner AS text FROM {activity}")(
    lambda g: g.activity.select("id", X.embedding_text(F.col("project_id"), F.col("event_type"), F.col("title"), F.col("status"), F.col("summary"), F.lit(""), F.array("props", "owner")).alias("text")))
query("x19_guid", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN lower(concat(substr(md5(p_name), 1, 8), '-', substr(md5(p_name), 9, 4), '-', substr(md5(p_name), 13, 4), '-', substr(md5(p_name), 17, 4), '-', substr(md5(p_name), 21, 12))) END AS guid FROM {part}")(
    lambda g: (lambda m: g.part.select("p_partkey", X.guid(F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("/a/"), F.upper(F.concat_ws("-", *[F.substring(m, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])), F.lit("/v1.json"))).otherwise("/none")).alias("guid")))(F.md5(F.col("p_name").cast("binary"))))
_HEADERS = ("int x; // class A", "std::string s;", "struct A {\n public:\n};", "constexpr int x = 1;", "/* namespace a */ int f();", "template <int N> struct B;", "#define PUBLIC 1")
query("s03_dialect", """SELECT page_id, CASE WHEN page_id % 7 IN (1, 2, 3, 5) THEN 'cpp' ELSE 'c' END AS language FROM {pages}""")(
    lambda g: g.pages.select("page_id", X.dialect(F.lit(".h"), F.element_at(F.array(*map(F.lit, _HEADERS)), (F.col("page_id") % 7 + 1).cast("int"))).alias("language")))

# --- planning -----------------------------------------------------------------

query("p12_incremental_plan", """SELECT coalesce(o.id, n.id) AS path, CASE WHEN n.id IS NULL THEN 'delete' WHEN n.scope LIKE 'red%' THEN 'drop' WHEN o.id IS NULL OR o.content_hash <> n.content_hash THEN 'parse' ELSE 'skip' END AS action FROM {resource_old} o FULL JOIN {resource_new} n ON o.id = n.id""")(
    lambda g: incremental_plan(g.resource_old, g.resource_new, F.col("scope").startswith("red")))
query("p11_positional_arguments", """SELECT call_id, pos, concat(dst, ':a', pos) AS parameter FROM {raw_call} c, (VALUES (0), (1), (2)) t(pos) WHERE pos < callee % 4""")(
    lambda g: g.raw_call.select("call_id", "dst", F.posexplode(F.slice(F.array(F.lit("a"), F.lit("b"), F.lit("c")), 1, (F.col("callee") % 4).cast("int"))).alias("pos", "argument")).select("call_id", "pos", F.concat("dst", F.lit(":a"), "pos").alias("parameter")))
query("t10_stale_jobs", "SELECT job_id FROM {job} WHERE state = 'processing' AND created_at <= TIMESTAMP '1998-06-01' - INTERVAL 30 DAY")(
    lambda g: g.job.where((F.col("state") == "processing") & (F.col("created_at") <= F.lit("1998-06-01").cast("timestamp") - F.expr("INTERVAL 30 DAYS"))).select("job_id"))


def incremental_plan(old: DataFrame, new: DataFrame, disabled) -> DataFrame:
    """What to do with each path: delete what is gone, drop what is disabled, parse what is new or changed, skip the rest."""
    a, b = old.select(F.col("id").alias("a"), F.col("content_hash").alias("ah")), new.select(F.col("id").alias("b"), F.col("content_hash").alias("bh"), disabled.alias("off"))
    return a.join(b, F.col("a") == F.col("b"), "full_outer").select(F.coalesce("a", "b").alias("path"), F.when(F.col("b").isNull(), "delete").when(F.col("off"), "drop").when(
        F.col("a").isNull() | (F.col("ah") != F.col("bh")), "parse").otherwise("skip").alias("action"))


# --- streams, over whole tables -----------------------------------------------

from ..streaming import jobs as S  # noqa: E402
from .router import ontology  # noqa: E402

_outcomes = lambda g: g.events.select(F.concat(F.lit("j"), F.col("user_id")).alias("job_id"), (F.col("event_id") % 3 == 0).alias("ok"), F.col("ts").alias("at"))
query("t04_retry_states", """WITH e AS (SELECT concat('j', user_id) AS job_id, event_id % 3 = 0 AS ok, ts AS at_ FROM {events}), w AS (SELECT *, sum((NOT ok)::INT) OVER (PARTITION BY job_id ORDER BY at_) AS f, coalesce(sum((NOT ok)::INT) OVER (PARTITION BY job_id ORDER BY at_ ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS fb,
    coalesce(max(ok::INT) OVER (PARTITION BY job_id ORDER BY at_ ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS won FROM e)
    SELECT job_id, (f + ok::INT)::INT AS attempt, CASE WHEN ok THEN 'done' WHEN f >= 3 THEN 'failed' ELSE 'retrying' END AS state, CASE WHEN ok OR f >= 3 THEN 0.0 ELSE least(30.0, pow(2, f - 1)) END::DOUBLE AS pause_s FROM w WHERE won = 0 AND fb < 3""")(
    lambda g: S.states(_outcomes(g)))
query("t01_conflicts", "SELECT concat('j', o_custkey) AS job_id, count(DISTINCT o_orderpriority) AS payloads FROM {orders} GROUP BY 1 HAVING count(DISTINCT o_orderpriority) > 1")(
    lambda g: S.conflicts(g.orders.select(F.concat(F.lit("j"), "o_custkey").alias("job_id"), F.col("o_orderpriority").alias("digest"))))
query("t07_trace_evaluation", """SELECT concat('t', user_id) AS key, count(*) AS total, count(*) FILTER (event_id % 3000 >= (SELECT count(*) FROM {part})) AS missing,
    round(count(*) FILTER (event_id % 3000 >= (SELECT count(*) FROM {part}))::DOUBLE / count(*), 4) AS share FROM {events} GROUP BY 1""")(
    lambda g: S.evaluate_traces(g.events.select(F.concat(F.lit("t"), "user_id").alias("trace_id"), F.array(F.concat(F.lit("p."), F.col("event_id") % 3000)).alias("results")), g.symbol))
query("t11_event_windows", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM {events} GROUP BY 1, 2")(lambda g: S.event_windows(g.events))
query("g11_ontology", """SELECT '1.0.0' AS version, * FROM (VALUES ('CONTAINS', 'repository', 'path', 'file', 'path', []), ('DEFINES', 'file', 'path', 'symbol', 'qualified_name', []), ('IMPORTS', 'file', 'path', 'file', 'path', []), ('CALLS', 'symbol', 'qualified_name', 'symbol', 'qualified_name', []),
    ('USES_VARIABLE', 'symbol', 'qualified_name', 'variable', 'qualified_name', []), ('FLOWS_TO', 'variable', 'qualified_name', 'variable', 'qualified_name', ['scope_qname', 'line_number', 'flow_type'])) t(relation, source, source_key, target, target_key, evidence)""")(lambda g: ontology(g.spark))

# --- sources, extraction and routing over generated files ---------------------

from ..extract import tables as P  # noqa: E402
from ..sources import files as Z  # noqa: E402
from . import router as R  # noqa: E402

query("s02_language_catalogue", """SELECT page_id, path, CASE page_id % 6 WHEN 0 THEN 'python' WHEN 1 THEN 'typescript' WHEN 2 THEN 'go' WHEN 3 THEN 'cmake' WHEN 4 THEN 'rust' END AS language
    FROM (SELECT page_id, 'src/d' || page_id || '/' || (['m.py', 'm.tsx', 'm.go', 'CMakeLists.txt', 'm.rs', 'm.unknown'])[1 + page_id % 6] AS path FROM {pages})""")(
    lambda g: g.pages.select("page_id", F.concat(F.lit("src/d"), "page_id", F.lit("/"), F.element_at(F.array(*map(F.lit, ("m.py", "m.tsx", "m.go", "CMakeLists.txt", "m.rs", "m.unknown"))), (F.col("page_id") % 6 + 1).cast("int"))).alias("path")).withColumn(
        "language", Z.language(F.col("path"))))
query("s08_query_batch", """SELECT event_id + 1 AS line, CASE event_id % 4 WHEN 0 THEN event_type WHEN 1 THEN 'find_symbol' END AS tool, event_id % 4 < 2 AS valid FROM {events} WHERE event_id % 4 < 3""")(
    lambda g: Z.query_items(g.events.select(F.col("event_id").alias("pos"), F.when(F.col("event_id") % 4 == 0, F.concat(F.lit('{"tool": "'), "event_type", F.lit('"}'))).when(F.col("event_id") % 4 == 1, F.concat(F.lit('{"query": "'), "event_type", F.lit('"}'))).when(
        F.col("event_id") % 4 == 2, F.lit("no json")).otherwise(F.lit("  ")).alias("value"))).select("line", "tool", "valid"))
query("s11_status_changes", """WITH e AS (SELECT event_id AS pos, event_id % 4 AS k, concat('f', event_id % 90) AS f FROM {events}), x AS (SELECT pos, f AS path, CASE WHEN k IN (1, 2) THEN 'destructive' ELSE 'changed' END AS change FROM e UNION ALL SELECT pos, f || '.new', 'changed' FROM e WHERE k = 2)
    SELECT path, change, min(pos) AS pos FROM x GROUP BY 1, 2""")(
    lambda g: Z.status_changes(g.events.select(F.col("event_id").alias("pos"), F.concat(F.element_at(F.array(*map(F.lit, (" M ", " D ", "R  ", "?? "))), (F.col("event_id") % 4 + 1).cast("int")), F.concat(F.lit("f"), F.col("event_id") % 90),
                                                                                             F.when(F.col("event_id") % 4 == 2, F.concat(F.lit(" -> f"), F.col("event_id") % 90, F.lit(".new"))).otherwise("")).alias("value"))).select("path", "change", "pos"))
query("s13_markdown_notes", """SELECT 'd/' || doc_id || '.md' AS path, CASE WHEN doc_id % 3 = 0 THEN CAST(doc_id AS VARCHAR) ELSE 'Title ' || doc_id END AS title, CASE WHEN doc_id % 5 > 0 THEN 'para ' || source || ' end' END AS summary, CASE WHEN doc_id % 5 = 0 THEN 'no summary paragraph' END AS reason FROM {documents}""")(
    lambda g: Z.markdown_notes(g.documents.select(F.concat(F.lit("d/"), "doc_id", F.lit(".md")).alias("path"), F.concat(F.lit("---\nk: v\n---\n"), F.when(F.col("doc_id") % 3 > 0, F.concat(F.lit("# Title "), "doc_id", F.lit("\n"))).otherwise(""), F.lit("\n- item\n```\ncode\n```\n\n"),
                                                            F.when(F.col("doc_id") % 5 > 0, F.concat(F.lit("para  "), "source", F.lit("\nend\n\nmore"))).otherwise("")).alias("text"))))
query("s17_csv_safe", "SELECT id, CASE WHEN id % 3 = 0 THEN '''=' || title ELSE title END AS title FROM {activity}")(
    lambda g: Z.csv_safe(g.activity.select("id", F.when(F.col("id") % 3 == 0, F.concat(F.lit("="), "title")).otherwise(F.col("title")).alias("title"))))
query("s18_batch_rejects", """SELECT batch_id, CASE WHEN n > 12 THEN 'too many items' WHEN wrong > 0 THEN 'content does not match its digest' WHEN n > k THEN 'conflicting path' END AS reason FROM (SELECT o_custkey AS batch_id, count(*) AS n, count(*) FILTER (o_orderkey % 40 = 3) AS wrong, count(DISTINCT o_orderkey % 50) AS k
    FROM {orders} GROUP BY 1) WHERE n > 12 OR wrong > 0 OR n > k""")(
    lambda g: Z.batch_rejects(g.orders.select(F.col("o_custkey").alias("batch_id"), (F.col("o_orderkey") % 50).cast("string").alias("path"), F.col("o_orderpriority").alias("content"),
                                              F.when(F.col("o_orderkey") % 40 == 3, "0").otherwise(F.sha2(F.col("o_orderpriority").cast("binary"), 256)).alias("sha256"), F.octet_length("o_orderpriority").cast("long").alias("bytes"), F.lit(False).alias("tombstone")), 12))
query("s19_batch_plan", """WITH RECURSIVE o AS (SELECT source AS project, doc_id::VARCHAR AS path, strlen(text) AS bytes, row_number() OVER (PARTITION BY source ORDER BY doc_id::VARCHAR) AS r FROM {documents}),
    f AS (SELECT project, path, bytes, r, 0 AS batch, 1 AS n, coalesce(bytes, 0) AS size FROM o WHERE r = 1 UNION ALL SELECT o.project, o.path, o.bytes, o.r, CASE WHEN f.n = 500 OR f.size + coalesce(o.bytes, 0) > 100000 THEN f.batch + 1 ELSE f.batch END,
    CASE WHEN f.n = 500 OR f.size + coalesce(o.bytes, 0) > 100000 THEN 1 ELSE f.n + 1 END, CASE WHEN f.n = 500 OR f.size + coalesce(o.bytes, 0) > 100000 THEN coalesce(o.bytes, 0) ELSE f.size + coalesce(o.bytes, 0) END
    FROM f JOIN o ON o.project IS NOT DISTINCT FROM f.project AND o.r = f.r + 1) SELECT project, path, bytes, false AS tombstone, batch FROM f""")(lambda g: Z.plan_batches(g.documents.select(F.col("source").alias("project"), F.col("doc_id").cast("string").alias("path"), F.octet_length("text").cast("long").alias("bytes"), F.lit(False).alias("tombstone")), 500, 100_000))
query("f13_safe_learning", """SELECT event_id FROM {events} WHERE event_type IN ('view', 'click') AND value / 100 <= 1 AND event_id % 7 <> 0""")(
    lambda g: L.safe_learning(g.events.select("event_id", F.when(F.col("event_type") == "view", "lesson").when(F.col("event_type") == "click", "decision").otherwise(F.col("event_type")).alias("category"), F.lit("t").alias("title"),
                                              F.when(F.col("event_id") % 7 == 0, F.lit("use api_key=abcd")).otherwise("use it").alias("lesson"), (F.col("value") / 100).alias("confidence"))).select("event_id"))
_FILES_PY = lambda g: g.part.select(F.concat(F.lit("src/m"), "p_partkey", F.lit(".py")).alias("path"), F.concat(F.lit("from m"), F.col("p_partkey") + 1, F.lit(" import f"), F.col("p_partkey") + 1, F.lit("\n\ndef f"), "p_partkey", F.lit("(a):\n    b = f"), F.col("p_partkey") + 1, F.lit("(a)\n    return b\n")).alias("text"))
query("p01_python_symbols", "SELECT concat('m', p_partkey, '.f', p_partkey) AS qualified_name, 'function' AS symbol_type, concat('src/m', p_partkey, '.py') AS file_path, 3 AS line_start, 5 AS line_end FROM {part}")(
    lambda g: P.tables(P.evidence(_FILES_PY(g)))["symbol"].select("qualified_name", "symbol_type", "file_path", "line_start", "line_end"))
query("p10_python_calls", "SELECT concat('m', p_partkey, '.f', p_partkey) AS src, concat('m', p_partkey + 1, '.f', p_partkey + 1) AS dst FROM {part} WHERE p_partkey + 1 IN (SELECT p_partkey FROM {part})")(
    lambda g: P.linked(_FILES_PY(g))["calls"])
query("p11_python_flows", """WITH n AS (SELECT concat('m', p_partkey, '.f', p_partkey) AS f, concat('m', p_partkey + 1, '.f', p_partkey + 1) AS h, concat('f', p_partkey + 1) AS imported, p_partkey + 1 IN (SELECT p_partkey FROM {part}) AS has FROM {part})
    SELECT f || ':a' AS src, f || ':b' AS dst, 'assignment' AS flow_type FROM n UNION ALL SELECT f || ':b', f || ':__return__', 'return' FROM n UNION ALL SELECT f || ':a', h || ':a', 'argument' FROM n WHERE has UNION ALL SELECT h || ':__return__', f || ':b', 'call_return' FROM n WHERE has""")(
    lambda g: P.linked(_FILES_PY(g))["flows_to"].where(~F.col("src").rlike(":f[0-9]+$")).select("src", "dst", "flow_type"))
query("p04_typescript_calls", "SELECT concat('t', p_partkey, '.run', p_partkey) AS caller, concat('go', p_partkey) AS callee FROM {part}")(
    lambda g: P.tables(P.evidence(g.part.select(F.concat(F.lit("src/t"), "p_partkey", F.lit(".ts")).alias("path"), F.concat(F.lit("export function run"), "p_partkey", F.lit("(a) {\n  go"), "p_partkey", F.lit("(a)\n}\n")).alias("text"))))["raw_call"].select(
        F.col("caller_qname").alias("caller"), F.col("callee_name").alias("callee")))
_REACH = "r AS (SELECT src AS a, dst AS b FROM {calls} UNION SELECT r.a, e.dst FROM r JOIN {calls} e ON r.b = e.src)"
query("g05_on_cycles", f"WITH RECURSIVE {_REACH} SELECT a AS symbol FROM r WHERE a = b")(lambda g: G.on_cycles(g.calls).select("symbol"))
query("g06_cycle_sizes", f"""WITH RECURSIVE {_REACH}, s AS (SELECT x.a, max(x.b) AS component FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY 1)
    SELECT component, count(*) AS n FROM s GROUP BY 1""")(lambda g: G.on_cycles(g.calls).groupBy("component").agg(F.count(F.lit(1)).alias("n")))
_LEVELS = """n AS (SELECT src AS symbol FROM {calls} UNION SELECT dst FROM {calls}), d(symbol, depth) USING KEY (symbol) AS (SELECT symbol, 0 FROM n WHERE symbol NOT IN (SELECT dst FROM {calls})
    UNION SELECT c.dst, min(d.depth) + 1 FROM d JOIN {calls} c ON d.symbol = c.src LEFT JOIN recurring.d AS known ON known.symbol = c.dst WHERE known.symbol IS NULL GROUP BY 1)"""
query("g07_call_depth", f"WITH RECURSIVE {_LEVELS} SELECT n.symbol, coalesce(min(d.depth), 0) AS depth FROM n LEFT JOIN d ON n.symbol = d.symbol GROUP BY 1")(lambda g: G.depths(g.calls))
query("a10_metrics", f"""WITH RECURSIVE {_LEVELS}, m AS (SELECT symbol, min(depth) AS depth FROM d GROUP BY 1), {_REACH}, f AS ({_FAN})
    SELECT count(*) AS symbols, sum(fan_out)::BIGINT AS calls, round(avg(fan_in), 2) AS avg_fan_in, round(avg(fan_out), 2) AS avg_fan_out, max(fan_in) AS max_fan_in, max(fan_out) AS max_fan_out,
    (SELECT count(*) FROM r WHERE a = b) AS in_cycles, (SELECT max(depth) FROM m) AS max_depth FROM f""")(
    lambda g: (lambda calls: A.metrics(calls, G.on_cycles(calls), G.depths(calls)))(materialise(g.calls, "calls")))
query("l06_severity_order", "SELECT id, CASE WHEN value > 300 THEN 'critical' WHEN value > 100 THEN 'medium' ELSE 'info' END AS worst FROM {activity}")(
    lambda g: (lambda r: W.by_severity(r, A.severity_rank(F.col("worst")), "id"))(g.activity.select("id", F.when(F.col("value") > 300, "critical").when(F.col("value") > 100, "medium").otherwise("info").alias("worst"))))
query("l07_versions", "SELECT DISTINCT concat(p_size % 4, '.', p_size, '.', p_partkey % 12) AS v FROM {part}")(
    lambda g: W.versions(g.part.select(F.concat_ws(".", F.col("p_size") % 4, "p_size", F.col("p_partkey") % 12).alias("v")).distinct(), "v"))
query("a16_dense_days", """WITH d AS (SELECT CAST(occurred_at AS DATE) AS day, count(*) AS n FROM {activity} GROUP BY 1) SELECT CAST(r.day AS DATE) AS day, coalesce(d.n, 0) AS n
    FROM (SELECT unnest(generate_series((SELECT min(day) FROM d), (SELECT max(day) FROM d), INTERVAL 1 DAY)) AS day) r LEFT JOIN d ON CAST(r.day AS DATE) = d.day""")(lambda g: A.dense_days(g.activity))
query("g12_routed_lookup", "SELECT s.qualified_name, s.name, s.file_path FROM {calls} c JOIN {symbol} s ON c.src = s.qualified_name WHERE c.dst = 'p.10' ORDER BY 1 LIMIT 21")(lambda g: R.plan(g, "calls", "p.10", "incoming", 20)[0])
_HITS = """h AS (SELECT s.* FROM {symbol} s JOIN {file} f ON s.file_path = f.path WHERE contains(s.name, 'ring') OR contains(s.qualified_name, 'ring') ORDER BY s.name, s.qualified_name LIMIT 20),
    rel AS (SELECT *, coalesce(list_sort((SELECT list(src) FROM (SELECT src FROM {calls} c WHERE c.dst = h.qualified_name ORDER BY src LIMIT 3))), []) AS callers,
    coalesce(list_sort((SELECT list(dst) FROM (SELECT dst FROM {calls} c WHERE c.src = h.qualified_name ORDER BY dst LIMIT 3))), []) AS callees FROM h),
    it AS (SELECT *, CASE WHEN contains(lower(qualified_name), 'ring') THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END + least(0.2::DOUBLE, 0.05::DOUBLE * (len(callers) + len(callees))) + 0.1::DOUBLE AS score,
    sum(greatest(1, length(to_json({'qualified_name': qualified_name, 'symbol_type': symbol_type, 'file_path': file_path, 'callers': callers, 'callees': callees})::VARCHAR) // 4)) OVER (ORDER BY name, qualified_name) AS used FROM rel)"""
query("g13_strategy", f"WITH {_HITS} SELECT qualified_name, score, used::BIGINT AS used FROM it WHERE used <= 400")(lambda g: R.strategy(g.symbol, g.file, g.calls, "ring", 400).select("qualified_name", "score", "used"))
_texts = lambda g: g.documents.select(F.concat(F.lit("s/"), "doc_id").alias("path"), "text")
query("g13_keyword_fallback", """SELECT 'keyword-fallback' AS source, row_number() OVER (ORDER BY path)::INT AS place, path AS file_path, line_start, 'insufficient_graph_hits' AS reason, 0.0::DOUBLE AS quality
    FROM (SELECT concat('s/', doc_id) AS path, 1 + length(substr(text, 1, instr(lower(text), 'the') - 1)) - length(replace(substr(text, 1, instr(lower(text), 'the') - 1), chr(10), '')) AS line_start
    FROM {documents} WHERE instr(lower(text), 'the') > 0 ORDER BY path LIMIT 3)""")(
    lambda g: R.bundle_rows(R.strategy_bundle(g.symbol, g.file, g.calls, _texts(g), "The ", 4000)).select("source", "place", "file_path", F.col("line_start").cast("long"), "reason", "quality"))
query("e11_improvement", "SELECT o_orderkey, round(o_totalprice / (2 * o_custkey + 1), 2) AS factor FROM {orders}")(lambda g: g.orders.select("o_orderkey", X.improvement(F.col("o_totalprice"), 2 * F.col("o_custkey") + 1).alias("factor")))
query("x12_uuid5", """SELECT p_partkey, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', 1 + ('0x' || substr(h, 17, 1))::INT % 4, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS id
    FROM (SELECT p_partkey, sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode(p_name || p_partkey)) AS h FROM {part})""")(lambda g: g.part.select("p_partkey", X.uuid5(F.concat("p_name", F.col("p_partkey").cast("string"))).alias("id")))
_TEXTS = {"go": "package m\nimport \"fmt\"\nfunc Do(a int) {\n\tfmt.Println(a)\n}\n", "rs": "use std::fs;\npub fn Do(a: u8) {\n  call(a)\n}\n", "java": "import a.B;\npublic class Do {\n}\n", "ps1": "function Do {\n  call(1)\n}\n",
          "vb": "Public Class Do\nEnd Class\n", "adb": "with Text;\nprocedure Do is\nend Do;\n", "mojo": "fn Do(a):\n    call(a)\n", "cmake": "function(Do a)\nendfunction()\n", "vy": "def Do(a):\n    pass\n", "move": "module Do {\n}\n", "cairo": "fn Do() {\n}\n", "clar": "(define-public (Do) x)\n", "cdc": "pub fun Do() {\n}\n", "cbl": "       PROGRAM-ID. Do.\n"}
query("p05_other_languages", "SELECT concat('d', page_id, '/m.', (" + str(list(_TEXTS)) + ")[1 + page_id % " + str(len(_TEXTS)) + "]) AS path, 'Do' AS name FROM {pages}")(
    lambda g: P.tables(P.evidence(g.pages.select(F.concat(F.lit("d"), "page_id", F.lit("/m."), F.element_at(F.array(*map(F.lit, _TEXTS)), (F.col("page_id") % len(_TEXTS) + 1).cast("int"))).alias("path"),
                                                 F.element_at(F.array(*map(F.lit, _TEXTS.values())), (F.col("page_id") % len(_TEXTS) + 1).cast("int")).alias("text"))))["symbol"].select(F.col("file_path").alias("path"), "name"))
query("a08_fan_out_of", "SELECT DISTINCT dst AS neighbour FROM {calls} WHERE src = 'p.3'")(lambda g: A.neighbours(g.calls, "p.3", False))
query("a33_cluster_counts", "SELECT kind, count(*) AS n FROM {node} WHERE kind <> 'Repository' GROUP BY kind")(lambda g: A.kind_counts(g.node.where("kind <> 'Repository'")))
query("w10_recent_decisions", "SELECT id FROM {audit} ORDER BY created_at DESC, id DESC LIMIT 100")(lambda g: W.page_at(g.audit, [F.desc("created_at"), F.desc("id")], 0, 100).select("id"))
query("s01_discover", "SELECT page_id, 'src/a' || page_id || '.py' AS path FROM {pages} WHERE page_id % 3 = 0")(
    lambda g: g.pages.select("page_id", F.concat(F.element_at(F.array(F.lit("src/a"), F.lit(".git/a"), F.lit("node_modules/x/a")), (F.col("page_id") % 3 + 1).cast("int")), "page_id", F.lit(".py")).alias("path")).where(Z.wanted(F.col("path"))))

from . import delivery, expansion, layout, nested, search  # noqa: E402, F401  register their queries

query("p13_generation", """SELECT lower(kind) AS relation, incoming, count(*) AS edges, count(DISTINCT CASE WHEN incoming THEN dst ELSE src END) AS nodes
    FROM {edge}, (VALUES (false), (true)) t(incoming) GROUP BY 1, 2""")(lambda g: B.of(g).adjacency.groupBy("relation", "incoming").agg(F.count(F.lit(1)).alias("edges"), F.countDistinct("here").alias("nodes")))
