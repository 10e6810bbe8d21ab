"""The property graph and its companions as views of the driver's tables.

Each view is one SELECT that both Spark SQL and DuckDB run; ``{name}`` stands for a
table or another view.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from .shared import materialise

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations").split()

VIEWS = {
    "repository": "SELECT concat('n/', n_nationkey) AS path, n_name AS name FROM {nation}",
    "file": """SELECT concat('s/', s_suppkey) AS path, r_name AS language, concat('n/', s_nationkey) AS repo, s_name AS name
        FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey""",
    "symbol": """SELECT concat('p.', p_partkey) AS qualified_name, p_name AS name, p_type AS symbol_type,
        concat('s/', p_partkey % (SELECT count(*) FROM {supplier})) AS file_path, p_size AS line_start, p_size + 9 AS line_end FROM {part}""",
    "raw_call": """SELECT a.l_orderkey AS call_id, concat('p.', a.l_partkey) AS src, concat('p.', b.l_partkey) AS dst, b.l_partkey AS callee
        FROM {lineitem} a JOIN {lineitem} b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = 1 AND b.l_linenumber = 2 AND a.l_partkey <> b.l_partkey""",
    "calls": "SELECT DISTINCT src, dst FROM {raw_call}",
    "contains": "SELECT repo AS src, path AS dst FROM {file}",
    "defines": "SELECT file_path AS src, qualified_name AS dst FROM {symbol}",
    "imports": """SELECT DISTINCT a.file_path AS src, b.file_path AS dst FROM {calls} c JOIN {symbol} a ON c.src = a.qualified_name
        JOIN {symbol} b ON c.dst = b.qualified_name WHERE a.file_path <> b.file_path""",
    "variable": """SELECT concat('u.', user_id, ':', event_type) AS qualified_name, event_type AS name, concat('u.', user_id) AS scope_qname,
        concat('s/', user_id % (SELECT count(*) FROM {supplier})) AS file_path, CAST(min(event_id) AS INT) AS line_number,
        CASE event_type WHEN 'signup' THEN 'parameter' WHEN 'purchase' THEN 'return' ELSE 'local' END AS role,
        CASE event_type WHEN 'signup' THEN 0 END AS parameter_index FROM {events} GROUP BY user_id, event_type""",
    "uses_variable": "SELECT scope_qname AS src, qualified_name AS dst FROM {variable}",
    "step": """SELECT user_id, event_id, event_type, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next_type FROM {events}""",
    "flows_to": """SELECT concat('u.', user_id, ':', event_type) AS src, concat('u.', user_id, ':', next_type) AS dst, concat('u.', user_id) AS scope_qname,
        min(event_id) AS line_number, CASE next_type WHEN 'purchase' THEN 'return' ELSE 'assignment' END AS flow_type FROM {step}
        WHERE next_type IS NOT NULL AND next_type <> event_type GROUP BY user_id, event_type, next_type""",
    "activity": """SELECT event_id AS id, concat('a', event_id) AS activity_id, concat('pl', user_id % 3) AS plugin_id, concat('sys', user_id % 4) AS source_system,
        event_type AS source_type, concat('i', event_id % 997) AS source_item_id, concat('proj', user_id % 10) AS project_id, event_type,
        concat('  Ticket   ', user_id % 17, ' of ', event_type) AS title, concat('summary ', props) AS summary,
        CASE WHEN value < 5 THEN NULL WHEN value < 40 THEN 'open' WHEN value < 120 THEN 'done' ELSE 'blocked' END AS status,
        CAST(user_id AS STRING) AS owner, md5(concat(user_id % 17, event_type)) AS content_hash, ts AS occurred_at, ts AS synced_at, value, props FROM {events}""",
    "audit": """SELECT event_id AS id, ts AS created_at, CASE event_type WHEN 'error' THEN 'admin' ELSE 'api' END AS scope, concat('Actor', user_id % 21) AS actor_name,
        concat('proj', user_id % 10) AS project_name, CASE event_type WHEN 'view' THEN concat('/api/queue/', user_id) WHEN 'click' THEN '/api/admin/schedules' WHEN 'error' THEN '/auth/login'
        ELSE concat('/api/', event_type) END AS path, CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status_code, CASE event_type WHEN 'signup' THEN 'POST' ELSE 'GET' END AS method, CAST(value AS INT) AS duration_ms FROM {events}""",
    "chunk": """SELECT d.doc_id % 20 AS case_id, CASE WHEN d.doc_id % 3 = 0 THEN 'baseline' ELSE 'scoped' END AS mode, d.doc_id AS pos, d.text AS text,
        coalesce(l.quality, 0) = 1 AS useful, d.doc_id % 40 AS evidence, d.source AS sym FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id""",
    "resource_old": "SELECT concat('r/', p_partkey) AS id, p_brand AS kind, concat(p_type, p_size) AS content_hash, p_name AS scope FROM {part} WHERE p_partkey % 7 <> 3",
    "resource_new": """SELECT concat('r/', p_partkey) AS id, p_brand AS kind, concat(p_type, CASE WHEN p_partkey % 11 = 5 THEN p_size + 1 ELSE p_size END) AS content_hash,
        p_name AS scope FROM {part} WHERE p_partkey % 13 <> 4""",
    "job": """SELECT o_orderkey AS job_id, concat('proj', o_custkey % 10) AS project, o_orderdate AS created_at,
        CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'pending' ELSE 'processing' END AS state, o_totalprice / 100 AS seconds FROM {orders}""",
    "project_facts": """SELECT c_custkey AS project_id, CASE WHEN c_custkey % 9 > 0 THEN concat('/r/', c_custkey) END AS repo_path, c_custkey % 9 > 1 AS repo_exists,
        c_custkey % 5 AS adc_present, CASE WHEN c_custkey % 17 = 0 THEN 0 ELSE 4 END AS adc_required, c_custkey % 6 > 0 AS graph_available, c_nationkey AS files, c_nationkey % 3 AS symbols,
        CASE c_mktsegment WHEN 'BUILDING' THEN 'done' WHEN 'MACHINERY' THEN 'processing' WHEN 'FURNITURE' THEN 'stale' END AS index_status, c_custkey % 4 > 0 AS has_tests,
        c_custkey % 3 AS ci_workflows, coalesce(e.n, 0) AS activity_count, c_custkey % 2 AS active_tokens, CASE WHEN c_custkey % 7 < 2 THEN 'observe-only' ELSE 'regulated' END AS profile,
        concat('L', c_custkey % 5) AS level, CASE WHEN c_custkey % 3 > 0 THEN concat('ev', c_custkey) END AS evidence_pack
        FROM {customer} LEFT JOIN (SELECT user_id, count(*) AS n FROM {events} GROUP BY user_id) e ON c_custkey = e.user_id""",
    "project_signal": """SELECT o_orderkey AS id, o_custkey AS project_id, CASE o_orderkey % 4 WHEN 0 THEN 'ci' WHEN 1 THEN 'pr' WHEN 2 THEN 'benchmark' ELSE 'note' END AS kind,
        CASE o_orderstatus WHEN 'F' THEN ' Passed' WHEN 'O' THEN 'failed' ELSE 'running' END AS status, o_orderdate AS created_at FROM {orders}""",
    "edge": """SELECT 'CONTAINS' AS kind, src, dst FROM {contains} UNION ALL SELECT 'DEFINES', src, dst FROM {defines} UNION ALL SELECT 'IMPORTS', src, dst FROM {imports}
        UNION ALL SELECT 'CALLS', src, dst FROM {calls} UNION ALL SELECT 'USES_VARIABLE', src, dst FROM {uses_variable} UNION ALL SELECT 'FLOWS_TO', src, dst FROM {flows_to}""",
    "node": """SELECT 'Repository' AS kind, path AS id, name FROM {repository} UNION ALL SELECT 'File', path, name FROM {file}
        UNION ALL SELECT 'Symbol', qualified_name, name FROM {symbol} UNION ALL SELECT 'Variable', qualified_name, name FROM {variable}""",
}


class Graph:
    """Views and tables of one data set by name, each built once."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self._made = spark, sf_dir, {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._made:
            if name in TABLES:
                self._made[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            else:
                text = VIEWS[name]
                self._made[name] = self.spark.sql(text, **{n: self[n] for n in set(re.findall(r"\{([a-z]\w*)\}", text))})
        return self._made[name]

    def kept(self, *names: str) -> Graph:
        """The same data set with the named views as tables in the shared folder, for work that reads them more than once."""
        out = Graph(self.spark, self.sf_dir)
        for name in names:
            out._made[name] = materialise(out[name], name)
        return out

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in VIEWS and name not in TABLES:
            raise AttributeError(name)
        return self[name]


def with_views(select: str, recursive: bool = False) -> str:
    """A DuckDB statement: ``select`` with the views it names in front."""
    order: list[str] = []

    def need(text: str) -> None:
        for name in re.findall(r"\{([a-z]\w*)\}", text):
            if name in VIEWS and name not in order:
                need(VIEWS[name])
                if name not in order:
                    order.append(name)

    need(select)
    plain = lambda text: re.sub(r"\{([a-z]\w*)\}", lambda m: f"v_{m[1]}" if m[1] in VIEWS else m[1], text)
    views = ", ".join(f"v_{n} AS ({plain(VIEWS[n])})" for n in order)
    body = plain(select).strip()
    more = re.match(r"WITH\s+(RECURSIVE\s+)?", body)
    if more:
        return f"WITH {'RECURSIVE ' if recursive or more[1] else ''}{views + ', ' if views else ''}{body[more.end():]}"
    return f"WITH {views} {body}" if views else body
