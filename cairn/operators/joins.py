"""One-hop relations, dependency joins, resolution and snapshot differences."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..graph_model import KEYS, checked


def callers(calls: DataFrame, symbols: DataFrame, name: str, limit: int = 20) -> DataFrame:
    return calls.where(F.col("dst") == name).join(symbols, F.col("src") == F.col("qualified_name")).select(
        "qualified_name", "name", "file_path").orderBy("qualified_name").limit(limit)


def callees(calls: DataFrame, symbols: DataFrame, name: str, limit: int = 20) -> DataFrame:
    return calls.where(F.col("src") == name).join(symbols, F.col("dst") == F.col("qualified_name")).select(
        "qualified_name", "name", "file_path").orderBy("qualified_name").limit(limit)


def file_imports(imports: DataFrame, files: DataFrame, path: str, limit: int | None = None, incoming: bool = False) -> DataFrame:
    """Files that ``path`` imports, or with ``incoming`` that import it; ordered only under a limit of 1 to 101."""
    here, there = ("dst", "src") if incoming else ("src", "dst")
    out = imports.where(F.col(here) == path).join(files, F.col(there) == F.col("path")).select("path", "language")
    if limit is None:
        return out
    if not 1 <= limit <= 101:
        raise ValueError("limit must be from 1 to 101")
    return out.orderBy("path").limit(limit)


def dependency_overview(imports: DataFrame, files: DataFrame, limit: int = 30) -> DataFrame:
    left = files.select(F.col("path").alias("src"), F.col("language").alias("src_language"))
    right = files.select(F.col("path").alias("dst"), F.col("language").alias("dst_language"))
    return imports.join(left, "src").join(right, "dst").select("src", "src_language", "dst", "dst_language").orderBy("src", "dst").limit(limit)


def relation(tables, name: str, identity: str, direction: str = "outgoing", limit: int = 20) -> DataFrame:
    """Typed one-hop query over any relation in either direction; ``tables`` maps node and relation names to DataFrames.

    Columns: source, target, target_path, line, and the edge's evidence; up to limit + 1 rows, so
    that a caller sees whether there are more.
    """
    r = checked(name, identity, direction, limit)
    here, there, far = ("src", "dst", r.target) if direction == "outgoing" else ("dst", "src", r.source)
    edges = tables[name].where(F.col(here) == identity)
    nodes = tables[far]
    has = lambda c: F.col(c) if c in nodes.columns else F.lit(None)
    ends = nodes.select(F.col(KEYS[far]).alias("far"), (has("file_path") if "file_path" in nodes.columns else has("path")).cast("string").alias("far_path"),
                        F.coalesce(has("line_start").cast("long"), has("line_number").cast("long")).alias("line"))
    got = edges.join(ends, F.col(there) == F.col("far"))
    evidence = [F.col(c) if c in edges.columns else F.lit(None).cast(t).alias(c) for c, t in (("scope_qname", "string"), ("line_number", "long"), ("flow_type", "string"))]
    return got.select(F.col("src").alias("source"), F.col("dst").alias("target"), "far_path", "line", *evidence).orderBy(
        "source", "target", "scope_qname", "line_number", "flow_type").limit(limit + 1)


def file_call_dependencies(defines: DataFrame, calls: DataFrame, limit: int | None = 20) -> DataFrame:
    """Pairs of different files by the calls between their symbols, with distinct callers and callees."""
    a, b = defines.select(F.col("src").alias("from_file"), F.col("dst").alias("caller")), defines.select(F.col("src").alias("to_file"), F.col("dst").alias("callee"))
    out = calls.join(a, F.col("src") == F.col("caller")).join(b, F.col("dst") == F.col("callee")).where("from_file <> to_file").groupBy("from_file", "to_file").agg(
        F.countDistinct("caller").alias("callers"), F.countDistinct("callee").alias("callees"), F.count(F.lit(1)).alias("calls"))
    return out if limit is None else out.orderBy(F.desc("calls"), "from_file", "to_file").limit(limit)


def lineage(variables: DataFrame, flows: DataFrame) -> DataFrame:
    """Distinct direct sources and targets of every variable, sorted; empty where there are none."""
    into = flows.groupBy(F.col("dst").alias("qualified_name")).agg(F.array_sort(F.collect_set("src")).alias("sources"))
    out = flows.groupBy(F.col("src").alias("qualified_name")).agg(F.array_sort(F.collect_set("dst")).alias("targets"))
    none = F.array().cast("array<string>")
    return variables.select("qualified_name").join(into, "qualified_name", "left").join(out, "qualified_name", "left").select(
        "qualified_name", F.coalesce("sources", none).alias("sources"), F.coalesce("targets", none).alias("targets"))


def scope_metrics(variables: DataFrame, flows: DataFrame) -> DataFrame:
    """Distinct flows in and out of each variable within its own scope."""
    into = flows.groupBy(F.col("dst").alias("qualified_name"), F.col("scope_qname")).agg(F.countDistinct("src").alias("flows_in"))
    out = flows.groupBy(F.col("src").alias("qualified_name"), F.col("scope_qname")).agg(F.countDistinct("dst").alias("flows_out"))
    keys = ["qualified_name", "scope_qname"]
    return variables.select(*keys, "role").join(into, keys, "left").join(out, keys, "left").fillna(0, ["flows_in", "flows_out"])


def missing_share(names: DataFrame, symbols: DataFrame) -> DataFrame:
    """Per ``key``: names, names that no symbol has, and their share rounded to 4."""
    known = symbols.select(F.col("qualified_name").alias("known")).distinct()
    return names.join(known, F.col("name") == F.col("known"), "left").groupBy("key").agg(
        F.count(F.lit(1)).alias("total"), F.sum(F.when(F.col("known").isNull(), 1).otherwise(0)).alias("missing")).select(
        "key", "total", "missing", F.round(F.col("missing") / F.col("total"), 4).alias("share"))


def scope_parameters(variables: DataFrame, scopes: DataFrame) -> DataFrame:
    """Parameters of the scopes in ``scopes`` (scope_qname), in order."""
    return variables.where("role = 'parameter'").join(scopes.select("scope_qname").distinct(), "scope_qname", "left_semi").select(
        "scope_qname", "parameter_index", "line_number", "name").orderBy("scope_qname", "parameter_index", "line_number", "name")


def resolve_calls(raw: DataFrame, symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """Callee of each raw call (call_id, file_path, callee_name) by the first tier with exactly one candidate.

    Tiers: a symbol of that name in the caller's file, in a file it imports, anywhere. A tier with
    several candidates makes the call ambiguous and ends the search; then and without candidates there is no row.
    """
    named = symbols.select(F.col("name").alias("callee_name"), "qualified_name", F.col("file_path").alias("def_path"))
    def tier(n: int, hits: DataFrame) -> DataFrame:
        return hits.groupBy("call_id").agg(F.count(F.lit(1)).alias("n"), F.min("qualified_name").alias("target")).withColumn("tier", F.lit(n))

    # names with one symbol anywhere need no list of candidates, so the widest tier stays one row a name
    unique = named.groupBy("callee_name").agg(F.count(F.lit(1)).alias("n"), F.min("qualified_name").alias("target"))
    same = raw.join(named, (raw["callee_name"] == named["callee_name"]) & (raw["file_path"] == named["def_path"]))
    links = imports.select(F.col("src").alias("file_path"), F.col("dst").alias("def_path")).distinct()
    imported = raw.join(links, "file_path").join(named, ["callee_name", "def_path"])
    anywhere = raw.select("call_id", "callee_name").join(unique, "callee_name").select("call_id", "n", "target", F.lit(3).alias("tier"))
    every = tier(1, same).unionByName(tier(2, imported)).unionByName(anywhere)
    first = every.groupBy("call_id").agg(F.min_by(F.struct("n", "target"), "tier").alias("best"), F.min("tier").alias("tier"))
    return first.where("best.n = 1").select("call_id", F.col("best.target").alias("target"), "tier")


def resolve_imports(raw: DataFrame, files: DataFrame, suffixes: tuple[str, ...] = ("", ".py", "/__init__.py")) -> DataFrame:
    """File of each raw import (src, module): the first of its candidate paths that is known."""
    tried = raw.select("src", "module", F.posexplode(F.array(*[F.concat(F.col("module"), F.lit(s)) for s in suffixes])).alias("pos", "path"))
    return tried.join(files.select("path"), "path").groupBy("src", "module").agg(F.min_by("path", "pos").alias("dst"))


def labelled(rows: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    return rows.join(labels, key, "left")


def active_tokens(tokens: DataFrame, projects: DataFrame) -> DataFrame:
    """Tokens with their projects, where both are active."""
    return tokens.where("token_active = 1").join(projects.where("project_active = 1"), "project_id")


def diff(old: DataFrame, new: DataFrame, key: str = "id", value: str = "content_hash") -> DataFrame:
    """created, deleted and modified keys of two snapshots; equal rows, null values included, are left out."""
    a, b = old.select(F.col(key).alias("k"), F.lit(1).alias("in_old"), F.col(value).alias("before")), new.select(F.col(key).alias("l"), F.lit(1).alias("in_new"), F.col(value).alias("after"))
    return a.join(b, F.col("k") == F.col("l"), "full_outer").select(
        F.coalesce("k", "l").alias(key),
        F.when(F.col("in_old").isNull(), "created").when(F.col("in_new").isNull(), "deleted").when(~F.col("before").eqNullSafe(F.col("after")), "modified").alias("change"),
        "before", "after").where("change is not null")


def relation_summary(hits: DataFrame, calls: DataFrame, most: int = 3) -> DataFrame:
    """The first callers and callees of each hit (qualified_name), up to ``most``."""
    def first(edges: DataFrame, here: str, there: str, name: str) -> DataFrame:
        near = edges.join(hits.select("qualified_name"), F.col(here) == F.col("qualified_name"))
        order = Window.partitionBy("qualified_name").orderBy(there)
        return near.withColumn("n", F.row_number().over(order)).where(F.col("n") <= most).groupBy("qualified_name").agg(F.array_sort(F.collect_list(there)).alias(name))

    none = F.array().cast("array<string>")
    return hits.select("qualified_name").join(first(calls, "dst", "src", "callers"), "qualified_name", "left").join(
        first(calls, "src", "dst", "callees"), "qualified_name", "left").select("qualified_name", F.coalesce("callers", none).alias("callers"), F.coalesce("callees", none).alias("callees"))


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges both of whose ends are in ``nodes`` (id)."""
    ids = nodes.select("id").distinct()
    return edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")


def scope_or_fallback(wanted: DataFrame, fallback: DataFrame) -> DataFrame:
    return fallback if wanted.isEmpty() else wanted


def enrich(activities: DataFrame, cache: DataFrame, now: str) -> DataFrame:
    """Details of each activity's references (id, refs) from unexpired entries of ``cache`` (ref, details, expires_at)."""
    live = cache.where(F.col("expires_at") > F.lit(now).cast("timestamp")).select("ref", "details")
    return activities.select("id", F.explode(F.array_distinct("refs")).alias("ref")).join(live, "ref", "left").groupBy("id").agg(
        F.array_sort(F.collect_list("details")).alias("details"), F.sum(F.when(F.col("details").isNull(), 1).otherwise(0)).alias("to_fetch"))


#: Users that share a copy of a list of projects.
SHARE = 256


def accessible(members: DataFrame, groups: DataFrame, grants: DataFrame) -> DataFrame:
    """(user, project_id) by membership of active groups; each pair once.

    The pairs are users times projects by nature, so none of them is shuffled: users with the same active groups have one list of distinct
    projects, and each user meets its list once. A list goes to as many tasks as its users need, a copy for SHARE of them or more.
    """
    parts = max(1, int(members.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    live = groups.where("active = 1").select("group_id").distinct()
    held = members.select("user", "group_id").join(live, "group_id", "left_semi").groupBy("user").agg(F.array_sort(F.collect_set("group_id")).alias("groups"))
    sets = held.groupBy("groups").agg(F.least(F.ceil(F.count(F.lit(1)) / SHARE), F.lit(parts)).cast("int").alias("copies"))
    lists = sets.select("groups", F.explode("groups").alias("group_id")).join(grants.select("group_id", "project_id").distinct(), "group_id").select("groups", "project_id").distinct()
    copied = lists.join(sets, "groups").select("groups", "project_id", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"))
    dealt = held.join(sets, "groups").select("user", "groups", F.pmod(F.xxhash64("user"), "copies").cast("int").alias("copy"))
    at = [F.col("groups"), F.col("copy")]
    return dealt.repartition(parts, *at).join(copied.repartition(parts, *at), ["groups", "copy"]).select("user", "project_id")
