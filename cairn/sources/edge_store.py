"""The graph's edges published for look-ups from either end.

One table holds every edge twice, once under its source and once under its target, with what a one-hop query returns of the far
end. The near end has a 64-bit key; rows are dealt out by ranges of (relation, direction, key, far end) and sorted by them in files
with statistics and Bloom filters, so that the filter of a look-up is pushed to the scan and leaves few row groups, and the edges
of a hub are spread over files. Names are compared after keys, so no answer rests on a hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..graph_model import KEYS, RELATIONS
from ..shared import drop, fresh_dir
from . import generations

ADJACENT = ("relation string, incoming boolean, key long, here string, there string, known boolean, name string, path string, language string, line long, "
            "scope_qname string, line_number long, flow_type string")
#: Nodes of a step that are looked up by the filter of the scan; more are joined.
FEW = 500
NODE = "label string, key long, id string, name string, path string"


def key_of(identity: Column) -> Column:
    return F.xxhash64(identity)


def _nodes(tables) -> DataFrame:
    """All nodes as (label, id, name, path, language, line)."""
    def one(label: str) -> DataFrame:
        t = tables[label]
        has = lambda c, kind: F.col(c).cast(kind) if c in t.columns else F.lit(None).cast(kind)
        return t.select(F.lit(label).alias("label"), F.col(KEYS[label]).alias("id"), has("name", "string").alias("name"),
                        F.coalesce(has("file_path", "string"), has("path", "string")).alias("path"), has("language", "string").alias("language"),
                        F.coalesce(has("line_start", "long"), has("line_number", "long")).alias("line"))

    out = one("repository")
    for label in list(KEYS)[1:]:
        out = out.unionByName(one(label))
    return out


def adjacency(tables) -> DataFrame:
    """ADJACENT rows of all relations but for their key, which shuffles need not carry; ``known`` says whether the far end is a node."""
    def one(name: str) -> DataFrame:
        t, r = tables[name], RELATIONS[name]
        has = lambda c, kind: F.col(c).cast(kind).alias(c) if c in t.columns else F.lit(None).cast(kind).alias(c)
        ends = F.explode(F.array(*(F.struct(F.lit(i).alias("incoming"), F.col(a).alias("here"), F.col(b).alias("there"), F.lit(label).alias("label"))
                                   for i, a, b, label in ((False, "src", "dst", r.target), (True, "dst", "src", r.source)))))
        return t.select(F.lit(name).alias("relation"), ends.alias("e"), has("scope_qname", "string"), has("line_number", "long"), has("flow_type", "string"))

    edges = one("contains")
    for name in list(RELATIONS)[1:]:
        edges = edges.unionByName(one(name))
    rows = edges.select("relation", "e.*", "scope_qname", "line_number", "flow_type")
    far = _nodes(tables).select(F.col("label").alias("l"), F.col("id").alias("i"), "name", "path", "language", "line")
    joined = rows.join(far, (F.col("label") == F.col("l")) & (F.col("there") == F.col("i")), "left")
    return joined.select("relation", "incoming", "here", "there", F.col("i").isNotNull().alias("known"), "name", "path", "language", "line", "scope_qname", "line_number", "flow_type")


def publish(spark: SparkSession, root: str, tables, expected: str | None = None) -> str:
    """A new generation of the store below ``root`` from ``tables``, which maps node and relation names to DataFrames; as many files as the session has shuffle partitions."""
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    order, by = ("relation", "incoming", "here", "there"), ("label", "id")
    dealt = lambda df, key, columns: df.repartitionByRange(parts, *(key_of(F.col(c)) if c == key else F.col(c) for c in columns)).withColumn("key", key_of(F.col(key))).sortWithinPartitions(
        *("key" if c == key else c for c in columns))
    made = {"adjacency": dealt(adjacency(tables), "here", order).select("relation", "incoming", "key", "here", "there", "known", "name", "path", "language", "line", "scope_qname", "line_number", "flow_type"),
            "nodes": dealt(_nodes(tables).select("label", "id", "name", "path"), "id", by).select("label", "key", "id", "name", "path")}
    return generations.publish(spark, root, made, expected, {"parquet.bloom.filter.enabled#key": "true", "parquet.block.size": str(16 << 20), "compression": "zstd"})


class EdgeStore:
    """Look-ups in the generation that was current when the store was opened."""

    def __init__(self, spark: SparkSession, root: str):
        at = generations.current(spark, root)
        self.adjacency = generations.read(spark, root, "adjacency", at, ADJACENT)
        self.nodes = generations.read(spark, root, "nodes", at, NODE)

    def edges(self, relation: str, incoming: bool = False) -> DataFrame:
        return self.adjacency.where((F.col("relation") == relation) & (F.col("incoming") == F.lit(incoming)))

    def near(self, relation: str, identity: str, incoming: bool = False) -> DataFrame:
        """Edges at one node; relation, direction and key are filters of the scan."""
        return self.edges(relation, incoming).where((F.col("key") == key_of(F.lit(identity))) & (F.col("here") == identity))

    def node(self, label: str, identity: str) -> DataFrame:
        return self.nodes.where((F.col("label") == label) & (F.col("key") == key_of(F.lit(identity))) & (F.col("id") == identity))


_opened: dict[tuple[str, str], tuple[tuple, EdgeStore]] = {}


def _state(spark: SparkSession, sf_dir: str, names: tuple[str, ...]) -> tuple:
    """Names, lengths and times of the files that a store is made of."""
    out = []
    for name in names:
        fs, path, _ = generations._fs(spark, f"{sf_dir}/{name}.parquet")
        status = fs.getFileStatus(path)
        out += [(f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in (fs.listStatus(path) if status.isDirectory() else [status])]
    return tuple(out)


def of(g) -> EdgeStore:
    """The store of a data set (views.Graph), published in the shared folder on its first use in a session and again when its files change."""
    spark = g.spark
    where = spark.sparkContext.applicationId, g.sf_dir
    state = _state(spark, g.sf_dir, ("lineitem", "part", "supplier", "nation", "region", "events"))
    if where not in _opened or _opened[where][0] != state:
        root = fresh_dir(spark, "edge-store")
        tables = g.kept("calls", "variable")
        publish(spark, root, tables)
        drop(spark, tables.calls, tables.variable)
        _opened[where] = state, EdgeStore(spark, root)
    return _opened[where][1]


def callers(store: EdgeStore, name: str, limit: int = 20) -> DataFrame:
    return _called(store.near("calls", name, True), limit)


def callees(store: EdgeStore, name: str, limit: int = 20) -> DataFrame:
    return _called(store.near("calls", name), limit)


def _called(edges: DataFrame, limit: int) -> DataFrame:
    return edges.where("known").select(F.col("there").alias("qualified_name"), "name", F.col("path").alias("file_path")).orderBy("qualified_name").limit(limit)


def call_graph(store: EdgeStore, name: str, limit: int = 50) -> DataFrame:
    """One hop each way."""
    return callers(store, name, limit).withColumn("way", F.lit("caller")).union(callees(store, name, limit).withColumn("way", F.lit("callee")))


def file_imports(store: EdgeStore, path: str, limit: int | None = None, incoming: bool = False) -> DataFrame:
    out = store.near("imports", path, incoming).where("known").select(F.col("there").alias("path"), "language")
    if limit is None:
        return out
    if not 1 <= limit <= 101:
        raise ValueError("limit must be from 1 to 101")
    return out.orderBy("path").limit(limit)


def relation(store: EdgeStore, name: str, identity: str, direction: str = "outgoing", limit: int = 20) -> DataFrame:
    """As joins.relation, from the store."""
    from ..graph_model import checked

    checked(name, identity, direction, limit)
    incoming = direction == "incoming"
    source, target = ("there", "here") if incoming else ("here", "there")
    return store.near(name, identity, incoming).where("known").select(F.col(source).alias("source"), F.col(target).alias("target"), F.col("path").alias("far_path"), "line", "scope_qname", "line_number", "flow_type").orderBy(
        "source", "target", "scope_qname", "line_number", "flow_type").limit(limit + 1)


def reach(store: EdgeStore, relation: str, start: Column, begin: DataFrame, hops: int) -> DataFrame:
    """(node, depth) of what is within ``hops`` of ``begin`` (node) by edges either way. The first step's keys are filters of the scan if
    ``start`` is a constant, and so are those of later steps that begin at FEW nodes at most; others join the nodes found with the store.
    """
    either = store.adjacency.where(F.col("relation") == relation)
    front = begin.select("node", F.lit(0).alias("depth"))
    seen = front
    for d in range(1, hops + 1):
        if d == 1:
            step = either.where((F.col("key") == key_of(start)) & (F.col("here") == start)).select(F.col("there").alias("node"))
        elif len(few := [tuple(r) for r in front.select("node", key_of(F.col("node"))).limit(FEW + 1).collect()]) <= FEW:
            if not few:
                return seen
            step = either.where(F.col("key").isin([k for _, k in few]) & F.col("here").isin([n for n, _ in few])).select(F.col("there").alias("node"))
        else:
            step = either.join(front.select(F.col("node").alias("here"), key_of(F.col("node")).alias("key")), ["key", "here"]).select(F.col("there").alias("node"))
        front = step.distinct().join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(d))
        seen = seen.union(front)
    return seen


def neighbourhood(store: EdgeStore, start: str, hops: int = 2, flows: bool = False) -> DataFrame:
    """As graph.neighbourhood, from the store."""
    spark = store.nodes.sparkSession
    own = store.node("symbol", start).select("path").first()
    one = lambda x: spark.range(1).select(F.lit(x).alias("node"))
    near = reach(store, "calls", F.lit(start), one(start), hops).withColumn("relation", F.lit("CALLS"))
    if own is not None:
        near = near.union(reach(store, "imports", F.lit(own[0]), one(own[0]), hops).withColumn("relation", F.lit("IMPORTS")))
    near = near.where("depth > 0")
    if flows:
        used = store.near("uses_variable", start).select(F.col("there").alias("here"), key_of(F.col("there")).alias("key"))
        into = store.edges("flows_to").where(F.col("scope_qname") == start).join(used, ["key", "here"], "left_semi")
        near = near.union(into.select(F.col("there").alias("node"), F.lit(1).alias("depth"), F.lit("FLOWS_TO").alias("relation")))
    return near.groupBy("relation", "node").agg(F.min("depth").alias("depth"))
