"""Files to graph tables: extraction, resolution and publication of generations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import materialise
from . import patterns, python_source

EVIDENCE = """path string, language string, error string, content_hash string,
symbols array<struct<qualified_name:string,name:string,symbol_type:string,line_start:int,line_end:int,parameters:array<struct<name:string,kind:string,has_default:boolean>>>>,
imports array<string>,
bindings array<struct<scope_qname:string,name:string,target:string>>,
calls array<struct<caller_qname:string,callee_name:string,callee_qualifier:string,arguments:array<struct<dependencies:array<string>,position:int,keyword:string,unpacked:boolean>>,line_number:int,result_var_qname:string,shadowed:boolean>>,
variables array<struct<qualified_name:string,name:string,scope_qname:string,line_number:int,role:string,parameter_index:int>>,
flows array<struct<src:string,dst:string,scope_qname:string,line_number:int,flow_type:string>>"""


#: Files of a batch of evidence.
FILES = 256


def evidence(files: DataFrame) -> DataFrame:
    """One row of nested evidence for each (path, text) whose language is known; content_hash is SHA-256 of the text.

    Files are dealt over the session's shuffle partitions first: a table of short files is few splits to read, but each file costs its parser.
    """
    import hashlib

    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = to_arrow_schema(_parse_datatype_string(EVIDENCE))

    def rows(batches):
        for whole in batches:
            for lo in range(0, whole.num_rows, FILES):
                out = []
                for path, text in zip(*(whole.column(c).slice(lo, FILES).to_pylist() for c in ("path", "text")), strict=True):
                    language = patterns.language_of(path)
                    if language is None or text is None:
                        continue
                    got = python_source.extract(path, text) if language == "python" else patterns.extract(path, text, language)
                    out.append(got | {"content_hash": hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()})
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema)

    parts = max(1, int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return files.select("path", "text").repartition(parts, "path").mapInArrow(rows, EVIDENCE)


def linked(files: DataFrame) -> dict[str, DataFrame]:
    """resolve() of ``files`` (path, text): each file is parsed once and its evidence kept in the shared folder, where each table reads its own columns."""
    return resolve(tables(materialise(evidence(files), "evidence")))


def tables(found: DataFrame) -> dict[str, DataFrame]:
    """Symbols, imports, raw calls, variables and flows of evidence rows, exploded."""
    each = lambda column: found.select("path", "language", F.explode(column).alias("x"))
    return {
        "file": found.select("path", "language", "content_hash"),
        "symbol": each("symbols").select("x.qualified_name", "x.name", "x.symbol_type", F.col("path").alias("file_path"), "x.line_start", "x.line_end", "x.parameters").dropDuplicates(["qualified_name"]),
        "raw_import": each("imports").select(F.col("path").alias("src"), "language", F.col("x").alias("module")).distinct(),
        "binding": each("bindings").select("path", "x.*").distinct(), "raw_call": each("calls").select("path", "x.*"), "variable": each("variables").select("path", "x.*"), "flows_to": each("flows").select("x.*").distinct()}


#: What a relative import may leave out, in the order in which it is tried.
LEFT_OUT = ("", ".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.tsx", "/index.js", "/index.jsx")


def relative_imports(raw: DataFrame, files: DataFrame) -> DataFrame:
    """(src, dst) of imports like ./b and ../c/d: the first of the paths that the importing file's folder and LEFT_OUT make and that is known.

    A path that leaves the root, and a package's name, resolve to nothing.
    """
    steps = F.split(F.concat(F.regexp_replace("src", r"[^/]*$", ""), "module"), "/")
    # ".." takes the folder before it away; one too many makes the path null
    walked = F.aggregate(F.filter(steps, lambda x: ~x.isin("", ".")), F.array().cast("array<string>"), lambda path, x: F.when(x != "..", F.concat(path, F.array(x))).when(F.size(path) > 0, F.slice(path, 1, F.size(path) - 1)))
    tried = raw.where("language = 'typescript' AND module LIKE '.%'").select("src", "module", F.array_join(walked, "/").alias("base")).select(
        "src", "module", F.posexplode(F.array(*[F.concat("base", F.lit(x)) for x in LEFT_OUT])).alias("pos", "path"))
    return tried.join(files.select("path"), "path").groupBy("src", "module").agg(F.min_by("path", "pos").alias("dst")).select("src", "dst")


def resolve(parts: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Adds imports (file to file), calls (symbol to symbol) and the flows between scopes.

    A call's candidates are, in order of preference: what an import binds its qualifier to, a symbol nested in the
    caller or a scope around it, one of the caller's file, one of an imported file, and outside Python one anywhere. The first
    kind with any candidate decides; several candidates of it, or a shadowed name, give no edge.
    """
    parts = parts | {"symbol": materialise(parts["symbol"], "symbols")}
    modules = parts["file"].select(F.col("path").alias("dst"), F.regexp_replace(F.regexp_replace(F.regexp_replace("path", r"\.(py|pyi|ts|tsx|js|jsx|go|rs|java|ps1|psm1)$", ""), r"(^|/)src/", "$1"), "/", ".").alias("module"))
    modules = modules.select("dst", F.regexp_replace("module", r"\.__init__$", "").alias("module"))
    dotted = parts["raw_import"].where("language <> 'typescript'").join(modules, "module").select("src", "dst")
    imports = dotted.union(relative_imports(parts["raw_import"], parts["file"])).where("src <> dst").distinct()
    calls = materialise(parts["raw_call"].withColumn("call_id", F.xxhash64("path", "caller_qname", "callee_qualifier", "line_number")), "raw-calls")
    named = parts["symbol"].select(F.col("name").alias("callee_name"), F.col("qualified_name").alias("target"), F.col("file_path").alias("to_path"))
    open_calls = calls.where("NOT shadowed").select("call_id", "path", "caller_qname", "callee_name")
    at_home = open_calls.join(named, (open_calls["callee_name"] == named["callee_name"]) & (open_calls["path"] == named["to_path"])).select(
        "call_id", "target", F.when(F.col("target") == F.concat("caller_qname", F.lit("."), open_calls["callee_name"]), 0).when(F.startswith("caller_qname", F.concat(F.regexp_replace("target", r"\.[^.]*$", ""), F.lit("."))), 1).otherwise(2).alias("tier"))
    via = open_calls.join(imports.select(F.col("src").alias("path"), F.col("dst").alias("to_path")), "path").join(named, ["callee_name", "to_path"]).select("call_id", "target", F.lit(3).alias("tier"))
    first, rest = F.substring_index("callee_qualifier", ".", 1), F.regexp_extract("callee_qualifier", r"^[^.]*(.*)$", 1)
    bound = calls.where("NOT shadowed").select("call_id", "path", "caller_qname", first.alias("name"), rest.alias("rest")).join(parts["binding"], ["path", "name"]).where(
        (F.col("caller_qname") == F.col("scope_qname")) | F.startswith("caller_qname", F.concat("scope_qname", F.lit("."))))
    through = bound.select("call_id", F.concat("target", "rest").alias("target")).join(parts["symbol"].select(F.col("qualified_name").alias("target")), "target").select("call_id", "target", F.lit(-1).alias("tier"))
    lone = named.groupBy("callee_name").agg(F.count(F.lit(1)).alias("n"), F.min("target").alias("target")).where("n = 1")
    anywhere = open_calls.where(~F.col("path").rlike(r"\.pyi?$")).join(lone, "callee_name").select("call_id", "target", F.lit(4).alias("tier"))
    tiers = at_home.union(via).union(anywhere).union(through).groupBy("call_id", "tier").agg(F.countDistinct("target").alias("n"), F.min("target").alias("target"))
    best = tiers.groupBy("call_id").agg(F.min_by(F.struct("n", "target"), "tier").alias("b")).where("b.n = 1").select("call_id", F.col("b.target").alias("callee"))
    linked = calls.join(best, "call_id")
    between = cross_flows(linked.join(parts["symbol"].select(F.col("qualified_name").alias("callee"), F.col("symbol_type").alias("callee_type"), "parameters"), "callee"))
    return parts | {"imports": imports, "calls": linked.select(F.col("caller_qname").alias("src"), F.col("callee").alias("dst")).distinct(), "flows_to": parts["flows_to"].unionByName(between).distinct()}


def cross_flows(linked: DataFrame) -> DataFrame:
    """argument and call_return flows of resolved calls (caller_qname, callee, callee_type, arguments, parameters, result_var_qname), at line 0.

    Arguments in order take the places of the callee's parameters, further ones its list of the rest; named arguments take
    the parameter of that name, others its dictionary of the rest. A method's receiver takes no argument. A call that unpacks, or
    that doesn't fit the parameters, gives no argument flow.
    """
    named = lambda xs: F.transform(xs, lambda p: p["name"])
    of = lambda xs, *kinds: F.filter(xs, lambda p: p["kind"].isin(*kinds))
    receiver = F.endswith("callee_type", F.lit("method")) & F.coalesce(F.get("parameters", 0)["name"].isin("self", "cls"), F.lit(False))
    shaped = linked.withColumn("own", F.when(receiver, F.slice("parameters", 2, F.size("parameters"))).otherwise(F.col("parameters"))).withColumns({
        "in_order": F.filter("arguments", lambda a: a["keyword"].isNull()), "by_name": F.filter("arguments", lambda a: a["keyword"].isNotNull()),
        "places": named(of("own", "positional_only", "positional_or_keyword")), "rest": F.get(named(of("own", "var_positional")), 0), "others": F.get(named(of("own", "var_keyword")), 0),
        "required": named(F.filter("own", lambda p: ~p["has_default"] & p["kind"].isin("positional_only", "positional_or_keyword", "keyword_only")))})
    taken = shaped.withColumn("taken", F.slice("places", 1, F.size("in_order"))).withColumn("open", F.array_except(named(of("own", "positional_or_keyword", "keyword_only")), F.col("taken")))
    keyword = lambda a: F.when(F.array_contains("open", a["keyword"]), a["keyword"]).when(~F.array_contains("taken", a["keyword"]), F.col("others"))
    pair = lambda a, to: F.struct(a["dependencies"].alias("dependencies"), to.alias("to"))
    slots = F.concat(F.transform("in_order", lambda a, i: pair(a, F.coalesce(F.get("places", i), F.col("rest")))), F.transform("by_name", lambda a: pair(a, keyword(a))))
    names = F.transform("by_name", lambda a: a["keyword"])
    fits = (F.col("own").isNotNull() & ~F.exists("arguments", lambda a: a["unpacked"]) & F.forall("slots", lambda x: x["to"].isNotNull())
            & (F.size(F.array_except("required", F.concat("taken", names))) == 0) & (F.size(names) == F.size(F.array_distinct(names))))
    bound = taken.withColumn("slots", slots).where(fits).select("caller_qname", "callee", F.explode("slots").alias("x")).select("caller_qname", "callee", F.explode("x.dependencies").alias("src"), F.col("x.to").alias("to"))
    passed = bound.select("src", F.concat("callee", F.lit(":"), "to").alias("dst"), F.col("caller_qname").alias("scope_qname"), F.lit(0).alias("line_number"), F.lit("argument").alias("flow_type"))
    returned = linked.where("result_var_qname IS NOT NULL").select(F.concat("callee", F.lit(":__return__")).alias("src"), F.col("result_var_qname").alias("dst"), F.col("caller_qname").alias("scope_qname"),
                                                                   F.lit(0).alias("line_number"), F.lit("call_return").alias("flow_type"))
    return passed.union(returned).distinct()
