from cairn.extract import patterns, python_source, tables

TWO = """import os
from a.b import c

def normalize(raw):
    value = raw.strip()
    return value

def render(input_text):
    clean = normalize(input_text)
    return [clean for clean in clean]
"""


def test_two_functions():
    got = python_source.extract("src/pkg/m.py", TWO)
    assert [(s["qualified_name"], s["symbol_type"], s["line_start"], s["line_end"]) for s in got["symbols"]] == [("pkg.m.normalize", "function", 4, 6), ("pkg.m.render", "function", 8, 10)]
    assert got["imports"] == ["os", "a.b"]
    assert {(f["src"].split(":")[1], f["dst"].split(":")[1], f["flow_type"]) for f in got["flows"]} == {("raw", "value", "assignment"), ("value", "__return__", "return"),
                                                                                                     ("normalize", "clean", "assignment"), ("input_text", "clean", "assignment"), ("clean", "__return__", "return")}
    roles = {v["qualified_name"]: v["role"] for v in got["variables"]}
    assert roles["pkg.m.normalize:raw"] == "parameter" and roles["pkg.m.normalize:__return__"] == "return"
    call = next(c for c in got["calls"] if c["callee_name"] == "normalize")
    assert call["arguments"] == [{"dependencies": ["pkg.m.render:input_text"], "position": 0, "keyword": None, "unpacked": False}] and call["result_var_qname"] == "pkg.m.render:clean"


def test_scopes():
    got = python_source.extract("m.py", "class A:\n    async def f(self, x):\n        def g():\n            nonlocal x\n            x = x + 1\n            return [y(y) for y in x]\n        return g\n")
    assert {s["qualified_name"]: s["symbol_type"] for s in got["symbols"]} == {"m.A": "class", "m.A.f": "async_method", "m.A.f.g": "function"}
    assert {v["qualified_name"] for v in got["variables"]} >= {"m.A.f:x"} and "m.A.f.g:x" not in {v["qualified_name"] for v in got["variables"]}
    assert next(c for c in got["calls"] if c["callee_name"] == "y")["shadowed"]


def test_bindings(spark):
    got = python_source.extract("src/pkg/sub/m.py", "import a.b\nimport c.d as e\nfrom ..x import y as z\nfrom . import w\n")
    assert {(b["name"], b["target"]) for b in got["bindings"]} == {("a", "a"), ("e", "c.d"), ("z", "pkg.x.y"), ("w", "pkg.sub.w")} and got["imports"] == ["a.b", "c.d", "pkg.x", "pkg.sub"]
    files = spark.createDataFrame([("u.py", "def go(): pass\n"), ("v.py", "def go(): pass\n"), ("w.py", "from v import go as run\nimport u\n\ndef f():\n    run()\n\ndef g():\n    u.go()\n\ndef h(u):\n    other.go()\n")], "path string, text string")
    calls = tables.resolve(tables.tables(tables.evidence(files)))["calls"]
    assert {tuple(r) for r in calls.collect()} == {("w.f", "v.go"), ("w.g", "u.go")}


def test_bad_files():
    assert python_source.extract("m.py", "def (")["error"]
    assert python_source.extract("m.py", "")["symbols"] == []


def test_patterns():
    ts = patterns.extract("src/a.ts", "import {x} from './b'\nexport class A {\n  run(n) {\n    helper(n)\n  }\n}\nconst go = (y) => {\n  A.run(y)\n}\n", "typescript")
    assert {(s["qualified_name"], s["symbol_type"], s["line_end"]) for s in ts["symbols"]} == {("a.A", "class", 6), ("a.A.run", "method", 5), ("a.go", "arrow", 9)}
    assert ts["imports"] == ["./b"] and {(c["caller_qname"], c["callee_qualifier"]) for c in ts["calls"]} == {("a.A.run", "helper"), ("a.go", "A.run")}
    go = patterns.extract("m.go", 'package m\nimport "fmt"\nfunc (s *T) Do(a int) {\n\tfmt.Println(a)\n}\n', "go")
    assert go["symbols"][0]["symbol_type"] == "method" and go["imports"] == ["fmt"] and go["calls"][0]["callee_qualifier"] == "fmt.Println"
    rust = patterns.extract("m.rs", "use std::fs;\npub fn f(a: u8) -> u8 {\n  g(a)\n}\n", "rust")
    assert rust["imports"] == ["std::fs"] and rust["calls"][0]["callee_name"] == "g"
    java = patterns.extract("M.java", "import a.B;\npublic class M {\n  public int f(int x) {\n    return g(x);\n  }\n}\n", "java")
    assert [s["symbol_type"] for s in java["symbols"]] == ["class", "method"] and java["calls"][0]["callee_name"] == "g"
    ps = patterns.extract("m.ps1", "function Get-It {\n  Write-Out('x')\n}\n", "powershell")
    assert ps["symbols"][0]["name"] == "Get-It"
    assert patterns.extract("m.vb", "Public Class A\nSub B()\nEnd Sub\nEnd Class", "vb")["symbols"][1]["line_end"] == 3
    assert patterns.language_of("x/CMakeLists.txt") == "cmake" and patterns.language_of("a.unknown") is None


def test_binding(spark):
    own = lambda *ps: [{"name": n, "kind": k, "has_default": d} for n, k, d in ps]
    p = own(("a", "positional_or_keyword", False), ("rest", "var_positional", False), ("k", "keyword_only", True))
    q = own(("self", "positional_or_keyword", False), ("a", "positional_or_keyword", False), ("more", "var_keyword", False))
    arg = lambda d, pos=None, kw=None, un=False: {"dependencies": [d], "position": pos, "keyword": kw, "unpacked": un}
    shape = """case int, arguments array<struct<dependencies:array<string>,position:int,keyword:string,unpacked:boolean>>, parameters array<struct<name:string,kind:string,has_default:boolean>>,
        caller_qname string, callee string, callee_type string, result_var_qname string"""
    cases = [([arg("x", 0), arg("y", 1), arg("z", None, "k")], p, "function", {("x", "a"), ("y", "rest"), ("z", "k")}), ([arg("x", 0, None, True)], p, "function", set()), ([], p, "function", set()),
             ([arg("x", 0)], None, "function", set()), ([arg("x", 0), arg("y", None, "a")], p, "function", set()), ([arg("x", 0), arg("y", None, "none")], p, "function", set()),
             ([arg("x", 0), arg("y", None, "b")], q, "method", {("x", "a"), ("y", "more")}), ([arg("o", 0), arg("x", 1)], q, "function", {("o", "self"), ("x", "a")}), ([arg("x", 0), arg("y", 1)], q, "async_method", set())]
    rows = spark.createDataFrame([(i, a, ps, f"caller{i}", "f", t, None) for i, (a, ps, t, _) in enumerate(cases)], shape)
    got = {}
    for r in tables.cross_flows(rows).collect():
        got.setdefault(r["scope_qname"], set()).add((r["src"], r["dst"].removeprefix("f:")))
    assert [got.get(f"caller{i}", set()) for i in range(len(cases))] == [want for *_, want in cases]


def test_relative_imports(spark):
    files = spark.createDataFrame([("src/a/m.ts", "import {x} from './b'\nimport y from '../c'\nimport z from 'lib'\nimport w from '../../../up'\n"), ("src/a/b.ts", "export const x = 1\n"), ("src/c/index.js", ""), ("up.ts", "")], "path string, text string")
    got = tables.resolve(tables.tables(tables.evidence(files)))["imports"]
    assert {tuple(r) for r in got.collect()} == {("src/a/m.ts", "src/a/b.ts"), ("src/a/m.ts", "src/c/index.js")}


def test_declarations_by_grammar():
    kinds = lambda text, language: [(s["name"], s["symbol_type"]) for s in patterns.extract("m", text, language)["symbols"]]
    assert kinds("export default class A {\n}\nexport const go = async (y: T) => {\n}\nexport async function* gen(a) {\n}\nexport type U<X> = string\nconst enum E { A }\ndeclare function g(): void;\n", "typescript") == [
        ("A", "class"), ("go", "arrow"), ("gen", "function"), ("U", "type"), ("E", "enum"), ("g", "function")]
    assert kinds("module 0x1::m {\n public entry fun go() {}\n public(friend) fun h() {}\n struct S has key {}\n}", "move") == [("0x1::m", "module"), ("go", "function"), ("h", "function"), ("S", "struct")]
    assert kinds("pub fn a() {}\nfn b() {}\npub(crate) struct C {}", "cairo") == [("a", "function"), ("b", "function"), ("C", "struct")]
    assert kinds("(define-public (go (a int)) x)\n(define-read-only (g) 1)\n(define-data-var v int 0)", "clarity") == [("go", "function"), ("g", "function"), ("v", "constant")]
    assert kinds("access(all) contract interface C {\n pub fun f() {}\n access(self) view fun g() {}\n}", "cadence") == [("C", "contract"), ("f", "function"), ("g", "function")]


def test_tables(spark):
    files = spark.createDataFrame([("src/m.py", TWO), ("src/n.py", "from m import render\n\ndef go(q):\n    return render(q)\n"), ("x.bin", "?"), ("bad.py", "def (")], "path string, text string")
    got = tables.resolve(tables.tables(tables.evidence(files)))
    assert {tuple(r) for r in got["calls"].collect()} == {("m.render", "m.normalize"), ("n.go", "m.render")}
    assert {tuple(r) for r in got["imports"].collect()} == {("src/n.py", "src/m.py")}
    flows = {(r["src"], r["dst"], r["flow_type"]) for r in got["flows_to"].collect()}
    assert ("n.go:q", "m.render:input_text", "argument") in flows and ("m.normalize:__return__", "m.render:clean", "call_return") in flows


def test_files_are_dealt_and_parsed_once(spark, tmp_path):
    seen = str(tmp_path)

    def noted(batches):
        import uuid

        for batch in batches:
            with open(f"{seen}/{uuid.uuid4().hex}", "w") as f:
                f.write("\n".join(batch["path"]))
            yield batch

    files = spark.range(0, 400, 1, 1).selectExpr("concat('m', id, '.py') AS path", "concat('from m', id + 1, ' import f', id + 1, '\\n\\ndef f', id, '(a):\\n    return f', id + 1, '(a)\\n') AS text")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert tables.evidence(files).rdd.glom().map(len).filter(lambda n: n > 0).count() == parts
    got = tables.linked(files.mapInPandas(noted, files.schema))
    assert {tuple(r) for r in got["calls"].collect()} == {(f"m{i}.f{i}", f"m{i + 1}.f{i + 1}") for i in range(399)}
    assert got["flows_to"].where("flow_type = 'argument'").count() == 399
    read = [line for f in tmp_path.iterdir() for line in f.read_text().splitlines()]
    assert len(read) == 400 and len(set(read)) == 400
