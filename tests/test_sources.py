import pytest

from cairn.plans import router
from cairn.sources import files, generations
from cairn.views import Graph


def test_discover(spark, tmp_path):
    for name, data in {"a.py": b"x = 1", "src/b.ts": b"let x", "node_modules/c.py": b"", ".git/d.py": b"", "e.txt": b"no", "bin.py": b"\x00", "bad.py": b"\xff\xfe"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    assert {(r["path"], r["language"]) for r in files.discover(spark, f"file://{tmp_path}").collect()} == {("a.py", "python"), ("src/b.ts", "typescript")}
    assert [r["path"] for r in files.discover(spark, f"file://{tmp_path}", ("typescript",)).collect()] == ["a.py"]


def test_status_changes(spark):
    lines = spark.createDataFrame([(0, " M a"), (1, "R  old -> new"), (2, " D gone"), (3, "?? fresh"), (4, " M a"), (5, "")], "pos int, value string")
    assert [(r["path"], r["change"]) for r in files.status_changes(lines).collect()] == [("old", "destructive"), ("gone", "destructive"), ("a", "changed"), ("new", "changed"), ("fresh", "changed")]


def test_query_batch(spark, tmp_path):
    (tmp_path / "q.jsonl").write_text('{"tool": "find_callers", "arguments": {"name": "x"}}\n\n{"query": "y"}\nnot json\n{"__line": 99, "query": "z"}\n')
    got = files.query_batch(spark, f"file://{tmp_path}/q.jsonl").collect()
    assert [(r["line"], r["tool"], r["valid"]) for r in got] == [(1, "find_callers", True), (3, "find_symbol", True), (4, None, False), (99, "find_symbol", True)]


def test_case_set_is_written_once(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('# note\n\n{"id": "a"}\n{"id": "b"}\n')
    cases = files.case_set(spark, f"file://{tmp_path}/c.jsonl", "id string")
    first = files.freeze(cases, f"file://{tmp_path}/out")
    import hashlib

    with pytest.raises(FileExistsError):
        files.freeze(cases, f"file://{tmp_path}/out")
    assert files.freeze(cases.orderBy("id"), f"file://{tmp_path}/out", True) == first == hashlib.sha256(b'{"id": "a"}\n{"id": "b"}\n').hexdigest()
    digest = lambda names: files.freeze(spark.createDataFrame([(n,) for n in names], "id string"), f"file://{tmp_path}/more", True)
    assert digest("aab") != digest("ccb")


def test_markdown(spark):
    df = spark.createDataFrame([("a.md", "---\nx: 1\n---\n# Title #\n\n- item\n\nFirst  para\nline two\n\nmore"), ("b.md", "# Only"), ("c.md", "password: hunter2"), ("d.md", "```\ncode\n```\n\n" + "w" * 500)], "path string, text string")
    got = {r["path"]: r for r in files.markdown_notes(df).collect()}
    assert (got["a.md"]["title"], got["a.md"]["summary"], got["a.md"]["reason"]) == ("Title", "First para line two", None)
    assert got["b.md"]["reason"] == "no summary paragraph" and got["c.md"]["reason"].startswith("possible credential")
    assert len(got["d.md"]["summary"]) == 400 and got["d.md"]["title"] == "d"


def test_batches(spark):
    items = spark.createDataFrame([("p", f"f{i}", 40, False) for i in range(5)] + [("p", "a", None, True)], "project string, path string, bytes long, tombstone boolean")
    got = {r["path"]: r["batch"] for r in files.plan_batches(items, 3, 100).collect()}
    assert got == {"f0": 0, "f1": 0, "f2": 1, "f3": 1, "f4": 2, "a": 2}
    sync = spark.createDataFrame([("ok", "f", "abc", "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad", 3, False), ("bad", "f", "abc", "0", 3, False)], "batch_id string, path string, content string, sha256 string, bytes long, tombstone boolean")
    assert {tuple(r) for r in files.batch_rejects(sync).collect()} == {("bad", "content does not match its digest")}


def test_reports(spark, tmp_path):
    df = spark.createDataFrame([("=1+1", 'say "x"'), ("plain", "-2")], "a string, b string")
    files.write_csv(df, f"file://{tmp_path}/r")
    text = "".join(p.read_text() for p in (tmp_path / "r").glob("*.csv"))
    assert "\"'=1+1\"" in text and '"say ""x"""' in text and "\"'-2\"" in text
    assert [r[0] for r in files.mermaid(spark.createDataFrame([("a.b", "c")], "src string, dst string")).collect()] == ["  a_b --> c"]


def test_lines_are_numbered_across_splits(spark, tmp_path):
    """Files of many splits, of one, and empty ones; lines longer than a split; the same numbers as a plain reader's."""
    import random

    rng = random.Random(3)
    (tmp_path / "in").mkdir()
    want = {}
    for name, n in (("a", 4000), ("b", 1), ("c", 0), ("d", 300)):
        lines = ["" if rng.random() < 0.1 else f"{name}{i} " + "x" * rng.choice([3, 50, 20_000 if i % 97 == 5 else 9]) for i in range(n)]
        (tmp_path / "in" / name).write_bytes(("\r\n" if name == "d" else "\n").join(lines).encode() + (b"\n" if name == "a" else b""))
        want |= {(name, i): x for i, x in enumerate(lines)}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16384")
    try:
        raw = files.numbered_lines(spark, f"file://{tmp_path}/in")
        got = {(r["file"].rsplit("/", 1)[1], r["pos"]): r["value"] for r in raw.collect()}
        assert spark.read.text(f"file://{tmp_path}/in").rdd.getNumPartitions() > 20
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == want


def test_files_that_change_while_they_are_read(spark, tmp_path, monkeypatch):
    """A file that is written between two reads is read again; one that never rests, and one that goes, are listed."""
    root = tmp_path / "src"
    (root / "deep").mkdir(parents=True)
    for name in ("still", "once", "always", "gone", "deep/still"):
        (root / name).write_text(f"first {name}")
    reads, read = [], files.read_files

    def disturbed(session, paths):
        reads.append(1)
        if len(reads) == 2:
            (root / "once").write_text("other once")
            (root / "gone").unlink()
        if len(reads) % 2 == 0:
            (root / "always").write_text(f"always {len(reads)}")
        return read(session, paths)

    monkeypatch.setattr(files, "read_files", disturbed)
    kept, rejects = files.snapshot(spark, [f"file://{root}"])
    got = {r["path"].rsplit("src/", 1)[1]: bytes(r["content"]).decode() for r in kept.collect()}
    assert got == {"still": "first still", "deep/still": "first deep/still", "once": "other once"} and len(reads) == 6
    assert {(r["path"].rsplit("/", 1)[1], r["reason"]) for r in rejects.collect()} == {("always", "changed")}
    once = files.torn(read(spark, [f"file://{root}"]), read(spark, [f"file://{root}"]))
    assert once.count() == 0


def test_torn_reads_are_told_apart(spark):
    row = lambda path, n, content: (path, n, 1, content, bytearray(content.encode()))
    schema = "path string, length long, modificationTime int, digest string, content binary"
    a = spark.createDataFrame([row("same", 2, "xy"), row("part", 9, "xy"), row("gone", 1, "x"), row("moved", 1, "x")], schema)
    b = spark.createDataFrame([row("same", 2, "xy"), row("part", 9, "xy"), row("new", 1, "x"), row("moved", 1, "z")], schema)
    assert {tuple(r) for r in files.torn(a, b).collect()} == {("part", "read in part"), ("gone", "gone"), ("new", "new"), ("moved", "changed")}


def test_generations(spark, tmp_path):
    root, one, two = f"file://{tmp_path}/g", spark.range(3), spark.range(5)
    assert generations.current(spark, root) is None
    first = generations.publish(spark, root, {"n": one}, None)
    pinned = generations.read(spark, root, "n")
    second = generations.publish(spark, root, {"n": two}, first)
    assert generations.current(spark, root) == second and pinned.count() == 3 and generations.read(spark, root, "n").count() == 5
    with pytest.raises(RuntimeError, match="changed"):
        generations.publish(spark, root, {"n": one}, first)
    generations.promote(spark, root, f"file://{tmp_path}/h", ["n"])
    assert generations.read(spark, f"file://{tmp_path}/h", "n").count() == 5
    generations.promote(spark, root, f"file://{tmp_path}/k", ["n"], drop_source=True)
    assert generations.read(spark, f"file://{tmp_path}/k", "n").count() == 5 and generations.current(spark, root) is None


@pytest.mark.parametrize("step", ["_claim", "_fill", "write"])
def test_a_writer_that_dies_leaves_the_generation_before(spark, tmp_path, monkeypatch, step):
    root = f"file://{tmp_path}/g"
    first = generations.publish(spark, root, {"n": spark.range(3)}, None)

    def dies(*_):
        raise OSError("lost")

    with monkeypatch.context() as m:
        tables = {"n": spark.range(5)}
        if step == "write":
            tables["o"] = spark.range(1).selectExpr("raise_error('lost') AS x")
        else:
            m.setattr(generations, step, dies)
        with pytest.raises(Exception, match="lost"):
            generations.publish(spark, root, tables, first)
    assert generations.current(spark, root) == first and generations.read(spark, root, "n").count() == 3
    second = generations.publish(spark, root, {"n": spark.range(7)}, first)
    assert generations.current(spark, root) == second and generations.read(spark, root, "n").count() == 7


def test_one_of_two_writers_wins(spark, tmp_path, monkeypatch):
    root, won = f"file://{tmp_path}/g", []
    first = generations.publish(spark, root, {"n": spark.range(3)}, None)
    claim = generations._claim

    def overtaken(*args):
        monkeypatch.setattr(generations, "_claim", claim)
        won.append(generations.publish(spark, root, {"n": spark.range(4)}, first))
        return claim(*args)

    monkeypatch.setattr(generations, "_claim", overtaken)
    with pytest.raises(RuntimeError, match="changed"):
        generations.publish(spark, root, {"n": spark.range(5)}, first)
    assert generations.current(spark, root) == won[0] and generations.read(spark, root, "n").count() == 4


class Tables(dict):
    """A small graph with a hub, a dangling call, and names of every relation."""

    def __init__(self, spark):
        make = lambda rows, schema: spark.createDataFrame(rows, schema)
        super().__init__(
            repository=make([("r", "repo")], "path string, name string"), file=make([("f1", "py", "r", "one"), ("f2", "js", "r", "two")], "path string, language string, repo string, name string"),
            symbol=make([(f"s{i}", f"n{i}", "function", f"f{i % 2 + 1}", i, i + 3) for i in range(40)], "qualified_name string, name string, symbol_type string, file_path string, line_start int, line_end int"),
            variable=make([("s0:a", "a", "s0", "f1", 3, "parameter", 0), ("s0:b", "b", "s0", "f1", 4, "return", None)],
                          "qualified_name string, name string, scope_qname string, file_path string, line_number int, role string, parameter_index int"),
            contains=make([("r", "f1"), ("r", "f2")], "src string, dst string"), defines=make([(f"f{i % 2 + 1}", f"s{i}") for i in range(40)], "src string, dst string"),
            imports=make([("f1", "f2")], "src string, dst string"), calls=make([(f"s{i}", "s0") for i in range(1, 40)] + [("s0", "s1"), ("s0", "gone"), ("s1", "s2")], "src string, dst string"),
            uses_variable=make([("s0", "s0:a"), ("s0", "s0:b")], "src string, dst string"),
            flows_to=make([("s0:a", "s0:b", "s0", 5, "return")], "src string, dst string, scope_qname string, line_number long, flow_type string"))

    def __getattr__(self, name):
        return self[name]


@pytest.fixture
def store(spark, tmp_path):
    from cairn.sources import edge_store

    tables = Tables(spark)
    edge_store.publish(spark, f"file://{tmp_path}/store", tables)
    return tables, edge_store.EdgeStore(spark, f"file://{tmp_path}/store")


def test_look_ups_in_the_store_equal_joins(store):
    from cairn.operators import graph, joins
    from cairn.sources import edge_store as B

    tables, made = store
    plain = lambda df: [tuple(r) for r in df.collect()]
    for name in ("s0", "s1", "absent"):
        assert plain(B.callers(made, name, 7)) == plain(joins.callers(tables.calls, tables.symbol, name, 7))
        assert plain(B.callees(made, name)) == plain(joins.callees(tables.calls, tables.symbol, name))
        assert sorted(plain(B.neighbourhood(made, name, flows=True))) == sorted(plain(graph.neighbourhood(tables.calls, tables.imports, tables.symbol, name, uses=tables.uses_variable, flows=tables.flows_to)))
    for relation, identity in (("contains", "r"), ("defines", "f1"), ("imports", "f1"), ("calls", "s0"), ("uses_variable", "s0"), ("flows_to", "s0:a")):
        for direction in ("outgoing", "incoming"):
            assert plain(B.relation(made, relation, identity, direction)) == plain(joins.relation(tables, relation, identity, direction))
    assert plain(B.file_imports(made, "f2", 3, True)) == [("f1", "py")]
    with pytest.raises(ValueError):
        B.relation(made, "calls", "", "outgoing")


def test_the_scan_of_a_look_up_has_its_filters(spark, store):
    from cairn.sources import edge_store as B

    _, made = store
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = B.callers(made, "s0")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(key," in plan and "EqualTo(relation,calls)" in plan and "EqualTo(here,s0)" in plan and "Join" not in plan and "Exchange" not in plan


def test_keys_are_not_shuffled_and_later_steps_are_look_ups(spark, store):
    from pyspark.sql import functions as F

    from cairn.sources import edge_store as B

    tables, made = store
    assert not {"key", "far_key"} & set(B.adjacency(tables).columns)
    rows = made.adjacency.select("key", B.key_of(F.col("here")).alias("want")).collect()
    assert rows and all(r["key"] == r["want"] for r in rows)
    begin = spark.createDataFrame([("s2",)], "node string")
    near = B.reach(made, "calls", F.lit("s2"), begin, 2)
    assert {(r["node"], r["depth"]) for r in near.collect()} == {("s2", 0), ("s0", 1), ("s1", 1), ("gone", 2), *((f"s{i}", 2) for i in range(3, 40))}
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    assert "In(key," in near._jdf.queryExecution().executedPlan().toString()


def test_the_store_follows_its_files(spark, tmp_path):
    import shutil

    from cairn.sources import edge_store as B
    from cairn.views import Graph

    for name in ("lineitem", "part", "supplier", "nation", "region", "events"):
        shutil.copy(f"/root/testdata/sf0.001/{name}.parquet", tmp_path / f"{name}.parquet")
    first = B.of(Graph(spark, str(tmp_path)))
    assert B.of(Graph(spark, str(tmp_path))) is first
    spark.read.parquet(str(tmp_path / "lineitem.parquet")).where("l_orderkey < 100").coalesce(1).write.parquet(str(tmp_path / "less"))
    shutil.copy(next((tmp_path / "less").glob("part-*")), tmp_path / "lineitem.parquet")
    spark.catalog.refreshByPath(str(tmp_path))
    second = B.of(Graph(spark, str(tmp_path)))
    assert second is not first and 0 < second.edges("calls").count() < first.edges("calls").count()


@pytest.mark.parametrize("mode,relation,direction,intent,evidence,plan", [
    ("auto", "calls", "incoming", "lookup", False, "callers"), ("auto", "calls", "incoming", "impact", False, "relation"), ("lightweight_first", "imports", "outgoing", "impact", False, "file_imports"),
    ("auto", "calls", "outgoing", "audit", False, "relation"), ("auto", "calls", "outgoing", "lookup", True, "relation"), ("evidence_first", "calls", "outgoing", "lookup", False, "relation"), ("auto", "flows_to", "outgoing", "lookup", False, "relation")])
def test_routing(mode, relation, direction, intent, evidence, plan):
    assert router.choose(mode, relation, direction, intent, evidence)[0] == plan


def test_budget_is_exact():
    rows = [{"name": "x" * 50, "n": i} for i in range(10)]
    whole = router.fitted(rows, 10, 10_000, {})
    assert whole["decision"]["bytes"] == router.size_of(whole) and whole["decision"]["returned"] == 10
    assert router.fitted(rows, 10, whole["decision"]["bytes"], {})["decision"]["returned"] == 10
    less = router.fitted(rows, 10, whole["decision"]["bytes"] - 1, {})
    assert less["decision"]["returned"] == 9 and less["decision"]["has_more"] and less["decision"]["bytes"] <= whole["decision"]["bytes"] - 1
    with pytest.raises(ValueError):
        router.fitted(rows, 10, 5, {})


def test_plans_agree(spark):
    g = Graph(spark, "/root/testdata/sf0.001")
    light, _ = router.plan(g, "calls", "p.3", "incoming", 20)
    full, _ = router.plan(g, "calls", "p.3", "incoming", 20, intent="audit")
    assert {r["qualified_name"] for r in light.collect()} == {r["source"] for r in full.collect()}
    assert router.strategy(g.symbol, g.file, g.calls, "ring", 200).count() > 0


def test_tables_in_the_shared_folder(spark):
    from pathlib import Path

    from cairn import shared

    shared.drop_made(spark)
    kept = shared.materialise(spark.range(5), "test")
    folder = Path(shared._made[0].removeprefix("file://"))
    assert kept.count() == 5 and folder.exists() and shared._made[0].startswith(shared.shared_dir(spark))
    assert shared.drop_made(spark) == 1 and not folder.exists()
