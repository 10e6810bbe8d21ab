from pathlib import Path

import pytest
from pyspark.sql import functions as F
from test_sources import Tables

from cairn.sources import generations, parted_graph


@pytest.fixture
def graph(spark, tmp_path):
    return Tables(spark), parted_graph.create(spark, f"file://{tmp_path}/g", Tables(spark), 8)


def plain(df):
    return sorted(map(str, df.collect()))


def test_what_was_created(graph):
    tables, made = graph
    assert all(plain(made[name]) == plain(tables[name]) for name in tables)


def test_a_file_takes_all_that_hangs_on_it(spark, graph):
    tables, made = graph
    before = {name: dict(made.folders(name)) for name in tables}
    touched = made.delete_files(spark.createDataFrame([("f1",), ("absent",)], "path string"))
    after = parted_graph.PartedGraph(spark, made.root)
    symbols = {f"s{i}" for i in range(1, 40, 2)}
    assert {r["path"] for r in after["file"].collect()} == {"f2"} and {r["qualified_name"] for r in after["symbol"].collect()} == symbols
    assert after["variable"].count() == after["flows_to"].count() == after["uses_variable"].count() == after["imports"].count() == 0 and after["repository"].count() == 1
    assert plain(after["calls"]) == plain(tables["calls"].where(F.col("src").isin(*symbols) & F.col("dst").isin(*symbols | {"gone"}))) and plain(after["contains"]) == ["Row(src='r', dst='f2')"]
    # untouched parts keep their folders, and a reader of the graph before still has all of it
    for name in tables:
        assert {p: at for p, at in after.folders(name).items() if p not in touched[name]} == {p: at for p, at in before[name].items() if p not in touched[name]}
        assert plain(made[name]) == plain(tables[name])
    assert touched["repository"] == [] and len(touched["file"]) == 1 and all(Path(f"{made.root}/{n}/{at}".removeprefix("file://")).is_dir() for n in tables for at in after.folders(n).values())


def test_a_lost_writer_changes_nothing(spark, graph, monkeypatch):
    tables, made = graph
    with monkeypatch.context() as m:
        m.setattr(generations, "_claim", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            made.delete_files(spark.createDataFrame([("f1",)], "path string"))
    now = parted_graph.PartedGraph(spark, made.root)
    assert now.text == made.text and all(plain(now[name]) == plain(tables[name]) for name in tables)


def test_two_writers(spark, graph):
    _, made = graph
    made.delete_files(spark.createDataFrame([("f1",)], "path string"))
    with pytest.raises(RuntimeError, match="changed"):
        made.delete_files(spark.createDataFrame([("f2",)], "path string"))
