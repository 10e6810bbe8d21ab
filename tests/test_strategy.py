from cairn.plans import router

SYMBOLS = "qualified_name string, name string, symbol_type string, file_path string, line_start int, line_end int"


def tables(spark, n):
    symbols = spark.createDataFrame([(f"m.load{i}", f"load{i}", "function", "a.py", i + 1, i + 1) for i in range(n)], SYMBOLS)
    files = spark.createDataFrame([("a.py", "python"), ("b.py", "python")], "path string, language string")
    calls = spark.createDataFrame([(f"m.load{i}", f"x.y{j}") for i in range(n) for j in range(3)], "src string, dst string")
    texts = spark.createDataFrame([("a.py", "\n".join(f"def load{i}(): pass" for i in range(12))), ("b.py", "x\ny\nz\nq\nNEEDLE here\nlast"), ("c.py", None), ("d.py", "")], "path string, text string")
    return symbols, files, calls, texts


def test_enough_good_hits_need_no_fallback(spark):
    rows, decision = router.strategy_bundle(*tables(spark, 4), "load", 4000)
    assert decision == {"quality": 0.87, "items": 4, "matched": 4, "reason": "graph_context_sufficient", "fallback": False}
    assert [r["source"] for r in rows.collect()] == ["graph"] * 4


def test_few_hits_bring_their_code(spark):
    rows, decision = router.strategy_bundle(*tables(spark, 2), "load", 4000)
    got = sorted(rows.collect(), key=lambda r: (r["source"], r["place"]))
    assert decision["reason"] == "insufficient_graph_hits" and [r["source"] for r in got] == ["graph", "graph", "symbol-snippet", "symbol-snippet"]
    assert got[2]["snippet"] == "\n".join(f"def load{i}(): pass" for i in range(4)) and got[3]["snippet"].endswith("load4(): pass")
    assert got[3]["used"] > got[2]["used"] > got[1]["used"]
    spent = got[1]["used"]
    assert router.strategy_bundle(*tables(spark, 2), "load", spent)[0].count() == 2  # nothing is left for code


def test_no_hits_search_all_texts(spark):
    rows, decision = router.strategy_bundle(*tables(spark, 2), " needle ", 4000)
    got = rows.collect()
    assert decision["quality"] == 0.0 and [(r["source"], r["file_path"], r["line_start"], r["line_end"], r["snippet"]) for r in got] == [("keyword-fallback", "b.py", 5, 6, "y\nz\nq\nNEEDLE here\nlast")]
    assert router.strategy_bundle(*tables(spark, 2), "absent", 4000)[0].count() == 0
    assert router.keyword_snippets(tables(spark, 1)[3], "  ", 3).count() == 0
