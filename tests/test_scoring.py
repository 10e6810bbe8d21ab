from pyspark.sql import functions as F

from cairn.functions import scalars as X
from cairn.operators import expansion as K
from cairn.operators import scoring as E
from cairn.operators import windows as W


def test_pressure_of_published_case(spark):
    schema = "case_id int, mode string, pos int, text string, useful boolean, evidence array<string>, syms array<string>"
    dup = "d" * 324
    chunks = spark.createDataFrame([(1, "baseline", 0, "u" * 124, False, ["g1"], ["a:run"]), (1, "baseline", 1, dup, False, [], ["b:run"]), (1, "baseline", 2, dup, False, [], []),
                                    (1, "scoped", 0, "x" * 164, False, ["g1", "g2"], ["m:run"]), (1, "scoped", 1, "y" * 164, False, [], [])], schema)
    gold = spark.createDataFrame([(1, ["g1", "g2"])], "case_id int, gold array<string>")
    targets = spark.createDataFrame([(1, ["m:run"])], "case_id int, targets array<string>")
    scores = E.pressure(chunks, gold, targets)
    got = {r["mode"]: r for r in scores.collect()}
    b, s = got["baseline"], got["scoped"]
    assert (b["tokens"], b["useful_tokens"], b["duplicate_tokens"], b["coverage"], b["noise"], b["redundancy"], b["ambiguity"], b["score"]) == (193, 31, 81, 0.5, 0.8394, 0.4197, 1.0, 66.08)
    assert (s["tokens"], s["coverage"], s["noise"], s["ambiguous_hits"], s["symbol_hits"], s["score"]) == (82, 1.0, 0.5, 0, 1, 17.5)
    c = E.compared(scores).first()
    assert (c["token_reduction"], c["score_reduction"], c["coverage_delta"], c["precision_delta"]) == (57.51, 73.52, 0.5, 0.3394)


def test_facts_match_whole_words_in_any_inflection(spark):
    df = spark.createDataFrame([("It  CALLED parse(x)", "call"), ("recalls it", "call"), ("a\\b c", "a/b"), ("flows_to", "flow"), ("f(x)", "f(x)"), ("foo_f(x)", "f(x)")], "a string, f string")
    assert [r[0] for r in df.select(E.has_fact(F.col("a"), F.col("f"))).collect()] == [True, False, True, True, True, False]


def test_ratios_over_nothing(spark):
    df = spark.createDataFrame([(1, "yes", [], [], [], [])], "id int, answer string, facts array<string>, citations array<string>, gold array<string>, evidence array<string>")
    assert E.answers(df).first()["passed"] is True
    assert df.select(E.ratio(F.lit(1), F.lit(0))).first()[0] == 0.0


def test_calibration(spark):
    df = spark.createDataFrame([(10.0, True), (20.0, True), (30.0, False), (40.0, False)], "score double, passed boolean")
    assert tuple(E.calibrate(df).first())[:2] == (20.0, 1.0)
    worst = spark.createDataFrame([(5.0, False)], "score double, passed boolean")
    assert E.calibrate(worst).first()["threshold"] == 4.99
    assert E.calibrate(df.where("false")).count() == 0


def test_greedy_expansion_passes_over_what_does_not_fit(spark):
    df = spark.createDataFrame([(1, 0, 0, 50), (1, 0, 1, 80), (1, 1, 2, 40)], "case_id int, depth int, pos int, tokens int")
    assert {r["pos"] for r in K.accepted(df, 5, 100).collect()} == {0, 2}


def test_budget_prefix_stops_at_first_overflow(spark):
    df = spark.createDataFrame([(1, 1, 50), (1, 2, 80), (1, 3, 40)], "k int, pos int, tokens int")
    assert [r["pos"] for r in W.budget_prefix(df, "k", ["pos"], F.col("tokens"), 100).collect()] == [1]


def test_scalars(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(X.tokens_simple(F.lit(""))) == 0 and one(X.tokens_simple(F.lit("abc"))) == 1 and one(X.tokens_simple(F.lit("a" * 9))) == 2
    assert one(X.tokens_mixed(F.lit("abcd"))) == 1 and one(X.tokens_mixed(F.lit("漢字漢字"))) == 3
    assert one(X.module_of(F.lit("src/pkg/src/mod.py"))) == "pkg.mod"
    assert one(X.safe_url(F.lit("https://u:p@h.org/a?b#c"))) == "https://h.org/a" and one(X.safe_url(F.lit("ftp://x"))) is None
    assert one(X.slug(F.lit(" A  b! "))) == "a-b" and one(X.fnv1a(F.lit("a"))) == 0xE40C292C and one(X.fnv1a(F.lit(""))) == 0x811C9DC5
    assert one(E.simple_name(F.lit("a::b:c.d"))) == "d" and one(X.widened(F.lit("/a/b"), F.lit("/a"))) is True
    assert one(X.snippet(F.lit("1\n2\n3\n4\n5"), F.lit(3), F.lit(3), 1)) == "2\n3\n4"


def test_uuid5(spark):
    import uuid

    for name in ("a", "ключ", ""):
        assert spark.range(1).select(X.uuid5(F.lit(name))).first()[0] == str(uuid.uuid5(uuid.NAMESPACE_DNS, name))


def test_cache():
    from cairn.plans.cache import ResultCache

    now, made = [0.0], []
    cache = ResultCache(60, 2, lambda: now[0])
    get = lambda g: cache.get(cache.key("t", {"b": 1, "a": 2}, "g", "p", g), lambda: made.append(g) or g)
    assert get("1") == get("1") == "1" and made == ["1"]
    assert get("2") == "2" and made == ["1", "2"]
    now[0] = 61
    get("1")
    get("3")
    get("2")
    assert made == ["1", "2", "1", "3", "2"] and len(cache.held) == 2 and cache.clear() == 2


def test_expansion_traces_equal_a_plain_fold(spark):
    """Every candidate in order, over many rounds of a block; equal places, null tokens and a case of a third of all rows too."""
    import random

    rng = random.Random(9)
    rows = [(0 if rng.random() < 0.3 else rng.randrange(12), rng.randrange(3), rng.randrange(200), rng.choice([None, 0, rng.randrange(900), rng.randrange(90)])) for _ in range(3000)]
    df = spark.createDataFrame(rows, "case_id long, depth int, pos int, tokens long")
    for chunks, tokens in ((40, 5000), (7, 300), (0, 100), (5, 0)):
        want = []
        for c in {r[0] for r in rows}:
            used = n = 0
            for d, p, t in sorted((d, p, t or 0) for x, d, p, t in rows if x == c):
                ok = n < chunks and used + t <= tokens
                want.append((c, d, p, t, n + 1 if ok else None, used + t if ok else None, K.ACCEPTED if ok else K.CHUNKS if n >= chunks else K.TOKENS))
                used, n = (used + t, n + 1) if ok else (used, n)
        assert sorted(map(tuple, K.trace(df, chunks, tokens).collect()), key=repr) == sorted(want, key=repr)


def test_expansion_stops(spark):
    pool = spark.createDataFrame([(c, d, p, 10) for c in (1, 2, 3, 4) for d in (1, 2) for p in (0, 1)] + [(5, 1, 0, 999)], "case_id long, depth int, pos int, tokens long")
    cases = spark.createDataFrame([(c, c == 6, c not in (4, 6)) for c in range(1, 8)], "case_id long, passed boolean, triggered boolean")
    outcomes = spark.createDataFrame([(1, 1, True), (2, 1, False), (2, 2, True), (3, 1, False)], "case_id long, depth int, passed boolean")
    for chunks, depth, third in ((10, 2, "max_depth_reached"), (10, 3, "candidate_pool_exhausted"), (2, 3, "chunk_budget_exhausted"), (0, 3, "chunk_budget_exhausted")):
        got = {r["case_id"]: r for r in K.runs(cases, K.trace(pool, chunks, 100), outcomes, chunks, depth).collect()}
        assert got[3]["stop_reason"] == third and got[4]["stop_reason"] == "not_triggered" and got[7]["stop_reason"] == "no_expansion_candidates" and got[6]["passed_after"]
        assert got[5]["stop_reason"] == ("chunk_budget_exhausted" if chunks == 0 else "token_budget_exhausted")
        if chunks == 10:
            assert [(got[c]["attempts"], got[c]["added"], got[c]["final_depth"], got[c]["stop_reason"]) for c in (1, 2, 3)] == [(1, 2, 1, "answer_passed"), (2, 4, 2, "answer_passed"), (2, 4, 2, third)]
            one = K.summary(K.runs(cases, K.trace(pool, chunks, 100), outcomes, chunks, depth)).first()
            assert (one["cases"], one["triggered"], one["recovered"], one["still_failing"], one["reruns"], one["model_calls"]) == (7, 5, 2, 4, 5, 19)
