import math
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from cairn.operators import search


def ranks(spark, query, texts, all_docs=False):
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    hits = search.found(search.postings(docs, "id", F.col("text")), "id", query, docs if all_docs else None)
    return {r["id"]: r["rank"] for r in hits.collect()}


TEXTS = ["The quick brown fox", "quick the fox, brown", "brown-fox quick; QUICK!", "nothing here", "", None, "fox " * 400, "quick brown dog or not"]


@pytest.mark.parametrize("query, want", [
    ("quick fox", {0, 1, 2}), ('"quick brown"', {0, 7}), ('"brown fox"', {0, 2}), ("quick -fox", {7}), ('dog OR "quick the"', {1, 7}), ('"or not"', {7}), ("or fox or", {0, 1, 2, 6}),
    ("absent", set()), ('fox -"brown fox"', {1, 6}), ('"Quick', {0, 1, 2, 7}), ("dog or nothing here", {3, 7}), ("", set()), ("!! --", set())])
def test_matches(spark, query, want):
    assert set(ranks(spark, query, TEXTS)) == want


def test_exclusions_alone_need_all_documents(spark):
    assert ranks(spark, "-fox", TEXTS, True) == dict.fromkeys((3, 4, 5, 7), 0.0)
    with pytest.raises(ValueError):
        ranks(spark, "-fox", TEXTS)


def test_rank_of_words_that_are_all_wanted(spark):
    """Nearer words rank higher; the value is that of independent chances over all pairs of places."""
    got = ranks(spark, "a b", ["a b", "a x x x b", "b a b"])
    near = lambda d: 0.1 * math.sqrt(1 / (1.005 + 0.05 * math.exp(d / 1.5 - 2)))
    assert got[0] == pytest.approx(near(1)) and got[1] == pytest.approx(near(4)) and got[2] == pytest.approx(1 - (1 - near(1)) ** 2)
    assert got[2] > got[0] > got[1]


def test_rank_of_alternatives(spark):
    got = ranks(spark, "fox or dog", TEXTS)
    assert got[6] == pytest.approx(sum(0.1 / j ** 2 for j in range(1, 257)) / 1.64493406685 / 2) and got[7] == pytest.approx(0.1 / 1.64493406685 / 2)


def test_stored_index_reads_only_its_terms(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    search.write_index(docs, "doc_id", F.col("text"), f"{tmp_path}/index", 4)
    stored = spark.read.parquet(f"{tmp_path}/index")
    hits = search.found(stored, "doc_id", 'the "of the" -und')
    assert "In(term, [of,the,und])" in hits._jdf.queryExecution().executedPlan().toString()
    fresh = search.found(search.postings(docs, "doc_id", F.col("text")), "doc_id", 'the "of the" -und')
    assert sorted(map(tuple, hits.collect())) == sorted(map(tuple, fresh.collect())) != []


def test_activities_are_searched_by_project(spark):
    rows = [("a1", "p", "Fix login", "of the portal", ["auth"], 1, "i1"), ("a2", "p", "Login", None, ["fix"], 2, "i2"), ("a3", "q", "fix login", "", [], 3, "i3"), ("a4", "p", "100% done_now", "", None, 4, "i4")]
    acts = spark.createDataFrame(rows, "activity_id string, project_id string, title string, summary string, tags array<string>, occurred_at int, source_item_id string")
    assert [r["activity_id"] for r in search.search_activities(acts, "p", "fix login").collect()] == ["a2", "a1"]  # equally near, the latest first
    assert [r["activity_id"] for r in search.search_activities(acts, "p", "login", 1).collect()] == ["a2"]  # equal ranks: the latest
    assert [r["activity_id"] for r in search.search_literal(acts, "p", "0% DONE_").collect()] == ["a4"] and search.search_literal(acts, "p", "0%_d").count() == 0


def test_places_are_a_total_order(spark):
    df = spark.createDataFrame([(i, 0.5 if i % 2 else 0.25) for i in range(10)], "id long, rank double")
    assert [r["id"] for r in search.first(df, 4, F.desc("id")).collect()] == [9, 7, 5, 3]
    assert all(a != b for a, b in combinations([r["place"] for r in search.first(df, 10, F.desc("id")).collect()], 2))
