import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from cairn.operators import nested as N


def values(x, field):
    if isinstance(x, dict):
        return set().union(*({v} if k.lower() == field and isinstance(v, str) else values(v, field) for k, v in x.items()), set())
    return set().union(*(values(v, field) for v in x), set()) if isinstance(x, list) else set()


def tree(rng, depth):
    kind = rng.random()
    if depth == 0 or kind < 0.3:
        return rng.choice(["deny", "a \"quoted\" \\ é\n", 1, 2.5, None, True, "", "{\"effect\": \"inside a string\"}"])
    if kind < 0.6:
        return [tree(rng, depth - 1) for _ in range(rng.randrange(4))]
    return {rng.choice(["effect", "Effect", "if", "then", "effects"]): tree(rng, depth - 1) for _ in range(rng.randrange(4))}


def test_strings_at_any_depth(spark):
    rng = random.Random(8)
    texts = [json.dumps(tree(rng, 6)) for _ in range(150)] + ["not json", "", None, '{"effect": {"effect": ["x", {"EFFECT": "y"}]}}', '"effect"']
    got = N.json_strings(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), "id", "text", "effect").collect()
    for r in got:
        text = texts[r["id"]]
        want = values(json.loads(text), "effect") if text not in ("not json", "", None) else set()
        assert r["values"] == sorted(want), text
    assert len(got) == len(texts) and any(len(r["values"]) > 1 for r in got)


def test_redaction_by_schema_and_by_key(spark):
    row = {"id": 1, "Access_Key_Id": "k", "deep": {"note": "n", "auth": [{"userPassword": "p", "port": 5}, None], "authorization": {"a": 1}}, "free": {"api_key": 7, "plain": 8}, "maps": {"x": {"TOKEN": "t", "y": "z"}}, "none": None}
    df = spark.createDataFrame([row], "id long, Access_Key_Id string, deep struct<note: string, auth: array<struct<userPassword: string, port: int>>, authorization: struct<a: int>>, "
                               "free map<string, int>, maps map<string, map<string, string>>, none struct<secret: string>")
    got = N.without_secrets(df).first().asDict(True)
    got["maps"] = {k: json.loads(v) for k, v in got["maps"].items()}
    assert got == {"id": 1, "Access_Key_Id": "***", "deep": {"note": "n", "auth": [{"userPassword": "***", "port": 5}, None], "authorization": "***"}, "free": {"api_key": "***", "plain": "8"},
                   "maps": {"x": {"TOKEN": "***", "y": "z"}}, "none": None}
    keyed = N.without_secrets(df, "salt").first().asDict(True)
    name = lambda v: hashlib.sha256(f"salt\n{v}".encode()).hexdigest()[:16]
    assert keyed["Access_Key_Id"] == name("k") and keyed["deep"]["auth"][0]["userPassword"] == name("p") and keyed["deep"]["authorization"] == name('{"a":1}') and keyed["free"] == {"api_key": name("7"), "plain": "8"}
    assert N.without_secrets(df, "other").first()["Access_Key_Id"] != keyed["Access_Key_Id"]


@pytest.mark.parametrize("rows", [[], [(1, None)]])
def test_no_entries(spark, rows):
    df = spark.createDataFrame(rows, "id long, text string")
    assert N.json_entries(df, "id", "text").count() == 0 and N.json_strings(df, "id", "text", "effect").count() == len(rows)


def test_entries_have_depth_and_kind(spark):
    df = spark.createDataFrame([(1, '{"a": [1, {"b": "x"}]}')], "id long, text string")
    got = {(r["depth"], r["field"], r["value"]) for r in N.json_entries(df, "id", "text").where(~F.col("kind").startswith("ARRAY")).collect()}
    assert got == {(1, None, "1"), (1, None, '{"b":"x"}'), (2, "b", "x")}
