"""Samples that are learned from, on tables of few texts and many copies."""

from pyspark.sql import functions as F

from cairn.llm import quality


def test_quality_sample_of_copies(spark, monkeypatch):
    monkeypatch.setattr(quality, "ROWS", 200)
    monkeypatch.setattr(quality, "LEAST", 50)
    seen = {}
    init = quality.Model.__init__

    def keep(self, x, y, *more):
        seen["y"] = y
        init(self, x, y, *more)

    monkeypatch.setattr(quality.Model, "__init__", keep)
    for k in range(6):  # one text for each label: a choice by the text takes all of its rows or none
        good, bad = f"A quiet text of number {k}, in whole sentences.", f"$$$ BUY | BUY | {k} !!!"
        docs = spark.range(8000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 20 == 0, bad).otherwise(good).alias("text"))
        labels = docs.select("doc_id", F.when(F.col("doc_id") % 20 == 0, 0).otherwise(1).alias("quality"))
        model = quality.learn(docs, labels)
        n = [int((seen["y"] == c).sum()) for c in (0, 1)]
        assert 20 <= n[0] <= 90 and 120 <= n[1] <= 270
        assert model.score([good])[0] >= quality.THRESHOLD > model.score([bad])[0]
