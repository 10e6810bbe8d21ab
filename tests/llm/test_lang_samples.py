"""Languages learned from copies, and in many scripts."""

import random

import numpy as np
from pyspark.sql import functions as F

from cairn.llm import langid


def test_labels_of_copies_are_learned(spark):
    docs = spark.range(48_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("l"), F.col("id") % 3).alias("lang"), F.element_at(F.array(*map(F.lit, ("one text", "un texte", "ein wort"))), (F.col("id") % 3 + 1).cast("int")).alias("text"))
    assert langid.training_text(docs) == {"l0": "one text", "l1": "un texte", "l2": "ein wort"}


def test_each_language_has_its_own_letters():
    letters = [[chr(0x4E00 + k * 100 + i) for i in range(100)] for k in range(6)]
    model = langid.Model({f"l{k}": "".join(x) * (7 - k) for k, x in enumerate(letters)})
    assert model.predict(["".join(x[20:60]) for x in letters])[0] == [f"l{k}" for k in range(6)]


def test_a_language_of_copies_and_few_others(spark):
    docs = spark.range(20_360).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 20_060, "fr").otherwise("en").alias("lang"),
                                      F.when(F.col("id") < 20_000, "le texte copié").otherwise(F.concat(F.lit("a text of number "), F.col("id"))).alias("text"))
    assert set(langid.training_text(docs)) == {"fr", "en"}


def test_large_alphabets_are_small():
    rng = random.Random(1)
    han = "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(20_000))
    model = langid.Model({"zh": han, "en": "some plain words of another script " * 20})
    assert (model.automata[model.langs.index("zh")].comb >= 0).sum() > 20_000
    assert sum(a.comb.nbytes + a.begin.nbytes for a in model.automata) < 3 << 20
    assert model.predict([han[500:540], han[3000:3003] + han[9000:9005]])[0] == ["zh", "zh"]
