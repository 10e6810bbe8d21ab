import base64
import hashlib
import zlib

import numpy as np
import pytest
from compare import duck, same

import corpus_pipeline
from cairn.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, connection, name):
    same(queries.queries()[name](spark, SF), connection, queries.oracle_sql()[name])


def test_every_operator_has_a_query():
    assert {n.split("_")[0] for n in queries.queries()} == {f"op{i}" for i in range(1, 14)}


def rows(spark, name):
    return {r["doc_id"]: r for r in queries.queries()[name](spark, SF).collect()}


def test_languages(spark, documents):
    got, want = rows(spark, "op1_langid"), {r["doc_id"]: r["lang"] for r in documents.collect()}
    held = [d for d, r in got.items() if r["held_out"]]
    assert set(got) == set(want) and all(r["held_out"] == (zlib.crc32(str(d).encode()) % 4 == 2) for d, r in got.items())
    assert np.mean([got[d]["lang_pred"] == want[d] for d in held]) > 0.95 and all(0 <= r["score"] <= 1 for r in got.values())


def test_quality(spark):
    got = rows(spark, "op7_quality")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    held = [d for d in labels if got[d]["held_out"]]
    assert np.mean([got[d]["predicted"] == labels[d] for d in held]) > 0.9
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got.values())


def ids_by_library(documents):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.vocabulary(queries.TOKENIZER))
    return {r["doc_id"]: t.encode(r["text"] or "", add_special_tokens=False).ids + [queries.END_ID] for r in documents.collect()}


def test_id_files(spark, documents):
    got, at = rows(spark, "op8_simple8b"), 0
    for d, ids in sorted(ids_by_library(documents).items()):
        assert (got[d]["start"], got[d]["n_tokens"], got[d]["ids_crc32"]) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def encoder():
    import public_tokenizers
    import tiktoken

    with open(queries.vocabulary(queries.RANKS), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_merges(spark, documents):
    got, e = rows(spark, "op9_bpe"), encoder()
    for r in documents.collect():
        ids, own = e.encode_ordinary(r["text"]), got[r["doc_id"]]
        assert (own["n_tokens"], own["ids_sha256"], own["decoded_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(r["text"].encode()).hexdigest())


def test_pipeline_equals_brute_force(spark, documents):
    """Each stage against its meaning, on what the stage before it kept."""
    from cairn.llm import langid, mixing, ngramjoin, quality
    from cairn.llm.shared import materialise
    from test_ngramjoin import brute

    kept, columns = documents, documents.columns
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    after = {}
    for name, stage in corpus_pipeline.STAGES:
        before, kept = kept, materialise(stage(spark, kept, SF), "test")
        after[name] = kept
        own = before.collect()
        if name.startswith("quality"):
            model = quality.learn(before, labels)
            want = [r["doc_id"] for r in own if model.score([r["text"]])[0] >= quality.THRESHOLD]
        elif name.startswith("language"):
            model = langid.Model(langid.training_text(before))
            said = [(r["doc_id"], len(r["text"]), *(x[0] for x in model.predict([r["text"]]))) for r in own]
            want = [d for d, n, label, _, gain in said if label != langid.UNDETERMINED and gain > (0 if n >= 400 else -1)]
        elif name.startswith("n-gram"):
            want = [d for d, (_, c) in brute({r["doc_id"]: r["text"] for r in own}).items() if c == d]
        elif name.startswith("mixing"):
            want = [r["doc_id"] for r in mixing.mix(before).collect() for _ in range(r["copies"])]
        else:
            e = encoder()
            assert sorted((r["doc_id"], tuple(r["ids"])) for r in kept.collect()) == sorted((r["doc_id"], tuple(e.encode_ordinary(r["text"]))) for r in own)
            continue
        assert kept.columns == columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(want), name
    assert sorted((r["doc_id"], r["ids_sha256"]) for r in corpus_pipeline.run(spark, SF).collect()) == sorted((r["doc_id"], r["ids_sha256"]) for r in kept.collect())


def test_pipeline_takes_odd_tables(spark, odd, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for table in (odd, odd.limit(0)):
        kept = table
        for _, stage in corpus_pipeline.STAGES:
            kept = stage(spark, kept, str(tmp_path))
        assert kept.count() <= 2 * table.count()


def test_language_stage_selects(spark, documents):
    """Of four languages those asked for stay; unknown scripts and texts that no language's phrases fit go, whatever they are labelled."""
    shown = documents.select("doc_id", "text", "lang", "source", "n_chars").where("n_chars > 400")
    strange = [(9001, "Ωμέγα και άλφα στο τέλος της ημέρας " * 30, None, "s", 1), (9002, "漢字 仮名 " * 200, "en", "s", 1), (9003, "12 345 " * 100, "en", "s", 1),
               (9004, "zxq vkj wqpx jzkv " * 40, "en", "s", 1), (9005, None, "en", "s", None)]
    bare = shown.limit(1).selectExpr("9006L", "concat(text, ' ')", "CAST(NULL AS STRING)", "source", "n_chars")
    docs = shown.union(spark.createDataFrame(strange, shown.schema)).union(bare).cache()
    every = {r["doc_id"]: r["lang"] for r in corpus_pipeline.by_language(spark, docs, SF).collect()}
    was = {r["doc_id"]: r["lang"] for r in shown.collect()}
    assert not {9001, 9002, 9003, 9005} & set(every) and set(was) - set(every) == set()
    assert all(every[d] == lang for d, lang in was.items()) and every[9006] in was.values()
    some = {r["doc_id"] for r in corpus_pipeline.by_language(spark, docs, SF, ("de", "fr")).collect()}
    assert {was[d] for d in some & set(was)} == {"de", "fr"} and len(some & set(was)) >= 0.95 * sum(lang in ("de", "fr") for lang in was.values())
