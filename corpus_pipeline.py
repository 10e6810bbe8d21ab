"""The corpus pipeline: every document through quality, language, near duplicates, mixing and tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next one's docs. All but the last return the columns
of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm import bpe, langid, mixing, ngramjoin, quality
from cairn.llm.queries import RANKS, vocabulary
from cairn.llm.shared import materialise


#: Languages whose documents stay; None keeps all that are learned.
LANGUAGES: tuple[str, ...] | None = None
#: What phrases of the best language must save of a code letter by letter: something, where a text has LONG characters; shorter clean texts
#: of few words beside numbers and names may take up to twice the bits.
LONG, LEAST_GAIN, LEAST_GAIN_SHORT = 400, 0.0, -1.0


def _own(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` doesn't have."""
    while name in docs.columns:
        name += "_"
    return name


def by_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score reaches the threshold; scores are learned from the stage's own labelled documents.

    Null texts are judged as empty ones, repeated rows alike; without labels of both kinds all stay; an empty table gives none.
    """
    name = _own(docs, "quality_score")
    scored = quality.score(docs, quality.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")), name)
    return scored.where(F.col(name) >= quality.THRESHOLD).select(*docs.columns)


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str, languages: tuple[str, ...] | None = LANGUAGES) -> DataFrame:
    """Documents in one of ``languages`` whose phrases tell more than its letters; unknown scripts, texts without a letter and null texts go.

    The language found goes on as ``lang`` of documents that had none. Repeated rows are judged alike; an empty table gives none.
    """
    label, share, gain = (_own(docs, c) for c in ("lang_pred", "lang_score", "lang_gain"))
    found = langid.predict(docs, langid.training_text(docs), label, share, gain)
    least = F.when(F.char_length("text") >= LONG, LEAST_GAIN).otherwise(LEAST_GAIN_SHORT)
    wanted = F.col(label) != langid.UNDETERMINED if languages is None else F.col(label).isin(*languages)
    kept = found.where(wanted & (F.col(gain) > least))
    return kept.select(*[F.coalesce(F.col("lang"), F.col(label)).alias("lang") if c == "lang" else F.col(f"`{c}`") for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group that links of five-word shingles connect.

    Texts without words, null ones too, link with nothing and stay; of repeated rows one stays; an empty table gives none.
    """
    return ngramjoin.one_of_each(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it.

    Null sources are a source of their own; texts without words count for nothing and are taken at their source's rate; repeated rows
    are documents of their own; an empty table gives none.
    """
    return mixing.emit(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and the ids of each document of the mix.

    Null texts are empty and have no ids; each of repeated rows gives a row; an empty table gives none.
    """
    return bpe.encode(docs, vocabulary(RANKS), vectors=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", by_quality), ("language ID", by_language), ("n-gram Jaccard join", near_duplicates),
    ("mixing sources to target weights", mixed), ("byte-level BPE encoding and decoding", tokens)]

#: SQL can express neither the learned stages nor the merges; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs, f"pipeline-{k}")
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
