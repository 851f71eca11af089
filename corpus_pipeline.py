"""From raw documents to token ids, in stages that each read what the last one wrote.

Stages before the last keep the columns of ``documents``; n_chars follows the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weighbridge.llm import decontaminate, jaccard, language, pieces
from weighbridge.llm.common import table
from weighbridge.llm.lines import LineStore
from weighbridge.llm.queries import piece_model
from weighbridge.sources.storage import stored

ORACLE_SQL = None  # language identification has no SQL form


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled ones teach; texts without one go."""
    return language.accepted(docs, language.learn(docs, F.lit(True)))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each repeated line stays in the first document that holds it."""
    store = LineStore(spark)
    store.insert(docs)
    return store.kept(docs, out="text").withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.one_of_each(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, ids, starts, ends): pieces and the bytes of the text they stand for."""
    return pieces.encode(docs, piece_model()).select("doc_id", "lang", "source", "ids", "starts", "ends")


STAGES = [
    ("language ID", identify_language),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_benchmark_leaks),
    ("SentencePiece encoding", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
