"""A training corpus from raw documents: five stages, each a table between the others."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexitally.llm import bpe, language, mixture, ngram_join, suffix_dedup
from lexitally.llm.queries import MIX_WEIGHTS, held_out, mix_levels
from lexitally.session import stage

#: Bytes of a repeated passage: some 50 words, the shortest ones included.
PASSAGE = 200


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: documents without a letter, and those the calibrated bound rejects, go."""
    model = language.fit(docs, where=~held_out())
    return language.identify(docs, model).where("accepted").select(*docs.columns)


def keep_one_of_alike(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join: the row of the smallest id stays of every group of near copies.

    Near copies share 0.8 of their five-word shingles. Exactly one row stays of a group, also
    where rows repeat under one id. Rows with a null id are rows like others, after all ids.
    """
    ids = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    if ids.where("n > 1 or doc_id is null").isEmpty():
        numbered = docs.withColumn("__row", F.col("doc_id").cast("long"))
    else:
        numbered, _ = stage(docs.withColumn("__row", F.monotonically_increasing_id()))
    groups = ngram_join.jaccard_classes(numbered, "__row", words=5, percent=80).withColumnRenamed("id", "__row")
    of_row = groups.join(numbered.select("__row", "doc_id"), "__row")
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "__row")
    first = of_row.groupBy("component_id").agg(F.min(order).alias("first")).select("first.__row")
    return numbered.join(first, "__row", "left_semi").select(*docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Suffix-array dedup: passages that occur again leave the texts, and texts with nothing left go."""
    cut = suffix_dedup.remove_repeats(docs, length=PASSAGE, as_text=True)
    cut = cut.withColumn("text", F.col("kept")).withColumn("n_chars", F.length("kept").cast("long"))
    return cut.where(F.col("text").rlike(r"\S")).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing towards target weights: nine tenths of all tokens, each document once at most.

    A domain cannot give more than it holds, so the weights are approached, not reached (see README).
    """
    return mixture.mix(docs, mix_levels(), MIX_WEIGHTS, share=(9, 10), epochs=1, seed=2).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """BPE encoding and decoding: ids of every document, and digests of ids and decoded text."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    coded = bpe.encode(docs.select("doc_id", "lang", "source", "text"), path, decode=True)
    return coded.select("doc_id", "lang", "source", "ids", *bpe.digests())


STAGES = [
    ("language_id", keep_known_languages),
    ("ngram_join", keep_one_of_alike),
    ("suffix_dedup", cut_repeats),
    ("mixture", mix_sources),
    ("bpe", encode),
]

#: SQL can express neither the classifier nor suffix arrays; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, apply in STAGES:
        docs, _ = stage(apply(spark, docs, sf_dir))
    return docs
