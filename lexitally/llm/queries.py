"""Registered queries of the pipeline operators, on the given tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexitally.llm import bpe, conversations, forest, infill, language, licences, mixture, ngram_join, oracles, sharding, small_world, suffix_dedup, token_files, url_filter
from lexitally.llm.common import table


BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def held_out() -> F.Column:
    """Documents that language ID never learns from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", held_out().alias("held_out"))
    model = language.fit(docs, where=~F.col("held_out"))
    found = language.identify(docs, model, keep=["doc_id", "held_out"])
    return found.select("doc_id", "held_out", "lang_pred", "score", "accepted")


def op1_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op3_small_world(spark: SparkSession, sf_dir: str) -> DataFrame:
    return small_world.near_duplicates(table(spark, sf_dir, "embeddings"), bound=0.9)


#: The tree of the mixture: a domain per group of sources, then language, then source.
DOMAINS = ("web", "books", "news", "code")
MIX_WEIGHTS = {"domain": {"web": 5, "books": 2, "news": 2, "code": 1}, "lang": {"en": 4}}


def mix_levels() -> dict[str, F.Column]:
    number = F.coalesce(F.regexp_extract("source", r"([0-9]{1,9})$", 1).try_cast("int"), F.lit(0))
    domain = F.lit(DOMAINS[0])
    for i, name in enumerate(DOMAINS):
        domain = F.when(number % len(DOMAINS) == i, name).otherwise(domain)
    return {"domain": domain, "lang": F.col("lang"), "source": F.col("source")}


def op2_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    picked = mixture.mix(docs, mix_levels(), MIX_WEIGHTS, share=(1, 2), epochs=2, seed=2)
    return picked.select("doc_id", "lang", "source", "mix_tokens", "mix_epoch")


#: The rules of the contract.
URL_RULES = [
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
]


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.judge(pages, rules).select("page_id", "host", "path", "rule", "verdict")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = suffix_dedup.remove_repeats(docs)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_files.round_trip(docs, WORD_BPE)


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode(docs, BYTE_BPE, decode=True).select("doc_id", *bpe.digests())


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return ngram_join.jaccard_classes(docs).withColumnRenamed("id", "doc_id")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sharding.shard(docs, 8).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


#: The phrases of the contract.
LICENCE_PHRASES = [("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit")]


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = licences.scan(docs, phrases=LICENCE_PHRASES)
    at, base = F.col("places.word"), F.array_distinct("places.label")
    every = F.array_union(base, F.col("spans.label"))
    return found.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(at).alias("first_word"),
        F.array_max(at).alias("last_word"),
        F.array_join(F.array_sort(base), ",").alias("base_labels"),
        F.array_join(F.array_sort(every), ",").alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(F.col("covered")).alias("score"),
        "spans",
    )


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    made = infill.rearrange(docs, seed=1, plain=10, spm=20).select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output")
    again = infill.restored(F.col("output"), F.col("form"))
    digest = [F.sha2(c.cast("binary"), 256).alias(name) for c, name in ((F.col("output"), "output_sha256"), (again, "restored_sha256"))]
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digest)


def damaged(turns: DataFrame) -> DataFrame:
    """The turns with faults that the checksums of their ids call for; null roles and texts become one space."""
    some = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat_ws(":", some("conv_id"), some("turn")).cast("binary")) % 20
    text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("fate") == 4, "user").otherwise(F.col("role"))
    rows = turns.select("conv_id", "turn", some("role").alias("role"), some("text").alias("text"), fate.alias("fate")).where("fate <> 0")
    times = F.when(F.col("fate") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(times)).drop("col")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    fixed = conversations.repair(damaged(turns))
    found = fixed.conversations.join(conversations.line_digests(fixed.lines), "key", "left")
    every = turns.select(F.col("conv_id").alias("id")).distinct()
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return every.join(found, F.col("id").eqNullSafe(F.col("conv_id")), "left").select(
        F.col("id").alias("conv_id"),
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in numbers],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
    )


QUERIES = {
    "op1_forest": op1_forest,
    "op2_mixture": op2_mixture,
    "op3_small_world": op3_small_world,
    "op4_url_filter": op4_url_filter,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_language_id": op6_language_id,
    "op7_token_files": op7_token_files,
    "op8_bpe": op8_bpe,
    "op9_ngram_join": op9_ngram_join,
    "op10_sharding": op10_sharding,
    "op11_license_scan": op11_license_scan,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_conversation_repair": op13_conversation_repair,
}

#: Where SQL can express an operator on whole tables.
ORACLES: dict[str, str] = {
    "op2_mixture": oracles.mixture(DOMAINS, MIX_WEIGHTS, (1, 2), 2, 2),
    "op4_url_filter": oracles.url_filter(URL_RULES),
    "op12_fill_in_middle": oracles.fill_in_middle(1, 10, 20),
    "op13_conversation_repair": oracles.conversation_repair(),
}
