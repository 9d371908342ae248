"""The published runs from input folders to output folders.

``clean`` -> ``describe`` / ``rank`` -> ``contrast`` -> ``classify``, and
``ingest`` for the manifest. Each reads its input once into a table in the
shared folder where it needs it more than once, and writes Parquet for
documents and one small CSV per report.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexitally.functions.defaults import EXPERIMENTS, STOPWORDS
from lexitally.functions.text import whitespace_tokens
from lexitally.operators import distinct, eda, ingest, metrics, model, tfidf
from lexitally.operators.term_table import Slice, term_table
from lexitally.session import stage
from lexitally.sources import readers, sinks
from lexitally.streaming import ingest as streaming

RANKINGS = (
    # report, phrase lengths, stopwords removed, least documents, column
    ("tfidf_by_emotion", (1, 1), False, 1, "word"),
    ("tfidf_by_emotion_stopwords_removed", (1, 1), True, 1, "word"),
    ("bigram_tfidf", (2, 2), True, 2, "phrase"),
    ("trigram_tfidf", (3, 3), True, 2, "phrase"),
)
PATTERNS = (
    # report, ranking it comes from, column, rows per label of the short list
    ("distinctive_words", "tfidf_by_emotion_stopwords_removed", "word", 20),
    ("distinctive_bigrams", "bigram_tfidf", "phrase", 15),
    ("distinctive_trigrams", "trigram_tfidf", "phrase", 15),
)


def load(spark: SparkSession, path: str, keep_empty: bool = False) -> DataFrame:
    """Cleaned documents: a folder per label holding text files, or the Parquet table of ``clean``."""
    docs = readers.read_corpus(spark, path, keep_empty=True).drop("word_count")
    if docs.isEmpty():
        docs = spark.read.parquet(path)
    return docs if keep_empty else readers.drop_blank(docs)


def clean(spark: SparkSession, raw: str, out: str) -> DataFrame:
    """ING-5: clean every raw text; returns documents per outcome (AGG-13)."""
    docs = readers.read_corpus(spark, raw, "*_raw.txt", keep_empty=True).drop("word_count")
    names = streaming.processed_name(F.col("file_name"))
    cleaned = streaming.cleaned_documents(docs.withColumn("file_name", names))
    sinks.write_corpus(cleaned.withColumn("doc_id", F.concat_ws("/", "emotion", "file_name")), out)
    done = spark.read.parquet(out).select(F.lit("ok").alias("status"))
    failed = readers.read_errors(spark, raw, "*_raw.txt").select(F.lit("failed").alias("status"))
    return ingest.status_counts(done.unionByName(failed))


def clean_new(spark: SparkSession, raw: str, out: str, checkpoint: str) -> None:
    """ING-4: clean only texts that were not there the last time."""
    docs = streaming.stream_texts(spark, raw).withColumn("doc_id", F.concat_ws("/", "emotion", "file_name"))
    streaming.run_available(docs, out, checkpoint, partition_by="emotion")


def describe(spark: SparkSession, corpus: str, out: str, top_n: int = 20) -> None:
    """SNK-4: the data set, lengths, vocabulary sizes and most frequent words."""
    words = whitespace_tokens(F.col("text"))
    docs = load(spark, corpus, keep_empty=True).withColumn("words", words)
    docs, _ = stage(docs.withColumn("word_count", F.size("words").cast("long")))
    docs.drop("words").write.mode("overwrite").parquet(f"{out}/transcript_dataset")
    sinks.write_report(eda.corpus_summary(docs), f"{out}/corpus_summary")
    sinks.write_report(eda.label_counts(docs, "emotion").orderBy("emotion"), f"{out}/label_counts")
    sinks.write_report(eda.length_summary(docs, "emotion").orderBy("emotion"), f"{out}/text_length_by_emotion")
    sizes = eda.vocabulary_size(docs, "emotion").orderBy(F.col("vocabulary_size").desc(), "emotion")
    sinks.write_report(sizes, f"{out}/vocabulary_by_emotion")
    top = eda.top_words(docs, "emotion", top_n=top_n, first_seen="file_name")
    sinks.write_report(top.orderBy("emotion", "rank"), f"{out}/top_words")


def rank(
    spark: SparkSession, corpus: str, out: str, top_n: int = 30, stopwords: Iterable[str] = STOPWORDS
) -> None:
    """TXT-7, TXT-8, TXT-9: the four rankings, as one report and per label."""
    slices = [Slice(*ngrams, without, min_df) for _, ngrams, without, min_df, _ in RANKINGS]
    table = term_table(load(spark, corpus), "doc_id", "emotion", "text", slices, stopwords, raw=False)
    for (name, *_, column), part, vocab in zip(RANKINGS, slices, table.vocabularies(slices)):
        ranked, _ = stage(tfidf.rank_labels(table.counted(part), vocab, "doc_id", "emotion", top_n, column))
        sinks.write_report(ranked.orderBy("emotion", "rank"), f"{out}/{name}")
        sinks.write_report_per_label(ranked, "emotion", f"{out}/per_label/{name}")


def contrast(spark: SparkSession, rankings: str, out: str, carryover: bool = False) -> None:
    """TXT-12, TXT-13, TOP-3, TOP-4: distinctive terms, filtered, and the short lists."""
    for name, ranking, column, short in PATTERNS:
        schema = f"emotion string, rank int, {column} string, mean_tfidf double"
        ranked = readers.read_results(spark, f"{rankings}/{ranking}", schema)
        table, _ = stage(distinct.distinctiveness(ranked, column, carryover=carryover))
        for part, rows in (
            ("all", table),
            ("filtered", distinct.valid_patterns(table, column)),
            ("top", distinct.top_patterns(table, column, top_n=short, positive_only=False)),
            ("top_10", distinct.top_patterns(table, column, top_n=10)),
        ):
            sinks.write_report(distinct.published_order(rows, column), f"{out}/{part}/{name}")


def classify(spark: SparkSession, corpus: str, out: str, stopwords: Iterable[str] = STOPWORDS) -> DataFrame:
    """ML-7 to ML-10, SNK-6: all experiments with their reports; returns the comparison."""
    docs = readers.require_rows(load(spark, corpus))
    predictions = model.experiment_grid(docs, "doc_id", "emotion", stopwords=stopwords, raw=False)
    names = [name for name, _, _ in EXPERIMENTS]
    for name in names:
        own = predictions.where(F.col("experiment") == name)
        sinks.write_report(
            metrics.class_report(own, "emotion", "prediction"), f"{out}/reports/classification_report_{name}"
        )
        sinks.write_report(
            metrics.confusion_counts(own, "emotion", "prediction").orderBy("truth", "prediction"),
            f"{out}/confusion_matrix/{name}",
        )
    compared, _ = stage(model.compare_experiments(predictions, names, "emotion"))
    sinks.write_report(compared.orderBy(F.col("macro_f1").desc(), "experiment"), f"{out}/model_comparison")
    return compared


def ingest_manifest(
    spark: SparkSession, manifest: str, raw: str | None, out: str, outcomes: DataFrame | None = None, **options
) -> DataFrame:
    """SRC-1 to SNK-7: route and number the manifest, look up what exists, write the ledger."""
    rows = ingest.manifest_rows(readers.read_manifest(spark, manifest))
    if raw is None:
        existing = rows.select("emotion", "video_id").limit(0)
    else:
        existing = readers.existing_transcripts(spark, raw)
    ledger, _ = stage(ingest.ingest_status(rows, existing, outcomes, **options))
    sinks.write_ledger(ledger, out)
    return ledger
