"""Queries over the given tables, one or more per operator.

Each takes ``(spark, folder of Parquet tables)`` and reads its whole tables.
``documents`` is the labelled corpus (label = ``lang`` or ``source``),
``conversations`` a second one (label = ``role``), ``pages`` the manifest and
``labels`` the set of documents already processed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexitally.functions import routing, text
from lexitally.functions.defaults import EXPERIMENTS, STOPWORDS
from lexitally.operators import distinct, eda, ingest, metrics, model, ranking, sampling, tfidf, trees
from lexitally.operators.phrase_blocks import phrase_blocks
from lexitally.session import spread_single_file, stage, stage_path
from lexitally.sources import listing, readers, sinks
from lexitally.streaming import ingest as streaming

# Common words of the four languages of ``documents``, so that removal has an effect there.
COMMON_WORDS = tuple(
    "the of and to in is that for on with der die und den von mit das la le les des un une et el los que de".split()
)
QUERY_STOPWORDS = STOPWORDS + COMMON_WORDS

# Host rules that send the invented hosts of ``pages`` down every branch.
PAGE_RULES = (
    ("GD", "equals", "thther.example.org"),
    ("IG", "contains", "blog."),
    ("IG", "contains", "example.net"),
)
PAGE_CODES = {"en": "ENG", "fr": "FRA"}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def documents(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    return readers.read_table(spark, f"{sf}/documents.parquet", "doc_id", *columns)


def langs(spark: SparkSession, sf: str) -> DataFrame:
    return documents(spark, sf, "lang", "text")


def words(spark: SparkSession, sf: str, label: str = "lang", stopwords=(), ngrams=(1, 1)) -> DataFrame:
    """The non-blank documents with an array of terms."""
    return tfidf.with_terms(documents(spark, sf, label, "text"), "text", ngrams, stopwords)


# cleaning and tokens


def with_link(c: str = "text"):
    """A text with a link, dashes and odd spaces added; the given texts hold hardly any."""
    return F.concat(
        F.lit("\ufeffSee HTTPS://ex.com/a?b=1 or www.Ex.org/x "), F.col(c), F.lit(" a–b\u00a0c—d http://e.x/"), F.col("doc_id")
    )


def clean_text(spark, sf):
    return langs(spark, sf).select("doc_id", text.clean_text(with_link()).alias("cleaned"))


def clean_steps(spark, sf):
    low = text.lower_case(with_link())
    return langs(spark, sf).select(
        "doc_id",
        F.md5(low).alias("lowered"),
        F.md5(text.strip_urls(low)).alias("without_urls"),
        F.md5(text.dashes_to_space(low)).alias("without_dashes"),
        F.md5(text.punctuation_to_space(low)).alias("without_punctuation"),
        F.md5(text.collapse_space(low)).alias("collapsed"),
    )


def light_clean(spark, sf):
    return langs(spark, sf).select("doc_id", text.light_clean(with_link()).alias("cleaned"))


def token_counts(spark, sf):
    c = F.col("text")
    return langs(spark, sf).select(
        "doc_id",
        text.word_count(c).alias("whitespace_tokens"),
        F.size(text.word_tokens(c)).cast("long").alias("word_tokens"),
        text.is_blank(c).alias("blank"),
    )


def stopword_removed(spark, sf):
    cleaned = langs(spark, sf).select("doc_id", text.clean_text(F.col("text")).alias("text"))
    return cleaned.select("doc_id", text.remove_stopwords(F.col("text"), QUERY_STOPWORDS).alias("kept"))


def stopword_anti_join(spark, sf):
    stop = spark.createDataFrame([(w,) for w in QUERY_STOPWORDS], "word string")
    tokens = ranking.exploded(words(spark, sf), F.col("terms"), "word", "lang")
    return tokens.join(stop, "word", "left_anti").groupBy("lang", "word").agg(F.count(F.lit(1)).alias("count"))


def phrase_counts(shortest, longest):
    def query(spark, sf):
        docs = words(spark, sf, stopwords=QUERY_STOPWORDS, ngrams=(shortest, longest))
        counted = tfidf.counted_terms(docs.drop("lang"))
        return counted.select("doc_id", F.col("term").alias("phrase"), F.col("tf").cast("long").alias("count"))

    return query


def valid_patterns(spark, sf):
    held = ranking.exploded(words(spark, sf), F.array_distinct("terms"), "word").distinct()
    return held.where(text.is_valid_pattern(F.col("word")))


# manifest and ingest


def manifest(spark, sf):
    label = F.regexp_extract("url", r"^https?://[^/]+/([^/?#]+)", 1)
    return table(spark, sf, "pages").select("page_id", "url", label.alias("label"))


def page_rows(spark, sf):
    return ingest.manifest_rows(
        manifest(spark, sf), "page_id", "page_id", "url", "label", PAGE_RULES, PAGE_CODES
    )


def manifest_ids(spark, sf):
    rows = page_rows(spark, sf)
    return rows.select(
        "dataset_id",
        "emotion",
        "source_type",
        "sequence",
        "video_id",
        routing.raw_path(F.col("emotion"), F.col("video_id")).alias("raw_path"),
        routing.processed_path(F.col("emotion"), F.col("video_id")).alias("processed_path"),
        routing.processed_name(F.concat("video_id", F.lit("_raw.txt"))).alias("processed_name"),
    )


def manifest_csv(spark, sf):
    """The manifest written as CSV and read back as a manifest file."""
    path = stage_path(spark)
    pages = manifest(spark, sf).select(F.col("page_id").alias("id"), F.col("url").alias("video"), F.col("label").alias("emotion"))
    pages.write.csv(path, header=True, escape='"')
    rows = readers.read_manifest(spark, path).withColumn("page_id", F.col("id").cast("long"))
    return ingest.manifest_rows(rows, "page_id", rules=PAGE_RULES, codes=PAGE_CODES).select(
        "dataset_id", "url", "emotion", "source_type", "video_id"
    )


def source_routing(spark, sf):
    return manifest(spark, sf).select(
        "page_id",
        routing.url_hostname(F.col("url")).alias("host"),
        routing.source_type(F.col("url"), PAGE_RULES).alias("source_type"),
        routing.source_type(F.concat(F.lit("https://u@Drive.Google.com:80/"), "label")).alias("drive"),
        routing.source_type(F.concat(F.lit("https://www.instagram.com/"), "label")).alias("reel"),
        routing.source_type(F.col("label")).alias("hostless"),
    )


def url_host_counts(spark, sf):
    return eda.label_counts(manifest(spark, sf).select(routing.url_host(F.col("url")).alias("host")), "host")


def url_filter(spark, sf):
    some_null = F.when(~F.col("url").contains("ref="), F.col("url"))
    return (
        manifest(spark, sf)
        .select("page_id", some_null.alias("url"))
        .where(routing.without_hosts(F.col("url"), "BLOG|cheap"))
    )


def drive_file_id(spark, sf):
    key, label = F.col("page_id").cast("string"), F.col("label")
    url = (
        F.when(label == "en", F.concat(F.lit("https://drive.google.com/file/d/f"), key, F.lit("/view")))
        .when(label == "fr", F.concat(F.lit("https://drive.google.com/open?id=o"), key, F.lit("&x=1")))
        .when(label == "de", F.concat(F.lit("https://drive.google.com/uc?export=d&id=u"), key))
        .otherwise(F.col("url"))
    )
    return manifest(spark, sf).select("page_id", routing.drive_file_id(url).alias("file_id"))


def error_messages():
    url, label = F.col("url"), F.col("label")
    return (
        F.when(url.contains("#"), F.concat(F.lit("ERROR: Video "), url, F.lit(" is Private")))
        .when(url.contains("?"), F.concat(F.lit("  Access denied for "), url))
        .when(label == "fr", F.lit("  "))
        .when(label == "de", F.concat(F.lit("HTTP Error 403 at "), url))
        .otherwise(F.concat(F.lit(" timeout for "), url, F.lit("\n")))
    )


def error_class(spark, sf):
    rows = manifest(spark, sf).select("page_id", error_messages().alias("message"))
    return rows.select(
        "page_id",
        routing.classify_error(F.col("message"), "GD").alias("drive_note"),
        routing.classify_error(F.col("message"), "IG").alias("reel_note"),
    )


def existing_pages(spark, sf, rows):
    """Rows whose number occurs among the labelled documents count as present."""
    done = table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("dataset_id"))
    return rows.join(done, "dataset_id", "left_semi")


def attempts(rows):
    """Outcomes told by the address: a query string is gone, a fragment fails, "blog" was not tried."""
    url = F.col("url")
    return rows.where(~url.contains("blog")).select(
        "emotion",
        "video_id",
        F.when(url.contains("?"), F.lit("unavailable")).when(url.contains("#"), F.lit("RuntimeError")).alias("error_class"),
        F.when(url.contains("?"), F.lit("gone")).when(url.contains("#"), F.concat(F.lit("boom "), url)).alias("message"),
    )


def ledger(spark, sf, **options):
    rows = page_rows(spark, sf)
    return ingest.ingest_status(rows, existing_pages(spark, sf, rows), attempts(rows), order="page_id", **options)


def ingest_status(spark, sf):
    return ledger(spark, sf)


def ingest_limited(spark, sf):
    return ledger(spark, sf, dry_run=True, skip_existing=False, limit=40)


def status_counts(spark, sf):
    return ingest.status_counts(ledger(spark, sf))


def ledger_csv(spark, sf):
    """The ledger written and read back."""
    path = stage_path(spark)
    sinks.write_ledger(ledger(spark, sf), path)
    schema = ", ".join(f"{c} string" for c in ingest.LEDGER_COLUMNS)
    return readers.read_results(spark, path, schema).na.fill("")


def pending_docs(spark, sf):
    docs = documents(spark, sf, "lang")
    return ingest.pending_rows(docs, table(spark, sf, "labels"), ["doc_id"])


def first_pages(spark, sf):
    return ranking.first_rows(manifest(spark, sf), ["page_id"], 5)


# corpus statistics


def label_counts(spark, sf):
    return eda.label_counts(table(spark, sf, "documents"), "lang")


def source_counts(spark, sf):
    return eda.value_counts(table(spark, sf, "documents"), "source")


def corpus_summary(spark, sf):
    return eda.corpus_summary(langs(spark, sf).withColumn("text", text.clean_text(F.col("text"))))


def null_counts(spark, sf):
    host = manifest(spark, sf).withColumn("host", F.when(F.col("label") != "es", routing.url_host(F.col("url"))))
    return eda.null_counts(host, "host", "label")


def distinct_labels(spark, sf):
    return eda.distinct_labels(table(spark, sf, "documents"), "source")


def lengths(spark, sf, label):
    docs = documents(spark, sf, label, "text")
    return docs.select(label, F.size(text.clean_words(F.col("text"))).cast("long").alias("word_count"))


def length_summary(spark, sf):
    return eda.length_summary(lengths(spark, sf, "lang"), "lang")


def length_summary_by_source(spark, sf):
    return eda.length_summary(lengths(spark, sf, "source"), "source")


def length_histogram(spark, sf):
    return eda.length_histogram(lengths(spark, sf, "lang"), "lang")


def vocabulary_size(spark, sf):
    return eda.vocabulary_size(words(spark, sf), "lang", "terms")


def vocabulary_merged(spark, sf):
    """AGG-6 from sketches of two batches that were written one after the other: how far off they are, at most 2 %."""
    docs, path = words(spark, sf), stage_path(spark)
    for batch in (0, 1):
        eda.vocabulary_sketches(docs.where(F.col("doc_id") % 2 == batch), "lang", "terms").write.parquet(f"{path}/batch={batch}")
    sketches = eda.merge_sketches(spark.read.schema("lang string, sketch binary").parquet(path), "lang")
    about = eda.vocabulary_estimate(sketches, "lang").withColumnRenamed("vocabulary_size", "about")
    exact = vocabulary_size(spark, sf)
    close = F.abs(F.col("about") - F.col("vocabulary_size")) <= 0.02 * F.col("vocabulary_size")
    return exact.join(about, "lang").select("lang", "vocabulary_size", close.alias("within_bound"))


def word_counts(spark, sf):
    return eda.word_counts(words(spark, sf), "lang", "terms")


def top_words(spark, sf):
    return eda.top_words(words(spark, sf), "lang", "terms")


def top_words_first_seen(spark, sf):
    return eda.top_words(words(spark, sf, "source"), "source", "terms", first_seen="doc_id")


def word_comparison(spark, sf):
    return eda.word_comparison(words(spark, sf), "lang", "terms")


def exclamations(spark, sf):
    return eda.exclamations(langs(spark, sf), "lang")


# TF-IDF


def doc_frequency(spark, sf):
    return tfidf.document_frequencies(words(spark, sf), min_df=2)


def idf_table(spark, sf):
    vocab = tfidf.fit_vocabulary(words(spark, sf, stopwords=QUERY_STOPWORDS), "lang", 2)
    return vocab.terms.select("term", "df", F.bround("idf", 9).alias("idf"))


def tf_sublinear(spark, sf):
    counted = tfidf.counted_terms(words(spark, sf).drop("lang"))
    damped = 1.0 + F.log(F.col("tf").cast("double"))
    return counted.select("doc_id", "term", F.col("tf").cast("long").alias("tf"), F.bround(damped, 9).alias("damped"))


def feature_count(spark, sf):
    counts = {}
    for side in sorted({without for _, _, without in EXPERIMENTS}):
        docs, own = documents(spark, sf, "lang", "text"), [(name, *ngrams, 1) for name, ngrams, without in EXPERIMENTS if without == side]
        blocks = phrase_blocks(docs, "doc_id", "lang", stopwords=QUERY_STOPWORDS if side else ())
        counts |= zip([name for name, *_ in own], blocks.feature_counts([tuple(s) for _, *s in own]))
    return spark.createDataFrame([(name, counts[name]) for name, _, _ in EXPERIMENTS], "experiment string, features long")


def ranking_query(label="lang", **options):
    def query(spark, sf):
        docs = documents(spark, sf, label, "text")
        return tfidf.tfidf_ranking(docs, "doc_id", label, **options)

    return query


tfidf_words = ranking_query()
tfidf_words_min_df = ranking_query(min_df=2)
tfidf_words_nostop = ranking_query(stopwords=QUERY_STOPWORDS)
tfidf_bigrams = ranking_query(ngrams=(2, 2), stopwords=QUERY_STOPWORDS, min_df=2, term="phrase")
tfidf_trigrams = ranking_query(ngrams=(3, 3), stopwords=QUERY_STOPWORDS, min_df=2, term="phrase")
tfidf_range_1_2 = ranking_query(ngrams=(1, 2), stopwords=QUERY_STOPWORDS, sublinear=True, term="phrase")
tfidf_range_1_3 = ranking_query(ngrams=(1, 3), stopwords=QUERY_STOPWORDS, sublinear=True, term="phrase")
tfidf_by_source = ranking_query(label="source", min_df=2)
# the way beyond the broadcast bound, on the same data
tfidf_words_shuffled = ranking_query(limit=1_000)
tfidf_bigrams_shuffled = ranking_query(
    ngrams=(2, 2), stopwords=QUERY_STOPWORDS, min_df=2, term="phrase", limit=1_000
)


def turns(spark, sf):
    table_ = spread_single_file(table(spark, sf, "conversations"), "conv_id")
    return table_.select(F.concat_ws("-", "conv_id", "turn").alias("turn_id"), "role", "text")


def tfidf_conversations(spark, sf):
    return tfidf.tfidf_ranking(turns(spark, sf), "turn_id", "role")


def rounded_weights(docs, vocab):
    weights = tfidf.document_weights(docs.drop("lang"), vocab, "doc_id")
    return weights.select("doc_id", "term", F.bround("weight", 6).alias("weight"))


def document_weights(spark, sf):
    vocab = tfidf.fit_vocabulary(words(spark, sf), "lang", 2)
    return rounded_weights(tfidf.hashed_terms(langs(spark, sf), "doc_id"), vocab)


def split_docs(spark, sf, *more):
    """The split of the non-blank documents; their text is read once."""
    kept, _ = stage(readers.drop_blank(langs(spark, sf)).select("doc_id", "lang", *more))
    return sampling.train_test_split(kept, "doc_id")


def tfidf_transform_test(spark, sf):
    whole = split_docs(spark, sf, "text")
    train, test = (whole.where(F.col("split") == s).drop("split") for s in ("train", "test"))
    vocab = tfidf.fit_vocabulary(tfidf.with_terms(train), "lang", 1, True)
    return rounded_weights(tfidf.hashed_terms(test, "doc_id"), vocab)


# distinctiveness


def rounded(df):
    return df.withColumns({c: F.bround(c, 9) for c in ("score", "other_mean", "distinctiveness")})


def distinctive(ranked: Callable, term: str, label: str = "lang", carryover: bool = False):
    def query(spark, sf):
        return rounded(distinct.distinctiveness(ranked(spark, sf), term, label, carryover=carryover))

    return query


distinctive_words = distinctive(tfidf_words_nostop, "word")
distinctive_words_carryover = distinctive(tfidf_words_nostop, "word", carryover=True)
distinctive_bigrams = distinctive(tfidf_bigrams, "phrase")
distinctive_trigrams = distinctive(tfidf_trigrams, "phrase")
distinctive_by_source = distinctive(tfidf_by_source, "word", "source", carryover=True)


def distinctive_filtered(spark, sf):
    return distinct.published_order(distinct.valid_patterns(distinctive_words(spark, sf), "word"), "word", "lang")


def distinctive_top10(spark, sf):
    return distinct.top_patterns(distinctive_bigrams(spark, sf), "phrase", "lang", 10)


def distinctive_top15(spark, sf):
    return distinct.top_patterns(distinctive_trigrams(spark, sf), "phrase", "lang", 15, positive_only=False)


def distinctive_top20(spark, sf):
    return distinct.top_patterns(distinctive_words(spark, sf), "word", "lang", 20, positive_only=False)


def label_pivot(spark, sf):
    return distinct.score_pivot(tfidf_words_nostop(spark, sf), "word", "lang")


def ranking_csv(spark, sf):
    """A ranking written as CSV, per label and as a whole, and read back."""
    ranked = tfidf_words_nostop(spark, sf)
    whole, parts = stage_path(spark), stage_path(spark)
    sinks.write_report(ranked, whole)
    back = readers.read_results(spark, whole, "lang string, rank int, word string, mean_tfidf double")
    sinks.write_report_per_label(back, "lang", parts)
    return spark.read.schema("lang string, rank int, word string, mean_tfidf double, lang_dir string").csv(
        parts, header=True, escape='"'
    )


# sampling


def stratified_sample(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "source")
    return sampling.in_label_order(sampling.sample_per_label(docs, "source", "doc_id"), "source")


def train_test_split(spark, sf):
    return split_docs(spark, sf).select("doc_id", "split")


def split_distribution(spark, sf):
    return sampling.split_distribution(split_docs(spark, sf), "lang")


def rare_labels(spark, sf):
    hosts = manifest(spark, sf).select(routing.url_host(F.col("url")).alias("host"))
    return sampling.rare_labels(hosts, "host")


# metrics over two simple rules, so that SQL can follow


def rule_predictions(spark, sf, rule="words"):
    """Predict the language from which common words a text holds, or from its length."""
    tokens = words(spark, sf)

    def holds(*some):
        return F.arrays_overlap("terms", F.array(*[F.lit(w) for w in some]))

    by_words = (
        F.when(holds("the", "of"), "en")
        .when(holds("und", "der"), "de")
        .when(holds("les", "des"), "fr")
        .otherwise("other")
    )
    by_length = F.when(F.size("terms") > 300, "en").when(F.size("terms") > 100, "fr").otherwise("es")
    return tokens.select("doc_id", "lang", (by_words if rule == "words" else by_length).alias("prediction"))


def class_weights(spark, sf):
    return metrics.class_weights(table(spark, sf, "documents").select("source"), "source").withColumn(
        "class_weight", F.bround("class_weight", 9)
    )


def confusion_matrix(spark, sf):
    return metrics.confusion_matrix(rule_predictions(spark, sf), "lang", "prediction")


def confusion_counts(spark, sf):
    return metrics.confusion_counts(rule_predictions(spark, sf), "lang", "prediction")


def class_report(spark, sf):
    report = metrics.class_report(rule_predictions(spark, sf), "lang", "prediction")
    return report.withColumns({c: F.bround(c, 9) for c in ("precision", "recall", "f1_score", "support")})


# label folders


def label_folders(spark, sf):
    """The pages as text files in label folders: one file a page, some of no bytes, some that are no UTF-8, some blank.

    Files are named and filled by the page's number and address, as SQL can follow.
    """
    root = stage_path(spark)
    kind = F.col("page_id") % 10
    html = F.coalesce("url", F.lit(""))
    body = (
        F.when(kind == 0, F.lit(b""))
        .when(kind == 1, F.concat(html.cast("binary"), F.unhex(F.lit("FF20"))))
        .when(kind == 2, F.lit(b" \n"))
        .otherwise(F.concat(F.lit(b"  "), html.cast("binary"), F.lit(b"\n")))
    )
    label = F.concat(F.lit("label "), (F.col("page_id") % 7).cast("string"))
    name = F.concat(F.col("page_id").cast("string"), F.lit("_processed.txt"))
    files = table(spark, sf, "pages").select(label.alias("emotion"), name.alias("file_name"), body.alias("content"))
    sinks.write_files(files, root)
    return root


def folder_corpus(spark, sf):
    """SRC-3, SRC-9: the good and non-blank texts of label folders, read in one pass with the others set aside."""
    docs = readers.read_corpus(spark, label_folders(spark, sf), quarantine=stage_path(spark))
    return docs.select("doc_id", "emotion", F.md5("text").alias("text_md5"))


def folder_statistics(spark, sf):
    """SRC-4, SNK-4: all good files, those of no bytes too, with their words."""
    return readers.read_corpus(spark, label_folders(spark, sf), keep_empty=True).select("doc_id", "emotion", "word_count")


def folder_quarantine(spark, sf):
    """SRC-9: files that are no UTF-8, and where; what both sides hold adds up to all files."""
    out = stage_path(spark)
    root = label_folders(spark, sf)
    readers.read_corpus(spark, root, quarantine=out)
    bad = readers.read_quarantine(spark, out)
    return bad.select("emotion", "file_name", "reason", "byte_position", F.octet_length("content").cast("long").alias("n_bytes"))


def folder_listing(spark, sf):
    """JOIN-4: names and sizes of all files, without their content."""
    return listing.list_files(spark, label_folders(spark, sf), "*_processed.txt")


def corpus_table(spark, sf):
    """SRC-5, ING-5, SNK-3: cleaned documents written by label and read back."""
    path = stage_path(spark)
    docs = streaming.cleaned_documents(langs(spark, sf))
    sinks.write_corpus(docs, path, "lang")
    back = spark.read.schema("doc_id long, text string, lang string").parquet(path)
    return back.select("doc_id", "lang", F.md5("text").alias("text_md5"))


def report_csv(spark, sf):
    """SNK-6: the class report written as CSV and read back."""
    path = stage_path(spark)
    sinks.write_report(class_report(spark, sf), path)
    return readers.read_results(spark, path, "label string, precision double, recall double, f1_score double, support double")


def distinctive_csv(spark, sf):
    """SNK-5: the filtered distinctive words written as CSV and read back."""
    path = stage_path(spark)
    found = distinctive_filtered(spark, sf)
    sinks.write_report(found, path)
    return readers.read_results(spark, path, ", ".join(f"{name} {kind}" for name, kind in found.dtypes))


METRICS = ("accuracy", "macro_precision", "macro_recall", "macro_f1", "weighted_f1")


def metrics_summary(spark, sf):
    summary = metrics.metrics_summary(rule_predictions(spark, sf), "lang", "prediction")
    return summary.withColumns({c: F.bround(c, 9) for c in METRICS})


def experiment_compare(spark, sf):
    both = rule_predictions(spark, sf, "words").withColumn("experiment", F.lit("words")).unionByName(
        rule_predictions(spark, sf, "length").withColumn("experiment", F.lit("length"))
    )
    compared = model.compare_experiments(both, ["words", "length"], "lang")
    return compared.withColumns({c: F.bround(c, 9) for c in METRICS})


def learned(spark, sf, experiments=EXPERIMENTS):
    """Test documents with the label of every experiment, and what it saw of them."""
    rows = model.experiment_grid(langs(spark, sf), "doc_id", "lang", stopwords=QUERY_STOPWORDS, experiments=experiments, sums=True)
    return rows.withColumn("weight_sum", F.bround("weight_sum", 6))


def logreg_predictions(spark, sf):
    """Test documents with what the classifier saw of them, and whether it gave a label it knows.

    The columns are those SQL can follow; ``logreg_labels`` has the labels themselves.
    """
    return known_labels(learned(spark, sf, EXPERIMENTS[:1])).drop("experiment")


def known_labels(predicted):
    known = predicted.select("lang").distinct().select(F.col("lang").alias("prediction"), F.lit(True).alias("known_label"))
    rows = predicted.join(F.broadcast(known), "prediction", "left").drop("prediction")
    return rows.withColumn("known_label", F.coalesce("known_label", F.lit(False)))


def experiment_grid(spark, sf):
    return known_labels(learned(spark, sf))


def experiment_labels(spark, sf):
    """Test documents with the label every experiment of the grid gives them, and what it saw of them."""
    return learned(spark, sf).select("experiment", "doc_id", "lang", "prediction", "n_features", "weight_sum")


def experiment_metrics(spark, sf):
    """The experiments compared by their predictions, best first."""
    compared = model.compare_experiments(experiment_labels(spark, sf), [e[0] for e in EXPERIMENTS], "lang")
    return compared.withColumns({c: F.bround(c, 9) for c in METRICS})


def logreg_labels(spark, sf):
    """Test documents with the label the classifier gives them, and what it saw of them."""
    return learned(spark, sf, EXPERIMENTS[:1]).select("doc_id", "lang", "prediction", "n_features", "weight_sum")


def margin_labels(spark, sf):
    """OPT-4: test documents with the label of the largest margin of one label against the rest."""
    prepared = model.prepared_corpus(langs(spark, sf), "doc_id", "lang")
    return model.run_experiment(prepared, "doc_id", "lang", stopwords=QUERY_STOPWORDS, loss="squared_hinge")


def forest_labels(spark, sf):
    """OPT-4: test documents with the label a forest gives them."""
    prepared = model.prepared_corpus(langs(spark, sf), "doc_id", "lang")
    rows = prepared.select("doc_id", "lang", "split", text.remove_words(F.col("words"), QUERY_STOPWORDS).alias("terms"))
    forest = trees.fit_forest(rows.where("split = 'train'"), "doc_id", "lang")
    return forest.predict(rows.where("split = 'test'").drop("split"))


def tree_splits(spark, sf):
    """OPT-4: the nodes of one tree of two levels, of all documents and terms."""
    rows = words(spark, sf, stopwords=QUERY_STOPWORDS)
    tree = trees.fit_forest(rows, "doc_id", "lang", trees=1, depth=2, term_share=1, bootstrap=False, balanced=False)
    return tree.table(spark).drop("tree")


# streaming


def stream_clean_ingest(spark, sf):
    schema = table(spark, sf, "documents").schema
    stream = streaming.stream_table(spark, sf, "documents.parquet", schema)
    out = stage_path(spark)
    streaming.run_available(stream.select("doc_id", "lang", "text"), out, stage_path(spark), partition_by="lang")
    return spark.read.schema("doc_id long, text string, lang string").parquet(out)


def stream_ledger(spark, sf):
    pages = table(spark, sf, "pages")
    stream = streaming.stream_table(spark, sf, "pages.parquet", pages.schema)

    def to_ledger(batch, earlier):
        label = F.regexp_extract("url", r"^https?://[^/]+/([^/?#]+)", 1)
        rows = ingest.manifest_rows(
            batch.select("page_id", "url", label.alias("label")), "page_id", "page_id", "url", "label", PAGE_RULES, PAGE_CODES,
            earlier,
        )
        return ingest.ingest_status(rows, existing_pages(spark, sf, rows), attempts(rows), order="page_id")

    out = stage_path(spark)
    streaming.run_ledger(stream.select("page_id", "url"), to_ledger, out, stage_path(spark))
    return spark.read.parquet(out).drop("batch_id")


QUERIES = {
    f.__name__: f
    for f in (
        clean_text, clean_steps, light_clean, token_counts, stopword_removed, stopword_anti_join, valid_patterns,
        manifest_ids, manifest_csv, source_routing, url_host_counts, url_filter, drive_file_id, error_class,
        ingest_status, ingest_limited, status_counts, ledger_csv, pending_docs, first_pages,
        label_counts, source_counts, corpus_summary, null_counts, distinct_labels, length_summary,
        length_summary_by_source, length_histogram, vocabulary_size, word_counts, top_words,
        top_words_first_seen, word_comparison, exclamations,
        doc_frequency, idf_table, tf_sublinear, feature_count, tfidf_conversations, document_weights,
        tfidf_transform_test, distinctive_filtered, distinctive_top10, distinctive_top15, distinctive_top20,
        label_pivot, ranking_csv, stratified_sample, train_test_split, split_distribution, rare_labels,
        class_weights, confusion_matrix, confusion_counts, class_report, metrics_summary, experiment_compare,
        logreg_predictions, experiment_grid, stream_clean_ingest, stream_ledger,
        folder_corpus, folder_statistics, folder_quarantine, folder_listing, corpus_table, report_csv, distinctive_csv,
        vocabulary_merged, tree_splits,
    )
} | {
    "ngrams_2": phrase_counts(2, 2),
    "ngrams_3": phrase_counts(3, 3),
    "ngrams_1_2": phrase_counts(1, 2),
    "ngrams_1_3": phrase_counts(1, 3),
    "tfidf_words": tfidf_words,
    "tfidf_words_min_df": tfidf_words_min_df,
    "tfidf_words_nostop": tfidf_words_nostop,
    "tfidf_bigrams": tfidf_bigrams,
    "tfidf_trigrams": tfidf_trigrams,
    "tfidf_range_1_2": tfidf_range_1_2,
    "tfidf_range_1_3": tfidf_range_1_3,
    "tfidf_by_source": tfidf_by_source,
    "tfidf_words_shuffled": tfidf_words_shuffled,
    "tfidf_bigrams_shuffled": tfidf_bigrams_shuffled,
    "distinctive_words": distinctive_words,
    "distinctive_words_carryover": distinctive_words_carryover,
    "distinctive_bigrams": distinctive_bigrams,
    "distinctive_trigrams": distinctive_trigrams,
    "distinctive_by_source": distinctive_by_source,
}

#: What a classifier learned, which SQL cannot follow; tests compare with a refit.
LEARNED = {f.__name__: f for f in (logreg_labels, experiment_labels, experiment_metrics, margin_labels, forest_labels)}
