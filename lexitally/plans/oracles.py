"""The same results in DuckDB SQL, written from the definitions and not from the Spark code.

The SQL cleans in five steps, joins and ranks plainly, and knows nothing of the
ways around shuffles that the Spark side takes.
"""

from __future__ import annotations

from lexitally.functions.defaults import ERROR_RULES, EXPERIMENTS
from lexitally.plans.queries import PAGE_CODES, PAGE_RULES, QUERY_STOPWORDS

# The languages of ``documents``; SQL needs the names of its columns beforehand.
LANGS = ["de", "en", "es", "fr"]

S = r"\t-\r\x1c-\x1f\x{85}\p{Z}"
W = r"\p{L}\p{N}_"
URLS = rf"https?://[^{S}]+|www\.[^{S}]+"


def strip_urls(c):
    return f"regexp_replace({c}, '{URLS}', ' ', 'g')"


def dashes(c):
    return f"regexp_replace({c}, '[-–—]', ' ', 'g')"


def punctuation(c):
    return f"regexp_replace({c}, '[^{W}{S}]', ' ', 'g')"


def collapse(c):
    return f"trim(regexp_replace({c}, '[{S}]+', ' ', 'g'))"


def clean(c):
    return collapse(punctuation(dashes(strip_urls(f"lower({c})"))))


def quoted(values):
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


LINKED = (
    "concat(chr(65279), 'See HTTPS://ex.com/a?b=1 or www.Ex.org/x ', text, "
    "' a–b\u00a0c—d http://e.x/', CAST(doc_id AS VARCHAR))"
)
STOP = quoted(QUERY_STOPWORDS)


def corpus(label="lang", stopwords=False, ngrams=(1, 1), source="documents", id_sql="doc_id", name="docs"):
    """CTEs up to ``terms(id, label, term)``; ``docs`` holds the non-blank documents."""
    words = f"regexp_extract_all(cleaned, '[{W}]+')"
    if stopwords:
        words = f"[x for x in {words} if x not in ({STOP})]"
    grams = " UNION ALL ".join(
        f"SELECT id, label, unnest([array_to_string(w[i:i+{n - 1}], ' ') for i in "
        f"generate_series(1, len(w) - {n - 1})]) AS term FROM tokens"
        if n > 1
        else "SELECT id, label, unnest(w) AS term FROM tokens"
        for n in range(ngrams[0], ngrams[1] + 1)
    )
    return f"""cleaned AS (SELECT {id_sql} AS id, {label} AS label, {clean('text')} AS cleaned FROM {source}),
    docs AS (SELECT * FROM cleaned WHERE cleaned <> ''),
    tokens AS (SELECT id, label, {words} AS w FROM docs),
    terms AS ({grams})"""


TF = "tf AS (SELECT id, label, term, count(*) AS tf FROM terms GROUP BY ALL)"


def idf(min_df=1, from_tf="tf", n="(SELECT count(*) FROM docs)"):
    return f"""vocab AS (SELECT term, count(*) AS df,
        ln(CAST(1 + {n} AS DOUBLE) / CAST(1 + count(*) AS DOUBLE)) + 1.0::DOUBLE AS idf
        FROM {from_tf} GROUP BY term HAVING count(*) >= {min_df})"""


def weights(sublinear=False, from_tf="tf"):
    tf = "(1.0::DOUBLE + ln(CAST(tf AS DOUBLE)))" if sublinear else "CAST(tf AS DOUBLE)"
    return f"""raw AS (SELECT id, label, term, {tf} * idf AS w FROM {from_tf} JOIN vocab USING (term)),
    weights AS (SELECT id, label, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS weight FROM raw)"""


def ranked(label="lang", term="word", min_df=1, sublinear=False, top_n=30, **options):
    return f"""{corpus(label, **options)}, {TF}, {idf(min_df)}, {weights(sublinear)},
    sizes AS (SELECT label, count(*) AS n FROM docs GROUP BY label),
    scores AS (SELECT label, term, sum(weight) / any_value(n) AS score FROM weights JOIN sizes USING (label)
        GROUP BY label, term),
    ranked AS (SELECT label AS {label}, CAST(row_number() OVER (PARTITION BY label ORDER BY round(score, 12) DESC, term)
        AS INTEGER) AS rank, term AS {term}, round_even(score, 6) AS mean_tfidf FROM scores WHERE score > 0
        QUALIFY rank <= {top_n})"""


def ranking(**options):
    return f"WITH {ranked(**options)} SELECT * FROM ranked"


def distinctive(term="word", label="lang", carryover=False, **options):
    plain = "(total - s) / nullif(n - 1, 0)"
    carried = f"CASE WHEN k = 1 THEN {plain} ELSE (total - s + before) / (n + 1) END"
    return f"""{ranked(label=label, term=term, **options)},
    names AS (SELECT DISTINCT {label} AS l FROM ranked),
    held AS (SELECT DISTINCT {term} AS t FROM ranked),
    dense AS (SELECT l, t, coalesce(mean_tfidf, 0.0::DOUBLE) AS s
        FROM names CROSS JOIN held LEFT JOIN ranked ON ({label} = l AND {term} = t)),
    summed AS (SELECT *, sum(s) OVER (PARTITION BY t) AS total, count(*) OVER (PARTITION BY t) AS n,
        row_number() OVER (PARTITION BY t ORDER BY l) AS k, lag(s) OVER (PARTITION BY t ORDER BY l) AS before FROM dense),
    others AS (SELECT l, t, s, {carried if carryover else plain} AS other FROM summed),
    dist AS (SELECT l AS {label}, t AS {term}, round_even(s, 9) AS score, round_even(other, 9) AS other_mean,
        round_even(s - other, 9) AS distinctiveness FROM others)"""


def top_distinctive(term, top_n, positive, **options):
    where = "WHERE round(distinctiveness, 12) > 0" if positive else ""
    return f"""WITH {distinctive(term, **options)} SELECT *, CAST(row_number() OVER (PARTITION BY lang
        ORDER BY round(distinctiveness, 12) DESC, {term}) AS INTEGER) AS rank FROM dist {where} QUALIFY rank <= {top_n}"""


HASH = "md5(concat(CAST({id} AS VARCHAR), '#42'))"
SPLIT = f"""sides AS (SELECT *, CASE WHEN row_number() OVER (ORDER BY {HASH.format(id='id')}, id)
    <= ceil(0.2::DOUBLE * count(*) OVER ()) THEN 'test' ELSE 'train' END AS split FROM kept)"""
KEPT = f"kept AS (SELECT doc_id AS id, lang AS label, text FROM documents WHERE regexp_matches(text, '[^{S}]'))"


def seen_by_model(key="doc_id", experiment=None, **options):
    """Test rows with the number of their known terms and the sum of their weights."""
    name = "" if experiment is None else f"'{experiment}' AS experiment, "
    label = options.get("label", "lang")
    return f"""WITH {corpus(**options)}, {TF},
        sides AS (SELECT id, label, CASE WHEN row_number() OVER (ORDER BY {HASH.format(id='id')}, id)
            <= ceil(0.2::DOUBLE * count(*) OVER ()) THEN 'test' ELSE 'train' END AS split FROM docs),
        trained AS (SELECT tf.* FROM tf JOIN sides USING (id) WHERE split = 'train'),
        tested AS (SELECT tf.* FROM tf JOIN sides USING (id) WHERE split = 'test'),
        {idf(1, 'trained', "(SELECT count(*) FROM sides WHERE split = 'train')")}, {weights(True, 'tested')},
        seen AS (SELECT id, count(*) AS n, sum(weight) AS s FROM weights GROUP BY id)
        SELECT {name}id AS {key}, label AS {label}, coalesce(n, 0)::BIGINT AS n_features,
            round_even(coalesce(s, 0.0::DOUBLE), 6) AS weight_sum, true AS known_label
        FROM sides LEFT JOIN seen USING (id) WHERE split = 'test'"""


GRID = " UNION ALL ".join(
    f"SELECT * FROM ({seen_by_model(experiment=name, ngrams=ngrams, stopwords=without)})" for name, ngrams, without in EXPERIMENTS
)

WS = r"\t-\r\x1c-\x1f\x{85}\p{Z}"
STRIPPED = f"regexp_replace(regexp_replace(coalesce(url, ''), '^[{WS}]+', ''), '[{WS}]+$', '')"
PAGES = """pg AS (SELECT page_id, url, regexp_extract(url, '^https?://[^/]+/([^/?#]+)', 1) AS label FROM pages)"""
HOST = "lower(nullif(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.\\-]*:)?//(?:[^/?#]*@)?([^/?#:]*)', 1), ''))"
HOST9 = "nullif(regexp_extract(url, 'https?://([^/]+)', 1), '')"
ROUTE = (
    "CASE "
    + " ".join(
        f"WHEN {HOST} = '{t}' THEN '{c}'" if how == "equals" else f"WHEN contains({HOST}, '{t}') THEN '{c}'"
        for c, how, t in PAGE_RULES
    )
    + " ELSE 'UNSUPPORTED' END"
)
CODE = (
    "CASE "
    + " ".join(f"WHEN label = '{k}' THEN '{v}'" for k, v in PAGE_CODES.items())
    + " ELSE substr(upper(regexp_replace(label, '[^A-Za-z]', '', 'g')), 1, 3) END"
)
ROWS = f"""{PAGES}, routed AS (SELECT *, {ROUTE} AS source_type, {CODE} AS code,
    row_number() OVER (PARTITION BY label ORDER BY page_id) AS sequence FROM pg),
    rows AS (SELECT page_id, CAST(page_id AS VARCHAR) AS dataset_id, url, label AS emotion, source_type, sequence,
    concat(code, '_', CASE WHEN sequence < 1000 THEN lpad(CAST(sequence AS VARCHAR), 3, '0')
        ELSE CAST(sequence AS VARCHAR) END, '_', source_type) AS video_id FROM routed)"""
RAW_PATH = "concat('data/1_raw/transcripts/', emotion, '/', video_id, '_raw.txt')"
DRIVE_ID = (
    "coalesce(nullif(regexp_extract({u}, '/file/d/([^/]+)', 1), ''), nullif(regexp_extract({u}, '[?&]id=([^&]+)', 1), ''))"
)


def ledger_ctes(skip=True, dry=False, limit=None):
    rest = (
        "WHEN true THEN 'dry_run'"
        if dry
        else f"""WHEN source_type = 'GD' AND {DRIVE_ID.format(u='url')} IS NULL THEN 'deleted_or_unavailable'
        WHEN NOT contains(url, 'blog') AND contains(url, '?') THEN 'deleted_or_unavailable'
        WHEN NOT contains(url, 'blog') AND contains(url, '#') THEN 'failed'
        WHEN NOT contains(url, 'blog') THEN 'transcribed' ELSE ''"""
    )
    cut = f"ORDER BY page_id LIMIT {limit}" if limit else ""
    skipped = "WHEN present THEN 'skipped_existing'" if skip else ""
    note = (
        "''"
        if dry
        else f"""CASE status WHEN 'failed' THEN concat('boom ', url) WHEN 'deleted_or_unavailable' THEN
        CASE WHEN source_type = 'GD' AND {DRIVE_ID.format(u='url')} IS NULL
        THEN 'google drive file id could not be parsed' ELSE 'gone' END ELSE '' END"""
    )
    return f"""{ROWS}, batch AS (SELECT *, page_id IN (SELECT doc_id FROM labels) AS present FROM rows {cut}),
    staged AS (SELECT *, CASE WHEN source_type = 'UNSUPPORTED' THEN 'unsupported_source' {skipped} {rest} END AS status FROM batch),
    ledger AS (SELECT dataset_id, video_id, emotion, url, source_type, status,
        present OR status = 'transcribed' AS has_raw_transcript, false AS has_cleaned_transcript,
        CASE WHEN source_type = 'UNSUPPORTED' THEN '' ELSE 'whisper:small' END AS transcription_method,
        {RAW_PATH} AS raw_transcript_path, '' AS cleaned_transcript_path,
        CASE WHEN status = 'unsupported_source' THEN 'Only Instagram and Google Drive sources are allowed'
        ELSE {note} END AS notes FROM staged)"""


def error_note(source):
    rule = ERROR_RULES[source]
    test = " OR ".join(f"contains(lower(m), '{x}')" for x in rule["markers"])
    stripped = f"regexp_replace(m, '^[{S}]+|[{S}]+$', '', 'g')"
    return f"CASE WHEN {test} THEN '{rule['unavailable']}' ELSE coalesce(nullif({stripped}, ''), '{rule['fallback']}') END"


def lengths(label):
    return f"lens AS (SELECT {label}, len(regexp_extract_all({clean('text')}, '[{W}]+')) AS n FROM documents)"


def length_summary(label):
    return f"""WITH {lengths(label)} SELECT {label}, count(*) AS transcript_count, CAST(sum(n) AS BIGINT) AS total_words,
        round_even(CAST(sum(n) AS DOUBLE) / count(*) * 100, 0) / 100 AS average_words,
        round_even(CAST(median(n) AS DOUBLE) * 100, 0) / 100 AS median_words, CAST(min(n) AS BIGINT) AS min_words,
        CAST(max(n) AS BIGINT) AS max_words FROM lens GROUP BY {label}"""


def phrases(shortest, longest):
    return f"""WITH {corpus(stopwords=True, ngrams=(shortest, longest))} SELECT id AS doc_id, term AS phrase,
        count(*) AS "count" FROM terms GROUP BY ALL"""


RULES = f"""{corpus()}, ruled AS (SELECT id, label AS truth,
    CASE WHEN list_contains(w, 'the') OR list_contains(w, 'of') THEN 'en'
        WHEN list_contains(w, 'und') OR list_contains(w, 'der') THEN 'de'
        WHEN list_contains(w, 'les') OR list_contains(w, 'des') THEN 'fr' ELSE 'other' END AS by_words,
    CASE WHEN len(w) > 300 THEN 'en' WHEN len(w) > 100 THEN 'fr' ELSE 'es' END AS by_length FROM tokens)"""


def scored(prediction, tag=""):
    """CTE with precision, recall, F1 and support per label of the union."""
    return f"""names{tag} AS (SELECT truth AS label FROM ruled UNION SELECT {prediction} FROM ruled),
    counted{tag} AS (SELECT label,
        (SELECT count(*) FROM ruled WHERE truth = label AND {prediction} = label) AS tp,
        (SELECT count(*) FROM ruled WHERE {prediction} = label) AS pred,
        (SELECT count(*) FROM ruled WHERE truth = label) AS support FROM names{tag}),
    scored{tag} AS (SELECT label, tp, support,
        CASE WHEN pred = 0 THEN 0.0::DOUBLE ELSE CAST(tp AS DOUBLE) / pred END AS p,
        CASE WHEN support = 0 THEN 0.0::DOUBLE ELSE CAST(tp AS DOUBLE) / support END AS r,
        CASE WHEN pred + support = 0 THEN 0.0::DOUBLE ELSE CAST(2 * tp AS DOUBLE) / (pred + support) END AS f
        FROM counted{tag})"""


def summary(tag=""):
    return f"""round_even(CAST(sum(tp) AS DOUBLE) / sum(support), 9) AS accuracy,
        round_even(avg(p), 9) AS macro_precision, round_even(avg(r), 9) AS macro_recall,
        round_even(avg(f), 9) AS macro_f1, round_even(sum(f * support) / sum(support), 9) AS weighted_f1
        FROM scored{tag}"""


def report():
    n = "CAST(sum(support) AS DOUBLE)"

    def w(c):
        return f"round_even(sum({c} * support) / {n}, 9)"

    acc = f"round_even(CAST(sum(tp) AS DOUBLE) / {n}, 9)"
    return f"""WITH {RULES}, {scored('by_words')}
        SELECT label, round_even(p, 9) AS "precision", round_even(r, 9) AS recall, round_even(f, 9) AS f1_score,
            CAST(support AS DOUBLE) AS support FROM scored
        UNION ALL SELECT 'accuracy', {acc}, {acc}, {acc}, {acc} FROM scored
        UNION ALL SELECT 'macro avg', round_even(avg(p), 9), round_even(avg(r), 9), round_even(avg(f), 9), {n} FROM scored
        UNION ALL SELECT 'weighted avg', {w('p')}, {w('r')}, {w('f')}, {n} FROM scored"""


NOSTOP = {"stopwords": True}
BIGRAMS = {"stopwords": True, "ngrams": (2, 2), "min_df": 2, "term": "phrase"}
TRIGRAMS = {"stopwords": True, "ngrams": (3, 3), "min_df": 2, "term": "phrase"}

def grown(level):
    """CTEs of one level of a tree: rows by node, label sizes, gains of all terms, the best term of a node."""
    n, above = level, level - 1
    if not level:
        placed = "SELECT id, label, 1 AS node FROM docs WHERE label IS NOT NULL"
    else:
        placed = f"""SELECT p.id, p.label, 2 * s.node + CASE WHEN d.term IS NULL THEN 0 ELSE 1 END AS node
        FROM p{above} p JOIN s{above} s USING (node) LEFT JOIN d ON (d.id = p.id AND d.term = s.term)"""
    return f"""p{n} AS ({placed}),
    l{n} AS (SELECT node, label, count(*) AS t FROM p{n} GROUP BY ALL),
    m{n} AS (SELECT node, CAST(sum(t) AS DOUBLE) AS mass, CAST(sum(t * t) AS DOUBLE) AS squares FROM l{n} GROUP BY node),
    c{n} AS (SELECT node, label, term, count(*) AS a FROM p{n} JOIN d USING (id) GROUP BY ALL),
    g{n} AS (SELECT node, term, mass, round((sum(a * a) / CAST(sum(a) AS DOUBLE)
        + (squares + sum((t - a) * (t - a) - t * t)) / (mass - sum(a)) - squares / mass) / mass, 9) AS gain
        FROM c{n} JOIN l{n} USING (node, label) JOIN m{n} USING (node) GROUP BY node, term, mass, squares HAVING sum(a) < mass),
    s{n} AS (SELECT node, term, gain FROM g{n} WHERE gain > 0
        QUALIFY row_number() OVER (PARTITION BY node ORDER BY gain DESC, term) = 1)"""


def tree(depth):
    levels = ", ".join(grown(n) for n in range(depth + 1))
    nodes = " UNION ALL ".join(
        f"SELECT CAST(m{n}.node AS INTEGER) AS node, s{n}.term, s{n}.gain, mass FROM m{n} LEFT JOIN s{n} USING (node)"
        if n < depth
        else f"SELECT CAST(node AS INTEGER), NULL, NULL, mass FROM m{n}"
        for n in range(depth + 1)
    )
    return f"WITH {corpus(stopwords=True)}, d AS (SELECT DISTINCT id, term FROM terms), {levels} {nodes}"


ORACLES = {
    "clean_text": f"SELECT doc_id, {clean(LINKED)} AS cleaned FROM documents",
    "clean_steps": f"""WITH t AS (SELECT doc_id, lower({LINKED}) AS x FROM documents)
        SELECT doc_id, md5(x) AS lowered, md5({strip_urls('x')}) AS without_urls, md5({dashes('x')}) AS without_dashes,
        md5({punctuation('x')}) AS without_punctuation, md5({collapse('x')}) AS collapsed FROM t""",
    "light_clean": f"SELECT doc_id, {collapse(f'replace({LINKED}, chr(65279), chr(32))')} AS cleaned FROM documents",
    "token_counts": f"""SELECT doc_id, CAST(len(regexp_extract_all(text, '[^{S}]+')) AS BIGINT) AS whitespace_tokens,
        CAST(len(regexp_extract_all(text, '[{W}]+')) AS BIGINT) AS word_tokens,
        NOT regexp_matches(text, '[^{S}]') AS blank FROM documents""",
    "stopword_removed": f"""SELECT doc_id, array_to_string([x for x in
        regexp_extract_all({clean('text')}, '[^{S}]+') if x not in ({STOP})], ' ') AS kept FROM documents""",
    "stopword_anti_join": f"""WITH {corpus()} SELECT label AS lang, term AS word, count(*) AS "count" FROM terms
        WHERE term NOT IN ({STOP}) GROUP BY ALL""",
    "ngrams_2": phrases(2, 2),
    "ngrams_3": phrases(3, 3),
    "ngrams_1_2": phrases(1, 2),
    "ngrams_1_3": phrases(1, 3),
    "valid_patterns": f"""WITH {corpus()} SELECT DISTINCT term AS word FROM terms WHERE
        NOT regexp_full_match(term, '\\p{{Nd}}+') AND regexp_matches(term, '[a-zA-Z]') AND length(term) > 1""",
    "manifest_ids": f"""WITH {ROWS} SELECT dataset_id, emotion, source_type, sequence, video_id, {RAW_PATH} AS raw_path,
        concat('data/2_processed/transcripts/', emotion, '/', video_id, '_processed.txt') AS processed_path,
        concat(video_id, '_processed.txt') AS processed_name FROM rows""",
    "manifest_csv": f"WITH {ROWS} SELECT dataset_id, url, emotion, source_type, video_id FROM rows",
    "source_routing": f"""WITH {PAGES} SELECT page_id, {HOST} AS host, {ROUTE} AS source_type,
        'GD' AS drive, 'IG' AS reel, 'UNSUPPORTED' AS hostless FROM pg""",
    "url_host_counts": f"""SELECT {HOST9} AS host, count(*) AS "count" FROM pages WHERE {HOST9} IS NOT NULL GROUP BY 1""",
    "url_filter": """WITH t AS (SELECT page_id, CASE WHEN NOT contains(url, 'ref=') THEN url END AS url FROM pages)
        SELECT * FROM t WHERE url IS NULL OR NOT regexp_matches(url, 'blog|cheap', 'i')""",
    "drive_file_id": f"""WITH {PAGES}, u AS (SELECT page_id, CASE label
        WHEN 'en' THEN concat('https://drive.google.com/file/d/f', page_id, '/view')
        WHEN 'fr' THEN concat('https://drive.google.com/open?id=o', page_id, '&x=1')
        WHEN 'de' THEN concat('https://drive.google.com/uc?export=d&id=u', page_id) ELSE url END AS u FROM pg)
        SELECT page_id, {DRIVE_ID.format(u='u')} AS file_id FROM u""",
    "error_class": f"""WITH {PAGES}, e AS (SELECT page_id, CASE
        WHEN contains(url, '#') THEN concat('ERROR: Video ', url, ' is Private')
        WHEN contains(url, '?') THEN concat('  Access denied for ', url)
        WHEN label = 'fr' THEN '  ' WHEN label = 'de' THEN concat('HTTP Error 403 at ', url)
        ELSE concat(' timeout for ', url, chr(10)) END AS m FROM pg)
        SELECT page_id, {error_note('GD')} AS drive_note, {error_note('IG')} AS reel_note FROM e""",
    "ingest_status": f"WITH {ledger_ctes()} SELECT * FROM ledger",
    "ingest_limited": f"WITH {ledger_ctes(skip=False, dry=True, limit=40)} SELECT * FROM ledger",
    "status_counts": f"""WITH {ledger_ctes()} SELECT status, count(*) AS "count" FROM ledger GROUP BY 1""",
    "ledger_csv": f"""WITH {ledger_ctes()} SELECT * REPLACE (
        CASE WHEN has_raw_transcript THEN 'True' ELSE 'False' END AS has_raw_transcript,
        'False' AS has_cleaned_transcript) FROM ledger""",
    "stream_ledger": f"WITH {ledger_ctes()} SELECT * FROM ledger",
    "pending_docs": "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "first_pages": f"WITH {PAGES} SELECT * FROM pg ORDER BY page_id LIMIT 5",
    "label_counts": """SELECT lang, count(*) AS "count" FROM documents WHERE lang IS NOT NULL GROUP BY 1""",
    "source_counts": """SELECT source, count(*) AS "count" FROM documents WHERE source IS NOT NULL GROUP BY 1""",
    "corpus_summary": f"""SELECT count(*) AS documents, count(*) FILTER ({clean('text')} = '') AS blank_documents
        FROM documents""",
    "null_counts": f"""WITH {PAGES}, h AS (SELECT label, CASE WHEN label <> 'es' THEN {HOST9} END AS host FROM pg)
        SELECT count(*) FILTER (host IS NULL) AS host, count(*) FILTER (label IS NULL) AS label FROM h""",
    "distinct_labels": "SELECT DISTINCT source FROM documents",
    "length_summary": length_summary("lang"),
    "length_summary_by_source": length_summary("source"),
    "length_histogram": f"""WITH {lengths('lang')} SELECT lang, CAST(n // 50 * 50 AS BIGINT) AS length_from,
        count(*) AS documents FROM lens GROUP BY ALL""",
    "vocabulary_size": f"""WITH {corpus()} SELECT label AS lang, count(DISTINCT term) AS vocabulary_size FROM terms GROUP BY 1""",
    "word_counts": f"""WITH {corpus()} SELECT label AS lang, term AS word, count(*) AS "count" FROM terms GROUP BY ALL""",
    "top_words": f"""WITH {corpus()}, c AS (SELECT label AS lang, term AS word, count(*) AS "count" FROM terms GROUP BY ALL)
        SELECT lang, CAST(row_number() OVER (PARTITION BY lang ORDER BY "count" DESC, word) AS INTEGER) AS rank, word, "count"
        FROM c QUALIFY rank <= 20""",
    "top_words_first_seen": f"""WITH {corpus('source')},
        p AS (SELECT id, label, unnest(w) AS word, unnest(generate_series(1, len(w))) AS pos FROM tokens),
        c AS (SELECT label AS source, word, count(*) AS "count", min(struct_pack(a := id, b := pos)) AS seen FROM p GROUP BY ALL)
        SELECT source, CAST(row_number() OVER (PARTITION BY source ORDER BY "count" DESC, seen) AS INTEGER) AS rank, word,
        "count" FROM c QUALIFY rank <= 20""",
    "word_comparison": f"""WITH {corpus()} SELECT term AS word,
        {', '.join(f"count(*) FILTER (label = '{x}') AS {x}" for x in LANGS)} FROM terms GROUP BY term""",
    "exclamations": """WITH e AS (SELECT lang, length(text) - length(replace(text, '!', '')) AS n FROM documents)
        SELECT lang, CAST(sum(n) AS BIGINT) AS exclamations, count(*) FILTER (n > 0) AS documents_with_any FROM e GROUP BY 1""",
    "doc_frequency": f"""WITH {corpus()}, {TF} SELECT term, count(*) AS df FROM tf GROUP BY term HAVING count(*) >= 2""",
    "idf_table": f"""WITH {corpus(stopwords=True)}, {TF}, {idf(2)} SELECT term, df, round_even(idf, 9) AS idf FROM vocab""",
    "tf_sublinear": f"""WITH {corpus()}, {TF} SELECT id AS doc_id, term, tf,
        round_even(1.0::DOUBLE + ln(CAST(tf AS DOUBLE)), 9) AS damped FROM tf""",
    "feature_count": " UNION ALL ".join(
        f"(WITH {corpus(stopwords=without, ngrams=ngrams)} SELECT '{name}' AS experiment, "
        f"count(DISTINCT term) AS features FROM terms)"
        for name, ngrams, without in EXPERIMENTS
    ),
    "tfidf_words": ranking(),
    "tfidf_words_min_df": ranking(min_df=2),
    "tfidf_words_nostop": ranking(**NOSTOP),
    "tfidf_bigrams": ranking(**BIGRAMS),
    "tfidf_trigrams": ranking(**TRIGRAMS),
    "tfidf_range_1_2": ranking(stopwords=True, ngrams=(1, 2), sublinear=True, term="phrase"),
    "tfidf_range_1_3": ranking(stopwords=True, ngrams=(1, 3), sublinear=True, term="phrase"),
    "tfidf_by_source": ranking(label="source", min_df=2),
    "tfidf_words_shuffled": ranking(),
    "tfidf_bigrams_shuffled": ranking(**BIGRAMS),
    "tfidf_conversations": ranking(label="role", source="conversations", id_sql="concat(conv_id, '-', turn)"),
    "document_weights": f"""WITH {corpus()}, {TF}, {idf(2)}, {weights()}
        SELECT id AS doc_id, term, round_even(weight, 6) AS weight FROM weights""",
    "tfidf_transform_test": f"""WITH {KEPT}, {SPLIT},
        {corpus(label='label', source='sides', id_sql='id')}, {TF},
        trained AS (SELECT tf.* FROM tf JOIN sides USING (id) WHERE split = 'train'),
        tested AS (SELECT tf.* FROM tf JOIN sides USING (id) WHERE split = 'test'),
        {idf(1, 'trained', "(SELECT count(*) FROM docs JOIN sides USING (id) WHERE split = 'train')")}, {weights(True, 'tested')}
        SELECT id AS doc_id, term, round_even(weight, 6) AS weight FROM weights""",
    "distinctive_words": f"WITH {distinctive(**NOSTOP)} SELECT * FROM dist",
    "distinctive_words_carryover": f"WITH {distinctive(carryover=True, **NOSTOP)} SELECT * FROM dist",
    "distinctive_bigrams": f"WITH {distinctive(**BIGRAMS)} SELECT * FROM dist",
    "distinctive_trigrams": f"WITH {distinctive(**TRIGRAMS)} SELECT * FROM dist",
    "distinctive_by_source": f"WITH {distinctive(label='source', carryover=True, min_df=2)} SELECT * FROM dist",
    "distinctive_filtered": f"""WITH {distinctive(**NOSTOP)} SELECT * FROM dist WHERE round(distinctiveness, 12) > 0
        AND NOT regexp_full_match(word, '\\p{{Nd}}+') AND regexp_matches(word, '[a-zA-Z]') AND length(word) > 1""",
    "distinctive_top10": top_distinctive(top_n=10, positive=True, **BIGRAMS),
    "distinctive_top15": top_distinctive(top_n=15, positive=False, **TRIGRAMS),
    "distinctive_top20": top_distinctive("word", 20, False, **NOSTOP),
    "label_pivot": f"""WITH {ranked(**NOSTOP)} SELECT word,
        {', '.join(f"coalesce(avg(mean_tfidf) FILTER (lang = '{x}'), 0.0::DOUBLE) AS {x}" for x in LANGS)}
        FROM ranked GROUP BY word""",
    "ranking_csv": f"WITH {ranked(**NOSTOP)} SELECT *, lang AS lang_dir FROM ranked",
    "stratified_sample": f"""SELECT doc_id, source, CAST(row_number() OVER (PARTITION BY source
        ORDER BY {HASH.format(id='doc_id')}, doc_id) AS INTEGER) AS sample_no FROM documents
        WHERE source IS NOT NULL QUALIFY sample_no <= 5""",
    "logreg_predictions": seen_by_model(),
    "experiment_grid": GRID,
    "train_test_split": f"WITH {KEPT}, {SPLIT} SELECT id AS doc_id, split FROM sides",
    "split_distribution": f"""WITH {KEPT}, {SPLIT} SELECT split, label AS lang, count(*) AS "count" FROM sides GROUP BY ALL""",
    "tree_splits": tree(2),
    "rare_labels": f"""SELECT {HOST9} AS host, count(*) AS "count" FROM pages WHERE {HOST9} IS NOT NULL
        GROUP BY 1 HAVING count(*) < 2""",
    "class_weights": """WITH c AS (SELECT source, count(*) AS n_label FROM documents GROUP BY 1)
        SELECT source, n_label, round_even(CAST((SELECT sum(n_label) FROM c) AS DOUBLE)
        / (SELECT count(*) FROM c) / n_label, 9) AS class_weight FROM c""",
    "confusion_matrix": f"""WITH {RULES}, names AS (SELECT truth AS l FROM ruled UNION SELECT by_words FROM ruled)
        SELECT l AS truth, {', '.join(f"count(*) FILTER (by_words = '{x}') AS {x}" for x in [*LANGS, 'other'])}
        FROM names LEFT JOIN ruled ON (truth = l) GROUP BY l""",
    "confusion_counts": f"""WITH {RULES}, names AS (SELECT truth AS l FROM ruled UNION SELECT by_words FROM ruled)
        SELECT a.l AS truth, b.l AS prediction, count(ruled.id) AS "count" FROM names a CROSS JOIN names b
        LEFT JOIN ruled ON (truth = a.l AND by_words = b.l) GROUP BY ALL""",
    "class_report": report(),
    "metrics_summary": f"WITH {RULES}, {scored('by_words')} SELECT {summary()}",
    "experiment_compare": f"""WITH {RULES}, {scored('by_words', '1')}, {scored('by_length', '2')}
        SELECT 'words' AS experiment, {summary('1')} UNION ALL SELECT 'length' AS experiment, {summary('2')}""",
    "folder_corpus": f"""SELECT concat('label ', page_id % 7, '/', page_id, '_processed.txt') AS doc_id,
        concat('label ', page_id % 7) AS emotion, md5({STRIPPED}) AS text_md5 FROM pages
        WHERE page_id % 10 > 2 AND {STRIPPED} <> ''""",
    "folder_statistics": f"""SELECT concat('label ', page_id % 7, '/', page_id, '_processed.txt') AS doc_id,
        concat('label ', page_id % 7) AS emotion, CASE WHEN page_id % 10 IN (0, 2) THEN 0 ELSE
        len(list_filter(string_split_regex({STRIPPED}, '[{WS}]+'), lambda x: x <> '')) END::BIGINT AS word_count
        FROM pages WHERE page_id % 10 <> 1""",
    "folder_quarantine": f"""SELECT concat('label ', page_id % 7) AS emotion, concat(page_id, '_processed.txt') AS file_name,
        'not valid UTF-8' AS reason, strlen(coalesce(url, ''))::BIGINT AS byte_position, strlen(coalesce(url, ''))::BIGINT + 2 AS n_bytes
        FROM pages WHERE page_id % 10 = 1""",
    "folder_listing": """SELECT concat('label ', page_id % 7) AS emotion, concat(page_id, '_processed.txt') AS file_name,
        (CASE page_id % 10 WHEN 0 THEN 0 WHEN 1 THEN strlen(coalesce(url, '')) + 2 WHEN 2 THEN 2
            ELSE strlen(coalesce(url, '')) + 3 END)::BIGINT AS size FROM pages""",
    "corpus_table": f"SELECT doc_id, lang, md5({clean('text')}) AS text_md5 FROM documents",
    "report_csv": report(),
    "distinctive_csv": f"""WITH {distinctive(**NOSTOP)} SELECT * FROM dist WHERE round(distinctiveness, 12) > 0
        AND NOT regexp_full_match(word, '\\p{{Nd}}+') AND regexp_matches(word, '[a-zA-Z]') AND length(word) > 1""",
    "vocabulary_merged": f"""WITH {corpus()} SELECT label AS lang, count(DISTINCT term) AS vocabulary_size, true AS within_bound
        FROM terms GROUP BY 1""",
    "stream_clean_ingest": f"SELECT doc_id, {clean('text')} AS text, lang FROM documents",
}
