"""Language ID, n-gram join, suffix dedup, BPE and token files against brute force."""

import hashlib
import random
import re
import tracemalloc
import types
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lexitally.llm import bpe, language, ngram_join, queries, suffix_dedup, token_files
from lexitally.llm.common import connected_components, slices, utf8

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def frame(spark, texts, schema="doc_id long, text string"):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], schema).repartition(3)


def given_documents(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet").collect()


# --- helpers


def test_slices_and_bytes():
    data, offsets = utf8(pa.array(["é", None, "", "abc"]))
    assert data.tobytes().decode() == "éabc" and offsets.tolist() == [0, 2, 2, 2, 5]
    data, offsets = utf8(pa.array(["x", "é", "yz"]).slice(1))
    assert data.tobytes().decode() == "éyz"
    sizes = [0, 5, 100, 0, 3, 3, 50]
    cuts = list(slices(np.concatenate(([0], np.cumsum(sizes))), 10))
    assert [a for a, _ in cuts[1:]] == [b for _, b in cuts[:-1]] and cuts[0][0] == 0 and cuts[-1][1] == len(sizes)


def test_components_of_chains_hubs_and_nothing(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(100, 140)] + [(7, x) for x in range(1000, 1200)] + [(5, 5)]
    edges += [(rng.randrange(2000, 2300), rng.randrange(2000, 2300)) for _ in range(200)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    rng.shuffle(edges)
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(edges, "x long, y long").repartition(5)).collect()}
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: root(x) for x in linked}
    assert connected_components(spark.createDataFrame([], "x long, y long")).isEmpty()


# --- language ID


def test_language_id_on_held_out_documents(spark):
    rows = queries.op6_language_id(spark, "/root/testdata/sf0.01").collect()
    truth = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    assert len(rows) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) >= 0.97
    assert all(0 <= r.score <= 1 for r in rows)
    assert sum(r.accepted for r in rows) / len(rows) >= 0.99


def test_language_id_of_odd_rows(spark):
    words = {"en": "the of and with them", "fr": "les des dans avec une"}
    train = [(i, " ".join(random.Random(i).choices(words[x].split(), k=12)), x, "s", 1) for i, x in enumerate(["en", "fr"] * 40)]
    docs = spark.createDataFrame(train, SCHEMA)
    model = language.fit(docs)
    odd = [(100, None, None, "s", 1), (101, "", None, "s", 1), (102, "12 %", None, "s", 1), (103, "the and of " * 200_000, "en", "s", 1), (104, "les", None, "s", 1)]
    clash = spark.createDataFrame(odd, SCHEMA).withColumns({"score": F.lit("x"), "lang_pred": F.lit(1), "z": F.lit(2)})
    got = {r.doc_id: r for r in language.identify(clash, model).collect()}
    assert [got[i].lang_pred for i in range(100, 103)] == ["und"] * 3 and [got[i].score for i in range(100, 103)] == [0.0] * 3
    assert got[103].lang_pred == "en" and got[103].score > 0.9 and got[104].lang_pred == "fr" and got[103].z == 2
    nothing = language.fit(docs.limit(0))
    assert {r.lang_pred for r in language.identify(docs, nothing).collect()} == {"und"}
    assert language.identify(docs.limit(0), model).isEmpty()


def test_language_id_rejects_letters_of_no_learned_language(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rng = random.Random(5)
    letters = [" ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(4, 9))) for _ in range(n)) for n in (3, 10, 40, 400)]
    other = ["это совсем другой язык и другие слова", "αυτή είναι μια άλλη γλώσσα", "これは別の言語です", "xqzj kvwq zzxj qqkp"]
    odd = spark.createDataFrame([(i, t, None, "s", 1) for i, t in enumerate(letters + other)], SCHEMA)
    for few in (["en"], ["en", "fr"], ["de", "en", "es", "fr"]):
        of = rows.where(F.col("lang").isin(few))
        model = language.fit(of, where=~queries.held_out())
        assert not any(r.accepted for r in language.identify(odd, model).collect())
        kept = [r.accepted for r in language.identify(of, model, keep=["doc_id"]).where("lang_pred != 'und'").collect()]
        assert sum(kept) / len(kept) >= 0.99


def test_training_rows_are_bounded_and_ids_do_not_matter(spark):
    docs = spark.createDataFrame([(i, "the of " * (i % 5 + 1), "en", "s", 1) for i in range(50)] + [(50, "les des", "fr", "s", 1), (51, "les", None, "s", 1)], SCHEMA)
    model = language.fit(docs, rows_per_label=10)
    assert model.languages == ["en", "fr"]


# --- n-gram join


def jaccard_brute(texts, words, percent):
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = {}
    for i, t in texts.items():
        w = re.findall("[^\x20\x09-\x0d]+", (t or "").translate(low))
        sets[i] = {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set()
    parent = {i: i for i in texts}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(texts)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


def near_copies(seed, n):
    rng = random.Random(seed)
    vocabulary = [f"W{i}" for i in range(60)]
    out = []
    while len(out) < n:
        base = rng.choices(vocabulary, k=rng.choice([1, 3, 4, 8, 40, 90]))
        for _ in range(rng.choice([1, 1, 2, 6])):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2])):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            out.append(rng.choice([" ", "\n", "  "]).join(copy).replace("W", rng.choice("Ww")))
    return out[:n]


@pytest.mark.parametrize("words,percent,chunk", [(4, 85, 256), (5, 80, 2)])
def test_ngram_join_equals_all_pairs(spark, monkeypatch, words, percent, chunk):
    monkeypatch.setattr(ngram_join, "CHUNK", chunk)
    texts = dict(enumerate([None, "", " \t\n", "One", "one", *near_copies(words, 120), "x y " * 3000, "x y " * 3000 + "z"]))
    docs = frame(spark, list(texts.values())).withColumns({"n": F.lit("n"), "rep": F.lit(0), "component_id": F.lit(1)})
    got = {r.id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_classes(docs, words=words, percent=percent).collect()}
    assert got == jaccard_brute(texts, words, percent)


def test_ngram_join_on_the_given_table_and_odd_tables(spark):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op9_ngram_join(spark, FOLDER).collect()}
    assert got == jaccard_brute({r.doc_id: r.text for r in given_documents(spark)}, 4, 85)
    none = spark.createDataFrame([], "doc_id long, text string")
    assert ngram_join.jaccard_classes(none).isEmpty()
    twice = spark.createDataFrame([(1, "a b c d e"), (1, "a b c d e"), (None, "a b c d e"), (2, "a b c d e")], "doc_id long, text string")
    rows = sorted(map(tuple, ngram_join.jaccard_classes(twice).na.fill(-1).collect()))
    assert rows == [(-1, 2, -1), (1, 2, 1), (1, 2, 1), (2, 2, 1)]


def test_ngram_join_of_ids_that_repeat_with_other_texts(spark):
    """As many rows as texts, each with the smallest id of its component, as all pairs of rows give it."""
    texts = near_copies(8, 90)
    rng = random.Random(8)
    ids = [rng.randrange(30) for _ in texts]
    a, b = (" ".join(f"{c}{k}" for k in range(40)) for c in "pq")
    ids, texts = [*ids, 101, 101, 105, 107, 106, None], [*texts, a, b, a, a + " end", b + " end", a]
    docs = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string").repartition(4)
    got = Counter((r.id, r.n_shingles, r.component_id) for r in ngram_join.jaccard_classes(docs, words=4, percent=85).collect())
    parts = jaccard_brute({k: t for k, t in enumerate(texts[:-1])}, 4, 85)
    least = {}
    for k, (_, part) in parts.items():
        least[part] = min(least.get(part, ids[k]), ids[k])
    want = Counter((ids[k], n, least[part]) for k, (n, part) in parts.items())
    assert got == want + Counter([(None, 37, None)])
    assert {(101, 101), (105, 101), (107, 101), (106, 101)} <= {(i, c) for i, _, c in got}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sets(st.integers(0, 12), max_size=9), max_size=8), st.sets(st.integers(0, 12), min_size=1, max_size=9), st.sampled_from([50, 80, 100]))
def test_trie_finds_what_all_pairs_find(sets, probe, percent):
    arrays = [np.array(sorted(s), np.uint64) for s in sets]
    trie = ngram_join.Trie(arrays, lambda s: s.tolist())
    found = sorted(trie.alike(np.array(sorted(probe), np.uint64), percent))
    assert found == [i for i, s in enumerate(sets) if 100 * len(s & probe) >= percent * len(s | probe)]


def test_meetings_find_every_pair_that_could_be_alike(spark, monkeypatch):
    """Cells of few classes, against all pairs of an n-gram; only pairs whose sets differ too much are left out."""
    monkeypatch.setattr(ngram_join, "MEET", 4)
    rng = np.random.default_rng(5)
    sets = {0: rng.integers(0, 1 << 63, 90, dtype=np.uint64)}
    for k in range(1, 60):
        old = sets[int(rng.integers(0, k))].copy()
        old = old[int(rng.integers(0, 12)) :]
        sets[k] = np.unique(np.append(old, rng.integers(0, 1 << 63, int(rng.integers(0, 12)), dtype=np.uint64)))
    part = {k: int(rng.integers(0, 9)) for k in sets}
    members = {g: sorted(rng.choice(60, int(size), replace=False).tolist()) for g, size in enumerate([2, 3, 5, 17, 60, 1, 8])}
    rows = [(g, len(ks), k, len(sets[k]), part[k], ngram_join.parity_map(sets[k]).tobytes()) for g, ks in members.items() for k in ks]
    posts = spark.createDataFrame(rows, "gram long, many long, rep long, n int, component long, map binary").repartition(7)
    met = ngram_join._meetings(posts, 85).collect()
    got = {(r.hub, r.member) for r in met}
    assert len(got) == len(met) and all((r.n, r.m) == (len(sets[r.hub]), len(sets[r.member])) for r in met)
    assert all(r.c == sum(r.hub in ks and r.member in ks for ks in members.values()) for r in met)
    pairs = {(a, b) for ks in members.values() for a in ks for b in ks if a < b and part[a] != part[b]}
    alike = {(a, b) for a, b in pairs if 100 * len(set(sets[a]) & set(sets[b])) >= 85 * len(set(sets[a]) | set(sets[b]))}
    assert alike and alike <= got <= pairs and len(got) < len(pairs)


# --- suffix dedup


@settings(max_examples=150, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=40).map(lambda b: bytes(x % 3 for x in b)), min_size=1, max_size=5), st.integers(1, 6), st.booleans())
def test_suffix_array_and_repeated_starts(parts, length, deep):
    old = suffix_dedup.MOST_SYMBOLS, suffix_dedup.SHORT
    try:
        if deep:
            suffix_dedup.MOST_SYMBOLS, suffix_dedup.SHORT = 3, 2
        text = b"".join(parts)
        order = suffix_dedup.suffix_array(np.frombuffer(text, np.uint8), 256).tolist()
        assert order == sorted(range(len(text)), key=lambda i: text[i:])
        seen = Counter(p[i : i + length] for p in parts for i in range(len(p) - length + 1))
        want = [[i for i in range(len(p) - length + 1) if seen[p[i : i + length]] > 1] for p in parts]
        assert [x.tolist() for x in suffix_dedup.repeated_starts(parts, length)] == want
    finally:
        suffix_dedup.MOST_SYMBOLS, suffix_dedup.SHORT = old


def repeats_brute(texts, length):
    raw = {i: (t or "").encode() for i, t in texts.items()}
    seen = Counter(t[k : k + length] for t in raw.values() for k in range(len(t) - length + 1))
    out = {}
    for i, t in raw.items():
        gone = bytearray(len(t))
        for k in range(len(t) - length + 1):
            if seen[t[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        kept = bytes(c for c, g in zip(t, gone) if not g)
        out[i] = (len(t), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest())
    return out


def removed(df):
    got = df.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("s")).collect()
    return {r.doc_id: tuple(r)[1:] for r in got}


@pytest.mark.parametrize("most_variants", [4096, 1])
def test_suffix_dedup_equals_counting_windows(spark, most_variants):
    rng = random.Random(3)
    passage = ["".join(rng.choices("abcdé ", k=60)) for _ in range(6)]
    texts = [None, "", "short", "é" * 100, "ab" * 300]
    for _ in range(60):
        texts.append("".join(rng.choice(passage)[rng.randrange(20) :] if rng.random() < 0.3 else "".join(rng.choices("abcdefgh\0", k=30)) for _ in range(rng.randrange(12))))
    texts += [texts[20], texts[20]]
    docs = frame(spark, texts).withColumns({"kept": F.lit(1), "w": F.lit("x"), "id": F.lit(5), "a": F.lit(1)})
    got = suffix_dedup.remove_repeats(docs, length=40, most_variants=most_variants)
    assert removed(got) == repeats_brute(dict(enumerate(texts)), 40)
    assert {"w", "id", "a"} < set(got.columns)


def test_suffix_dedup_on_the_given_table_and_odd_tables(spark):
    got = {r.doc_id: tuple(r)[1:] for r in queries.op5_suffix_dedup(spark, FOLDER).collect()}
    assert got == repeats_brute({r.doc_id: r.text for r in given_documents(spark)}, 400)
    assert suffix_dedup.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).isEmpty()
    same = spark.createDataFrame([(1, "x" + "é" * 30), (1, "y" + "é" * 30), (None, "z")], "doc_id long, text string")
    rows = suffix_dedup.remove_repeats(same, length=41, as_text=True).collect()
    assert sorted((r.doc_id or 0, r.kept, r.n_removed) for r in rows) == [(0, "z", 0), (1, "x", 60), (1, "y", 60)]


def test_suffix_dedup_takes_little_memory_for_a_shard():
    rng = np.random.default_rng(5)
    base = bytes(rng.integers(97, 120, 1500).astype(np.uint8))
    parts = [base[k : k + 700] for k in rng.integers(0, 800, 700).tolist()]
    tracemalloc.start()
    try:
        suffix_dedup.repeated_starts(parts, 400)
        assert tracemalloc.get_traced_memory()[1] < 55 * sum(map(len, parts))
    finally:
        tracemalloc.stop()


def test_suffix_dedup_gives_an_anchor_with_much_to_compare_its_own_shard(spark, monkeypatch, tmp_path):
    run, note = suffix_dedup._shard, str(tmp_path / "sizes")

    def watched(length):
        def shard(pdf):
            with open(note, "a") as f:
                f.write(f"{sum(map(len, pdf['bytes']))}\n")
            return run(length)(pdf)

        return shard

    rng = random.Random(6)
    near = ["".join(rng.choices("abcdef", k=30)) for _ in range(8)]
    texts = [near[k % 8] + "".join(rng.choices("ghij", k=3)) for k in range(160)] + [None, ""]
    want = repeats_brute(dict(enumerate(texts)), 24)
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", 2000)
    monkeypatch.setattr(suffix_dedup, "_shard", watched)
    assert removed(suffix_dedup.remove_repeats(frame(spark, texts), length=24)) == want
    with open(note) as f:
        sizes = [int(x) for x in f]
    # more shards than the bytes alone would give, and none is larger than asked
    assert len(sizes) > -(-sum(sizes) // 2000) and max(sizes) <= 2000


# --- BPE


PIECES = ["'s", "'re", "'ll", "'", " ", "  ", "\n", "\t", "a", "Zeta", "é", "½", "٣", "!", "…", "\u00a0", "\u0301", "日本", "😀", "<|endoftext|>", "<|endo", "'S", "\x85", "\x1c", "\U0001e5fa", "1", "23"]


def test_words_merged_side_by_side_are_those_merged_alone():
    rules, rng = bpe.merges(BYTE), random.Random(4)
    words = ["", " ", "a", "é", "😀", " the", "aaaaaaa", "x" * 33, "ab" * 200]
    words += ["".join(rng.choices(["a", "b", "th", "e", "ing", " ", "é", "日", "1", "'"], k=rng.randrange(20))) for _ in range(6000)]
    alone = []
    for word in words:
        alone.append(rules.merge(word))
    assert rules.merge_many(words) == alone
    assert rules.merge_many([]) == []


def test_words_and_merges_equal_the_library():
    library, rules = Tokenizer.from_file(BYTE), bpe.merges(BYTE)
    rng = random.Random(8)
    for n in range(3000):
        text = "".join(rng.choices(PIECES, k=rng.randrange(14)))
        ids = []
        for plain, special in bpe._pieces(text, rules.special):
            ids += [i for w in bpe.words(plain) for i in rules.merge(w)] + [special] * (special is not None)
        want = library.encode(text, add_special_tokens=False).ids
        assert ids == want, repr(text)
        assert bpe.decode_ids(ids, BYTE) == library.decode(want, skip_special_tokens=False)
    for word in ("a" * 3000, "".join(rng.choices("abtheringé", k=700))):
        assert rules.merge(word) == library.encode(word, add_special_tokens=False).ids


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.binary(min_size=1, max_size=6).map(lambda b: bytes(x % 4 for x in b)), st.lists(st.integers(0, 50_000), max_size=4), max_size=40))
def test_lexicon_holds_its_words_and_no_others(entries):
    lexicon = bpe.Lexicon(bpe.compile_lexicon(entries.items()))
    keys = [*entries, b"\x09", b"\0" * 9, b""]
    found = lexicon.find(keys).tolist()
    assert [lexicon.output(n) if n >= 0 else None for n in found] == [entries.get(k) for k in keys]


def test_lexicon_shares_endings():
    words = [(f"{a}{b}ing".encode(), [1]) for a in "abcdefgh" for b in "abcdefgh"]
    assert len(bpe.Lexicon(bpe.compile_lexicon(words)).final) == 6


def test_lexicon_is_collected_and_compiled_in_little_memory(spark):
    """The pipeline's driver held a Python object per word, id and state: 250 MB more for a full lexicon."""
    words = sorted({hashlib.sha256(str(i).encode()).hexdigest()[: 3 + i % 6] for i in range(20_000)})
    entries = [(w.encode(), [k, k + 1]) for k, w in enumerate(words)]
    table = bpe.lexicon_table(entries)
    tracemalloc.start()
    block = bpe.compile_lexicon(table)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    lexicon = bpe.Lexicon(block)
    assert [lexicon.output(n) for n in lexicon.find([w for w, _ in entries]).tolist()] == [i for _, i in entries]
    assert most < 600 * len(words)
    found = bpe.frequent_words(frame(spark, ["a b a", "b"]).select("text"), BYTE)
    assert isinstance(found, pa.Table) and sorted(found["word"].to_pylist()) == [b" a", b" b", b"a", b"b"]


def test_bpe_equals_the_library(spark, monkeypatch):
    library = Tokenizer.from_file(BYTE)
    docs = queries.op8_bpe(spark, FOLDER).collect()
    want = {}
    texts = {r.doc_id: r.text for r in given_documents(spark)}
    for i, text in texts.items():
        ids = library.encode(text or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        want[i] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest())
    assert {r.doc_id: tuple(r)[1:] for r in docs} == want
    monkeypatch.setattr(bpe, "MEMORY", 10)
    odd = [None, "", "a<|endoftext|>b", "word " * 100_000, "é\0\n"]
    clash = frame(spark, odd).withColumns({"ids": F.lit(1), "x": F.lit(2), "decoded": F.lit(3), "word": F.lit(4)})
    got = {r.doc_id: r for r in bpe.encode(clash, BYTE, decode=True, most=3).collect()}
    for i, text in enumerate(odd):
        assert got[i].ids == ",".join(map(str, library.encode(text or "", add_special_tokens=False).ids)) and got[i].decoded == (text or "")
    assert bpe.encode(clash.limit(0), BYTE).isEmpty()


# --- token files


def test_token_files_round_trip(spark, tmp_path):
    library = Tokenizer.from_file(WORD)
    odd = [None, "", "A<|startoftext|>B c", "Ünï\u00a0CODE\u2003x\x85y", "word " * 60_000, "'s it's ΑΣ ΑΣ"]
    texts = odd + [r.text for r in given_documents(spark)]
    docs = frame(spark, texts).withColumns({"id": F.lit(1), "n": F.lit(1), "frame": F.lit(1)})
    files = token_files.write_tokens(docs, str(tmp_path / "t"), WORD).collect()
    assert sum(r.documents for r in files) == len(texts)
    table = spark.createDataFrame(files)
    got = {r.doc_id: tuple(r)[1:] for r in token_files.read_tokens(table, str(tmp_path / "t")).collect()}
    at, want = 0, {}
    for i, text in enumerate(texts):
        ids = library.encode(text or "", add_special_tokens=False).ids + [2]
        want[i] = (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert got == want
    one = token_files.TokenFile(str(tmp_path / "t"), next(r.file for r in files if r.first_id == 0))
    assert one.ids[0] == 0 and one.document(0).tolist() == [2]
    (tmp_path / "t" / token_files.DICTIONARY).write_bytes(b"other")
    with pytest.raises(ValueError, match="another dictionary"):
        token_files.TokenFile(str(tmp_path / "t"), files[0].file)


def test_token_files_of_odd_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert token_files.round_trip(none, WORD).isEmpty()
    rows = spark.createDataFrame([(None, "x"), (3, "a b"), (3, "a b"), (3, "a")], "doc_id long, text string")
    got = sorted(token_files.round_trip(rows, WORD).collect(), key=lambda r: r.start)
    assert [r.n_tokens for r in got] == [2, 2, 3, 3] and [r.start for r in got] == [0, 2, 4, 7]


def test_clashing_and_dotted_names(spark):
    """Language ID and BPE keep columns whatever their names are."""
    docs = spark.createDataFrame([(i, f"some text {i}", "en" if i % 2 else "de") for i in range(30)], "doc_id long, text string, lang string")
    odd = docs.withColumns({"__text": F.lit(1), "__letters": F.lit(2), "a.b": F.col("doc_id"), "in_0": F.lit(4), "ids": F.lit(5)})
    model = language.fit(odd, epochs=1)
    found = language.identify(odd, model).collect()
    assert sorted(r["a.b"] for r in found) == list(range(30)) and {(r["__text"], r["__letters"], r["in_0"]) for r in found} == {(1, 2, 4)}
    coded = bpe.encode(odd, BYTE, decode=True).collect()
    assert all(r.decoded == f"some text {r['a.b']}" and r["__text"] == 1 and r["in_0"] == 4 for r in coded)


def test_language_sample_is_bounded_in_bytes(spark):
    """Whole texts up to the bound, a label's first row in any case; a fit on them does not fail."""
    docs = spark.createDataFrame([(i, "wort " * 2000, "de") for i in range(8)] + [(9, "word", "en")], "doc_id long, text string, lang string")
    model = language.fit(docs, bytes_per_label=25_000)
    assert model.languages == ["de", "en"]


def test_special_tokens_in_any_number():
    special = {"<|a|>": 1, "<|ab|>": 2, "|>": 3}
    text = "x<|ab|>" + "<|a|>|>y" * 3
    assert list(bpe._pieces(text, special)) == [("x", 2), ("", 1), ("", 3), ("y", 1), ("", 3), ("y", 1), ("", 3), ("y", None)]


def test_bpe_decodes_a_word_once(monkeypatch):
    """op8_bpe: what a word's ids decode to was looked up token by token in every text."""

    class Counted(dict):
        asked = 0

        def __getitem__(self, key):
            Counted.asked += 1
            return super().__getitem__(key)

    rules = bpe.merges(BYTE)
    monkeypatch.setattr(rules, "by_name", Counted(rules.by_name))
    block = bpe.compile_lexicon([(w, rules.merge(w.decode())) for w in (b"Hello", b" over")])
    handle = types.SimpleNamespace(digest="counted", open=lambda: bpe.Lexicon(block))
    text = "Hello over there, unfathomable zxqj é世<|endoftext|>"
    batch = pa.RecordBatch.from_pydict({"text": [text * 50, None, ""] * 4, "kept": list(range(12))})
    out = pa.Table.from_batches(bpe._encode(BYTE, handle, True)(iter([batch]))).to_pydict()
    whole = Tokenizer.from_file(BYTE)
    want = [whole.encode(t or "", add_special_tokens=False).ids for t in batch.column(0).to_pylist()]
    assert out["new_0"] == [",".join(map(str, ids)) for ids in want]
    assert out["new_1"] == [whole.decode(ids, skip_special_tokens=False) for ids in want]
    assert Counted.asked < sum(map(len, want)) / 5
