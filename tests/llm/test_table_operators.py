"""Vector search, near-dedup, mixture, URL filter, sharding and the pipeline against brute force."""

import random
import re
import sys
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from compare import difference, oracle  # noqa: E402

from lexitally.llm import forest, mixture, queries, sharding, small_world, url_filter  # noqa: E402

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
@pytest.mark.parametrize("folder", [FOLDER, "/root/testdata/sf0.01"])
def test_sql_twins(spark, name, folder):
    assert difference(queries.QUERIES[name](spark, folder), oracle(folder), queries.ORACLES[name]) is None


def test_thirteen_operators_are_registered():
    assert [int(re.match(r"op(\d+)_", q)[1]) for q in queries.QUERIES] == list(range(1, 14))


# --- vectors


def vectors(spark, rows, kind="array<double>"):
    return spark.createDataFrame(rows, f"vec_id long, embedding {kind}, label int").repartition(3)


def clustered(seed, n, dim=8):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((max(2, n // 6), dim))
    x = centres[rng.integers(0, len(centres), n)] + 0.15 * rng.standard_normal((n, dim))
    x[n // 2] = x[n // 3]
    return x * rng.uniform(0.5, 2, (n, 1))


ODD = [(9000, None, 0), (9001, [0.0] * 8, 0), (9002, [None] * 8, 0), (9003, [float("nan")] * 8, 0), (9004, [float("inf")] * 8, 0), (9005, [1.0] * 3, 0)]


def test_forest_finds_the_neighbours(spark, monkeypatch):
    monkeypatch.setattr(forest, "BLOCK", 50)
    monkeypatch.setattr(forest, "QUERY_BLOCK", 4)
    monkeypatch.setattr(forest, "LEAF", 24)
    x = clustered(1, 400)
    df = vectors(spark, [(i, v.tolist(), 0) for i, v in enumerate(x)] + ODD).withColumns({"id": F.lit(1), "vec": F.lit(2), "rank": F.lit(3)})
    got = {}
    for r in forest.neighbours(df, F.col("vec_id") % 20 == 0, k=20).collect():
        got.setdefault(r.query_id, []).append(r)
    assert set(got) == set(range(0, 400, 20))
    hit = 0
    for i, rows in got.items():
        rows.sort(key=lambda r: r["rank"])
        scores = [sum(a * b for a, b in zip(x[i].tolist(), v.tolist())) for v in x]
        want = sorted((j for j in range(400) if j != i), key=lambda j: (-scores[j], j))[:20]
        hit += len({r.vec_id for r in rows} & set(want))
        assert [r["rank"] for r in rows] == list(range(1, 21))
        assert all(r.score == pytest.approx(scores[r.vec_id], abs=1e-12) for r in rows)
        assert [(-r.score, r.vec_id) for r in rows] == sorted((-r.score, r.vec_id) for r in rows)
    assert hit / 400 >= 0.9


def test_forest_of_few_or_equal_rows(spark):
    same = vectors(spark, [(i, [1.0, 2.0], 0) for i in range(0, 60, 5)])
    rows = forest.neighbours(same, F.col("vec_id") % 20 == 0, k=20).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in rows if r.query_id == 0) == [(0, k + 1, 5 * (k + 1)) for k in range(11)]
    assert forest.neighbours(vectors(spark, ODD[:5]), F.col("vec_id") % 20 == 0).isEmpty()
    assert forest.neighbours(vectors(spark, []), F.col("vec_id") % 20 == 0).isEmpty()


def test_forest_recall_on_the_given_table(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()
    x = {r.vec_id: np.array(r.embedding, np.float64) for r in rows}
    got, hit, total = {}, 0, 0
    for r in queries.op1_forest(spark, "/root/testdata/sf0.01").collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    for i in x:
        if i % 20 == 0:
            want = sorted((j for j in x if j != i), key=lambda j: (-float(x[i] @ x[j]), j))[:20]
            hit, total = hit + len(got[i] & set(want)), total + 20
    assert hit / total >= 0.9


def dedup_brute(x, bound):
    ids = sorted(x)
    unit = {i: np.array(x[i]) / np.linalg.norm(x[i]) for i in ids}
    links, parent = Counter(), {i: i for i in ids}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for n, a in enumerate(ids):
        for b in ids[:n]:
            if float(unit[a] @ unit[b]) >= bound:
                links[a] += 1
                links[b] += 1
                p, q = root(a), root(b)
                parent[max(p, q)] = min(p, q)
    return {i: (links[i], root(i), root(i) == i) for i in ids}


def test_small_world_equals_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(small_world, "COUNT_BLOCK", 16)
    monkeypatch.setattr(small_world, "BLOCK", 64)
    x = {i: v.tolist() for i, v in enumerate(clustered(2, 300))}
    x |= {1000 + i: x[0] for i in range(40)}
    df = vectors(spark, [(i, v, 0) for i, v in x.items()] + ODD + [(None, [1.0] * 8, 0)]).withColumns({"rep": F.lit(1), "kept": F.lit(2), "copies": F.lit(3)})
    got = {r.vec_id: tuple(r)[1:] for r in small_world.near_duplicates(df, shards=3).collect()}
    assert got == dedup_brute(x, 0.9) | {i: (0, i, True) for i, _, _ in ODD} | {None: (0, None, False)}
    assert small_world.near_duplicates(vectors(spark, [])).isEmpty()
    assert [tuple(r) for r in small_world.near_duplicates(vectors(spark, ODD[:1])).collect()] == [(9000, 0, 9000, True)]


def test_small_world_of_ids_that_repeat(spark):
    """As many rows as vectors, whether an id repeats with the same vector or another."""
    x = clustered(7, 80)
    rng = random.Random(7)
    ids = [rng.randrange(30) for _ in x] + [501, 501, 502, 503, 505, 505, 500]
    x = [v.tolist() for v in x] + [x[0].tolist()] * 2 + [x[1].tolist(), (-x[1]).tolist(), x[0].tolist(), (-x[0]).tolist(), (-x[0]).tolist()]
    df = vectors(spark, [*[(i, v, 0) for i, v in zip(ids, x)], (None, [1.0] * 8, 0), (501, None, 0), (506, None, 0)])
    of_row = dedup_brute(dict(enumerate(x)), 0.9)
    least = {}
    for k, (_, part, _) in of_row.items():
        least[part] = min(least.get(part, ids[k]), ids[k])
    want = Counter((ids[k], n, least[part], ids[k] == least[part]) for k, (n, part, _) in of_row.items())
    want += Counter([(None, 0, None, False), (501, 0, 501, True), (506, 0, 506, True)])
    assert Counter(map(tuple, small_world.near_duplicates(df, shards=3).collect())) == want


def test_small_world_audits_tables_of_few_links(spark, monkeypatch):
    """Without a link to audit, a beam that finds too little is noticed all the same."""
    rng = np.random.default_rng(9)
    x = rng.standard_normal((900, 12))
    far = small_world._unit(x) @ small_world._unit(x).T - 2 * np.eye(900)
    x = x[(far < 0.9).all(axis=1)]
    df = vectors(spark, [(i, v.tolist(), 0) for i, v in enumerate(x)])
    widths, audit = [], small_world._audited_width
    monkeypatch.setattr(small_world, "FIRST_WIDTH", 1)
    monkeypatch.setattr(small_world, "_audited_width", lambda *a: widths.append(audit(*a)) or widths[-1])
    assert all(r.kept and r.n_links == 0 for r in small_world.near_duplicates(df, shards=2).collect())
    assert widths[0] > 1
    monkeypatch.setattr(small_world, "AUDIT", 200)
    pairs = [(2000 + k, (x[k] + 0.05 * rng.standard_normal(12)).tolist(), 0) for k in (10, 300, 700)]
    rows = small_world.near_duplicates(df.union(vectors(spark, pairs)), shards=2).collect()
    assert {(r.vec_id, r.component_id) for r in rows if r.n_links} == {(i, k) for k in (10, 300, 700) for i in (k, 2000 + k)}


def test_small_world_widens_its_beams():
    rng = np.random.default_rng(4)
    x = rng.standard_normal((900, 16))
    x[:400] = x[0] + 0.05 * rng.standard_normal((400, 16))
    x = small_world._unit(x)
    graph = small_world._load(x, small_world._save(small_world.Graph(x)))
    q, n = graph.near(x[:5], 16, 0.9)
    assert Counter(q.tolist()) == Counter({i: int((x @ x[i] >= 0.9).sum()) for i in range(5)})


# --- mixture


def shares(spark, leaves, weights, share, epochs, levels):
    df = spark.createDataFrame(leaves, [*levels, "tokens"])
    return {tuple(r[c] for c in levels): r.given for r in mixture.plan(df, levels, weights, share, epochs).collect()}


def test_shortages_go_to_siblings_first(spark):
    leaves = [("a", "x", 100), ("a", "y", 10), ("b", "x", 1000), ("b", "y", 1000)]
    # a may have half of 400, but holds 110: y is full, x gets the rest of a; b takes what a cannot.
    assert shares(spark, leaves, {}, (400, 2110), 1, ["d", "s"]) == {("a", "x"): 100, ("a", "y"): 10, ("b", "x"): 145, ("b", "y"): 145}
    # a's share of 100 fits: y's shortage stays inside a.
    got = shares(spark, leaves, {"d": {"b": 3}}, (400, 2110), 1, ["d", "s"])
    assert got == {("a", "x"): 90, ("a", "y"): 10, ("b", "x"): 150, ("b", "y"): 150}
    # Two epochs double what a leaf holds; a budget beyond that is all there is.
    assert sum(shares(spark, leaves, {}, (10, 1), 2, ["d", "s"]).values()) == 2 * 2110


def test_shares_add_up(spark):
    rng = random.Random(5)
    leaves = [(f"d{i % 3}", f"l{i % 5}", f"s{i}", rng.randrange(0, 500)) for i in range(40)]
    total = sum(x[3] for x in leaves)
    for num, den in ((1, 3), (7, 8), (1, 1)):
        got = shares(spark, leaves, {"d": {"d1": 7}, "l": {"l2": 3}}, (num, den), 1, ["d", "l", "s"])
        assert sum(got.values()) == total * num // den
        assert all(0 <= got[x[:3]] <= x[3] for x in leaves)


def test_mixture_of_odd_rows(spark):
    rows = [(i, "w " * (i % 7 + 1), "en" if i % 3 else None, f"s{i % 2}") for i in range(60)]
    rows += [(60, None, "en", None), (61, "", None, "s0"), (61, "", None, "s0"), (None, "w", "en", "s1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumns(
        {"whole": F.lit(1), "place": F.lit("p"), "tokens": F.lit(2), "mix_epoch": F.lit("old"), "n": F.lit(0)}
    )
    levels = {"lang": F.col("lang"), "source": F.col("source")}
    got = mixture.mix(docs, levels, share=(1, 2), epochs=2, seed=1)
    again = mixture.mix(docs.repartition(5), levels, share=(1, 2), epochs=2, seed=1)
    assert got.exceptAll(again).isEmpty() and again.exceptAll(got).isEmpty()
    tokens = sum(len((r[1] or "").split()) for r in rows)
    assert tokens // 2 <= sum(r.mix_tokens for r in got.collect()) <= tokens // 2 + 7 * 6
    everything = mixture.mix(docs, levels, share=(1, 1), epochs=1)
    assert everything.where("mix_tokens > 0").count() == 61
    assert mixture.mix(docs.limit(0), levels).isEmpty()


# --- URL filter


def judged(url, rules, default="allow"):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        raw = re.match(r"[^/?#]*", rest)[0]
        host = raw.translate({c: c + 32 for c in range(65, 91)})
        path = re.match(r"[^?#]*", rest[len(raw) :])[0]
    fit = [(len(h + p), len(h), h + p, v) for h, p, v in rules if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=(0, 0, None, default))
    return host, path, best[2], best[3]


def test_url_filter_equals_trying_every_rule(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "RANGE_ROWS", 40)
    rng = random.Random(6)
    labels = ["a", "b", "a-b", "example", "net", "com", "ab"]

    def host():
        return ".".join(rng.choices(labels, k=rng.randint(1, 4)))

    rules = {(host(), rng.choice(["/", "/en/", "/en/x", "/d"])): rng.choice(["block", "allow"]) for _ in range(60)}
    rules = [(h, p, v) for (h, p), v in rules.items()]
    urls = [f"http{rng.choice(['', 's'])}://{host().upper() if rng.random() < 0.2 else host()}{rng.choice(['', '/', '/en/', '/en/xy?a=/b', '#x/', '?q://a', '/d#'])}" for _ in range(800)]
    urls += ["http://hot.example.net/en/"] * 400 + [None, "", "no scheme", "://", "x://é.net/ü", "http://a..b/", "HTTP://NET", "http://net/" + "y" * 100_000]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").repartition(4)
    df = df.withColumns({"host": F.lit("x"), "verdict": F.lit("y"), "first": F.lit(1), "n": F.lit(2)})
    listed = spark.createDataFrame([*rules, (None, "/", "block"), ("", "/", "block")], "host string, path string, verdict string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(df, listed).collect()}
    assert got == {i: judged(u, rules) for i, u in enumerate(urls)}
    none = {r.verdict for r in url_filter.judge(df, listed.limit(0), default="block").collect()}
    assert none == {"block"} and url_filter.judge(df.limit(0), listed).isEmpty()


# --- sharding


def shards_of(df, shards):
    rows = df.collect()
    for s in range(shards):
        slots = sorted(r.slot for r in rows if r.shard == s)
        assert slots == list(range(len(slots)))
    return rows


def test_shards_are_even(spark):
    rows = shards_of(queries.op10_sharding(spark, "/root/testdata/sf0.01"), 8)
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    import zlib

    assert {(r.doc_id, r.size, r.text_crc32) for r in rows} == {(i, len(t.encode()) + 1, zlib.crc32(t.encode())) for i, t in texts.items()}
    assert {(r.law, r.grown_shard) for r in rows} == {("bytes", None)}
    total, largest = sum(r.size for r in rows), max(r.size for r in rows)
    sizes = Counter()
    for r in rows:
        sizes[r.shard] += r.size
    assert all(abs(sizes[s] - total / 8) <= 2 * (total / 8 * sharding.TOLERANCE + largest) for s in range(8))


def test_copies_stay_together_unless_they_are_too_many(spark):
    rows = [(i, f"text {i // 3}") for i in range(3000)]
    placed = shards_of(sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), 4, tolerance=0.02), 4)
    assert max(Counter(t for t, _ in {(r.text_crc32, r.shard) for r in placed}).values()) == 1
    hot = [(i, "hot" * 10 if i % 2 else f"text {i}" + " x" * 12) for i in range(2000)]
    placed = shards_of(sharding.shard(spark.createDataFrame(hot, "doc_id long, text string").repartition(5), 8), 8)
    sizes = Counter()
    for r in placed:
        sizes[r.shard] += r.size
    assert max(sizes.values()) <= 1.03 * min(sizes.values())


def test_sharding_of_odd_rows(spark):
    rows = [(1, None), (1, None), (None, ""), (2, "é" * 100_000), (3, "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"size": F.lit("x"), "key": F.lit(1), "id": F.lit(2), "slot": F.lit(3)})
    got = shards_of(sharding.shard(df, 8), 8)
    assert sorted(r.size for r in got) == [1, 1, 1, 2, 200_001] and {r.text_crc32 for r in got if r.size == 1} == {0}
    assert sharding.shard(df.limit(0), 8).isEmpty()


# --- the pipeline


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, kinds = docs.columns, docs.dtypes
    from test_text_operators import jaccard_brute, repeats_brute

    before = docs
    for (name, apply), number in zip(corpus_pipeline.STAGES, (6, 9, 5, 2, 8)):
        from lexitally.session import stage

        after, _ = stage(apply(spark, before, FOLDER))
        if number != 8:
            assert (after.columns, after.dtypes) == (columns, kinds), name
        old, new = {r.doc_id: r for r in before.collect()}, {r.doc_id: r for r in after.collect()}
        assert set(new) <= set(old)
        if number == 6:
            assert len(new) >= 0.98 * len(old)
        if number == 9:
            parts = jaccard_brute({i: r.text for i, r in old.items()}, 5, 80)
            assert set(new) == {i for i, (_, c) in parts.items() if i == c}
        if number == 5:
            left = repeats_brute({i: r.text for i, r in old.items()}, corpus_pipeline.PASSAGE)
            assert {i for i, x in left.items() if x[1] == 0} <= set(new)
            assert all(new[i].text == old[i].text for i in new if left[i][1] == 0)
            assert all(abs(len(new[i].text.encode()) - (left[i][0] - left[i][1])) <= 6 * left[i][2] for i in new)
        if number == 2:
            words = sum(len(re.findall("[^\x20\x09-\x0d]+", r.text)) for r in old.values())
            assert sum(len(re.findall("[^\x20\x09-\x0d]+", r.text)) for r in new.values()) >= words * 9 // 10
        if number == 8:
            assert set(new) == set(old) and all(r.n_tokens == r.ids.count(",") + 1 for r in new.values())
        before = after
    assert corpus_pipeline.run(spark, FOLDER).count() == before.count()


def test_pipeline_of_nothing(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0)
    for _, apply in corpus_pipeline.STAGES:
        docs = apply(spark, docs, FOLDER)
        assert docs.isEmpty()


def test_pipeline_keeps_one_row_of_repeated_and_null_ids(spark):
    import corpus_pipeline

    rng = random.Random(11)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(60)) for _ in range(7)]
    rows = [(4, texts[0]), (4, texts[0]), (4, texts[0]), (9, texts[0] + " end")]  # one group under a repeated id
    rows += [(5, texts[1]), (5, texts[2])]  # one id, unlike texts
    rows += [(None, texts[3]), (None, texts[4]), (None, texts[4]), (None, texts[5]), (2, texts[5])]
    rows += [(None, None), (6, ""), (6, ""), (8, texts[6])]
    docs = spark.createDataFrame([(i, t, "en", "s1", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    stay = corpus_pipeline.keep_one_of_alike(spark, docs, FOLDER)
    want = [(4, texts[0]), (5, texts[1]), (5, texts[2]), (None, texts[3]), (None, texts[4]), (2, texts[5]), (None, None), (6, ""), (6, ""), (8, texts[6])]
    assert Counter((r.doc_id, r.text) for r in stay.collect()) == Counter(want)
    left = corpus_pipeline.cut_repeats(spark, stay, FOLDER)
    assert Counter((r.doc_id, r.text) for r in left.collect()) == Counter(x for x in want if x[1])
