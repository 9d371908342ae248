"""Fill-in-middle, licence scan and conversation repair against brute force."""

import hashlib
import random
import re
import zlib
from functools import lru_cache

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexitally.llm import conversations, infill, licences, queries

FOLDER = "/root/testdata/sf0.001"


def frame(spark, texts, schema="doc_id long, text string"):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], schema).repartition(3)


# --- fill-in-middle


def cut(doc_id, text, seed=1, plain=10, spm=20):
    """Form, prefix and middle length and output, by slices of a Python string."""
    text = text or ""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(text)
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 100 - plain:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    if h[3] % 100 < spm:
        return n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}"


def test_cuts_and_restores_odd_texts(spark):
    rng = random.Random(12)
    texts = [None, "", "a", "<P>x", "x<M>", "<S", "$1\\2", "é😀\r\n x", "<" * 9, "\x85\n\n", "a<S><", "S>a<P"]
    texts += ["".join(rng.choice("ab<>PSM\n😀é \\$") for _ in range(rng.randrange(60))) for _ in range(300)]
    texts += ["x" * 4095, "é" * 4096, "😀" * 4097, "ab\n" * 70_000, "same", "same"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "no id"), (5, "twice"), (5, "twice")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    made = infill.rearrange(docs).withColumn("again", infill.restored(F.col("output"), F.col("form"))).collect()
    got = sorted(((r.doc_id, r.text, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in made), key=repr)
    assert got == sorted(((i, t, *cut(i, t)) for i, t in rows), key=repr)
    assert all(r.again == (r.text or "") for r in made)


def test_cut_shares_units_and_names(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("one two  three four five ").alias("text"))
    made = infill.rearrange(docs, plain=50, spm=50, unit=r"(?>\S+\s*+)")
    forms = {r.form: r["count"] for r in made.groupBy("form").count().collect()}
    assert 1800 < forms["plain"] < 2200 and 850 < forms["spm"] < 1150
    assert made.where("n <> 5").isEmpty() and made.where("prefix_chars + middle_chars > 5").isEmpty()
    assert made.where(~F.col("output").rlike(r"^(<[PSM]>(\S+\s+)*)+$") & (F.col("form") != "plain")).isEmpty()
    odd = frame(spark, ["text of it"]).withColumns({"__text": F.lit(1), "n": F.lit("old"), "a.b": F.lit(2), "__h3": F.lit(3)})
    row = infill.rearrange(odd).first()
    assert (row["n"], row["__text"], row["a.b"], row["__h3"]) == (10, 1, 2, 3)
    assert infill.rearrange(frame(spark, [])).isEmpty()


def test_fill_in_middle_query_on_given_documents(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").collect()
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = {d.doc_id: cut(d.doc_id, d.text) for d in docs}
    for r in queries.op12_fill_in_middle(spark, FOLDER).collect():
        n, form, a, m, output = want.pop(r.doc_id)
        assert (r.n, r.form, r.prefix_chars, r.middle_chars) == (n, form, a, m)
        assert r.output_sha256 == sha(output)
    assert not want


# --- licence scan


def plain_words(text):
    folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", folded)


def all_matches(ws, licence, long):
    """Matches of every text position by comparing with every licence position, longest per position, not extendable."""
    common = [[0] * (len(licence) + 1) for _ in range(len(ws) + 2)]
    for i, w in enumerate(ws, 1):
        for j, x in enumerate(licence, 1):
            common[i][j] = common[i - 1][j - 1] + 1 if w == x else 0
    longest = [max(row) for row in common]
    return [
        (i, j, longest[i])
        for i in range(1, len(ws) + 1)
        if longest[i] >= long and longest[i + 1] != longest[i] + 1
        for j in range(1, len(licence) + 1)
        if common[i][j] == longest[i]
    ]


def all_chains(matches, gap):
    """Best chain ending in each match over all earlier matches, then the best ones that share none."""
    best = []
    for i, (te, le, n) in enumerate(matches):
        ways = [(n, -1)]
        for j, (tp, lp, _) in enumerate(matches):
            shared = max(tp - te + n, lp - le + n, 0)
            if tp < te and lp < le and shared < n and te - n + shared - tp <= gap:
                ways.append((best[j][0] + n - shared, j))
        best.append(max(ways, key=lambda way: (way[0], -way[1])))
    out, used = [], set()
    for i in sorted(range(len(matches)), key=lambda i: (-best[i][0], i)):
        path = [i]
        while best[path[-1]][1] >= 0:
            path.append(best[path[-1]][1])
        if not used & set(path):
            used |= set(path)
            out.append((best[i][0], matches[path[-1]][0] - matches[path[-1]][2], matches[i][0]))
    return out


def plain_scan(text, notices, phrases, long, gap, cover):
    ws = plain_words(text)
    places = [
        (label, i) for phrase, label in phrases for n in [len(plain_words(phrase))] for i in range(len(ws)) if n and ws[i : i + n] == plain_words(phrase)
    ]
    spans, most = [], 0.0
    for label, notice in notices:
        licence = plain_words(notice)
        for covered, first, until in all_chains(all_matches(ws, licence, long), gap):
            most = max(most, covered / len(licence))
            if covered >= cover * len(licence):
                spans.append((label, first, until, covered / len(licence)))
    return len(ws), sorted(places), sorted(spans), most


def test_matching_statistics_and_chains_of_random_texts():
    rng = random.Random(11)
    for _ in range(400):
        letters = "abcdé"[: rng.randrange(2, 6)]
        make = lambda n: " ".join(rng.choice(letters) for _ in range(n))  # noqa: E731, B023
        notices = [(f"l{k}", make(rng.randrange(0, 15))) for k in range(rng.randrange(4))]
        phrases = [(make(rng.randrange(0, 4)), f"p{k}") for k in range(rng.randrange(3))]
        pieces = [make(rng.randrange(12)), "X? zz", *[t for _, t in notices], *[t for t, _ in phrases]]
        text = " ".join(rng.choice(pieces) for _ in range(rng.randrange(6)))
        long, gap, cover = rng.randrange(1, 4), rng.randrange(4), rng.choice([0.3, 0.6, 1.0])
        compiled = licences.Licences(notices, phrases, long)
        n, places, spans, most = licences.scan_text(text.encode(), compiled, gap, cover, step=rng.choice([1, 5, 1 << 20]))
        assert (n, sorted(places), spans, most) == plain_scan(text, notices, phrases, long, gap, cover)


def test_licence_spans_of_altered_notices(spark):
    gpl = dict(reversed(licences.NOTICES))["gpl-3.0-or-later"]
    texts = [None, "", "-- ?", "MIT LICENSE", f"intro {gpl} end", gpl.replace("either", "oder"), gpl[: len(gpl) // 2], "cc by cc by nc"]
    texts += ["w\n" * 300_000 + "Apache-License", "x" * 3_000_000 + " mit license", gpl, gpl]
    docs = frame(spark, texts).withColumns({"spans": F.lit(1), "__text": F.lit(2), "a.b": F.lit(3)})
    got = {r.doc_id: r for r in licences.scan(docs, phrases=queries.LICENCE_PHRASES).collect()}
    assert [len(got[i].places) for i in range(len(texts))] == [0, 0, 0, 1, 1, 1, got[6].places != [] and 1 or 0, 2, 1, 1, 1, 1]
    assert got[0].n_words == got[1].n_words == got[2].n_words == 0 and got[0].covered == 0
    assert [(s.label, s.covered) for s in got[4].spans] == [("gpl-3.0-or-later", 1.0)] and got[4].spans[0].first == 1
    assert 0.9 < got[5].spans[0].covered < 1 and got[6].spans == [] and 0.3 < got[6].covered < 0.8
    assert (got[8].places[0].word, got[9].places[0].word) == (300_000, 1) and got[10].spans == got[11].spans
    assert (got[0]["__text"], got[0]["a.b"]) == (2, 3)
    assert licences.scan(frame(spark, [])).isEmpty()
    assert licences.scan(frame(spark, ["mit license"]), notices=[("x", "-")], phrases=[("?", "y")]).first().places == []


def test_licence_query_on_given_documents(spark):
    folder = "/root/testdata/sf0.01"
    texts = {d.doc_id: d.text for d in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = queries.op11_license_scan(spark, folder).collect()
    assert len(rows) == len(texts) and sum(r.n_base for r in rows) > 20
    for r in rows:
        ws, places = plain_words(texts[r.doc_id]), []
        for phrase, label in queries.LICENCE_PHRASES:
            p = phrase.split()
            places += [(i, label) for i in range(len(ws)) if ws[i] == p[0] and ws[i : i + len(p)] == p]
        base = {label for _, label in places}
        assert (r.n_words, r.n_base, r.base_labels) == (len(ws), len(places), ",".join(sorted(base)))
        assert (r.first_word, r.last_word) == ((min(places)[0], max(places)[0]) if places else (None, None))
        if places or r.score > 0:
            _, _, spans, most = plain_scan(texts[r.doc_id], licences.NOTICES, [], 3, 8, 0.8) if len(ws) < 2000 else (0, 0, [tuple(s) for s in r.spans], r.score)
            assert [tuple(s) for s in r.spans] == spans and r.score == (1.0 if places else most)
        assert r.labels == ",".join(sorted(base | {s.label for s in r.spans}))


# --- conversation repair


def faults(rows):
    """(role, text, fault) of rows in order."""
    seen, out = set(), []
    for role, text in rows:
        signs = re.findall(r"[^\x20\x09-\x0D]", text)
        if not signs:
            fault = "blank"
        elif (role, text) in seen:
            fault = "duplicate"
        else:
            fault = "" if signs[-1] in ".!?" else "truncated"
        seen.add((role, text))
        out.append((role, text, fault))
    return out


def cheapest(rows):
    """Cost, audit and repaired lines by trying every edit at every place."""
    rows = tuple(faults(rows))
    follows = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    turn = {"": "user", "s": "user", "u": "assistant", "a": "user"}

    @lru_cache(None)
    def best(i, state, inserted):
        ways = [(0, "", ())] if i == len(rows) and state in ("", "a") else []
        if inserted < 3:
            c, a, t = best(i, turn[state][0], inserted + 1)
            ways.append((c + 3, "I" + a, (turn[state] + ":",) + t))
        if i < len(rows):
            role, text, fault = rows[i]
            c, a, t = best(i + 1, state, 0)
            ways.append((c + 4, "D" + a, t))
            if fault not in ("blank", "duplicate"):
                late = 3 if fault else 0
                if role[:1] in follows[state]:
                    c, a, t = best(i + 1, role[:1], 0)
                    ways.append((c + late, "K" + a, (f"{role}:{text}",) + t))
                c, a, t = best(i + 1, turn[state][0], 0)
                ways.append((c + late + 3, "R" + a, (f"{turn[state]}:{text}",) + t))
        return min(ways, default=(1 << 40, "", ()))

    return best(0, "", 0)


def as_wanted(rows):
    """All numbers of a conversation from (turn, role, text) rows."""
    rows = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    order = lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest())
    rows = sorted(rows, key=order)
    turns = [t for t, _, _ in rows if t is not None]
    found = [f for _, _, f in faults([r[1:] for r in rows])]
    initials = [r[:1] for _, r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    cost, audit, lines = cheapest([r[1:] for r in rows])
    digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
    return (gaps, found.count("blank"), found.count("duplicate"), found.count("truncated"), illegal, cost, audit, digest)


def random_rows(rng, n):
    roles = ["user", "assistant", "user", "assistant", "system", "u", "tool", None, ""]
    texts = ["Yes.", "No!", "cut off", " ", "", None, "why? \n", "é.", "Yes. "]
    own = rng.choice([roles[:4], roles[:5], roles])
    rows = [(rng.choice([t, t, t, rng.randrange(n + 1), None]), rng.choice(own), f"{rng.choice(texts) or ''}") for t in range(n)]
    return [(t, r, None if x == "" and rng.random() < 0.5 else (f"{t}{x}" if x.strip() and rng.random() < 0.7 else x)) for t, r, x in rows]


def test_ranks_order_nodes_by_their_least_audits():
    rng = np.random.default_rng(13)
    for _ in range(60):
        sizes = rng.integers(1, 12, rng.integers(1, 4))
        starts = np.concatenate(([0], np.cumsum(sizes)))
        kinds = rng.choice([0, 1, 1, 1, 2, 2, 2, 3, 5, 6, 8, 12], starts[-1])
        cost = conversations.costs(kinds, starts, conversations.CLOSING[None].repeat(len(sizes), 0))
        ranked = conversations.rank_paths(conversations.optimal_arcs(kinds, starts, cost, np.ones(len(sizes), bool)))
        path, cut = conversations.lay_out(ranked, np.arange(len(ranked.letter)))
        spelled = ["".join(conversations.LETTERS[x - 1] for x in ranked.letter[path[a:b]]) for a, b in zip(cut[:-1], cut[1:])]
        order = {s: k for k, s in enumerate(sorted(set(spelled)))}
        assert [order[s] for s in spelled] == ranked.rank.tolist()
        price = {"D": 4, "I": 3, "K": 0, "R": 3}
        late = sum(3 for s in spelled[:1] for x, k in zip([x for x in s if x != "I"], kinds) if k // 4 == 1 and x != "D")
        assert cost[0, 0] == sum(price[x] for x in spelled[0]) + late


@pytest.mark.parametrize("chunk, group", [(1024, 256), (3, 2), (1, 3)])
def test_repairs_equal_trying_everything(spark, monkeypatch, chunk, group):
    monkeypatch.setattr(conversations, "CHUNK", chunk)
    monkeypatch.setattr(conversations, "GROUP", group)
    rng = random.Random(chunk)
    given = {c: random_rows(rng, rng.randrange(1, 14)) for c in [None, *range(120)]}
    given[500] = random_rows(rng, 60)
    rows = [(c, *r, 1, 2) for c, some in given.items() for r in some]
    rng.shuffle(rows)
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, `key` int, `a.b` int").repartition(4)
    fixed = conversations.repair(table)
    digests = {r.key: r.sha256 for r in conversations.line_digests(fixed.lines).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    got = {
        r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, digests.get(r.key, empty))
        for r in fixed.conversations.collect()
    }
    assert got == {c: as_wanted(some) for c, some in given.items()}
    nothing = conversations.repair(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))
    assert nothing.conversations.isEmpty() and nothing.lines.isEmpty()


def test_repair_query_on_given_conversations(spark):
    given = {}
    for r in spark.read.parquet(f"{FOLDER}/conversations.parquet").collect():
        given.setdefault(r.conv_id, [])
        fate = zlib.crc32(f"{' ' if r.conv_id is None else r.conv_id}:{' ' if r.turn is None else r.turn}".encode()) % 20
        text = {1: "", 2: re.sub("[.!?]", "", r.text or " ")}.get(fate, r.text)
        given[r.conv_id] += [(r.turn, "user" if fate == 4 else r.role, text)] * {0: 0, 3: 2}.get(fate, 1)
    got = {r.conv_id: tuple(r)[1:] for r in queries.op13_conversation_repair(spark, FOLDER).collect()}
    assert got == {c: as_wanted(rows) for c, rows in given.items()}
