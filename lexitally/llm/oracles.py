"""SQL twins of the operators that SQL can express on whole tables, for DuckDB."""

from __future__ import annotations


def url_filter(rules: list[tuple[str, str, str]], default: str = "allow") -> str:
    listed = ", ".join(f"('{host}', '{path}', '{verdict}')" for host, path, verdict in rules)
    return rf"""
    WITH rules(rule_host, rule_path, rule_verdict) AS (VALUES {listed}),
    rest AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
    parts AS (
        SELECT page_id,
            coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
            coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
        FROM rest),
    best AS (
        SELECT page_id, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
            arg_max(rule_verdict, length(rule_host || rule_path)) AS verdict
        FROM parts JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
        GROUP BY page_id)
    SELECT page_id, host, path, rule, coalesce(verdict, '{default}') AS verdict FROM parts LEFT JOIN best USING (page_id)"""


def _weight(column: str, weights: dict[str, int]) -> str:
    cases = " ".join(f"WHEN '{value}' THEN {w}" for value, w in weights.items())
    return f"(CASE {column} {cases} ELSE 1 END)::BIGINT" if cases else "1::BIGINT"


def _share(level: int, above: list[str], name: str, weights: dict[str, int]) -> str:
    """The budget of every node of a level from that of the level above."""
    keys = ", ".join(["root", *above])
    same = " AND ".join(f"n.{a} IS NOT DISTINCT FROM g.{a}" for a in ["root", *above])
    by = f"PARTITION BY {keys} ORDER BY cap / weight, {name} NULLS FIRST"
    until = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    before = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    return f"""
    nodes{level} AS (SELECT {keys}, {name}, sum(cap)::HUGEINT AS cap, {_weight(name, weights)} AS weight FROM caps GROUP BY {keys}, {name}),
    joined{level} AS (SELECT n.*, g.budget FROM nodes{level} n JOIN given{level - 1} g ON {same}),
    run{level} AS (SELECT *, greatest(budget - coalesce(sum(cap) OVER ({by} {before}), 0), 0) AS own_rest,
        sum(weight) OVER (PARTITION BY {keys}) - coalesce(sum(weight) OVER ({by} {before}), 0) AS weight_left FROM joined{level}),
    open{level} AS (SELECT *, max(CASE WHEN cap * weight_left <= weight * own_rest THEN 0 ELSE 1 END) OVER ({by} {until}) AS is_open FROM run{level}),
    first{level} AS (SELECT *,
        first_value(own_rest) OVER (PARTITION BY {keys} ORDER BY is_open DESC, cap / weight, {name} NULLS FIRST) AS rest,
        first_value(weight_left) OVER (PARTITION BY {keys} ORDER BY is_open DESC, cap / weight, {name} NULLS FIRST) AS weights,
        sum(CASE WHEN is_open = 1 THEN weight ELSE 0 END) OVER ({by} {until}) AS upto FROM open{level}),
    given{level} AS (SELECT {keys}, {name}, CASE WHEN is_open = 0 THEN cap
        ELSE (rest * upto) // weights - (rest * (upto - weight)) // weights END AS budget FROM first{level})"""


def mixture(domains: tuple[str, ...], weights: dict[str, dict[str, int]], share: tuple[int, int], epochs: int, seed: int) -> str:
    """The tree domain, language, source over ``documents``."""
    cases = " ".join(f"WHEN {i} THEN '{name}'" for i, name in enumerate(domains))
    number = "coalesce(try_cast(regexp_extract(source, '([0-9]{1,9})$', 1) AS INTEGER), 0)"
    levels = ["domain", "lang", "source"]
    tree = ",".join(_share(i + 1, levels[:i], name, weights.get(name, {})) for i, name in enumerate(levels))
    leaf = " AND ".join(f"{{a}}.{c} IS NOT DISTINCT FROM {{b}}.{c}" for c in levels)
    return rf"""
    WITH docs AS (SELECT doc_id, lang, source, CASE {number} % {len(domains)} {cases} END AS domain,
        coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS mix_tokens FROM documents),
    leaves AS (SELECT domain, lang, source, sum(mix_tokens)::HUGEINT AS tokens FROM docs GROUP BY ALL),
    caps AS (SELECT 0 AS root, *, tokens * {epochs} AS cap FROM leaves),
    given0 AS (SELECT 0 AS root, least(sum(tokens) * {share[0]} // {share[1]}, sum(cap)) AS budget FROM caps), {tree},
    plan AS (SELECT l.*, CASE WHEN tokens > 0 THEN g.budget // tokens ELSE 0 END AS whole,
        CASE WHEN tokens > 0 THEN g.budget % tokens ELSE 0 END AS need FROM leaves l JOIN given3 g ON {leaf.format(a='l', b='g')}),
    placed AS (SELECT d.*, p.whole, p.need, md5('{seed}|' || p.whole || '|' || coalesce(d.doc_id::VARCHAR, '')) AS place
        FROM docs d JOIN plan p ON {leaf.format(a='d', b='p')}),
    sums AS (SELECT domain, lang, source, need, place, sum(mix_tokens) AS n FROM placed GROUP BY ALL),
    upto AS (SELECT *, sum(n) OVER (PARTITION BY domain, lang, source ORDER BY place) - n AS before FROM sums),
    cuts AS (SELECT domain, lang, source, max(place) AS cut FROM upto WHERE need > 0 AND before < need GROUP BY ALL),
    times AS (SELECT d.*, (whole + CASE WHEN place <= cut THEN 1 ELSE 0 END)::BIGINT AS times
        FROM placed d LEFT JOIN cuts c ON {leaf.format(a='d', b='c')})
    SELECT doc_id, lang, source, mix_tokens, unnest(range(times))::INTEGER AS mix_epoch FROM times"""


def fill_in_middle(seed: int, plain: int, spm: int) -> str:
    """Cuts by code points, and the text put together again from the pieces of the output."""
    draws = ", ".join(f"('0x' || substr(hash, {8 * k - 7}, 8))::BIGINT AS h{k}" for k in range(1, 5))
    piece = "substr(output, 4 + {a}::BIGINT, {n}::BIGINT)"
    p, m, s = "prefix_chars", "middle_chars", "(n - prefix_chars - middle_chars)"
    from_psm = piece.format(a=0, n=p) + " || " + piece.format(a=f"({p} + {s} + 6)", n=m) + " || " + piece.format(a=f"({p} + 3)", n=s)
    from_spm = piece.format(a=f"({s} + 3)", n=p) + " || " + piece.format(a=f"({p} + {s} + 6)", n=m) + " || " + piece.format(a=0, n=s)
    return f"""
    WITH docs AS (SELECT doc_id, coalesce(text, '') AS text, sha256('{seed}:' || coalesce(doc_id::VARCHAR, '')) AS hash FROM documents),
    drawn AS (SELECT doc_id, text, length(text)::BIGINT AS n, {draws} FROM docs),
    formed AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
        CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= {100 - plain} THEN 'plain'
            WHEN h4 % 100 < {spm} THEN 'spm' ELSE 'psm' END AS form FROM drawn),
    pieces AS (SELECT doc_id, text, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
        substr(text, 1, a) AS p, substr(text, a + 1, b - a) AS m, substr(text, b + 1, n - b) AS s FROM formed),
    made AS (SELECT *, CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
        ELSE '<S>' || s || '<P>' || p || '<M>' || m END AS output FROM pieces)
    SELECT doc_id, n, form, prefix_chars, middle_chars, sha256(output) AS output_sha256,
        sha256(CASE form WHEN 'plain' THEN output WHEN 'psm' THEN {from_psm} ELSE {from_spm} END) AS restored_sha256 FROM made"""


def crc32(ascii_text: str) -> str:
    """The checksum bit by bit, as DuckDB has no function for it."""
    bit = "lambda c, i: xor(c >> 1, 3988292384 * (c & 1))"
    byte = f"lambda c, b: list_reduce(list_concat([xor(c, b)], range(8)), {bit})"
    codes = f"list_transform(string_split({ascii_text}, ''), lambda x: ord(x)::BIGINT)"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {codes}), {byte}), 4294967295)"


def conversation_repair() -> str:
    """From every conversation's last row to its first: the cheapest repair of the rest after each last role written."""
    turn = {"o": "u", "s": "u", "u": "a", "a": "u"}
    line = {"u": "user:", "a": "assistant:"}
    keeps = {"o": [("s", "s"), ("u", "u")], "s": [("u", "u")], "u": [("a", "a")], "a": [("u", "u")]}

    def way(state: str, cost: str, letter: str, text: str = "''") -> str:
        """A repair that goes on as from ``state``: cost, audit, text."""
        return f"{{'c': {cost} + {state}.c, 'a': '{letter}' || {state}.a, 't': {text} || {state}.t}}"

    def ways(state: str) -> str:
        """All repairs that take the next row first."""
        out = [way(state, "4", "D")]
        for initial, to in keeps[state]:
            kept = way(to, "late", "K", "chr(10) || role || ':' || text")
            out.append(f"CASE WHEN stays AND initial = '{initial}' THEN {kept} END")
        to = turn[state]
        out.append(f"CASE WHEN stays THEN {way(to, '3 + late', 'R', f'chr(10) || {chr(39)}{line[to]}{chr(39)} || text')} END")
        return f"list_min(list_filter([{', '.join(out)}], lambda x: x IS NOT NULL))"

    def inserting(state: str, of: str) -> str:
        """The best of going on at once, after one empty turn, and after two."""
        one, two = turn[state], turn[turn[state]]
        first, both = f"chr(10) || '{line[one]}'", f"chr(10) || '{line[one]}' || chr(10) || '{line[two]}'"
        return f"list_min([{of}{state}, {way(of + one, '3', 'I', first)}, {way(of + two, '6', 'II', both)}]) AS {state}"

    states = list(turn)
    takes = ", ".join(f"{ways(x)} AS go_{x}" for x in states)
    best = ", ".join(inserting(x, "go_") for x in states)
    ends = {
        "o": "{'c': 0::BIGINT, 'a': '', 't': ''}",
        "s": "{'c': 6::BIGINT, 'a': 'II', 't': chr(10) || 'user:' || chr(10) || 'assistant:'}",
        "u": "{'c': 3::BIGINT, 'a': 'I', 't': chr(10) || 'assistant:'}",
        "a": "{'c': 0::BIGINT, 'a': '', 't': ''}",
    }
    blank = r"[^\x20\x09-\x0D]"
    return rf"""
    WITH RECURSIVE fated AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
        {crc32("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS fate FROM conversations),
    kept AS (SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
        CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
        unnest(range(CASE WHEN fate = 3 THEN 2 ELSE 1 END)) AS copy FROM fated WHERE fate <> 0),
    placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS pos,
        count(*) OVER (PARTITION BY conv_id) AS n FROM kept),
    judged AS (SELECT *, substr(role, 1, 1) AS initial, lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY pos) AS prior,
        CASE WHEN NOT regexp_matches(text, '{blank}') THEN 'blank'
            WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'duplicate'
            WHEN NOT regexp_matches(text, '[.!?][ 	-
]*$') THEN 'truncated' ELSE '' END AS fault FROM placed),
    steps AS (SELECT conv_id, pos, n, role, text, initial, fault NOT IN ('blank', 'duplicate') AS stays,
        (CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END)::BIGINT AS late FROM judged),
    solved AS (
        SELECT conv_id, max(n) + 1 AS pos, {', '.join(f'{e} AS {x}' for x, e in ends.items())} FROM steps GROUP BY conv_id
        UNION ALL
        SELECT conv_id, pos, {best} FROM (
            SELECT r.conv_id, r.pos, {takes} FROM steps r JOIN solved z ON r.conv_id IS NOT DISTINCT FROM z.conv_id AND r.pos = z.pos - 1)),
    facts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 'blank') AS blank,
        count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
        count(*) FILTER (prior || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM judged GROUP BY conv_id),
    found AS (SELECT f.*, s.o.c AS cost, s.o.a AS audit, substr(s.o.t, 2) AS repaired FROM facts f JOIN solved s
        ON f.conv_id IS NOT DISTINCT FROM s.conv_id AND s.pos = 1),
    every AS (SELECT DISTINCT conv_id FROM conversations)
    SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
        coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit,
        sha256(coalesce(repaired, '')) AS repaired_sha256 FROM every e LEFT JOIN found f ON e.conv_id IS NOT DISTINCT FROM f.conv_id"""
