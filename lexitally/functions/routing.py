"""Manifest expressions: source routing, ids, paths, error classes."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexitally.functions.defaults import (
    DRIVE_ID_PATTERNS,
    ERROR_RULES,
    HOST_RULES,
    LABEL_CODES,
    UNSUPPORTED,
)
from lexitally.functions.text import collapse_ends


def blank_to_null(c: Column) -> Column:
    """A pattern without a match yields an empty string; make that a null."""
    return F.nullif(c, F.lit(""))


def url_hostname(url: Column) -> Column:
    """Host without user, port and case; null for a text without a host."""
    host = F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/?#]*@)?([^/?#:]*)", 1)
    return F.lower(blank_to_null(host))


def url_host(url: Column) -> Column:
    """SCA-9: the part between the scheme and the first slash, port and user kept."""
    return blank_to_null(F.regexp_extract(url, r"https?://([^/]+)", 1))


def source_type(url: Column, rules: Sequence[tuple[str, str, str]] = HOST_RULES) -> Column:
    """SCA-3: the code of the first rule the host matches."""
    host = url_hostname(url)
    tests = [(host == text if how == "equals" else host.contains(text), code) for code, how, text in rules]
    chain = F.when(tests[0][0], tests[0][1])
    for test, code in tests[1:]:
        chain = chain.when(test, code)
    return chain.otherwise(UNSUPPORTED)


def label_code(label: Column, codes: Mapping[str, str] = LABEL_CODES) -> Column:
    """SCA-5: the code of a known label, else the first three letters of it."""
    letters = F.upper(F.regexp_replace(label, "[^A-Za-z]", ""))
    fallback = F.substring(letters, 1, 3)
    if not codes:
        return fallback
    known = F.create_map(*[F.lit(part) for pair in codes.items() for part in pair])
    return F.coalesce(F.try_element_at(known, label), fallback)


def video_id(label: Column, sequence: Column, source: Column, codes: Mapping[str, str] = LABEL_CODES) -> Column:
    """SCA-4: ``CODE_007_SRC``; numbers beyond 999 take the digits they need."""
    return F.format_string("%s_%03d_%s", label_code(label, codes), sequence, source)


def raw_path(label: Column, vid: Column, root: str = "data/1_raw/transcripts") -> Column:
    """SCA-6: where the raw text of a row belongs."""
    return F.concat_ws("/", F.lit(root), label, F.concat(vid, F.lit("_raw.txt")))


def processed_path(label: Column, vid: Column, root: str = "data/2_processed/transcripts") -> Column:
    """SCA-6: where the cleaned text of a row belongs."""
    return F.concat_ws("/", F.lit(root), label, F.concat(vid, F.lit("_processed.txt")))


def processed_name(file_name: Column) -> Column:
    """SCA-10."""
    return F.replace(file_name, F.lit("_raw.txt"), F.lit("_processed.txt"))


def drive_file_id(url: Column, patterns: Sequence[str] = DRIVE_ID_PATTERNS) -> Column:
    """SCA-7: the first pattern that matches wins; null where none does."""
    return F.coalesce(*[blank_to_null(F.regexp_extract(url, p, 1)) for p in patterns])


def classify_error(message: Column, source: str, rules: Mapping[str, dict] = ERROR_RULES) -> Column:
    """SCA-8: a fixed note for errors that mean "gone", else the trimmed message."""
    rule = rules[source]
    markers = "|".join(re.escape(m) for m in rule["markers"])
    return F.when(F.lower(message).rlike(markers), F.lit(rule["unavailable"])).otherwise(
        F.coalesce(blank_to_null(collapse_ends(message)), F.lit(rule["fallback"]))
    )


def without_hosts(url: Column, pattern: str = "scontent|fbcdn") -> Column:
    """FIL-3: false where the URL matches in any case; a null URL is kept."""
    return ~F.coalesce(url.rlike(f"(?i){pattern}"), F.lit(False))
