"""Text expressions: cleaning, tokenising, stopwords, phrases.

Every function maps a Column to a Column and stays on the JVM side. The
character classes are spelled out because Java's ``\\w`` and ``\\s`` are not
the Unicode classes the published results were computed with.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The character classes that define words and white space.
SPACE = r"\t-\r\x1c-\x1f\x85\p{Z}"
WORD = r"\p{L}\p{N}_"
URL_PATTERN = rf"https?://[^{SPACE}]+|www\.[^{SPACE}]+"


def lower_case(c: Column) -> Column:
    """SCA-1a."""
    return F.lower(c)


def strip_urls(c: Column) -> Column:
    """SCA-1b: a URL up to the next whitespace becomes one space (expects lower case).

    The substring test spares texts without any URL the regular expression.
    """
    has_url = c.contains("http") | c.contains("www.")
    return F.when(has_url, F.regexp_replace(c, URL_PATTERN, " ")).otherwise(c)


def dashes_to_space(c: Column) -> Column:
    """SCA-1c."""
    return F.regexp_replace(c, "[-–—]", " ")


def punctuation_to_space(c: Column) -> Column:
    """SCA-1d: whatever is neither a word character nor whitespace."""
    return F.regexp_replace(c, rf"[^{WORD}{SPACE}]", " ")


def collapse_space(c: Column) -> Column:
    """SCA-1e: one space for every run of whitespace, none at the ends."""
    return F.trim(F.regexp_replace(c, rf"[{SPACE}]+", " "))


def clean_text(c: Column) -> Column:
    """SCA-1: the five steps in order, in two passes over the text.

    Once URLs are gone, dashes, punctuation and whitespace are together exactly
    the non-word characters, so replacing each run of those gives the same text
    as steps c, d and e one after the other.
    """
    return F.trim(F.regexp_replace(strip_urls(lower_case(c)), f"[^{WORD}]+", " "))


def clean_words(c: Column) -> Column:
    """SCA-1 followed by SCA-13 (or SCA-11) without building the text in between."""
    return F.array_remove(F.split(strip_urls(lower_case(c)), f"[^{WORD}]+"), "")


def light_clean(c: Column) -> Column:
    """SCA-2: byte order marks become spaces, then whitespace is collapsed."""
    return collapse_space(F.translate(c, "\ufeff", " "))


def is_blank(c: Column) -> Column:
    """True where nothing but whitespace is left."""
    return ~c.rlike(rf"[^{SPACE}]")


def whitespace_tokens(c: Column) -> Column:
    """SCA-11: maximal runs of non-whitespace; an empty text has none."""
    return F.array_remove(F.split(c, rf"[{SPACE}]+"), "")


def word_count(c: Column) -> Column:
    """SCA-12."""
    return F.size(whitespace_tokens(c)).cast("long")


def word_tokens(c: Column) -> Column:
    """SCA-13: maximal runs of word characters, case kept, single characters kept."""
    return F.regexp_extract_all(c, F.lit(f"([{WORD}]+)"), 1)


def remove_words(tokens: Column, stopwords: Iterable[str]) -> Column:
    """SCA-14: drop exact matches, keep order and repetitions."""
    stop = sorted(set(stopwords))
    return F.filter(tokens, lambda t: ~t.isin(stop)) if stop else tokens


def remove_stopwords(c: Column, stopwords: Iterable[str]) -> Column:
    """SCA-14 on a text: whitespace tokens, stopwords out, one space between the rest."""
    return F.array_join(remove_words(whitespace_tokens(c), stopwords), " ")


def ngrams(tokens: Column, n: int) -> Column:
    """SCA-15: all phrases of ``n`` neighbouring tokens, by zipping the array with its own tails.

    No element looks back into the whole array, so the cost stays linear even
    where the planner inlines the expression behind ``tokens``.
    """
    count = F.greatest(F.size(tokens) - (n - 1), F.lit(0))
    phrases = F.slice(tokens, F.lit(1), count) if n > 1 else tokens
    for k in range(1, n):
        tail = F.slice(tokens, F.lit(k + 1), count)
        phrases = F.zip_with(phrases, tail, lambda left, right: F.concat(left, F.lit(" "), right))
    return phrases


def ngram_range(tokens: Column, shortest: int, longest: int) -> Column:
    """SCA-15 for a range of lengths, short phrases first."""
    parts = [ngrams(tokens, n) for n in range(shortest, longest + 1)]
    return parts[0] if len(parts) == 1 else F.concat(*parts)


def is_valid_pattern(c: Column) -> Column:
    """FIL-6: has a Latin letter, is longer than one character, is not a number."""
    t = collapse_ends(F.lower(c))
    return ~t.rlike(r"^\p{Nd}+$") & t.rlike("[a-zA-Z]") & (F.length(t) > 1)


def collapse_ends(c: Column) -> Column:
    """Strip every kind of whitespace from both ends, leave the inside alone."""
    return F.regexp_replace(c, rf"^[{SPACE}]+|[{SPACE}]+$", "")


def round_half_even(c: Column, places: int) -> Column:
    """SCA-16: scale, round half to even, scale back, as array libraries do it."""
    return F.rint(c * F.lit(float(10**places))) / F.lit(float(10**places))
