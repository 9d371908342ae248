"""Fill-in-middle by counted quantifiers: one regular expression per row cuts its text.

``regexp_count`` gives the n units of a text. Two places are drawn from the row's id, and the
row's own pattern, ``unit`` counted a times, then b - a times, then the rest, all possessive,
captures prefix, middle and suffix in one match, whose replacement is the output already.
Possessive counts never step back, so a match walks a text once, of any length.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexitally.llm.common import named, others, unused

#: Units that are counted as one step, so that a count holds blocks of a text and not its units.
BLOCK = 4096


@dataclass(frozen=True)
class Markers:
    """What stands before prefix, suffix and middle; no marker holds another's first character but as its own first."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def all(self) -> tuple[str, str, str]:
        return self.prefix, self.suffix, self.middle


def draw(id_col: str, seed: int, number: int) -> Column:
    """The ``number``-th group of eight hexadecimal digits of the id's hash, as an unsigned integer."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(named(id_col).cast("string"), F.lit("")))
    digits = F.sha2(text.cast("binary"), 256).substr(8 * number - 7, 8)
    return F.conv(digits, 16, 10).cast("long")


def unit_count(text: Column, unit: str = ".") -> Column:
    """``regexp_count`` of the units that tile a text, whole blocks first, then those of the rest."""
    block = f"(?s)(?:{unit}){{{BLOCK}}}+"
    rest = F.regexp_replace(text, F.lit(rf"(?s)\A(?:(?:{unit}){{{BLOCK}}}+)*+"), F.lit(""))
    return (F.regexp_count(text, F.lit(block)).cast("long") * BLOCK + F.regexp_count(rest, F.lit(f"(?s){unit}"))).cast("long")


def _quoted(text: str) -> str:
    return r"\Q" + text + r"\E"


def _literal(text: str) -> str:
    """A replacement that stands for itself."""
    return text.replace("\\", r"\\").replace("$", r"\$")


def rearrange(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    seed: int = 1,
    plain: int = 10,
    spm: int = 20,
    markers: Markers = Markers(),
    unit: str = ".",
) -> DataFrame:
    """All columns with ``n``, ``form``, ``prefix_chars``, ``middle_chars`` and ``output``.

    Of 100 texts ``plain`` stay as they are (form ``plain``), and of 100 others ``spm`` begin
    with the suffix (``spm``: suffix, prefix, middle) instead of the prefix (``psm``: prefix,
    suffix, middle). Empty texts and texts with a marker in them stay plain as well, and a
    null text is an empty one. ``prefix_chars`` and ``middle_chars`` count units (null where
    plain); a unit is one regex atom that tiles any text, a code point by default. Rows are
    judged one by one: rows of one id are cut alike if their texts are, a null id draws as an
    empty one, no row gives none. Columns of the input with the new names are replaced.
    """
    new = ("n", "form", "prefix_chars", "middle_chars", "output")
    kept = others(docs, *new)
    text, h3, h4, first, second = (unused(docs, x) for x in ("text", "h3", "h4", "first", "second"))
    is_plain = F.lit(False)
    for marker in markers.all():
        is_plain = is_plain | F.contains(F.col(text), F.lit(marker))
    rows = docs.select(
        *kept,
        F.coalesce(named(text_col).cast("string"), F.lit("")).alias(text),
        *[draw(id_col, seed, k).alias(c) for k, c in ((1, first), (2, second), (3, h3), (4, h4))],
    )
    rows = rows.withColumn("n", unit_count(F.col(text), unit))
    is_plain = (F.col("n") == 0) | is_plain | (F.col(h3) % 100 >= 100 - plain)
    form = F.when(is_plain, "plain").when(F.col(h4) % 100 < spm, "spm").otherwise("psm")
    rows = rows.select(
        *kept, text, "n", form.alias("form"), *[(F.col(c) % (F.col("n") + 1)).alias(c) for c in (first, second)]
    )
    a, b = F.least(first, second), F.greatest(first, second)
    rows = rows.select(
        *kept, text, "n", "form",
        F.when(F.col("form") != "plain", a).alias("prefix_chars"),
        F.when(F.col("form") != "plain", b - a).alias("middle_chars"),
    )
    return rows.select(*kept, *new[:-1], _output(F.col(text), markers, unit).alias("output"))


def _output(text: Column, markers: Markers, unit: str) -> Column:
    """The one match of a row, written in the order of its form."""
    p, s, m = (_literal(x) for x in markers.all())
    parts = [F.lit(rf"(?s)\A((?:{unit}){{"), F.col("prefix_chars"), F.lit(rf"}}+)((?:{unit}){{"), F.col("middle_chars")]
    pattern = F.concat(*parts, F.lit(r"}+)(.*+)\z"))
    order = F.when(F.col("form") == "spm", f"{s}$3{p}$1{m}$2").otherwise(f"{p}$1{s}$3{m}$2")
    return F.when(F.col("form") == "plain", text).otherwise(F.regexp_replace(text, pattern, order))


def restored(output: Column, form: Column, markers: Markers = Markers()) -> Column:
    """The text that an output was made from, by its form; null gives null."""
    p, s, m = (_quoted(x) for x in markers.all())
    psm = F.regexp_replace(output, F.lit(rf"(?s)\A{p}(.*?){s}(.*?){m}(.*+)\z"), F.lit("$1$3$2"))
    spm = F.regexp_replace(output, F.lit(rf"(?s)\A{s}(.*?){p}(.*?){m}(.*+)\z"), F.lit("$2$3$1"))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
