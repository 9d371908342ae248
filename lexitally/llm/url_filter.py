"""URL filter by a sort-merge range join over reversed hosts.

A host's labels in reverse order, each closed by a separator, make a key under which all
subdomains of a rule's host form one interval. Pages and rules are cut into the same key
ranges, every range gets the rules that reach into it, and each is swept once in key order
with a stack of the rules' hosts that are open at that point, nested as hosts are.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexitally.session import stage

#: Label separator of a key; below every character that a label holds.
CLOSE = "\x01"
#: Cells that the pages of one host are spread over, pages of a range, rows that make a cell
#: weigh double when ranges are cut.
CELLS, RANGE_ROWS, CELL_ROWS = 64, 200_000, 64


def url_host(url: Column) -> Column:
    """After the first ``://`` up to a slash, question mark, number sign or the end; A-Z lower-cased."""
    at = F.locate("://", url)
    rest = F.substring_index(F.substring_index(F.substring_index(_after(url), "/", 1), "?", 1), "#", 1)
    return F.when(at > 0, _lower(rest)).otherwise("")


def url_path(url: Column) -> Column:
    """What follows the host up to a question mark, a number sign or the end."""
    rest = _after(url)
    plain = F.substring_index(F.substring_index(rest, "?", 1), "#", 1)
    slash = F.locate("/", plain)
    path = F.when(slash > 0, plain.substr(slash, F.length(plain))).otherwise("")
    return F.when(F.locate("://", url) > 0, path).otherwise("")


def _after(url: Column) -> Column:
    text = F.coalesce(url, F.lit(""))
    return text.substr(F.locate("://", text) + 3, F.length(text))


def _lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_key(host: Column) -> Column:
    """Labels in reverse order, each followed by the separator; the empty host has an empty key."""
    labels = F.array_join(F.reverse(F.split(host, r"\.")), CLOSE)
    return F.when(host == "", F.lit("")).otherwise(F.concat(labels, F.lit(CLOSE)))


def sweep(rules: list[tuple[str, str, str, str]], pages: Iterator[tuple[str, str]]) -> Iterator[tuple[str | None, str | None]]:
    """Rule and verdict of every page, in key order.

    ``rules`` are (key, path, name, verdict) in key order: every rule whose interval reaches
    into the range. The stack holds the open hosts, outermost first, each with its rules.
    """
    stack: list[tuple[str, list]] = []
    following = 0
    for key, path in pages:
        while following < len(rules) and rules[following][0] <= key:
            of = rules[following][0]
            while stack and not of.startswith(stack[-1][0]):
                stack.pop()
            if stack and stack[-1][0] == of:
                stack[-1][1].append(rules[following][1:])
            else:
                stack.append((of, [rules[following][1:]]))
            following += 1
        while stack and not key.startswith(stack[-1][0]):
            stack.pop()
        best = None
        for depth, (_, held) in enumerate(stack):
            for prefix, name, verdict in held:
                if path.startswith(prefix) and (best is None or (len(name), depth) >= best[0]):
                    best = ((len(name), depth), name, verdict)
        yield (best[1], best[2]) if best else (None, None)


def judge(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow") -> DataFrame:
    """All columns with ``host``, ``path``, ``rule`` and ``verdict`` for every row.

    ``rules`` has ``host``, ``path`` and ``verdict``. A rule fits its host and all subdomains
    where the url's path starts with the rule's; of several the longest wins (host and path
    together, then the longer host). Without a rule ``rule`` is null and the verdict is
    ``default``. A null url, or one without ``://``, has an empty host and path and fits no
    rule. Rules with a null or empty host fit nothing; a null path counts as ``/``.
    Columns of the input with these four names are replaced.
    """
    spark = pages.sparkSession
    new = ("host", "path", "rule", "verdict")
    names = [c for c in pages.columns if c not in new]
    url = F.col(url_col).cast("string")
    rows = pages.select(*names, url_host(url).alias("host"), url_path(url).alias("path"))
    # Pages of one key are spread over cells, so that a host with a third of the pages is cut as well.
    rows = rows.withColumns({"__key": host_key(F.col("host")), "__cell": F.floor(F.rand(4) * CELLS).cast("int")})
    keyed, seen = stage(rows, rows=F.count(F.lit(1)))
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(seen.get("rows") or 0) // RANGE_ROWS))
    rules = rules.where("coalesce(host, '') != ''").select(
        host_key(_lower(F.col("host"))).alias("__key"),
        F.struct(
            host_key(_lower(F.col("host"))).alias("key"),
            F.coalesce("path", F.lit("/")).alias("path"),
            F.concat(_lower(F.col("host")), F.coalesce("path", F.lit("/"))).alias("name"),
            "verdict",
        ).alias("__rule"),
    )
    # Cells and rules are cut into the same ranges of the key; a cell weighs as many rows as it has.
    cells = keyed.groupBy("__key", "__cell").agg(F.count(F.lit(1)).alias("n"))
    cells = cells.withColumn("__part", F.explode(F.sequence(F.lit(1), F.ceil(F.col("n") / CELL_ROWS).cast("int"))))
    merged = cells.select("__key", "__cell", "__part", F.lit(None).cast(rules.schema["__rule"].dataType).alias("__rule")).union(
        rules.select("__key", F.lit(-1), F.lit(0), "__rule")
    )
    merged = merged.repartitionByRange(ranges, "__key", "__cell").withColumn("__range", F.spark_partition_id())
    merged, _ = stage(merged)
    cells = merged.where("__rule is null and __part = 1").select("__key", "__cell", "__range")
    begin = merged.where("__rule is not null").select("__range", "__rule")
    # Rules open where a range begins: those whose key is a beginning of the range's first key.
    first = cells.groupBy("__range").agg(F.min("__key").alias("first"))
    depth = F.size(F.split("first", CLOSE)) - 1
    labels = F.slice(F.split("first", CLOSE), 1, depth)
    outer = F.transform(F.sequence(F.lit(1), depth), lambda i: F.concat(F.array_join(F.slice(labels, F.lit(1), i), CLOSE), F.lit(CLOSE)))
    opened = first.where(depth > 0).select("__range", F.explode(outer).alias("__key")).join(rules, "__key")
    of_range = begin.union(opened.select("__range", "__rule")).distinct().withColumnRenamed("__range", "__of")
    dealt = keyed.join(cells, ["__key", "__cell"]).drop("__cell")
    fields = [dealt.schema[c] for c in names] + [T.StructField(c, T.StringType()) for c in new]
    columns = [*names, *new]

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left):  # rules begin where no page lies
            return pd.DataFrame({c: [] for c in columns}, dtype=object)
        left = left.sort_values("__key", kind="stable")
        mine = sorted((r["key"], r["path"], r["name"], r["verdict"]) for r in right["__rule"])
        found = list(sweep(mine, zip(left["__key"], left["path"])))
        left["rule"] = [r for r, _ in found]
        left["verdict"] = [default if v is None else v for _, v in found]
        return left[columns]

    return dealt.groupBy("__range").cogroup(of_range.groupBy("__of")).applyInPandas(run, T.StructType(fields))
