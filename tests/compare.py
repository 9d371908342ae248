"""Run queries next to their SQL twins: ``python tests/compare.py 0.01 [name ...]``."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
KINDS = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean"}


def oracle(folder):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(r[i] for i in order) for r in rows), key=repr)


def difference(df, con, sql):
    """None where names, types and all values agree, else what differs."""
    mine = rows_of(df.columns, df.collect())
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    kinds = {d[0]: KINDS.get(str(d[1]), str(d[1])) for d in rel.description}
    theirs = rows_of(names, rel.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} / {sorted(names)}"
    if kinds != dict(df.dtypes):
        return f"types {[(k, v, kinds[k]) for k, v in df.dtypes if kinds[k] != v]}"
    if len(mine) != len(theirs):
        return f"rows {len(mine)} / {len(theirs)}"
    wrong = [(a, b) for a, b in zip(mine, theirs) if a != b]
    return f"{len(wrong)} of {len(mine)} rows, first {wrong[0]}" if wrong else None


def main():
    from __spark_entry__ import oracle_sql, queries
    from lexitally.session import build_session

    conf = {"spark.driver.memory": "16g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"}
    spark = build_session(master="local[8]", **conf, **{"spark.sql.shuffle.partitions": "8"})
    spark.sparkContext.setLogLevel("ERROR")
    folder = f"/root/testdata/sf{sys.argv[1]}"
    con, twins = oracle(folder), oracle_sql()
    for name, query in queries().items():
        if sys.argv[2:] and name not in sys.argv[2:]:
            continue
        start = time.time()
        try:
            df = query(spark, folder)
            if name in twins:
                n, verdict = "", difference(df, con, twins[name]) or "ok"
            else:
                n, verdict = len(df.collect()), "rows only"
        except Exception as exc:
            n, verdict = "", f"ERROR {str(exc)[:600]}"
        print(f"{name:30s} {time.time() - start:6.2f}s {verdict} {n}", flush=True)


if __name__ == "__main__":
    main()
