"""Compare registered queries with their DuckDB statements: python tests/oracle.py [--scale] [sf dir] [name …]

``--scale`` makes small tables take the paths of large ones: many ranges, no broadcast by size, salted
lookups; and lists plan nodes that would not survive growth.
"""
from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _cell(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v
    if isinstance(v, (list, tuple)):
        return tuple(_cell(x) for x in v)
    return v


def _rows(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_cell(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, sf_dir: str, fn, sql: str | None) -> str:
    df = fn(spark, sf_dir)
    got = _rows(df.columns, df.collect())
    if sql is None:
        return f"rows {len(got)}"
    rel = con.sql(sql)
    want = _rows(rel.columns, rel.fetchall())
    if sorted(df.columns) != sorted(rel.columns):
        return f"MISMATCH columns {sorted(df.columns)} / {sorted(rel.columns)}"
    if len(got) != len(want):
        return f"MISMATCH rows {len(got)} / {len(want)}"
    bad = [(a, b) for a, b in zip(got, want) if a != b]
    if bad:
        return f"MISMATCH {len(bad)} of {len(got)}: {str(bad[0][0])[:300]} / {str(bad[0][1])[:300]}"
    types = {c: t for c, t in zip(rel.columns, map(str, rel.types))}
    odd = [c for c, t in df.dtypes if (t in ("bigint", "int")) != (types[c] in ("BIGINT", "INTEGER"))]
    return f"ok {len(got)}" + (f" types differ: {[(c, dict(df.dtypes)[c], types[c]) for c in odd]}" if odd else "")


def scale_mode(spark) -> None:
    from tablewright.operators import impute, ordering, skew

    ordering.ROWS_PER_RANGE = 700
    impute.BLOCK_POINTS = 60
    skew.HOT_SHARE = 0.02
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")


def growth_risks(df) -> list[str]:
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [n for n in ("CartesianProduct", "BroadcastNestedLoopJoin", "Exchange SinglePartition") if n in plan]


if __name__ == "__main__":
    from __spark_entry__ import oracle_sql, queries
    from tablewright.session import local_session

    args = [a for a in sys.argv[1:] if a != "--scale"]
    sf = args[0] if args else "/root/testdata/sf0.01"
    spark, con, sqls = local_session(8), connect(sf), oracle_sql()
    scale = "--scale" in sys.argv
    if scale:
        scale_mode(spark)
    for name, fn in queries().items():
        if len(args) > 1 and not any(name.startswith(a) for a in args[1:]):
            continue
        t = time.time()
        try:
            result = compare(spark, con, sf, fn, sqls.get(name))
            if scale and (risks := growth_risks(fn(spark, sf))):
                result += f" {risks}"
        except Exception as e:  # the listing goes on with the next query
            result = f"ERROR {type(e).__name__} {str(e)[:400]}"
        print(f"{time.time() - t:6.1f}s {name}: {result}", flush=True)
