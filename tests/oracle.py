"""Compare registered queries with their SQL: python -m tests.oracle [sf] [names...]"""

from __future__ import annotations

import math
import sys
import time
import traceback

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _plain(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return round(value, 6) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    if hasattr(value, "asDict"):
        return tuple(sorted((k, _plain(v)) for k, v in value.asDict().items()))
    if isinstance(value, dict):
        return tuple(sorted((k, _plain(v)) for k, v in value.items()))
    return value


KINDS = {"BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "DOUBLE": "double", "BOOLEAN": "boolean",
         "FLOAT": "float", "TIMESTAMP": "timestamp"}


def compare(spark, con, sf_dir: str, plan, sql: str) -> str | None:
    """``None`` when rows, names and types agree, else what differs."""
    df = plan(spark, sf_dir)
    names = sorted(df.columns)
    left = sorted((tuple(_plain(r[c]) for c in names) for r in df.collect()), key=repr)
    shape = df._jdf.queryExecution().executedPlan().toString()
    for join in ("CartesianProduct", "BroadcastNestedLoopJoin"):
        if join in shape:
            return f"the plan holds a {join}"
    rel = con.sql(sql)
    if sorted(rel.columns) != names:
        return f"columns {names} vs {sorted(rel.columns)}"
    spark_types = dict(df.dtypes)
    for c, t in zip(rel.columns, rel.types):
        if KINDS.get(str(t), str(t)) != spark_types[c]:
            return f"type of {c}: {spark_types[c]} vs {t}"
    at = [rel.columns.index(c) for c in names]
    right = sorted((tuple(_plain(r[i]) for i in at) for r in rel.fetchall()), key=repr)
    if len(left) != len(right):
        return f"rows {len(left)} vs {len(right)}"
    if not left:
        return "no rows"
    bad = [(a, b) for a, b in zip(left, right) if a != b]
    if bad:
        return f"{len(bad)} of {len(left)} rows differ, first {str(bad[0])[:600]}"
    return None


if __name__ == "__main__":
    import __spark_entry__ as e
    from findery.session import build_session

    sf = f"/root/testdata/sf{sys.argv[1] if len(sys.argv) > 1 else '0.01'}"
    spark, con = build_session("oracle"), connect(sf)
    plans, sqls = e.queries(), e.oracle_sql()
    failed = 0
    for name in sys.argv[2:] or plans:
        t0 = time.time()
        try:
            if name in sqls:
                why = compare(spark, con, sf, plans[name], sqls[name])
            else:
                why = None if plans[name](spark, sf).count() > 0 else "no rows"
        except Exception as err:
            why = f"{type(err).__name__}: {str(err)[:1500]}"
            if "-v" in sys.argv:
                traceback.print_exc()
        failed += why is not None
        print(f"{'ok  ' if why is None else 'FAIL'} {name} {time.time() - t0:.1f}s {'' if name in sqls else '(no sql)'}"
              f"{'' if why is None else ' :: ' + why}", flush=True)
    print(f"{failed} failed")
