"""Compare Spark queries with their SQL counterparts: python tests/check.py [sf_dir] [name ...]"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    con.execute("SET TimeZone='UTC'")
    return con


def _cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v
    return v


def _sort_key(row):
    return tuple((v is None, str(type(v).__name__ in ("int", "float")), str(v)) for v in row)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_cell(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=_sort_key)


def same(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return a == b
    return a == b and (isinstance(a, bool) == isinstance(b, bool)) and (isinstance(a, float) == isinstance(b, float))


def compare(con, spark, sf_dir, fn, sql):
    df = fn(spark, sf_dir)
    s_cols, s_rows = rows_of(df.columns, [tuple(r) for r in df.collect()])
    con.execute(sql)
    d_cols, d_rows = rows_of([c[0] for c in con.description], con.fetchall())
    if s_cols != d_cols:
        return f"columns {s_cols} vs {d_cols}"
    if len(s_rows) != len(d_rows):
        return f"rows {len(s_rows)} vs {len(d_rows)}; e.g. {s_rows[:2]} vs {d_rows[:2]}"
    bad = [(a, b) for a, b in zip(s_rows, d_rows) if not all(same(x, y) for x, y in zip(a, b))]
    if bad:
        return f"{len(bad)} of {len(s_rows)} rows differ; e.g. {str(bad[0][0])[:700]}\n      vs {str(bad[0][1])[:700]}"
    return None if s_rows else "no rows"


def main(argv):
    from __spark_entry__ import oracle_sql, queries
    from evalweave.session import local_session

    ORACLES, QUERIES = oracle_sql(), queries()

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    names = argv[1:] or list(QUERIES)
    spark = local_session("check", shuffle_partitions=int(os.environ.get("CHECK_PARTITIONS", "8")))
    con = connect(sf_dir)
    failed = 0
    for name in names:
        t = time.time()
        try:
            if name in ORACLES:
                problem = compare(con, spark, sf_dir, QUERIES[name], ORACLES[name])
            else:
                n = QUERIES[name](spark, sf_dir).count()
                problem = None if n else "no rows"
        except Exception as e:  # noqa: BLE001
            problem = f"{type(e).__name__}: {str(e)[:300]}"
        kind = "sql" if name in ORACLES else "rows"
        if problem or len(names) < 40:
            print(f"{'FAIL' if problem else 'ok  '} {name} [{kind}] {time.time() - t:.1f}s {problem or ''}", flush=True)
        failed += bool(problem)
    print(f"{len(names) - failed} of {len(names)} ok")
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
