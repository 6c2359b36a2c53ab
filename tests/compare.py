"""Compare registered Spark queries with their SQL twins in DuckDB."""

from __future__ import annotations

import math
import sys
import threading
import time

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET enable_progress_bar = false")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def normal(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    return repr(v)


def compare(spark_df, con, sql: str) -> str | None:
    stop = threading.Timer(60, con.interrupt)
    stop.start()
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    want = cursor.fetchall()
    stop.cancel()
    got = spark_df.collect()
    if sorted(names) != sorted(spark_df.columns):
        return f"columns differ: spark {sorted(spark_df.columns)} sql {sorted(names)}"
    order = sorted(names)
    at = [names.index(n) for n in order]
    a = sorted(tuple(normal(r[n]) for n in order) for r in got)
    b = sorted(tuple(normal(r[i]) for i in at) for r in want)
    if a == b:
        return None
    extra = [x for x in a if x not in set(b)][:3]
    missing = [x for x in b if x not in set(a)][:3]
    return f"rows spark {len(a)} sql {len(b)}\n  cols {order}\n  only spark {extra}\n  only sql {missing}"


def main(sf: str, *patterns: str) -> int:
    sys.path.insert(0, "/root/repo")
    import __spark_entry__ as entry
    from voxloom.session import local_session

    sf_dir = f"/root/testdata/{sf}"
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in queries.items():
        if patterns and not any(name.startswith(p) for p in patterns):
            continue
        t = time.time()
        try:
            df = fn(spark, sf_dir)
            if name in oracles:
                problem = compare(df, con, oracles[name])
            else:
                n = df.count()
                problem = None if n else "no rows"
        except Exception as e:
            problem = f"{type(e).__name__}: {str(e)[:1500]}"
        note = "" if name in oracles else " (rows only)"
        rows = ""
        if not problem and name in oracles:
            rows = con.execute(f"SELECT count(*) FROM ({oracles[name]})").fetchall()[0][0]
        print(f"{'ok  ' if not problem else 'FAIL'} {name}{note} {time.time()-t:.1f}s rows={rows} {problem or ''}", flush=True)
        bad += bool(problem)
    missing = set(oracles) - set(queries)
    print("bad", bad, "oracle without query", missing)
    return bad


if __name__ == "__main__":
    sys.exit(main(*sys.argv[1:]))
