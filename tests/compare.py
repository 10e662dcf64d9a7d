"""Side-by-side run of Spark queries and their SQL: python tests/compare.py [sf] [names]"""

from __future__ import annotations

import math
import os
import sys
import time
import traceback

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def normal(value):
    if isinstance(value, float) and math.isnan(value):
        return None
    if isinstance(value, float) and value == 0:
        return 0.0
    return value


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    data = [tuple(normal(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(data, key=repr)


def check(spark, con, name, query, sql, sf_dir):
    """None when both engines agree, else what differs."""
    df = query(spark, sf_dir)
    ours = table(df.columns, df.collect())
    rel = con.sql(sql)
    theirs = table(rel.columns, rel.fetchall())
    if ours[0] != theirs[0]:
        return f"columns {ours[0]} != {theirs[0]}"
    if len(ours[1]) != len(theirs[1]):
        return f"{len(ours[1])} rows != {len(theirs[1])}"
    for a, b in zip(ours[1], theirs[1]):
        if a != b or [type(x) for x in a] != [type(x) for x in b]:
            return f"{dict(zip(ours[0], a))}\n   != {dict(zip(ours[0], b))}"
    return None


def main() -> None:
    from __spark_entry__ import oracle_sql, queries
    from ledgerweave.session import local_session

    sf_dir = f"/root/testdata/sf{sys.argv[1] if len(sys.argv) > 1 else '0.01'}"
    wanted = sys.argv[2:]
    spark, con, oracles = local_session(), duck(sf_dir), oracle_sql()
    bad = []
    for name, query in queries().items():
        if wanted and name not in wanted:
            continue
        started = time.time()
        try:
            if name in oracles:
                problem = check(spark, con, name, query, oracles[name], sf_dir)
                verdict = "ok" if problem is None else f"DIFFERS {problem}"
            else:
                rows = query(spark, sf_dir).collect()
                verdict = f"rows {len(rows)}"
        except Exception as error:
            verdict = "FAILED " + "".join(traceback.format_exception_only(error))[:1500]
        print(f"{name:24} {time.time() - started:6.1f}s {verdict}", flush=True)
        if verdict.startswith(("DIFFERS", "FAILED")):
            bad.append(name)
    print("not equal:", bad)


if __name__ == "__main__":
    main()
