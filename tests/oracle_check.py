"""Run queries next to their SQL checks and compare the rows.

    python tests/oracle_check.py [sf_dir] [query ...]
"""

from __future__ import annotations

import math
import pathlib
import sys
import time
from collections import Counter

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    return value


def rows_of(columns, rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_plain(r[i]) for i in order) for r in rows)


def compare(df, relation) -> tuple[bool, str]:
    mine = rows_of(df.columns, df.collect())
    theirs = rows_of(relation.columns, relation.fetchall())
    if sorted(df.columns) != sorted(relation.columns):
        return False, f"columns {sorted(df.columns)} != {sorted(relation.columns)}"
    extra, missing = mine - theirs, theirs - mine
    note = f"{sum(mine.values())} rows"
    if extra or missing:
        note += f"; only here {list(extra.items())[:3]}; only there {list(missing.items())[:3]}"
    return not extra and not missing, note


def main(sf_dir: str = "/root/testdata/sf0.01", *names: str) -> None:
    from __spark_entry__ import oracle_sql, queries
    from veilscan.session import local_session

    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con, oracles = connect(sf_dir), oracle_sql()
    for name, run in queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            df = run(spark, sf_dir)
            if name in oracles:
                ok, note = compare(df, con.sql(oracles[name]))
            else:
                ok, note = True, f"{df.count()} rows, no SQL"
        except Exception as problem:
            ok, note = False, f"{type(problem).__name__}: {str(problem)[:700]}"
        print(f"{'ok  ' if ok else 'FAIL'} {name:24s} {time.time() - start:6.1f}s {note[:1500]}", flush=True)


if __name__ == "__main__":
    main(*sys.argv[1:])
