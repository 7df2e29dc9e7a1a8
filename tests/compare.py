"""Run registered queries beside their SQL and compare the rows."""

from __future__ import annotations

import datetime
import decimal
import sys
import time
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return con


def plain(value):
    if isinstance(value, (float, decimal.Decimal)):
        return round(float(value), 6)
    if isinstance(value, bool):
        return value
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def rows(names: list[str], data) -> Counter:
    order = sorted(range(len(names)), key=names.__getitem__)
    return Counter(tuple(plain(row[i]) for i in order) for row in data)


def differences(spark, folder: str, name: str, query, sql: str | None) -> tuple[str, int, float]:
    """(what differs or '', rows, seconds)."""
    start = time.time()
    df = query(spark, folder)
    found = [tuple(r) for r in df.collect()]
    seconds = time.time() - start
    if sql is None:
        return ("" if found else "no rows"), len(found), seconds
    result = connect(folder).execute(sql)
    names = [d[0] for d in result.description]
    expected = result.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}", len(found), seconds
    got, want = rows(df.columns, found), rows(names, expected)
    if got == want:
        return ("" if found else "no rows"), len(found), seconds
    extra, missing = got - want, want - got
    return (
        f"{sum(extra.values())} extra {list(extra)[:3]}; {sum(missing.values())} missing {list(missing)[:3]}",
        len(found),
        seconds,
    )


if __name__ == "__main__":
    sys.path.insert(0, ".")
    from threadshelf import checks
    from threadshelf.session import local_session

    folder, wanted = sys.argv[1], sys.argv[2:]
    checks.load()
    spark = local_session("compare")
    bad = 0
    for name, query in checks.QUERIES.items():
        if wanted and name not in wanted and not any(query.__module__.endswith(w) for w in wanted):
            continue
        try:
            problem, n, seconds = differences(spark, folder, name, query, checks.SQL.get(name))
        except Exception as error:
            problem, n, seconds = f"{type(error).__name__}: {str(error)[:1500]}", 0, 0
        bad += bool(problem)
        kind = "sql" if name in checks.SQL else "rows"
        print(f"{'FAIL' if problem else 'ok':4} {kind:4} {name:28} {n:7} rows {seconds:6.2f}s {problem[:1800]}", flush=True)
    print("failed:", bad)
