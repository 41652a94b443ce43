"""Compare registered queries with their SQL in DuckDB: python tests/sql_check.py [folder] [name prefix ...]"""

from __future__ import annotations

import datetime
import decimal
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry_module  # noqa: E402
from queries.base import TABLES  # noqa: E402
from tablelab.session import local_session  # noqa: E402


def _cell(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else v + 0.0
    if isinstance(v, (datetime.datetime, datetime.date)):
        return str(v)
    return v


def _kind(v):
    return "number" if isinstance(v, (int, float)) and not isinstance(v, bool) else type(v).__name__


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([tuple(_cell(r[i]) for i in order) for r in rows], key=repr)


def compare(spark, con, folder, name):
    """(status, seconds, rows, note) of one query."""
    start = time.time()
    df = entry_module.queries()[name](spark, folder)
    got = df.collect()
    seconds = time.time() - start
    sql = entry_module.oracle_sql().get(name)
    if sql is None:
        return "rows-only", seconds, len(got), ""
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(names) != sorted(df.columns):
        return "FAIL", seconds, len(got), f"columns {sorted(df.columns)} vs {sorted(names)}"
    a, b = rows_of(df.columns, got), rows_of(names, want)
    if a == b:
        types = {r: str(d[1]) for r, d in zip(names, cur.description)}
        loose = [f.name for f in df.schema.fields
                 if (f.dataType.typeName() in ("integer", "long")) != (types[f.name] in ("NUMBER", "INTEGER", "BIGINT"))]
        return "ok", seconds, len(got), f"types differ: {[(c, dict(df.dtypes)[c], types[c]) for c in loose]}" if loose else ""
    note = f"rows {len(a)} vs {len(b)}"
    for x, y in zip(a, b):
        if x != y:
            note += f"\n    spark {x}\n    sql   {y}"
            break
    return "FAIL", seconds, len(got), note


def connect(folder):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def main() -> int:
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark = local_session()
    con = connect(folder)
    bad = 0
    for name in entry_module.queries():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        try:
            status, seconds, rows, note = compare(spark, con, folder, name)
        except Exception as error:  # report and go on with the next query
            status, seconds, rows, note = "ERROR", 0.0, 0, str(error)[:700]
        bad += status in ("FAIL", "ERROR")
        print(f"{status:9} {name:40} {seconds:7.2f}s {rows:8d} {note}", flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
