"""Compare registered queries with their SQL in DuckDB: python tests/oracle.py [sf] [names…]"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402
from pyspark.sql import SparkSession  # noqa: E402

from eoframe.plans.views import TABLES  # noqa: E402
from eoframe.session import SETTINGS  # noqa: E402


SMALL = "/root/testdata/sf0.001"


def session(cpus: str = "8") -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for k, v in SETTINGS.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET threads = 4")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return (0, "")
    if isinstance(v, bool):
        return (1, str(v))
    if isinstance(v, float):
        return (2, repr(v + 0.0))
    return (1, str(v))


KINDS = {
    "BIGINT": "int", "INTEGER": "int", "SMALLINT": "int", "TINYINT": "int", "HUGEINT": "huge",
    "DOUBLE": "float", "FLOAT": "float", "VARCHAR": "str", "BOOLEAN": "bool", "DATE": "date", "TIMESTAMP": "ts",
    "bigint": "int", "int": "int", "smallint": "int", "tinyint": "int", "double": "float", "float": "float",
    "string": "str", "boolean": "bool", "date": "date", "timestamp": "ts",
}


def compare(df, con, sql: str) -> str:
    """'' when rows, columns, kinds and values agree, else what differs."""
    columns = sorted(df.columns)
    rows = [tuple(x) for x in df.select(*columns).collect()]
    described = con.execute("DESCRIBE " + sql).fetchall()
    kinds = {d[0]: KINDS.get(d[1], d[1]) for d in described}
    if sorted(kinds) != columns:
        return f"columns {columns} != {sorted(kinds)}"
    mine = {n: KINDS.get(t, t) for n, t in df.dtypes}
    wrong = {c: (mine[c], kinds[c]) for c in columns if mine[c] != kinds[c]}
    if wrong:
        return f"kinds {wrong}"
    listed = ", ".join('"' + c + '"' for c in columns)
    theirs = con.execute(f"SELECT {listed} FROM ({sql}) AS q").fetchall()
    if len(rows) != len(theirs):
        return f"rows {len(rows)} != {len(theirs)}"
    a = sorted(tuple(map(_cell, x)) for x in rows)
    b = sorted(tuple(map(_cell, x)) for x in theirs)
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        x, y = bad[0]
        return f"{len(bad)} of {len(rows)} rows differ, e.g. {[(c, p[1], q[1]) for c, p, q in zip(columns, x, y) if p != q]}"
    return "" if rows else "EMPTY"


def main() -> int:
    from eoframe.plans.catalogue import RUNS, SQL

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    names = sys.argv[2:] or list(RUNS)
    sf_dir = f"/root/testdata/sf{sf}"
    spark, con = session(), connect(sf_dir)
    spark.sparkContext.setLogLevel("ERROR")
    failed = 0
    for n in names:
        t0 = time.time()
        try:
            df = RUNS[n](spark, sf_dir)
            if n in SQL:
                verdict = compare(df, con, SQL[n])
                note = "ok" if not verdict else verdict
            else:
                verdict, note = "", f"rows only: {df.count()}"
        except Exception as e:  # noqa: BLE001
            verdict = note = f"{type(e).__name__}: {str(e)[:600]}"
        failed += bool(verdict)
        print(f"{'FAIL' if verdict else 'ok  '} {n:32s} {time.time() - t0:6.2f}s  {note if verdict or n not in SQL else ''}", flush=True)
    print(f"{len(names) - failed} of {len(names)} agree")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
