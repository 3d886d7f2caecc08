"""Run queries in Spark and their SQL in DuckDB, and compare rows regardless of order.

    python -m tests.compare [sf_dir] [name-part ...]
"""

from __future__ import annotations

import decimal
import math
import sys
import time

import duckdb
import numpy as np

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def canon(value):
    if value is None or value is np.nan:
        return None
    if isinstance(value, (bool, np.bool_)):
        return bool(value)
    if isinstance(value, (int, np.integer)):
        return int(value)
    if isinstance(value, decimal.Decimal):
        return round(float(value), 6)
    if isinstance(value, (float, np.floating)):
        return None if math.isnan(value) else round(float(value), 6) + 0.0
    if isinstance(value, (list, tuple, np.ndarray)):
        return tuple(canon(v) for v in value)
    return str(value)


def kind_of(type_name: str) -> str:
    """Coarse type: sizes of integers and floats do not matter, but 128-bit sums and decimals do."""
    if "[" in type_name or type_name.startswith("array"):
        return "list"
    if type_name in ("tinyint", "smallint", "int", "integer", "bigint"):
        return "int"
    if type_name in ("double", "float"):
        return "float"
    if type_name in ("string", "varchar"):
        return "text"
    return type_name.split("(")[0].replace("_ntz", "")


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(canon(r[i]) for i in order) for r in rows), key=repr)


def compare(df, con, sql: str) -> str | None:
    """None when equal, else a short description of the difference."""
    got_rows = [tuple(r) for r in df.collect()]
    cur = con.execute(sql)
    cols = [c[0] for c in cur.description]
    want_rows = cur.fetchall()
    if sorted(df.columns) != sorted(cols):
        return f"columns differ: {sorted(set(df.columns) ^ set(cols))}"
    kinds = {n: kind_of(t) for n, t in df.dtypes}
    clash = [f"{c[0]}: {kinds[c[0]]} vs {c[1]}" for c in cur.description if kinds[c[0]] != kind_of(str(c[1]).lower())]
    if clash:
        return f"types differ: {clash}"
    got, want = rows_of(df.columns, got_rows), rows_of(cols, want_rows)
    if len(got) != len(want):
        return f"rows {len(got)} vs {len(want)}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        return f"{len(bad)} of {len(got)} rows differ, first: spark={bad[0][0]} sql={bad[0][1]} cols={sorted(cols)}"[:900]
    return None


def main() -> int:
    from gearwatch.catalog import ORACLES, QUERIES
    from gearwatch.session import build_session

    args = sys.argv[1:]
    sf_dir = args[0] if args else "/root/testdata/sf0.01"
    parts = args[1:]
    spark = build_session("compare", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    failed = 0
    for name, fn in QUERIES.items():
        if parts and not any(p in name for p in parts):
            continue
        begin = time.time()
        try:
            df = fn(spark, sf_dir)
            if name in ORACLES:
                problem = compare(df, con, ORACLES[name])
                n = "" if problem else df.count()
            else:
                n = df.count()
                problem = None
        except Exception as err:  # noqa: BLE001
            problem, n = f"{type(err).__name__}: {str(err)[:1200]}", ""
        failed += problem is not None
        kind = f"sql rows={n}" if name in ORACLES else f"rows={n}"
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} [{kind}] {time.time() - begin:.1f}s {problem or ''}", flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(main())
