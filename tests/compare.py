"""Runs registered queries on Spark and DuckDB side by side.

    python tests/compare.py [sf_dir] [query …]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def cell(v, digits):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return float(f"{v:.{digits}g}") + 0.0
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(cell(x, digits) for x in v)
    return v


def canon(rows, digits=9):
    return sorted((tuple(cell(v, digits) for v in r) for r in rows), key=repr)


def kind(name: str) -> str:
    name = name.lower()
    for k, words in {"int": ("int", "long", "short"), "float": ("double", "float"),
                     "str": ("string", "varchar"), "bool": ("bool",), "ts": ("timestamp",)}.items():
        if any(w in name for w in words):
            return k
    return name


def duck(sf_dir):
    import duckdb
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def compare(spark, con, name, fn, sql, sf_dir):
    """Problems found (empty when both sides agree) and the Spark seconds."""
    start = time.time()
    df = fn(spark, sf_dir)
    cols = sorted(df.columns)
    got = [tuple(r[c] for c in cols) for r in df.collect()]
    took = time.time() - start
    if sql is None:
        return ([] if got else ["no rows"]), took, len(got), "rows only"
    cur = con.execute(sql)
    names = [x[0] for x in cur.description]
    types = {x[0]: kind(str(x[1])) for x in cur.description}
    want = [tuple(dict(zip(names, r))[c] for c in cols) if set(names) == set(cols) else r
            for r in cur.fetchall()]
    problems = []
    if sorted(names) != cols:
        return [f"columns {cols} vs {sorted(names)}"], took, len(got), ""
    for c, t in df.dtypes:
        if kind(t) != types[c]:
            problems.append(f"type of {c}: {t} vs {types[c]}")
    if len(got) != len(want):
        problems.append(f"rows {len(got)} vs {len(want)}")
    a, b = canon(got), canon(want)
    if a != b:
        diff = [(x, y) for x, y in zip(a, b) if x != y]
        problems.append(f"{len(diff)} differing rows of {cols}, first: {diff[:2]}")
    exact = canon(got, 17) == canon(want, 17)
    return problems, took, len(got), "exact" if exact else "close"


def main():
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry
    args = sys.argv[1:]
    sf_dir = args[0] if args else "/root/testdata/sf0.01"
    wanted = args[1:]
    spark = (SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false")
             .config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g")
             .config("spark.ui.showConsoleProgress", "false")
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    bad = 0
    for name, fn in entry.queries().items():
        if wanted and name not in wanted:
            continue
        try:
            problems, took, n, how = compare(
                spark, con, name, fn, entry.oracle_sql().get(name), sf_dir)
        except Exception as e:  # noqa: BLE001
            problems, took, n, how = [f"{type(e).__name__}: {str(e)[:600]}"], 0.0, 0, ""
        bad += bool(problems)
        print(f"{'FAIL' if problems else 'ok  '} {name:32s} {n:7d} rows {took:6.2f}s {how}", *problems,
              sep="\n      " if problems else " ", flush=True)
    print("failures:", bad)


if __name__ == "__main__":
    main()
