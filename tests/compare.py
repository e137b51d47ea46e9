"""Runs registered queries next to their DuckDB checks. `python tests/compare.py [sf] [name part ...]`."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


WIDTHS: list[tuple] = []  # integer columns whose width differs between the engines


def norm(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return str(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(norm(x) for x in v) + "]"
    if isinstance(v, dict):
        return "{" + ",".join(f"{k}:{norm(x)}" for k, x in sorted(v.items())) + "}"
    if hasattr(v, "asDict"):
        return norm(v.asDict())
    return str(v)


def kind(name: str) -> str:
    """Type family, so an integer of another width passes and a decimal does not pass as a double."""
    name = name.lower()
    if name.startswith(("bigint", "int", "tinyint", "smallint", "hugeint", "long")) and "[" not in name:
        return "int"
    if name.startswith(("varchar", "string")) and "[" not in name:
        return "str"
    return name.split("(")[0]


def compare(spark, con, sf_dir, job, sql):
    df = job(spark, sf_dir)
    cols = sorted(df.columns)
    plan = df._jdf.queryExecution().executedPlan().toString()
    for node in ("CartesianProduct", "BroadcastNestedLoopJoin"):
        if node in plan:
            return 0, f"plan holds {node}"
    got = sorted(tuple(norm(r[c]) for c in cols) for r in df.collect())
    if sql is None:
        return len(got), None
    res = con.execute(sql)
    names = [d[0] for d in res.description]
    types = {d[0]: str(d[1]) for d in res.description}
    rows = res.fetchall()
    if sorted(names) != cols:
        return len(got), f"columns differ: spark {cols} duckdb {sorted(names)}"
    for f in df.schema.fields:
        a, b = kind(f.dataType.simpleString()), kind(types[f.name])
        if a == b == "int" and (f.dataType.simpleString() == "int") != (types[f.name].upper() == "INTEGER"):
            WIDTHS.append((f.name, f.dataType.simpleString(), types[f.name]))
        if a != b and not a.startswith(("array", "struct", "map")):
            return len(got), f"type of {f.name}: spark {a} duckdb {types[f.name]}"
    at = [names.index(c) for c in cols]
    want = sorted(tuple(norm(r[i]) for i in at) for r in rows)
    if got != want:
        a, b = set(got), set(want)
        return len(got), (f"rows spark {len(got)} duckdb {len(want)}; only spark {len(a - b)}: "
                          f"{sorted(a - b)[:3]}; only duckdb {len(b - a)}: {sorted(b - a)[:3]}; cols {cols}")
    return len(got), None


def session():
    """A session without our settings, as a driver might hand it over."""
    from pyspark.sql import SparkSession
    spark = (SparkSession.builder.master("local[8]").appName("compare")
             .config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "12g")
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main(argv):
    import __spark_entry__ as entry
    sf = argv[0] if argv else "sf0.01"
    sf_dir = f"/root/testdata/{sf}"
    spark, con = session(), duck(sf_dir)
    jobs, checks = entry.queries(), entry.oracle_sql()
    bad = []
    for name, job in jobs.items():
        if argv[1:] and not any(part in name for part in argv[1:]):
            continue
        t = time.time()
        try:
            n, problem = compare(spark, con, sf_dir, job, checks.get(name))
        except Exception as e:  # report and go on with the next query
            n, problem = -1, f"{type(e).__name__}: {str(e)[:1500]}"
        if WIDTHS:
            print("  widths", name, WIDTHS, flush=True)
            WIDTHS.clear()
        label = "rows-only" if name not in checks else "ok" if problem is None else "DIFF"
        if problem:
            label = "DIFF"
            bad.append(name)
        print(f"{label:9} {name:36} {n:7} rows {time.time() - t:6.1f}s {problem or ''}", flush=True)
    print("failing:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
