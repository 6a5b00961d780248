"""Compare registered queries with their SQL: ``python tests/check_oracle.py [sf_dir] [name ...]``."""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    return v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr)


TIMES = {}


def compare(con, df, sql) -> str:
    """'' when equal, else what differs."""
    t0 = time.time()
    names, got = df.columns, [tuple(r) for r in df.collect()]
    t1 = time.time()
    cur = con.execute(sql)
    want_names, want = [x[0] for x in cur.description], cur.fetchall()
    TIMES["run"], TIMES["sql"] = t1 - t0, time.time() - t1
    if sorted(names) != sorted(want_names):
        return f"columns {sorted(names)} != {sorted(want_names)}"
    a, b = rows_of(names, got), rows_of(want_names, want)
    if len(a) != len(b):
        extra = [x for x in a if x not in set(b)][:2] if len(a) < 20000 else []
        missing = [x for x in b if x not in set(a)][:2] if len(a) < 20000 else []
        return f"rows {len(a)} != {len(b)} spark-only {extra} sql-only {missing}"
    for x, y in zip(a, b):
        if x != y:
            return f"row {sorted(names)}: {x} != {y}"
    spark_types = {f.name: f.dataType.simpleString() for f in df.schema}
    duck_types = {x[0]: str(x[1]) for x in cur.description}
    pair = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP"}
    bad = {n: (t, duck_types[n]) for n, t in spark_types.items() if not duck_types[n].startswith(pair.get(t, "?"))}
    return f"types {bad}" if bad else ""


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    from __spark_entry__ import oracle_sql, queries

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    only = sys.argv[2:]
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.ui.enabled", "false").config("spark.driver.memory", "8g")
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls, failed = duck(sf), oracle_sql(), []
    for name, fn in queries().items():
        if only and name not in only:
            continue
        t = time.time()
        TIMES.clear()
        try:
            df = fn(spark, sf)
            TIMES["build"] = time.time() - t
            msg = compare(con, df, sqls[name]) if name in sqls else f"(no SQL) rows {df.count()}"
        except Exception as err:  # report and go on
            msg = f"ERROR {type(err).__name__} {str(err)[:700]}"
        ok = msg == "" or msg.startswith("(no SQL)")
        if not ok:
            failed.append(name)
        print(f"{'ok  ' if ok else 'FAIL'} {name} {time.time() - t:.1f}s {' '.join(f'{k}={v:.1f}' for k, v in TIMES.items())} {msg[:900]}", flush=True)
    print("failed:", failed)
