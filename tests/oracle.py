"""Run named queries beside their SQL twins: ``python tests/oracle.py [sf] [name ...]``."""

import math
import os
import sys
import tempfile
import time
import traceback
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def duck(folder):
    import duckdb
    c = duckdb.connect()
    for name in TABLES:
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return c


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "~"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, int) or type(v).__name__ == "Decimal" and v == v.to_integral_value():
        return str(int(v))
    if isinstance(v, float) or type(v).__name__ == "Decimal":
        return str(int(v)) if float(v).is_integer() else f"{float(v):.9g}"
    return str(v)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


def compare(names, rows, other_names, other_rows):
    if sorted(names) != sorted(other_names):
        return f"columns {sorted(names)} != {sorted(other_names)}"
    a, b = rows_of(names, rows), rows_of(other_names, other_rows)
    if len(a) != len(b):
        return f"rows {len(a)} != {len(b)}: only ours {[r for r in a if r not in set(b)][:3]} only sql {[r for r in b if r not in set(a)][:3]}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    return f"{len(bad)} of {len(a)} differ: {bad[:2]}" if bad else None


def main():
    import __spark_entry__ as entry
    from folioproof.plans.session import session
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    folder = f"/root/testdata/sf{sf}"
    spark = session("local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
                                   "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false",
                                   "spark.checkpoint.dir": tempfile.mkdtemp(prefix="run-", dir="/tmp")})
    spark.sparkContext.setLogLevel("OFF")
    c, sql = duck(folder), entry.oracle_sql()
    wanted = sys.argv[2:]
    bad = 0
    for name, fn in entry.queries().items():
        if wanted and name not in wanted and not any(w.endswith("*") and name.startswith(w[:-1]) for w in wanted):
            continue
        start = time.time()
        try:
            df = fn(spark, folder)
            rows = df.collect()
            took = time.time() - start
            if name in sql:
                t0 = time.time()
                res = c.execute(sql[name])
                problem = compare(df.columns, rows, [d[0] for d in res.description], res.fetchall())
                bad += problem is not None
                print(f"{'OK ' if problem is None else 'BAD'} {name} {len(rows)} {took:.2f}s duck {time.time() - t0:.2f}s {problem or ''}"[:700], flush=True)
            else:
                print(f"--  {name} {len(rows)} {took:.2f}s {rows[:2]}"[:300], flush=True)
        except Exception as error:  # noqa: BLE001
            bad += 1
            text = str(error).split("JVM stacktrace")[0]
            print(f"ERR {name} {type(error).__name__} {text[:500]}", flush=True)
            if os.environ.get("TRACE"):
                traceback.print_exc()
    print("bad", bad)
    spark.stop()


if __name__ == "__main__":
    main()
