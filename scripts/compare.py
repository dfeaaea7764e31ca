"""Compare registered queries with their comparison SQL on a scale-factor folder.

Usage: python scripts/compare.py [sf_dir] [name-prefix ...]
"""
import sys, time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from feedloom import build_session
from feedloom.catalog import load_all

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()

def norm(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(str(r[i]) for i in order) for r in rows), [names[i] for i in order]

def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    want = sys.argv[2:]
    spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
                          "spark.driver.memory": "8g", "spark.sql.session.timeZone": "UTC"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    bad = []
    for name, q in load_all().items():
        if want and not any(name.startswith(w) for w in want):
            continue
        t0 = time.time()
        try:
            df = q.run(spark, sf)
            got, cols = norm([tuple(r) for r in df.collect()], df.columns)
        except Exception as e:
            print(f"ERR  {name}: {str(e)[:600]}"); bad.append(name); continue
        dt = time.time() - t0
        if q.sql is None:
            print(f"ROWS {name}: {len(got)} rows {dt:.2f}s"); continue
        try:
            rel = con.execute(q.sql)
            exp, ecols = norm(rel.fetchall(), [d[0] for d in rel.description])
        except Exception as e:
            print(f"SQL  {name}: {str(e)[:500]}"); bad.append(name); continue
        if cols != ecols or got != exp:
            bad.append(name)
            print(f"DIFF {name}: cols {cols} vs {ecols}; rows {len(got)} vs {len(exp)}")
            g, e = set(got), set(exp)
            for r in list(g - e)[:3]: print("   spark", str(r)[:300])
            for r in list(e - g)[:3]: print("   sql  ", str(r)[:300])
        else:
            print(f"OK   {name}: {len(got)} rows {dt:.2f}s")
    print("BAD", bad)

main()
