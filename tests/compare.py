"""Run registered queries next to their DuckDB text and compare whole results.

    python tests/compare.py [sf_dir] [name ...]
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def difference(spark, con, query, text: str, sf_dir: str) -> str | None:
    """None when columns, row counts and all values agree, else a short account."""
    df = query(spark, sf_dir)
    names = sorted(df.columns)
    got = df.toArrow()
    con.register("spark_result", got)
    want = [d[0] for d in con.execute(f"DESCRIBE {text}").fetchall()]
    if sorted(want) != names:
        return f"columns {names} vs {sorted(want)}"
    cols = ", ".join(f'"{n}"' for n in names)
    con.execute(f"CREATE OR REPLACE TEMP TABLE want AS SELECT {cols} FROM ({text})")
    n = con.execute("SELECT count(*) FROM want").fetchall()[0][0]
    if n != got.num_rows:
        return f"rows {got.num_rows} vs {n}"
    if n == 0:
        return "no rows"
    for a, b in (("spark_result", "want"), ("want", "spark_result")):
        left = con.execute(f"SELECT {cols} FROM {a} EXCEPT ALL SELECT {cols} FROM {b} ORDER BY ALL LIMIT 2").fetchall()
        if left:
            return f"only in {a}: {names} {left}"
    return None


def main() -> int:
    from __spark_entry__ import oracle_sql, queries
    from runmosaic.session import build_session
    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and "/" in args[0] else "/root/testdata/sf0.01"
    spark, con = build_session(), connect(sf_dir)
    qs, sq = queries(), oracle_sql()
    bad = 0
    for name in args or list(qs):
        t = time.time()
        try:
            if name in sq:
                d = difference(spark, con, qs[name], sq[name], sf_dir)
            else:
                d = None if qs[name](spark, sf_dir).count() else "no rows"
        except Exception as e:  # report and go on to the next query
            d = f"{type(e).__name__}: {str(e)[:600]}"
        bad += d is not None
        print(f"{'ok ' if d is None else 'BAD'} {name} {time.time() - t:.1f}s {'' if name in sq else '(rows only)'} {d or ''}",
              flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main())
