"""Run registered queries against their SQL in DuckDB and report differences."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        p = Path(sf_dir) / f"{t}.parquet"
        if p.exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p}'")
    return con


def _key(row: tuple) -> tuple:
    return tuple((v is None, str(type(v)) if v is None else "", str(v)) for v in row)


def _rows(cols: list[str], rows: list[tuple]) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [cols[i] for i in order], sorted((tuple(r[i] for i in order) for r in rows), key=_key)


def differences(df, con, sql: str, exact: bool = True) -> list[str]:
    cols, rows = _rows(df.columns, [tuple(x) for x in df.collect()])
    cur = con.execute(sql)
    dcols, drows = _rows([c[0] for c in cur.description], cur.fetchall())
    out = []
    if cols != dcols:
        return [f"columns {cols} vs {dcols}"]
    if len(rows) != len(drows):
        return [f"rows {len(rows)} vs {len(drows)}", f"spark {rows[:2]}", f"duck {drows[:2]}"]
    if not rows:
        out.append("no rows")
    bad = 0
    for a, b in zip(rows, drows):
        for c, x, y in zip(cols, a, b):
            same = x == y and type(x) is type(y)
            if not same and not exact and isinstance(x, float) and isinstance(y, float):
                same = math.isclose(x, y, rel_tol=1e-6, abs_tol=2e-6)
            if isinstance(x, float) and math.isnan(x):
                same = False
            if not same:
                bad += 1
                if bad <= 4:
                    out.append(f"{c}: {x!r} vs {y!r} in {a}"[:400])
    if bad:
        out.append(f"{bad} cells differ of {len(rows)} rows")
    return out


def main(argv: list[str]) -> int:
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    import __spark_entry__ as entry
    from barweave.session import local_session

    sf = argv[0]
    wanted = argv[1:]
    spark = local_session("8")
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf)
    qs, sqls = entry.queries(), entry.oracle_sql()
    failed = 0
    for k, fn in qs.items():
        if wanted and not any(k == w or (w.endswith("*") and k.startswith(w[:-1])) for w in wanted):
            continue
        t = time.time()
        try:
            df = fn(spark, sf)
            if k in sqls:
                diff = differences(df, con, sqls[k])
                tag = "ok" if not diff else "DIFF"
            else:
                n = len(df.collect())
                diff, tag = ([] if n else ["no rows"]), f"rows={n}"
        except Exception as e:  # noqa: BLE001
            diff, tag = [str(e)[:1500]], "ERROR"
        failed += bool(diff)
        print(f"\n{tag:6} {time.time() - t:6.2f}s {k}", flush=True)
        for line in diff:
            print("        ", line, flush=True)
    print("failed", failed)
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
