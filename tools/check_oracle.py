"""Compare registered queries with their SQL on one data folder.

usage: python tools/check_oracle.py [--plain] [--dir DIR] [name-part ...]

``--plain`` uses a session without this package's settings.
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb
import pandas as pd
from pyspark.sql import SparkSession

from ledgerloom.plans import load_queries
from ledgerloom.session import build_session

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def cell(v):
    if v is None or v is pd.NA or (isinstance(v, float) and math.isnan(v)) or v is pd.NaT:
        return "NULL"
    if hasattr(v, "tolist") and not isinstance(v, (str, bytes)):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(cell(x) for x in v) + "]"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return repr(v)
    return str(v)


def kind(s: pd.Series) -> str:
    d = str(s.dtype).lower()
    for k in ("int", "float", "bool", "datetime"):
        if k in d:
            return k
    vals = s.dropna()
    return type(vals.iloc[0]).__name__ if len(vals) else "empty"


def compare(sdf: pd.DataFrame, ddf: pd.DataFrame) -> str:
    if sorted(sdf.columns) != sorted(ddf.columns):
        return f"COLUMNS spark={sorted(sdf.columns)} sql={sorted(ddf.columns)}"
    cols = sorted(sdf.columns)
    if len(sdf) != len(ddf):
        return f"ROWS spark={len(sdf)} sql={len(ddf)}"
    notes = []
    for c in cols:
        a, b = kind(sdf[c]), kind(ddf[c])
        if a != b and {a, b} not in ({"list", "ndarray"},) and "empty" not in (a, b):
            if not (sdf[c].isna().any() and {a, b} <= {"int", "float"}):
                notes.append(f"type {c}: {a}/{b}")
    a = sorted(map(tuple, ([cell(x) for x in row] for row in sdf[cols].astype(object).itertuples(index=False))))
    b = sorted(map(tuple, ([cell(x) for x in row] for row in ddf[cols].astype(object).itertuples(index=False))))
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        x, y = bad[0]
        diff = [(c, p, q) for c, p, q in zip(cols, x, y) if p != q]
        return f"VALUES {len(bad)}/{len(a)} rows differ, first: {diff[:4]}"
    if notes:
        return "TYPES " + "; ".join(notes)
    return "ok"


def main() -> None:
    args = sys.argv[1:]
    folder = "/root/testdata/sf0.01"
    plain = args[:1] == ["--plain"]
    args = args[1:] if plain else args
    if args[:1] == ["--dir"]:
        folder, args = args[1], args[2:]
    if plain:
        spark = SparkSession.builder.master("local[8]").config("spark.ui.showConsoleProgress", "false").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "8").getOrCreate()
        spark.sparkContext.setLogLevel("ERROR")
    else:
        spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
                                                "spark.driver.memory": "8g"})
    con = duck(folder)
    bad = 0
    for name, q in load_queries().items():
        if args and not any(a in name for a in args):
            continue
        t0 = time.time()
        try:
            sdf = q(spark, folder).toPandas()
            t1 = time.time()
            sql = q.oracle()
            if sql is None:
                res = "rows-only" if len(sdf) else "EMPTY"
            else:
                res = compare(sdf, con.execute(sql).df())
        except Exception as e:  # noqa: BLE001
            t1, res, sdf = time.time(), "ERROR " + str(e).split("JVM stacktrace")[0][:700], []
        bad += res not in ("ok", "rows-only")
        print(f"{'  ' if res in ('ok', 'rows-only') else '! '}{name:42s} rows={len(sdf):<7d} {t1 - t0:5.1f}s  {res}", flush=True)
    print("failures:", bad)


if __name__ == "__main__":
    main()
