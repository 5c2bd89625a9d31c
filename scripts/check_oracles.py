"""Run registered queries on Spark and their DuckDB oracle side by side and compare.

usage: python scripts/check_oracles.py [sf_dir] [name ...]
"""
from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402
import pandas as pd  # noqa: E402

from shelfspark.queries import oracle_sql, queries  # noqa: E402
from shelfspark.session import build_session  # noqa: E402

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 9)
    if hasattr(v, "tolist") and not isinstance(v, (str, bytes)):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, pd.Timestamp):
        return v.to_pydatetime().replace(tzinfo=None)
    if v is pd.NaT:
        return None
    try:
        if pd.isna(v):
            return None
    except (TypeError, ValueError):
        pass
    if hasattr(v, "item"):
        try:
            return norm(v.item())
        except Exception:
            pass
    return v


def rows(df: pd.DataFrame):
    cols = sorted(df.columns)
    out = [tuple(norm(x) for x in r) for r in df[cols].itertuples(index=False, name=None)]
    return cols, sorted(out, key=lambda r: tuple((x is None, str(type(x)), str(x)) for x in r))


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 and "/" in sys.argv[1] else "/root/testdata/sf0.01"
    names = [a for a in sys.argv[1:] if "/" not in a]
    tz = os.environ.get("CHECK_SESSION_TZ")  # e.g. America/Los_Angeles: results must not depend on it
    if os.environ.get("CHECK_PLAIN_SESSION"):
        # a bare session, as a caller would create it (none of our defaults)
        from pyspark.sql import SparkSession
        spark = (SparkSession.builder.master("local[*]").config("spark.sql.shuffle.partitions", "8")
                 .config("spark.ui.enabled", "false").getOrCreate())
    else:
        spark = build_session("local[8]", shuffle_partitions=8,
                              extra={"spark.sql.session.timeZone": tz} if tz else None)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    qs, ors = queries(), oracle_sql()
    bad = 0
    for name in (names or list(qs)):
        t0 = time.time()
        try:
            sdf = qs[name](spark, sf).toPandas()
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: spark error {type(e).__name__}: {str(e)[:400]}")
            bad += 1
            continue
        ts = time.time() - t0
        if name not in ors:
            print(f"ROWS {name}: {len(sdf)} rows (no oracle) {ts:.1f}s")
            continue
        try:
            odf = con.execute(ors[name]).df()
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: duckdb error {str(e)[:400]}")
            bad += 1
            continue
        sc, sr = rows(sdf)
        oc, orr = rows(odf)
        if sc != oc:
            print(f"FAIL {name}: columns {sc} vs {oc}")
            bad += 1
        elif len(sr) != len(orr):
            print(f"FAIL {name}: rows {len(sr)} vs {len(orr)}")
            bad += 1
        elif sr != orr:
            diff = [(a, b) for a, b in zip(sr, orr) if a != b][:3]
            print(f"FAIL {name}: values differ ({len(sr)} rows) e.g. {diff}")
            bad += 1
        else:
            print(f"OK   {name}: {len(sr)} rows {ts:.1f}s")
    print(f"{bad} failing")


if __name__ == "__main__":
    main()
