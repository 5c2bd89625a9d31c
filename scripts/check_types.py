"""Compare column types of each registered query (Spark) with its DuckDB oracle."""
from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from shelfspark.queries import oracle_sql, queries  # noqa: E402
from shelfspark.session import build_session  # noqa: E402

SPARK_TO_DUCK = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR",
                 "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMP WITH TIME ZONE",
                 "float": "FLOAT", "smallint": "SMALLINT", "tinyint": "TINYINT", "date": "DATE"}


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    spark = build_session("local[4]", shuffle_partitions=4)
    con = duckdb.connect()
    for t in ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
              "embeddings", "pages", "benchmark", "labels", "conversations"]:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    qs, ors = queries(), oracle_sql()
    for name in sorted(ors):
        s = {f.name: f.dataType.simpleString() for f in qs[name](spark, sf).schema.fields}
        d = {r[0]: r[1] for r in con.execute(f"DESCRIBE {ors[name]}").fetchall()}
        bad = [(c, s[c], d.get(c)) for c in s if SPARK_TO_DUCK.get(s[c], s[c].upper()) != d.get(c)]
        if bad:
            print(name, bad)
    print("done")


if __name__ == "__main__":
    main()
