"""Side-by-side run of the registered queries and their SQL."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels"
    " conversations"
).split()


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    return value


def normal(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(_cell(r[i]) for i in order) for r in data), key=repr)


def compare(spark, con, sf_dir, name, query, sql):
    """Difference of the two results as text, empty if equal; and the number of rows."""
    frame = query(spark, sf_dir)
    columns, mine = normal(frame.columns, [tuple(r) for r in frame.collect()])
    if sql is None:
        return "", len(mine), frame
    got = con.sql(sql)
    other, theirs = normal(got.columns, got.fetchall())
    if columns != other:
        return f"columns {columns} != {other}", len(mine), frame
    if mine != theirs:
        extra, missing = set(mine) - set(theirs), set(theirs) - set(mine)
        return (
            f"{len(mine)} rows against {len(theirs)}; only Spark {list(extra)[:2]}; only SQL {list(missing)[:2]}",
            len(mine),
            frame,
        )
    return "", len(mine), frame


def main() -> None:
    root = Path(__file__).resolve().parents[1]
    sys.path.insert(0, str(root))
    import __spark_entry__ as entry
    from chunkloom.session import build_session

    sf_dir = sys.argv[1]
    wanted = sys.argv[2:]
    spark = build_session("local[8]", 8, **{"spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, sqls = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, query in queries.items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            diff, count, _ = compare(spark, con, sf_dir, name, query, sqls.get(name))
        except Exception as err:  # noqa: BLE001
            diff, count = f"{type(err).__name__}: {str(err)[:1500]}", -1
        bad += bool(diff)
        print(f"{'BAD' if diff else 'ok '} {name} rows={count} {time.time() - start:.1f}s {diff}", flush=True)
    print(f"{bad} bad")


if __name__ == "__main__":
    main()
