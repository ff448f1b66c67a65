"""Run registered queries next to their SQL: ``python tests/check_oracles.py [sf] [name ...]``."""

from __future__ import annotations

import math
import sys
import time
from decimal import Decimal
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


def plain(value):
    if isinstance(value, Decimal):
        value = float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 5) + 0.0
    if isinstance(value, int) and not isinstance(value, bool):
        return round(float(value), 5)
    return None if value is None else str(value)


def compare(spark, sf: str, name: str) -> str:
    """Empty when both sides agree, else what differs; the seconds are not compared."""
    import duckdb

    from __spark_entry__ import oracle_sql, queries

    df = queries()[name](spark, sf)
    columns = sorted(df.columns)
    mine = sorted((tuple(plain(v) for v in row) for row in df.select(*columns).collect()), key=repr)
    sql = oracle_sql().get(name)
    if sql is None:
        return "" if mine else "no rows"
    con = duckdb.connect()
    for table in Path(sf).glob("*.parquet"):
        con.execute(f"create view {table.stem} as select * from '{table}'")
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    if sorted(names) != columns:
        return f"columns {columns} and {sorted(names)}"
    order = [names.index(c) for c in columns]
    theirs = sorted((tuple(plain(r[i]) for i in order) for r in cursor.fetchall()), key=repr)
    if len(mine) != len(theirs):
        return f"{len(mine)} rows and {len(theirs)}"
    bad = [(a, b) for a, b in zip(mine, theirs) if a != b]
    return f"{len(bad)} of {len(mine)} rows differ, first {bad[0]}" if bad else ""


def main() -> None:
    from pyspark.sql import SparkSession

    from __spark_entry__ import oracle_sql, queries

    sf = f"/root/testdata/sf{sys.argv[1] if len(sys.argv) > 1 else '0.01'}"
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    for name in sys.argv[2:] or queries():
        start = time.time()
        try:
            result = compare(spark, sf, name)
        except Exception as error:  # report and go on with the next query
            result = f"{type(error).__name__}: {str(error)[:1500]}"
        kind = "exact" if name in oracle_sql() else "rows"
        print(f"{'ok  ' if not result else 'FAIL'} {kind:5} {time.time() - start:6.2f}s {name} {result}", flush=True)


if __name__ == "__main__":
    main()
