"""Runs registered queries beside their SQL: python tests/compare.py SF_DIR [NAME...]"""

from __future__ import annotations

import datetime
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def views(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in sorted(os.listdir(sf_dir)):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM read_parquet('{sf_dir}/{name}')")
    return con


def canonical(rows, columns) -> list:
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def plain(x):
        if isinstance(x, float):
            return "nan" if math.isnan(x) else round(x, 9)
        if isinstance(x, datetime.datetime):
            return x.replace(tzinfo=None).isoformat()
        if isinstance(x, datetime.date):
            return x.isoformat()
        return x

    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def differences(df, con, sql: str) -> str:
    """Empty if the query and its SQL agree on names, rows and values."""
    got = canonical(df.collect(), df.columns)
    cur = con.execute(sql)
    names = [x[0] for x in cur.description]
    want = canonical(cur.fetchall(), names)
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    if got != want:
        extra, missing = [x for x in got if x not in set(want)], [x for x in want if x not in set(got)]
        return f"{len(got)} rows against {len(want)}; only here {extra[:2]}, only in SQL {missing[:2]}"
    return ""


def main() -> int:
    import __spark_entry__ as entry
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.master("local[8]").config(map={"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g", "spark.sql.session.timeZone": "UTC", "spark.ui.showConsoleProgress": "false"}).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    con, bad, sqls = views(sys.argv[1]), 0, entry.oracle_sql()
    for name, query in entry.queries().items():
        if sys.argv[2:] and name not in sys.argv[2:]:
            continue
        began = time.time()
        try:
            if name in sqls:
                df = query(spark, sys.argv[1])
                said = differences(df, con, sqls[name]) or f"same, {df.count()} rows"
            else:
                said = f"no SQL, {query(spark, sys.argv[1]).count()} rows"
        except Exception as error:  # noqa: BLE001 - the report goes on with the next query
            said = f"FAILED {type(error).__name__}: {str(error)[:1500]}"
        bad += not said.startswith(("same", "no SQL"))
        print(f"{name}: {said} ({time.time() - began:.1f} s)", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main())
