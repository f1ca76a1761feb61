"""Hold every query against its SQL in DuckDB: ``python tests/compare.py [sf_dir] [query ...]``."""

from __future__ import annotations

import math
import os
import sys
import time

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
)


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect(config={"memory_limit": "6GB"})
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def rows_of(names: list[str], rows: list) -> list[tuple]:
    """Rows as sorted tuples of text, columns by name; doubles to nine significant digits."""

    def text(v) -> str:
        if isinstance(v, float):
            return "nan" if math.isnan(v) else f"{v + 0.0:.9g}"
        return str(v)

    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(text(r[i]) for i in order) for r in rows)


def difference(spark, con, query, sql: str, sf_dir: str) -> str | None:
    """What differs first between the query's rows and the SQL's; None if nothing does."""
    df = query(spark, sf_dir)
    mine = rows_of(df.columns, [tuple(r) for r in df.collect()])
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    theirs = rows_of(names, result.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    if len(mine) != len(theirs):
        return f"{len(mine)} and {len(theirs)} rows"
    apart = [(a, b) for a, b in zip(mine, theirs, strict=True) if a != b]
    return f"{len(apart)} of {len(mine)} rows, first {apart[0][0]} and {apart[0][1]}" if apart else None


def main() -> None:
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    sys.path.insert(0, root)
    os.environ["PYTHONPATH"] = root
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "8g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, queries, sql = duck(sf_dir), entry.queries(), entry.oracle_sql()
    for name in sys.argv[2:] or sql:
        began = time.time()
        try:
            said = difference(spark, con, queries[name], sql[name], sf_dir)
        except Exception as e:  # the report goes on with the next query
            said = f"{type(e).__name__}: {str(e)[:300]}"
        print(f"{'DIFFERS' if said else 'same'} {name} {time.time() - began:.1f} s {said or ''}", flush=True)
        spark.catalog.clearCache()


if __name__ == "__main__":
    main()
