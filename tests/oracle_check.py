"""Run registered queries and their SQL side by side and compare the rows.

    python tests/oracle_check.py [sf_dir] [name prefix ...]
"""

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf_dir):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    fixed = [tuple(None if r[i] is None else r[i] for i in order) for r in rows]
    return [columns[i] for i in order], sorted(fixed, key=repr)


def compare(spark, con, sf_dir, name, run, sql):
    started = time.time()
    df = run(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    spent = time.time() - started
    started = time.time()
    result = con.execute(sql)
    want = rows_of([d[0] for d in result.description], result.fetchall())
    sql_spent = time.time() - started
    types = {f.name: f.dataType.simpleString() for f in df.schema}
    kinds = {d[0]: str(d[1]) for d in result.description}
    return got, want, types, kinds, spent, sql_spent


def main():
    import __spark_entry__ as entry
    from pyspark.sql import SparkSession

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    prefixes = tuple(sys.argv[2:])
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = connect(sf_dir), []
    oracles = entry.oracle_sql()
    for name, run in entry.queries().items():
        if prefixes and not name.startswith(prefixes):
            continue
        try:
            if name not in oracles:
                print(f"{name}: rows {run(spark, sf_dir).count()} (no SQL)", flush=True)
                continue
            got, want, types, kinds, spent, sql_spent = compare(spark, con, sf_dir, name, run, oracles[name])
        except Exception as error:  # keep going, report at the end
            print(f"{name}: ERROR {str(error)[:600]}", flush=True)
            bad.append(name)
            continue
        same = got == want
        print(f"{name}: {'ok' if same else 'DIFFERS'} rows {len(got[1])}/{len(want[1])} {spent:.1f}s sql {sql_spent:.1f}s", flush=True)
        integer = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN", "string": "VARCHAR"}
        for column, kind in types.items():
            if integer.get(kind, kind) != kinds.get(column):
                print(f"   type of {column}: {kind} / {kinds.get(column)}", flush=True)
        if not same:
            bad.append(name)
            if got[0] != want[0]:
                print("   columns", got[0], want[0])
            left, right = set(map(repr, got[1])), set(map(repr, want[1]))
            print("   only spark", [x[:400] for x in sorted(left - right)[:3]])
            print("   only sql  ", [x[:400] for x in sorted(right - left)[:3]])
    print("bad:", bad)


if __name__ == "__main__":
    main()
