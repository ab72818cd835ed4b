"""Compare registered queries with their SQL in DuckDB: names, row count and values."""

import math
import sys
import time
import traceback

import duckdb

sys.path.insert(0, str(__import__("pathlib").Path(__file__).resolve().parents[1]))

from faultline.plans import catalog  # noqa: E402
from faultline.session import build_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def norm(v):
    if v is None:
        return "~"
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v + 0.0
    return v


def compare(spark_df, con, sql):
    cols = sorted(spark_df.columns)
    left = [tuple(norm(x) for x in r) for r in spark_df.select(*cols).collect()]
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    if sorted(names) != cols:
        return f"columns differ: spark {cols} sql {sorted(names)}", len(left)
    types = dict(zip(names, [str(d[1]) for d in rel.description]))
    order = [names.index(c) for c in cols]
    right = [tuple(norm(r[i]) for i in order) for r in rel.fetchall()]
    st = dict(spark_df.dtypes)
    bad_types = [
        (c, st[c], types[c])
        for c in cols
        if {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
        .get(st[c], st[c]).upper() != types[c].upper()
    ]
    key = lambda r: tuple((str(type(x).__name__ not in ("int", "float")), x if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)) if not isinstance(x, str) else ("T", x) for x in r)
    try:
        left.sort(key=key), right.sort(key=key)
    except TypeError:
        left.sort(key=str), right.sort(key=str)
    if len(left) != len(right):
        extra = [r for r in left if r not in set(right)][:2] if len(left) < 50000 else []
        missing = [r for r in right if r not in set(left)][:2] if len(left) < 50000 else []
        return f"rows differ: spark {len(left)} sql {len(right)}\n   only spark {extra}\n   only sql {missing}", len(left)
    diffs = [(a, b) for a, b in zip(left, right) if a != b]
    if diffs:
        return f"{len(diffs)} of {len(left)} rows differ, first:\n   {cols}\n   {diffs[0][0]}\n   {diffs[0][1]}", len(left)
    if bad_types:
        return f"types differ: {bad_types}", len(left)
    return None, len(left)


def main():
    sf = "/root/testdata/sf0.01"
    args = sys.argv[1:]
    if args and args[0].startswith("sf"):
        sf = f"/root/testdata/{args.pop(0)}"
    spark = build_session("check", "local[8]", **{"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    queries, sql = catalog.queries(), catalog.oracle_sql()
    names = [n for n in queries if not args or any(a in n for a in args)]
    failed = 0
    for n in names:
        t0 = time.time()
        try:
            df = queries[n](spark, sf)
            if n in sql:
                err, rows = compare(df, con, sql[n])
            else:
                err, rows = None, len(df.collect())
        except Exception as e:
            err, rows = "".join(traceback.format_exception_only(e))[:900] + traceback.format_exc()[-600:], -1
        spark.catalog.clearCache()
        flag = "ok  " if not err else "FAIL"
        failed += bool(err)
        print(f"{flag} {n} rows={rows} {'' if n in sql else '(rows only) '}{time.time() - t0:.1f}s {err or ''}", flush=True)
    print(f"{len(names) - failed} of {len(names)} good")


if __name__ == "__main__":
    main()
