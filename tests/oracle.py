"""Compare a query with its SQL twin: names, row count and order-insensitive values."""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb
import pandas as pd

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _cell(v):
    if v is None or v is pd.NaT or (isinstance(v, float) and v != v):
        return "<null>"
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float):
        return repr(v + 0.0)
    return repr(v)


def _rows(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(name, df, con, sql):
    rel = con.execute(sql)
    want_names = [d[0] for d in rel.description]
    want_types = [str(d[1]) for d in rel.description]
    want = rel.fetchall()
    got = [tuple(r) for r in df.collect()]
    assert sorted(df.columns) == sorted(want_names), f"{name}: {sorted(df.columns)} vs {sorted(want_names)}"
    spark_types = dict(df.dtypes)
    alias = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean"}
    odd = {n: (spark_types[n], t) for n, t in zip(want_names, want_types) if alias.get(t) != spark_types[n]}
    a, b = _rows(got, df.columns), _rows(want, want_names)
    assert len(a) == len(b), f"{name}: {len(a)} rows vs {len(b)}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    assert not bad, f"{name}: {len(bad)} rows differ, first {sorted(df.columns)} {bad[0]}"
    assert not odd, f"{name}: types {odd}"
    return len(a)


if __name__ == "__main__":
    import __spark_entry__ as e
    from panelspark.runtime import local_session

    sf_dir = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
    spark = local_session("8", shuffle_partitions=8)
    con = duck(sf_dir)
    prefixes = sys.argv[1:]
    failed = []
    for n, fn in e.queries().items():
        if prefixes and not any(n.startswith(p) for p in prefixes):
            continue
        t = time.time()
        try:
            sql = e.oracle_sql().get(n)
            if sql:
                rows = compare(n, fn(spark, sf_dir), con, sql)
                kind = "match"
            else:
                rows = len(fn(spark, sf_dir).collect())
                kind = "rows"
            print(f"{kind:6s} {n:40s} {rows:8d} rows {time.time() - t:7.2f}s", flush=True)
        except Exception as ex:  # noqa: BLE001
            failed.append(n)
            print(f"FAIL   {n}: {str(ex)[:1500]}", flush=True)
    print("failed:", failed)
