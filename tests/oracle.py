"""Run a query in Spark and its SQL in DuckDB and compare the rows as the driver does."""

from __future__ import annotations

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def norm(v):
    if v is None:
        return "∅"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return "nan" if v != v else repr(v + 0.0)
    return str(v)


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(norm(r[i]) for i in order) for r in rows)


def compare(spark, con, sf_dir, fn, sql):
    df = fn(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    cur = con.execute(sql)
    want_cols = [d[0] for d in cur.description]
    want = cur.fetchall()
    problems = []
    if sorted(df.columns) != sorted(want_cols):
        problems.append(f"columns {sorted(df.columns)} != {sorted(want_cols)}")
    else:
        a, b = rows_of(df.columns, got), rows_of(want_cols, want)
        if len(a) != len(b):
            problems.append(f"rows {len(a)} != {len(b)}")
        if a != b:
            sa, sb = set(a), set(b)
            problems.append(f"only spark {len(sa - sb)}: {sorted(sa - sb)[:3]}")
            problems.append(f"only sql {len(sb - sa)}: {sorted(sb - sa)[:3]}")
    return len(got), problems
