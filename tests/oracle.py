"""Compare a Spark result with a SQL result from DuckDB on the same tables."""

import os

import duckdb


def tables(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in sorted(os.listdir(sf_dir)):
        if name.endswith(".parquet"):
            con.execute(f"CREATE VIEW {name[:-8]} AS SELECT * FROM '{sf_dir}/{name}'")
    return con


def sql_rows(con, text):
    cur = con.execute(text)
    names = [d[0] for d in cur.description]
    return names, cur.fetchall()


def canonical(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(row[i] for i in order) for row in rows), key=repr)


def compare(df, con, text):
    """None when equal, else a short account of the difference."""
    names, expected = sql_rows(con, text)
    got_names = df.columns
    if sorted(names) != sorted(got_names):
        return f"columns {sorted(got_names)} against {sorted(names)}"
    got = canonical(got_names, [tuple(r) for r in df.collect()])
    want = canonical(names, expected)
    if got == want:
        return None
    missing = sorted(set(want) - set(got), key=repr)[:3]
    extra = sorted(set(got) - set(want), key=repr)[:3]
    return f"{len(got)} rows against {len(want)}; missing {missing}; extra {extra}"
