"""Compares a query with its SQL, as sorted rows with sorted columns."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir, views=None):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def rows(table):
    names = sorted(table.column_names)
    clean = lambda v: round(v, 9) if isinstance(v, float) else v
    return names, sorted(repr([clean(r[n]) for n in names]) for r in table.to_pylist())


def same(df, sql, sf_dir):
    got, want = rows(df.toArrow()), rows(connect(sf_dir).execute(sql).to_arrow_table())
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    assert got[1] == want[1]
