"""Runs SQL in DuckDB over the tables of a folder."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of(sql, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(names), sorted((tuple(r[i] for i in order) for r in cur.fetchall()), key=str)


def same_rows(df, sql, sf_dir):
    names, want = rows_of(sql, sf_dir)
    assert sorted(df.columns) == names
    got = sorted((tuple(r) for r in df.select(*names).collect()), key=str)
    assert got == want
    assert got
