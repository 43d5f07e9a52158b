"""Compares registered queries with their SQL on a folder of tables."""

import glob
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if glob.glob(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(v[i] for i in order) for v in values), key=repr)


def compare(spark, con, run, sql, sf_dir):
    """(Spark's rows, the SQL's rows), with columns by name."""
    frame = run(spark, sf_dir)
    got = rows(frame.columns, [tuple(r) for r in frame.collect()])
    result = con.execute(sql)
    return got, rows([d[0] for d in result.description], result.fetchall())
