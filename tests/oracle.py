"""Running a query and its SQL side by side on the same Parquet files."""

import datetime
import math
import os

import duckdb


def tables(sf_dir):
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        path = os.path.join(sf_dir, name)
        files = f"{path}/*.parquet" if os.path.isdir(path) else path
        con.execute(f"create view {name.split('.')[0]} as select * from read_parquet('{files}')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def same(spark, con, sf_dir, query, sql):
    df = query(spark, sf_dir)
    names = sorted(df.columns)
    ours = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)
    found = con.sql(sql)
    places = [found.columns.index(c) for c in names]
    assert sorted(found.columns) == names
    theirs = sorted((tuple(plain(r[p]) for p in places) for r in found.fetchall()), key=repr)
    assert ours == theirs
