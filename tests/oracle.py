"""Rows of a query and of its SQL, for comparison."""

from collections import Counter

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    return round(v, 9) if isinstance(v, float) else tuple(v) if isinstance(v, list) else v


def both(spark, folder, function, sql):
    import duckdb

    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"create view {t} as select * from '{folder}/{t}.parquet'")
    df = function(spark, folder)
    names = sorted(df.columns)
    found = db.sql(sql)
    assert sorted(found.columns) == names
    at = [found.columns.index(n) for n in names]
    return Counter(tuple(plain(r[n]) for n in names) for r in df.collect()), Counter(tuple(plain(r[k]) for k in at) for r in found.fetchall())
