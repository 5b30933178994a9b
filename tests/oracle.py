"""A query's rows against its oracle's, as the driver compares them: columns by name, rows in any order."""

from decimal import Decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if hasattr(v, "asDict"):
        v = v.asDict()
    if isinstance(v, dict):
        return {k: plain(x) for k, x in v.items()}
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return float(v) if isinstance(v, Decimal) else v


def rows_of(df):
    columns = sorted(df.columns)
    return columns, sorted(str([plain(r[c]) for c in columns]) for r in df.collect())


def oracle_rows(sql, d):
    con = duckdb.connect()
    for n in TABLES:
        con.execute(f"CREATE VIEW {n} AS SELECT * FROM '{d}/{n}.parquet'")
    result = con.execute(sql)
    names = [x[0] for x in result.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(names), sorted(str([plain(r[i]) for i in order]) for r in result.fetchall())
