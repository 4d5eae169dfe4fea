"""Runs a query and its SQL on the same tables and compares their rows."""

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(frame):
    frame = frame[sorted(frame.columns)]
    out = []
    for row in frame.itertuples(index=False):
        cells = []
        for v in row:
            if pd.isna(v) if pd.api.types.is_scalar(v) else False:
                cells.append(None)
            elif isinstance(v, (int, float)) and not isinstance(v, bool):
                cells.append(round(float(v), 8))
            else:
                cells.append(str(v))
        out.append(tuple(cells))
    return sorted(out, key=repr)


def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def agree(spark, con, sf_dir, query, sql):
    got, want = query(spark, sf_dir).toPandas(), con.execute(sql).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.astype(object)) == rows(want.astype(object))
