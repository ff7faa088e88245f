"""Holds a Spark result against DuckDB's, as sets of rows with columns by name."""

import duckdb
import numpy as np

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def _sorted(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype.kind == "f":
            df[c] = df[c].round(6) + 0.0
        elif df[c].dtype.kind not in "iub":
            df[c] = df[c].map(lambda v: None if v is None or v != v else str(v))
    return df.sort_values(list(df.columns), na_position="first").reset_index(drop=True)


def same(spark_df, con, sql):
    a, b = spark_df.toPandas(), con.sql(sql).df()
    assert sorted(a.columns) == sorted(b.columns)
    assert len(a) == len(b)
    a, b = _sorted(a), _sorted(b)
    for c in a.columns:
        x, y = a[c], b[c]
        if x.dtype.kind in "iufb" and y.dtype.kind in "iufb":
            assert np.allclose(x.astype(float), y.astype(float), rtol=1e-6, atol=1e-6, equal_nan=True), c
        else:
            empty = x.isna() & y.isna()
            assert (empty | (x.astype(str) == y.astype(str))).all(), c
