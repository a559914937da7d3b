"""Hold a query's rows against SQL that another engine runs over the same tables."""

import glob
import os

import duckdb

DATA = "/root/testdata/sf0.001"


def connection():
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    return con


def rows(frame):
    columns = sorted(frame.columns)
    return columns, sorted(tuple("" if v is None or str(v) in ("nan", "<NA>", "NaT") else f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in frame[columns].itertuples(index=False))
