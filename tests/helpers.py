"""What tests share: the smallest tables, DuckDB on them, and a comparison of rows."""

SF = "/root/testdata/sf0.001"


def duck(sql: str, sf: str = SF):
    """Rows of a DuckDB query on the driver's tables, as dicts."""
    import duckdb

    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con.execute(sql).df()


def same(a, b) -> bool:
    """Equal rows whatever their order, floats to six places."""
    import pandas as pd

    def plain(v):
        if hasattr(v, "tolist"):
            v = v.tolist()
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
            return "NULL"
        return f"{v:.6f}" if isinstance(v, float) else str(v)

    rows = lambda df: sorted(map(tuple, df[sorted(df.columns)].map(plain).values.tolist()))
    return sorted(a.columns) == sorted(b.columns) and rows(a) == rows(b)
