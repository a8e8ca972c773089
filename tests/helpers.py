from __future__ import annotations

import os

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str = SF):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{os.path.join(sf_dir, t)}.parquet'")
    return con


def rows_of(df) -> list[tuple]:
    """Rows with columns in order of name, sorted; numbers as Python's own."""
    plain = lambda v: None if v is None or v != v else v.item() if hasattr(v, "item") else v.to_pydatetime() if hasattr(v, "to_pydatetime") else v
    df = df[sorted(df.columns)]
    return sorted((tuple(map(plain, r)) for r in df.astype(object).itertuples(index=False, name=None)), key=repr)
