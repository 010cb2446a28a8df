"""Compares a Spark query with its SQL on the same tables."""

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings jobs page_info sent_pages send_attempts link_graph eval_items containers".split()


def database(folder):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def rows(frame):
    def shown(x):
        if x is None or x is pd.NaT or x is pd.NA or isinstance(x, float) and x != x:
            return ""
        return str(int(x)) if isinstance(x, float) and x == int(x) else str(x)

    frame = frame[sorted(frame.columns)]
    return sorted("|".join(map(shown, r)) for r in frame.itertuples(index=False, name=None))


def spark_frame(df):
    return pd.DataFrame([r.asDict() for r in df.collect()], columns=df.columns).astype(object)
