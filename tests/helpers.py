import os

import duckdb

DATA = "/root/testdata"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
)


def duck(sf: str, sql: str) -> list[tuple]:
    c = duckdb.connect()
    for t in TABLES.split():
        path = f"{DATA}/{sf}/{t}.parquet"
        c.sql(f"create view {t} as from '{path + ('/*.parquet' if os.path.isdir(path) else '')}'")
    frame = c.sql(sql)
    names = sorted(frame.columns)
    return names, sorted(map(repr, c.sql(f"select {', '.join(names)} from ({sql})").fetchall()))


def rows(df) -> list[tuple]:
    names = sorted(df.columns)
    return names, sorted(repr(tuple(r)) for r in df.select(*names).collect())
