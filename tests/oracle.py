"""A query's rows and its SQL's rows, in a form that can be compared."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SMALL = "/root/testdata/sf0.001"


def plain(x):
    if hasattr(x, "tolist"):
        x = x.tolist()
    if x is None or isinstance(x, float) and x != x:
        return None
    if isinstance(x, float):
        return str(int(x)) if x.is_integer() else repr(round(x, 9))  # pandas turns whole numbers with nulls among them into floats
    if isinstance(x, (list, tuple)):
        return [plain(y) for y in x]
    return str(x)


def rows(frame) -> list[str]:
    columns = sorted(frame.columns)
    return sorted(str([plain(v) for v in r]) for r in frame[columns].astype(object).where(frame[columns].notna(), None).values.tolist())


def expected(sql: str, path: str = SMALL):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"create view {t} as select * from '{path}/{t}.parquet'")
    return db.execute(sql).fetchdf()
