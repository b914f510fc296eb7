import glob
import os

import duckdb


def oracle(sql, folder):
    c = duckdb.connect()
    for p in glob.glob(f"{folder}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    r = c.execute(sql)
    names = [d[0] for d in r.description]
    return [dict(zip(names, row, strict=True)) for row in r.fetchall()]


def same(df, sql, folder):
    mine = [r.asDict() for r in df.collect()]
    theirs = oracle(sql, folder)
    key = lambda r: repr([(k, float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v) for k, v in sorted(r.items())])
    assert sorted(map(key, mine)) == sorted(map(key, theirs))
    return mine


#: Nulls, empty and blank texts, ties, repeats, a long text.
ODD = [(None, "one two three four five six seven"), (7, None), (8, ""), (9, " \n\t "), (10, "word"), (11, "word"), (11, "word"), (12, "x " * 30_000), (13, "é日本 \x85 ok"), (14, "a" * 40_000)]
