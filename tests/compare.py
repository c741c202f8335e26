"""Query results against their SQL in DuckDB."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(frame, columns):
    return sorted(tuple(repr(r[c]) for c in columns) for r in frame.collect())


def oracle(sql, sf_dir, columns):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    result = con.execute(sql)
    names = [x[0] for x in result.description]
    assert sorted(names) == sorted(columns)
    return sorted(tuple(repr(r[names.index(c)]) for c in columns) for r in result.fetchall())
