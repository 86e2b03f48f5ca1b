"""Order-insensitive comparison of a Spark result with a DuckDB result."""

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float) and math.isnan(value):
        return "nan"
    return value


def rows_of(frame, columns):
    return sorted((tuple(_plain(v) for v in row) for row in frame), key=repr)


def differences(spark_df, con, sql):
    relation = con.sql(sql)
    expected_columns = sorted(relation.columns)
    if sorted(spark_df.columns) != expected_columns:
        return f"columns {sorted(spark_df.columns)} != {expected_columns}"
    got = rows_of((tuple(r[c] for c in expected_columns) for r in spark_df.collect()), expected_columns)
    index = [relation.columns.index(c) for c in expected_columns]
    expected = rows_of((tuple(r[i] for i in index) for r in relation.fetchall()), expected_columns)
    if len(got) != len(expected):
        return f"{len(got)} rows != {len(expected)}"
    for g, e in zip(got, expected):
        if g != e:
            return f"{expected_columns}: {str(g)[:400]} != {str(e)[:400]}"
    types = {c: t for c, t in spark_df.dtypes}
    sql_types = {c: str(t) for c, t in zip(relation.columns, relation.types)}
    names = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    wrong = {c: (t, sql_types[c]) for c, t in types.items() if names.get(t, t) != sql_types[c]}
    return f"types {wrong}" if wrong else None
