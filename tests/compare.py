"""Spark query against DuckDB SQL on the same tables, compared as sorted rows."""

from __future__ import annotations

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}"
    if isinstance(value, (list, tuple)):
        return str([_cell(v) for v in value])
    if isinstance(value, dict):
        return str({k: _cell(v) for k, v in sorted(value.items())})
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([tuple(_cell(row[i]) for i in order) for row in rows])


def spark_rows(df):
    return rows_of(df.columns, [tuple(r) for r in df.collect()])


def duck_rows(con, sql):
    cursor = con.execute(sql)
    columns = [d[0] for d in cursor.description]
    return columns, rows_of(columns, cursor.fetchall())


SPARK_KIND = {
    "tinyint": "int", "smallint": "int", "int": "int", "bigint": "bigint", "double": "double",
    "float": "float", "string": "string", "boolean": "boolean", "date": "date",
    "timestamp": "timestamp", "timestamp_ntz": "timestamp",
}
DUCK_KIND = {
    "INTEGER": "int", "BIGINT": "bigint", "DOUBLE": "double", "FLOAT": "float",
    "VARCHAR": "string", "BOOLEAN": "boolean", "DATE": "date", "TIMESTAMP": "timestamp",
    "TIMESTAMP WITH TIME ZONE": "timestamp",
}


def kinds(df, con, sql):
    """(spark, duckdb) type name by column, for plain types."""
    ours = {n: SPARK_KIND.get(t, t) for n, t in df.dtypes}
    cursor = con.execute(f"SELECT * FROM ({sql}) LIMIT 0")
    theirs = {d[0]: DUCK_KIND.get(str(d[1]), str(d[1])) for d in cursor.description}
    return ours, theirs
