"""Compare query results with their SQL twins as bags of rows."""

import math
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf_dir}/{table}.parquet')")
    return con


def _value(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value
    if isinstance(value, (list, tuple)):
        return tuple(_value(item) for item in value)
    if isinstance(value, dict):
        return tuple((key, _value(item)) for key, item in value.items())
    return value


def bag(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(_value(row[i]) for i in order) for row in rows)


def spark_bag(df):
    return sorted(df.columns), bag(df.columns, df.collect())


def sql_bag(con, sql):
    result = con.execute(sql)
    names = [column[0] for column in result.description]
    return sorted(names), bag(names, result.fetchall())
