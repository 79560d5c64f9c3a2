"""A query's SQL twin over rows made for a test."""

import compare
import duckdb
import pyarrow as pa


def sql_rows(sql, table, rows, schema):
    """The twin's rows when ``table`` holds these rows."""
    con = duckdb.connect()
    columns = {name: pa.array([row[i] for row in rows], kind) for i, (name, kind) in enumerate(schema.items())}
    con.register(table, pa.table(columns))
    return compare.sql_bag(con, sql)
