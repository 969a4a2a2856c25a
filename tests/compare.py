"""Compares a query's rows with those of its SQL in DuckDB."""

import os

import duckdb

from .conftest import TABLES


def same_rows(spark, query, sql, tables=TABLES):
    with duckdb.connect() as db:
        for file in os.listdir(tables):
            db.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{tables}/{file}'")
        expected = db.sql(sql).df()
    got = query(spark, tables).toPandas()
    assert sorted(got.columns) == sorted(expected.columns)
    columns = sorted(got.columns)

    def rows(df):
        plain = df[columns].astype(object).where(df[columns].notna(), None)
        return sorted((tuple(_value(v) for v in row) for row in plain.itertuples(index=False)), key=str)

    assert rows(got) == rows(expected)


def _value(v):
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, float):
        return int(v) if v == int(v) else round(v, 9)
    return str(v) if hasattr(v, "isoformat") else v
