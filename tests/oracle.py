"""A query's rows and those of its DuckDB SQL, in comparable form."""

from __future__ import annotations

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SMALL = "/root/testdata/sf0.001"


def _rows(table) -> list[str]:
    return sorted(map(repr, table.select(sorted(table.schema.names)).to_pylist()))


def both(spark, query, sql: str, folder: str = SMALL) -> tuple[list[str], list[str]]:
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return _rows(query(spark, folder).toArrow()), _rows(con.sql(sql).to_arrow_table())
