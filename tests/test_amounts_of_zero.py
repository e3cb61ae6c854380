"""Rows without a positive amount have no family, hence no name and no code of one."""

from __future__ import annotations

import duckdb

from tests.conftest import DATA
from tidemark import catalogue


def test_scan_counts_rows_of_amount_0_as_the_sql_does(spark, tmp_path):
    con = duckdb.connect()
    changed = "SELECT * REPLACE (CASE WHEN event_id % 7 = 0 THEN 0.0 WHEN event_id % 11 = 0 THEN -1.5 ELSE value END AS value)"
    con.execute(f"COPY ({changed} FROM '{DATA}/sf0.001/events.parquet') TO '{tmp_path}/events.parquet'")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    want = con.execute(catalogue.oracle_sql()["scan_validate"]).df().iloc[0].to_dict()
    found = catalogue.queries()["scan_validate"](spark, str(tmp_path)).first().asDict()
    assert found == want and found["n_null"] > 100
