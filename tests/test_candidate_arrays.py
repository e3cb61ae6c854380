"""The matrix over all features is computed from arrays: the cells of the plans, wherever a batch ends."""

from __future__ import annotations

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import DATA
from tests.test_client_parts import COLUMNS, _rows
from tidemark import catalogue
from tidemark.operators import candidate_arrays, kernel
from tidemark.sources import adapters


def _odd():
    """Rows of odd values: none of a client, day, code, name and currency, equal days, one amount for all."""
    out = [(2000 + i, "equal", -5.0, 10.0, "chf", "card_payment", "7997", "gym") for i in range(4)] + [(3000, None, -9.0, 12.0, None, "card_payment", None, "cloud"), (3001, None, -4.0, 12.0, "chf", "card_payment", "5732", None)]
    return out + [(4000 + i, "no day", None if i % 3 == 0 else -30.0 * i, 20.0 + i / 8, "eur", "refund" if i == 5 else "card_payment", "7997", "gym") for i in range(1, 9)] + [(4100, "never", None, 7.0, "eur", "card_payment", "7997", "gym")]


def _matrix(df, names):
    rows = {(r["client_id"], r["candidate"]): r["features"] for r in df.collect()}
    assert len(rows) % 8 == 0 and {len(v) for v in rows.values()} == {7 * names + 10 + 4 * 13 + 8}
    return list(rows), np.array(list(rows.values()))


@pytest.mark.parametrize("source", ("rows", "table"))
def test_arrays_have_the_cells_of_the_plans(spark, source):
    df = spark.createDataFrame(_rows() + _odd(), COLUMNS).repartition(3, "client_id") if source == "rows" else adapters.long_transactions(spark, f"{DATA}/sf0.001", by_client=True)
    assigned = kernel.assign_families(df)
    profile = kernel.family_profile(assigned, context=True)
    names = len(profile.columns) - 3
    keys, wanted = _matrix(kernel.candidate_matrix(profile), names)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        found_keys, found = _matrix(candidate_arrays.matrix(assigned), names)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    found = found[[found_keys.index(k) for k in keys]]
    columns = sorted(c for c in profile.columns if c not in ("client_id", "family", "context"))
    phases = [names + i for i, c in enumerate(columns) if re.search(r"phase_due", c)]  # the last digit of an angle decides which of equal phases is greater
    rest = np.setdiff1d(np.arange(found.shape[1]), phases)
    off = np.abs(found - wanted) > 1e-9 * np.maximum(1, np.abs(wanted))
    assert not off[:, rest].any(), [(keys[i], columns[j % names], j, wanted[i, j], found[i, j]) for i, j in np.argwhere(off)[:9]]
    assert off[:, phases].mean() < 0.01


def test_candidate_matrix_whole_aggregates_no_row_for_each_stream(spark):
    df = catalogue.queries()["candidate_matrix_whole"](spark, f"{DATA}/sf0.001")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Aggregate" not in plan
    assert plan.count("Exchange hashpartitioning(client_id") == 1 and plan.count("Join ") == 1
    assert df.select(F.size("features")).distinct().collect() == [(2093,)]
