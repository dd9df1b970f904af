"""Lines through tooth peaks where a residual's last digit hangs on the order of the sums."""

from __future__ import annotations

import duckdb
import pytest

from inspectra.plans import registry
from tests.conftest import plain

#: Where the SQL leaves an order open: the first of equal rows, and sums by tooth or row.
PINS = {
    "arg_max(y, x)": "first(y ORDER BY x DESC, y)", "regr_slope(peak, y)": "regr_slope(peak, y ORDER BY tooth)", "regr_intercept(peak, y)": "regr_intercept(peak, y ORDER BY tooth)",
    "arg_max(y, v)": "first(y ORDER BY v DESC, y)", "arg_max(y, area)": "first(y ORDER BY area DESC, run)", "sum(v - 15)": "sum(v - 15 ORDER BY y)",
}


@pytest.mark.parametrize("name", ["w11_tooth_peaks", "w11_peak_maxima", "w12_excursion_from_peaks"])
def test_as_sql_in_order_of_teeth(name, spark, tmp_path):
    c = duckdb.connect()
    c.execute("COPY (SELECT * FROM '/root/testdata/sf0.1/events.parquet' WHERE user_id IN (23, 77, 110, 547, 642, 1091, 1157)) TO '" + f"{tmp_path}/events.parquet'")
    c.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    sql = registry.oracle_sql()[name]
    for open_, pinned in PINS.items():
        sql = sql.replace(open_, pinned)
    result = c.execute(sql)
    columns = [d[0] for d in result.description]
    ours = registry.queries()[name](spark, str(tmp_path)).select(*columns).collect()
    assert sorted(repr(plain(tuple(r))) for r in ours) == sorted(repr(plain(r)) for r in result.fetchall())
