"""Ties of history that a query and its oracle must settle alike."""

from datetime import datetime

import duckdb

from assay.plans.catalog import ORACLES, QUERIES
from tests.oracle import compare, connect

GIVEN = "/root/testdata/sf0.001"


def test_errors_at_one_time_are_told_by_their_run(spark, tmp_path):
    """Two runs start at once, and a check errs in both: the later place is that of the larger id."""
    con = connect(GIVEN)
    day = datetime(1995, 5, 1)
    # Runs 24 and 48 have the same hour. 19 or 20 bought of supplier 1: an error, or another outcome.
    lines = []
    for supplier in range(1, 9):
        for order in (24, 48):
            quantity = next(q for q in range(1, 40) if (q * 7 + supplier + order) % 13 == 0)
            lines.append((order, supplier, 1, quantity))
    # The larger id comes first and last, so that no order of rows hides the tie.
    lines = sorted(lines, key=lambda x: (x[1] % 2 == 0) != (x[0] == 48))
    con.sql(f"copy (select * replace (o_orderkey * 24 as o_orderkey, timestamp '{day}' as o_orderdate) from orders "
            f"where o_orderkey in (select distinct o_orderkey from orders order by 1 limit 2)) to '{tmp_path}/orders.parquet'")
    keys = con.sql(f"select o_orderkey from '{tmp_path}/orders.parquet' order by 1").fetchall()
    renamed = dict(zip((24, 48), (k for (k,) in keys), strict=True))
    con.sql(f"copy (select * replace (case o_orderkey when {renamed[24]} then 24 else 48 end::bigint as o_orderkey) "
            f"from '{tmp_path}/orders.parquet') to '{tmp_path}/two.parquet'")
    values = ", ".join(map(str, lines))
    con.sql(f"copy (select l.* replace (o::bigint as l_orderkey, s::bigint as l_suppkey, n::bigint as l_linenumber, q::double as l_quantity) "
            f"from (select * from lineitem limit 1) l, (values {values}) v(o, s, n, q)) to '{tmp_path}/lineitem.parquet'")
    con.sql(f"copy (select * from '{tmp_path}/two.parquet') to '{tmp_path}/orders.parquet'")
    for name in ("supplier", "nation"):
        con.sql(f"copy (select * from {name}) to '{tmp_path}/{name}.parquet'")
    own = duckdb.connect()
    for name in ("supplier", "nation", "orders", "lineitem"):
        own.sql(f"create view {name} as select * from '{tmp_path}/{name}.parquet'")
    assert compare(spark, own, "join_recorded_after", QUERIES, ORACLES, str(tmp_path)) is None
