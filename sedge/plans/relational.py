"""Queries over the relational tables."""

from __future__ import annotations

from sedge.plans.sql import plan

PLANS = {}

PLANS["region_revenue"] = plan(
    "region nation customer orders lineitem",
    """SELECT r_name, count(*) AS n_items, CAST(round(sum(l_extendedprice * (1 - l_discount)), 2) AS DOUBLE) AS revenue
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
    JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name""",
)
