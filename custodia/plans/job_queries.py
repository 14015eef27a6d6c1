"""The sample jobs end to end."""

from __future__ import annotations

from pyspark.sql import DataFrame

from custodia.plans import jobs
from custodia.plans.registry import query
from custodia.sources.tables import Dataset

NET = "CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))"


@query(
    f"""
SELECT c_custkey AS customer_id, c_mktsegment || ' ' || c_name AS customer_name,
  CAST(sum({NET}) AS DECIMAL(38,4)) AS lifetime_value, count(*) AS order_count
FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN customer ON o_custkey = c_custkey
WHERE o_orderstatus = 'O' GROUP BY ALL
"""
)
def customer_ltv(ds: Dataset) -> DataFrame:
    return jobs.customer_ltv(ds.table("orders"), ds.table("lineitem"), ds.table("customer"))


@query(
    """
SELECT r_name AS region, CAST(sum(CAST(o_totalprice AS DECIMAL(14,2))) AS DECIMAL(38,2)) AS total_revenue,
  CAST(sum(CAST(o_totalprice AS DECIMAL(14,2))) AS DOUBLE) / count(*) AS avg_revenue
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
JOIN region ON n_regionkey = r_regionkey WHERE o_orderstatus = 'O' GROUP BY r_name
"""
)
def region_revenue(ds: Dataset) -> DataFrame:
    return jobs.region_revenue(*[ds.table(t) for t in ("orders", "customer", "nation", "region")])


@query(
    f"""
SELECT cr.r_name AS customer_region, sr.r_name AS supplier_region, count(*) AS n_lines,
  CAST(sum({NET}) AS DECIMAL(38,4)) AS value
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
JOIN supplier ON l_suppkey = s_suppkey
JOIN nation cn ON c_nationkey = cn.n_nationkey JOIN region cr ON cn.n_regionkey = cr.r_regionkey
JOIN nation sn ON s_nationkey = sn.n_nationkey JOIN region sr ON sn.n_regionkey = sr.r_regionkey
WHERE cr.r_name <> sr.r_name GROUP BY ALL
"""
)
def cross_border_flows(ds: Dataset) -> DataFrame:
    return jobs.cross_border_flows(
        *[ds.table(t) for t in ("orders", "lineitem", "customer", "supplier", "nation", "region")]
    )
