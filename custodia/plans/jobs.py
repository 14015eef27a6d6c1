"""The sample jobs of the governed pipelines, over the order tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def net_price() -> Column:
    price = F.col("l_extendedprice").cast("decimal(12,2)")
    return price * (F.lit(1).cast("decimal(1,0)") - F.col("l_discount").cast("decimal(4,2)"))


def customer_ltv(
    orders: DataFrame, lineitem: DataFrame, customer: DataFrame, status: str = "O"
) -> DataFrame:
    """Lifetime value and order lines of every customer with orders in the given status.

    Lines are summed per order before they meet the orders, on the same key, so the
    join reads one row per order and needs no further shuffle of the lines.
    """
    per_order = (
        lineitem.select("l_orderkey", net_price().alias("total_value"))
        .groupBy("l_orderkey")
        .agg(F.sum("total_value").alias("value"), F.count(F.lit(1)).alias("lines"))
    )
    active = orders.where(F.col("o_orderstatus") == status).select("o_orderkey", "o_custkey")
    per_customer = (
        active.join(per_order, F.col("o_orderkey") == F.col("l_orderkey"))
        .groupBy("o_custkey")
        .agg(F.sum("value").cast("decimal(38,4)").alias("lifetime_value"), F.sum("lines").alias("order_count"))
    )
    names = customer.select("c_custkey", F.concat("c_mktsegment", F.lit(" "), "c_name").alias("customer_name"))
    return per_customer.join(names, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("c_custkey").alias("customer_id"), "customer_name", "lifetime_value", "order_count"
    )


def region_revenue(
    orders: DataFrame, customer: DataFrame, nation: DataFrame, region: DataFrame, status: str = "O"
) -> DataFrame:
    """Total and average revenue by region.

    Orders are summed per customer before they meet the customers, and per nation
    before they meet nations and regions, so those joins see a handful of rows.
    """
    per_customer = (
        orders.where(F.col("o_orderstatus") == status)
        .groupBy("o_custkey")
        .agg(
            F.sum(F.col("o_totalprice").cast("decimal(14,2)")).alias("revenue"),
            F.count(F.lit(1)).alias("n"),
        )
    )
    homes = customer.select("c_custkey", "c_nationkey")
    per_nation = (
        per_customer.join(homes, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy("c_nationkey")
        .agg(F.sum("revenue").alias("revenue"), F.sum("n").alias("n"))
    )
    return (
        per_nation.join(_regions(nation, region), F.col("c_nationkey") == F.col("nationkey"))
        .groupBy("region")
        .agg(F.sum("revenue").cast("decimal(38,2)").alias("total_revenue"), F.sum("n").alias("_n"))
        .select(
            "region",
            "total_revenue",
            (F.col("total_revenue").cast("double") / F.col("_n")).alias("avg_revenue"),
        )
    )


def _regions(nation: DataFrame, region: DataFrame) -> DataFrame:
    return nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_nationkey").alias("nationkey"), F.col("r_name").alias("region")
    )


def cross_border_flows(
    orders: DataFrame,
    lineitem: DataFrame,
    customer: DataFrame,
    supplier: DataFrame,
    nation: DataFrame,
    region: DataFrame,
) -> DataFrame:
    """Order lines whose buyer and supplier sit in different regions, by pair of regions.

    Lines meet the orders in one shuffle and are summed per pair of nations right there,
    on the map side; regions only see those sums. An order or a supplier that holds most
    lines is split by the skew join, whose output nothing needs partitioned. No join is
    hinted: customers and suppliers are broadcast only as long as Spark measures them to
    be small.
    """
    sold = lineitem.select("l_orderkey", "l_suppkey", net_price().alias("value")).join(
        supplier.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey")
    )
    bought = orders.select("o_orderkey", "o_custkey").join(
        customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")
    )
    nations = (
        sold.join(bought, F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy("c_nationkey", "s_nationkey")
        .agg(F.count(F.lit(1)).alias("lines"), F.sum("value").alias("value"))
    )
    buyers = _regions(nation, region).toDF("buyer_nation", "customer_region")
    sellers = _regions(nation, region).toDF("seller_nation", "supplier_region")
    return (
        nations.join(buyers, F.col("c_nationkey") == F.col("buyer_nation"))
        .join(sellers, F.col("s_nationkey") == F.col("seller_nation"))
        .where(F.col("customer_region") != F.col("supplier_region"))
        .groupBy("customer_region", "supplier_region")
        .agg(F.sum("lines").alias("n_lines"), F.sum("value").cast("decimal(38,4)").alias("value"))
    )
