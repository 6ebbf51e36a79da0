"""The driver's star schema projected onto the graph model, so that every operator runs on its tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.sources.tables import table


def nodes(spark: SparkSession, d: str) -> DataFrame:
    """(node_key, name, path, kind, description): customers, suppliers and parts are files, orders are symbols."""
    c, s, p, o = (table(spark, d, t) for t in ("customer", "supplier", "part", "orders"))
    key = lambda kind, c: F.concat(F.lit(f"{kind}/"), F.col(c))
    cols = ["node_key", "name", "path", "kind", "description"]
    parts = [
        c.select(key("customer", "c_custkey"), "c_name", key("customer", "c_custkey"), F.lit("file"), "c_mktsegment"),
        s.select(key("supplier", "s_suppkey"), "s_name", key("supplier", "s_suppkey"), F.lit("file"), F.lit("")),
        p.select(key("part", "p_partkey"), "p_name", key("part", "p_partkey"), F.lit("file"), "p_type"),
        o.select(
            F.concat(F.lit("customer/"), "o_custkey", F.lit("#order"), "o_orderkey"), F.concat(F.lit("order"), "o_orderkey"),
            key("customer", "o_custkey"), F.lit("symbol"), "o_orderpriority",
        ),
    ]
    out = parts[0].toDF(*cols)
    for x in parts[1:]:
        out = out.unionAll(x.toDF(*cols))
    return out


def links(spark: SparkSession, d: str) -> DataFrame:
    """(src, dst, link_type): contains customer-order, calls order-part, depends_on part-supplier."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    li = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey")
    order = F.concat(F.lit("customer/"), "o_custkey", F.lit("#order"), "o_orderkey")
    contains = o.select(F.concat(F.lit("customer/"), "o_custkey").alias("src"), order.alias("dst")).distinct()
    calls = o.join(li, F.col("o_orderkey") == F.col("l_orderkey")).select(order.alias("src"), F.concat(F.lit("part/"), "l_partkey").alias("dst")).distinct()
    depends = li.select(F.concat(F.lit("part/"), "l_partkey").alias("src"), F.concat(F.lit("supplier/"), "l_suppkey").alias("dst")).distinct()
    tag = lambda df, t: df.withColumn("link_type", F.lit(t))
    return tag(contains, "contains").unionAll(tag(calls, "calls")).unionAll(tag(depends, "depends_on"))


SQL = """
nodes AS (
select concat('customer/',c_custkey) node_key, c_name as name, concat('customer/',c_custkey) path, 'file' kind, c_mktsegment description from customer
union all select concat('supplier/',s_suppkey), s_name, concat('supplier/',s_suppkey), 'file', '' from supplier
union all select concat('part/',p_partkey), p_name, concat('part/',p_partkey), 'file', p_type from part
union all select concat('customer/',o_custkey,'#order',o_orderkey), concat('order',o_orderkey), concat('customer/',o_custkey), 'symbol', o_orderpriority from orders),
links AS (
select distinct concat('customer/',o_custkey) src, concat('customer/',o_custkey,'#order',o_orderkey) dst, 'contains' link_type from orders
union all select distinct concat('customer/',o_custkey,'#order',o_orderkey), concat('part/',l_partkey), 'calls' from lineitem join orders on o_orderkey=l_orderkey
union all select distinct concat('part/',l_partkey), concat('supplier/',l_suppkey), 'depends_on' from lineitem)
"""
