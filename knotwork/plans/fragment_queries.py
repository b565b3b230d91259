"""Queries on raw fragments and node-link documents, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import node_link
from ..operators.graph import PropertyGraph
from ..sources.tables import table

QUERIES: dict = {}
ORACLES: dict = {}
c = F.col


def register(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


def _documents(spark: SparkSession, d: str) -> DataFrame:
    """A node-link document for each order: customer and order with a link; every third has `edges` instead, every fifth is broken."""
    o = table(spark, d, "orders")
    customer, order = F.concat(F.lit("customer_"), "o_custkey"), F.concat(F.lit("Order."), "o_orderkey")
    nodes = F.array(F.struct(customer.alias("id"), F.lit("sales\\customers.py").alias("source_file")), F.struct(order.alias("id"), F.lit("sales\\orders.py").alias("source_file")))
    link = F.array(F.struct(customer.alias("source"), F.concat(F.lit("order_"), "o_orderkey").alias("target"), F.lit("places").alias("relation")), F.struct(customer.alias("source"), F.lit("ghost").alias("target"), F.lit("haunts").alias("relation")))
    text = F.when(c("o_orderkey") % 3 == 0, F.to_json(F.struct(nodes.alias("nodes"), link.alias("edges")))).otherwise(F.to_json(F.struct(nodes.alias("nodes"), link.alias("links"))))
    return o.select(c("o_orderkey").alias("doc"), F.when(c("o_orderkey") % 5 == 0, F.lit("no document")).otherwise(text).alias("text"))


@register("SELECT 'customer_' || o_custkey AS source, 'Order.' || o_orderkey AS target, 'places' AS relation FROM orders WHERE o_orderkey % 5 <> 0")
def load_node_link(spark, d):
    nodes, edges = node_link.parse(_documents(spark, d))
    edges = edges.withColumn("confidence", F.coalesce("confidence", F.lit("EXTRACTED")))
    return PropertyGraph.build(nodes.drop("doc"), edges.drop("doc")).edges.select("source", "target", "relation")


@register("SELECT id, min(file) AS source_file FROM (SELECT 'customer_' || o_custkey AS id, 'sales/customers.py' AS file FROM orders WHERE o_orderkey % 5 <> 0 UNION ALL SELECT 'Order.' || o_orderkey, 'sales/orders.py' FROM orders WHERE o_orderkey % 5 <> 0) GROUP BY id")
def load_node_link_nodes(spark, d):
    nodes, _ = node_link.parse(_documents(spark, d))
    return node_link.first_nodes(nodes.drop("doc")).select("id", "source_file")


def _raw_edges(spark, d) -> DataFrame:
    li = table(spark, d, "lineitem")
    order, part = F.concat(F.lit("order_"), "l_orderkey"), F.concat(F.lit("part_"), "l_partkey")
    odd = c("l_linenumber") % 2 == 1
    return li.select(F.when(odd, order).otherwise("").alias("source"), F.when(odd, part).alias("target"), F.when(~odd, order).alias("from"), F.when(~odd, part).alias("to"), F.concat(F.lit("sales\\"), "l_returnflag", F.lit(".py")).alias("source_file"))


@register("SELECT 'order_' || l_orderkey AS source, 'part_' || l_partkey AS target, 'sales/' || l_returnflag || '.py' AS source_file FROM lineitem")
def canonicalize(spark, d):
    return node_link.canonical_edges(_raw_edges(spark, d)).select("source", "target", "source_file")


def _part_nodes(spark, d) -> DataFrame:
    order = F.concat(F.lpad(c("l_orderkey").cast("string"), 12, "0"), F.lpad(c("l_linenumber").cast("string"), 4, "0"), F.lpad((c("l_quantity") * 100).cast("long").cast("string"), 9, "0"), "l_linestatus")
    return table(spark, d, "lineitem").select(F.concat(F.lit("part_"), "l_partkey").alias("id"), c("l_linestatus").alias("label"), c("l_returnflag").alias("flag"), order.alias("ord"))


_ORD = "lpad(l_orderkey::VARCHAR, 12, '0') || lpad(l_linenumber::VARCHAR, 4, '0') || lpad((l_quantity * 100)::BIGINT::VARCHAR, 9, '0') || l_linestatus"


@register(f"SELECT id, label, flag FROM (SELECT 'part_' || l_partkey AS id, l_linestatus AS label, l_returnflag AS flag, row_number() OVER (PARTITION BY l_partkey ORDER BY {_ORD}, l_linestatus, l_returnflag) AS k FROM lineitem) WHERE k = 1")
def dedup_nodes(spark, d):
    return node_link.first_nodes(_part_nodes(spark, d)).select("id", "label", "flag")


@register("""SELECT 'order_' || l_orderkey AS source, CASE WHEN l_linenumber % 3 = 0 THEN 'lib_' || l_linestatus ELSE 'part_' || l_partkey END AS target, CASE WHEN l_linenumber % 3 = 0 THEN 'imports' ELSE 'contains' END AS relation
FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 7 <> 0) AND (l_linenumber % 3 = 0 OR l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 10))""")
def finish_filter(spark, d):
    outer = c("l_linenumber") % 3 == 0
    target = F.when(outer, F.concat(F.lit("lib_"), "l_linestatus")).otherwise(F.concat(F.lit("part_"), "l_partkey"))
    edges = table(spark, d, "lineitem").select(F.concat(F.lit("order_"), "l_orderkey").alias("source"), target.alias("target"), F.when(outer, "imports").otherwise("contains").alias("relation"))
    orders = table(spark, d, "orders").where("o_orderkey % 7 <> 0").select(F.concat(F.lit("order_"), "o_orderkey").alias("id"))
    parts = table(spark, d, "part").where("p_size > 10").select(F.concat(F.lit("part_"), "p_partkey").alias("id"))
    return node_link.finished(edges, orders.union(parts))


@register("""WITH n AS (SELECT 'part_' || p_partkey AS id, lpad(p_partkey::VARCHAR, 9, '0') AS ord, p_brand AS file, p_size % 5 AS name, p_size AS at FROM part)
SELECT key, id FROM (SELECT c_custkey AS key, n.id, row_number() OVER (PARTITION BY c_custkey ORDER BY n.at <> c_custkey % 50, n.ord) AS k
FROM customer JOIN n ON n.file = (SELECT min(p_brand) FROM part) AND n.name = c_custkey % 7) WHERE k = 1""")
def external_edge_match(spark, d):
    p = table(spark, d, "part")
    nodes = p.select(F.concat(F.lit("part_"), "p_partkey").alias("id"), F.lpad(c("p_partkey").cast("string"), 9, "0").alias("ord"), c("p_brand").alias("source_file"), F.concat(F.lit(".Size"), c("p_size") % 5, F.lit("()")).alias("label"), c("p_size").alias("line"))
    file = p.agg(F.min("p_brand").alias("file"))
    symbols = table(spark, d, "customer").select(c("c_custkey").alias("key"), F.concat(F.lit("size"), c("c_custkey") % 7).alias("name"), (c("c_custkey") % 50).alias("line"))
    return node_link.external_matches(symbols.join(F.broadcast(file)), nodes)  # one file


@register("""WITH s AS (SELECT n_name || '.py' AS file, c_name AS label, 'c' || c_custkey AS id FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT n_name || '.py', n_name || '.py', n_name FROM nation),
r AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY label, id) AS place FROM s WHERE label <> file)
SELECT file AS source_file, place, label AS name, 1 AS total FROM r WHERE place <= 3 UNION ALL SELECT file, 4, '(+' || (count(*) - 3) || ' more)', count(*) - 3 FROM r GROUP BY file HAVING count(*) > 3""")
def tree_children(spark, d):
    n, cu = table(spark, d, "nation"), table(spark, d, "customer")
    file = F.concat("n_name", F.lit(".py"))
    symbols = cu.join(n, cu["c_nationkey"] == n["n_nationkey"]).select(F.concat(F.lit("c"), "c_custkey").alias("id"), c("c_name").alias("label"), file.alias("source_file"))
    nodes = symbols.union(n.select("n_name", file, file)).withColumn("file_type", F.lit("code"))
    return node_link.children(PropertyGraph(nodes, nodes.limit(0)), most=3)
