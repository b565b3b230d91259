"""Exports: scripts, layouts and trees as DataFrames of lines or places."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import canvas_name, cypher_escape, escape_html
from .graph import PropertyGraph

#: Colours of communities.
COLORS = ("#4E79A7", "#F28E2B", "#E15759", "#76B7B2", "#59A14F", "#EDC948", "#B07AA1", "#FF9DA7", "#9C755F", "#BAB0AC")


def with_scores(edges: DataFrame) -> DataFrame:
    """Fills confidence_score where it is missing."""
    if "confidence_score" not in edges.columns:
        edges = edges.withColumn("confidence_score", F.lit(None).cast("double"))
    default = F.when(F.col("confidence") == "EXTRACTED", 1.0).when(F.col("confidence") == "AMBIGUOUS", 0.2).otherwise(0.5)
    return edges.withColumn("confidence_score", F.coalesce("confidence_score", default))


def _format(template: str, *columns):
    return F.format_string(template, *columns)


def cypher_nodes(g: PropertyGraph) -> DataFrame:
    parts = [cypher_escape(F.col(c)) for c in ("id", "label", "file_type", "source_file")]
    return g.nodes.select("ord", _format("MERGE (n:Node {id:'%s'}) SET n.label='%s', n.file_type='%s', n.source_file='%s';", *parts).alias("line"))


def placed(df: DataFrame, out: str = "k") -> DataFrame:
    """0-based places by ord."""
    return df.withColumn(out, F.row_number().over(Window.orderBy("ord")) - 1)


def cypher_edges(g: PropertyGraph) -> DataFrame:
    e = placed(g.edges)
    parts = [cypher_escape(F.col("source")), cypher_escape(F.col("target")), F.col("k"), cypher_escape(F.col("relation")), cypher_escape(F.col("confidence"))]
    return e.select("ord", _format("MATCH (a:Node {id:'%s'}), (b:Node {id:'%s'}) MERGE (a)-[r:RELATED {id:'e%d'}]->(b) SET r.relation='%s', r.confidence='%s';", *parts).alias("line"))


def graphml_nodes(placed: DataFrame) -> DataFrame:
    """Lines of nodes(id, label, cid, ord)."""
    parts = [escape_html(F.col("id")), escape_html(F.col("label")), F.coalesce(F.col("cid").cast("string"), F.lit(""))]
    return placed.select("ord", _format('<node id="%s"><data key="label">%s</data><data key="community">%s</data></node>', *parts).alias("line"))


def graphml_edges(g: PropertyGraph) -> DataFrame:
    parts = [F.col("k"), escape_html(F.col("source")), escape_html(F.col("target")), escape_html(F.col("relation"))]
    return placed(g.edges).select("ord", _format('<edge id="e%d" source="%s" target="%s"><data key="relation">%s</data></edge>', *parts).alias("line"))


def canvas(g: PropertyGraph) -> DataFrame:
    """Cards in rows of eight."""
    n = placed(g.nodes)
    return n.select("id", F.concat(canvas_name(F.col("label")), F.lit(".md")).alias("file"), ((F.col("k") % 8) * 320).alias("x"), (F.floor(F.col("k") / 8) * 180).alias("y"))


def svg_layout(g: PropertyGraph, width: int = 1200, height: int = 900) -> DataFrame:
    """Nodes on a circle, larger with their degree."""
    total, radius = max(1, g.nodes.count()), min(width, height) * 0.38
    n = placed(g.nodes).join(g.degree, "id").withColumn("a", F.lit(2 * math.pi) * F.col("k") / total)
    return n.select("id", (width / 2 + F.cos("a") * radius).alias("x"), (height / 2 + F.sin("a") * radius).alias("y"), F.greatest(F.lit(5), F.least(F.lit(18), F.col("degree") + 5)).alias("r"))


def viz(g: PropertyGraph, member: DataFrame) -> DataFrame:
    n = g.nodes.join(g.degree, "id").join(member, "id")
    color = F.element_at(F.lit(list(COLORS)).cast("array<string>"), (F.col("cid") % len(COLORS) + 1).cast("int"))
    return n.select("id", "label", F.col("cid").cast("long").alias("community"), "degree", F.greatest(F.lit(8), F.least(F.lit(34), 8 + F.col("degree"))).alias("size"), color.alias("color"))


def tree(g: PropertyGraph) -> DataFrame:
    """(prefix, n): number of symbols under each folder and file."""
    parts = F.split("source_file", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    files = g.nodes.where("source_file <> ''").groupBy("source_file").agg(F.count(F.lit(1)).alias("k"))
    return files.select("k", F.explode(prefixes).alias("prefix")).groupBy("prefix").agg(F.sum("k").alias("n"))
