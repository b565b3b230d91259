"""Node-link documents and raw fragments: reading, canonical names, saving."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import PropertyGraph

NODE = "id:string,label:string,file_type:string,source_file:string,source:string"
EDGE = "source:string,target:string,from:string,to:string,relation:string,confidence:string,context:string,source_file:string"
DOCUMENT = f"directed boolean, nodes array<struct<{NODE}>>, links array<struct<{EDGE}>>, edges array<struct<{EDGE}>>"


def posix(path: Column) -> Column:
    return F.replace(F.coalesce(path, F.lit("")), F.lit("\\"), F.lit("/"))


def canonical_nodes(nodes: DataFrame) -> DataFrame:
    """nodes whose file may stand under `source`: source_file always, with forward slashes; the alias goes."""
    own = F.col("source_file") if "source_file" in nodes.columns else F.lit(None).cast("string")
    file = F.coalesce(own, F.col("source")) if "source" in nodes.columns else own
    return nodes.withColumn("source_file", posix(file)).drop("source")


def canonical_edges(edges: DataFrame) -> DataFrame:
    """edges whose ends may stand under `from` and `to`: source and target always; the aliases go."""
    for end, alias in (("source", "from"), ("target", "to")):
        if alias in edges.columns:
            own = F.nullif(F.col(end), F.lit("")) if end in edges.columns else F.lit(None).cast("string")
            edges = edges.withColumn(end, F.coalesce(own, F.col(f"`{alias}`"))).drop(alias)
    file = F.col("source_file") if "source_file" in edges.columns else F.lit("")
    return edges.withColumn("source_file", posix(file))


def parse(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """nodes and edges of documents(doc, text), each text a node-link document with `links` or else `edges`.

    A text that is no such document has none. `ord` is the place in its document.
    """
    parsed = documents.select("doc", F.from_json(F.col("text"), DOCUMENT).alias("d"))
    place = F.concat(F.col("doc").cast("string"), F.lit("|"), F.lpad(F.col("at").cast("string"), 9, "0"))

    def rows(items: Column) -> DataFrame:
        return parsed.select("doc", F.posexplode(items).alias("at", "x")).select("doc", "x.*", place.alias("ord"))

    return canonical_nodes(rows(F.col("d.nodes"))), canonical_edges(rows(F.coalesce("d.links", "d.edges")))


def save(g: PropertyGraph, path: str) -> None:
    """Writes nodes and links as JSON lines under path; each task writes its own part."""
    g.nodes.write.mode("overwrite").json(f"{path}/nodes")
    g.edges.write.mode("overwrite").json(f"{path}/links")


def load(spark: SparkSession, path: str, directed: bool = False) -> PropertyGraph:
    """The graph that save() has written."""
    text = lambda *names: ", ".join(f"`{n}` string" for n in names)
    nodes = spark.read.schema(text("id", "label", "file_type", "source_file", "source", "ord")).json(f"{path}/nodes")
    edges = spark.read.schema(text("source", "target", "from", "to", "relation", "confidence", "context", "source_file", "ord")).json(f"{path}/links")
    return PropertyGraph.build(canonical_nodes(nodes), canonical_edges(edges), directed)


def first_nodes(nodes: DataFrame) -> DataFrame:
    """One row an id, the first by ord, with all its attributes."""
    rest = [c for c in nodes.columns if c not in ("id", "ord")]
    first = nodes.groupBy("id").agg(F.min(F.struct("ord", *rest)).alias("f"))
    return first.select("id", "f.*").select(*nodes.columns)


def finished(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose ends are nodes; of imports only the source must be one."""
    ids = nodes.select("id").distinct()
    known = edges.join(ids, edges["source"] == ids["id"], "left_semi")
    outer = known.where(F.startswith("relation", F.lit("import")))
    inner = known.where(~F.startswith("relation", F.lit("import")))
    return inner.join(ids, inner["target"] == ids["id"], "left_semi").union(outer)


def external_matches(symbols: DataFrame, nodes: DataFrame) -> DataFrame:
    """(key, id): the node that each of symbols(key, file, name, line) names.

    A node of the same file with the same name at the same line, else the first of the file with that name by ord.
    """
    from ..functions.text import symbol_base

    known = nodes.select("id", "ord", F.col("source_file").alias("file"), symbol_base(F.col("label")).alias("name"), F.col("line").alias("at"))
    met = symbols.withColumn("name", symbol_base(F.col("name"))).join(known, ["file", "name"])
    best = F.struct((F.col("at") != F.col("line")).alias("off"), "ord")
    return met.groupBy("key").agg(F.min_by("id", best).alias("id"))


def children(g: PropertyGraph, most: int = 200) -> DataFrame:
    """(source_file, place, name, total): the symbols of each file by label; beyond `most`, one leaf that counts the rest."""
    from pyspark.sql import Window

    from ..functions.text import basename

    of = g.nodes.where("source_file <> ''")
    of = of.where(~((F.col("label") == basename(F.col("source_file"))) & (F.col("file_type") == "code")))
    order = Window.partitionBy("source_file").orderBy("label", "id")
    shown = of.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)  # Spark limits each group before it shuffles
    leaves = shown.select("source_file", "place", F.col("label").alias("name"), F.lit(1).cast("long").alias("total"))
    more = of.groupBy("source_file").agg((F.count(F.lit(1)) - most).alias("total")).where("total > 0")
    return leaves.union(more.select("source_file", F.lit(most + 1), F.concat(F.lit("(+"), "total", F.lit(" more)")), "total"))
