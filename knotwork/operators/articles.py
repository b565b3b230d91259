"""Wiki articles of communities as rows: one Markdown text a community, and file names that are given once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import wiki_file_name
from .graph import PropertyGraph

#: The order of the audit trail, and how many rows a section has.
CONFIDENCES = ("EXTRACTED", "STATIC_RESOLVED", "INFERRED", "AMBIGUOUS")
CONCEPTS, LINKS, FILES = 25, 12, 20


def _section(rows: DataFrame, line: Column, order: list, most: int, name: str) -> DataFrame:
    """cid and the lines of its first `most` rows; each task keeps only so many before the shuffle."""
    first = rows.withColumn("k", F.row_number().over(Window.partitionBy("cid").orderBy(*order))).where(F.col("k") <= most)
    lists = F.array_sort(F.collect_list(F.struct("k", line.alias("line"))))
    return first.groupBy("cid").agg(F.array_join(F.transform(lists, lambda x: x["line"]), "\n").alias(name))


def community_articles(g: PropertyGraph, member: DataFrame, labels: DataFrame) -> DataFrame:
    """(cid, label, text) of each community of member(id, cid) with labels(cid, label)."""
    nodes = g.nodes.join(g.degree, "id").join(member, "id")
    concept = F.concat(F.lit("- **"), "label", F.lit("** ("), "degree", F.lit(" connections)"), F.when(F.col("source_file") != "", F.concat(F.lit(" — `"), "source_file", F.lit("`"))).otherwise(""))
    concepts = _section(nodes.select("cid", "id", "label", "degree", "source_file"), concept, [F.desc("degree"), "id"], CONCEPTS, "concepts")
    far = member.select(F.col("id").alias("nbr"), F.col("cid").alias("other"))
    pairs = g.neighbours.join(member, "id").join(far, "nbr").where("cid <> other").groupBy("cid", "other").agg(F.count(F.lit(1)).alias("n"))
    shared = pairs.join(labels.withColumnRenamed("cid", "other"), "other").groupBy("cid", "label").agg(F.sum("n").alias("n"))
    links = _section(shared, F.concat(F.lit("- [["), "label", F.lit("]] ("), "n", F.lit(" shared connections)")), [F.desc("n"), "label"], LINKS, "links")
    paths = nodes.where("source_file <> ''").select("cid", "source_file").distinct()
    files = _section(paths, F.concat(F.lit("- `"), "source_file", F.lit("`")), ["source_file"], FILES, "files")
    counts = [F.count_if(F.col("confidence") == x).alias(x) for x in CONFIDENCES]
    audit = g.directions().join(member, "id").groupBy("cid").agg(*counts, F.count(F.lit(1)).alias("ends"))

    every = member.groupBy("cid").agg(F.count(F.lit(1)).alias("n_nodes")).join(labels, "cid")
    for part in (concepts, links, files, audit):
        every = every.join(part, "cid", "left")
    share = lambda x: F.floor(F.coalesce(x, F.lit(0)) / F.coalesce("ends", F.lit(1)) * 100 + 0.5)
    trail = [F.concat(F.lit(f"- {x}: "), F.coalesce(x, F.lit(0)), F.lit(" ("), share(F.col(x)), F.lit("%)")) for x in CONFIDENCES]
    more = F.when(F.col("n_nodes") > CONCEPTS, F.concat(F.lit("\n- *... and "), F.col("n_nodes") - CONCEPTS, F.lit(" more nodes in this community*"))).otherwise("")
    text = F.concat(
        *(F.lit("# "), F.col("label"), F.lit("\n\n> "), F.col("n_nodes"), F.lit(" nodes\n\n## Key Concepts\n\n"), F.col("concepts"), more),
        *(F.lit("\n\n## Relationships\n\n"), F.coalesce("links", F.lit("- No strong cross-community connections detected"))),
        F.coalesce(F.concat(F.lit("\n\n## Source Files\n\n"), "files"), F.lit("")),
        *(F.lit("\n\n## Audit Trail\n\n"), F.concat_ws("\n", *trail)),
    )
    return every.select("cid", "label", text.alias("text"))


def file_names(articles: DataFrame, order: str = "cid") -> DataFrame:
    """articles(label, ...) with file: names by label, a number added to names that came before in `order`."""
    rows = articles.withColumn("file", wiki_file_name(F.col("label")))
    for _ in range(2):  # a numbered name may be another's own
        k = F.row_number().over(Window.partitionBy("file").orderBy(order))
        rows = rows.withColumn("k", k).withColumn("file", F.when(F.col("k") > 1, F.concat_ws("_", "file", "k")).otherwise(F.col("file"))).drop("k")
    return rows
