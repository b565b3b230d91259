"""Checks of nodes and edges; problems are rows, nothing is raised."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values.
FILE_TYPES = ("code", "document", "paper", "image", "video", "rationale", "concept", "dependency")
CONFIDENCES = ("EXTRACTED", "STATIC_RESOLVED", "INFERRED", "AMBIGUOUS")


def problems(nodes: DataFrame, edges: DataFrame, file_types=FILE_TYPES, confidences=CONFIDENCES) -> DataFrame:
    """(error, at): missing fields, unexpected values, ends without a node."""
    rows = [nodes.where(F.col(c).isNull()).select(F.lit(f"missing {c}").alias("error"), F.col("ord").alias("at")) for c in ("id", "label", "file_type", "source_file")]
    rows += [edges.where(F.col(c).isNull()).select(F.lit(f"missing {c}"), "ord") for c in ("source", "target", "relation", "confidence", "source_file")]
    rows += [nodes.where(~F.col("file_type").isin(list(file_types))).select(F.lit("unexpected file_type"), "ord"), edges.where(~F.col("confidence").isin(list(confidences))).select(F.lit("unexpected confidence"), "ord")]
    ids = nodes.select("id").distinct()
    rows += [edges.join(ids, edges[end] == ids["id"], "left_anti").select(F.lit(f"unexpected {end}"), "ord") for end in ("source", "target")]
    return reduce(DataFrame.union, rows)
