"""The property graph: two DataFrames, and the relational form of what the graph rules ask for.

nodes(id, label, file_type, source_file, ord) and edges(source, target, relation, confidence, context, source_file, ord);
more columns may follow. `ord` is a sortable string that stands for insertion order: the later of two equal keys wins
and takes the earlier one's place.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..sources.tables import cut, discard, within


def merge_nodes(nodes: DataFrame) -> DataFrame:
    """One row an id: of each column the last value that is present, and the first place."""
    rest = [c for c in nodes.columns if c not in ("id", "ord")]
    return nodes.groupBy("id").agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), F.col("ord"))).alias(c) for c in rest), F.min("ord").alias("ord"))


def _key(*columns) -> Column:
    """A hash of 40 bits: equal columns have equal ones, and few bytes of it are shuffled."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 24)


def _again(rows: DataFrame, key: Column) -> DataFrame | None:
    """The keys that occur more than once, written; None without any."""
    again = cut(rows.groupBy(key.alias("h")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h"))
    if not again.isEmpty():
        return again
    discard(again)
    return None


def merge_few(nodes: DataFrame) -> DataFrame:
    """merge_nodes() where few ids repeat: of most nodes only a hash of the id is shuffled, and none of them is written."""
    nodes = nodes.select("id", *(c for c in nodes.columns if c not in ("id", "ord")), "ord")
    again = _again(nodes, _key("id"))
    if again is None:
        return nodes
    repeats = within(again)(_key("id"))
    return nodes.where(~repeats).union(cut(merge_nodes(nodes.where(repeats))))


def resolve(edges: DataFrame, nodes: DataFrame, normalise: bool = True) -> DataFrame:
    """Edges whose ends exist, by id or else (if asked for) by normalised id (the last node of a collision wins).

    Only ids are shuffled; the edges meet no more than the ends that are no ids.
    """
    ends = edges.select(F.explode(F.array("source", "target")).alias("id")).where("id is not null").distinct()
    other = cut(ends.join(nodes.select("id"), "id", "left_anti"))
    edges = edges.where("source is not null and target is not null")
    if other.isEmpty():
        return edges
    if not normalise:
        for end in ("source", "target"):
            edges = edges.join(other.withColumnRenamed("id", end), end, "left_anti").select(edges.columns)
        return edges
    norms = nodes.groupBy(text.normalize_id(F.col("id")).alias("_norm")).agg(F.max_by("id", "ord").alias("to"))
    moved = cut(other.join(norms, text.normalize_id(other["id"]) == F.col("_norm"), "left").select(F.col("id").alias("_from"), "to"))
    for end in ("source", "target"):
        edges = edges.join(moved, F.col(end) == F.col("_from"), "left")
        edges = edges.withColumn(end, F.when(F.col("_from").isNull(), F.col(end)).otherwise(F.col("to"))).where(F.col(end).isNotNull()).drop("_from", "to")
    return edges


def collapse(edges: DataFrame, directed: bool = False) -> DataFrame:
    """A simple graph: one edge a pair of ends, all attributes from the last, the place of the first.

    Of most edges only a hash of the pair is shuffled: those whose hash occurs once pass as they are.
    """
    u, v = (F.col("source"), F.col("target")) if directed else (F.least("source", "target"), F.greatest("source", "target"))
    rest = [c for c in edges.columns if c != "ord"]
    pair = _key(u, v)
    again = _again(edges, pair)
    once = edges.select(*rest, "ord")
    if again is None:
        return once
    repeats = within(again)(pair)
    out = edges.where(repeats).groupBy(u.alias("_u"), v.alias("_v")).agg(F.max(F.struct("ord", *rest)).alias("_e"), F.min("ord").alias("ord"))
    return once.where(~repeats).union(cut(out.select(*(F.col(f"_e.{c}") for c in rest), "ord")))


@dataclass(frozen=True)
class PropertyGraph:
    nodes: DataFrame
    edges: DataFrame
    directed: bool = False

    @property
    def loose(self) -> DataFrame | None:
        """(source, target) of edges as they come, if that is less work: pairs may repeat, ends may be no nodes."""
        return None

    @classmethod
    def build(cls, nodes: DataFrame, edges: DataFrame, directed: bool = False) -> PropertyGraph:
        nodes = merge_nodes(nodes)
        return cls(nodes, collapse(resolve(edges, nodes), directed), directed)

    @cached_property
    def key(self) -> Callable[[str], Column]:
        """Of an id column what tells nodes apart in few bytes: a hash of 64 bits, or the id itself if two nodes share one."""
        again = _again(self.nodes.where("id is not null"), F.xxhash64("id"))
        discard(again)
        return F.xxhash64 if again is None else F.col

    @cached_property
    def neighbours(self) -> DataFrame:
        """(id, nbr): opposite ends in both directions, each once."""
        # An undirected simple graph holds a pair once, so it needs no shuffle.
        way = lambda a, b: F.struct(F.col(a).alias("id"), F.col(b).alias("nbr"))
        there, back = way("source", "target"), way("target", "source")
        ways = F.when(F.col("source") == F.col("target"), F.array(there)).otherwise(F.array(there, back))
        both = self.edges.select(F.inline(ways))
        return both.distinct() if self.directed else both

    @cached_property
    def degree(self) -> DataFrame:
        """(id, degree) of every node; a loop counts 1."""
        return self.degree_of(self.nodes)

    def degree_of(self, ids: DataFrame, few: bool = False) -> DataFrame:
        """(id, degree) of the nodes in ids, which holds each once; if they are few, only their edges are shuffled."""
        near = self.neighbours
        if few:
            near = near.where(within(ids.select(F.xxhash64("id").alias("h")))(F.xxhash64("id")))
        counts = near.groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
        return ids.select("id").join(counts, "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"))

    def subgraph(self, ids: DataFrame) -> PropertyGraph:
        keep = ids.select("id").distinct()
        nodes = self.nodes.join(keep, "id", "left_semi")
        edges = self.edges.join(keep.withColumnRenamed("id", "source"), "source", "left_semi").join(keep.withColumnRenamed("id", "target"), "target", "left_semi")
        return PropertyGraph(nodes, edges.select(self.edges.columns), self.directed)

    def with_context(self, *contexts: str) -> PropertyGraph:
        return PropertyGraph(self.nodes, self.edges.where(F.col("context").isin(list(contexts))), self.directed) if contexts else self

    def directions(self) -> DataFrame:
        """(id, nbr, relation, confidence): each edge from both ends, once for a loop; directed edges from their source only."""
        out = self.edges.select(F.col("source").alias("id"), F.col("target").alias("nbr"), "relation", "confidence", "context")
        back = self.edges.where("source <> target").select("target", "source", "relation", "confidence", "context")
        return out if self.directed else out.union(back)

    def ends(self) -> DataFrame:
        """Edges with the attributes of both ends as s_* and t_*."""
        known = self.nodes.join(self.degree, "id").withColumn("file_like", file_like()).withColumn("concept", concept())
        side = lambda p: known.select(*(F.col(c).alias(f"{p}_{c}") for c in ("id", "label", "source_file", "degree", "file_like", "concept")))
        e = self.edges
        return e.join(side("s"), e["source"] == F.col("s_id")).join(side("t"), e["target"] == F.col("t_id"))


class LazyGraph(PropertyGraph):
    """A graph whose edges are built when they are first asked for."""

    def __init__(self, nodes: DataFrame, make: Callable[[], DataFrame], loose: Callable[[], DataFrame]) -> None:
        object.__setattr__(self, "nodes", nodes)
        object.__setattr__(self, "make", make)
        object.__setattr__(self, "make_loose", loose)

    @property
    def loose(self) -> DataFrame:
        return self.make_loose()

    @cached_property
    def edges(self) -> DataFrame:
        return self.make()


def merge_graphs(graphs: dict[str, PropertyGraph]) -> PropertyGraph:
    """Later graphs override the nodes and edges they share with earlier ones; nodes carry the repository they last came from."""
    nodes = edges = None
    for i, (repo, g) in enumerate(graphs.items()):
        n = g.nodes.withColumn("repo", F.lit(repo)).withColumn("ord", F.concat(F.lit(f"{i:04d}|"), "ord"))
        e = g.edges.withColumn("ord", F.concat(F.lit(f"{i:04d}|"), "ord"))
        nodes, edges = (n, e) if nodes is None else (nodes.unionByName(n), edges.unionByName(e))
    return PropertyGraph(merge_nodes(nodes), collapse(edges))


def file_like(label: str = "label", source: str = "source_file", degree: str = "degree") -> Column:
    """Nodes that stand for a file or a method; needs the degree."""
    lab, src = F.coalesce(F.col(label), F.lit("")), F.coalesce(F.col(source), F.lit(""))
    call = F.endswith(lab, F.lit("()"))
    return ((src != "") & (lab == text.basename(src))) | (F.startswith(lab, F.lit(".")) & call) | (call & (F.col(degree) <= 1))


def concept(source: str = "source_file") -> Column:
    src = F.coalesce(F.col(source), F.lit(""))
    return (src == "") | ~F.contains(text.basename(src), F.lit("."))
