"""Communities: components, the large ones split by directory; ranks, labels and cohesion."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import round_half_up
from ..sources.tables import cut, discard, within
from .components import forests
from .graph import PropertyGraph


def _top() -> Column:
    """The first directory of a node's file, by which large components are split."""
    src = F.coalesce("source_file", F.lit(""))
    return F.when(F.contains(src, F.lit("/")), F.split_part(src, F.lit("/"), F.lit(1))).when(src == "", "unknown").otherwise(src)


@dataclass(frozen=True)
class Communities:
    """One written table: (top, cid) of the largest component, if most nodes are in it, and (id, cid) of all other nodes."""

    table: DataFrame
    tops: int
    others: int

    @cached_property
    def _maybe(self):
        return within(self.table.where("id is not null").select(F.xxhash64("id").alias("h")))

    def of(self, nodes: DataFrame) -> DataFrame:
        """nodes(id, source_file, ...) of the graph with cid; only those that may be outside of the largest component are shuffled."""
        others = self.table.where("id is not null").select("id", "cid")
        if not self.tops:
            return nodes.join(others, "id")
        usual = self.table.where("top is not null").select(F.col("top").alias("_top"), F.col("cid").alias("_cid"))
        usual = F.broadcast(usual) if self.tops <= 100_000 else usual
        out = nodes.where("id is not null").withColumn("_top", _top()).join(usual, "_top", "left")
        if self.others:
            may = self._maybe(F.xxhash64("id"))
            odd = out.where(may).join(others, "id", "left").withColumn("cid", F.coalesce("cid", "_cid"))
            out = out.where(~may).withColumn("cid", F.col("_cid")).unionByName(odd)
        else:
            out = out.withColumn("cid", F.col("_cid"))
        return out.select(*nodes.columns, "cid")


def communities(g: PropertyGraph, cut=cut) -> Communities:
    """A component above max(10, a quarter of the nodes) is split by the first directory of its files.

    Components need no simple graph: edges that repeat pass, and ends that are no nodes show where nodes meet their links.
    """
    nodes = g.nodes.select("id", _top().alias("kind"))
    ends = lambda e: e.select(F.col("source").alias("a"), F.col("target").alias("b"))
    of, above = forests(ends(g.edges if g.loose is None else g.loose), nodes, cut)
    if g.loose is not None and not of.where("kind is null").isEmpty():
        discard(of, above)
        of, above = forests(ends(g.edges), nodes, cut)
    rooted = of.where("kind is not null").join(above, "root", "left").select("id", F.coalesce("_top", "root", "id").alias("root"), F.col("kind").alias("top"))
    written, rooted = of, cut(rooted)
    discard(written)
    total = rooted.count()
    sizes = rooted.groupBy("root").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max(10, total // 4))
    large = {r["root"]: r["n"] for r in sizes.collect()}  # three at most
    split = rooted.select("id", "root", F.when(F.col("root").isin(list(large)), F.col("top")).otherwise("").alias("top"))
    parts = split.groupBy("root", "top").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    # One row a community; a global rank of them is what is asked for.
    rank = F.row_number().over(Window.orderBy(F.desc("n"), F.translate("first", "_", " "))) - 1
    parts = cut(parts.select("root", "top", rank.alias("cid")))
    first = max(large, key=lambda x: (large[x], x), default=None)
    if first is None or 4 * (total - large[first]) > total:
        return Communities(cut(split.join(parts, ["root", "top"]).select("id", F.lit(None).cast("string").alias("top"), "cid")), 0, total)
    here, rest = F.col("root") == F.lit(first), split.where(~F.col("root").eqNullSafe(first))
    usual = parts.where(here).select(F.lit(None).cast(g.nodes.schema["id"].dataType).alias("id"), "top", "cid")
    tops = usual.count()
    return Communities(cut(usual.unionByName(rest.join(parts, ["root", "top"]).select("id", F.lit(None).cast("string").alias("top"), "cid"))), tops, total - large[first])


def cluster(g: PropertyGraph, cut=cut) -> DataFrame:
    """(id, cid) of the nodes."""
    return communities(g, cut).of(g.nodes).select("id", "cid")


def _among(rows: DataFrame):
    return (lambda x: F.lit(False)) if rows.isEmpty() else within(rows.select(F.xxhash64("id").alias("h")))


def told(placed: DataFrame):
    """A function of id columns that gives the community of most nodes without a shuffle, null for the rest, and the rest as (id, cid).

    For nodes of the two largest communities, 0 and 1. A filter of what is outside of 0 lets no such node by, but some
    of 0; a second filter has just those, so that what passes the first one only is outside for certain.
    """
    rest = cut(placed.where("cid > 0").select("id", "cid"))
    outside = _among(rest)
    wrong = cut(placed.where("cid = 0").where(outside(F.xxhash64("id"))).select("id", "cid"))
    inside, further = _among(wrong), _among(rest.where("cid > 1"))

    def tell(c: str) -> Column:
        h = F.xxhash64(c)
        return F.when(~outside(h), 0).when(~inside(h) & ~further(h), 1)

    return tell, cut(wrong.union(rest).where(tell("id").isNull()))


def cross_links(g: PropertyGraph, placed: DataFrame) -> DataFrame:
    """(cid, other, links): edges between each two communities, from both sides; only edges with an end that told() leaves open are shuffled."""
    tell, odd = told(placed)
    # Always true; rand() is not deterministic, which is meant to keep the filters above the union of edges, not in each of its parts.
    always = F.rand(0) >= 0
    e = g.edges.select("source", "target", F.when(always, tell("source")).alias("s"), F.when(always, tell("target")).alias("t"))
    left_open = F.col("s").isNull() | F.col("t").isNull()
    e = e.where(left_open | (F.col("s") != F.col("t")))
    n = cut(e.groupBy("s", "t", *(F.when(left_open, F.col(x)).alias(x) for x in ("source", "target"))).agg(F.count(F.lit(1)).alias("n")))
    rest = n.where("source is not null")
    for end, cid in (("source", "s"), ("target", "t")):
        rest = rest.join(odd.select(F.col("id").alias(end), F.col("cid").alias("_cid")), end, "left").withColumn(cid, F.coalesce(cid, "_cid")).drop("_cid")
    both = n.where("source is null").select("s", "t", "n").union(rest.select("s", "t", "n")).where("s <> t")
    way = lambda a, b: F.struct(F.col(a).alias("cid"), F.col(b).alias("other"), F.col("n"))
    return both.select(F.inline(F.array(way("s", "t"), way("t", "s")))).groupBy("cid", "other").agg(F.sum("n").alias("links"))


def labels(placed: DataFrame) -> DataFrame:
    """(cid, label) of communities of placed(id, label, cid): the first three labels of nodes that are no file names."""
    named = placed.where(~F.rlike("label", F.lit(r"\.(py|ts)$")))
    name = F.regexp_replace(F.regexp_replace("label", r"^\.", ""), r"\(\)$", "")
    first = named.withColumn("k", F.row_number().over(Window.partitionBy("cid").orderBy("id"))).where("k <= 3")
    lists = first.groupBy("cid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", name.alias("name")))), lambda x: x["name"]), ", ").alias("l"))
    return placed.select("cid").distinct().join(lists, "cid", "left").select("cid", F.coalesce("l", F.concat(F.lit("Community "), "cid")).alias("label"))


def cohesion(g: PropertyGraph, member: DataFrame) -> DataFrame:
    """(cid, n, cohesion): the share of possible edges that exist inside, 2 decimals; 1 for a single node."""
    side = lambda e: member.select(F.col("id").alias(e), F.col("cid").alias(f"{e}_cid"))
    inside = g.edges.join(side("source"), "source").join(side("target"), "target").where("source_cid = target_cid")
    found = inside.groupBy(F.col("source_cid").alias("cid")).agg(F.count(F.lit(1)).alias("inside"))
    sizes = member.groupBy("cid").agg(F.count(F.lit(1)).alias("n"))
    share = F.try_divide(F.coalesce("inside", F.lit(0)), F.col("n") * (F.col("n") - 1) / 2)
    return sizes.join(found, "cid", "left").select("cid", "n", F.when(F.col("n") <= 1, 1.0).otherwise(round_half_up(share, 100)).alias("cohesion"))
