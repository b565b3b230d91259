"""Connected components: forests of what a task reads, contracted, then alternating large-star and small-star steps."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import cut, discard

#: Links that a task puts together at once.
CHUNK = 1 << 20


def _forest(batches):
    """(id, root) of each end of the links of a chunk; root is the smallest id reachable inside the chunk."""

    def out(held):
        a, b = (pa.concat_arrays([x.column(i) for x in held]) for i in (0, 1))
        ids = pc.unique(pa.concat_arrays([a, b]))
        ids = ids.take(pc.sort_indices(ids))
        i, j = (pc.index_in(x, ids).to_numpy(zero_copy_only=False) for x in (a, b))
        label = np.arange(len(ids))
        while True:
            before = label.copy()
            low = np.minimum(label[i], label[j])
            for end in (i, j):
                np.minimum.at(label, before[end], low)  # the roots of both ends first, so that whole trees move
                np.minimum.at(label, end, low)
            label = label[label]
            if (label == before).all():
                break
        for at in range(0, len(ids), 65536):
            yield pa.record_batch([ids[at : at + 65536], ids.take(pa.array(label[at : at + 65536]))], ["id", "root"])

    held, n = [], 0
    for x in batches:
        if x.num_rows:
            held, n = [*held, x], n + x.num_rows
        if n >= CHUNK:
            yield from out(held)
            held, n = [], 0
    if held:
        yield from out(held)


def components(links: DataFrame, cut=cut, written: bool = False) -> DataFrame:
    """(id, component) of every end of links(a, b); component is the smallest id reachable. Tables that cut writes are read by it.

    If links are a table that was `written`, they are counted: a chunk of them at most is one forest, which needs no steps.
    """
    if written and links.count() <= CHUNK:
        kind = links.schema["a"].dataType.simpleString()
        one = links.where("a <> b").select("a", "b").coalesce(1).mapInArrow(_forest, f"id {kind}, root {kind}")
        return cut(one).select("id", F.col("root").alias("component"))
    of, above = forests(links, cut=cut)
    return of.select("id", "root").join(above, "root", "left").select("id", F.coalesce("_top", "root").alias("component"))


def forests(links: DataFrame, nodes: DataFrame | None = None, cut=cut) -> tuple[DataFrame, DataFrame]:
    """Two tables that cut writes: (id, root, roots) of every end of links(a, b), and (root, _top) of roots that have a smaller one.

    nodes(id, kind) are dealt out with what their links give, so that they need no join: their table has a row for each
    of them too, and kind, which is null for ends that are no nodes.

    Links become forests where they are read, so that they are not shuffled: an id has a root in each chunk it occurs in, and
    the roots of an id are linked. The smallest id of a component is a root. The steps over the links of roots each are
    a minimum per node, which Spark sums up before it shuffles, and a join, whose hot nodes adaptive execution splits.
    They end when the links no longer change; every step before that lowers some end, so they do end.
    """
    kind = links.schema["a"].dataType.simpleString()
    found = links.where("a <> b").select("a", "b").mapInArrow(_forest, f"id {kind}, root {kind}")
    if nodes is None:
        written, rows, more = (found := cut(found)), found, {}
    else:
        written, rows, more = None, found.unionByName(nodes.select("id", "kind"), allowMissingColumns=True), {"kind": F.max("kind")}
    # Dealt out first, as rows of two strings take less of a shuffle than sets do.
    sets = rows.repartition("id").groupBy("id").agg(F.collect_set("root").alias("roots"), *(v.alias(k) for k, v in more.items()))
    of = cut(sets.select("id", F.array_min("roots").alias("root"), F.when(F.size("roots") > 1, F.col("roots")).alias("roots"), *more))
    discard(written)
    pairs = of.where("roots is not null").select(F.explode("roots").alias("a"), F.col("root").alias("b")).where("a <> b")
    pairs = pairs.mapInArrow(_forest, f"id {kind}, root {kind}").where("id <> root")
    e = cut(pairs.select(F.col("id").alias("u"), F.col("root").alias("v")).distinct())
    mark = None
    while True:
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        before, e = e, cut(joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low).where("u <> v").distinct())
        discard(before)
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == mark:
            break
        mark = tuple(now)
    return of, e.select(F.col("u").alias("root"), F.col("v").alias("_top"))
