"""Sharding by balanced label propagation.

Documents with equal texts are linked. State is the number of documents of a group in a shard, so a group of any
size is at most `shards` rows. In each round a group's parts want to move to the shard that holds most of the group,
full or not; what may move is bound by what moves back, also in cycles of shards, by the room left, and by whole groups
that give way. Spark hands those quotas out along a hash order, until none is left. Documents without links then fill the shards up, so that counts are
at most one apart (law `rows`).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, numbered, table


def _case(column: str, values: list[int]):
    out = F.lit(0)
    for s, v in enumerate(values):
        out = F.when(F.col(column) == s, v).otherwise(out)
    return out.cast("long")


def _sizes(state: DataFrame, shards: int) -> list[int]:
    got = {r["s"]: r["n"] for r in state.groupBy("s").agg(F.sum("c").alias("n")).collect()}  # a row a shard
    return [got.get(s, 0) for s in range(shards)]


def _quotas(wanted: dict, free: list[int]) -> dict:
    """How much of wanted[s, t] may move so that no shard grows beyond its room: cycles first, then room, also what chains free."""
    left, quota, free = dict(wanted), dict.fromkeys(wanted, 0), list(free)

    def push(edges, n):
        for e in edges:
            left[e] -= n
            quota[e] += n

    def cycle(start):
        back, queue = {}, [start]  # breadth first, so the shortest
        for s in queue:
            for e in sorted(left):
                if e[0] == s and left[e] and e[1] not in back:
                    back[e[1]] = s
                    queue.append(e[1])
        if start not in back:
            return None
        edges = [(back[start], start)]
        while edges[-1][0] != start:
            edges.append((back[edges[-1][0]], edges[-1][0]))
        return edges

    for start in range(len(free)):
        while edges := cycle(start):
            push(edges, min(left[e] for e in edges))
    while go := [e for e in sorted(left, key=lambda e: (-left[e], e)) if left[e] and free[e[1]] > 0]:
        s, t = go[0]
        n = min(left[s, t], free[t])
        push([(s, t)], n)
        free[t] -= n
        free[s] += n
    return quota


def _wishes(state: DataFrame, targets: DataFrame) -> DataFrame:
    best = targets.groupBy("g").agg(F.max(F.struct("c", (-F.col("s")).alias("m"))).alias("b")).select("g", F.col("b.c").alias("bc"), (-F.col("b.m")).alias("t"))
    wish = state.join(best, "g").where((F.col("s") != F.col("t")) & ((F.col("c") < F.col("bc")) | ((F.col("c") == F.col("bc")) & (F.col("s") > F.col("t")))))
    return cut(wish.select("g", "s", "t", "c", F.md5(F.concat_ws("|", "g", "s")).alias("k")))


def _flows(wish: DataFrame) -> dict:
    return {(r["s"], r["t"]): r["n"] for r in wish.groupBy("s", "t").agg(F.sum("c").alias("n")).collect()}  # a row a pair of shards


def _exchanged(state: DataFrame, unmet: dict) -> DataFrame:
    """g, s, t, c of groups that are together in a full shard and give way, whole, to what wants to come: no edge is cut."""
    whole = state.groupBy("g").agg(F.count(F.lit(1)).alias("parts"), F.first("s").alias("s"), F.sum("c").alias("c")).where("parts = 1")
    most = {t: max(n for e, n in unmet.items() if e[1] == t) for t in {e[1] for e in unmet}}
    small = F.lit(False)
    for t, n in most.items():
        small = small | ((F.col("s") == t) & (F.col("c") <= n))
    ranked = numbered(cut(whole.where(small).select("g", "s", "c", F.md5("g").alias("k"))), ["s"], "k", "_before", weight="c")
    to, at = F.lit(None).cast("int"), dict.fromkeys(most, 0)
    for (s, t), n in sorted(unmet.items(), key=lambda x: (-x[1], x[0])):
        here = (F.col("s") == t) & (F.col("_before") >= at[t]) & (F.col("_before") + F.col("c") <= at[t] + n)
        to, at[t] = F.when(here, s).otherwise(to), at[t] + n
    return cut(ranked.withColumn("t", to).where("t is not null").select("g", "s", "t", "c"))


def propagate(state: DataFrame, shards: int, room: int) -> DataFrame:
    """Moves the parts of state(g, s, c) until no quota is left; no shard grows beyond `room`.

    Every move takes a part to one that is no smaller, or a whole group, so the links inside shards only grow and the
    rounds end.
    """
    while True:
        sizes = _sizes(state, shards)
        free = [room - z for z in sizes]
        wish = _wishes(state, state.where(F.col("c") < room))
        wanted = _flows(wish)
        quota = _quotas(wanted, free)
        unmet = {e: n - quota[e] for e, n in wanted.items() if n > quota[e]}
        given_way = None
        if unmet:
            given_way = _exchanged(state, unmet)
            for (t, s), n in _flows(given_way).items():
                quota[s, t] += n
        if not any(quota.values()):  # nothing can come to the best shards: the best of those with room
            wish = _wishes(state, state.where(F.col("s").isin([s for s in range(shards) if free[s] > 0] or [-1])))
            quota, given_way = _quotas(_flows(wish), free), None
        if not any(quota.values()):
            return state
        given = F.lit(0)
        for (s, t), q in quota.items():
            given = F.when((F.col("s") == s) & (F.col("t") == t), q).otherwise(given)
        ranked = numbered(wish, ["s", "t"], "k", "_before", weight="c")
        moved = ranked.withColumn("a", F.greatest(F.lit(0), F.least(F.col("c"), given - F.col("_before")))).where("a > 0").select("g", "s", "t", "a")
        if given_way is not None:
            moved = moved.union(given_way)
        change = moved.select("g", "s", (-F.col("a")).alias("c")).union(moved.select("g", F.col("t").alias("s"), F.col("a").alias("c")))
        state = cut(state.select("g", "s", "c").union(change).groupBy("g", "s").agg(F.sum("c").alias("c")).where("c > 0"))


def shard(documents: DataFrame, shards: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row of documents(doc_id, text).

    Null and empty texts have size 1 and are equal. Rows that repeat an id are documents of their own. Shards differ by
    one row at most; groups stay together as far as the quotas let them move. Other columns are not read.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.md5(text).alias("g"))
    docs = cut(docs.withColumn("k", F.md5(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "g"))))
    total = docs.count()
    goal = [total // shards + (s < total % shards) for s in range(shards)]
    groups = cut(docs.groupBy("g").agg(F.count(F.lit(1)).alias("n")))
    linked = docs.join(groups.where("n > 1").select("g"), "g")
    start = F.pmod(F.xxhash64("k"), F.lit(shards)).cast("int").alias("s")
    state = propagate(cut(linked.groupBy("g", start).agg(F.count(F.lit(1)).alias("c"))), shards, min(goal))

    upto = Window.partitionBy("g").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    parts = state.withColumn("lo", F.coalesce(F.sum("c").over(upto), F.lit(0))).withColumn("hi", F.col("lo") + F.col("c")).select("g", "s", "lo", "hi")
    ranked = numbered(cut(linked), ["g"], "k", "r").alias("l")
    placed = cut(ranked.join(parts.alias("p"), (F.col("l.g") == F.col("p.g")) & (F.col("r") >= F.col("lo")) & (F.col("r") < F.col("hi"))).select("doc_id", "size", "text_crc32", "k", "s"))
    over = [max(0, z - t) for z, t in zip(_sizes(placed.withColumn("c", F.lit(1)), shards), goal, strict=True)]
    spare = docs.join(groups.where("n = 1").select("g"), "g").select("doc_id", "size", "text_crc32", "k")
    if any(over):  # groups that filled a shard beyond its goal give some documents back
        placed = cut(numbered(placed, ["s"], "k", "r2"))
        spare = spare.union(placed.where(F.col("r2") < _case("s", over)).select("doc_id", "size", "text_crc32", "k"))
        placed = placed.where(F.col("r2") >= _case("s", over)).drop("r2")
    need, at, dest = [t - z for t, z in zip(goal, _sizes(placed.withColumn("c", F.lit(1)), shards), strict=True)], 0, F.lit(shards - 1)
    ends = []
    for n in need:
        at += n
        ends.append(at)
    for s in reversed(range(shards)):
        dest = F.when(F.col("r3") < ends[s], s).otherwise(dest)
    free = numbered(cut(spare.withColumn("one", F.lit(1))), ["one"], "k", "r3").select("doc_id", "size", "text_crc32", "k", dest.cast("int").alias("s"))
    out = numbered(cut(placed.select("doc_id", "size", "text_crc32", "k", "s").union(free)), ["s"], "k", "slot")
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("s").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))
