"""Embedding near-dedup: epsilon grid order join.

Vectors of unit length with cosine >= t lie within eps = sqrt(2 - 2t). They are turned to their principal
dimensions, sorted by the grid cells of the leading ones, and cut into a sequence of blocks. Two blocks are joined
only if the boxes around their leading coordinates come within eps; inside, both intervals are halved recursively
and distant halves skipped. What is left is compared by a bound from half of the dimensions first and in double
precision last, on the vectors as they are. Turning is a rotation, so bounds on turned vectors hold but for rounding, for
which they leave room.

Equal vectors are one class, compared once and counted as often as it has members. A pair of blocks returns the number
of links of each class and a spanning forest of the links, at most one row a class each, however many links there are.
The driver holds the boxes of the blocks (200 bytes for up to 16,384 vectors).

Pairs of blocks can be many times the vectors, so their vectors are never shuffled: a round broadcasts SENT bytes of blocks
at most (or one block) and every task meets them with the blocks that it reads from the table.
"""

from __future__ import annotations

import bisect
import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, discard, scratch, settings, table

#: Coordinates in the sort key and the boxes.
LEADING = 8
LEAF = 512
#: Bytes of vectors that a round broadcasts.
SENT = 32 << 20


def _unit(x: np.ndarray) -> np.ndarray | None:
    """The vector at unit length in double precision; None if it has no direction."""
    x = x.astype(np.float64)
    if not np.isfinite(x).all() or not x.any():
        return None
    with np.errstate(over="ignore"):
        norm = np.sqrt(np.dot(x, x))
    if not (np.isfinite(norm) and norm > 1e-100):  # scaled first, so that squares neither overflow nor vanish
        x = x / np.abs(x).max()
        norm = np.sqrt(np.dot(x, x))
    return x / norm


def _valid(batch: pa.RecordBatch) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(id, vector as it is, vector at unit length) of the rows that can link."""
    out = []
    for i, v in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
        v = v.values if v.is_valid else None
        if i is None or v is None or not len(v) or v.null_count:
            continue
        x = v.to_numpy(zero_copy_only=False)
        if (y := _unit(x)) is not None:
            out.append((i, x, y))
    return out


def _moments(batches):
    """Sums of products of the task's vectors, by dimension."""
    sums: dict[int, np.ndarray] = {}
    for b in batches:
        for _, _, x in _valid(b):
            if len(x) not in sums:
                sums[len(x)] = np.zeros((len(x), len(x)))
            sums[len(x)] += np.outer(x, x)
    for d, s in sums.items():
        yield pa.record_batch([pa.array([d] * d, pa.int32()), pa.array(range(d), pa.int32()), pa.array(list(s), pa.list_(pa.float64()))], ["d", "i", "s"])


def _turned(axes_b):
    """id, dimension, grid cells, bytes and key (of the bytes) of the vectors that can link."""

    def run(batches):
        axes = axes_b.value
        for b in batches:
            rows = _valid(b)
            raw = [(x + 0.0).tobytes() for _, x, _ in rows]  # -0.0 is 0.0
            keys = [int.from_bytes(hashlib.blake2b(v, digest_size=8).digest(), "little", signed=True) for v in raw]
            cells = [[int(np.floor(c)) for c in (axes[len(y)][:, :LEADING].T @ y) * 8] for _, _, y in rows]
            yield pa.record_batch([pa.array([i for i, _, _ in rows], pa.int64()), pa.array([len(y) for _, _, y in rows], pa.int32()), pa.array(cells, pa.list_(pa.int32())), pa.array(raw, pa.binary()), pa.array(keys, pa.int64())], ["id", "d", "cells", "v", "key"])

    return run


def _load(data, d: int, kind: str, axes: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors of a block: at unit length and turned to the principal dimensions; as they are, and their lengths."""
    raw = np.frombuffer(data, kind).reshape(-1, d)
    x = raw.astype(np.float64)
    with np.errstate(over="ignore"):
        norms = np.sqrt(np.einsum("ij,ij->i", x, x))
    for i in np.flatnonzero(~(np.isfinite(norms) & (norms > 1e-100) & (norms < 1e100))):
        x[i], norms[i] = _unit(raw[i]), 1.0
    return (x / norms[:, None]) @ axes[d], x, norms


def _blocks(size: int, kind: str, axes_b):
    """Cuts the sorted rows of a partition into blocks of one dimension and at most `size` vectors.

    ids holds the key and the number of members of each."""

    def block(part, k, d, ids, data):
        x = _load(b"".join(data), d, kind, axes_b.value)[0][:, :LEADING]
        return (part, k, d, np.array(ids, np.int64).tobytes(), b"".join(data), x.min(0).tolist(), x.max(0).tolist())

    def run(batches):
        from pyspark import TaskContext

        part, k, d, ids, data = TaskContext.get().partitionId(), 0, None, [], []
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.float64()), pa.list_(pa.float64())]

        def out(row):
            return pa.record_batch([pa.array([x], t) for x, t in zip(row, kinds, strict=True)], ["part", "k", "d", "ids", "data", "lo", "hi"])

        for b in batches:
            for i, dim, v, times in zip(*(b.column(c).to_pylist() for c in ("key", "d", "v", "times")), strict=True):
                if ids and (dim != d or len(ids) >= size):
                    yield out(block(part, k, d, ids, data))
                    k, ids, data = k + 1, [], []
                d = dim
                ids.append((i, times))
                data.append(v)
        if ids:
            yield out(block(part, k, d, ids, data))

    return run


def _gap(lo_a, hi_a, lo_b, hi_b) -> np.ndarray:
    """Least squared distance of boxes."""
    g = np.maximum(0, np.maximum(lo_a - hi_b, lo_b - hi_a))
    return (g * g).sum(-1)


def _joined(eps2: float, cosine: float, kind: str, axes_b):
    """Links inside and between the two blocks of each row."""

    def links(one: tuple, two: tuple, same: bool) -> tuple[np.ndarray, np.ndarray]:
        (a, raw_a, norms_a), (b, raw_b, norms_b) = one, two
        found: list[tuple[np.ndarray, np.ndarray]] = []
        half = max(1, a.shape[1] // 2)

        def short(x):
            rest = np.sqrt(np.maximum(0, 1 - (x[:, :half] ** 2).sum(1)))
            return np.hstack([x[:, :half], rest[:, None]]).astype(np.float32)

        sa, sb = short(a), short(b)

        def join(a0, a1, b0, b1):
            if same and b1 <= a0:
                return
            x, y = a[a0:a1, :LEADING], b[b0:b1, :LEADING]
            if _gap(x.min(0), x.max(0), y.min(0), y.max(0)) > eps2 + 1e-9:
                return
            if a1 - a0 <= LEAF and b1 - b0 <= LEAF:
                # The leading half of the products and the lengths of the rest bound the cosine from above.
                i, j = np.nonzero(sa[a0:a1] @ sb[b0:b1].T >= cosine - 1e-4)
                i, j = i + a0, j + b0
                if same:
                    i, j = i[i < j], j[i < j]
                for at in range(0, len(i), 65536):
                    p, q = i[at : at + 65536], j[at : at + 65536]
                    ok = np.einsum("ij,ij->i", raw_a[p], raw_b[q]) / (norms_a[p] * norms_b[q]) >= cosine
                    found.append((p[ok], q[ok]))
                return
            ma, mb = ((a0 + a1) // 2, (b0 + b1) // 2)
            for u in [(a0, ma), (ma, a1)] if a1 - a0 > LEAF else [(a0, a1)]:
                for w in [(b0, mb), (mb, b1)] if b1 - b0 > LEAF else [(b0, b1)]:
                    join(*u, *w)

        join(0, len(a), 0, len(b))
        return tuple(np.concatenate(x) if found else np.empty(0, np.int64) for x in (zip(*found, strict=True) if found else ((), ())))

    def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        label = np.arange(n)
        while True:
            low = np.minimum(label[i], label[j])
            before = label.copy()
            np.minimum.at(label, i, low)
            np.minimum.at(label, j, low)
            label = label[label]
            if (label == before).all():
                return label

    def run(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                ids, data, ids2, data2, d = (batch.column(c)[r] for c in ("ids", "data", "ids2", "data2", "d"))
                same = not ids2.is_valid
                ids, times = np.frombuffer(ids.as_buffer(), np.int64).reshape(-1, 2).T
                other, times2 = (ids, times) if same else np.frombuffer(ids2.as_buffer(), np.int64).reshape(-1, 2).T
                a = _load(data.as_buffer(), d.as_py(), kind, axes_b.value)
                b = a if same else _load(data2.as_buffer(), d.as_py(), kind, axes_b.value)
                i, j = links(a, b, same)
                if not len(i):
                    continue
                if not same:
                    ids, times, j = np.concatenate([ids, other]), np.concatenate([times, times2]), j + len(ids)
                count = np.zeros(len(ids), np.int64)
                np.add.at(count, i, times[j])
                np.add.at(count, j, times[i])
                label = forest(len(ids), i, j)
                at = np.flatnonzero(count)
                yield pa.record_batch([pa.array(ids[at]), pa.array(count[at]), pa.array(ids[label[at]])], ["id", "n", "root"])

    return run


def _near(meta_b, eps2: float):
    """Of each block, the blocks at or after it in the sequence that may hold a neighbour: halves the sequence recursively."""

    def run(batches):
        lo, hi, d, keys = meta_b.value
        bounds = {}

        def box(x, y):
            if (x, y) not in bounds:
                bounds[x, y] = (lo[x:y].min(0), hi[x:y].max(0))
            return bounds[x, y]

        def search(i, x, y, out):
            if y <= i or _gap(lo[i], hi[i], *box(x, y)) > eps2 + 1e-9:
                return
            if y - x == 1:
                if d[x] == d[i]:
                    out.append(x)
                return
            search(i, x, (x + y) // 2, out)
            search(i, (x + y) // 2, y, out)

        for batch in batches:
            a, b = [], []
            for p, k in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                i, out = bisect.bisect_left(keys, (p, k)), []
                search(i, 0, len(keys), out)
                a += [i] * len(out)
                b += out
            cols = [[keys[x][0] for x in a], [keys[x][1] for x in a], [keys[x][0] for x in b], [keys[x][1] for x in b]]
            yield pa.record_batch([pa.array(c, pa.int32()) for c in cols], ["part", "k", "part2", "k2"])

    return run


def _rounds(sizes: list[int]) -> list[tuple[int, int]]:
    """Cuts the sequence of blocks into ranges of at most SENT bytes, or of one block."""
    out, start, held = [], 0, 0
    for i, n in enumerate(sizes):
        if i > start and held + n > SENT:
            out.append((start, i))
            start, held = i, 0
        held += n
    return [*out, (start, len(sizes))] if sizes else []


def near_duplicates(embeddings: DataFrame, cosine: float = 0.9, block: int | None = None) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of embeddings(vec_id, embedding).

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing, nor do vectors of
    different dimensions or without an id. Rows that repeat an id are vectors of their own: each counts as a link
    of the other if close, and both report the id's sum and the smaller of their components. An empty table gives no rows.
    Other columns are not read.
    """
    spark, eps2 = embeddings.sparkSession, 2 - 2 * cosine
    single = embeddings.schema["embedding"].dataType.simpleString() == "array<float>"
    kind, cast = ("<f4", "array<float>") if single else ("<f8", "array<double>")
    rows = embeddings.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast(cast).alias("v"))
    # One d x d table for each dimension that occurs, whatever the number of vectors.
    sums = rows.mapInArrow(_moments, "d int, i int, s array<double>").select("d", "i", F.posexplode("s").alias("j", "x")).groupBy("d", "i", "j").agg(F.sum("x").alias("x"))
    moments: dict[int, np.ndarray] = {}
    for r in sums.collect():
        moments.setdefault(r["d"], np.zeros((r["d"], r["d"])))[r["i"], r["j"]] = r["x"]
    axes = {d: np.linalg.eigh((m + m.T) / 2)[1][:, ::-1].copy() for d, m in moments.items()}
    axes_b = spark.sparkContext.broadcast(axes)
    with scratch() as cut:
        turned = cut(rows.mapInArrow(_turned(axes_b), "id long, d int, cells array<int>, v binary, key long"))
        classes = cut(turned.groupBy("key", "d", "v").agg(F.first("cells").alias("cells"), F.min("id").alias("rep"), F.count(F.lit(1)).alias("times")))
        ids = cut(turned.select("id", "key"))
        discard(turned)
        n = classes.count()
        # Blocks grow with the input, so that their number, of which the driver holds the boxes, stays small.
        size = block or int(min(16384, max(1024, n // 2048)))
        ordered = classes.repartitionByRange(max(1, -(-n // (4 * size))), "d", "cells", "key").sortWithinPartitions("d", "cells", "key")
        blocks = cut(ordered.select("key", "d", "v", "times").mapInArrow(_blocks(size, kind, axes_b), "part int, k int, d int, ids binary, data binary, lo array<double>, hi array<double>"))
        slim = cut(classes.select("key", "rep", "times"))
        discard(classes)
        meta = sorted((r["part"], r["k"], r["d"], r["lo"], r["hi"], r["n"]) for r in blocks.select("part", "k", "d", "lo", "hi", F.length("data").alias("n")).collect())
        wide = lambda x: np.array([v + [0.0] * (LEADING - len(v)) for v in x]).reshape(-1, LEADING)
        meta_b = spark.sparkContext.broadcast((wide([m[3] for m in meta]), wide([m[4] for m in meta]), [m[2] for m in meta], [m[:2] for m in meta]))
        pairs = cut(blocks.select("part", "k").repartition(max(1, min(64, len(meta)))).mapInArrow(_near(meta_b, eps2), "part int, k int, part2 int, k2 int"))
        two = blocks.select(F.col("part").alias("part2"), F.col("k").alias("k2"), F.col("ids").alias("ids2"), F.col("data").alias("data2"))
        twin = (F.col("part") == F.col("part2")) & (F.col("k") == F.col("k2"))
        # One file of blocks a task: blocks come after those they meet, so the last ones have most to do.
        file = 4 * max((m[5] for m in meta), default=0)
        links = []
        for first, end in _rounds([m[5] for m in meta]):
            at, (a, b) = F.struct("part", "k"), (F.struct(*map(F.lit, meta[i][:2])) for i in (first, end - 1))
            one = F.broadcast(blocks.where(at.between(a, b)).select("part", "k", "d", "ids", "data"))
            both = two.join(F.broadcast(pairs.where(at.between(a, b))), ["part2", "k2"]).join(one, ["part", "k"])
            both = both.select("d", "ids", "data", F.when(~twin, F.col("ids2")).alias("ids2"), F.when(~twin, F.col("data2")).alias("data2"))
            with settings(spark, spark__sql__files__maxPartitionBytes=str(max(4 << 20, file))):
                links.append(cut(both.mapInArrow(_joined(eps2, cosine, kind, axes_b), "id long, n long, root long"), batch=4))  # rows of megabytes
        found = reduce(DataFrame.union, links) if links else spark.createDataFrame([], "id long, n long, root long")
        discard(blocks, pairs)
        counts = found.groupBy("id").agg(F.sum("n").alias("n"))
        comps = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
        least = comps.join(slim, comps["id"] == slim["key"]).groupBy("component").agg(F.min("rep").alias("least"))
        joined = comps.join(least, "component").join(counts, "id", "left").select("id", "least", "n")
        of = slim.join(joined, F.col("key") == F.col("id"), "left")
        of = of.select("key", (F.coalesce("n", F.lit(0)) + F.col("times") - 1).alias("n"), F.coalesce("least", "rep").alias("least"))
        # An id that repeats reports the sum of its vectors, and the smallest component.
        own = ids.join(of, "key").groupBy("id").agg(F.sum("n").alias("n"), F.min("least").alias("component")).select(F.col("id").alias("_i"), "n", "component")
        out = rows.select(F.col("id").alias("vec_id")).join(own, F.col("vec_id") == F.col("_i"), "left")
        comp = F.coalesce("component", "vec_id")
        return cut.keep(cut(out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), comp.alias("component_id"), F.coalesce(comp == F.col("vec_id"), F.lit(True)).alias("kept"))))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
