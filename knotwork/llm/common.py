"""Shared pieces of the training-data operators: tables, cut points, word hashes, ranks, components."""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.components import components
from ..sources.tables import cut, discard, scratch, settings, shared_dir, table

__all__ = ["SPACES", "bounded_batches", "components", "cut", "discard", "mix64", "n_words", "numbered", "rowed", "scratch", "settings", "shared_dir", "shingles", "table", "tidied"]

#: White space of the word rule `[^\x20\x09-\x0D]+`; bytes.split() splits at exactly these.
SPACES = " \t\n\x0b\x0c\r"


def bounded_batches(spark: SparkSession, rows: int = 1000) -> None:
    """No more rows in an Arrow batch than this: whole texts can be long."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def tidied(run):
    """run over Arrow batches, after which the Python worker, which Spark keeps for other tasks, gives freed memory back."""

    def whole(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc only
        if trim:
            trim(0)

    return whole


def rowed(df: DataFrame, **columns: Column) -> DataFrame:
    """The rows of df as one struct column `row`, beside `columns` over df: names of df's own can't clash with later ones.
    `select("row.*")` brings df's columns back."""
    return df.select(F.struct(*(df[f"`{c}`"] for c in df.columns)).alias("row"), *(c.alias(name) for name, c in columns.items()))


# --- words ------------------------------------------------------------------------------------

_MIX = np.random.default_rng(20240501).integers(1, 2**63, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        size = 1 << (n - 1).bit_length()
        for i, base in enumerate((_BASE, _INVERSE)):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _POWERS[i] = np.multiply.accumulate(x)
    return _POWERS[0], _POWERS[1]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective mixer on unsigned 64-bit words."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, words: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a whole text (A-Z lower-cased).

    With fewer words the whole sequence is the one shingle; without words the set is empty.
    A shingle's hash is a polynomial over its bytes, taken from running sums over the text.
    """
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.empty(0, np.uint64)
    flat = np.frombuffer(b" ".join(parts), np.uint8)
    up, down = _powers(len(flat) + 1)
    sums = np.zeros(len(flat) + 1, np.uint64)
    np.cumsum(_MIX[flat] * up[: len(flat)], out=sums[1:])
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(words, len(parts))
    first, last = starts[: len(parts) - k + 1], ends[k - 1 :]
    return np.unique(mix64((sums[last] - sums[first]) * down[first] + (last - first).astype(np.uint64)))


def n_words(text: Column) -> Column:
    """Number of words of a text, on the JVM."""
    trimmed = F.trim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, r"[\x20\x09-\x0D]+"))).cast("long")


# --- ranks and running sums over groups of any size ---------------------------------------------


def numbered(df: DataFrame, keys: list[str], order: str, out: str = "rank", per: int = 4000, weight: str | None = None) -> DataFrame:
    """Adds the 0-based place of each row within its key, by the hexadecimal string column `order`.

    With `weight`, a long column, it is the sum of the weights before the row. A key's rows are dealt into buckets
    of about `per` rows by the first digits of `order`, summed, and only then ranked inside their bucket, so no
    task holds a whole key. `df` must not change when it is computed twice: pass a table that cut() has written.
    """
    same = lambda names: [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in names]
    w = F.col(weight) if weight else F.lit(1)
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    part = (F.conv(F.substring(order, 1, 7), 16, 10).cast("long") * F.ceil(F.col("_n") / per) / (1 << 28)).cast("long")
    dealt = df.alias("l").join(sizes.alias("r"), same(keys)).select("l.*", "_n").withColumn("_b", part).drop("_n")
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy(*keys, "_b").agg(F.sum(w).alias("_c"))
    starts = counts.withColumn("_s", F.coalesce(F.sum("_c").over(before), F.lit(0))).drop("_c")
    above = Window.partitionBy(*keys, "_b").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    inside = dealt.withColumn("_i", F.coalesce(F.sum(w).over(above), F.lit(0)))
    joined = inside.alias("l").join(starts.alias("r"), same([*keys, "_b"]))
    return joined.select("l.*", (F.col("_s") + F.col("_i")).alias(out)).drop("_b", "_i")
