"""Document fingerprints: one-permutation MinHash with optimal densification and packed low-order bits.

Native: DataFrame expressions only. Each 5-word shingle is hashed once; its top bits choose one of BINS bins and
the smallest hash in a bin is the bin's value. An empty bin takes the value of the first non-empty bin in a
pseudo-random sequence of its own. The low 4 bits of each bin are kept, 16 bins to a long. Two bins agree by
chance in 1 of 16 cases, which the likeness corrects for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACES, cut, table

BINS, BITS, TRIES = 256, 4, 32
_LOW = (1 << 56) - 1
_LONGS = BINS * BITS // 64


def with_fingerprint(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds out, array<long> of _LONGS elements (empty array: no words), the fingerprint of the string column `text`.

    Steps are columns of their own, each of which later steps read more than once, so that none is computed twice.
    """
    df = df.withColumn("_w", F.split(F.trim(F.lower(text), F.lit(SPACES)), r"[\x20\x09-\x0D]+"))
    df = df.withColumn("_h", F.transform("_w", lambda w: F.xxhash64(w)))
    n, five = F.size("_h"), [lambda i, j=j: F.get("_h", i + j) for j in range(5)]
    every = F.transform(F.sequence(F.lit(0), n - 5), lambda i: F.xxhash64(*(f(i) for f in five)))
    df = df.withColumn("_s", F.when(n >= 5, every).otherwise(F.array(F.xxhash64(F.array_join("_w", " ")))))
    tops = F.lit([((b - BINS // 2) << 56) | _LOW for b in range(BINS)]).cast("array<bigint>")
    df = df.withColumn("_s", F.sort_array(F.concat("_s", tops)))
    # The first value of each bin; the bin's own top value stands for an empty bin.
    bin_ = lambda x: F.shiftright(x, 56)
    df = df.withColumn("_s", F.filter("_s", lambda x, i: (i == 0) | (bin_(x) != bin_(F.get("_s", i - 1)))))
    df = df.withColumn("_s", F.transform("_s", lambda x: F.when(x.bitwiseAND(F.lit(_LOW)) != _LOW, x)))

    def filled(v: Column, b: Column) -> Column:
        tries = [F.get("_s", F.xxhash64(b, F.lit(a)).bitwiseAND(F.lit(BINS - 1)).cast("int")) for a in range(TRIES)]
        walk = F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda j: F.get("_s", (b * 7 + 3 + j * (2 * b + 1)) % BINS))
        return F.coalesce(v, *tries, F.get(F.filter(walk, lambda x: x.isNotNull()), F.lit(0)))

    # Mixed with the bin's number, so that bins filled from one value don't agree by chance all at once.
    df = df.withColumn("_s", F.transform("_s", lambda v, b: F.xxhash64(filled(v, b), b)))
    per = BINS // _LONGS
    packed = [F.aggregate(F.slice("_s", i * per + 1, per), F.lit(0).cast("long"), lambda s, x: F.shiftleft(s, BITS).bitwiseOR(x.bitwiseAND(F.lit((1 << BITS) - 1)))) for i in range(_LONGS)]
    empty = F.get("_w", F.lit(0)) == ""
    return df.withColumn(out, F.when(empty, F.array().cast("array<bigint>")).otherwise(F.array(*packed))).drop("_w", "_h", "_s")


def likeness(a: Column, b: Column) -> Column:
    """Bias-corrected share of equal bins, 0 to 1; two texts without words are alike, one is like none with words."""
    ones = F.lit(0x1111111111111111).cast("long")

    def differing(x: Column) -> Column:
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        return F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(ones)).cast("int")

    apart = F.aggregate(F.zip_with(a, b, lambda x, y: differing(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    chance = 1.0 / (1 << BITS)
    share = (1 - apart / F.lit(float(BINS)) - chance) / (1 - chance)
    none = (F.size(a) == 0) | (F.size(b) == 0)
    return F.when(none, F.when(F.size(a) == F.size(b), 1.0).otherwise(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)))


def text_of(longs: Column) -> Column:
    return F.array_join(F.transform(longs, lambda x: F.lpad(F.hex(x), 16, "0")), "")


def with_next(documents: DataFrame, segments: int = 64) -> DataFrame:
    """documents(doc_id, text) with next_text and next_fp of the row that follows by doc_id; the first follows the last.

    Ids are cut into ranges of about even row counts (quantiles, then evenly inside). Each range also gets the first
    row of the next one, so that one shuffle by range is enough.
    """
    spark = documents.sparkSession
    rows, marks = documents.agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("doc_id", [i / segments for i in range(segments + 1)], 10000).alias("q")).first()
    q = sorted(set(marks or [0]))
    wanted = max(1, min(rows // 500, 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    each = max(1, wanted // len(q))
    seg = F.greatest(F.lit(1), F.size(F.filter(F.lit(q).cast("array<bigint>"), lambda x: x <= F.col("doc_id"))))
    at = lambda xs: F.element_at(F.lit(xs).cast("array<bigint>"), seg)
    inside = F.floor((F.col("doc_id") - at(q)) * each / (at([*q[1:], q[-1] + 1]) - at(q)))
    pid = F.when(F.col("doc_id").isNull(), -1).otherwise((seg - 1) * each + F.least(F.greatest(inside, F.lit(0)), F.lit(each - 1)))
    docs = documents.withColumn("_o", F.xxhash64("text")).withColumn("_p", pid.cast("long"))
    first = docs.groupBy("_p").agg(F.min(F.struct(F.coalesce("doc_id", F.lit(-(2**63))).alias("i"), "_o")).alias("f"))
    order = Window.orderBy("_p")  # one row a range
    heads = first.withColumn("_t", F.coalesce(F.lag("_p").over(order), F.max("_p").over(Window.partitionBy()))).select("_p", "f", "_t")
    heads = cut(heads)
    found = docs.join(heads, "_p").where((F.coalesce("doc_id", F.lit(-(2**63))) == F.col("f.i")) & (F.col("_o") == F.col("f._o")))
    extra = found.select("doc_id", "text", "_o", F.col("_t").alias("_p")).dropDuplicates(["_p"]).withColumn("_x", F.lit(1))
    every = docs.select("doc_id", "text", "_o", "_p", F.lit(0).alias("_x")).unionByName(extra)
    every = with_fingerprint(every, "text", "fp")
    follow = Window.partitionBy("_p").orderBy("_x", F.col("doc_id").asc_nulls_first(), "_o")
    every = every.withColumn("next_text", F.lead("text").over(follow)).withColumn("next_fp", F.lead("fp").over(follow))
    return every.where("_x = 0").select("doc_id", "text", "fp", "next_text", "next_fp")


def fingerprints(documents: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row of documents.

    A null text is empty. A text without words has the empty fingerprint. Rows that repeat an id follow each other
    by a hash of the text; null ids come first. A single row is its own next. Other columns are not read.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    df = with_next(docs).withColumn("n_chars", F.length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.expr("substring(text, 1, cast(n_chars - floor(n_chars / 2) as int))"), F.substring("next_text", F.lit(1), half))
    df = df.withColumn("edited", edited).drop("text", "next_text")
    df = df.withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256))
    df = with_fingerprint(df, "edited", "efp")
    return df.select("doc_id", "n_chars", "edited_sha256", text_of(F.col("fp")).alias("fingerprint"), text_of(F.col("efp")).alias("edited_fingerprint"), likeness(F.col("fp"), F.col("efp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
