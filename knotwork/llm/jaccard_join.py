"""N-gram Jaccard join: rare-first prefixes with length, positional and suffix filters.

Documents link when 100 * |A & B| >= 100 * threshold * |A | B| over their sets of 5-word shingles.

1.  One scan makes each document's set signature and counts its shingles in hashed counters. Their ranks order all
    shingles from rare to frequent. Any order gives exact results; this one keeps shared passages out of the prefixes.
2.  Documents with equal sets form a class; only classes are joined.
3.  Each class posts the shingles of its prefix with size and position, sorted by shingle. A shingle of one class ends
    there; one of up to FEW classes gives its pairs at once, so pairs grow with the postings; the rest are frequent.
    Of a frequent shingle one class is the pivot, and every other class meets the pivot only.
4.  Pairs that pass the length, positional and suffix filters are candidates. Each class is compared with its nearest
    candidate first, over whole sets, and links make components. Candidates inside one component are settled.
5.  Frequent shingles whose classes are in several components get other pivots, and at last give all their pairs between
    components. No pair is compared twice, and no link that could join two components is left out.

Shingles and sets are told apart by 64 and 128 bits of a hash; of 2**64 pairs of different shingles one is taken for equal.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, components, mix64, scratch, shingles, table, tidied

#: Hashed counters, summed in SLICES parts: a fixed size, whatever the input.
COUNTERS_LOG2, SLICES = 18, 64
COUNTERS = 1 << COUNTERS_LOG2
#: Bits of a set's parity bitmap.
BITMAP = 1024
#: A frequent shingle's postings are dealt over so many tasks.
SALTS = 64
#: Shingles of so many classes give all of their pairs.
FEW = 8
#: Rows of an Arrow batch of postings.
ROWS = 1 << 16


def _class_of(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _key(sig: bytes | None) -> int | None:
    return sig and int.from_bytes(sig[:8], "little", signed=True)


def _bitmap(s: np.ndarray) -> np.ndarray:
    """One bit a bucket of shingles: whether it holds an odd number of them. The bits in which two sets differ are
    no more than the shingles in which they differ."""
    odd = np.bincount((mix64(s) >> np.uint64(54)).astype(np.int64), minlength=BITMAP) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _scan(words: int):
    """doc_id, th, n, sig, cls (the key of sig in the postings), bits of each row; SLICES more rows per task hold its counters."""
    names = ["doc_id", "th", "n", "sig", "cls", "bits", "slice", "counts"]

    def run(batches):
        counts, lows, held = np.zeros(COUNTERS, np.int64), [np.empty(0, np.int32)], 0
        for b in batches:
            ns, sigs, bits = [], [], []
            for text in b.column(2).to_pylist():
                s = shingles(text, words)
                lows.append((s & np.uint64(COUNTERS - 1)).astype(np.int32))
                if (held := held + len(s)) > 1 << 22:
                    counts += np.bincount(np.concatenate(lows), minlength=COUNTERS)
                    lows, held = [np.empty(0, np.int32)], 0
                ns.append(len(s))
                sigs.append(_class_of(s) if len(s) else None)
                bits.append(_bitmap(s) if len(s) else None)
            n = len(ns)
            yield pa.record_batch([b.column(0), b.column(1), pa.array(ns, pa.int64()), pa.array(sigs, pa.binary()), pa.array([_key(x) for x in sigs], pa.int64()), pa.array(bits, pa.list_(pa.int64())), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names)
        counts += np.bincount(np.concatenate(lows), minlength=COUNTERS)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.list_(pa.int64()))
        parts = [x.astype(np.int64).tobytes() for x in np.split(counts, SLICES)]
        yield pa.record_batch([*(pa.nulls(SLICES, k) for k in kinds), pa.array(range(SLICES), pa.int32()), pa.array(parts, pa.binary())], names)

    return run


def _summed(batches):
    total: dict[int, np.ndarray] = {}
    for b in batches:
        for k, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            total[k] = total.get(k, 0) + np.frombuffer(x, np.int64)
    yield pa.record_batch([pa.array(total, pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["slice", "counts"])


def _prefix(s: np.ndarray, ranks: np.ndarray, percent: int) -> np.ndarray:
    """The prefix of a set from rare to frequent: by the rank of a shingle's counter, then by the shingle's other bits."""
    k = len(s) - -(-percent * len(s) // 100) + 1
    key = ranks[(s & np.uint64(COUNTERS - 1)).astype(np.int64)] << np.uint64(64 - COUNTERS_LOG2) | s >> np.uint64(COUNTERS_LOG2)
    least = np.argpartition(key, k - 1)[:k] if k < len(s) else np.arange(len(s))
    return s[least[np.argsort(key[least])]]


def _postings(counts_b, words: int, percent: int, load: float):
    """token, cls, pack (centrality, size, position), salt of each prefix. Shingles with more than `load` documents, as
    far as the counters tell, are dealt over SALTS parts."""

    def run(batches):
        counts, ranks = counts_b.value
        mean = float(counts.mean())
        seen: set[bytes] = set()
        for b in batches:
            out: list[list[np.ndarray]] = [[np.empty(0, np.int64)] for _ in range(4)]
            for text in b.column(0).to_pylist():
                s = shingles(text, words)
                if not len(s) or (sig := _class_of(s)) in seen:
                    continue
                seen.add(sig)
                order = _prefix(s, ranks, percent)
                k = len(order)
                central = int(min(127, 8 * np.log2(1 + counts[(s & np.uint64(COUNTERS - 1)).astype(np.int64)].mean() / (1 + mean))))
                often = counts[(order & np.uint64(COUNTERS - 1)).astype(np.int64)] - mean
                out[0].append(order.view(np.int64))
                out[1].append(np.full(k, _key(sig)))
                out[2].append((central << 56 | len(s) << 28) + np.arange(k, dtype=np.int64))
                out[3].append(np.where(often > load, 1 + sig[8] % SALTS, 0))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32())
            yield pa.record_batch([pa.array(np.concatenate(x), k) for x, k in zip(out, kinds, strict=True)], ["token", "cls", "pack", "salt"])

    return run


def _may_link(p: np.ndarray, q: np.ndarray, percent: int) -> np.ndarray:
    """Length and positional filter on packed postings of the same shingles."""
    low = (1 << 28) - 1
    n, m, i, j = p >> 28 & low, q >> 28 & low, p & low, q & low
    return (100 * np.minimum(n, m) >= percent * np.maximum(n, m)) & (np.minimum(n - i, m - j) >= -(-percent * (n + m) // (100 + percent)))


def _meetings(percent: int):
    """Of postings sorted by token, salt and cls: pairs (a, b) of the shingles of up to FEW classes, and the postings
    (token, a, pack) of the frequent ones. Holds one batch and at most FEW rows more."""

    def run(batches):
        carry = [np.empty(0, np.int64) for _ in range(4)]
        frequent, last = None, None  # the frequent shingle that the last batch ended in, and its last class

        def step(rows, end):
            nonlocal carry, frequent, last
            t, c, p, s = (np.concatenate(x) for x in zip(carry, rows, strict=True))
            if not len(t):
                return [], []
            new = np.ones(len(t), bool)
            new[1:] = (t[1:] != t[:-1]) | (s[1:] != s[:-1])
            same = np.zeros(len(t), bool)
            same[1:] = ~new[1:] & (c[1:] == c[:-1])
            goes_on = frequent == (t[0], s[0])
            same[0] = goes_on and last == c[0]
            first = np.cumsum(new) - 1 == 0  # rows of the first run, which may have begun before
            t, c, p, s, new, first = (x[~same] for x in (t, c, p, s, new, first))
            if not len(t):
                return [], []
            new[0] = True
            new[1:] = (t[1:] != t[:-1]) | (s[1:] != s[:-1])
            starts = np.flatnonzero(new)
            run_ = np.cumsum(new) - 1
            size = np.diff(np.append(starts, len(t)))[run_]
            often = (size > FEW) | (s > 0) | (first & goes_on)
            open_ = np.zeros(len(t), bool) if end else run_ == run_[-1]
            hold = open_ & ~often
            if not end:
                frequent, last = ((t[-1], s[-1]), c[-1]) if often[-1] else (None, None)
            carry = [x[hold] for x in (t, c, p, s)]
            few, pairs = ~often & ~hold & (size > 1), [np.empty((2, 0), np.int64)]
            for d in range(1, FEW):
                i = np.flatnonzero(few[:-d] & (run_[:-d] == run_[d:])) if d < len(t) else np.empty(0, np.int64)
                i = i[_may_link(p[i], p[i + d], percent)]
                pairs.append(np.stack([c[i], c[i + d]]))
            return np.unique(np.concatenate(pairs, 1), axis=1), (t[often], c[often], p[often])

        def batch(pairs, posts):
            n = len(pairs[0]) if len(pairs) else 0
            a, posts = (pairs[0], pairs[1]) if n else (np.empty(0, np.int64),) * 2, posts or (np.empty(0, np.int64),) * 3
            m = len(posts[0])
            cols = [pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(posts[0])]), pa.array(np.concatenate([a[0], posts[1]])), pa.concat_arrays([pa.array(a[1]), pa.nulls(m, pa.int64())]), pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(posts[2])])]
            return pa.record_batch(cols, ["token", "a", "b", "pack"])

        for b in batches:
            yield batch(*step([b.column(i).to_numpy().astype(np.int64) for i in range(4)], False))
        yield batch(*step([np.empty(0, np.int64)] * 4, True))

    return run


class Bloom:
    """Which ids may be wanted: 12 bits an id and two probes, at most 32 MB; fuller than that it lets more ids by."""

    def __init__(self, n: int, bits: bytes | None = None):
        self.bits = np.zeros(1 << min(25, max(10, (12 * n // 8).bit_length())), np.uint8) if bits is None else np.frombuffer(bits, np.uint8)

    def _at(self, ids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        h = mix64(ids.astype(np.int64).view(np.uint64))
        places = [(h >> np.uint64(s)) & np.uint64(8 * len(self.bits) - 1) for s in (0, 32)]
        return [((p >> np.uint64(3)).astype(np.int64), (1 << (p & np.uint64(7)).astype(np.uint8)).astype(np.uint8)) for p in places]

    def add(self, ids: np.ndarray) -> None:
        for at, bit in self._at(ids):
            np.bitwise_or.at(self.bits, at, bit)

    def may_hold(self, ids: np.ndarray) -> np.ndarray:
        (a, x), (b, y) = self._at(ids)
        return (self.bits[a] & x > 0) & (self.bits[b] & y > 0)


def _bits(n: int):
    def run(batches):
        bloom = Bloom(n)
        for b in batches:
            bloom.add(b.column(0).to_numpy())
        yield pa.record_batch([pa.array([bloom.bits.tobytes()], pa.binary())], ["bits"])

    return run


def _ored(batches):
    total = None
    for b in batches:
        for x in b.column(0).to_pylist():
            x = np.frombuffer(x, np.uint8)
            total = x.copy() if total is None else total | x
    if total is not None:
        yield pa.record_batch([pa.array([total.tobytes()], pa.binary())], ["bits"])


def _filter_of(ids: DataFrame, n: int):
    """The broadcast bits of the filter of n ids, the one column of ids."""
    bits = ids.mapInArrow(_bits(n), "bits binary").repartition(8).mapInArrow(_ored, "bits binary").repartition(1).mapInArrow(_ored, "bits binary")
    return ids.sparkSession.sparkContext.broadcast(bytes(bits.collect()[0][0]))


def maybe_among(ids: DataFrame, n: int):
    """A function of long columns without nulls: false where a value is surely none of the n > 0 ids, the one column of ids."""
    bits_b = _filter_of(ids, n)

    @F.pandas_udf("boolean")
    def held(values: pd.Series) -> pd.Series:
        return pd.Series(Bloom(n, bits_b.value).may_hold(values.to_numpy()))

    return held


def _sets(words: int, n: int, bits_b):
    """cls, set of the documents that the filter lets by, each set once a task."""

    def run(batches):
        bloom, seen = Bloom(n, bits_b.value), set()
        for b in batches:
            b = b.filter(pa.array(bloom.may_hold(b.column(0).to_numpy())))
            sets = {_key(_class_of(s)): s.view(np.int64) for s in (shingles(t, words) for t in b.column(1).to_pylist()) if len(s)}
            sets = {k: s for k, s in sets.items() if k not in seen}
            seen.update(sets)
            yield pa.record_batch([pa.array(sets, pa.int64()), pa.array(sets.values(), pa.list_(pa.int64()))], ["cls", "set"])

    return run


def _needed(n_a, n_b, percent: int):
    """The least overlap of two sets of these sizes that link."""
    return F.ceil(F.lit(percent) * (n_a + n_b) / F.lit(100 + percent))


def _passes(a: str, b: str, percent: int):
    """Length and positional filter on two packed postings of one shingle."""
    n = lambda p: F.shiftright(F.col(p), 28).bitwiseAND(F.lit((1 << 28) - 1))
    at = lambda p: F.col(p).bitwiseAND(F.lit((1 << 28) - 1))
    need = _needed(n(a), n(b), percent)
    return (100 * F.least(n(a), n(b)) >= percent * F.greatest(n(a), n(b))) & (F.least(n(a) - at(a), n(b) - at(b)) >= need)


def _apart(bits_a: str, bits_b: str):
    return F.aggregate(F.zip_with(bits_a, bits_b, lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("int")), F.lit(0), lambda s, x: s + x)


def _near(percent: int):
    """Suffix filter: whether the Hamming distance of the whole sets, bound by their bitmaps, leaves enough overlap."""
    n = F.col("n_a") + F.col("n_b")
    return F.floor((n - _apart("bits_a", "bits_b")) / 2) >= _needed(F.col("n_a"), F.col("n_b"), percent)


def _candidates(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """a, b, rep_a, rep_b, apart of the pairs(a, b) that pass the suffix filter and, if classes have comp, whose comps differ."""
    known = "comp" in classes.columns
    of = lambda x: classes.select(F.col("cls").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in ("rep", "n", "bits", *(["comp"] if known else []))))
    both = pairs.join(of("a"), "a").join(of("b"), "b").where(_near(percent) & (F.col("comp_a") != F.col("comp_b") if known else F.lit(True)))
    return both.select("a", "b", "rep_a", "rep_b", _apart("bits_a", "bits_b").alias("apart"))


def _nearest(pairs: DataFrame) -> DataFrame:
    """Of each class, its nearest pair."""
    pair = F.struct("apart", "a", "b", "rep_a", "rep_b").alias("p")
    ends = pairs.select(F.col("a").alias("x"), pair).union(pairs.select("b", pair))
    return ends.groupBy("x").agg(F.min("p").alias("p")).select("p.*").distinct()


def _verified(pairs: DataFrame, documents: DataFrame, words: int, percent: int, cut) -> DataFrame | None:
    """Links (a, b) between classes among pairs(a, b, rep_a, rep_b), over whole sets.

    pairs is a table that cut has written. A filter of the wanted ids keeps other texts out of the shuffle.
    """
    reps = pairs.select(F.col("rep_a").alias("id")).union(pairs.select("rep_b"))
    n = 2 * pairs.count()  # ids that repeat only make the filter larger, and it has a bound
    if not n:
        return None
    sets = documents.mapInArrow(tidied(_sets(words, n, _filter_of(reps, n))), "cls long, set array<long>").dropDuplicates(["cls"])
    side = lambda x: sets.select(F.col("cls").alias(x), F.col("set").alias(f"set_{x}"))
    both = pairs.select("a", "b", "rep_a", "rep_b").join(side("a"), "a").join(side("b"), "b")
    need = _needed(F.size("set_a"), F.size("set_b"), percent)
    return cut(both.where(F.size(F.array_intersect("set_a", "set_b")) >= need).select("a", "b"))


def _labels(classes: DataFrame, found: DataFrame) -> DataFrame:
    """cls, rep, n, bits, comp: the classes with their components."""
    return classes.join(found, found["id"] == classes["cls"], "left").select("cls", "rep", "n", "bits", F.coalesce("component", "cls").alias("comp"))


def _open(postings: DataFrame, labels: DataFrame) -> DataFrame:
    """The postings of shingles whose classes are in several components, with comp and the shingle's largest (most).

    Components only grow together, so a shingle that is left out once need not be looked at again.
    """
    marked = postings.select("token", "cls", "pack").join(labels.select("cls", "comp"), "cls")
    sizes = marked.groupBy("token", "comp").agg(F.count(F.lit(1)).alias("m"))
    open_ = sizes.groupBy("token").agg(F.max_by("comp", "m").alias("most"), F.count(F.lit(1)).alias("k")).where("k > 1").select("token", "most")
    return marked.join(open_, "token")


def _to_pivot(postings: DataFrame, percent: int, apart: bool) -> DataFrame:
    """Pairs (a, b) of each class with the pivot of its shingle: the most central class at first.

    Once components are known (`apart`) it is a random one that has the shingle early in its prefix, where the positional
    filter lets most of the others by, and only classes of other components meet it.
    """
    n, at = (F.shiftright("pack", x).bitwiseAND(F.lit((1 << 28) - 1)) for x in (28, 0))
    order = F.struct(n - at >= _needed(n, n, percent), F.xxhash64("cls", "token"), "cls") if apart else F.struct("pack", "cls")
    pivot = postings.groupBy("token").agg(F.max_by(F.struct("cls", "pack", *(["comp"] if apart else [])), order).alias("p"))
    met = postings.join(pivot, "token").where(F.col("cls") != F.col("p.cls")).withColumn("pack_p", F.col("p.pack"))
    if apart:
        met = met.where(F.col("comp") != F.col("p.comp"))
    return met.where(_passes("pack", "pack_p", percent)).select(F.least("cls", "p.cls").alias("a"), F.greatest("cls", "p.cls").alias("b"))


def _between(postings: DataFrame, percent: int) -> DataFrame:
    """All pairs (a, b) of open postings in different components of a shingle that pass all three filters.

    One side has the postings outside their shingle's largest component, so a group that is together meets none of its
    own, and only postings of neighbouring size bands meet. In a shingle of many classes that don't link this compares
    them all, as any prefix filter does; the join writes only the pairs that pass.
    """
    n = F.shiftright("pack", 28).bitwiseAND(F.lit((1 << 28) - 1))
    band = F.floor(F.log(n.cast("double")) / F.log(F.lit(100.0 / percent)) + 1e-9) if percent < 100 else n
    side = lambda x: [F.col("token"), *(F.col(c).alias(f"{c}_{x}") for c in ("cls", "pack", "comp", "most", "n", "bits"))]
    near = F.explode(F.sequence(band - 1, band + 1)) if percent < 100 else band
    a, b = postings.where("comp <> most").select(*side("a"), near.alias("band")), postings.select(*side("b"), band.alias("band"))
    apart = F.expr("comp_a <> comp_b and (comp_b = most_b or cls_a < cls_b)") & _passes("pack_a", "pack_b", percent) & _near(percent)
    return a.join(b, (a["token"] == b["token"]) & (a["band"] == b["band"]) & apart).select(F.least("cls_a", "cls_b").alias("a"), F.greatest("cls_a", "cls_b").alias("b"))


def jaccard_components(documents: DataFrame, threshold: float = 0.8, words: int = 5) -> DataFrame:
    """doc_id, n_shingles, class_id, component_id, component, text_hash of every row of documents(doc_id, text).

    class_id is the smallest doc_id with the same set, component_id the smallest doc_id reachable by links; component is
    a key of the component itself (null: no words or no id), text_hash is xxhash64 of the text.
    Null and empty texts: n_shingles 0, linked with nothing. A null doc_id is reported, never linked. Rows that repeat a
    doc_id are reported as often, each with the component of its own text. Only components are built, so links inside
    one are not counted. An empty table gives no rows. Other columns are not read, whatever their names.
    """
    spark, percent = documents.sparkSession, round(100 * threshold)
    bounded_batches(spark)
    text = F.col("text").cast("string")
    documents = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))
    with scratch() as cut:
        scanned = cut(documents.mapInArrow(tidied(_scan(words)), "doc_id long, th long, n long, sig binary, cls long, bits array<long>, slice int, counts binary"))
        counts = np.zeros(COUNTERS, np.int64).reshape(SLICES, -1)
        for r in scanned.where("slice is not null").select("slice", "counts").repartition(SLICES, "slice").mapInArrow(_summed, "slice int, counts binary").collect():
            counts[r["slice"]] += np.frombuffer(bytes(r["counts"]), np.int64)  # SLICES rows
        counts = counts.reshape(-1)
        ranks = np.empty(COUNTERS, np.uint64)
        ranks[np.argsort(counts, kind="stable")] = np.arange(COUNTERS, dtype=np.uint64)
        counts_b = spark.sparkContext.broadcast((counts, ranks))
        rows = scanned.where("slice is null").select("doc_id", "th", "n", "sig", "cls", "bits")
        classes = cut(rows.where("sig is not null and doc_id is not null").groupBy("sig").agg(F.min("doc_id").alias("rep"), F.first("cls").alias("cls"), F.first("n").alias("n"), F.first("bits").alias("bits")))

        named = documents.where("doc_id is not null").select("doc_id", "text")
        # A shingle with a tenth of a task's share of the postings is dealt over several tasks.
        load = max(1000.0, counts.sum() * (100 - percent) / 1000 / int(spark.conf.get("spark.sql.shuffle.partitions")))
        posts = named.select("text").mapInArrow(tidied(_postings(counts_b, words, percent, load)), "token long, cls long, pack long, salt int")
        # Most shingles occur in one class only and end here, after the one shuffle that all postings go through.
        posts = posts.repartition("token", "salt").sortWithinPartitions("token", "salt", "cls")
        met = cut(posts.mapInArrow(tidied(_meetings(percent)), "token long, a long, b long, pack long"), ROWS)
        frequent = met.where("token is not null").select("token", F.col("a").alias("cls"), "pack")  # each once
        star = _to_pivot(frequent, percent, apart=False)
        pairs = cut(_candidates(met.where("token is null").select("a", "b").union(star).distinct(), classes, percent))

        tried = cut(_nearest(pairs))
        links = _verified(tried, named, words, percent, cut)
        if links is None:
            links = cut(classes.select(F.col("cls").alias("a"), F.col("cls").alias("b")).limit(0))
        found, done = components(links, written=True), tried.select("a", "b")
        for last in (False, True):
            labels = cut(_labels(classes, found))
            frequent = cut(_open(frequent, labels))
            more = _between(frequent.join(classes.select("cls", "n", "bits"), "cls"), percent) if last else _to_pivot(frequent, percent, apart=True)
            met_by = lambda x, tried: x.select("a", "b", F.lit(tried).alias("tried"))
            left = met_by(pairs, False).union(met_by(more, False)).union(met_by(done, True)).groupBy("a", "b").agg(F.max("tried").alias("tried"))
            pairs = cut(_candidates(left.where("not tried").select("a", "b"), labels, percent))
            tried = pairs if last else cut(_nearest(pairs))
            done = done.union(tried.select("a", "b"))
            more = _verified(tried, named, words, percent, cut)
            if more is not None:
                links = cut(links.union(more))
                found = components(links, written=True)
        comps = cut(_labels(classes, found).select("cls", "rep", "comp"))
        least = comps.groupBy("comp").agg(F.min("rep").alias("component_id"))
        of = comps.join(least, "comp").select("cls", "rep", "comp", "component_id")
        linked = F.col("doc_id").isNotNull()
        out = rows.drop("bits", "sig").join(of, "cls", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(linked, F.coalesce("rep", "doc_id")).alias("class_id"), F.when(linked, F.coalesce("component_id", "doc_id")).alias("component_id"), F.when(linked, F.col("comp")).alias("component"), F.col("th").alias("text_hash"))
        return cut.keep(cut(out))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))
