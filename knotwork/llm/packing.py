"""Best-fit packing by bin completion.

Packing depends on lengths only, and there are at most `size` of them. So the plan is made from the histogram
of lengths, which is small for any input: take the largest length left, enumerate its undominated fillings,
use the best one as often as the counts allow, go on. Every such step uses up a length class; the plan is a
list of patterns with how often each is used. The best-fit descent is the incumbent, other descents take a worse
filling at one step. If they need more bins than the lower bound, branch and bound goes over all undominated fillings
of every step, until the bound is met, the tree is exhausted or WORK is used up.
Spark then numbers the pieces within their length and looks their place up in the plan.
"""

from __future__ import annotations

import functools
import hashlib
import os
import zlib
from array import array
from bisect import bisect_right

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, cut, numbered, table, tidied

#: Steps of the branch and bound: lengths looked at. Some seconds; small histograms are exhausted long before.
WORK = 5_000_000
#: Bytes of texts whose words are looked up at once; one text may be longer.
CHARS = 1 << 21

# --- the plan -----------------------------------------------------------------------------------


def fillings(counts: np.ndarray, room: int, most: int = 3) -> list[tuple[int, tuple[int, ...]]]:
    """The `most` best (waste, lengths) with up to three large items each; a filling that another dominates is left out."""
    av = np.flatnonzero(counts[: room + 1])
    av = av[av > 0]
    if not len(av):
        return [(room, ())]
    found = [(room - int(av[-1]), (int(av[-1]),))]
    if found[0][0] == 0:
        return found  # one item that fits exactly dominates all others

    def pairs(left: int, first: int, keep: int) -> None:
        a = av[av <= left]
        if not len(a):
            return
        at = np.searchsorted(av, np.minimum(a, left - a), "right") - 1
        ok = at >= 0
        a, b = a[ok], av[at[ok]]
        need = 1 + (a == b).astype(int) + (b == first) + 0
        ok = (counts[b] >= need) & (counts[a] >= 1 + (a == first) + (a == b))
        a, b = a[ok], b[ok]
        for i in np.lexsort((-a, left - a - b))[:keep]:
            found.append((left - int(a[i]) - int(b[i]), tuple(x for x in (first, int(a[i]), int(b[i])) if x)))

    pairs(room, 0, most)
    if min(found)[0]:
        for first in av[::-1][:48]:
            if first < room and counts[first] >= 1:
                pairs(room - int(first), int(first), 1)
                if min(found)[0] == 0:
                    break
    best: dict[int, tuple[int, ...]] = {}
    for waste, items in found:  # of equal waste, the filling with the larger items dominates
        if waste not in best or sorted(items, reverse=True) > sorted(best[waste], reverse=True):
            best[waste] = items
    return sorted((w, x) for w, x in best.items())[:most]


def _descend(counts: np.ndarray, size: int, worse_at: int, bound: float) -> list[tuple[tuple[int, ...], int]] | None:
    """One descent; takes the second-best filling at step `worse_at`. None if its waste exceeds the bound."""
    counts, out, waste, step, top = counts.copy(), [], 0, 0, size
    while True:
        while top > 0 and not counts[top]:
            top -= 1
        if not top:
            return out
        counts[top] -= 1
        options = fillings(counts, size - top)
        counts[top] += 1
        _, items = options[min(1, len(options) - 1) if step == worse_at else 0]
        used = np.bincount([top, *items], minlength=1)
        whole, left = [top, *items], size - top - sum(items)
        while left > 0:  # what still fits, largest first
            small = np.flatnonzero(counts[: left + 1])
            small = [x for x in small[::-1] if x and counts[x] > (used[x] if x < len(used) else 0)][:1]
            if not small:
                break
            n = min((left // small[0]), int(counts[small[0]] - (used[small[0]] if small[0] < len(used) else 0)))
            whole += [int(small[0])] * n
            left -= int(small[0]) * n
            used = np.bincount(whole)
        kinds = np.flatnonzero(used)
        times = int((counts[kinds] // used[kinds]).min())
        counts[kinds] -= used[kinds] * times
        out.append((tuple(sorted(map(int, whole), reverse=True)), times))
        step += 1
        if counts.any():
            waste += left * times
            if waste > bound:
                return None


def least_bins(counts: np.ndarray, size: int) -> int:
    """The lower bound of Martello and Toth (L2), with that of the total."""
    lengths = np.arange(size + 1)
    n, total = np.concatenate(([0], np.cumsum(counts))), np.concatenate(([0], np.cumsum(counts * lengths)))
    a = np.arange(size // 2 + 1)  # items above size - a are alone; those of a to half a size fill up the larger ones
    large, alone = n[size + 1] - n[size // 2 + 1], n[size + 1] - n[size - a + 1]
    free = (large - alone) * size - (total[size - a + 1] - total[size // 2 + 1])
    return int(max((large + np.maximum(0, -((free - (total[size // 2 + 1] - total[a])) // size))).max(), -(-int(total[-1]) // size)))


class _Spent(Exception):
    """The work allowed is used up."""


def _completions(counts: np.ndarray, room: int, slack: int, work: list[int]):
    """(waste, lengths) of all fillings that waste no more than slack, but for those that another dominates.

    A filling is dominated if one of its items, a pair of them or nothing can give way to one larger item that is left:
    what it displaces fits where that item would have gone.
    """
    up = np.flatnonzero(counts[: room + 1])
    # A step of the search stays open as long as those below it, so what it holds is compact: 24 bytes a length.
    sums, have, up = (array("q", x.astype(np.int64).tobytes()) for x in (np.concatenate(([0], np.cumsum(up * counts[up]))), counts[up], up))
    work[0] -= 64 + len(up)

    def dominated(items: list[int], waste: int) -> bool:
        kinds = sorted(set(items))
        pairs = {x + y for i, x in enumerate(kinds) for y in kinds[i:] if x != y or items.count(x) > 1}
        for x, least in {(0, 1), *((x, x + 1) for x in kinds), *((x, x) for x in pairs)}:
            at = bisect_right(up, least - 1)
            while at < len(up) and up[at] <= x + waste:
                work[0] -= 1
                if have[at] > items.count(up[at]):
                    return True
                at += 1
        return False

    def grow(upto: int, left: int, items: list[int]):
        if left <= slack and not dominated(items, left):
            yield left, tuple(items)
        for at in range(min(upto, bisect_right(up, left)) - 1, -1, -1):
            work[0] -= 1
            if work[0] < 0:
                raise _Spent
            if left - sums[at + 1] > slack:
                return
            x = up[at]
            for n in range(min(have[at], left // x), 0, -1):
                yield from grow(at, left - n * x, items + [x] * n)

    return grow(len(up), room, [])


def _search(counts: np.ndarray, size: int, best: list, least: int, work: int) -> list[tuple[tuple[int, ...], int]]:
    """The best plan: branch and bound over all undominated fillings of the largest item left.

    A filling is taken as often as it can be and, on the way back, once: the latter alone is the whole tree.
    """
    counts, budget, total = counts.copy(), [work], int((counts * np.arange(size + 1)).sum())
    bound, seen, path, stack = sum(n for _, n in best), {}, [], []
    used = waste = 0

    def choices(slack: int):
        top = int(np.flatnonzero(counts)[-1])
        counts[top] -= 1
        found = _completions(counts, size - top, slack, budget)
        counts[top] += 1
        for lost, items in found:
            whole = (top, *items)
            kinds, need = np.unique(whole, return_counts=True)
            most = int((counts[kinds] // need).min())
            for times in (most, 1) if most > 1 else (1,):
                yield whole, times, lost * times, kinds, need * times

    try:
        stack.append(choices((bound - 1) * size - total))
        while stack:
            step = next(stack[-1], None)
            if step is None:
                stack.pop()
                if path:
                    _, times, lost, kinds, need = path.pop()
                    counts[kinds] += need
                    used, waste = used - times, waste - lost
                continue
            whole, times, lost, kinds, need = step
            slack = (bound - 1) * size - total - waste - lost
            if slack < 0:
                continue
            counts[kinds] -= need
            if not counts.any():
                best, bound = [(x[0], x[1]) for x in [*path, step]], used + times
                if bound <= least:
                    return best
                counts[kinds] += need
                continue
            key = hashlib.blake2b(counts.tobytes(), digest_size=16).digest()
            if seen.get(key, used + times + 1) <= used + times:
                counts[kinds] += need
                continue
            seen[key] = used + times
            path.append(step)
            used, waste = used + times, waste + lost
            stack.append(choices(slack))
    except _Spent:
        pass
    return best


def plan(histogram: dict[int, int], size: int, descents: int = 6, work: int = WORK) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, how often) of the bins; every item is placed once and no bin exceeds size."""
    counts = np.zeros(size + 1, np.int64)
    for length, n in histogram.items():
        counts[length] = n
    if not counts.any():
        return []
    total = int((counts * np.arange(size + 1)).sum())
    least = least_bins(counts, size)
    best = _descend(counts, size, -1, float("inf"))
    bins = lambda p: sum(n for _, n in p)
    for worse_at in range(descents):
        if bins(best) <= least:
            return best
        other = _descend(counts, size, worse_at, (bins(best) - 1) * size - total)
        if other is not None and bins(other) < bins(best):
            best = other
    return best if bins(best) <= least else _search(counts, size, best, least, work)


# --- tokens -------------------------------------------------------------------------------------


@functools.cache
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task a core already
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _of_letters(model):
    """The same for words of a-z with a blank between them, which need neither normalizing nor expressions to split them."""
    from tokenizers import Tokenizer, pre_tokenizers

    letters = Tokenizer(model.model)
    letters.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
    return letters


class Ids:
    """Token ids of whole texts as little-endian bytes.

    White space always ends a token of this vocabulary, so a text's ids are those of its words in turn. Ids of words
    are kept while they are in use, up to two generations of `keep` words and those of one call more.
    """

    def __init__(self, path: str, keep: int = 250_000, longest: int = 48):
        self.model, self.keep, self.longest = tokenizer(path), keep, longest
        ids_of_ = lambda text: np.array(self.model.encode(text, add_special_tokens=False).ids, "<u4")
        self.marks = {m: ids_of_(m).tobytes() for m in ("", ".", ",")}
        vocabulary = self.model.get_vocab()
        self.ends = np.zeros(1 + max(vocabulary.values()), bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.letters = _of_letters(self.model)
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _encoded(self, words: list[str], by) -> dict[str, bytes]:
        """Ids of words of letters only, from one call. Such a word is one unit and a unit's last token says so, which tells the words' ids apart."""
        ids = np.array(by.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
        stops = 4 * (np.flatnonzero(self.ends[ids]) + 1)
        if len(stops) != len(words):
            return {}
        data, cuts = ids.tobytes(), [0, *stops.tolist()]
        return {w: data[x:y] for w, x, y in zip(words, cuts, cuts[1:], strict=False)}

    def _learn(self, words: list[str]) -> None:
        """Puts the ids of words into young. Those of letters only, perhaps with a stop or comma after them, share calls.

        The vocabulary has lower case only, so words of A-Z share their ids with those of a-z.
        """
        young, old, marks = self.young, self.old, self.marks
        later, rest, fresh = [], [], ({}, {})
        for w in words:
            base = w
            if (mark := w[-1:]) == "." or mark == ",":
                base = w[:-1]
            else:
                mark = ""
            if base.isascii():
                if not base.isalpha():
                    rest.append(w)
                    continue
                base, kind = base.lower(), 0
            elif base.isalpha() and base.lower().isalpha():
                kind = 1
            else:
                rest.append(w)
                continue
            ids = young.get(base)
            if ids is None and (ids := old.get(base)) is None:
                fresh[kind][base] = None
                later.append((w, base, mark))
            else:
                young[w] = ids + marks[mark] if mark else ids
        known: dict[str, bytes] = {}
        for bases, by in zip(fresh, (self.letters, self.model), strict=True):
            if bases:
                known |= self._encoded(list(bases), by)
        young.update(known)
        for w, base, mark in later:
            if base in known:
                young[w] = known[base] + marks[mark] if mark else known[base]
            else:
                rest.append(w)
        if rest:
            for w, x in zip(rest, self.model.encode_batch_fast(rest, add_special_tokens=False), strict=True):
                young[w] = np.array(x.ids, "<u4").tobytes()

    def of(self, words: list[str]) -> list[bytes]:
        """Ids of each of words, which are distinct."""
        if len(self.young) > self.keep:
            self.young, self.old = {}, self.young
        young, old = self.young, self.old
        found = list(map(young.get, words))
        new = [w for w, x in zip(words, found, strict=True) if x is None]
        if not new:
            return found
        unseen = []
        for w in new:
            if (x := old.get(w)) is None:
                unseen.append(w)
            else:
                young[w] = x
        if unseen:
            self._learn(unseen)
        found = [young[w] if x is None else x for w, x in zip(words, found, strict=True)]
        for w in new:
            if len(w) > self.longest:
                young.pop(w, None)
                young.pop(w[:-1], None)
        return found

    def texts(self, texts: pa.Array):
        """Ids of each text (null: none). Words are told apart outside of Python, those of CHARS bytes of texts at a time."""
        texts = pc.fill_null(texts, "")
        size = pc.binary_length(texts).to_numpy().astype(np.int64)
        part = (np.cumsum(size) - size) // CHARS
        bounds = [*np.flatnonzero(np.diff(part, prepend=-1)).tolist(), len(texts)]
        for low, high in zip(bounds, bounds[1:], strict=False):
            some = texts[low:high]
            for space in "\n\t":
                some = pc.replace_substring(some, space, " ")
            split = pc.split_pattern(some, " ")
            coded = split.flatten().dictionary_encode()
            parts = self.of(coded.dictionary.to_pylist())
            length = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
            at = coded.indices.to_numpy()
            n = length[at]
            ends = np.concatenate(([0], np.cumsum(n)))
            places = np.repeat((np.cumsum(length) - length)[at] - ends[:-1], n)
            places += np.arange(len(places))
            ids = np.frombuffer(b"".join(parts), "<u4")[places]
            stops = ends[np.cumsum(pc.list_value_length(split).to_numpy())].tolist()
            for x, y in zip([0, *stops], stops, strict=False):
                yield ids[x:y].tobytes()

    def __call__(self, text: str) -> bytes:
        return next(self.texts(pa.array([text], pa.string())))


@functools.cache
def ids_of(path: str) -> Ids:
    """One for each Python worker, which keeps it from task to task."""
    return Ids(path)


def _pieces(path: str, size: int, end: int):
    def run(batches):
        ids, tail = ids_of(path), np.array([end], "<u4").tobytes()
        for b in batches:
            out: list[list] = [[], [], [], [], []]
            for doc, found in zip(b.column(0).to_pylist(), ids.texts(b.column(1)), strict=True):
                data = found + tail
                for piece, at in enumerate(range(0, len(data), 4 * size)):
                    part = data[at : at + 4 * size]
                    for x, v in zip(out, (doc, piece, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                        x.append(v)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.record_batch([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def pack(documents: DataFrame, tokenizer_path: str, size: int = 4096, end: int = 1) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: a row per piece of every row of documents(doc_id, text).

    Null and empty texts are the end id alone. Rows that repeat a doc_id are documents of their own; null ids stay null.
    Other columns are not read. Only documents longer than `size` are cut.
    """
    spark = documents.sparkSession
    bounded_batches(spark)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = docs.mapInArrow(tidied(_pieces(tokenizer_path, size, end)), "doc_id long, piece int, start long, length long, ids_crc32 long")
    rows = cut(rows.withColumn("_k", F.lpad(F.hex(F.xxhash64("doc_id", "piece", "ids_crc32")), 16, "0")))
    histogram = {r[0]: r[1] for r in rows.groupBy("length").count().collect()}  # at most `size` rows
    slots, next_rank, next_bin = [], {}, 0
    for lengths, times in plan(histogram, size):
        offset = 0
        for x in lengths:
            lo = next_rank.get(x, 0)
            slots.append((x, lo, lo + times, next_bin - lo, offset))
            next_rank[x] = lo + times
            offset += x
        next_bin += times
    places = spark.createDataFrame(slots, "length long, lo long, hi long, base long, offset long")
    ranked = numbered(rows, ["length"], "_k", "_r").alias("l")
    # At most a few patterns use up each of `size` lengths, so the plan has a bounded size whatever the input.
    on = (F.col("l.length") == F.col("p.length")) & (F.col("_r") >= F.col("lo")) & (F.col("_r") < F.col("hi"))
    return ranked.join(F.broadcast(places.alias("p")), on).select("doc_id", "piece", "start", "l.length", "ids_crc32", (F.col("base") + F.col("_r")).alias("sequence_id"), "offset")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), default_path())
