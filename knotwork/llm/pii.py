"""Personal data: base expressions, and bootstrapped contextual extraction.

Base spans are the seeds. Their contexts (two words before; a word before and one after) are lexical patterns.
Patterns and the identifier-like tokens that occur in them form a bipartite graph, over which Spark passes scores
back and forth: a pattern is as good as the mean score of its instances, an instance as good as its good
patterns make it. Occurrences of unseen instances in high-confidence patterns become further spans.
"""

from __future__ import annotations

import bisect
import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_batches, cut, discard, rowed, table, tidied

KINDS = ("email", "ip", "card", "phone")

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_NOT_LOCAL = re.compile(r"[^A-Za-z0-9._%+-]")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_ANY = re.compile(r"[0-9@]")
_TOKEN = re.compile(r"(?<![A-Za-z0-9._@/-])(?=[A-Za-z._@/-]*[0-9])[A-Za-z0-9][A-Za-z0-9._@/-]{3,}[A-Za-z0-9](?![A-Za-z0-9])")
#: Stands for base spans where runs are looked for.
_GONE = "\ue000"
_RUNS = (
    re.compile(r"(?<![A-Za-z0-9._%+\ue000-])[A-Za-z0-9._%+-]++@[A-Za-z0-9](?:[A-Za-z0-9.-]*[A-Za-z0-9])?"),
    re.compile(r"(?<![A-Za-z0-9\ue000])[0-9]++[.:][0-9.:]*[0-9](?![A-Za-z0-9\ue000])"),
    re.compile(r"(?<![A-Za-z0-9_@/\ue000])\+?\(?[0-9][0-9 ().-]*[0-9](?![A-Za-z0-9\ue000])"),  # all that a shape allows
    re.compile(r"(?<![A-Za-z0-9_@/\ue000])\+?\(?[0-9]+(?:(?:[ .-]|\)[ .-]?|[ .-]?\()[0-9]+)+(?![A-Za-z0-9\ue000])"),  # one sign apart
)
_WORD = re.compile(r"\S+")
_EDGE = " \t\n.,;:!?()[]{}<>\"'|#$%&*=-"


def _emails(text: str):
    """Leftmost matches, found from their @: the local part is the run before it that no match has used."""
    used, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > used and not _NOT_LOCAL.match(text, start - 1):
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            used = m.end()
        else:
            used = at + 1
        at = text.find("@", max(used, at + 1))


def _ips(text: str):
    for m in _DOTTED.finditer(text):
        if m.group().count(".") < 3:
            continue
        parts = [(x.start() + m.start(), x.end() + m.start()) for x in re.finditer("[0-9]+", m.group())]
        for i in range(0, len(parts) - 3, 4):
            if all(len(v) <= 3 and int(v or 0) <= 255 for v in (text[a:b].lstrip("0") for a, b in parts[i : i + 4])):
                yield parts[i][0], parts[i + 3][1]


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        d = d * 2 if i % 2 else d
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _cards(text: str):
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and _luhn(digits):
            yield m.span()


def _phones(text: str):
    for m in _PHONE.finditer(text):
        if 8 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
            yield m.span()


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) in code points, by kind, then start; each kind on its own."""
    if not _ANY.search(text):
        return []
    found = [(0, *x) for x in (_emails(text) if "@" in text else ())]
    found += [(1, *x) for x in _ips(text)] + [(2, *x) for x in _cards(text)]
    return found + [(3, *x) for x in (_phones(text) if "+" in text else ())]


#: A word of a pattern is its last or first so many characters: those next to the instance.
_PART = 48


def _clean(word: str) -> str:
    return re.sub("[0-9]", "0", word.strip(_EDGE).lower())


def _contexts(text: str, words: list[tuple[int, int]], start: int, end: int) -> list[str]:
    """The two patterns of an instance. words: the places of the text's words; parts of words beside the instance are words."""
    i = bisect.bisect_left(words, (start, 0))
    before = [_clean(text[max(a, min(b, start) - _PART) : min(b, start)]) for a, b in words[max(0, i - 2) : i]]
    j = bisect.bisect_right(words, end, key=lambda w: w[1])
    after = [_clean(text[max(a, end) : min(b, max(a, end) + _PART)]) for a, b in words[j : j + 1]]
    one, two, right = (before or ["^"])[-1], (["^", "^", *before])[-2], (after or ["$"])[0]
    return [f"{two} {one} _", f"{one} _ {right}"]


def _instance(found: str) -> str:
    """Stands for what was found; one that is very long by its digest."""
    return found.lower() if len(found) <= 256 else hashlib.md5(found.lower().encode("utf-8", "surrogatepass")).hexdigest()


def _candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """What may be an unseen identifier, by start: tokens with a digit, local@name, and digits with signs between them."""
    found, rest, at = {m.span() for m in _TOKEN.finditer(text)}, [], 0
    for _, s, e in sorted(base, key=lambda x: x[1:]):
        if e > at:
            rest += [text[at:s], _GONE * (e - max(at, s))]
            at = e
    rest = "".join(rest) + text[at:]
    for form in _RUNS:
        for m in form.finditer(rest):
            s, e = m.span()
            found.add((s + (rest[s] == "(" and ")" not in m.group()), e))
    return sorted(found)


def occurrences(text: str, base: list[tuple[int, int, int]]) -> list[dict]:
    """Seeds and other identifier-like tokens with their contexts."""
    if not _ANY.search(text):
        return []
    more = _candidates(text, base)
    words = [m.span() for m in _WORD.finditer(text)] if base or more else []
    out = [{"kind": k, "start": s, "end": e, "inst": _instance(text[s:e]), "ctx": _contexts(text, words, s, e)} for k, s, e in base]
    taken, i = sorted((s, e) for _, s, e in base), 0
    for start, end in more:
        while i < len(taken) and taken[i][1] <= start:
            i += 1
        if i == len(taken) or taken[i][0] >= end:
            out.append({"kind": -1, "start": start, "end": end, "inst": _instance(text[start:end]), "ctx": _contexts(text, words, start, end)})
    return out


_SPANS = pa.list_(pa.struct([("k", pa.int32()), ("s", pa.int64()), ("e", pa.int64())]))
_FOUND = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("inst", pa.string()), ("ctx", pa.list_(pa.string()))]))
_SCANNED = "doc_id long, th long, base array<struct<k:int,s:long,e:long>>, occ array<struct<kind:int,start:long,end:long,inst:string,ctx:array<string>>>"


def _scan(batches):
    for b in batches:
        base, occ = [], []
        for text in b.column(2).to_pylist():
            spans = base_spans(text or "")
            base.append([{"k": k, "s": s, "e": e} for k, s, e in spans])
            occ.append(occurrences(text or "", spans))
        yield pa.record_batch([b.column(0), b.column(1), pa.array(base, _SPANS), pa.array(occ, _FOUND)], ["doc_id", "th", "base", "occ"])


#: What a span must look like to be taken for a kind.
_SHAPE = {0: "@", 1: r"^[0-9]+[.:][0-9.:]+$", 2: r"^[0-9][0-9 -]{10,}[0-9]$", 3: r"^\+?\(?[0-9][0-9 ().-]{5,}[0-9]$"}


def discovered(scanned: DataFrame, least_seeds: int = 3, confidence: float = 0.8) -> DataFrame:
    """doc_id, th, found array<(k, s, e)>: spans that high-confidence patterns add, none of which meets a base span.

    Scores go back and forth until no confidence grows by 0.001 any more."""
    seen = cut(scanned.where(F.size("occ") > 0).select("doc_id", "th", F.explode("occ").alias("o")).select("doc_id", "th", "o.*"))
    edges = cut(seen.select(F.explode("ctx").alias("ctx"), "inst", "kind").distinct())
    sizes = edges.groupBy("ctx").agg(F.countDistinct("inst").alias("n"))
    seeds = edges.where("kind >= 0").groupBy("ctx", "kind").agg(F.count(F.lit(1)).alias("seeds")).where(F.col("seeds") >= least_seeds)
    patterns = cut(seeds.join(sizes, "ctx"))
    unseen = cut(edges.where("kind = -1").select("ctx", "inst").join(patterns.select("ctx", "kind"), "ctx"))
    given = cut(patterns.withColumn("conf", F.col("seeds") / F.col("n")))
    while not unseen.isEmpty():  # confidences only grow, and not beyond 1
        good = given.where(F.col("conf") >= confidence / 2).select("ctx", "kind", "conf")
        scores = cut(unseen.join(good, ["ctx", "kind"]).groupBy("inst", "kind").agg((1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("conf"), F.lit(1e-9)))))).alias("score")))
        gain = unseen.join(scores, ["inst", "kind"]).groupBy("ctx", "kind").agg(F.sum("score").alias("more"))
        before, given = given, cut(patterns.join(gain, ["ctx", "kind"], "left").withColumn("conf", F.least(F.lit(1.0), (F.col("seeds") + F.coalesce("more", F.lit(0.0)) * F.col("seeds") / F.col("n")) / F.col("n"))).drop("more"))
        grown = given.join(before.select("ctx", "kind", F.col("conf").alias("was")), ["ctx", "kind"]).agg(F.max(F.col("conf") - F.col("was"))).first()[0]
        discard(before, scores)
        if not grown or grown < 0.001:
            break
    high = given.where(F.col("conf") >= confidence).select("ctx", "kind", "conf")
    hits = seen.where("kind = -1").select("doc_id", "th", "start", "end", "inst", F.explode("ctx").alias("ctx")).join(high, "ctx")
    looks = F.lit(False)
    for kind, shape in _SHAPE.items():
        looks = looks | ((F.col("kind") == kind) & F.col("inst").rlike(shape))
    best = hits.where(looks).groupBy("doc_id", "th", "start", "end").agg(F.max(F.struct("conf", -F.col("kind"))).alias("m"))
    # Of spans inside each other the longest counts.
    above = Window.partitionBy("doc_id", "th").orderBy("start", F.desc("end")).rowsBetween(Window.unboundedPreceding, -1)
    best = best.withColumn("_to", F.max("end").over(above)).where("_to is null or _to < end")
    span = F.struct((-F.col("m")["col2"]).cast("int").alias("k"), F.col("start").alias("s"), F.col("end").alias("e"))
    out = cut(best.groupBy("doc_id", "th").agg(F.collect_list(span).alias("found")))
    discard(seen, edges, patterns, unseen, given)
    return out


def _key():
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def _scanned(documents: DataFrame) -> DataFrame:
    bounded_batches(documents.sparkSession)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), _key().alias("th"), F.col("text").cast("string").alias("text"))
    return cut(docs.mapInArrow(tidied(_scan), _SCANNED))


def _joined(spans):
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"], x["e"])), ",")


def extract(documents: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_found of every row of documents(doc_id, text).

    The counts and the digest are of the base spans; spans has those and the n_found others. Null and empty
    texts have none. Equal rows get equal results each; other columns are not read.
    """
    scanned = _scanned(documents)
    found = discovered(scanned).select(F.col("doc_id").alias("d"), F.col("th").alias("h"), "found")
    both = scanned.drop("occ").join(found, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("h")), "left")
    every = F.array_sort(F.concat("base", F.coalesce("found", F.array().cast("array<struct<k:int,s:bigint,e:bigint>>"))))
    # The function of filter() must not have a second argument, even with a default: that is the place in the array.
    of = lambda k: F.filter("base", lambda x: x["k"] == k)
    counts = [F.size(of(k)).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return both.select("doc_id", *counts, F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(every).alias("spans"), F.coalesce(F.size("found"), F.lit(0)).alias("n_found"))


def mask(text: str | None, found: list | None) -> str | None:
    """The text with each span, base or found, replaced by its kind in brackets; spans that overlap become one."""
    if not text:
        return text
    spans = sorted([(s, e, k) for k, s, e in base_spans(text)] + [(x["s"], x["e"], x["k"]) for x in (found if found is not None else ())])
    out, at = [], 0
    for s, e, k in spans:
        if s >= at:
            out += [text[at:s], f"[{KINDS[k].upper()}]"]
        at = max(at, e)
    return "".join(out) + text[at:]


def redact(documents: DataFrame) -> DataFrame:
    """All rows and columns of documents, whatever their names, with the personal data of text masked."""

    @F.pandas_udf("string")
    def masked(texts, found):
        return texts.combine(found, mask) if len(texts) else texts

    scanned = _scanned(documents)
    found = discovered(scanned)
    discard(scanned)
    rows = rowed(documents, d=F.col("doc_id").cast("long"), h=_key())
    out = rows.join(found, rows["d"].eqNullSafe(found["doc_id"]) & (rows["h"] == found["th"]), "left")
    clean = masked(F.col("row.text").cast("string"), "found")
    return out.select(*(clean.alias(c) if c == "text" else F.col(f"row.`{c}`") for c in documents.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "documents"))
