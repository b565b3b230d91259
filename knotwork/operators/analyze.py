"""Hubs, surprising connections and suggested questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import extension
from ..sources.scan import EXTENSIONS
from ..sources.tables import cut, discard, within
from .graph import PropertyGraph, concept, file_like

#: Families of languages by extension.
FAMILIES = {
    "python": (".py", ".pyw"), "js": (".js", ".jsx", ".mjs", ".ejs", ".ts", ".tsx", ".vue", ".svelte"), "go": (".go",), "rust": (".rs",),
    "jvm": (".java", ".kt", ".kts", ".scala"), "c": (".c", ".h", ".cpp", ".cc", ".cxx", ".hpp"), "ruby": (".rb",), "swift": (".swift",),
    "dotnet": (".cs",), "php": (".php",), "r": (".r",),
}
#: Relations that only state structure, and the score of each confidence.
STRUCTURAL = ("imports", "imports_from", "contains", "method")
SCORES = {"AMBIGUOUS": 3, "INFERRED": 2}
#: Fixed value: the degree from which a node is a hub to peripheral ones.
HUB = 5


def language(path: Column) -> Column:
    ext, out = extension(path), F.lit(None).cast("string")
    for family, extensions in FAMILIES.items():
        out = F.when(ext.isin(list(extensions)), family).otherwise(out)
    return out


def cross_language(a: Column, b: Column) -> Column:
    return F.coalesce(language(a) != language(b), F.lit(False))


def file_category(path: Column) -> Column:
    ext = F.concat(F.lit("."), F.lower(F.element_at(F.split(path, r"\."), -1)))
    out = F.when(ext.isin(list(EXTENSIONS["code"])), "code").when(ext.isin(list(EXTENSIONS["document"])), "doc")
    return out.when(ext.isin(list(EXTENSIONS["paper"])), "paper").when(ext.isin(list(EXTENSIONS["image"])), "image").otherwise("doc")


def top_dir(path: Column) -> Column:
    return F.split_part(path, F.lit("/"), F.lit(1))


def attributed(g: PropertyGraph) -> DataFrame:
    return g.nodes.join(g.degree, "id").withColumn("file_like", file_like()).withColumn("concept", concept())


def degrees(g: PropertyGraph) -> DataFrame:
    """(k, degree) of nodes with edges, by their key, written."""
    return cut(g.neighbours.groupBy(g.key("id").alias("k")).agg(F.count(F.lit(1)).alias("degree")))


def god_nodes(g: PropertyGraph, n: int = 10, counts: DataFrame | None = None) -> DataFrame:
    """The n nodes of the highest degree that are no files, methods or concepts; labels are looked up for the highest degrees only."""
    of, most, found = degrees(g) if counts is None else counts, 100 * n, None
    nodes = g.nodes.where("id is not null").withColumn("k", g.key("id"))
    while found is None:
        top = cut(of.orderBy(F.desc("degree"), "k").limit(most))
        real = cut(nodes.join(F.broadcast(top), "k").where(~file_like() & ~concept()).select("id", "label", "degree", "ord"))
        low = 0 if top.count() < most else top.agg(F.min("degree")).first()[0]  # of lower degrees, all are here
        if real.where(F.col("degree") > low).count() >= n:
            found = real
        elif low == 0 or most > 100_000:
            found = attributed(g).where(~F.col("file_like") & ~F.col("concept"))
        most *= 10
    out = found.orderBy(F.desc("degree"), F.translate("label", "_", " "), "ord").limit(n).select("id", "label", "degree")
    if counts is None:
        out = cut(out)
        discard(of)
        return out.orderBy(F.desc("degree"), F.translate("label", "_", " "))
    return out


def file_like_nodes(g: PropertyGraph) -> DataFrame:
    """(id, label, degree) of nodes that stand for a file or a method; only those that may are counted."""
    maybe = g.nodes.withColumn("degree", F.lit(0)).where(file_like()).drop("degree")  # the fewer edges, the likelier
    return maybe.join(g.degree_of(maybe, few=True), "id").where(file_like()).select("id", "label", "degree")


def _known(g: PropertyGraph, placed: DataFrame, counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(k, class) of placed nodes that are no files, methods or concepts, by their key, and (class, source_file, degree, cid), which is
    all that surprises are judged by; degrees up to HUB. Both are written."""
    some = placed.where("id is not null").withColumn("degree", F.lit(2)).where(~file_like() & ~concept())
    some = some.withColumn("degree", F.lit(0)).select(g.key("id").alias("k"), "source_file", "cid", file_like().alias("method"))
    degree = F.coalesce("degree", F.lit(0))
    real = cut(some.join(counts, "k", "left").where(~F.col("method") | (degree > 1)).select("k", "source_file", F.least(degree, F.lit(HUB)).alias("degree"), "cid"))
    of = ["source_file", "degree", "cid"]
    # One row a class.
    classes = cut(real.groupBy(*of).agg(F.count(F.lit(1)).alias("n")).select(F.row_number().over(Window.orderBy(*of)).alias("class"), *of))
    known = cut(real.join(F.broadcast(classes) if classes.count() <= 100_000 else classes, of).select("k", "class"))
    discard(real)
    return known, classes


def _side(known: DataFrame, p: str) -> DataFrame:
    return known.select(*(F.col(c).alias(f"{p}_{c}") for c in known.columns))


def _judged() -> tuple[Column, Column]:
    """Score and reasons of an edge across files, by its confidence, its relation and its ends."""
    s, t = F.col("s_source_file"), F.col("t_source_file")
    base = F.when(F.col("confidence") == "AMBIGUOUS", 3).when(F.col("confidence") == "INFERRED", 2).otherwise(1)
    base = F.when((F.col("confidence") == "INFERRED") & (F.col("relation") == "calls") & cross_language(s, t), 0).otherwise(base)
    a, b = file_category(s), file_category(t)
    tests = [
        (a != b, 2, F.concat(F.lit("crosses file types ("), a, F.lit(" <-> "), b, F.lit(")"))),
        (top_dir(s) != top_dir(t), 2, F.lit("connects across different directories")),
        (~F.col("s_cid").eqNullSafe(F.col("t_cid")), 1, F.lit("bridges separate communities")),
        ((F.least("s_degree", "t_degree") <= 2) & (F.greatest("s_degree", "t_degree") >= HUB), 1, F.lit("peripheral node reaches a hub")),
    ]
    score = base
    for test, gain, _ in tests:
        score = score + F.when(test, gain).otherwise(0)
    why = F.concat_ws("; ", F.when(F.col("confidence") != "EXTRACTED", F.concat(F.lower("confidence"), F.lit(" connection"))), *(F.when(test, reason) for test, _, reason in tests))
    return score, F.when(why == "", "cross-file semantic connection").otherwise(why)


#: What the score asks of an edge's confidence and relation, as one number.
KINDS = {1: ("EXTRACTED", ""), 2: ("INFERRED", ""), 3: ("AMBIGUOUS", ""), 4: ("INFERRED", "calls")}


def _links(g: PropertyGraph) -> DataFrame:
    """Edges that state more than structure, with the keys of their ends and their kind."""
    calls = (F.col("confidence") == "INFERRED") & (F.col("relation") == "calls")
    kind = F.when(calls, 4).when(F.col("confidence") == "AMBIGUOUS", 3).when(F.col("confidence") == "INFERRED", 2).otherwise(1)
    e = g.edges.where(~F.col("relation").isin(list(STRUCTURAL)))
    return e.withColumn("s", g.key("source")).withColumn("t", g.key("target")).withColumn("kind", kind.cast("byte"))


def _ends(links: DataFrame, known: DataFrame, *more: str) -> DataFrame:
    """The classes of both ends of links(s, t, kind)."""
    half = links.join(known.select(F.col("k").alias("t"), F.col("class").alias("t_class")), "t").select("s", *more, "kind", "t_class")
    return half.join(known.select(F.col("k").alias("s"), F.col("class").alias("s_class")), "s")


def _class_scores(g: PropertyGraph, known: DataFrame, classes: DataFrame) -> DataFrame:
    """(s_class, t_class, kind, n, score) of edges across files, written.

    Edges meet their ends one after the other, with keys and classes only.
    """
    n = cut(_ends(_links(g).select("s", "t", "kind"), known).groupBy("s_class", "t_class", "kind").agg(F.count(F.lit(1)).alias("n")))
    kinds = lambda i: F.element_at(F.create_map(*(F.lit(x) for k, v in KINDS.items() for x in (k, v[i]))), F.col("kind").cast("int"))
    rows = n.join(_side(classes, "s"), "s_class").join(_side(classes, "t"), "t_class").where("s_source_file <> t_source_file")
    rows = rows.withColumn("confidence", kinds(0)).withColumn("relation", kinds(1))
    return cut(rows.select("s_class", "t_class", "kind", "n", _judged()[0].alias("score")))


def score_counts(g: PropertyGraph, placed: DataFrame) -> DataFrame:
    """(score, n): how many edges across files have each score."""
    counts = degrees(g)
    known, classes = _known(g, placed, counts)
    out = _class_scores(g, known, classes).groupBy("score").agg(F.sum("n").alias("n"))
    discard(counts, known, classes)
    return out


#: Of how many edges the first ones are taken, before all edges of a score are gathered.
NEAR = 10_000


def _first(g: PropertyGraph, known: DataFrame, classes: DataFrame, n: int) -> DataFrame:
    """The first n by ord of the edges between classes(s_class, t_class, kind), written."""
    of = ["s_class", "t_class", "kind"]
    classes = F.broadcast(classes.select(of))
    kinds = [r["kind"] for r in classes.select("kind").distinct().collect()]
    links = _links(g).where(F.col("kind").isin(kinds))
    near = cut(links.orderBy("ord").limit(NEAR))
    ids = F.broadcast(near.select(F.explode(F.array("s", "t")).alias("k")).distinct())
    found = cut(_ends(near, cut(known.join(ids, "k")), *(c for c in near.columns if c not in ("s", "t", "kind"))).join(classes, of).orderBy("ord").limit(n))
    if found.count() == n:
        return found
    pairs = cut(_ends(links.select("s", "t", "kind", F.col("t").alias("end")), known, "end").join(classes, of).select("s", F.col("end").alias("t")))
    if pairs.count() <= NEAR:
        return cut(links.join(F.broadcast(pairs), ["s", "t"]).orderBy("ord").limit(n))
    pair = F.xxhash64("s", "t")
    some, most = within(pairs.select(pair.alias("h"))), 100 * n
    while True:  # filters let some other edges by, so that n of the first `most` may be too few
        near = cut(links.where(some(pair)).orderBy("ord").limit(most))
        found = cut(pairs.join(F.broadcast(near), ["s", "t"]).orderBy("ord").limit(n))
        if found.count() == n or near.count() < most:
            return found
        most *= 10


def surprising_connections(g: PropertyGraph, placed: DataFrame, n: int = 5, counts: DataFrame | None = None) -> DataFrame:
    """The n edges across files with the highest scores, of equal ones the first, with score and reasons, written.

    placed are the nodes with cid. Places and labels are looked up for these edges alone.
    """
    of = degrees(g) if counts is None else counts
    known, classes = _known(g, placed, of)
    scores = _class_scores(g, known, classes)
    top, open_ = None, n
    for r in scores.groupBy("score").agg(F.sum("n").alias("n")).orderBy(F.desc("score")).collect():  # one row a score
        found = _first(g, known, scores.where(F.col("score") == r["score"]), min(open_, r["n"]))
        found = found.select("source", "target", "confidence", "relation", "ord")
        top, open_ = found if top is None else top.unionByName(found), open_ - r["n"]
        if open_ <= 0:
            break
    if top is None:
        top = _links(g).select("source", "target", "confidence", "relation", "ord").limit(0)
    e = cut(top).withColumn("s", g.key("source")).withColumn("t", g.key("target"))
    names = e.select(F.explode(F.array("source", "target")).alias("id")).distinct()
    labels = cut(g.nodes.join(F.broadcast(names), "id", "left_semi").select(g.key("id").alias("k"), "label"))
    ends = cut(known.join(F.broadcast(labels), "k").join(classes, "class"))
    score, why = _judged()
    e = e.join(_side(ends, "s"), e["s"] == F.col("s_k")).join(_side(ends, "t"), e["t"] == F.col("t_k"))
    out = e.select(F.col("s_label").alias("source"), F.col("t_label").alias("target"), "confidence", "relation", score.alias("score"), why.alias("why"), "ord")
    out = cut(out.orderBy(F.desc("score"), "ord").limit(n))
    discard(known, classes, scores, *(() if counts is not None else (of,)))
    return out.orderBy(F.desc("score"), "ord")
