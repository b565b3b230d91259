"""Questions: terms, relevance, contexts, and the text of an answer."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import sanitize_label
from ..sources.tables import cut, within
from .graph import PropertyGraph
from .traverse import bfs

#: Words that hint at the context of an edge.
HINTS = {
    "call": ("call", "calls", "called", "invoke", "invokes", "invoked"),
    "import": ("import", "imports", "imported", "module", "modules"),
    "field": ("field", "fields", "member", "members", "property", "properties"),
    "parameter_type": ("parameter", "parameters", "param", "params", "argument", "arguments"),
    "return_type": ("return", "returns", "returned"),
    "generic_arg": ("generic", "generics", "template", "templates"),
}
EXACT = 100


def fold(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c) and c not in "^`´¨¯·¸").lower()


def folded(x: Column) -> Column:
    """fold() of a column, on the JVM for plain ASCII and in Python for the rest."""

    @F.pandas_udf("string")
    def other(values):
        return values.map(lambda s: None if s is None else fold(s))

    plain = F.rlike(x, F.lit(r"^[\x00-\x7f&&[^\^`]]*$"))
    return F.when(plain, F.lower(x)).otherwise(other(F.when(~plain, x)))


def terms(question: str) -> list[str]:
    return [t.lower() for t in question.split() if len(t) > 2]


def question_terms(question: Column) -> Column:
    return F.filter(F.split(F.lower(question), r"\s+"), lambda t: F.length(t) > 2)


def score_nodes(g: PropertyGraph, words: list[str]) -> DataFrame:
    """(id, score) of nodes with a score above 0: 1 a term in the label, 0.5 in the path, 100 for the exact label."""
    label, source = folded(F.col("label")), F.lower(F.coalesce("source_file", F.lit("")))
    score = F.lit(0.0)
    for t in map(fold, words):
        score = score + F.contains(label, F.lit(t)).cast("double") + F.contains(source, F.lit(t)).cast("double") * 0.5
        score = score + F.when((label == t) | (F.regexp_replace(label, r"\(\)$", "") == t), EXACT).otherwise(0)
    return g.nodes.select("id", "label", score.alias("score")).where("score > 0")


def seeds(g: PropertyGraph, words: list[str], n: int = 3) -> DataFrame:
    return score_nodes(g, words).orderBy(F.desc("score"), F.translate("id", "_", " ")).limit(n)


def infer_contexts(question: Column) -> Column:
    """The contexts that a question's words hint at, comma-separated."""
    words = F.split(F.lower(F.regexp_replace(question, "[?,]", " ")), r"\s+")
    return F.concat_ws(",", *(F.when(F.arrays_overlap(words, F.lit(list(hints)).cast("array<string>")), name) for name, hints in HINTS.items()))


def contexts_of(question: str, explicit: list[str] | None = None) -> tuple[list[str], str | None]:
    given = list(dict.fromkeys(x for x in (fold(f).strip() for f in explicit or []) if x))
    if given:
        return given, "explicit"
    words = {fold(t) for t in question.replace("?", " ").replace(",", " ").split()}
    found = [name for name, hints in HINTS.items() if words & set(hints)]
    return found, "heuristic" if found else None


def answer_lines(g: PropertyGraph, starts: DataFrame, depth: int) -> DataFrame:
    """(part, place, line): NODE lines, seeds first and then by degree; EDGE lines by level."""
    visited, steps = bfs(g, starts, depth)
    first = starts.withColumn("k", F.row_number().over(Window.orderBy(F.desc("score"), F.translate("id", "_", " "))))  # the seeds
    visited = cut(visited)
    n = cut(g.degree_of(visited, few=True)).join(g.nodes, "id").join(first.select("id", "k"), "id", "left")
    line = F.concat(F.lit("NODE "), sanitize_label(F.col("label")), F.lit(" [src="), F.coalesce("source_file", F.lit("")), F.lit("]"))
    nodes = n.select(F.lit(0).alias("part"), F.concat_ws("|", F.lpad(F.coalesce("k", F.lit(999)).cast("string"), 3, "0"), F.lpad((10**9 - F.col("degree")).cast("string"), 10, "0"), "ord").alias("place"), line.alias("line"))
    name = lambda p: g.nodes.select(F.col("id").alias(p), sanitize_label(F.col("label")).alias(f"{p}_label"), F.col("ord").alias(f"{p}_ord"))
    steps = cut(steps)
    some = within(steps.select(F.xxhash64("source", "target").alias("h")))
    ways = g.directions().where(some(F.xxhash64("id", "nbr")))
    e = steps.join(ways.select(F.col("id").alias("source"), F.col("nbr").alias("target"), "relation", "confidence", "context"), ["source", "target"]).join(name("source"), "source").join(name("target"), "target")
    about = F.concat("confidence", F.when(F.col("context").isNotNull(), F.concat(F.lit(" context="), "context")).otherwise(""))
    text = F.concat(F.lit("EDGE "), "source_label", F.lit(" --"), "relation", F.lit(" ["), about, F.lit("]--> "), "target_label")
    return nodes.union(e.select(F.lit(1), F.concat_ws("|", F.col("level").cast("string"), "source_ord", "target_ord"), text))


def within_budget(lines: DataFrame, tokens: int) -> DataFrame:
    """One row: the lines in order, cut after 3 characters a token."""
    most = 3 * tokens
    near = lines.orderBy("part", "place").limit(most)  # a line has a character at least
    text = near.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "place", "line"))), lambda x: x["line"]), "\n").alias("t"))
    return text.select(F.when(F.length("t") > most, F.concat(F.substring("t", 1, most), F.lit(f"\n... (truncated to ~{tokens} token budget)"))).otherwise(F.col("t")).alias("answer"))


def query_graph(g: PropertyGraph, question: str, depth: int = 3, tokens: int = 2000, contexts: list[str] | None = None) -> DataFrame:
    found = seeds(g, terms(question))
    first = found.collect()  # at most 3 rows
    spark = g.nodes.sparkSession
    if not first:
        return spark.createDataFrame([("No matching nodes found.",)], "answer string")
    names, origin = contexts_of(question, contexts)
    sub = g.with_context(*names)
    starts = spark.createDataFrame(first, found.schema)
    visited, _ = bfs(sub, starts, depth)
    import json

    head = [f"Traversal: BFS depth={depth}", f"Start: {json.dumps([r['label'] for r in first], separators=(',', ':'), ensure_ascii=False)}"]
    head += [f"Context: {', '.join(names)} ({origin})"] if names else []
    head += [f"{visited.count()} nodes found"]
    return within_budget(answer_lines(sub, starts, depth), tokens).select(F.concat(F.lit(" | ".join(head) + "\n\n"), "answer").alias("answer"))
