"""Calls, inheritance and imports of declarations: call sites, resolution inside one file, targets of import statements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import extension, make_id, normalize_symbol
from ..sources.scan import EXTENSIONS

#: Files with an extractor of their own.
PYTHON = (".py", ".pyw")
SCRIPTS = (".js", ".jsx", ".mjs", ".ts", ".tsx", ".vue", ".svelte")
#: A declaration's head, in which inheritance is looked for, has so many characters.
HEAD = 500
SUPERTYPES = r"\b(?:extends|implements|is|<:)\s+([A-Za-z_][\w.]+)"


def extractor(path: Column) -> Column:
    """Which extractor a file goes to, by its extension: a single node, headings, or one of the code extractors."""
    ext, out = extension(path), None
    rules = [(kind, EXTENSIONS[kind]) for kind in ("paper", "image", "video")] + [("headings", EXTENSIONS["document"]), ("python", PYTHON), ("script", SCRIPTS)]
    for kind, among in rules:
        out = (F if out is None else out).when(ext.isin(list(among)), kind)
    return out.otherwise("generic")


def has_non_code(path: Column) -> Column:
    """Aggregate: whether any of the paths is no code file."""
    return F.coalesce(F.bool_or(~extension(path).isin(list(EXTENSIONS["code"]))), F.lit(False))


def supertypes(declaration: Column) -> Column:
    """What the head of a declaration extends or implements, in order."""
    return F.regexp_extract_all(F.substring(F.coalesce(declaration, F.lit("")), 1, HEAD), F.lit(SUPERTYPES), F.lit(1))


def import_targets(kind: Column, statement: Column) -> Column:
    """Distinct targets of an import statement of a syntax kind: what is quoted, then what the kind's form names."""
    s = F.trim(F.coalesce(statement, F.lit("")))
    rest = lambda rule: F.trim(F.regexp_extract(s, rule, 1))
    one = lambda x: F.array(x)
    listed = F.transform(F.split(rest(r"^import\s+(.+)"), ","), lambda x: F.regexp_replace(F.trim(x), r"(?is)\s+as\s+.*$", ""))
    named = (
        F.when(kind == "import_from_statement", one(F.regexp_replace(rest(r"^from\s+([.\w]+)"), r"^\.+", "")))
        .when(kind == "import_statement", listed)
        .when(kind == "using_directive", one(rest(r"^using\s+([^=;]+)")))
        .when(kind.isin("use_declaration", "use_statement"), one(F.element_at(F.split(F.regexp_replace(F.regexp_extract(s, r"^use\s+([^;]+)", 1), "[{}]", ""), r"[,:\s]+"), 1)))
        .when(kind == "namespace_use_declaration", one(rest(r"^use\s+([^;]+)")))
        .when(kind.isin("import_declaration", "import_directive"), one(F.regexp_replace(F.regexp_extract(s, r"^import\s+(?:static\s+)?([^;]+)", 1), r"\.\*$", "")))
        .when(kind.isin("preproc_include", "preproc_import"), one(rest(r"[<\"]([^>\"]+)[>\"]")))
        .otherwise(F.array().cast("array<string>"))
    )
    quoted = F.regexp_extract_all(s, F.lit(r"[\"'<]([^\"'>\n]+)[\"'>]"), F.lit(1))
    return F.array_distinct(F.filter(F.transform(F.concat(quoted, named), lambda x: F.trim(x)), lambda x: (x != "") & (x != "*")))


def import_context(kind: Column) -> Column:
    return F.when(F.contains(kind, F.lit("include")), "include").when(F.contains(kind, F.lit("use")) | F.contains(kind, F.lit("using")), "use").otherwise("import")


def call_sites(calls: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, label, kind, callee, line) and contains edges of the sites of calls(owner, callee, line, start)."""
    sites = calls.withColumn("id", make_id(F.col("owner"), F.lit("call_site"), F.col("callee"), F.col("line").cast("string"), F.col("start").cast("string")))
    nodes = sites.select("id", F.concat("callee", F.lit("()")).alias("label"), F.lit("call_site").alias("kind"), "callee", "line").dropDuplicates(["id"])
    edges = sites.select(F.col("owner").alias("source"), F.col("id").alias("target"), F.lit("contains").alias("relation"), F.lit("EXTRACTED").alias("confidence"), F.lit("call_site").alias("context"), "line")
    return nodes, edges.distinct()


def _unique(symbols: DataFrame) -> DataFrame:
    """path, key, target: the names of symbols(path, name, id) that stand for one id in their file."""
    named = symbols.select("path", normalize_symbol(F.col("name")).alias("key"), "id").where("key <> ''")
    return named.groupBy("path", "key").agg(F.min("id").alias("target"), F.max("id").alias("last")).where("target = last").drop("last")


def resolve_in_file(symbols: DataFrame, calls: DataFrame) -> DataFrame:
    """(path, source, target, relation, confidence, confidence_score, context, line) of calls(path, caller, site, callee, line).

    A callee that names one symbol of its file, other than the caller, gives a calls and a resolves_to edge; any other
    an unresolved one, which calls across files may still settle.
    """
    found = calls.withColumn("key", normalize_symbol(F.col("callee"))).join(_unique(symbols), ["path", "key"], "left")
    edge = lambda source, target, relation, confidence, score, context: F.struct(source.alias("source"), target.alias("target"), F.lit(relation).alias("relation"), F.lit(confidence).alias("confidence"), F.lit(score).alias("confidence_score"), F.lit(context).alias("context"))
    site, target = F.col("site"), F.col("target")
    known = F.array(edge(F.col("caller"), target, "calls", "STATIC_RESOLVED", 0.8, "call"), edge(site, target, "resolves_to", "STATIC_RESOLVED", 0.8, "call"))
    unknown = F.array(edge(site, make_id(F.lit("unresolved"), F.lit("call"), F.col("callee")), "unresolved_call", "AMBIGUOUS", 0.2, "call_site"))
    edges = F.when(target.isNotNull() & (target != F.col("caller")), known).otherwise(unknown)
    return found.select("path", F.explode(edges).alias("e"), "line").select("path", "e.*", "line").distinct()


def resolve_supertypes(symbols: DataFrame, inherits: DataFrame) -> DataFrame:
    """(path, source, target, relation, context, line) of inherits(path, source, name, line): a name of one symbol of the
    file is that symbol, any other an external type; nothing inherits from itself."""
    found = inherits.withColumn("key", normalize_symbol(F.col("name"))).join(_unique(symbols), ["path", "key"], "left")
    target = F.coalesce("target", make_id(F.lit("dep"), F.col("name")))
    edges = found.select("path", "source", target.alias("target"), F.lit("inherits").alias("relation"), F.lit("inheritance").alias("context"), "line")
    return edges.where("source <> target").distinct()
