"""Graph fragments from source text by regular expressions, and resolution of calls across files."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import symbol_base

#: Words before a parenthesis that are no calls.
NO_CALLS = ("if", "for", "while", "switch", "catch", "return", "print", "len", "range", "str", "int", "float", "bool", "dict", "list", "set", "super")


def call_names(body: Column) -> Column:
    """Distinct names before a parenthesis, in order."""
    found = F.regexp_extract_all(F.coalesce(body, F.lit("")), F.lit(r"\b([A-Za-z_][A-Za-z0-9_]*)\s*\("), F.lit(1))
    return F.array_distinct(F.filter(found, lambda x: ~x.isin(list(NO_CALLS))))


def python_imports(files: DataFrame) -> DataFrame:
    """(path, line, module, relation) of import statements of files(path, text)."""
    lines = files.select("path", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("at", "s"))
    plain, from_ = F.regexp_extract("s", r"^\s*import\s+([A-Za-z0-9_.]+)", 1), F.regexp_extract("s", r"^\s*from\s+([A-Za-z0-9_.]+)\s+import\b", 1)
    rows = lines.select("path", (F.col("at") + 1).alias("line"), F.when(plain != "", plain).otherwise(from_).alias("module"), F.when(plain != "", "imports").otherwise("imports_from").alias("relation"))
    return rows.where("module <> ''")


def python_definitions(files: DataFrame) -> DataFrame:
    """(path, line, kind, name, indent) of classes and functions."""
    lines = files.select("path", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("at", "s"))
    rule = r"^(\s*)(class|async def|def)\s+([A-Za-z_][A-Za-z0-9_]*)"
    rows = lines.where(F.rlike("s", F.lit(rule))).select("path", (F.col("at") + 1).alias("line"), F.when(F.regexp_extract("s", rule, 2) == "class", "class").otherwise("function").alias("kind"), F.regexp_extract("s", rule, 3).alias("name"), F.length(F.regexp_extract("s", rule, 1)).alias("indent"))
    return rows


def headings(docs: DataFrame) -> DataFrame:
    """(path, level, label) of Markdown headings of docs(path, text); closing signs are no part of the label."""
    lines = docs.select("path", F.explode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("s"))
    rule = r"^(#{1,6})\s+(.+?)\s*#*\s*$"
    return lines.where(F.rlike("s", F.lit(rule))).select("path", F.length(F.regexp_extract("s", rule, 1)).alias("level"), F.regexp_extract("s", rule, 2).alias("label"))


#: What the name of a syntax node tells of a literal and of a control structure; the first that fits counts.
LITERALS = (
    ("string", "string|char"),
    ("number", "integer|number|float|real"),
    ("boolean", "^true$|^false$|boolean"),
    ("null", "^null$|^nil$|^none$"),
    ("array", "array|list"),
    ("object", "dictionary|hash|map|object"),
    ("set", "set"),
)
CONTROLS = (
    ("branches", "if|switch|case|match|unless"),
    ("loops", "for|while|do_statement"),
    ("handles", "try|catch|except"),
)


def _first_fit(kind: Column, rules, otherwise: Column) -> Column:
    for name, rule in reversed(rules):
        otherwise = F.when(F.rlike(kind, F.lit(rule)), name).otherwise(otherwise)
    return otherwise


def literal_kind(kind: Column) -> Column:
    return _first_fit(kind, LITERALS, kind)


def control_relation(kind: Column) -> Column:
    return _first_fit(kind, CONTROLS, F.lit("control_flow"))


def control_label(kind: Column) -> Column:
    return F.replace(F.regexp_replace(kind, "_statement$|_clause$", ""), F.lit("_"), F.lit(" "))


#: Lines that import, open a type and open a function, in any of the common languages.
IMPORTS = (r"^import\s+[\"']([^\"']+)[\"']", r"^import\s+([\w.*/{} ,]+);?$", r"^using\s+([\w.]+);?", r"^#include\s+[<\"]([^>\"]+)", r"^require\s*\(?[\"']([^\"']+)[\"']\)?", r"^use\s+([\\\w]+);?", r"^package\s+([\w.]+);?")
TYPES = (r"\b(?:class|interface|struct|enum|object|module|trait)\s+([A-Za-z_]\w*)", r"\bnamespace\s+([A-Za-z_][\w.]*)")
FUNCTIONS = (*(rf"\b{word}\s+([A-Za-z_]\w*)\s*\(" for word in ("function", "func", "fn", "def", "sub")), r"^(?:public|private|protected|static|async|override|virtual|final|\w+)\s+([A-Za-z_]\w*)\s*\(")
NO_FUNCTIONS = ("if", "for", "while", "switch", "catch")


def _first_match(line: Column, rules) -> Column:
    found = [F.nullif(F.trim(F.regexp_extract(line, rule, 1)), F.lit("")) for rule in rules]
    return F.coalesce(*found)


def code_lines(files: DataFrame) -> DataFrame:
    """(path, line, kind, name) of the imports, types and functions of files(path, text) in any language, one a line.

    A line is an import and may be a type or a function besides; a type is no function.
    """
    lines = files.select("path", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\r?\n")).alias("at", "raw"))
    s = F.trim("raw")
    lines = lines.select("path", (F.col("at") + 1).alias("line"), _first_match(s, IMPORTS).alias("imports"), _first_match(s, TYPES).alias("type"), _first_match(s, FUNCTIONS).alias("function"))
    function = F.when(F.col("type").isNull() & ~F.col("function").isin(*NO_FUNCTIONS), F.col("function"))
    kinds = F.array(*(F.struct(F.lit(k).alias("kind"), x.alias("name")) for k, x in (("imports", F.col("imports")), ("type", F.col("type")), ("function", function))))
    return lines.select("path", "line", F.explode(F.filter(kinds, lambda x: x["name"].isNotNull())).alias("f")).select("path", "line", "f.*")


def generic_edges(files: DataFrame) -> DataFrame:
    """(source, target, relation, line): what the lines of files in any language import and contain."""
    from ..functions.text import make_id

    rows = code_lines(files)
    here = make_id(F.col("path"))
    name = F.when(F.col("kind") == "type", F.element_at(F.split("name", r"\."), -1)).otherwise(F.col("name"))
    target = F.when(F.col("kind") == "imports", make_id(F.col("name"))).otherwise(make_id(F.col("path"), name))
    return rows.select(here.alias("source"), target.alias("target"), F.when(F.col("kind") == "imports", "imports").otherwise("contains").alias("relation"), "line")


def dependency_package(module: Column) -> Column:
    """The package that an import names."""
    scope = F.array_join(F.slice(F.split(module, "/"), 1, 2), "/")
    root = F.nullif(F.regexp_extract(module, r"^[^/.\\]*", 0), F.lit(""))
    return F.when(F.startswith(module, F.lit("node:")), "node").when(F.startswith(module, F.lit("@")), scope).otherwise(F.coalesce(root, module))


def resolve_import(path: Column, module: Column) -> Column:
    """Relative specifiers become paths, others their last segment."""
    folder = F.regexp_replace(path, "[^/]*$", "")
    local = F.concat(folder, F.regexp_replace(module, r"^\./", ""))
    local = F.when(F.rlike(module, F.lit(r"\.[A-Za-z0-9]+$")), local).otherwise(F.concat(local, F.lit(".ts")))
    return F.when(F.startswith(module, F.lit(".")), local).otherwise(F.element_at(F.split(module, "[/.]"), -1))


def resolve_calls(nodes: DataFrame, edges: DataFrame, calls: DataFrame) -> DataFrame:
    """New calls edges of calls(caller, callee): the callee's name must belong to one node, which is not the caller."""
    names = nodes.groupBy(symbol_base(F.col("label")).alias("name")).agg(F.count(F.lit(1)).alias("n"), F.first("id").alias("target")).where("n = 1")
    found = calls.join(names, F.lower("callee") == F.col("name")).where("caller <> target").select(F.col("caller").alias("source"), "target").distinct()
    known = edges.where("relation = 'calls'").select("source", "target")
    return found.join(known, ["source", "target"], "left_anti").withColumn("relation", F.lit("calls")).withColumn("confidence", F.lit("INFERRED")).withColumn("confidence_score", F.lit(0.6))


_DEF = re.compile(r"^(\s*)(class|async def|def)\s+([A-Za-z_]\w*)\s*(?:\(([^)]*)\))?")


def python_fragment(path: str, text: str) -> tuple[list[dict], list[dict]]:
    """Nodes and edges of one Python file: classes, methods, functions, inheritance and calls by indentation."""
    from ..functions.text_rules import make_id_of

    lines, file_id = text.split("\n"), make_id_of(path)
    nodes = [{"id": file_id, "label": path.rsplit("/", 1)[-1], "line": 1}]
    edges: list[dict] = []
    stack: list[tuple[int, str, str]] = []
    bodies: list[tuple[str, int, int]] = []
    found = [(i, m) for i, s in enumerate(lines) if (m := _DEF.match(s))]
    for at, (i, m) in enumerate(found):
        indent, name = len(m[1]), m[3]
        while stack and stack[-1][0] >= indent:
            stack.pop()
        owner = next((x for x in reversed(stack) if x[2] == "class"), None)
        kind = "class" if m[2] == "class" else "method" if owner else "function"
        ident = make_id_of(owner[1] if owner and kind == "method" else file_id, name)
        label = name if kind == "class" else f".{name}()" if kind == "method" else f"{name}()"
        nodes.append({"id": ident, "label": label, "line": i + 1})
        edges.append({"source": owner[1] if kind == "method" else file_id, "target": ident, "relation": "method" if kind == "method" else "contains", "line": i + 1})
        if kind == "class":
            edges += [{"source": ident, "target": make_id_of(file_id, b.strip()), "relation": "inherits", "line": i + 1} for b in (m[4] or "").split(",") if b.strip()]
        else:
            end = next((j for j, n in found[at + 1 :] if len(n[1]) <= indent), len(lines))
            bodies.append((ident, i + 1, end))
        stack.append((indent, ident, m[2] if m[2] == "class" else "def"))
    by_name = {n["label"].strip(".()").lower(): n["id"] for n in nodes}
    for ident, start, end in bodies:
        for name in dict.fromkeys(re.findall(r"\b([A-Za-z_]\w*)\s*\(", "\n".join(lines[start:end]))):
            if name not in NO_CALLS and (to := by_name.get(name.lower())) and to != ident:
                edges.append({"source": ident, "target": to, "relation": "calls", "line": start})
    ids = {n["id"] for n in nodes}
    return nodes, [e for e in edges if e["target"] in ids or e["relation"].startswith("import")]


def python_fragments(files: DataFrame) -> DataFrame:
    """(path, nodes, edges) of files(path, text); whole files, one at a time in each task."""
    import pandas as pd

    def run(frames):
        for f in frames:
            rows = [(p, *python_fragment(p, t or "")) for p, t in zip(f["path"], f["text"], strict=True)]
            yield pd.DataFrame(rows, columns=["path", "nodes", "edges"])

    return files.select("path", "text").mapInPandas(run, "path string, nodes array<struct<id:string,label:string,line:int>>, edges array<struct<source:string,target:string,relation:string,line:int>>")


