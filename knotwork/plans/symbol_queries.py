"""Queries on calls, inheritance and imports of declarations made from the tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import extract, symbols
from ..sources.tables import table

QUERIES: dict = {}
ORACLES: dict = {}
c = F.col


def register(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


def _text(*parts):
    return F.concat(*(c(p[1:]).cast("string") if p.startswith("=") else F.lit(p) for p in parts))


def _functions(spark, d):
    """A file per nation with a function per customer; names repeat."""
    return table(spark, d, "customer").select(c("c_nationkey").cast("string").alias("path"), F.concat(F.lit("@Fn"), c("c_custkey") % 40, F.lit("()")).alias("name"), _text("c_", "=c_custkey").alias("id"))


def _calls(spark, d):
    o, cu = table(spark, d, "orders"), table(spark, d, "customer")
    rows = o.join(cu, o["o_custkey"] == cu["c_custkey"])
    return rows.select(c("c_nationkey").cast("string").alias("path"), _text("c_", "=o_custkey").alias("caller"), _text("s_", "=o_orderkey").alias("site"), F.concat(F.lit("fn"), c("o_orderkey") % 40).alias("callee"), (c("o_orderkey") % 500).alias("line"))


@register("""WITH s AS (SELECT c_nationkey AS p, c_custkey % 40 AS k, min('c_' || c_custkey) AS target FROM customer GROUP BY ALL HAVING count(*) = 1),
f AS (SELECT c_nationkey::VARCHAR AS path, 'c_' || o_custkey AS caller, 's_' || o_orderkey AS site, o_orderkey % 40 AS k, o_orderkey % 500 AS line, target FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN s ON s.p = c_nationkey AND s.k = o_orderkey % 40)
SELECT DISTINCT path, caller AS source, target, 'calls' AS relation, 'STATIC_RESOLVED' AS confidence, 0.8::DOUBLE AS confidence_score, 'call' AS context, line FROM f WHERE target <> caller
UNION ALL SELECT path, site, target, 'resolves_to', 'STATIC_RESOLVED', 0.8, 'call', line FROM f WHERE target <> caller
UNION ALL SELECT path, site, 'unresolved_call_fn' || k, 'unresolved_call', 'AMBIGUOUS', 0.2, 'call_site', line FROM f WHERE target IS NULL OR target = caller""")
def resolve_in_file(spark, d):
    return symbols.resolve_in_file(_functions(spark, d), _calls(spark, d))


def _sites(spark, d):
    return _calls(spark, d).select(c("caller").alias("owner"), "callee", "line", F.substring_index("site", "_", -1).alias("start"))


@register("SELECT 'c_' || o_custkey || '_call_site_fn' || (o_orderkey % 40) || '_' || (o_orderkey % 500) || '_' || o_orderkey AS id, 'fn' || (o_orderkey % 40) || '()' AS label, 'call_site' AS kind, 'fn' || (o_orderkey % 40) AS callee, o_orderkey % 500 AS line FROM orders JOIN customer ON o_custkey = c_custkey")
def call_sites(spark, d):
    return symbols.call_sites(_sites(spark, d))[0]


@register("SELECT 'c_' || o_custkey AS source, 'c_' || o_custkey || '_call_site_fn' || (o_orderkey % 40) || '_' || (o_orderkey % 500) || '_' || o_orderkey AS target, 'contains' AS relation, 'EXTRACTED' AS confidence, 'call_site' AS context, o_orderkey % 500 AS line FROM orders JOIN customer ON o_custkey = c_custkey")
def call_site_edges(spark, d):
    return symbols.call_sites(_sites(spark, d))[1]


def _declarations(spark, d):
    """A class per part whose head names three supertypes; every fourth has its last one beyond the head."""
    far = F.when(c("p_partkey") % 4 == 0, F.repeat(F.lit(" "), 500)).otherwise(F.lit(""))
    text = F.concat(F.lit("class P"), "p_partkey", F.lit(" extends Base"), c("p_partkey") % 60, F.lit(" implements lib.Kind"), c("p_partkey") % 3, far, F.lit(" is Size"), "p_size", F.lit(" { this is x }"))
    return table(spark, d, "part").select(c("p_brand").alias("path"), _text("part_", "=p_partkey").alias("source"), (c("p_partkey") % 60).alias("k"), (c("p_partkey") % 100).alias("line"), F.explode(symbols.supertypes(text)).alias("name"))


_NAMES = """SELECT 'part_' || p_partkey AS source, p_brand AS path, 'Base' || (p_partkey % 60) AS name, p_partkey % 100 AS line FROM part
UNION ALL SELECT 'part_' || p_partkey, p_brand, 'lib.Kind' || (p_partkey % 3), p_partkey % 100 FROM part UNION ALL SELECT 'part_' || p_partkey, p_brand, 'Size' || p_size, p_partkey % 100 FROM part WHERE p_partkey % 4 <> 0"""


@register(f"SELECT source, name FROM ({_NAMES})")
def inherits_scan(spark, d):
    return _declarations(spark, d).select("source", "name")


@register(f"""WITH i AS ({_NAMES}), s AS (SELECT p_brand AS path, 'Base' || (p_partkey % 60) AS name, min('part_' || p_partkey) AS target FROM part GROUP BY ALL HAVING count(*) = 1)
SELECT path, source, t AS target, 'inherits' AS relation, 'inheritance' AS context, line FROM (SELECT i.*, coalesce(target, 'dep_' || replace(lower(name), '.', '_')) AS t FROM i LEFT JOIN s USING (path, name)) WHERE source <> t""")
def resolve_supertypes(spark, d):
    types = table(spark, d, "part").select(c("p_brand").alias("path"), F.concat(F.lit("Base"), c("p_partkey") % 60).alias("name"), _text("part_", "=p_partkey").alias("id"))
    return symbols.resolve_supertypes(types, _declarations(spark, d))


#: Forms of import statements, by syntax kind; ~ is a customer's key, ! an order's.
_IMPORTS = (
    ("import_from_statement", "from ..pkg_~.mod import x", ("pkg_~.mod",)),
    ("import_statement", "import pkg_~ as p, sys! AS q,  os", ("pkg_~", "sys!", "os")),
    ("using_directive", "using Lib~.Core = x;", ("Lib~.Core",)),
    ("use_declaration", "use crate_~::{a, b};", ("crate_~",)),
    ("namespace_use_declaration", "use App\\P~;", ("App\\P~",)),
    ("import_declaration", "import static org.p~.*;", ("org.p~",)),
    ("preproc_include", "#include <p!.h>", ("p!.h",)),
    ("import_statement", 'import x! from "pkg~"', ("pkg~", 'x! from "pkg~"')),
    ("import_directive", "import *", ()),
)


def _imports_sql() -> str:
    fill = lambda x: "replace(replace('" + x + "', '~', o_custkey::VARCHAR), '!', o_orderkey::VARCHAR)"
    context = lambda kind: "include" if "include" in kind else "use" if "us" in kind else "import"
    return " UNION ALL ".join(f"SELECT o_orderkey, '{context(kind)}' AS context, {fill(x)} AS target FROM orders WHERE o_orderkey % {len(_IMPORTS)} = {k}" for k, (kind, _, found) in enumerate(_IMPORTS) for x in found)


@register(_imports_sql())
def import_targets(spark, d):
    o = table(spark, d, "orders")
    form = F.array(*(F.struct(F.lit(kind).alias("kind"), F.lit(text).alias("text")) for kind, text, _ in _IMPORTS))
    rows = o.select("*", F.element_at(form, (c("o_orderkey") % len(_IMPORTS) + 1).cast("int")).alias("f"))
    text = F.replace(F.replace(c("f.text"), F.lit("~"), c("o_custkey").cast("string")), F.lit("!"), c("o_orderkey").cast("string"))
    return rows.select("o_orderkey", symbols.import_context(c("f.kind")).alias("context"), F.explode(symbols.import_targets(c("f.kind"), text)).alias("target"))


@register(r"""SELECT page_id, CASE WHEN m LIKE 'node:%' THEN 'node' WHEN m LIKE '@%' THEN array_to_string(string_split(m, '/')[1:2], '/') ELSE coalesce(nullif(regexp_extract(m, '^[^/.\\]*'), ''), m) END AS package
FROM (SELECT page_id, (['', '@', 'node:', '.', 'a\'])[page_id % 5 + 1] || regexp_replace(url, '^https?://', '') AS m FROM pages)""")
def dependency_root(spark, d):
    start = F.element_at(F.array(*map(F.lit, ("", "@", "node:", ".", "a\\"))), (c("page_id") % 5 + 1).cast("int"))
    module = F.concat(start, F.regexp_replace("url", "^https?://", ""))
    return table(spark, d, "pages").select("page_id", extract.dependency_package(module).alias("package"))


_FILES = (("a.PDF", "paper"), ("b.svg", "image"), ("c.mp3", "video"), ("d.yml", "headings"), ("e.pyw", "python"), ("f.d.ts", "script"), ("g.go", "generic"), ("Makefile", "generic"), (".py", "generic"), ("h.x/i", "generic"), ("j.vue", "script"))


def _file(key):
    return F.concat(F.lit("src/"), key, F.lit("/"), F.element_at(F.array(*(F.lit(x) for x, _ in _FILES)), (key % len(_FILES) + 1).cast("int")))


@register("SELECT p_partkey, CASE p_partkey % 11 WHEN 0 THEN 'paper' WHEN 1 THEN 'image' WHEN 2 THEN 'video' WHEN 3 THEN 'headings' WHEN 4 THEN 'python' WHEN 5 THEN 'script' WHEN 10 THEN 'script' ELSE 'generic' END AS extractor FROM part")
def extract_dispatch(spark, d):
    return table(spark, d, "part").select("p_partkey", symbols.extractor(_file(c("p_partkey"))).alias("extractor"))


@register("SELECT user_id, bool_or(event_id % 11 NOT IN (5, 6, 10)) AS non_code FROM events WHERE event_id % 11 IN (5, 6, 10) OR user_id % 2 = 0 GROUP BY user_id")
def has_non_code_paths(spark, d):
    rows = table(spark, d, "events").where("event_id % 11 in (5, 6, 10) or user_id % 2 = 0")
    return rows.groupBy("user_id").agg(symbols.has_non_code(_file(c("event_id"))).alias("non_code"))
