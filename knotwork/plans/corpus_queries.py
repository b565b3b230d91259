"""Scanning, extraction, ingest, scalar and streaming queries over the driver's tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import analyze, extract, query
from ..sources import scan
from ..sources.tables import table
from ..streaming import changes

QUERIES: dict = {}
ORACLES: dict = {}


def register(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def scalar(name: str, source: str, key: str, expression, sql: str) -> None:
    """A query that applies one function to a column of a whole table."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        return table(spark, d, source).select(*key.split(", "), expression().alias("value"))

    run.__name__ = name
    QUERIES[name], ORACLES[name] = run, f"SELECT {key}, {sql} AS value FROM {source}"


_N = "lower(regexp_replace(regexp_replace({}, '[^a-zA-Z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'))"
_E = "replace(replace(replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')"
_HOST, _PATH = "lower(regexp_extract(url, '://([^/?#:]*)', 1))", "regexp_extract(url, '://[^/?#]*([^?#]*)', 1)"
c = F.col


def _nth(values, key: str):
    """One of the values by turns, by a column of numbers."""
    return F.element_at(F.lit(list(values)).cast("array<string>"), (c(key) % len(values) + 1).cast("int"))


scalar("fn_make_id", "part", "p_partkey", lambda: text.make_id(F.concat(F.lit("_"), c("p_name")), F.lit(""), F.concat(c("p_brand"), F.lit("."))), _N.format("p_name || '_' || p_brand"))
scalar("fn_normalize_id", "customer", "c_custkey", lambda: text.normalize_id(c("c_name")), _N.format("c_name"))
scalar("fn_sanitize_label", "documents", "doc_id", lambda: text.sanitize_label(c("text")), "substring(regexp_replace(text, '[\\x00-\\x1f\\x7f]', '', 'g'), 1, 256)")
scalar("fn_file_stem", "part", "p_partkey", lambda: text.file_stem(F.concat(F.lit("supply/"), c("p_brand"), F.lit(".java"))), "'supply.' || p_brand")
scalar("fn_posix_path", "part", "p_partkey", lambda: text.posix_path(F.concat(c("p_brand"), F.lit("\\"), c("p_name"))), "p_brand || '/' || p_name")
scalar("fn_line_number", "documents", "doc_id", lambda: text.line_of_offset(c("text"), F.lit(500)), "1 + length(substring(text, 1, 500)) - length(replace(substring(text, 1, 500), chr(10), ''))")
scalar("fn_md5", "documents", "doc_id", lambda: F.md5("text"), "md5(text)")
scalar("fn_content_hash", "documents", "doc_id", lambda: F.sha2(F.concat(c("text"), F.lit("\0"), c("source")), 256), "sha256(text || chr(0) || source)")
scalar("fn_count_words", "documents", "doc_id", lambda: text.count_words(c("text")), "len(regexp_extract_all(text, '\\S+'))")
scalar("fn_escape_html", "pages", "page_id", lambda: text.escape_html(c("html")), _E.format("html"))
scalar("fn_safe_community_name", "pages", "page_id", lambda: text.safe_community_name(c("url")), "trim(regexp_replace(url, '[\\\\/*?:\"<>|#^\\[\\]]', '', 'g'))")
scalar("fn_wiki_file_name", "pages", "page_id", lambda: text.wiki_file_name(c("url")), "substring(regexp_replace(regexp_replace(translate(url, '/ :', '-_-'), '[<>\"\\\\|?*]', '_', 'g'), '[. ]+$', ''), 1, 200)")
scalar("fn_canvas_name", "part", "p_partkey", lambda: text.canvas_name(F.concat(c("p_name"), F.lit("#a.md"))), "substring(regexp_replace(p_name || 'a', '[\\\\/*?:\"<>|#^\\[\\]]', '', 'g'), 1, 180)")
scalar("fn_url_file_name", "pages", "page_id", lambda: text.url_file_name(c("url"), ".md"), f"substring(regexp_replace(regexp_replace(regexp_replace({_HOST} || coalesce(nullif({_PATH}, ''), '/'), '[^A-Za-z0-9_-]', '_', 'g'), '_+', '_', 'g'), '^_+|_+$', '', 'g'), 1, 80) || '.md'")
scalar("fn_yaml_string", "documents", "doc_id", lambda: text.yaml_string(c("text")), "regexp_replace(replace(replace(text, '\\', '\\\\'), '\"', '\\\"'), '\\r?\\n', ' ', 'g')")
scalar("fn_cypher_escape", "documents", "doc_id", lambda: text.cypher_escape(c("text")), "replace(replace(text, '\\', '\\\\'), '''', '\\''')")
scalar("fn_url_type", "pages", "page_id", lambda: text.url_type(c("url")), f"CASE WHEN contains(lower(url), 'twitter.com') OR contains(lower(url), 'x.com') THEN 'tweet' WHEN contains(lower(url), 'arxiv.org') THEN 'arxiv' WHEN contains(lower(url), 'github.com') THEN 'github' WHEN contains(lower(url), 'youtu.be') OR contains(lower(url), 'youtube.com') THEN 'youtube' WHEN {_PATH} LIKE '%.pdf' THEN 'pdf' ELSE 'webpage' END")
_H = "regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', '', 'g'), '(?is)<style[^>]*>.*?</style>', '', 'g')"
for _n in range(1, 7):
    _H = f"regexp_replace({_H}, '(?is)<h{_n}[^>]*>\\s*(.*?)\\s*</h{_n}>', '{'#' * _n} \\1' || chr(10) || chr(10), 'g')"
for _a, _b in (("(?i)<p[^>]*>", "chr(10) || chr(10)"), ("(?i)<br\\s*/?>", "chr(10)"), ("<[^>]+>", "' '"), ("&nbsp;", "' '"), ("&amp;", "'&'"), ("&lt;", "'<'"), ("&gt;", "'>'"), ("\\s+\\n", "chr(10)"), ("\\n{3,}", "chr(10) || chr(10)"), ("[ \\t]{2,}", "' '"), ("^\\s+|\\s+$", "''")):
    _H = f"regexp_replace({_H}, '{_a}', {_b}, 'g')"
scalar("fn_strip_html", "pages", "page_id", lambda: text.strip_html(c("html")), _H)
scalar("fn_page_title", "pages", "page_id", lambda: text.page_title(c("html")), "trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\\s+', ' ', 'g'))")
scalar("fn_body_content", "documents", "doc_id", lambda: text.body_content(F.concat(F.lit("---\nlang: "), c("lang"), F.lit("\n---\n"), c("text"))), "chr(10) || text")
scalar("fn_compact_text", "documents", "doc_id", lambda: text.compact_text(c("text")), "substring(trim(regexp_replace(text, '\\s+', ' ', 'g')), 1, 80)")
scalar("fn_symbol_base", "orders", "o_orderkey", lambda: text.symbol_base(F.concat(F.lit(".Order_"), c("o_orderkey"), F.lit("()"))), "'order_' || o_orderkey")
scalar("fn_question_slug", "conversations", "conv_id, turn", lambda: text.question_slug(c("text")), "substring(regexp_replace(regexp_replace(lower(text), '[^A-Za-z0-9_]', '_', 'g'), '^_+|_+$', '', 'g'), 1, 50)")
scalar("fn_is_url", "pages", "page_id", lambda: text.is_url(c("url")), "url LIKE 'http://%' OR url LIKE 'https://%'")
_HOSTS = {"10.0.0.1": 1, "fdic.gov": 0, "10.example.com": 0, "172.16.0.1": 1, "172.32.0.1": 0, "fd00::1": 1, "fe80::1": 1, "::1": 1, "0.0.0.0": 0, "192.168.1.1": 1, "127.9.9.9": 1, "8.8.8.8": 0, "169.254.1.1": 1, "fc.org": 0, "10.0.0.256": 0}
scalar("fn_private_ip", "customer", "c_custkey", lambda: text.private_ip(_nth(_HOSTS, "c_custkey")), f"{list(_HOSTS.values())}[c_custkey % {len(_HOSTS)} + 1] = 1")
scalar("token_estimate", "documents", "doc_id", lambda: F.greatest(F.lit(1), F.floor(F.length("text") / 4)), "greatest(1, length(text) // 4)")
scalar("paper_signals", "documents", "doc_id", lambda: scan.paper_signals(c("text")), " + ".join(f"regexp_matches(substring(text, 1, 3000), '{p}')::INT" for p in scan.PAPER_SIGNALS))
_URLS = {"http://fdic.gov/a": 1, "https://10.0.0.1/": 0, "ftp://a.org": 0, "http://[fd00::1]:80/x": 0, "http://user@127.0.0.1/": 0, "http://metadata.google.internal/v1": 0, "https://10.example.com/": 1, "http://a.org:8080/?q=10.0.0.1": 1, "file:///etc/passwd": 0}
scalar("url_guard", "customer", "c_custkey", lambda: text.may_fetch(_nth(_URLS, "c_custkey")), f"{list(_URLS.values())}[c_custkey % {len(_URLS)} + 1] = 1")
scalar("url_guard_pages", "pages", "page_id", lambda: text.may_fetch(c("url")), "url LIKE 'http://%' OR url LIKE 'https://%'")
scalar("call_names", "pages", "page_id", lambda: F.size(extract.call_names(c("html"))), "len(list_distinct(list_filter(regexp_extract_all(html, '\\b([A-Za-z_][A-Za-z0-9_]*)\\s*\\(', 1), lambda x: x NOT IN (" + ", ".join(map(repr, extract.NO_CALLS)) + "))))")
scalar("infer_context", "conversations", "conv_id, turn", lambda: query.infer_contexts(c("text")), "concat_ws(',', " + ", ".join(f"CASE WHEN list_has_any(regexp_split_to_array(lower(regexp_replace(text, '[?,]', ' ', 'g')), '\\s+'), {list(v)}) THEN '{k}' END" for k, v in query.HINTS.items()) + ")")
scalar("question_terms", "conversations", "conv_id, turn", lambda: F.array_join(query.question_terms(c("text")), " "), "array_to_string(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: length(x) > 2), ' ')")
scalar("dependency_package", "pages", "page_id", lambda: extract.dependency_package(F.regexp_replace("url", "^https?://", "@")), "CASE WHEN split_part(regexp_replace(url, '^https?://', '@'), '/', 2) <> '' THEN split_part(regexp_replace(url, '^https?://', '@'), '/', 1) || '/' || split_part(regexp_replace(url, '^https?://', '@'), '/', 2) ELSE split_part(regexp_replace(url, '^https?://', '@'), '/', 1) END")
_KINDS = {"string_literal": "string", "char": "string", "integer": "number", "real_literal": "number", "true": "boolean", "null": "null", "nil": "null", "none": "null", "array": "array", "list_literal": "array", "dictionary": "object", "hash": "object", "set": "set", "regex": "regex", "true_thing": "true_thing"}
scalar("literal_kind", "events", "event_id", lambda: extract.literal_kind(_nth(_KINDS, "event_id")), f"{list(_KINDS.values())}[event_id % {len(_KINDS)} + 1]")
_FORMS = {"if_statement": "branches", "match_expression": "branches", "unless": "branches", "switch_case": "branches", "while_statement": "loops", "do_statement": "loops", "foreach": "loops", "try_statement": "handles", "except_clause": "handles", "with": "control_flow", "conditional": "control_flow"}
scalar("control_relation", "events", "event_id", lambda: extract.control_relation(_nth(_FORMS, "event_id")), f"{list(_FORMS.values())}[event_id % {len(_FORMS)} + 1]")
scalar("control_label", "events", "event_id", lambda: extract.control_label(_nth(_FORMS, "event_id")), f"replace(regexp_replace({list(_FORMS)}[event_id % {len(_FORMS)} + 1], '_statement$|_clause$', ''), '_', ' ')")
scalar("fn_clean_identifier", "part", "p_partkey", lambda: text.clean_identifier(F.concat(F.lit("@$"), c("p_name"), F.lit(" (x);\ny"))), "trim(p_name)")
scalar("fn_normalize_symbol", "part", "p_partkey", lambda: text.normalize_symbol(F.concat(F.lit("@."), c("p_brand"), F.lit("()"))), "lower(p_brand)")
scalar("budget_cut", "documents", "doc_id", lambda: text.budget_cut(c("text"), 100), "CASE WHEN length(text) > 300 THEN substring(text, 1, 300) || chr(10) || '... (truncated to ~100 token budget)' ELSE text END")
scalar("depth_clamp", "lineitem", "l_orderkey, l_linenumber", lambda: text.clamp_depth(F.when(c("l_linenumber") < 7, c("l_linenumber") * 2)), "CASE WHEN l_linenumber < 7 THEN least(l_linenumber * 2, 6) ELSE 3 END")
scalar("hop_limit", "lineitem", "l_orderkey, l_linenumber", lambda: text.within_hops(c("l_linenumber") * 2, F.when(c("l_linenumber") % 2 == 0, c("l_linenumber")), F.lit("found")), "CASE WHEN l_linenumber * 2 > CASE WHEN l_linenumber % 2 = 0 THEN l_linenumber ELSE 8 END THEN 'Path exceeds max_hops=' || CASE WHEN l_linenumber % 2 = 0 THEN l_linenumber ELSE 8 END || ' (' || l_linenumber * 2 || ' hops found).' ELSE 'found' END")
_PLACES = {"/out/graph.json": 1, "/out/../etc/passwd": 0, "/out": 1, "/outer/x": 0, "/out/a/../b": 1, "/a/../out//./x": 1, "/../../out/x": 1, "/out/a/../../..": 0}
scalar("path_guard", "pages", "page_id", lambda: text.inside(_nth(_PLACES, "page_id"), "/out"), f"{list(_PLACES.values())}[page_id % {len(_PLACES)} + 1] = 1")
scalar("import_resolve", "part", "p_partkey", lambda: extract.resolve_import(F.concat(F.lit("supply/"), c("p_brand"), F.lit(".ts")), F.when(c("p_partkey") % 2 == 0, F.lit("./util")).otherwise("lib/tool")), "CASE WHEN p_partkey % 2 = 0 THEN 'supply/util.ts' ELSE 'tool' END")
scalar("llm_cost", "documents", "doc_id", lambda: F.col("n_chars") / 4 / 1e6 * 3 + 500 / 1e6 * 15, "n_chars / 4 / 1e6 * 3 + 500 / 1e6 * 15")

_PATHS = ("supply/node_modules/a.js", "src/app.py", ".env", "keys/server.pem", "docs/readme.md", "paper.pdf", "icon.imageset/x.pdf", "yarn.lock", "my_venv/x.py", "view.blade.php", "clip.mp4", "a/token_store.ts", "sheet.xlsx", "img/a.png", "Makefile")
_CASES = "(SELECT page_id, CASE page_id % 15 " + " ".join(f"WHEN {i} THEN '{p}'" for i, p in enumerate(_PATHS)) + " END AS path FROM pages)"


def _cases(spark, d):
    out = F.lit(None).cast("string")
    for i, p in enumerate(_PATHS):
        out = F.when(c("page_id") % len(_PATHS) == i, p).otherwise(out)
    return table(spark, d, "pages").select("page_id", out.alias("path"))


def _paths(name: str, expression, sql: str) -> None:
    QUERIES[name] = lambda spark, d: _cases(spark, d).select("page_id", expression(c("path")).alias("value"))
    ORACLES[name] = f"SELECT page_id, {sql} AS value FROM {_CASES}"


_which = lambda *i: f"page_id % 15 IN ({', '.join(map(str, i))})"
_paths("noise_dir_filter", scan.is_noise, _which(0, 8))
_paths("lockfile_filter", scan.is_lock_file, _which(7))
_paths("sensitive_split", scan.is_sensitive, _which(2, 3, 11))
_paths("classify_files", scan.classify, "CASE WHEN " + _which(0, 1, 8, 9, 11) + " THEN 'code' WHEN " + _which(4, 12) + " THEN 'document' WHEN " + _which(5) + " THEN 'paper' WHEN " + _which(13) + " THEN 'image' WHEN " + _which(10) + " THEN 'video' END")
_paths("ignore_rules", lambda p: scan.ignored(p, ["*.md", "docs/**", "!docs/readme.md", "# note", "img/", "?ey*/*"]), _which(3, 13))
_paths("file_category", lambda p: analyze.file_category(p), "CASE WHEN " + _which(0, 1, 8, 9, 11) + " THEN 'code' WHEN " + _which(5, 6) + " THEN 'paper' WHEN " + _which(13) + " THEN 'image' ELSE 'doc' END")
_paths("cross_language", lambda p: analyze.cross_language(p, F.lit("x.py")), _which(0, 9, 11))


@register("SELECT doc_id, source || '/' || doc_id || '.txt' AS path, 'document' AS ftype, len(regexp_extract_all(text, '\\S+')) AS words FROM documents")
def detect_files(spark, d):
    docs = table(spark, d, "documents").withColumn("path", F.concat("source", F.lit("/"), "doc_id", F.lit(".txt")))
    kept = docs.where(~scan.is_noise(c("path")) & ~scan.is_lock_file(c("path")) & ~scan.is_sensitive(c("path")))
    return kept.select("doc_id", "path", scan.classify(c("path")).alias("ftype"), text.count_words(c("text")).alias("words"))


@register("SELECT doc_id, len(regexp_extract_all(text, '\\S+')) AS words FROM documents")
def word_counts(spark, d):
    return scan.word_counts(table(spark, d, "documents"))


@register("SELECT n_files, n_words, CASE WHEN n_words < 50000 THEN 'small' WHEN n_words >= 500000 OR n_files >= 200 THEN 'large' ELSE 'medium' END AS verdict, n_words >= 50000 AS needs_graph FROM (SELECT count(*) AS n_files, sum(len(regexp_extract_all(text, '\\S+')))::BIGINT AS n_words FROM documents)")
def corpus_verdict(spark, d):
    return scan.verdict(scan.word_counts(table(spark, d, "documents")))


@register("SELECT page_id, path FROM " + _CASES + " WHERE " + _which(0, 1, 8, 9, 11))
def code_files(spark, d):
    return _cases(spark, d).where(scan.classify(c("path")) == "code")


@register("SELECT doc_id, doc_id % 3 = 0 AS code FROM documents")
def shebang_code(spark, d):
    docs = table(spark, d, "documents").withColumn("t", F.concat(F.when(c("doc_id") % 3 == 0, "#!/usr/bin/env python\n").otherwise("x"), "text"))
    return docs.select("doc_id", scan.is_shebang(c("t")).alias("code"))


@register("SELECT bool_or(event_type NOT IN ('click', 'view')) AS non_code, user_id FROM events GROUP BY user_id")
def has_non_code(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.bool_or(~c("event_type").isin("click", "view")).alias("non_code"))


def _manifest(spark, d):
    e = table(spark, d, "events")
    last = lambda df: df.groupBy(c("user_id").alias("path")).agg(F.max("ts").alias("mtime"), F.md5(F.max_by("props", F.struct("ts", "event_id"))).alias("hash"))
    return last(e.where("user_id % 10 <> 3")), last(e.where("ts < timestamp'2024-01-15' and user_id % 10 <> 4"))


_LAST = "(SELECT user_id AS path, max(ts) AS mtime, md5(arg_max(props, {{'t': ts, 'e': event_id}})) AS hash FROM events WHERE {} GROUP BY 1)"


@register(f"SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'deleted' WHEN b.path IS NULL THEN 'new' WHEN a.mtime = b.mtime OR a.hash = b.hash THEN 'unchanged' ELSE 'changed' END AS state FROM {_LAST.format('user_id % 10 <> 3')} a FULL JOIN {_LAST.format('ts < TIMESTAMP ' + chr(39) + '2024-01-15' + chr(39) + ' AND user_id % 10 <> 4')} b ON a.path = b.path")
def incremental_diff(spark, d):
    return scan.incremental_diff(*_manifest(spark, d))


@register(f"SELECT path, hash FROM {_LAST.format('user_id % 10 <> 3')} WHERE hash NOT IN (SELECT hash FROM {_LAST.format('ts < TIMESTAMP ' + chr(39) + '2024-01-15' + chr(39) + ' AND user_id % 10 <> 4')})")
def cache_probe(spark, d):
    now, known = _manifest(spark, d)
    return now.join(known.select("hash").distinct(), "hash", "left_anti").select("path", "hash")


@register("SELECT md5(text) AS hash FROM documents UNION SELECT md5(text) FROM benchmark UNION SELECT md5(html) FROM pages")
def cached_hashes(spark, d):
    h = lambda t, x: table(spark, d, t).select(F.md5(x).alias("hash"))
    return h("documents", "text").union(h("benchmark", "text")).union(h("pages", "html")).distinct()


@register("SELECT path, mtime, event_id AS order_, CASE WHEN n = 1 THEN 'added' WHEN hash IS DISTINCT FROM b THEN 'changed' ELSE 'same' END AS change FROM (SELECT user_id AS path, ts AS mtime, event_id, props AS hash, lag(props) OVER w AS b, row_number() OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))")
def change_feed(spark, d):
    e = table(spark, d, "events")
    return changes.change_feed(e.select(c("user_id").alias("path"), c("ts").alias("mtime"), c("event_id").alias("order_"), c("props").alias("hash")))


@register("""SELECT path, min(ts) AS start, max(ts) AS "end", count(*) AS n, arg_max(event_type, {'t': ts, 'e': event_id}) AS last FROM (SELECT *, user_id AS path, sum(new_) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s
FROM (SELECT *, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 1 HOUR THEN 1 ELSE 0 END AS new_ FROM events)) GROUP BY path, s""")
def debounce_sessions(spark, d):
    e = table(spark, d, "events").select(c("user_id").alias("path"), c("ts").alias("mtime"), c("event_id").alias("order_"), c("event_type").alias("kind"))
    return changes.debounce(e, "1 hour")


@register("SELECT conv_id, turn, q.text AS question, a.text AS answer FROM conversations q JOIN (SELECT conv_id, turn - 1 AS turn, text FROM conversations WHERE role = 'assistant') a USING (conv_id, turn) WHERE role = 'user'")
def qa_notes(spark, d):
    t = table(spark, d, "conversations")
    a = t.where("role = 'assistant'").select("conv_id", (c("turn") - 1).alias("turn"), c("text").alias("answer"))
    return t.where("role = 'user'").select("conv_id", "turn", c("text").alias("question")).join(a, ["conv_id", "turn"])


@register(f"SELECT page_id, name || CASE WHEN k > 1 THEN '_' || k ELSE '' END || '.md' AS file FROM (SELECT page_id, name, row_number() OVER (PARTITION BY name ORDER BY page_id) AS k FROM (SELECT page_id, {_N.format(_HOST)} AS name FROM pages))")
def ingest_pages(spark, d):
    p = table(spark, d, "pages").select("page_id", text.normalize_id(F.lower(F.regexp_extract("url", "://([^/?#:]*)", 1))).alias("name"))
    k = F.row_number().over(Window.partitionBy("name").orderBy("page_id"))
    return p.withColumn("k", k).select("page_id", F.concat("name", F.when(c("k") > 1, F.concat(F.lit("_"), "k")).otherwise(""), F.lit(".md")).alias("file"))


@register("SELECT p_partkey, level, CASE level WHEN 1 THEN p_name WHEN 2 THEN p_brand ELSE 'Size ' || p_size END AS label FROM part, (VALUES (1), (2), (6)) v(level)")
def doc_headings(spark, d):
    lines = [F.lit("# "), "p_name", F.lit(" ##\ntext # no heading\n##  "), "p_brand", F.lit("  \n####### seven\n#none\n###### Size "), "p_size"]
    docs = table(spark, d, "part").select(c("p_partkey").alias("path"), F.concat(*lines).alias("text"))
    return extract.headings(docs).withColumnRenamed("path", "p_partkey")


@register("""SELECT 'src_p' || p_partkey AS source, target, relation, line FROM part, LATERAL (VALUES ('lib_' || lower(regexp_replace(p_brand, '[^A-Za-z0-9]+', '_', 'g')), 'imports', 1), ('src_p' || p_partkey || '_part' || p_partkey, 'contains', 3), ('src_p' || p_partkey || '_price', 'contains', 4), ('src_p' || p_partkey || '_inner', 'contains', 8)) v(target, relation, line)""")
def generic_extract(spark, d):
    body = [F.lit("import 'lib/"), "p_brand", F.lit("'\n\nclass Part"), "p_partkey", F.lit(" {\n  function price(x) {\n    if (x) return 1\n  }\n}\nnamespace a.b.inner\n")]
    files = table(spark, d, "part").select(F.concat(F.lit("src/p"), "p_partkey").alias("path"), F.concat(*body).alias("text"))
    return extract.generic_edges(files)


def _sources(spark, d):
    p = table(spark, d, "part")
    src = F.concat(F.lit("import os\nfrom lib."), F.lower("p_brand"), F.lit(" import tool\n\nclass Part(Base):\n    def size(self):\n        return helper(1)\n\ndef helper(x):\n    return x\n"))
    return p.select(F.concat(F.lit("supply/part_"), "p_partkey", F.lit(".py")).alias("path"), src.alias("text"))


@register("SELECT 'supply/part_' || p_partkey || '.py' AS path, line, module, relation FROM part, (VALUES (1, 'os', 'imports'), (2, NULL, 'imports_from')) v(line, m, relation), LATERAL (SELECT coalesce(m, 'lib.' || regexp_extract(lower(p_brand), '^[a-z0-9_.]+')) AS module)")
def py_imports(spark, d):
    return extract.python_imports(_sources(spark, d).withColumn("text", F.regexp_replace("text", r"lib\.([a-z0-9_.]+)[^ ]*", r"lib.$1")))


@register("SELECT 'supply/part_' || p_partkey || '.py' AS path, line, kind, name, indent FROM part, (VALUES (4, 'class', 'Part', 0), (5, 'function', 'size', 4), (8, 'function', 'helper', 0)) v(line, kind, name, indent)")
def py_defs(spark, d):
    return extract.python_definitions(_sources(spark, d))


@register("SELECT 'supply/part_' || p_partkey || '.py' AS path, 4 AS n_nodes, 4 AS n_edges FROM part")
def py_extract(spark, d):
    return extract.python_fragments(_sources(spark, d)).select("path", F.size("nodes").alias("n_nodes"), F.size("edges").alias("n_edges"))


@register("""WITH RECURSIVE f AS (SELECT source AS dir, doc_id, row_number() OVER (ORDER BY source, doc_id) AS k, floor((least(n_chars, 20000) + 80) / 4)::BIGINT AS t FROM documents),
r AS (SELECT k, doc_id, t AS tokens, 0::BIGINT AS chunk FROM f WHERE k = 1 UNION ALL SELECT f.k, f.doc_id, CASE WHEN r.tokens + f.t > 20000 THEN f.t ELSE r.tokens + f.t END, CASE WHEN r.tokens + f.t > 20000 THEN r.chunk + 1 ELSE r.chunk END FROM r JOIN f ON f.k = r.k + 1)
SELECT chunk, count(*) AS n_files, max(tokens) AS tokens FROM r GROUP BY chunk""")
def pack_chunks(spark, d):
    t = F.floor((F.least(c("n_chars"), F.lit(20000)) + 80) / 4)
    files = table(spark, d, "documents").select("source", "doc_id", t.alias("t"))

    def packed(frames):  # greedy packing depends on all files before; only their sizes are moved
        import pandas as pd

        chunk, tokens, out = 0, 0, {}
        for f in frames:
            for x in f["t"]:
                if tokens and tokens + x > 20000:
                    chunk, tokens = chunk + 1, 0
                tokens += x
                out[chunk] = (out.get(chunk, (0, 0))[0] + 1, tokens)
        yield pd.DataFrame([(k, *v) for k, v in out.items()], columns=["chunk", "n_files", "tokens"])

    return files.orderBy("source", "doc_id").coalesce(1).mapInPandas(packed, "chunk long, n_files long, tokens long")


@register("SELECT doc_id, doc_id % 2 = 0 AS ok, CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END AS n_nodes FROM documents")
def parse_fragment_json(spark, d):
    raw = F.when(c("doc_id") % 2 == 0, F.concat(F.lit('{"nodes":[{"id":"d'), "doc_id", F.lit('"}],"edges":[]}'))).otherwise("no json")
    parsed = F.from_json(raw, "nodes array<struct<id:string>>, edges array<struct<source:string,target:string>>")
    return table(spark, d, "documents").select("doc_id", parsed["nodes"].isNotNull().alias("ok"), F.coalesce(F.size(parsed["nodes"]), F.lit(0)).alias("n_nodes")).withColumn("n_nodes", F.greatest("n_nodes", F.lit(0)))


@register("SELECT lang, sum(tokens)::BIGINT AS tokens, count(*) AS n FROM (SELECT lang, length(text) // 4 AS tokens FROM documents UNION ALL SELECT 'bench', length(text) // 4 FROM benchmark) GROUP BY 1")
def merge_fragments(spark, d):
    part = lambda t, lang: table(spark, d, t).select(lang.alias("lang"), F.floor(F.length("text") / 4).alias("tokens"))
    return part("documents", c("lang")).union(part("benchmark", F.lit("bench"))).groupBy("lang").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("n"))


@register()
def fn_strip_diacritics(spark, d):
    @F.pandas_udf("string")
    def fold(x):
        return x.map(lambda s: None if s is None else query.fold(s))

    return table(spark, d, "documents").select("doc_id", fold("text").alias("value"))
