"""Scalar functions on strings, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize_id(x: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(x, "[^a-zA-Z0-9]+", "_"), "^_+|_+$", ""))


def make_id(*parts: Column) -> Column:
    """Identifier from the parts that are left after trimming."""
    kept = [F.regexp_replace(F.trim(F.coalesce(p, F.lit(""))), "^[_ .]+|[_ .]+$", "") for p in parts]
    return normalize_id(F.array_join(F.filter(F.array(*kept), lambda p: p != ""), "_"))


def basename(x: Column) -> Column:
    return F.regexp_extract(x, "([^/]*)/*$", 1)


def extension(x: Column) -> Column:
    """From the last dot of the base name, lower-cased; none for leading dots."""
    return F.lower(F.regexp_extract(basename(x), r"^.+(\.[^.]*)$", 1))


def sanitize_label(x: Column, most: int = 256) -> Column:
    return F.substring(F.regexp_replace(F.coalesce(x, F.lit("")), r"[\x00-\x1f\x7f]", ""), 1, most)


def file_stem(path: Column) -> Column:
    """parent.name without the extension."""
    base = basename(path)
    name = F.when(F.rlike(base, F.lit(r"^.+\.[^.]*$")), F.regexp_replace(base, r"\.[^.]*$", "")).otherwise(base)
    parent = F.regexp_extract(path, "([^/]+)/[^/]*$", 1)
    return F.when((parent != "") & (parent != "."), F.concat_ws(".", parent, name)).otherwise(name)


def posix_path(x: Column) -> Column:
    return F.replace(x, F.lit("\\"), F.lit("/"))


def line_of_offset(x: Column, offset: Column) -> Column:
    """1-based line of a 0-based offset."""
    head = F.substring(x, F.lit(1), offset.cast("int"))
    return F.lit(1) + F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit("")))


def count_words(x: Column) -> Column:
    return F.size(F.regexp_extract_all(F.coalesce(x, F.lit("")), F.lit(r"(?U)\S+"), F.lit(0))).cast("long")


def escape_html(x: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def safe_community_name(x: Column) -> Column:
    x = F.regexp_replace(F.regexp_replace(x, r'[\\/*?:"<>|#^\[\]]', ""), r"\r\n|\r|\n", " ")
    x = F.trim(F.regexp_replace(x, r"(?i)\.(md|mdx|markdown)$", ""))
    return F.when(x == "", "unnamed").otherwise(x)


def wiki_file_name(x: Column) -> Column:
    x = F.translate(x, "/ :", "-_-")
    x = F.regexp_replace(F.regexp_replace(x, r'[<>"\\|?*]', "_"), "[. ]+$", "")
    return F.substring(F.when(x == "", "unnamed").otherwise(x), 1, 200)


def canvas_name(x: Column) -> Column:
    x = F.regexp_replace(F.regexp_replace(x, r'[\\/*?:"<>|#^\[\]]', ""), r"(?i)\.(md|mdx|markdown)$", "")
    x = F.substring(x, 1, 180)
    return F.when(x == "", "unnamed").otherwise(x)


def url_file_name(url: Column, suffix: str) -> Column:
    host, path = F.lower(F.regexp_extract(url, "://([^/?#:]*)", 1)), F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1)
    path = F.when(path == "", "/").otherwise(path)
    name = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.concat(host, path), r"[^A-Za-z0-9_-]", "_"), "_+", "_"), "^_+|_+$", "")
    name = F.substring(name, 1, 80)
    return F.concat(F.when(name == "", "download").otherwise(name), F.lit(suffix))


def yaml_string(x: Column) -> Column:
    return F.regexp_replace(F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), "\r?\n", " ")


def cypher_escape(x: Column) -> Column:
    return F.replace(F.replace(F.coalesce(x, F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'"))


def url_type(url: Column) -> Column:
    low, path = F.lower(url), F.lower(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1))
    has = lambda *xs: F.rlike(low, F.lit("|".join(x.replace(".", r"\.") for x in xs)))
    out = F.when(has("twitter.com", "x.com"), "tweet").when(has("arxiv.org"), "arxiv").when(has("github.com"), "github").when(has("youtube.com", "youtu.be"), "youtube")
    return out.when(F.endswith(path, F.lit(".pdf")), "pdf").when(F.rlike(path, F.lit(r"\.(png|jpg|jpeg|webp|gif)$")), "image").otherwise("webpage")


def _tags_off(x: Column) -> Column:
    for a, b in ((r"(?i)<p[^>]*>", "\n\n"), (r"(?i)<br\s*/?>", "\n"), ("<[^>]+>", " "), ("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), (r"\s+\n", "\n"), (r"\n{3,}", "\n\n"), (r"[ \t]{2,}", " "), (r"^\s+|\s+$", "")):
        x = F.regexp_replace(x, a, b)
    return x


def strip_html(html: Column) -> Column:
    """Readable text of a page: headings as #, paragraphs and breaks as lines."""
    x = F.regexp_replace(F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<script[^>]*>.*?</script>", ""), r"(?is)<style[^>]*>.*?</style>", "")
    for n in range(1, 7):
        x = F.regexp_replace(x, rf"(?is)<h{n}[^>]*>\s*(.*?)\s*</h{n}>", "#" * n + " $1\n\n")
    return _tags_off(x)


def page_title(html: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1), r"\s+", " "))


def body_content(x: Column) -> Column:
    """What follows the front matter; the whole text without one."""
    end = F.locate("\n---", x, 4)
    return F.when(F.startswith(x, F.lit("---")) & (end > 0), F.substring(x, end + 4, F.length(x))).otherwise(x)


def compact_text(x: Column, most: int = 80) -> Column:
    return F.substring(F.trim(F.regexp_replace(x, r"\s+", " ")), 1, most)


def symbol_base(label: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(label, r"^\.", ""), r"\(\)$", ""))


def question_slug(x: Column) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(x), "[^A-Za-z0-9_]", "_"), "^_+|_+$", ""), 1, 50)


#: Hosts that give out a machine's credentials.
BLOCKED_HOSTS = ("metadata.google.internal", "metadata.google.com")
_BYTE = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"


def is_address(x: Column) -> Column:
    """Whether a host is an IPv4 or IPv6 address, and not a name."""
    four = F.rlike(x, F.lit(rf"^{_BYTE}(\.{_BYTE}){{3}}$"))
    six = F.rlike(x, F.lit(r"^[0-9A-Fa-f]{0,4}(:[0-9A-Fa-f]{0,4}){2,7}$"))
    return four | six


def private_ip(x: Column) -> Column:
    """Addresses that a fetch must not reach; names are none, whatever they begin with."""
    near = F.rlike(F.lower(x), F.lit(r"^(10\.|127\.|169\.254\.|192\.168\.|172\.(1[6-9]|2[0-9]|3[01])\.|::1$|fc|fd|fe80:)"))
    return is_address(x) & near


def url_host(url: Column) -> Column:
    """The host of a URL, without user, port and the brackets of an IPv6 address."""
    host = F.regexp_extract(url, r"://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1)
    return F.lower(F.regexp_replace(host, r"[\[\]]", ""))


def may_fetch(url: Column) -> Column:
    """Whether a URL is http or https and its host neither private nor blocked."""
    host = url_host(url)
    return is_url(url) & ~private_ip(host) & ~host.isin(*BLOCKED_HOSTS)


def resolved_path(path: Column) -> Column:
    """An absolute path without empty, `.` and `..` segments; `..` at the root stays there."""
    none = F.array().cast("array<string>")

    def step(out: Column, s: Column) -> Column:
        up = F.slice(out, F.lit(1), F.greatest(F.size(out) - 1, F.lit(0)))
        return F.when(s.isin("", "."), out).when(s == "..", up).otherwise(F.concat(out, F.array(s)))

    return F.concat(F.lit("/"), F.array_join(F.aggregate(F.split(path, "/"), none, step), "/"))


def inside(path: Column, base: str) -> Column:
    """Whether a path, resolved, is the folder base or lies below it."""
    at = resolved_path(path)
    return (at == base) | F.startswith(at, F.lit(base.rstrip("/") + "/"))


def clean_identifier(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(x, "^[:@$]+", ""), r"(?s)[(){}\[\];,].*$", ""))


def normalize_symbol(x: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(x, "^[@.$]+", ""), r"\(\)$", "")))


def budget_cut(x: Column, tokens: int) -> Column:
    """The text up to 3 characters a token, and a note where it was cut."""
    most = 3 * tokens
    return F.when(F.length(x) > most, F.concat(F.substring(x, 1, most), F.lit(f"\n... (truncated to ~{tokens} token budget)"))).otherwise(x)


def clamp_depth(x: Column) -> Column:
    """The depth that a request gets: 3 if it names none, 6 at most."""
    return F.least(F.coalesce(x, F.lit(3)), F.lit(6))


def within_hops(hops: Column, most: Column, answer: Column) -> Column:
    """The answer, unless its path has more hops than the request allows (8 if it names no limit)."""
    most = F.coalesce(most, F.lit(8))
    return F.when(hops > most, F.concat(F.lit("Path exceeds max_hops="), most, F.lit(" ("), hops, F.lit(" hops found)."))).otherwise(answer)


def is_url(x: Column) -> Column:
    return F.startswith(x, F.lit("http://")) | F.startswith(x, F.lit("https://"))


def round_half_up(x: Column, k: int) -> Column:
    """floor(x * k + 0.5) / k, which is not what round() gives."""
    return F.floor(x * k + 0.5) / k
