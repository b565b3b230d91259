"""URL filters: fixed rules, and a path-template tree whose templates are judged by labelled purity.

Per host, path segments of a variable form (numbers, hexadecimal keys, dates) become wildcards. Level by level,
a node with many children none of which stands out gets one wildcard child, and sibling branches whose labelled
shares do not differ significantly from those of their siblings merge. A template is rejected when the smoothed
share of bad pages among its labelled ones is high. All steps are sums per node that Spark pre-aggregates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, discard, table

#: Fixed rules: verdict, rule.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    part = lambda i: F.coalesce(F.regexp_extract(url, r"(?s)://([^/?#]*)([^?#]*)", i), F.lit(""))
    return F.translate(part(1), _UPPER, _LOWER), part(2)


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null without one."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: len(r[1])):
        h, _, p = text.partition("/")
        fits = ((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(f"/{p}"))
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def segments(path: Column) -> Column:
    """The path's segments, variable forms as wildcards."""
    parts = F.split(F.regexp_replace(path, "^/", ""), "/")

    def form(s: Column) -> Column:
        s = F.regexp_replace(s, r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$", "{date}")
        s = F.regexp_replace(s, r"^(?=[0-9a-fA-F-]*[0-9])[0-9a-fA-F-]{8,}$", "{key}")
        return F.regexp_replace(s, r"(?<![{A-Za-z])[0-9]+", "{n}")

    return F.transform(parts, form)


def templates(nodes: DataFrame, many: int = 20, share: float = 0.3, z: float = 1.96, least: int = 3) -> DataFrame:
    """Adds `t`, the template array, to nodes(host, segs, n, labelled, bad), one row per distinct (host, segs).

    Level by level, a node with more than `many` children of which none holds `share` of its pages gets one wildcard
    child. Else those children merge whose share of bad pages doesn't differ from their siblings' by `z` standard errors;
    a child with fewer than `least` labelled pages, or siblings with fewer, gives no evidence and keeps its name. A path
    that is alone below its node keeps the rest of its segments, so rounds end with the deepest branching.
    """
    nodes = nodes.withColumn("t", F.array().cast("array<string>"))
    done, level = [], 0
    while True:
        alone = nodes.groupBy("host", "t").agg(F.count(F.lit(1)).alias("m"))
        at = cut(nodes.join(alone, ["host", "t"]))
        rest = F.slice("segs", F.lit(level + 1), F.greatest(F.size("segs") - level, F.lit(0)))
        ends = (F.col("m") == 1) | (F.size("segs") <= level)
        done.append(cut(at.where(ends).withColumn("t", F.concat("t", rest)).drop("m")))
        at = at.where(~ends).drop("m").withColumn("s", F.get("segs", F.lit(level)))
        if at.isEmpty():
            break
        child = cut(at.groupBy("host", "t", "s").agg(*(F.sum(c).alias(c) for c in ("n", "labelled", "bad"))))
        node = child.groupBy("host", "t").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("whole"), F.max("n").alias("top"), F.sum("labelled").alias("L"), F.sum("bad").alias("B"))
        both = child.join(node, ["host", "t"])
        rest_l, rest_b = F.col("L") - F.col("labelled"), F.col("B") - F.col("bad")
        pooled = F.try_divide("B", "L")
        spread = F.sqrt(pooled * (1 - pooled) * (F.try_divide(F.lit(1), "labelled") + F.try_divide(F.lit(1), rest_l)))
        score = F.coalesce(F.abs(F.try_divide(F.try_divide("bad", "labelled") - F.try_divide(rest_b, rest_l), spread)), F.lit(0.0))
        both = both.withColumn("like", (F.col("labelled") >= least) & (rest_l >= least) & (score < z))
        likes = both.where("like").groupBy("host", "t").agg(F.count(F.lit(1)).alias("likes"))
        both = both.join(likes, ["host", "t"], "left")
        wide = (F.col("k") > many) & (F.col("top") < share * F.col("whole"))
        name = F.when(wide | (F.col("like") & (F.col("likes") > 1)), F.lit("*")).otherwise(F.col("s"))
        names = both.select("host", "t", "s", name.alias("name"))
        on = (F.col("a.host") == F.col("b.host")) & (F.col("a.t") == F.col("b.t")) & (F.col("a.s") == F.col("b.s"))
        before, nodes = nodes, cut(at.alias("a").join(names.alias("b"), on).select("a.host", "segs", "n", "labelled", "bad", F.concat("a.t", F.array("name")).alias("t")))
        discard(before, child)
        level += 1
    out = done[0]
    for x in done[1:]:
        out = out.union(x)
    out = cut(out)
    discard(*done)
    return out


def judge(pages: DataFrame, labels: DataFrame, least: int = 3, purity: float = 0.6, weight: float = 4.0) -> DataFrame:
    """page_id, host, path, rule, verdict, template of every row of pages(page_id, url).

    labels(doc_id, quality, toxic) mark a page by its id: bad if quality is 0 or toxic is 1. Where no rule fits, a page
    is blocked if its template has `least` labelled pages and the share of bad ones, smoothed by `weight` pages of the
    overall share, is `purity` or more; else allowed. Null and malformed urls have empty host and path and are
    allowed. Rows that repeat an id are judged each; an id's contradicting labels count as bad. An empty table gives no
    rows. Other columns are not read.
    """
    host, path = host_and_path(F.col("url").cast("string"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    rule, verdict = rule_for(F.col("host"), F.col("path"))
    rows = cut(rows.withColumn("rule", rule).withColumn("given", verdict).withColumn("segs", segments(F.col("path"))))
    bad = (F.coalesce(F.col("quality"), F.lit(1)) == 0) | (F.coalesce(F.col("toxic"), F.lit(0)) == 1)
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("_p")).agg(F.max(bad.cast("int")).alias("_bad"))
    marked = rows.join(marks, F.col("page_id") == F.col("_p"), "left")
    nodes = marked.groupBy("host", "segs").agg(F.count(F.lit(1)).alias("n"), F.count("_bad").alias("labelled"), F.coalesce(F.sum("_bad"), F.lit(0)).alias("bad"))
    tree = templates(cut(nodes))
    found = tree.groupBy("host", "t").agg(F.sum("labelled").alias("L"), F.sum("bad").alias("B"))
    overall = tree.agg(F.try_divide(F.sum("bad"), F.sum("labelled")).alias("p")).first()["p"] or 0.0
    smoothed = (F.col("B") + weight * overall) / (F.col("L") + weight)
    judged = found.select("host", "t", ((F.col("L") >= least) & (smoothed >= purity)).alias("reject"))
    by = tree.select("host", "segs", "t").join(judged, ["host", "t"]).select("host", "segs", "t", "reject")
    out = rows.join(by, ["host", "segs"], "left")
    decided = F.coalesce("given", F.when(F.coalesce("reject", F.lit(False)) & (F.col("host") != ""), "block").otherwise("allow"))
    return out.select("page_id", "host", "path", "rule", decided.alias("verdict"), F.concat(F.lit("/"), F.array_join("t", "/")).alias("template"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))
