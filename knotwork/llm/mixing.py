"""Mixing sources to target weights: hierarchical budgets over a domain-language-source tree.

Native: DataFrame operations only. A node's capacity is what its leaves can give in all epochs. From the root
down, a parent's budget is shared among its children by weight; a child that cannot take its share takes its
capacity and the rest goes to its siblings. As a parent never gets more than its capacity, what siblings
cannot take has by then gone to the parent's own siblings. All of it is exact integer arithmetic; the words that whole
shares leave over, fewer than a node has children, stay unassigned.
A leaf repeats whole epochs and then takes a prefix of one more, each epoch in an order of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, n_words, rowed, table

#: Fixed values of the production mix; what is not named weighs 1. Domains group the sources by their number.
WEIGHTS = {"domain": {"d0": 4, "d1": 3, "d2": 2, "d3": 1}, "lang": {"en": 6, "de": 2, "fr": 2, "es": 1}, "source": {}}
LEVELS = ("domain", "lang", "source")
SHARE, EPOCHS, SEED = (1, 1), 3, "mix-1"
#: A multiple of all weights that may be given (1 to 10), so that capacities by weight are compared in whole numbers.
WHOLE = 2520


def domain_of(source: Column) -> Column:
    number = F.regexp_extract(F.coalesce(source, F.lit("")), "([0-9]{1,9})$", 1)
    return F.concat(F.lit("d"), F.when(number == "", F.lit(0)).otherwise(number.cast("long") % 4).cast("string"))


def _weight(level: str, weights: dict) -> Column:
    out = F.lit(1)
    for name, w in weights.get(level, {}).items():
        out = F.when(F.col(level) == name, w).otherwise(out)
    return out.cast("long")


def allocate(children: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Adds `alloc` to children(*parent, name, w, cap, budget): the parent's budget by weight, up to capacity."""
    wide = lambda c, p: F.col(c).cast(f"decimal({p},0)")
    order = Window.partitionBy(*parent).orderBy(wide("cap", 30) * F.expr(f"{WHOLE} div w"), name)
    whole = Window.partitionBy(*parent)
    up, on = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    df = children.withColumn("_c", F.coalesce(F.sum("cap").over(up), F.lit(0))).withColumn("_w", F.sum("w").over(on)).withColumn("_rest", F.col("budget") - F.col("_c"))
    df = df.withColumn("_full", wide("cap", 22) * wide("_w", 12) <= wide("_rest", 22) * wide("w", 12))
    df = df.withColumn("_fc", F.sum(F.when(F.col("_full"), F.col("cap")).otherwise(0)).over(whole)).withColumn("_fw", F.sum(F.when(F.col("_full"), 0).otherwise(F.col("w"))).over(whole))
    df = df.withColumn("_rest", F.col("budget") - F.col("_fc")).withColumn("_num", wide("_rest", 22) * wide("w", 12)).withColumn("_den", wide("_fw", 12))
    return df.withColumn("alloc", F.when(F.col("_full"), F.col("cap")).otherwise(F.expr("_num div _den"))).drop("_c", "_w", "_rest", "_full", "_fc", "_fw", "_num", "_den")


def quotas(leaves: DataFrame, weights: dict, share: tuple[int, int], epochs: int) -> DataFrame:
    """Adds quota to leaves(domain, lang, source, tokens, n)."""
    at = leaves.withColumn("cap", F.col("tokens") * epochs)
    budget = at.agg(F.sum("tokens").alias("t"), F.sum("cap").alias("c")).select(F.least(F.expr(f"t * {share[0]} div {share[1]}"), "c").alias("budget"))
    top = at.groupBy("domain").agg(F.sum("cap").alias("cap")).withColumn("w", _weight("domain", weights)).withColumn("_one", F.lit(1)).join(budget.withColumn("_one", F.lit(1)), "_one")
    domains = allocate(top, ["_one"], "domain").select("domain", F.col("alloc").alias("budget"))
    langs = at.groupBy("domain", "lang").agg(F.sum("cap").alias("cap")).withColumn("w", _weight("lang", weights)).join(domains, "domain")
    langs = allocate(langs, ["domain"], "lang").select("domain", "lang", F.col("alloc").alias("budget"))
    sources = at.withColumn("w", _weight("source", weights)).join(langs, ["domain", "lang"])
    return allocate(sources, ["domain", "lang"], "source").select(*LEVELS, "tokens", "n", F.col("alloc").alias("quota"))


def mix(documents: DataFrame, weights: dict = WEIGHTS, share: tuple[int, int] = SHARE, epochs: int = EPOCHS, seed: str = SEED) -> DataFrame:
    """doc_id, domain, lang, source, tokens, epoch, th, copies: which documents to take, in which epochs.

    The budget is share of all tokens (words). Null lang and source count as ''; null and empty texts have 0 tokens
    and are taken where their place in the order falls within the prefix. Rows with equal id, text and leaf are
    one unit of `copies` rows and move together. Other columns are not read. A leaf's last epoch stops before the
    first unit that would exceed its quota.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    src = F.coalesce(F.col("source").cast("string"), F.lit(""))
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), domain_of(src).alias("domain"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), src.alias("source"), F.md5(text).alias("th"), n_words(text).alias("tokens"))
    units = cut(rows.groupBy("doc_id", *LEVELS, "th").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("copies")))
    leaves = cut(quotas(units.groupBy(*LEVELS).agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("n")), weights, share, epochs))
    full = F.when(F.col("tokens") > 0, F.expr("quota div tokens")).otherwise(F.lit(0))
    leaves = leaves.withColumn("full", full).withColumn("rest", F.col("quota") - full * F.col("tokens")).withColumn("more", (F.col("rest") > 0) | (F.col("tokens") == 0))
    of = units.join(leaves.select(*LEVELS, "full", "rest", "more", "n"), list(LEVELS))
    whole = of.where("full > 0").select("*", F.explode(F.sequence(F.lit(0), F.col("full") - 1)).alias("epoch"))
    key = F.md5(F.concat_ws("|", F.lit(seed), F.col("full").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "th"))
    # A leaf is dealt into buckets of about 4000 units by the order's first digits: no task holds a whole leaf.
    part = of.where("more").withColumn("k", key).withColumn("b", (F.conv(F.substring("k", 1, 7), 16, 10).cast("long") * F.ceil(F.col("n") / 4000) / (1 << 28)).cast("long"))
    before = Window.partitionBy(*LEVELS).orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    starts = part.groupBy(*LEVELS, "b").agg(F.sum("tokens").alias("_t")).withColumn("_s", F.coalesce(F.sum("_t").over(before), F.lit(0))).drop("_t")
    inside = Window.partitionBy(*LEVELS, "b").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    taken = part.withColumn("_c", F.sum("tokens").over(inside)).join(starts, [*LEVELS, "b"]).where("_s + _c <= rest").withColumn("epoch", F.col("full"))
    columns = ["doc_id", *LEVELS, "tokens", "epoch", "th", "copies"]
    return whole.select(columns).union(taken.select(columns))


def mixed(documents: DataFrame, **options) -> DataFrame:
    """The chosen rows of documents with all their columns, whatever their names, once an epoch."""
    chosen = mix(documents, **options).select("doc_id", "th", "lang", "source")
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = rowed(documents, d=F.col("doc_id").cast("long"), h=F.md5(plain("text")), l=plain("lang"), s=plain("source"))
    on = rows["d"].eqNullSafe(chosen["doc_id"]) & (rows["h"] == chosen["th"]) & (rows["l"] == chosen["lang"]) & (rows["s"] == chosen["source"])
    return rows.join(chosen, on).select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def _case(level: str) -> str:
    return "CASE " + level + "".join(f" WHEN '{k}' THEN {v}" for k, v in WEIGHTS[level].items()) + " ELSE 1 END" if WEIGHTS[level] else "1"


def _level(name: str, source: str, parent: str, by: str) -> str:
    return f"""
{name}_1 AS (SELECT *, budget - coalesce(sum(cap) OVER (PARTITION BY {parent} ORDER BY cap::HUGEINT * ({WHOLE} // w), {by} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_,
  sum(w) OVER (PARTITION BY {parent} ORDER BY cap::HUGEINT * ({WHOLE} // w), {by} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_ FROM {source}),
{name}_2 AS (SELECT *, cap::HUGEINT * w_ <= left_::HUGEINT * w AS full_ FROM {name}_1),
{name} AS (SELECT *, CASE WHEN full_ THEN cap ELSE ((budget - sum(CASE WHEN full_ THEN cap ELSE 0 END) OVER (PARTITION BY {parent}))::HUGEINT * w
  // nullif(sum(CASE WHEN full_ THEN 0 ELSE w END) OVER (PARTITION BY {parent}), 0)::HUGEINT)::BIGINT END AS alloc FROM {name}_2),"""


_SPACE = r"[\x20\x09-\x0D]+"
ORACLE_SQL = f"""
WITH rows_ AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, md5(coalesce(text, '')) AS th,
  len(list_filter(regexp_split_to_array(coalesce(text, ''), '{_SPACE}'), lambda x: x <> '')) AS t,
  'd' || (CASE WHEN regexp_extract(coalesce(source, ''), '([0-9]{{1,9}})$', 1) = '' THEN 0 ELSE regexp_extract(coalesce(source, ''), '([0-9]{{1,9}})$', 1)::BIGINT % 4 END)::VARCHAR AS domain FROM documents),
units AS (SELECT doc_id, domain, lang, source, th, sum(t)::BIGINT AS tokens, count(*) AS copies FROM rows_ GROUP BY ALL),
leaves AS (SELECT domain, lang, source, sum(tokens)::BIGINT AS tokens, sum(tokens)::BIGINT * {EPOCHS} AS cap FROM units GROUP BY ALL),
root AS (SELECT least(sum(tokens) * {SHARE[0]} // {SHARE[1]}, sum(cap))::BIGINT AS budget FROM leaves),
top AS (SELECT domain, {_case("domain")} AS w, sum(cap)::BIGINT AS cap, (SELECT budget FROM root) AS budget FROM leaves GROUP BY domain),{_level("domains", "top", "1", "domain")}
langs_in AS (SELECT l.domain, l.lang, {_case("lang")} AS w, sum(l.cap)::BIGINT AS cap, any_value(d.alloc) AS budget FROM leaves l JOIN domains d USING (domain) GROUP BY l.domain, l.lang),{_level("langs", "langs_in", "domain", "lang")}
sources_in AS (SELECT l.*, {_case("source")} AS w, g.alloc AS budget FROM leaves l JOIN langs g USING (domain, lang)),{_level("sources", "sources_in", "domain, lang", "source")}
quota AS (SELECT domain, lang, source, CASE WHEN tokens > 0 THEN alloc // tokens ELSE 0 END AS full_e, alloc - (CASE WHEN tokens > 0 THEN alloc // tokens ELSE 0 END) * tokens AS rest, tokens AS all_ FROM sources),
of_ AS (SELECT u.*, full_e, rest, all_, md5(concat_ws('|', '{SEED}', full_e::VARCHAR, coalesce(doc_id::VARCHAR, ''), th)) AS k FROM units u JOIN quota USING (domain, lang, source)),
part AS (SELECT *, sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY k ROWS UNBOUNDED PRECEDING) AS c FROM of_ WHERE rest > 0 OR all_ = 0)
SELECT doc_id, domain, lang, source, tokens, unnest(range(full_e)) AS epoch, th, copies FROM of_ WHERE full_e > 0
UNION ALL SELECT doc_id, domain, lang, source, tokens, full_e, th, copies FROM part WHERE c <= rest
"""
