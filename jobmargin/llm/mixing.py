"""Mixing sources to target weights through a tree of budgets."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from jobmargin.llm.common import query, table, whole_text

LEVELS = ("domain", "lang", "source")
BUCKET_ROWS = 1000  # documents of a leaf summed in one task, about
SALTS = 64          # parts of a leaf matched with its share apart


@dataclass(frozen=True)
class Target:
    """What to take: a share of all tokens, split by weights at each level, each document at most max_epochs times."""

    percent: int = 60
    max_epochs: int = 2
    seed: int = 7
    weights: Mapping[str, Mapping[str, int]] = field(default_factory=lambda: {
        "domain": {"domain0": 4, "domain1": 3, "domain2": 2, "domain3": 1},
        "lang": {"en": 6, "de": 2, "fr": 2, "es": 1},
    })  # a name without a weight has weight 1; weight 0 takes nothing


def domain_of(source: Column) -> Column:
    """The benchmark's sources are numbered; four domains share them."""
    number = F.coalesce(F.regexp_extract(source, "[0-9]+", 0).try_cast("bigint"), F.lit(0))
    return F.concat(F.lit("domain"), (number % 4).cast("string"))


def units(docs: DataFrame, domain: Column) -> DataFrame:
    """doc_id, key, the leaf, tokens and copies for each different (id, text): rows that agree in all go together."""
    words = F.regexp_count(whole_text(), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    rows = docs.select(
        "doc_id", F.xxhash64(whole_text()).alias("key"), F.coalesce(domain, F.lit("unknown")).alias("domain"),
        F.coalesce("lang", F.lit("unknown")).alias("lang"), F.coalesce("source", F.lit("unknown")).alias("source"), words.alias("n_tokens"),
    )
    return rows.groupBy("doc_id", "key", *LEVELS).agg(F.max("n_tokens").alias("n_tokens"), F.count("*").alias("copies"))


def _fill(nodes: DataFrame, parent: tuple[str, ...], name: str) -> DataFrame:
    """`share` of each node: its parent's `budget` split by weight, no node above its `room`.

    Nodes in the order of room by weight: those whose part of what is left exceeds their room are
    full, and what they lack goes to their siblings.  All in whole tokens; fractions stay untaken.
    """
    siblings = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    order = siblings.orderBy(F.col("room") / F.col("weight"), name)
    left = F.col("budget") - F.coalesce(F.sum("room").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    weights = F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    ranked = nodes.withColumns({"left": left, "weights": weights, "nth": F.row_number().over(order)})
    open_ = F.when(F.col("room") * F.col("weights") > F.col("left") * F.col("weight"), F.struct("nth", "left", "weights"))
    ranked = ranked.withColumn("first", F.min(open_).over(siblings))
    part = F.expr("cast(greatest(first.left, 0) * weight div first.weights as bigint)")
    full = F.col("first").isNull() | (F.col("nth") < F.col("first.nth"))
    return ranked.withColumn("share", F.when(full, F.col("room")).otherwise(F.least("room", part))).drop("left", "weights", "nth", "first")


def budgets(leaves: DataFrame, target: Target) -> DataFrame:
    """The leaves (LEVELS, tokens, n_docs) with `share`, the tokens to take of each.

    Budgets go down the tree.  A node never gets more than its leaves can give, so what a leaf lacks goes to the
    leaves beside it first, and only what a whole subtree lacks goes to the subtrees beside that one.
    """
    weighted = leaves
    for level in LEVELS:
        known = target.weights.get(level) or {}
        weight = F.coalesce(F.create_map(*(F.lit(x) for pair in known.items() for x in pair))[F.col(level)], F.lit(1)) if known else F.lit(1)
        weighted = weighted.withColumn(f"{level}_weight", weight.cast("long"))
    weighted = weighted.where(" and ".join(f"{level}_weight > 0" for level in LEVELS)).withColumn("room", F.col("tokens") * target.max_epochs)
    filled = weighted.withColumn("budget", F.expr(f"sum(tokens) over (partition by 0) * {int(target.percent)} div 100"))
    for depth, level in enumerate(LEVELS):
        path = LEVELS[:depth + 1]
        nodes = filled.groupBy(*path).agg(F.sum("room").alias("room"), F.max(f"{level}_weight").alias("weight"), F.max("budget").alias("budget"))
        shares = _fill(nodes, LEVELS[:depth], level).select(*path, "share")
        filled = filled.drop("share").join(shares, list(path)).withColumn("budget", F.col("share"))
    return filled.select(*LEVELS, "tokens", "n_docs", "share")


def select(docs: DataFrame, target: Target = Target(), domain: Column | None = None) -> DataFrame:
    """doc_id, key, copies, LEVELS, n_tokens, epoch of the chosen documents; tokens are words here.

    Each leaf is read in epochs: all its documents as often as its share holds them, then a prefix,
    in the order of a hash of seed, epoch and id, as long as the running sum of tokens stays within
    the share.  The sum is taken in buckets of hash order, sized by the leaf's number of
    documents, so that a source with a third of all rows is summed by many tasks.
    """
    own = units(docs, domain_of(F.col("source")) if domain is None else domain)
    own = own.withColumn("weighs", F.col("n_tokens") * F.col("copies"))
    leaves = own.groupBy(*LEVELS).agg(F.sum("weighs").alias("tokens"), F.count("*").alias("n_docs"))
    shares = budgets(leaves, target).where("share > 0")
    rounds = F.sequence(F.lit(0), ((F.col("share") - 1) / F.greatest("tokens", F.lit(1))).cast("int"))
    salted = shares.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    own = own.withColumn("salt", F.pmod("key", F.lit(SALTS)).cast("int"))
    dealt = own.join(salted, [*LEVELS, "salt"]).withColumn("epoch", F.explode(rounds))
    dealt = dealt.withColumn("amount", F.least("tokens", F.col("share") - F.col("epoch") * F.col("tokens")))
    dealt = dealt.withColumn("order", F.md5(F.concat_ws(":", F.lit(str(target.seed)), "epoch", F.coalesce(F.col("doc_id").cast("string"), F.lit("")))))
    place = F.conv(F.substring("order", 1, 8), 16, 10).cast("long")
    dealt = dealt.withColumn("bucket", F.floor(place * F.ceil(F.col("n_docs") / BUCKET_ROWS) / (1 << 32)))
    sums = dealt.groupBy(*LEVELS, "epoch", "bucket").agg(F.sum("weighs").alias("of_bucket"))
    earlier = Window.partitionBy(*LEVELS, "epoch").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    begins = sums.select(*LEVELS, "epoch", "bucket", F.coalesce(F.sum("of_bucket").over(earlier), F.lit(0)).alias("begin"))
    inside = Window.partitionBy(*LEVELS, "epoch", "bucket").orderBy("order", "doc_id", "key").rowsBetween(Window.unboundedPreceding, 0)
    reached = dealt.join(begins, [*LEVELS, "epoch", "bucket"]).withColumn("reached", F.col("begin") + F.sum("weighs").over(inside))
    return reached.where("reached <= amount").select("doc_id", "key", "copies", *LEVELS, "n_tokens", "epoch")


def mix(docs: DataFrame, target: Target = Target(), domain: Column | None = None) -> DataFrame:
    """The chosen rows of `docs`, once for each epoch, with the columns of `docs` and epoch.

    Null languages, sources and domains are named unknown; null and empty texts have no tokens and are taken
    where their turn comes within the share.  Rows of equal id, text and leaf are chosen together.  No
    rows give no rows.
    """
    chosen = select(docs, target, domain).select(F.col("doc_id").alias("_doc"), F.col("key").alias("_key"), *(F.col(c).alias(f"_{c}") for c in LEVELS), F.col("epoch").alias("_epoch"))
    named = {"_l": F.coalesce("lang", F.lit("unknown")), "_s": F.coalesce("source", F.lit("unknown")), "_own": F.xxhash64(whole_text()),
             "_d": F.coalesce(domain_of(F.col("source")) if domain is None else domain, F.lit("unknown"))}
    keyed = docs.drop("epoch").withColumns(named)
    same = keyed["doc_id"].eqNullSafe(chosen["_doc"]) & (F.col("_own") == F.col("_key")) & (F.col("_l") == F.col("_lang")) & (F.col("_s") == F.col("_source")) & (F.col("_d") == F.col("_domain"))
    return keyed.join(chosen, same).select(*docs.drop("epoch").columns, F.col("_epoch").alias("epoch"))


@query
def op3_source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    chosen = select(table(spark, folder, "documents"))
    return chosen.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("doc_id", *LEVELS, "n_tokens", "epoch")


def _fill_sql(level: str, parent: str, nodes: str) -> str:
    over = f"PARTITION BY {parent} " if parent else ""
    return f"""
{level}_ranked AS (SELECT *, budget - coalesce(sum(room) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lft,
    sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights, row_number() OVER w AS nth
  FROM ({nodes}) WINDOW w AS ({over}ORDER BY room / weight, {level})),
{level}_open AS (SELECT *, min(CASE WHEN room * weights > lft * weight THEN nth END) OVER ({over}) AS first FROM {level}_ranked),
{level}_first AS (SELECT *, max(CASE WHEN nth = first THEN lft END) OVER ({over}) AS first_left,
    max(CASE WHEN nth = first THEN weights END) OVER ({over}) AS first_weights FROM {level}_open),
{level}_share AS (SELECT * EXCLUDE (budget), CAST(CASE WHEN first IS NULL OR nth < first THEN room
    ELSE least(room, greatest(first_left, 0) * weight // first_weights) END AS BIGINT) AS budget FROM {level}_first)"""


_NODE = "SELECT {path}, CAST(sum(l.room) AS BIGINT) AS room, max(l.{level}_weight) AS weight, max({budget}) AS budget FROM leaves l {join} GROUP BY {path}"

ORACLE = """
WITH docs AS (SELECT doc_id, 'domain' || CAST(coalesce(TRY_CAST(regexp_extract(source, '[0-9]+') AS BIGINT), 0) % 4 AS VARCHAR) AS domain,
    coalesce(lang, 'unknown') AS lang, coalesce(source, 'unknown') AS source,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS n_tokens FROM documents),
leaves AS (SELECT domain, lang, source, CAST(sum(n_tokens) AS BIGINT) AS tokens, CAST(sum(n_tokens) * 2 AS BIGINT) AS room,
    CASE domain WHEN 'domain0' THEN 4 WHEN 'domain1' THEN 3 WHEN 'domain2' THEN 2 ELSE 1 END AS domain_weight,
    CASE lang WHEN 'en' THEN 6 WHEN 'de' THEN 2 WHEN 'fr' THEN 2 ELSE 1 END AS lang_weight, 1 AS source_weight FROM docs GROUP BY ALL),
""" + ",".join((
    _fill_sql("domain", "", _NODE.format(path="domain", level="domain", budget="(SELECT sum(tokens) * 60 // 100 FROM leaves)", join="")),
    _fill_sql("lang", "domain", _NODE.format(path="domain, lang", level="lang", budget="s.budget", join="JOIN domain_share s USING (domain)")),
    _fill_sql("source", "domain, lang", _NODE.format(path="domain, lang, source", level="source", budget="s.budget", join="JOIN lang_share s USING (domain, lang)")),
)) + """,
dealt AS (SELECT d.*, epoch, least(l.tokens, s.budget - epoch * l.tokens) AS amount, md5('7:' || epoch || ':' || coalesce(CAST(d.doc_id AS VARCHAR), '')) AS ord
  FROM docs d JOIN leaves l USING (domain, lang, source) JOIN source_share s USING (domain, lang, source), unnest(range(2)) AS e(epoch)
  WHERE s.budget > epoch * l.tokens),
summed AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source, epoch ORDER BY ord, doc_id ROWS UNBOUNDED PRECEDING) AS reached FROM dealt)
SELECT doc_id, domain, lang, source, n_tokens, CAST(epoch AS INT) AS epoch FROM summed WHERE reached <= amount
"""
