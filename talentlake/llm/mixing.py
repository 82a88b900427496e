"""Mixing sources to target weights by hierarchical budgeting.

Documents hang on a tree of level columns (domain, language, source). The token
budget goes down the tree: siblings share their parent's budget by weight, a
node gets no more than its documents can give in ``max_epochs`` passes, and what
it cannot use goes to its siblings first. A parent passes up only what all its
children together cannot use, because its own share was bounded by their sum.
Each leaf then gives whole epochs and, of its last epoch, the documents that
come first in a seeded order while their tokens fit (the token-prefix).

The prefix needs no sort of a whole leaf: tokens are summed in ranges of the
order's hash (about RANGE_ROWS documents each), and only the range holding the
cut is ordered. A leaf's prefix is one hash, so rows are selected where they are.

Defined results: null level values form nodes of their own; null texts and
blank ones have no tokens, and documents of a leaf without tokens are not
taken; nodes of weight zero or less get nothing; documents with equal ids share
a place in the order and are taken together or not at all; an empty table gives
no rows. All expressions are native.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import join_null_safe, materialize, read, text_of

RANGE_ROWS = 512
SEED = 17
BUDGET_SHARE = 0.5
MAX_EPOCHS = 3
WORD = r"[^\x20\x09-\x0D]+"
LEVELS = ("domain", "lang", "source")
DOMAIN_WEIGHTS = {"d0": 4, "d1": 3, "d2": 2, "d3": 1}
LANGUAGE_WEIGHTS = {"en": 5, "fr": 2, "de": 2, "es": 1}


def weight_of(column: Column, weights: dict[str, int], default: int = 1) -> Column:
    """The weight of a node by its name."""
    named = reduce(lambda c, kv: c.when(column == kv[0], kv[1]), weights.items(), F.when(F.lit(False), default))
    return named.otherwise(default)


def share_out(nodes: DataFrame, parents: Sequence[str], name: str) -> DataFrame:
    """Split ``budget`` (the parent's) among siblings by ``weight``, none above its ``cap``; sets ``budget``.

    In order of cap per weight, a node is filled if its cap is no more than its
    share of what the nodes before it leave; the rest share the remainder."""
    group = Window.partitionBy(*parents)
    order = group.orderBy(F.col("cap") / F.col("weight"), F.col(name).asc_nulls_first())
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    onward = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    full = F.col("cap").cast("double") * onward <= F.col("weight").cast("double") * (F.col("budget") - before)
    n = nodes.filter("weight > 0").withColumn("full", full)
    left = F.col("budget") - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(group), F.lit(0))
    among = F.sum(F.when(~F.col("full"), F.col("weight"))).over(group)
    share = F.floor(left.cast("double") * F.col("weight") / among)
    n = n.withColumns({"left": left, "share": share})
    return n.withColumn("budget", F.when(F.col("full"), F.col("cap")).otherwise(F.col("share"))).drop("full", "left", "share")


def leaf_budgets(leaves: DataFrame, levels: Sequence[str], weights: Sequence[Column], budget: int,
                 max_epochs: int) -> DataFrame:
    """The budget in tokens of each leaf (levels, tokens, n): one window pass for each level, over aggregated rows."""
    caps = leaves.withColumn("cap", F.col("tokens") * max_epochs)
    above = None
    for depth in range(1, len(levels) + 1):
        path = list(levels[:depth])
        nodes = caps.groupBy(*path).agg(F.sum("cap").alias("cap"))
        if above is None:
            nodes = nodes.withColumn("budget", F.lit(budget).cast("bigint"))
        else:
            nodes = join_null_safe(nodes, above.select(*path[:-1], "budget"), path[:-1])
        above = share_out(nodes.withColumn("weight", weights[depth - 1].cast("bigint")), path[:-1], path[-1])
    return above.select(*levels, "budget")


def order_hash(seed: int, epoch: Column, key: Column) -> Column:
    """Place of a document in an epoch's order."""
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(key.cast("string"), F.lit("")))
                  .cast("binary"), 256)


def mixing_plan(rows: DataFrame, levels: Sequence[str], weights: Sequence[Column], budget_share: float = BUDGET_SHARE,
                max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """One row per leaf of ``rows`` (id, n_tokens, levels): leaf_budget, epochs taken whole, and the hash
    up to which the next epoch is taken (null: nothing of it)."""
    levels = list(levels)
    leaves = materialize(rows.groupBy(*levels).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("n")), "leaves")
    total = leaves.agg(F.sum("tokens")).first()[0] or 0
    given = leaf_budgets(leaves, levels, weights, int(total * budget_share), max_epochs)
    plan = join_null_safe(leaves, given, levels).filter("tokens > 0").select(
        *levels, "tokens", "n", F.col("budget").alias("leaf_budget"),
        F.floor(F.col("budget") / F.col("tokens")).alias("whole"),
        (F.col("budget") % F.col("tokens")).alias("rest"))
    plan = materialize(plan, "leaf-budgets")
    placed = join_null_safe(rows, plan, levels).filter("rest > 0")
    place = order_hash(seed, F.col("whole"), F.col("id"))
    ranges = F.ceil(F.col("n") / RANGE_ROWS)
    within = F.floor(F.conv(F.substring(F.col("place"), 1, 8), 16, 10).cast("bigint") * F.col("ranges") / F.lit(2.0 ** 32))
    placed = placed.select(*levels, "n_tokens", "rest", place.alias("place"), ranges.alias("ranges"))
    placed = placed.withColumn("part", within)
    parts = placed.groupBy(*levels, "rest", "part").agg(F.sum("n_tokens").alias("t"), F.max("place").alias("last"))
    upto = F.sum("t").over(Window.partitionBy(*levels).orderBy("part"))
    parts = materialize(parts.withColumn("upto", upto), "order-ranges")
    whole = parts.filter("upto <= rest").groupBy(*levels).agg(F.max("last").alias("last"))
    cut = parts.filter("upto > rest and upto - t <= rest").select(
        *levels, "part", (F.col("upto") - F.col("t")).alias("before"))
    inside = join_null_safe(placed, cut, [*levels, "part"])
    running = F.sum("n_tokens").over(Window.partitionBy(*levels).orderBy("place"))     # equal places count together
    inside = inside.withColumn("upto", running + F.col("before")).filter("upto <= rest")
    last = whole.unionByName(inside.groupBy(*levels).agg(F.max("place").alias("last")))
    last = last.groupBy(*levels).agg(F.max("last").alias("last"))
    out = join_null_safe(plan, last, levels, "left")
    return materialize(out.select(*levels, "leaf_budget", "whole", "last"), "mixing-plan")


def mix(docs: DataFrame, levels: dict[str, Column], weights: Sequence[Column], id_col: str = "doc_id",
        text_col: str = "text", budget_share: float = BUDGET_SHARE, max_epochs: int = MAX_EPOCHS,
        seed: int = SEED) -> DataFrame:
    """The chosen rows of ``docs``, once for each epoch that takes them, with the columns
    ``mix_epoch``, ``mix_tokens``, ``mix_leaf_budget`` and one ``mix_<level>`` for each level.

    ``levels`` names the tree's levels from the top and how a row finds its node;
    ``weights`` are expressions over those names."""
    names = list(levels)
    tokens = F.regexp_count(text_of(text_col), F.lit(WORD)).cast("bigint")
    rows = docs.select(F.col(id_col).alias("id"), tokens.alias("n_tokens"), *[c.alias(n) for n, c in levels.items()])
    plan = mixing_plan(materialize(rows, "mixing-rows"), names, weights, budget_share, max_epochs, seed)
    marked = docs.withColumns({f"mix_{n}": c for n, c in levels.items()} | {"mix_tokens": tokens})
    match = reduce(lambda x, y: x & y, [marked[f"mix_{n}"].eqNullSafe(plan[n]) for n in names])
    first = order_hash(seed, plan["whole"], marked[id_col]) <= plan["last"]
    copies = plan["whole"] + F.coalesce(first.cast("int"), F.lit(0))
    joined = marked.join(plan, match).select(
        *[marked[c] for c in marked.columns], plan["leaf_budget"].alias("mix_leaf_budget"),
        F.explode(F.when(copies > 0, F.sequence(F.lit(0).cast("bigint"), copies - 1))).alias("mix_epoch"))
    return joined


def corpus_levels() -> dict[str, Column]:
    """Domain (by the source's number), language and source of ``documents``."""
    number = F.expr("try_cast(regexp_extract(source, '([0-9]+)$', 1) AS BIGINT)")
    return {"domain": F.coalesce(F.concat(F.lit("d"), (number % 4).cast("string")), F.lit("other")),
            "lang": F.col("lang"), "source": F.col("source")}


def corpus_weights() -> list[Column]:
    return [weight_of(F.col("domain"), DOMAIN_WEIGHTS), weight_of(F.col("lang"), LANGUAGE_WEIGHTS), F.lit(1)]


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return mix(docs, corpus_levels(), corpus_weights()).select(
        "doc_id", F.col("mix_domain").alias("domain"), "lang", "source", F.col("mix_tokens").alias("n_tokens"),
        F.col("mix_leaf_budget").alias("leaf_budget"), F.col("mix_epoch").alias("epoch"))


def _share_sql(level: int) -> str:
    """One level of the budget: the same rule as ``share_out``, written for the oracle."""
    path = ", ".join(LEVELS[:level])
    up = ", ".join(LEVELS[:level - 1])
    part = f"PARTITION BY {up}" if up else ""
    name = LEVELS[level - 1]
    weight = {1: "CASE domain WHEN 'd0' THEN 4 WHEN 'd1' THEN 3 WHEN 'd2' THEN 2 ELSE 1 END",
              2: "CASE lang WHEN 'en' THEN 5 WHEN 'fr' THEN 2 WHEN 'de' THEN 2 ELSE 1 END", 3: "1"}[level]
    match = " AND ".join(f"c.{c} IS NOT DISTINCT FROM b.{c}" for c in LEVELS[:level - 1])
    budget = "(SELECT CAST(floor(sum(tokens) * 0.5) AS BIGINT) FROM leaves)" if level == 1 else "b.budget"
    source = f"(SELECT {path}, sum(cap) AS cap FROM leaves GROUP BY {path}) c" + (
        "" if level == 1 else f" JOIN b{level - 1} b ON {match}")
    cols = ", ".join(f"c.{c}" for c in LEVELS[:level])
    return f"""
n{level} AS (SELECT {cols}, c.cap, {budget} AS budget, {weight.replace('CASE ', 'CASE c.') if level < 3 else weight} AS weight FROM {source}),
f{level} AS (SELECT *, CAST(cap AS DOUBLE) * sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
    <= CAST(weight AS DOUBLE) * (budget - coalesce(sum(cap) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS full_
  FROM n{level} WINDOW w AS ({part} ORDER BY cap / weight, {name} NULLS FIRST)),
b{level} AS (SELECT {path}, CASE WHEN full_ THEN cap ELSE CAST(floor(
    CAST(budget - coalesce(sum(cap) FILTER (full_) OVER g, 0) AS DOUBLE) * weight / sum(weight) FILTER (NOT full_) OVER g) AS BIGINT) END AS budget
  FROM f{level} WINDOW g AS ({part}))"""


OP7_SQL = rf"""
WITH d AS (SELECT doc_id, lang, source,
    coalesce('d' || CAST(TRY_CAST(regexp_extract(source, '([0-9]+)$', 1) AS BIGINT) % 4 AS VARCHAR), 'other') AS domain,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n_tokens FROM documents),
leaves AS (SELECT domain, lang, source, CAST(sum(n_tokens) AS BIGINT) AS tokens, CAST(sum(n_tokens) * 3 AS BIGINT) AS cap
  FROM d GROUP BY ALL),{_share_sql(1)},{_share_sql(2)},{_share_sql(3)},
plan AS (SELECT l.*, b.budget, b.budget // l.tokens AS whole, b.budget % l.tokens AS rest FROM leaves l JOIN b3 b
  ON l.domain = b.domain AND l.lang IS NOT DISTINCT FROM b.lang AND l.source IS NOT DISTINCT FROM b.source WHERE l.tokens > 0),
placed AS (SELECT d.*, p.budget, p.whole, p.rest, sha256('17:' || p.whole || ':' || coalesce(CAST(d.doc_id AS VARCHAR), '')) AS place
  FROM d JOIN plan p ON d.domain = p.domain AND d.lang IS NOT DISTINCT FROM p.lang AND d.source IS NOT DISTINCT FROM p.source),
taken AS (SELECT *, whole + CASE WHEN rest > 0 AND sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY place
    RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) <= rest THEN 1 ELSE 0 END AS copies FROM placed)
SELECT doc_id, domain, lang, source, n_tokens, CAST(budget AS BIGINT) AS leaf_budget, unnest(range(CAST(copies AS BIGINT))) AS epoch FROM taken
"""
