"""Mixing sources to target weights: hierarchical budgets and seeded token prefixes, in built-in functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common
from .quality import words_of

#: Target shares of the registered query: by length class (short texts below 1,000 characters, long ones from 10,000 on), and a few leaves.
TARGETS = {
    ("long",): 0.45, ("medium",): 0.45, ("short",): 0.1,
    ("long", "en"): 0.4, ("long", "de"): 0.25, ("long", "fr"): 0.2, ("long", "es"): 0.15,
    ("medium", "en"): 0.5, ("medium", "de"): 0.2, ("medium", "fr"): 0.2, ("medium", "es"): 0.1,
}
SPACE = 1 << 62
SLICES = 1 << 12


def length_class(text: Column) -> Column:
    """The domain of a text where tables name none: short, medium or long."""
    n = F.char_length(F.coalesce(text.cast("string"), F.lit("")))
    return F.when(n < 1_000, "short").when(n < 10_000, "medium").otherwise("long")


def leaf_budgets(leaves: DataFrame, levels: tuple[str, ...], total: Column, weights: dict[tuple[str, ...], float], power: float, most_epochs: int) -> DataFrame:
    """``leaves`` (one column a level, tokens) with ``budget``.

    From the root down, a node's budget is dealt to its children in proportion to their weights, none getting more than
    its subtree can give (tokens times ``most_epochs``); what a child can't take goes to its siblings, so a shortage
    leaves a node only when the whole node is exhausted. A child's weight is the one given for its path, or else its
    tokens to the ``power``.
    """
    out = leaves.withColumn("_budget", total.cast("double"))
    for depth, level in enumerate(levels):
        path, parent = list(levels[: depth + 1]), list(levels[:depth])
        w = F.pow(F.col("_tokens").cast("double"), F.lit(power))
        for key, value in weights.items():
            if len(key) == depth + 1:
                w = F.when(F.concat_ws("\0", *[F.coalesce(c, F.lit("")) for c in path]) == "\0".join(key), F.lit(float(value))).otherwise(w)
        nodes = out.groupBy(*path).agg(F.sum("tokens").alias("_tokens"), F.first("_budget").alias("_budget"))
        nodes = nodes.withColumn("_cap", F.col("_tokens") * F.lit(float(most_epochs))).withColumn("_w", F.when(F.col("_cap") > 0, w).otherwise(0.0))
        nodes = nodes.withColumn("_r", F.when(F.col("_w") > 0, F.col("_cap") / F.when(F.col("_w") > 0, F.col("_w"))).otherwise(F.lit(float("inf"))))
        family = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
        ranked = family.orderBy("_r", *path)
        before = F.coalesce(F.sum("_cap").over(ranked.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
        rest = F.sum("_w").over(ranked.rowsBetween(0, Window.unboundedFollowing))
        level_now = F.when(rest > 0, (F.greatest(F.col("_budget") - before, F.lit(0.0))) / F.when(rest > 0, rest))
        nodes = nodes.withColumn("_level", level_now)
        nodes = nodes.withColumn("_level", F.max(F.when(F.col("_level") < F.col("_r"), F.col("_level"))).over(family))
        share = F.when(F.col("_w") <= 0, 0.0).otherwise(F.least(F.col("_cap"), F.coalesce(F.col("_w") * F.col("_level"), F.col("_cap"))))
        dealt = nodes.select(*[F.col(c).alias(f"_{c}") for c in path], share.alias("_dealt"))
        same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in path]
        out = out.join(common.small(common.durable(dealt)), same).select(*leaves.columns, F.col("_dealt").alias("_budget"))
    return out.select(*leaves.columns, F.floor(F.col("_budget") + 1e-6).cast("long").alias("budget"))


def mix_sources(
    docs: DataFrame, share: float = 0.6, weights: dict[tuple[str, ...], float] | None = None, power: float = 0.7, most_epochs: int = 1,
    seed: int = 0, domain: Column | None = None, tokens: Column | None = None, most_leaves: int = 100_000, carry: tuple[str, ...] = (),
) -> DataFrame:
    """doc_id, domain, lang, source, n_tokens, copies, kept; and the columns ``carry``: one row per document.

    The budget is ``share`` of all tokens, dealt down the tree domain - language - source. A leaf reads its documents in
    the order of a seeded hash, another one in each epoch; it takes whole epochs, then the prefix of the next one that has
    just as many tokens as its budget has left. copies says how often a document was taken whole (kept: at all), taken how many of its
    tokens were: the document in which a prefix ends counts up to there, so all of the budget is used where there are tokens for it.

    The running sum that finds the end of a prefix is taken over at most ``SLICES`` slices of the hash range first (one
    row each); only the documents of the slice in which the prefix ends are sorted, so a leaf that holds a third of all
    rows is dealt over all tasks.
    Defaults: domain is the part of source before its first digit, tokens are words. Trees of more than ``most_leaves`` leaves
    are joined by a shuffle instead of a broadcast.

    Null domain, language or source is a leaf of its own. Documents without tokens are taken with the prefix they stand
    in. Repeated rows stand together in the order and share their fate at its end where both fit. Empty input gives no rows.
    """
    given = {f"_in_{i}": c for i, c in enumerate(carry)}
    where = domain if domain is not None else F.regexp_extract(F.col("source").cast("string"), "^([^0-9]*)", 1)
    size = tokens if tokens is not None else F.size(words_of(F.col("text").cast("string")))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), where.alias("domain"), F.col("lang").cast("string").alias("lang"),
        F.col("source").cast("string").alias("source"), size.cast("long").alias("n_tokens"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("_k"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("_t"),
        *[F.col(c).alias(a) for a, c in given.items()],
    )
    levels = ("domain", "lang", "source")
    leaves = common.durable(rows.groupBy(*levels).agg(F.sum("n_tokens").alias("tokens")))
    total = float(leaves.agg(F.sum("tokens").alias("n")).first()["n"] or 0) * share
    plan = leaf_budgets(leaves, levels, F.lit(total), weights or {}, power, most_epochs)
    epochs = F.when(F.col("tokens") > 0, F.least(F.lit(most_epochs).cast("double"), F.floor(F.col("budget") / F.when(F.col("tokens") > 0, F.col("tokens"))))).otherwise(0)
    plan = plan.withColumn("_full", epochs.cast("int")).withColumn("_rest", F.col("budget") - F.col("_full") * F.col("tokens"))
    plan = common.durable(plan.select(*[F.col(c).alias(f"_{c}") for c in levels], "_full", "_rest"))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in levels]
    drop = [f"_{c}" for c in levels]
    placed = rows.join(common.small(plan, most_leaves), same).drop(*drop)
    placed = placed.withColumn("_u", F.pmod(F.xxhash64("_k", "_t", F.lit(seed), F.col("_full")), F.lit(SPACE)))
    placed = placed.withColumn("_slice", F.shiftright("_u", 50).cast("int"))
    sums = placed.groupBy(*levels, "_slice").agg(F.sum("n_tokens").alias("_n"), F.first("_rest").alias("_rest"))
    running = Window.partitionBy(*levels).orderBy("_slice")
    sums = sums.withColumn("_upto", F.sum("_n").over(running))
    ends = sums.filter(F.col("_upto") > F.col("_rest")).groupBy(*levels).agg(F.min(F.struct("_slice", (F.col("_upto") - F.col("_n")).alias("_before"))).alias("e"))
    ends = common.durable(ends.select(*[F.col(c).alias(f"_{c}") for c in levels], F.col("e._slice").alias("_end"), F.col("e._before").alias("_before")))
    placed = placed.join(common.small(ends, most_leaves), same, "left").drop(*drop)
    inner = Window.partitionBy(*levels).orderBy("_u", "_k", "_t")
    last = placed.filter(F.col("_slice") == F.col("_end"))
    last = last.withColumn("_left", F.col("_rest") - F.col("_before") - F.sum("n_tokens").over(inner.rowsBetween(Window.unboundedPreceding, 0)))
    last = last.withColumn("_in", F.col("_left") >= 0).withColumn("_cut", F.greatest(F.lit(0), F.col("n_tokens") + F.col("_left"))).drop("_left")
    other = placed.filter(F.col("_end").isNull() | (F.col("_slice") != F.col("_end"))).withColumn("_in", F.col("_end").isNull() | (F.col("_slice") < F.col("_end"))).withColumn("_cut", F.lit(0))
    extra = F.when(F.col("_in") & (F.col("_full") < most_epochs), 1).otherwise(0)
    out = other.unionByName(last).withColumn("copies", (F.col("_full") + extra).cast("int"))
    part = F.when(~F.col("_in") & (F.col("_full") < most_epochs), F.col("_cut")).otherwise(0)
    taken = (F.col("copies") * F.col("n_tokens") + part).cast("long").alias("taken")
    return out.select("doc_id", *levels, "n_tokens", "copies", (F.col("copies") > 0).alias("kept"), taken, *[F.col(a).alias(c) for a, c in given.items()])
