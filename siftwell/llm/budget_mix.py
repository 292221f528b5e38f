"""Mixing sources to target weights by hierarchical budgets.

A token budget flows down a tree, here domain - language - source. At each node it is split among the children by
weight, no child getting more than its whole subtree can supply (its tokens times ``max_epochs``); what a child cannot
use goes to its siblings by weight, and only what all siblings together cannot use is left to the level above, because
a node is never handed more than its subtree holds. A leaf with budget B and S tokens gives ``B div S`` whole epochs
and then the longest prefix, in that epoch's seeded order, whose tokens stay within ``B mod S``.

Only DataFrame functions are used. A leaf may hold any share of the rows: its order is cut into buckets of the seeded
hash, bucket sums place the boundary, and only rows of the boundary bucket are put in order.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import save

#: Buckets of a leaf's order. 3 hexadecimal digits of the md5.
BUCKET_DIGITS = 3
#: Leaves up to which the plan is broadcast; more are joined.
BROADCAST_LEAVES = 50_000
WORD = r"[^ \t\n\r\f\x0B]+"


def word_count(text: Column) -> Column:
    """Words between ASCII white space; none in a null text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def weight_of(name: Column, weights: Mapping[str, float], default: float = 1.0) -> Column:
    out = F.lit(float(default))
    for k, v in weights.items():
        out = F.when(name == k, F.lit(float(v))).otherwise(out)
    return out


def order_key(seed: int, epoch: Column, key: Column) -> Column:
    return F.md5(F.concat_ws("/", F.lit(str(seed)), epoch.cast("string"), key))


def split_budget(nodes: DataFrame, parent: Sequence[str]) -> DataFrame:
    """Water-filling: nodes(parent.., w, cap, budget of the parent) plus ``share``, at most cap, summing to min(budget, sum of caps).

    Children are ordered by cap / w. A child is filled to its cap while the level that the rest would reach, (budget -
    caps before) / (weights from here on), is at least its own cap / w; the others get that level times their weight,
    rounded down (so a node may leave fewer tokens than it has children unspent). Children of weight 0 get nothing.
    """
    order = Window.partitionBy(*parent).orderBy("ratio", "name")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy(*parent)
    filled = F.when(F.col("level") >= F.col("ratio"), 1).otherwise(0)
    return (
        nodes.where("w > 0")
        .withColumn("ratio", F.col("cap") / F.col("w"))
        .withColumn("level", (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("w").over(after))
        .withColumn("filled", filled)
        .withColumn("rest", F.min(F.when(F.col("filled") == 0, F.struct("ratio", "name", "level"))).over(whole)["level"])
        .withColumn("share", F.when(F.col("filled") == 1, F.col("cap")).otherwise(F.least(F.col("cap"), F.floor(F.greatest(F.lit(0.0), F.col("rest")) * F.col("w")).cast("long"))))
        .drop("ratio", "level", "filled", "rest")
    )


def leaf_budgets(leaves: DataFrame, levels: Sequence[str], weights: Sequence[Mapping[str, float]], budget: Column, max_epochs: int) -> DataFrame:
    """leaves(levels.., tokens) plus ``budget``: the tokens that each leaf is to give."""
    caps = leaves.withColumn("cap", F.col("tokens") * F.lit(max_epochs))
    current = leaves.groupBy().agg(F.sum("tokens").alias("t")).select(budget.cast("long").alias("budget"), F.lit(0).alias("root"))
    parent: list[str] = ["root"]
    for i, level in enumerate(levels):
        path = list(levels[: i + 1])
        nodes = caps.groupBy(*path).agg(F.sum("cap").alias("cap")).withColumn("root", F.lit(0)).withColumn("w", weight_of(F.col(level), weights[i])).withColumn("name", F.col(level))
        current = split_budget(nodes.join(current, parent), parent).select("root", *path, F.col("share").alias("budget"))
        parent = ["root", *path]
    return leaves.join(current.drop("root"), list(levels), "left").withColumn("budget", F.coalesce("budget", F.lit(0)))


def mix(
    docs: DataFrame,
    levels: Mapping[str, Column],
    weights: Sequence[Mapping[str, float]],
    budget_share: float = 0.75,
    max_epochs: int = 2,
    seed: int = 7,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """The rows of ``docs`` that are chosen, all their columns, plus ``mix_<level>`` and ``mix_copies`` (1 to max_epochs).

    levels: name and expression of each level, root first; null names count as ``(none)``. The budget is that share of
    all tokens. A row without tokens costs nothing and is chosen with its place in the order; a leaf without any tokens gives
    nothing. Rows with the same id sort by tokens; equal rows are all counted. An empty table gives no rows.
    Tokens are words between ASCII white space. Columns of ``docs`` that are called as the new ones give way to them.
    """
    names = [f"mix_{x}" for x in levels]
    if "mix_copies" in names or len({n.lower() for n in names}) < len(names):
        raise ValueError("levels need names that differ from each other and from 'copies'")
    kept = [c for c in docs.columns if c.lower() not in {*map(str.lower, names), "mix_copies"}]
    # the operator's own columns are named apart from those of docs, whatever these are called
    placed = docs.select(
        *[F.col(f"`{c}`").alias(f"mixing__c{i}") for i, c in enumerate(kept)], F.col(id_col).alias("mixing__id"), F.col(text_col).alias("mixing__text"), *[F.coalesce(c.cast("string"), F.lit("(none)")).alias(n) for n, c in zip(names, levels.values(), strict=True)]
    )
    id_col, text_col = "mixing__id", "mixing__text"
    # rows without id are ordered by their text, so that they do not share one place
    key = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("null/"), F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))))

    sums = save(
        placed.select(*names, key.alias("mixing__key"), word_count(F.col(text_col)).alias("mixing__n"))
        .select(*names, "mixing__n", "mixing__key", F.explode(F.array(*[F.lit(e) for e in range(max_epochs)])).alias("mixing__epoch"))
        .groupBy(*names, "mixing__epoch", F.substring(order_key(seed, F.col("mixing__epoch"), F.col("mixing__key")), 1, BUCKET_DIGITS).alias("mixing__bucket"))
        .agg(F.sum("mixing__n").alias("tokens")),
        "mix-sums",
    )
    leaves = sums.where("mixing__epoch = 0").groupBy(*names).agg(F.sum("tokens").alias("tokens"))
    plan = leaf_budgets(leaves, names, weights, F.floor(F.col("t") * F.lit(budget_share)), max_epochs)
    plan = plan.select(
        *names,
        F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens"))).otherwise(0).cast("int").alias("mixing__whole"),
        F.when(F.col("tokens") > 0, F.col("budget") % F.col("tokens")).otherwise(0).alias("mixing__part"),
    )
    running = Window.partitionBy(*names).orderBy("mixing__bucket").rowsBetween(Window.unboundedPreceding, 0)
    # the boundary bucket of each leaf: the first whose running sum passes the part to be given
    edges = (
        sums.join(plan, names)
        .where("mixing__epoch = mixing__whole")
        .withColumn("upto", F.sum("tokens").over(running))
        .where("upto > mixing__part")
        .groupBy(*names)
        .agg(F.min(F.struct("mixing__bucket", (F.col("upto") - F.col("tokens")).alias("before"))).alias("edge"))
    )
    plan = save(plan.join(edges, names, "left").select(*names, "mixing__whole", "mixing__part", F.col("edge.mixing__bucket").alias("mixing__edge"), F.col("edge.before").alias("mixing__before")), "mix-plan")
    if plan.count() <= BROADCAST_LEAVES:
        plan = F.broadcast(plan)
    at = placed.join(plan, names).withColumn("mixing__key", order_key(seed, F.col("mixing__whole"), key)).withColumn("mixing__bucket", F.substring("mixing__key", 1, BUCKET_DIGITS))
    keep = [*[F.col(f"mixing__c{i}").alias(c) for i, c in enumerate(kept)], *names, "mix_copies"]
    clear = at.where("mixing__edge is null or mixing__bucket <> mixing__edge").withColumn("mix_copies", F.col("mixing__whole") + F.when(F.col("mixing__edge").isNull() & (F.col("mixing__part") == 0), 0).when(F.col("mixing__edge").isNull() | (F.col("mixing__bucket") < F.col("mixing__edge")), 1).otherwise(0))
    inside = Window.partitionBy(*names).orderBy("mixing__key", "mixing__n").rowsBetween(Window.unboundedPreceding, 0)
    edge = (
        at.where("mixing__bucket = mixing__edge")
        .withColumn("mixing__n", word_count(F.col(text_col)))
        .withColumn("mixing__upto", F.col("mixing__before") + F.sum("mixing__n").over(inside))
        .withColumn("mix_copies", F.col("mixing__whole") + F.when(F.col("mixing__upto") <= F.col("mixing__part"), 1).otherwise(0))
    )
    return clear.select(*keep).unionByName(edge.select(*keep)).where("mix_copies > 0")
