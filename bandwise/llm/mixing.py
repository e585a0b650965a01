"""Mixing sources to target weights by hierarchical budgeting.

1.  Supplies: tokens (words) per leaf of the tree, for instance domain, language, source.
2.  Top down, every node shares its budget among its children by their weights, but no child gets more than the supply
    below it times `max_epochs`.  What a child can't use goes to its siblings first; as no node gets a budget beyond the
    supply below it, a shortage reaches an ancestor's siblings only when all siblings are used up.  Each level is the
    closed form of that (children in order of capacity over weight), so it is two windows over a table of nodes.
3.  A leaf with quota q and supply s takes q div s whole epochs, and of the next one the documents whose tokens begin
    before q mod s, in the seeded order of that epoch (the last one taken may pass the quota by less than its length).
    The order is cut at one key per leaf: token sums per leaf and bin of the order find the bin of the cut, and only
    that bin's rows are put in order.  So a leaf with a third of all rows never meets in one task.

A null or empty text has no tokens; it comes with each whole epoch of its leaf.  A null in a path column is a value of its
own.  Rows with the same id are at the same place of the order and go together.  A weight that is null, negative or
missing counts as 0, and such a child gets nothing.  An empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bandwise.llm.common import fresh
from bandwise.session import write_through

WORD = r"[^ \t\n\x0B\f\r]+"
#: Hexadecimal digits of the order that make a bin: 4096 bins for each leaf.
BIN_DIGITS = 3


def domain() -> Column:
    """One of four domains, by the first digit of the source's MD5: the tables have no column for it."""
    return F.concat(F.lit("d"), F.expr("(locate(substring(md5(source), 1, 1), '0123456789abcdef') - 1) % 4"))


def n_words(text: Column | str) -> Column:
    column = F.col(text) if isinstance(text, str) else text
    return F.regexp_count(F.coalesce(column, F.lit("")), F.lit(WORD)).cast("long")


def order_key(id_column: Column, epoch: Column, seed: int) -> Column:
    """Place of a document in the seeded order of an epoch."""
    return F.md5(F.concat_ws("-", F.lit(str(seed)), epoch.cast("string"), F.coalesce(id_column.cast("string"), F.lit(""))))


def allocate(leaves: DataFrame, path: list[str], budget: Column, *, max_epochs: int, power: float = 0.5, weight: str | None = None) -> DataFrame:
    """leaves (path columns, supply[, weight]) with their `quota` in tokens.

    A node's weight is the sum of its leaves' weights, or its supply to the `power` if there is no such column.
    """
    node_weight = F.sum(F.greatest(F.coalesce(F.col(weight), F.lit(0.0)), F.lit(0.0))) if weight else None
    level = leaves.agg(budget.cast("double").alias("budget"), F.sum("supply").alias("all"))
    level = level.select(F.least("budget", F.col("all") * max_epochs).alias("budget"))
    for depth in range(1, len(path) + 1):
        keys, parents = path[:depth], path[: depth - 1]
        supply = F.sum("supply").cast("double")
        nodes = leaves.groupBy(*keys).agg(
            (supply * max_epochs).alias("capacity"), (node_weight if weight else F.pow(supply, power)).alias("w")
        )
        nodes = nodes.where("w > 0 and capacity > 0")
        above = level.select(*(F.col(c).alias(f"__{c}") for c in parents), F.col("budget").alias("above"))
        same = reduce(lambda a, c: a & F.col(c).eqNullSafe(F.col(f"__{c}")), parents, F.lit(True))
        nodes = nodes.join(F.broadcast(above) if not parents else above, same).drop(*(f"__{c}" for c in parents))
        family = Window.partitionBy(*parents)
        order = family.orderBy(F.col("capacity") / F.col("w"), *keys)
        before = F.coalesce(F.sum("capacity").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
        rest = F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing))
        nodes = nodes.withColumn("full", F.col("capacity") * rest <= (F.col("above") - before) * F.col("w"))
        used = F.coalesce(F.sum(F.when(F.col("full"), F.col("capacity"))).over(family), F.lit(0.0))
        open_weight = F.sum(F.when(~F.col("full"), F.col("w"))).over(family)
        share = F.when(F.col("full"), F.col("capacity")).otherwise((F.col("above") - used) / open_weight * F.col("w"))
        level = nodes.withColumn("budget", share).select(*keys, "budget")
    return level.withColumn("quota", F.floor(F.greatest("budget", F.lit(0.0)) + 1e-6)).drop("budget")


def leaf_cuts(
    docs: DataFrame, path: list[str], *, id_column: str, text_column: str, budget_ratio: float, max_epochs: int, seed: int,
    power: float = 0.5, weights: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Documents (id, path, tokens), and per leaf: supply, quota, epochs (whole ones) and cut (last key of the next)."""
    narrow = docs.select(F.col(id_column).alias("id"), *(F.col(c).alias(c) for c in path), n_words(text_column).alias("tokens"))
    narrow = write_through(narrow, "mix-tokens")
    leaves = narrow.groupBy(*path).agg(F.sum("tokens").alias("supply"))
    if weights is not None:
        leaves = leaves.alias("l").join(weights.select(*path, "weight").alias("w"), same_columns("l", "w", path), "left")
        leaves = leaves.select(*(F.col(f"l.{c}").alias(c) for c in path), "supply", "weight")
    leaves = write_through(leaves, "mix-leaves")
    quota = allocate(
        leaves, path, F.floor(F.sum("supply") * budget_ratio), max_epochs=max_epochs, power=power, weight="weight" if weights is not None else None
    )
    leaves = leaves.alias("l").join(quota.alias("q"), same_columns("l", "q", path), "left")
    leaves = leaves.select(*(F.col(f"l.{c}").alias(c) for c in path), "supply", F.coalesce("quota", F.lit(0)).alias("quota"))
    leaves = leaves.withColumn("epochs", F.when(F.col("supply") > 0, F.expr("quota div supply")).otherwise(0))
    leaves = write_through(leaves.withColumn("rest", F.col("quota") - F.col("epochs") * F.col("supply")), "mix-quota")
    partial = leaves.where("rest > 0")
    keyed = narrow.alias("n").join(partial.alias("p"), same_columns("n", "p", path))
    keyed = keyed.select(*(F.col(f"n.{c}").alias(c) for c in path), "tokens", "rest", order_key(F.col("id"), F.col("epochs"), seed).alias("key"))
    keyed = keyed.withColumn("bin", F.substring("key", 1, BIN_DIGITS))
    sums = keyed.groupBy(*path, "bin", "rest").agg(F.sum("tokens").alias("tokens"))
    upto = Window.partitionBy(*path).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    sums = sums.withColumn("last", F.sum("tokens").over(upto)).withColumn("start", F.col("last") - F.col("tokens"))
    cut_bin = sums.where("start < rest and last >= rest").select(*path, "bin", "start")
    inside = keyed.alias("k").join(cut_bin.alias("b"), same_columns("k", "b", [*path, "bin"]))
    inside = inside.groupBy(*(F.col(f"k.{c}").alias(c) for c in path), "rest", "start", "key").agg(F.sum("tokens").alias("tokens"))
    running = Window.partitionBy(*path).orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    inside = inside.withColumn("begins", F.col("start") + F.coalesce(F.sum("tokens").over(running), F.lit(0)))
    cuts = inside.where("begins < rest").groupBy(*path).agg(F.max("key").alias("cut"))
    done = leaves.alias("l").join(cuts.alias("c"), same_columns("l", "c", path), "left")
    done = done.select(*(F.col(f"l.{c}").alias(c) for c in path), "supply", "quota", "epochs", "cut")
    return narrow, write_through(done, "mix-cuts")


def same_columns(left: str, right: str, keys: list[str]) -> Column:
    return reduce(lambda x, c: x & F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}")), keys, F.lit(True))


def _copies(id_column: Column, seed: int) -> Column:
    taken = order_key(id_column, F.col("epochs"), seed) <= F.col("cut")
    return (F.col("epochs") + F.coalesce(taken, F.lit(False)).cast("long")).cast("int")


def plan(
    docs: DataFrame, path: list[str], *, id_column: str = "doc_id", text_column: str = "text", budget_ratio: float = 1.0, max_epochs: int = 2,
    seed: int = 17, power: float = 0.5, weights: DataFrame | None = None,
) -> DataFrame:
    """One row per row of docs: id, path, tokens, copies (epochs it is part of), and its leaf's supply and quota."""
    narrow, leaves = leaf_cuts(
        docs, path, id_column=id_column, text_column=text_column, budget_ratio=budget_ratio, max_epochs=max_epochs, seed=seed, power=power, weights=weights,
    )
    rows = narrow.alias("n").join(leaves.alias("l"), same_columns("n", "l", path))
    return rows.select(
        F.col("n.id").alias(id_column), *(F.col(f"n.{c}").alias(c) for c in path), "tokens",
        _copies(F.col("n.id"), seed).alias("copies"), "supply", "quota",
    )


def mix(docs: DataFrame, path: dict[str, Column], *, id_column: str = "doc_id", text_column: str = "text", seed: int = 17, **options) -> DataFrame:
    """The rows of docs, each as often as it is taken; only the table of leaves is joined, texts are not moved.

    `path` names the levels of the tree and their expressions over docs.
    """
    *names, copies, copy = fresh(docs, *(f"__{name}" for name in path), "__copies", "__copy")
    placed = docs.select("*", *(c.alias(n) for n, c in zip(names, path.values(), strict=True)))
    settings = {"budget_ratio": 1.0, "max_epochs": 2, "power": 0.5} | options
    _, leaves = leaf_cuts(placed, names, id_column=id_column, text_column=text_column, seed=seed, **settings)
    rows = placed.alias("d").join(leaves.alias("l"), same_columns("d", "l", names))
    times = _copies(F.col(f"d.{id_column}"), seed)
    taken = rows.select("d.*", times.alias(copies)).where(F.col(copies) > 0)
    return taken.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*docs.columns)
