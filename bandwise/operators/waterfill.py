"""Capped weighted water-filling in closed form."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from bandwise.functions.stats import CELL_ROWS, PARTS, ROUNDS, held_with, order_bucket


def water_levels(
    rows: DataFrame, keys: Sequence[str], *, room: Column, weight: Column, amounts: DataFrame,
    unfold: Callable[[DataFrame], DataFrame] | None = None, packed: Sequence[str] = (),
) -> DataFrame:
    """Water level per group: rows get ``least(room, level * weight)``, together ``amount`` if there is room.

    ``amounts``: the keys and ``amount``.  Rows without room or weight take no part; a group without
    any gives no row.  A row is full at the level room / weight.  One pass sums up room and weight by
    cells of neighbouring ratios; the water stands in one cell, and below and above it sums are all
    that counts.  Only the rows of that cell are read again: cells of many rows are cut into parts
    between their least and largest ratio, and the different ratios of small ones are put in order.
    So neither a house nor a household is ever sorted, or held, in one task.

    ``unfold`` repeats rows for a grid and adds the keys ``packed``: then rows meet the cells to read again before they
    are repeated, and only rows of these cells are shuffled one by one.
    """
    keys = list(keys)

    def measured(repeated: DataFrame, *more: str) -> DataFrame:
        found = repeated.select(*keys, *more, room.alias("_room"), weight.alias("_w")).where((F.col("_w") > 0) & (F.col("_room") > 0))
        return found.withColumn("_v", F.col("_room") / F.col("_w")).withColumn("_c0", order_bucket(F.col("_v")))

    def inside(usable: DataFrame, cells: DataFrame) -> DataFrame:
        """Rows of the cells, with the columns of these."""
        if unfold is None or len(path) > 1:
            return usable.join(cells, [*keys, *path])
        shared = [k for k in keys if k not in packed]
        fields = [c for c in cells.columns if c not in shared]
        lists = cells.groupBy(*shared).agg(F.collect_list(F.struct(*fields)).alias("_open"))  # one per member of the grid
        near = measured(unfold(rows.join(lists, shared)), "_open")
        same = [*packed, "_c0"]
        mine = F.filter("_open", lambda c: reduce(and_, [c[k] == F.col(k) for k in same]))
        near = near.withColumn("_mine", F.get(mine, F.lit(0))).where(F.col("_mine").isNotNull())
        return near.select(*keys, "_room", "_w", "_v", "_c0", *[F.col(f"_mine.{c}").alias(c) for c in fields if c not in same])

    usable = measured(rows if unfold is None else unfold(rows))
    path, ends = ["_c0"], []
    given = amounts.select(*keys, F.col("amount").alias("_amount"), F.lit(0.0).alias("_under"), F.lit(0.0).alias("_over"))
    # the group as the first cell: what is below it and above it is nothing
    cell, largest = held_with(_standing(_cells(usable, [*keys, "_c0"]), given, keys, "_c0"), "levels", _wide_rows())
    ends.append(cell)
    while largest and largest > CELL_ROWS and len(path) <= ROUNDS:
        step = f"_c{len(path)}"
        edges = cell.where(_wide()).select(*keys, *path, F.col("_lo").alias("_from"), F.col("_hi").alias("_to"))
        part = F.least(F.floor((F.col("_v") - F.col("_from")) / (F.col("_to") - F.col("_from")) * PARTS), F.lit(PARTS - 1)).cast("int")
        usable = inside(usable, edges).withColumn(step, part).drop("_from", "_to")
        parent = cell.where(_wide()).select(*keys, *path, "_amount", "_under", "_over")
        cells = _cells(usable, [*keys, *path, step])
        cell, largest = held_with(_standing(cells, parent, [*keys, *path], step), "levels", _wide_rows())
        ends.append(cell)
        path.append(step)
    found = [c.where(~_wide()).select(*keys, _level().alias("level")) for c in ends]
    if largest:
        still = cell.where(_wide())
        ranked = inside(usable, still.select(*keys, *path)).withColumn("_ratio", F.col("_v"))
        parent = still.select(*keys, *path, "_amount", "_under", "_over")
        cells = _standing(_cells(ranked, [*keys, *path, "_ratio"]), parent, [*keys, *path], "_ratio")
        found.append(cells.select(*keys, _level().alias("level")))
    levels = found[0]
    for more in found[1:]:
        levels = levels.unionByName(more)
    return levels


def _cells(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(
        F.count("*").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"),
        F.sum("_room").alias("_room"), F.sum("_w").alias("_w"),
    )


def _standing(cells: DataFrame, parent: DataFrame, keys: list[str], step: str) -> DataFrame:
    """The cell in which the water stands: the last one whose least ratio it reaches, or the first one."""
    below = Window.partitionBy(*keys).orderBy(step).rowsBetween(Window.unboundedPreceding, -1)
    above = Window.partitionBy(*keys).orderBy(F.desc(step)).rowsBetween(Window.unboundedPreceding, -1)
    placed = cells.select(
        "*",
        F.coalesce(F.sum("_room").over(below), F.lit(0.0)).alias("_room_under"),
        F.coalesce(F.sum("_w").over(above), F.lit(0.0)).alias("_w_over"),
    )
    placed = placed.join(parent, keys).withColumns(
        {"_under": F.col("_under") + F.col("_room_under"), "_over": F.col("_over") + F.col("_w_over")}
    )
    reached = F.col("_under") + F.col("_lo") * (F.col("_w") + F.col("_over")) <= F.col("_amount")
    fields = [c for c in placed.columns if c not in (*keys, step, "_room_under", "_w_over")]
    whole = F.struct(step, *fields)
    chosen = F.coalesce(F.max(F.when(reached, whole)), F.min(whole))
    return placed.groupBy(*keys).agg(chosen.alias("_cell")).select(*keys, "_cell.*")


def _reaches_end() -> Column:
    """Whether all of the cell is full."""
    return F.col("_under") + F.col("_room") + F.col("_hi") * F.col("_over") <= F.col("_amount")


def _wide() -> Column:
    """Whether the level depends on which rows of the cell are full."""
    begins = F.col("_under") + F.col("_lo") * (F.col("_w") + F.col("_over")) <= F.col("_amount")
    return (F.col("_lo") < F.col("_hi")) & begins & ~_reaches_end()


def _wide_rows() -> Column:
    return F.max(F.when(_wide(), F.col("_n")))


def _level() -> Column:
    """Level of a cell that is full, not reached, or of one ratio."""
    rest = F.greatest(F.col("_amount") - F.col("_under"), F.lit(0.0))
    full = F.when(F.col("_over") > 0, F.greatest((rest - F.col("_room")) / F.col("_over"), F.col("_hi"))).otherwise(F.col("_hi"))
    return F.when(_reaches_end(), full).otherwise(rest / (F.col("_w") + F.col("_over")))


def waterfill(
    df: DataFrame,
    group: Sequence[str],
    *,
    weight: str,
    current: str,
    cap: str,
    amount: str,
    name: str = "filled",
) -> DataFrame:
    """Add up to ``amount`` per group to ``current`` without passing ``cap``, by ``weight``.

    Negative weights count as zero.  Rows of weight zero get nothing while a weighted row has
    room; what is left then is split equally among them.  A group may have any number of rows.
    """
    keys = list(group)
    rows = (
        df.withColumn("_room", F.greatest(F.col(cap) - F.col(current), F.lit(0.0)))
        .withColumn("_amount", F.greatest(F.col(amount), F.lit(0.0)))
        .withColumn("_w", F.greatest(F.coalesce(F.col(weight), F.lit(0.0)), F.lit(0.0)))
    )
    for phase in ("_w", "_equal"):
        if phase == "_equal":
            # what weighted rows could not take goes in equal shares to rows without weight
            spent = rows.groupBy(*keys).agg(F.sum("_add").alias("_spent"))
            rows = (
                rows.join(spent, keys)
                .withColumn(
                    "_amount", F.greatest(F.col("_amount") - F.col("_spent"), F.lit(0.0))
                )
                .withColumn("_equal", F.when(F.col("_w") > 0, F.lit(0.0)).otherwise(F.lit(1.0)))
                .drop("_spent")
            )
        amounts = rows.groupBy(*keys).agg(F.max("_amount").alias("amount"))
        levels = water_levels(rows, keys, room=F.col("_room"), weight=F.col(phase), amounts=amounts)
        levels = levels.withColumnRenamed("level", "_level")
        rows = rows.join(levels, keys, "left")
        share = F.least(F.col("_room"), F.coalesce(F.col("_level"), F.lit(0.0)) * F.col(phase))
        added = share if phase == "_w" else F.col("_add") + share
        rows = rows.withColumn("_add", added).drop("_level")
    return rows.withColumn(name, F.col(current) + F.col("_add")).drop(
        "_room", "_amount", "_w", "_equal", "_add"
    )
