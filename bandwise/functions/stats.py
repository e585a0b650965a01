"""Exact order statistics, tail means, rank correlation and prefix sums that split hot groups."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from bandwise.session import write_through

#: Parts that a cell of values is cut into in one round, and rows of a cell whose values are ranked at once.  A bucket of
#: `order_bucket` holds at most 2**46 different doubles, so two rounds leave at most 2**18 different values in a cell.
PARTS, ROUNDS, CELL_ROWS = 16_384, 2, 100_000


def to_digits(value: Column, digits: int | None) -> Column:
    """The value itself, or rounded to so many digits, for comparisons with a tolerance."""
    return value if digits is None else F.round(value, digits)


def order_bucket(value: Column) -> Column:
    """Order-preserving bucket of a double: about 64 buckets per power of two, 0 for zero."""
    magnitude = F.floor((F.log2(F.abs(value)) + F.lit(1100.0)) * F.lit(64.0)) + F.lit(1)
    return (
        F.when(value == 0, F.lit(0))
        .when(value > 0, magnitude)
        .otherwise(-magnitude)
        .cast("int")
    )


def unit_of(scale: Column) -> Column:
    """A power of two far below a positive scale, in which `coarse` counts; 1 without such a scale."""
    return F.when(scale > 0, F.pow(F.lit(2.0), F.floor(F.log2(scale)) - F.lit(24))).otherwise(F.lit(1.0))


def coarse(value: Column, unit: Column) -> Column:
    """Whole units of a value.  Sums of them are exact, whatever their order, up to 2**53 units; what a value has
    beyond them is tiny.  So the two sums together hold a total of any number of rows to its last digits."""
    return F.rint(value / unit) * unit


Powers = Mapping[str, Callable[[Column], Column]]
#: What tail means and top shares add up: the values themselves.
VALUES: Powers = {"s": lambda v: v}


def order_statistics(
    df: DataFrame,
    keys: Sequence[str],
    value: Column,
    ranks: Mapping[str, Callable[[Column], Column]],
    *,
    powers: Powers = VALUES,
    sums: Mapping[str, Column] | None = None,
) -> DataFrame:
    """The values at some ranks (from 0, ascending) of each group, with the sums above them.

    A rank is a function of the group's row count ``n``.  Its column is a struct: ``v``, the value;
    ``ties``, the rows that equal it; ``above``, the rows above it; and for each of ``powers``
    (functions of a value) ``above_<name>``, their sum over those rows.  Also returned per group:
    ``n``, ``least``, ``most``, ``total_<name>`` of the powers, and ``sums`` of other expressions.
    Null values are no rows; a group without any gives none, and keys are not null.

    One pass counts the rows by cells of neighbouring values.  Each wanted rank lies in one cell, and
    most cells tell its value by their least and largest.  Only rows of the others are read again:
    cells of many rows are cut into parts between these two, which are cells again, and the
    different values of small ones are ranked.  Equal values are counted together on the map side.
    So no task ever holds a group, or all rows of one value; the driver learns the rows of the
    largest open cell.  Between passes only the cells with wanted ranks are kept, in a table.
    """
    extra = dict(sums or {})
    named = {f"_k{i}": F.col(k) for i, k in enumerate(keys)}
    rows = df.select(
        *[c.alias(n) for n, c in named.items()], value.cast("double").alias("_v"), *[c.alias(f"_x_{n}") for n, c in extra.items()]
    )
    rows = rows.where(F.col("_v").isNotNull()).withColumn("_c0", order_bucket(F.col("_v")))
    group, path = list(named), ["_c0"]
    added = [f"_p_{n}" for n in powers]
    measured = [
        F.count("*").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"),
        *[F.sum(f(F.col("_v"))).alias(f"_p_{n}") for n, f in powers.items()],
    ]
    cells = rows.groupBy(*group, "_c0").agg(*measured, *[F.sum(f"_x_{n}").alias(f"_x_{n}") for n in extra])
    whole = Window.partitionBy(*group)
    totals = {
        "n": F.sum("_n").over(whole), "least": F.min("_lo").over(whole), "most": F.max("_hi").over(whole),
        **{f"total_{n}": F.sum(f"_p_{n}").over(whole) for n in powers}, **{n: F.sum(f"_x_{n}").over(whole) for n in extra},
    }
    placed = _placed(cells, group, "_c0", ["_n", *added]).withColumns(totals)
    wanted = F.array(*[F.struct(F.lit(n).alias("_name"), f(F.col("n")).cast("long").alias("_rank")) for n, f in ranks.items()])
    inside = (F.col("_rank") >= F.col("_before")) & (F.col("_rank") < F.col("_before") + F.col("_n"))
    hit = placed.select("*", F.inline(wanted)).where(inside).withColumn("_rank", F.col("_rank") - F.col("_before"))
    hit, largest = held_with(hit.drop("_before", *[f"_x_{n}" for n in extra]), "ranks", _open_rows())
    settled, still = _settle(hit, powers), hit.where(_open())
    rows = rows.drop(*[f"_x_{n}" for n in extra])
    while largest and largest > CELL_ROWS and len(path) <= ROUNDS:
        edges = still.select(*group, *path, F.col("_lo").alias("_from"), F.col("_hi").alias("_to")).distinct()
        part = F.least(F.floor((F.col("_v") - F.col("_from")) / (F.col("_to") - F.col("_from")) * PARTS), F.lit(PARTS - 1)).cast("int")
        step = f"_c{len(path)}"
        rows = rows.join(edges, [*group, *path]).withColumn(step, part).drop("_from", "_to")
        hit = _descend(rows.groupBy(*group, *path, step).agg(*measured), still, group, path, step, added)
        hit, largest = held_with(hit, "ranks", _open_rows())
        settled = settled.unionByName(_settle(hit, powers))
        path.append(step)
        still = hit.where(_open())
    if largest:
        ranked = rows.join(still.select(*group, *path).distinct(), [*group, *path]).withColumn("_value", F.col("_v"))
        cells = ranked.groupBy(*group, *path, "_value").agg(*measured)
        settled = settled.unionByName(_settle(_descend(cells, still, group, path, "_value", added), powers))
    wide = settled.groupBy(*group).agg(
        *[F.first(n).alias(n) for n in totals],
        *[F.max(F.when(F.col("_name") == n, F.col("_found"))).alias(n) for n in ranks],
    )
    return wide.select(*[F.col(n).alias(k) for n, k in zip(group, keys, strict=True)], *totals, *ranks)


def _open() -> Column:
    """Cells whose least and largest value do not tell all others."""
    return (F.col("_lo") < F.col("_hi")) & (F.col("_n") > 2)


def _open_rows() -> Column:
    return F.max(F.when(_open(), F.col("_n")))


def held_with(table: DataFrame, name: str, figure: Column) -> tuple[DataFrame, int | None]:
    """Write a table through, with one figure of its rows that the write observes."""
    seen = Observation()
    written = write_through(table.observe(seen, figure.alias("figure")), name)
    return written, seen.get["figure"]


def _settle(hit: DataFrame, powers: Powers) -> DataFrame:
    """Ranks whose value is known."""
    low = (F.col("_lo") < F.col("_hi")) & (F.col("_rank") == 0)  # of two values the larger is above
    found = F.struct(
        F.when(F.col("_rank") == 0, F.col("_lo")).otherwise(F.col("_hi")).alias("v"),
        F.when(F.col("_lo") == F.col("_hi"), F.col("_n")).otherwise(F.lit(1)).alias("ties"),
        (F.col("_over_n") + low.cast("long")).alias("above"),
        *[(F.col(f"_over_p_{n}") + F.when(low, f(F.col("_hi"))).otherwise(F.lit(0.0))).alias(f"above_{n}") for n, f in powers.items()],
    )
    inner = ("_lo", "_hi", "_n", "_rank", "_over", "_p_", "_c", "_value")  # group columns begin with _k
    own = [c for c in hit.columns if not c.startswith(inner)]
    return hit.where(~_open()).select(*own, "_name", found.alias("_found"))


def _placed(cells: DataFrame, family: list[str], step: str, added: list[str]) -> DataFrame:
    """Cells with the rows before them, and the rows and sums over them."""
    below = Window.partitionBy(*family).orderBy(step).rowsBetween(Window.unboundedPreceding, -1)
    over = Window.partitionBy(*family).orderBy(F.desc(step)).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("_n").over(below), F.lit(0))
    after = F.sum("_n").over(Window.partitionBy(*family)) - before - F.col("_n")  # counts need no second order
    return cells.select(
        "*",
        before.alias("_before"),
        *[(after if c == "_n" else F.coalesce(F.sum(c).over(over), F.lit(0))).alias(f"_over{c}") for c in added],
    )


def _descend(cells: DataFrame, still: DataFrame, group: list[str], path: list[str], step: str, added: list[str]) -> DataFrame:
    """The part of its cell that holds each rank, with what lies above it."""
    counts = ["_n", *added]
    parts = _placed(cells, [*group, *path], step, counts)
    carried = [F.col(f"_over{c}").alias(f"_far{c}") for c in counts]
    asked = still.select(
        *[c for c in still.columns if c not in ("_n", "_lo", "_hi", *added) and not c.startswith("_over")], *carried
    )
    joined = parts.join(asked, [*group, *path])
    joined = joined.where((F.col("_rank") >= F.col("_before")) & (F.col("_rank") < F.col("_before") + F.col("_n")))
    sums = {f"_over{c}": F.col(f"_over{c}") + F.col(f"_far{c}") for c in counts}
    joined = joined.withColumns({"_rank": F.col("_rank") - F.col("_before"), **sums})
    return joined.drop("_before", *[f"_far{c}" for c in counts])


def position_ranks(probs: Mapping[str, float]) -> dict[str, Callable[[Column], Column]]:
    """The two ranks that linear interpolation needs, per probability."""
    ranks: dict[str, Callable[[Column], Column]] = {}
    for name, p in probs.items():
        ranks[f"{name}__lo"] = lambda n, p=p: F.floor(F.lit(float(p)) * (n - 1))
        ranks[f"{name}__hi"] = lambda n, p=p: F.ceil(F.lit(float(p)) * (n - 1))
    return ranks


def percentile_column(name: str, p: float) -> Column:
    """Linear interpolation between the order statistics of `position_ranks`."""
    low, high = F.col(f"{name}__lo.v"), F.col(f"{name}__hi.v")
    position = F.lit(float(p)) * (F.col("n") - 1)
    return low + (high - low) * (position - F.floor(position))


def tail_mean_column(name: str, p: float, power: str = "s") -> Column:
    """Mean of the values at or above the percentile, from the same order statistics."""
    at = F.when(percentile_column(name, p) <= F.col(f"{name}__lo.v"), F.col(f"{name}__lo")).otherwise(F.col(f"{name}__hi"))
    return (at[f"above_{power}"] + at["ties"] * at["v"]) / (at["above"] + at["ties"])


def top_share_rank(fraction: float) -> Callable[[Column], Column]:
    """Rank of the smallest of the largest ``max(ceil(n * f), 1)`` values."""
    return lambda n: n - F.greatest(F.ceil(n * F.lit(float(fraction))), F.lit(1))


def top_share_column(name: str, fraction: float, power: str, of: Callable[[Column], Column]) -> Column:
    """Share of the total of a power that the largest ``max(ceil(n * f), 1)`` values carry."""
    count = F.greatest(F.ceil(F.col("n") * F.lit(float(fraction))), F.lit(1))
    part = F.col(f"{name}.above_{power}") + (count - F.col(f"{name}.above")) * of(F.col(f"{name}.v"))
    total = F.col(f"total_{power}")
    return F.when(total > 0, part / total).otherwise(F.lit(0.0))


def exact_percentiles(df: DataFrame, keys: Sequence[str], value: Column, probs: Mapping[str, float]) -> DataFrame:
    """Linear-interpolated percentiles per group, one column per entry of ``probs``."""
    found = order_statistics(df, keys, value, position_ranks(probs), powers={})
    return found.select(*keys, *[percentile_column(n, p).alias(n) for n, p in probs.items()])


def tail_means(df: DataFrame, keys: Sequence[str], value: Column, tails: Mapping[str, tuple[str, float]]) -> DataFrame:
    """Percentile and the mean of the values at or above it: ``{cvar_name: (pct_name, p)}``."""
    found = order_statistics(df, keys, value, position_ranks(dict(tails.values())))
    return found.select(
        *keys,
        *[percentile_column(n, p).alias(n) for n, p in tails.values()],
        *[tail_mean_column(n, p).alias(name) for name, (n, p) in tails.items()],
    )


def top_share(df: DataFrame, keys: Sequence[str], value: Column, fractions: Mapping[str, float]) -> DataFrame:
    """Share of the total carried by the largest ``max(ceil(n * f), 1)`` values of each group."""
    found = order_statistics(df, keys, value, {n: top_share_rank(f) for n, f in fractions.items()})
    shares = [top_share_column(n, f, "s", lambda v: v).alias(f"_{n}") for n, f in fractions.items()]
    return found.select(*keys, *shares).withColumnsRenamed({f"_{n}": n for n in fractions})


def running_totals(
    df: DataFrame,
    keys: Sequence[str],
    slice_col: str,
    order: Sequence[str],
    *,
    sums: Mapping[str, Column] | None = None,
    maxima: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Inclusive running sums and maxima per key, computed slice by slice.

    ``slice_col`` must be non-decreasing along ``order``.  Every (key, slice) is scanned on its
    own; a small table of slice totals supplies what earlier slices carry in, so one hot key is
    spread over as many tasks as it has slices.
    """
    sums, maxima = dict(sums or {}), dict(maxima or {})
    base = df
    for name, expression in {**sums, **maxima}.items():
        base = base.withColumn(f"_in_{name}", expression)
    local = Window.partitionBy(slice_col, *keys).orderBy(*order)
    local = local.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = (
        Window.partitionBy(*keys).orderBy(slice_col).rowsBetween(Window.unboundedPreceding, -1)
    )
    carried = base.groupBy(slice_col, *keys).agg(
        *[F.sum(f"_in_{n}").alias(f"_slice_{n}") for n in sums],
        *[F.max(f"_in_{n}").alias(f"_slice_{n}") for n in maxima],
    )
    carried = carried.select(
        slice_col,
        *keys,
        *[F.coalesce(F.sum(f"_slice_{n}").over(earlier), F.lit(0)).alias(f"_c_{n}") for n in sums],
        *[F.max(f"_slice_{n}").over(earlier).alias(f"_c_{n}") for n in maxima],
    )
    for name in sums:
        base = base.withColumn(f"_w_{name}", F.coalesce(F.sum(f"_in_{name}").over(local), F.lit(0)))
    for name in maxima:
        base = base.withColumn(f"_w_{name}", F.max(f"_in_{name}").over(local))
    joined = base.join(carried, [slice_col, *keys])
    return joined.select(
        *[joined[c] for c in df.columns],
        *[(F.col(f"_w_{n}") + F.col(f"_c_{n}")).alias(n) for n in sums],
        *[F.greatest(f"_w_{n}", f"_c_{n}").alias(n) for n in maxima],
    )


def average_ranks(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """Ranks with ties averaged, from value counts; hot groups are split by value bucket."""
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("_ties"))
    counts = counts.withColumn("_bucket", order_bucket(F.col(value)))
    ranked = running_totals(
        counts, keys, "_bucket", [value], sums={"_upto": F.col("_ties")}
    ).select(*keys, value, (F.col("_upto") - (F.col("_ties") - 1) / 2).alias(name))
    return df.join(ranked, [*keys, value])


def spearman(df: DataFrame, keys: Sequence[str], left: str, right: str, name: str) -> DataFrame:
    """Rank correlation: identical constants give 1, anything undefined gives 0."""
    rows = df.select(*keys, F.col(left).alias("_l"), F.col(right).alias("_r"))
    ranked = average_ranks(rows, keys, "_l", "_rank_l")
    ranked = average_ranks(ranked, keys, "_r", "_rank_r")
    constant = (
        (F.min("_l") == F.max("_l")) & (F.min("_r") == F.max("_r")) & (F.min("_l") == F.min("_r"))
    )
    spread = F.stddev_pop("_rank_l") * F.stddev_pop("_rank_r")
    coefficient = F.covar_pop("_rank_l", "_rank_r") / spread
    return ranked.groupBy(*keys).agg(
        F.when(constant, F.lit(1.0)).when(spread > 0, coefficient).otherwise(F.lit(0.0)).alias(name)
    )
