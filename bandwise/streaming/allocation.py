"""Allocation on a stream: closed periods become thresholds, and events meet them in a second query.

The first query gathers each plug's events of a period under the watermark.  When it has passed the period, all plugs'
gatherings come out together; the batch operators then divide the budgets at the ticks of the closed periods, starting
from the state that the periods before have left (last squares and last-seen time of a plug, newest allocation of a
house), which is a table per micro-batch in the shared folder.  A repeated micro-batch starts from the same state and
writes the same tables.

The second query joins the event stream with the stream of those tables on plug and period, both under a watermark, so
that its state is bounded by the periods that are still open, decides, and sums up every timestamp of a house.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from bandwise.operators import allocate as alloc
from bandwise.operators import cycles, decide, score
from bandwise.params import AllocationConfig, Params
from bandwise.plans.frozen import Study
from bandwise.session import write_through
from bandwise.sources.events import PLUG
from bandwise.streaming.batches import END, end_marks, watermarked

#: What the second query reads for each plug with events in a period: its allocations in grid order.
THRESHOLDS = """house_id long, household_id long, plug_id long, cell long, period_start timestamp, tick_us long,
    mean_load double, returned array<long>, allocations array<struct<config_pos: int, threshold: double, previous: double,
    used: double, previous_used: double>>"""


def gather_periods(events: DataFrame, params: Params, delay: str) -> DataFrame:
    """Every plug's events of a period as one row, once the watermark has passed its end.

    ``events`` are predicted.  The row holds as many entries as the plug has events in the period.
    """
    length = f"{params.period_seconds} seconds"
    offset_us = params.start_us % params.period_us
    entry = F.struct(F.unix_micros("timestamp").alias("ts_us"), "row_id", (F.col("residual") * F.col("residual")).alias("sq"))
    gathered = (
        watermarked(events, delay)
        .groupBy(*PLUG, F.window("timestamp", length, length, f"{offset_us} microseconds").alias("period"))
        .agg(F.collect_list(entry).alias("entries"))
    )
    start = F.unix_micros("period.start")
    cell = F.floor((start - F.lit(params.start_us)) / F.lit(params.period_us)).cast("long")
    return gathered.select(*PLUG, cell.alias("cell"), "entries")


class StreamAllocation:
    """Thresholds of closed periods for a grid of configurations; ``refresh`` is called by a stream's sink.

    ``study`` is the fitted warm-up: medians, loads, floors, quantiles and the state at the start.  Results are the
    tables ``trace`` (as of the batch allocation) and ``thresholds`` (for the second query).
    """

    def __init__(self, study: Study, configs: Sequence[AllocationConfig], path: str):
        self.study, self.configs, self.path, self.params = study, list(configs), path, study.params
        self.spark: SparkSession = study.events.sparkSession
        capped = any(c.mode == "true_hierarchical_cap" for c in configs)
        self.quantiles = study.quantiles(self.configs) if capped else None

    def _table(self, name: str, epoch: int) -> str:
        return f"{self.path}/{name}/epoch={epoch}"

    def _write(self, table: DataFrame, name: str, epoch: int) -> DataFrame:
        table.write.mode("overwrite").parquet(self._table(name, epoch))
        return self.spark.read.schema(table.schema).parquet(self._table(name, epoch))

    def _read(self, name: str, epoch: int) -> DataFrame:
        return self.spark.read.parquet(self._table(name, epoch))

    def _commit(self, epoch: int, state: int) -> None:
        """Which tables hold the state after a micro-batch: those of the newest one that closed a period."""
        self._write(self.spark.createDataFrame([(state,)], "state long"), "at", epoch)

    def start(self) -> None:
        """Allocation before the first event, and the state that the warm-up leaves.  Micro-batches count from 0."""
        houses = self.study.houses
        tick = houses.select(
            "house_id", F.lit(0).cast("long").alias("cell"), F.lit(self.params.start_us - 1).alias("tick_us"),
            F.lit(0).cast("long").alias("cycle"),
        )
        self._write(houses.select("house_id", F.lit(-1).cast("long").alias("cycle")), "cycles", -2)
        self._write(self.study.warm_plugs.select(*PLUG, "last_us"), "plugs", -2)
        self._write(self.study.tail.select(*PLUG, "ts_us", "row_id", "sq"), "tail", -2)
        none = self.study.tail.limit(0).select(*PLUG, "ts_us", "row_id", "sq", F.lit(0).cast("long").alias("cycle"))
        self._allocate(none, tick, state=-2, epoch=-1)

    def refresh(self, closed: DataFrame, epoch: int) -> None:
        """Work on the periods that a micro-batch has closed."""
        before = self._read("at", epoch - 1).first().state
        closed = self._write(closed, "closed", epoch)
        if closed.isEmpty():
            self._commit(epoch, before)
            return
        events = closed.select(*PLUG, "cell", F.inline("entries")).withColumn("timestamp", F.timestamp_micros("ts_us"))
        carried = self._read("cycles", before)
        firsts = events.groupBy("house_id", "cell").agg(F.min("ts_us").alias("tick_us")).where(F.col("cell") >= 1)
        number = F.row_number().over(Window.partitionBy("house_id").orderBy("cell"))
        ticks = firsts.join(carried, "house_id").withColumn("cycle", F.col("cycle") + number)
        initial = carried.select(
            "house_id", F.lit(0).cast("long").alias("cell"), F.lit(self.params.start_us - 1).alias("tick_us"),
            F.lit(0).cast("long").alias("cycle"),
        )
        ticks = self._write(ticks.select("house_id", "cell", "tick_us", "cycle"), "ticks", epoch)
        cells = ticks.unionByName(initial)
        rows = write_through(cycles.assign_cycle(events.drop("cell"), cells, self.params), "stream-rows")
        trace = self._allocate(rows, ticks, state=before, epoch=epoch)
        self._thresholds(closed, cells, trace, before, epoch)

    def _allocate(self, events: DataFrame, ticks: DataFrame, *, state: int, epoch: int) -> DataFrame:
        """Divide the budgets at the ticks, from a state and the events since; write trace and new state."""
        # what was before is one more slice, older than all events: they are at or behind the newest tick
        before = self._read("cycles", state).select("house_id", (F.col("cycle") - 1).alias("cycle"))
        tail = self._read("tail", state).join(before, "house_id")
        totals = tail.groupBy(*PLUG).agg(F.count("*").alias("n"))
        plugs = self._read("plugs", state).join(totals, PLUG, "left").join(before, "house_id")
        states = write_through(cycles.slice_states(events, plugs).join(self.study.houses, "house_id"), "stream-states")
        residuals = events.select(*cycles.SLICE, "ts_us", "row_id", "sq").unionByName(
            tail.select(*cycles.SLICE, "ts_us", "row_id", "sq")
        )
        active = cycles.active_sets(states, ticks, self.params)
        # the allocation reads the scores several times
        snapshots = write_through(score.scores_at_ticks(active, states, residuals, self.params), "stream-snapshots")
        trace = alloc.allocate(snapshots, None, self.quantiles, self.configs, self.params)
        trace = self._write(trace, "trace", epoch)
        newest = ticks.groupBy("house_id").agg(F.max("cycle").alias("newest"))
        held = self._read("cycles", state).join(newest, "house_id", "left")
        held = held.select("house_id", F.coalesce("newest", "cycle").alias("cycle"))
        self._write(held, "cycles", epoch)
        last = self._read("plugs", state).unionByName(events.select(*PLUG, F.col("ts_us").alias("last_us")))
        self._write(last.groupBy(*PLUG).agg(F.max("last_us").alias("last_us")), "plugs", epoch)
        newest_first = Window.partitionBy(*PLUG).orderBy(F.desc("cycle"), F.desc("ts_us"), F.desc("row_id"))
        kept = residuals.where(F.col("sq").isNotNull()).withColumn("age", F.row_number().over(newest_first))
        kept = kept.where(F.col("age") <= self.params.window)
        self._write(kept.select(*PLUG, "ts_us", "row_id", "sq"), "tail", epoch)
        self._write(self._newest(trace, held, state, epoch), "allocated", epoch)
        self._commit(epoch, epoch)
        return trace

    def _newest(self, trace: DataFrame, held: DataFrame, state: int, epoch: int) -> DataFrame:
        """The newest allocation of every house."""
        rows = trace.select("config_pos", *cycles.SLICE, "threshold", "used_budget")
        if epoch >= 0:
            rows = rows.unionByName(self._read("allocated", state))
        return rows.join(held, ["house_id", "cycle"], "left_semi")

    def _thresholds(self, closed: DataFrame, cells: DataFrame, trace: DataFrame, before: int, epoch: int) -> None:
        """For each plug with events in a period: its allocations at the period's tick and before, and returns."""
        times = F.array_sort(F.array_distinct(F.transform("entries", lambda e: e["ts_us"])))
        met = closed.select(*PLUG, "cell", times.alias("times")).join(self._read("plugs", before), PLUG, "left")
        earlier = F.lag(F.element_at("times", -1)).over(Window.partitionBy(*PLUG).orderBy("cell"))
        met = met.withColumn("seen", F.coalesce(earlier, "last_us"))
        gaps = F.transform(
            "times",
            lambda t, i: F.when(t - F.when(i > 0, F.get("times", i - 1)).otherwise(F.col("seen")) <= self.params.active_us, F.lit(None))
            .otherwise(t),
        )
        met = met.withColumn("returned", F.filter(gaps, lambda t: t.isNotNull())).join(cells, ["house_id", "cell"])
        met = met.select(*PLUG, "cell", "tick_us", "cycle", "returned")
        every = trace.select("config_pos", *cycles.SLICE, "threshold", "used_budget").unionByName(self._read("allocated", before))
        # a plug and cycle, and a house and cycle, are one row for the whole grid
        tick = ["house_id", "cycle"]
        own = every.groupBy(*cycles.SLICE).agg(F.map_from_entries(F.collect_list(F.struct("config_pos", "threshold"))).alias("given"))
        used = every.groupBy("config_pos", *tick).agg(F.max("used_budget").alias("used"))
        used = used.groupBy(*tick).agg(F.map_from_entries(F.collect_list(F.struct("config_pos", "used"))).alias("spent"))

        def at(rows: DataFrame, back: int) -> DataFrame:
            cycle = (F.col("cycle") + back).alias("cycle")
            mine = own.select(*PLUG, cycle, F.col("given").alias(f"given_{back}"))
            whole = used.select("house_id", cycle, F.col("spent").alias(f"spent_{back}"))
            return rows.join(mine, cycles.SLICE, "left").join(whole, tick, "left")

        def figure(column: str, position: int) -> Column:
            return F.coalesce(F.try_element_at(F.col(column), F.lit(position)), F.lit(0.0))

        allocations = F.array(*[
            F.struct(
                F.lit(i).alias("config_pos"), figure("given_0", i).alias("threshold"), figure("given_1", i).alias("previous"),
                figure("spent_0", i).alias("used"), figure("spent_1", i).alias("previous_used"),
            )
            for i in range(len(self.configs))
        ])
        rows = at(at(met, 0), 1).withColumn("allocations", allocations)
        start = F.timestamp_micros(F.lit(self.params.start_us) + F.col("cell") * F.lit(self.params.period_us))
        rows = rows.join(self.study.houses.select("house_id", "mean_load"), "house_id").withColumn("period_start", start)
        wanted = T.StructType.fromDDL(THRESHOLDS)
        self._write(rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in wanted.fields]), "thresholds", epoch)


def threshold_stream(spark: SparkSession, path: str) -> DataFrame:
    """The thresholds that a `StreamAllocation` writes, as a stream; rows come in the order of their periods."""
    spark.createDataFrame([], THRESHOLDS).write.mode("append").parquet(f"{path}/thresholds")
    return spark.readStream.schema(THRESHOLDS).option("recursiveFileLookup", True).parquet(f"{path}/thresholds")


def end_of_periods(thresholds: DataFrame, marks: str) -> DataFrame:
    """Thresholds of a bounded stream and the end mark, which moves the watermark of the periods."""
    ends = end_marks(thresholds.sparkSession, marks).withColumnRenamed("timestamp", "period_start")
    return thresholds.unionByName(ends, allowMissingColumns=True)


def rolled_decisions(
    events: DataFrame, thresholds: DataFrame, configs: Sequence[AllocationConfig], params: Params, delay: str
) -> DataFrame:
    """Decide the events of closed periods and sum them up per configuration, house and timestamp.

    ``events``: predicted; ``thresholds``: from `threshold_stream`.  An event at the tick itself obeys the allocation
    before.  Both sides are held only as long as the watermark allows a partner.
    """
    # end marks carry keys, and lists are unfolded with outer: conditions that Spark derives from the join (keys are not
    # null, lists not empty) go below the watermark and would take the marks away before it sees them
    keys = list(PLUG)
    left = watermarked(events.fillna(-1, keys), delay).select(
        *PLUG, "timestamp", "value", "prediction", "residual", F.unix_micros("timestamp").alias("ts_us")
    )
    left = left.withColumn("cell", cycles.period_cell(params))
    right = thresholds.fillna(-1, [*keys, "cell"]).withWatermark("period_start", "0 seconds").where(F.col("period_start") < F.lit(END))
    right = right.select(*[F.col(c).alias(f"_{c}") for c in right.columns])
    same = [left[c] == right[f"_{c}"] for c in (*PLUG, "cell")]
    length = F.expr(f"interval {params.period_seconds} seconds")
    within = (left["timestamp"] >= right["_period_start"]) & (left["timestamp"] < right["_period_start"] + length)
    joined = left.join(right, [*same, within])
    after = F.col("ts_us") > F.col("_tick_us")

    def of_grid(field: str) -> Column:
        return F.get(F.array(*[F.lit(getattr(c, field)) for c in configs]), F.col("config_pos"))

    rows = joined.select("*", F.inline_outer("_allocations")).select(
        "house_id", "timestamp", "value", "prediction", "residual",
        of_grid("config_id").alias("config_id"), of_grid("mode").alias("mode"),
        (of_grid("epsilon") * F.col("_mean_load")).alias("house_budget"),
        F.when(after, F.col("threshold")).otherwise(F.col("previous")).alias("threshold_used"),
        F.when(after, F.col("used")).otherwise(F.col("previous_used")).alias("allocated_budget"),
        F.array_contains("_returned", F.col("ts_us")).alias("reactivated"),
    )
    decided = decide.decide(rows)
    summed = decided.groupBy("config_id", "mode", "house_id", "timestamp").agg(
        F.max("house_budget").alias("house_budget"), F.max("allocated_budget").alias("allocated_budget"), *decide.batch_sums()
    )
    return decide.with_batch_figures(summed, params)
