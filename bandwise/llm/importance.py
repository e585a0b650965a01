"""Importance resampling towards a target distribution, over hashed n-grams, with Arrow kernels.

1.  Words of a batch come from the kernels ascii_lower, split_pattern_regex and list_flatten; dictionary_encode turns them
    into indices of distinct words.  Runs of n words are pairs of the index of a run of n - 1 words and that of the
    next word, shifted by one; distinct pairs get new indices, so each distinct run is joined and hashed (CRC-32) once.
2.  Both tables are counted by bucket: every task adds up its own counts, then Spark adds those by bucket.  The sums
    are `buckets` rows at most, whatever the size of the tables; they give the gain of each bucket.
3.  A second pass takes the gain of every feature's bucket and adds them up per document (segment-reduce).
4.  A score is that weight plus Gumbel noise from a hash of the id, so the highest scores are a sample without
    replacement in proportion to exp(weight / 1000).  Rows are range-partitioned by score and sorted; a row's place is
    the number of rows in earlier partitions (one figure each) plus its place in its own, so no task holds all rows.

Null texts have no words, features or weight (0).  Every row gives one row.  Only rows with at least `least_words` words
are drawn; equal scores go to the smaller id, null ids (hashed as empty texts) last, and repeated rows are ranked one
after another.  Empty tables give empty results, and an empty target only smooths.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bandwise.llm.common import non_empty, partitions
from bandwise.llm.text import coded_words
from bandwise.session import write_through

# fixed values of the query: longest run of words, buckets, seed, least words of a drawn document, share drawn in per cent
MAX_N, BUCKETS, SEED, LEAST_WORDS, PERCENT = 1, 10_000, 2024, 20, 10


def bucketed(column: pa.Array, max_n: int, buckets: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Words per text, and for each n the buckets of all runs of n words with the borders between texts."""
    owner, single, words = coded_words(column)
    names = [w.encode() for w in words]
    n_words = np.bincount(owner, minlength=len(column)).astype(np.int64)
    found = []
    runs, spelled = single, names
    for n in range(1, max_n + 1):
        if n > 1:
            # a run goes on where its last word and the next one belong to the same text
            goes_on = owner[: len(owner) - n + 1] == owner[n - 1 :]
            pairs = runs[: len(goes_on)] * len(names) + single[n - 1 :]
            distinct, all_runs = np.unique(pairs, return_inverse=True)
            spelled = [spelled[p // len(names)] + b" " + names[p % len(names)] for p in distinct.tolist()]
            runs = all_runs
        else:
            goes_on = np.ones(len(single), bool)
        hashed = np.fromiter((crc32(s) % buckets for s in spelled), np.int64, len(spelled))
        counts = np.bincount(owner[: len(goes_on)][goes_on], minlength=len(column))
        found.append((hashed[runs[goes_on]], np.concatenate(([0], np.cumsum(counts)))))
    return n_words, found


def bucket_counts(texts: DataFrame, *, text_column: str = "text", max_n: int = MAX_N, buckets: int = BUCKETS) -> DataFrame:
    """One row per bucket that occurs: bucket, n (features of all texts in it)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(buckets, np.int64)
        for batch in non_empty(batches):
            for hashed, _ in bucketed(batch.column(0), max_n, buckets)[1]:
                sums += np.bincount(hashed, minlength=buckets)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[at])], names=["bucket", "n"])

    parts = texts.select(F.col(text_column).cast("string").alias("text")).mapInArrow(run, "bucket long, n long")
    return parts.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(raw: DataFrame, target: DataFrame, *, text_column: str = "text", max_n: int = MAX_N, buckets: int = BUCKETS) -> np.ndarray:
    """Gain of each bucket: 1000 times the logarithm of its smoothed share in the target over that in the raw texts."""
    counts = []
    for table in (raw, target):
        dense = np.zeros(buckets, np.int64)
        for r in bucket_counts(table, text_column=text_column, max_n=max_n, buckets=buckets).collect():  # `buckets` at most
            dense[r.bucket] = r.n
        counts.append(dense)
    s, t = counts
    above = (t + 1).astype(np.float64) * float(s.sum() + buckets)
    below = (s + 1).astype(np.float64) * float(t.sum() + buckets)
    return np.floor(1000 * np.log(above / below)).astype(np.int64)


def weights(
    docs: DataFrame, gain: np.ndarray, *, id_column: str = "doc_id", text_column: str = "text", max_n: int = MAX_N
) -> DataFrame:
    """One row per document: its id, n_words, n_features and weight, the sum of its features' gains."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in non_empty(batches):
            n_words, found = bucketed(batch.column(1), max_n, len(gain))
            n_features = np.zeros(batch.num_rows, np.int64)
            weight = np.zeros(batch.num_rows, np.int64)
            for hashed, border in found:
                taken = np.concatenate(([0], np.cumsum(gain[hashed])))
                weight += taken[border[1:]] - taken[border[:-1]]
                n_features += np.diff(border)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_words), pa.array(n_features), pa.array(weight)],
                names=["id", "n_words", "n_features", "weight"],
            )

    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    found = rows.mapInArrow(run, f"id {kind}, n_words long, n_features long, weight long")
    return found.select(F.col("id").alias(id_column), "n_words", "n_features", "weight")


def noise(seed: int, id_column: str) -> Column:
    """Gumbel noise times 1000, rounded down, from the first 8 hex digits of a hash of seed and id."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_column).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def draw(
    weighted: DataFrame, *, id_column: str = "doc_id", seed: int = SEED, least_words: int = LEAST_WORDS, percent: int = PERCENT
) -> DataFrame:
    """Rows of `weights` with score and rank: 1, 2, 3... for the highest `percent` of those long enough, else null."""
    spark = weighted.sparkSession
    scored = weighted.withColumn("score", F.col("weight") + noise(seed, id_column)).withColumn("fits", F.col("n_words") >= least_words)
    # the scores are written first, so that sampling the ranges does not read the texts again
    scored = write_through(scored.withColumn("row", F.monotonically_increasing_id()), "importance-scores")
    order = [F.desc("fits"), F.desc("score"), F.asc_nulls_last(id_column), F.asc("row")]
    sorted_rows = scored.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    # the number of the partition and, below it, the place in the partition
    placed = write_through(sorted_rows.withColumn("place", F.monotonically_increasing_id()), "importance-order")
    part, inside = F.shiftright("place", 33), F.col("place").bitwiseAND((1 << 33) - 1)
    sizes = placed.groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.count_if("fits").alias("fitting"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    sizes = sizes.select(
        "part",
        F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"),
        F.floor(F.sum("fitting").over(Window.partitionBy()) * percent / 100).alias("drawn"),
    )
    ranked = placed.withColumn("part", part).join(F.broadcast(sizes), "part").withColumn("rank", F.col("before") + inside + 1)
    return ranked.select(
        id_column, "n_words", "n_features", "weight", "score", F.when(F.col("rank") <= F.col("drawn"), F.col("rank")).alias("rank")
    )


def resample(docs: DataFrame, target: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", max_n: int = MAX_N, buckets: int = BUCKETS, **options) -> DataFrame:
    """Weights, scores and ranks of all documents, drawn towards the texts of `target`."""
    gain = gains(docs, target, text_column=text_column, max_n=max_n, buckets=buckets)
    weighted = weights(docs, gain, id_column=id_column, text_column=text_column, max_n=max_n)
    return draw(weighted, id_column=id_column, **options)
