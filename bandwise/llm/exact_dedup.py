"""Exact deduplication by a Grace hash: bucket the records until each bucket fits a table in memory.

1.  Every task first folds the copies it sees itself into one record per text (an open-addressing table of
    bounded size, flushed when full).  So a text that makes up a third of the input leaves a task at most once
    per flush, not once per row.  The records are written to the shared folder as the first spill table.
2.  The records are dealt to buckets by the leading bits of a 64-bit hash of the content.  Buckets whose distinct
    content is larger than `bucket_bytes` are dealt again, by the next bits, into the next spill table; this is
    repeated until all fit.  Only a few figures reach the driver (is any bucket too large?).
3.  One task streams a bucket through an open-addressing table that holds each distinct text once and compares
    complete contents; the hash only selects the slot.

Null texts count as empty.  Of equal texts the row with the largest id stays; among rows with the same id and text
exactly one stays (any of them), and a null id only stays if the whole group has none.  Rows are never lost:
an empty table gives an empty result, and extra columns are passed on or ignored as documented below.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bandwise.llm.common import keep_rows, non_empty, partitions
from bandwise.session import write_through

#: Buckets of the first level, and parts of a bucket that is dealt again.
FANOUT = 1024
#: Distinct content of one bucket.
BUCKET_BYTES = 64_000_000
#: Distinct content of a task's table before it is flushed.
FOLD_BYTES = 20_000_000


class Table:
    """Open addressing with linear probing; an entry is found only if its complete content is equal."""

    def __init__(self, slots: int = 1 << 10):
        self.slots = np.full(slots, -1, np.int64)
        self.hashes: list[int] = []
        self.contents: list[bytes] = []
        self.bytes = 0

    def place(self, h: int, content: bytes) -> int:
        """Number of the entry with this content, which is added if it is new."""
        mask = len(self.slots) - 1
        at = h & mask
        while (entry := int(self.slots[at])) >= 0:
            if self.hashes[entry] == h and self.contents[entry] == content:
                return entry
            at = (at + 1) & mask
        self.slots[at] = entry = len(self.contents)
        self.hashes.append(h)
        self.contents.append(content)
        self.bytes += len(content) + 100
        if 2 * len(self.contents) > len(self.slots):
            self._grow()
        return entry

    def _grow(self) -> None:
        self.slots = np.full(2 * len(self.slots), -1, np.int64)
        mask = len(self.slots) - 1
        for entry, h in enumerate(self.hashes):
            at = h & mask
            while self.slots[at] >= 0:
                at = (at + 1) & mask
            self.slots[at] = entry


RECORDS = "id long, copy long, stays boolean, sha256 string, hash long, size long, copies long, text string"


def _fold(normalise: Callable[[str], str] | None, limit: int) -> Callable[[Iterator], Iterator]:
    """Rows (id, text) to records: one per row, of which one per text and flush carries text and counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serial = TaskContext.get().partitionId() << 36
        held = Table()
        rows: list[tuple] = []

        def flush() -> pa.RecordBatch:
            best = [-1] * len(held.contents)
            copies = [0] * len(held.contents)
            for i, (key, entry, _) in enumerate(rows):
                copies[entry] += 1
                if best[entry] < 0 or (key is not None and (rows[best[entry]][0] is None or key > rows[best[entry]][0])):
                    best[entry] = i
            chief = set(best)
            signed = [h - (1 << 64) if h >> 63 else h for h in held.hashes]
            entries = [e for _, e, _ in rows]
            stays = [i in chief for i in range(len(rows))]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([r[0] for r in rows], pa.int64()),
                    pa.array([serial + e for e in entries], pa.int64()),
                    pa.array(stays, pa.bool_()),
                    pa.array([r[2] for r in rows], pa.string()),
                    pa.array([signed[e] for e in entries], pa.int64()),
                    pa.array([len(held.contents[e]) for e in entries], pa.int64()),
                    pa.array([copies[e] for e in entries], pa.int64()),
                    pa.array([held.contents[e].decode() if s else None for e, s in zip(entries, stays, strict=True)], pa.string()),
                ],
                names=[c.split()[0] for c in RECORDS.split(", ")],
            )

        digests: list[str] = []
        for batch in non_empty(batches):
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                content = ((normalise(text or "") if normalise else text) or "").encode()
                entry = held.place(xxhash.xxh3_64_intdigest(content), content)
                if entry == len(digests):
                    digests.append(hashlib.sha256(content).hexdigest())
                rows.append((key, entry, digests[entry]))
                if held.bytes > limit or len(rows) >= 200_000:
                    yield flush()
                    serial += len(held.contents)
                    held, rows, digests = Table(), [], []
        if rows:
            yield flush()

    return run


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records sorted by bucket to (copy, keep_copy, keep_id, group_size), one per record."""
    held, bucket, seen = Table(), None, []

    def results() -> pa.RecordBatch:
        best: list[tuple | None] = [None] * len(held.contents)
        total = [0] * len(held.contents)
        for entry, copy, key, copies in seen:
            total[entry] += copies
            rank = (key is not None, key or 0, copy)
            if best[entry] is None or rank > best[entry]:
                best[entry] = rank
        return pa.RecordBatch.from_arrays(
            [
                pa.array([s[1] for s in seen], pa.int64()),
                pa.array([best[s[0]][2] for s in seen], pa.int64()),
                pa.array([best[s[0]][1] if best[s[0]][0] else None for s in seen], pa.int64()),
                pa.array([total[s[0]] for s in seen], pa.int64()),
            ],
            names=["copy", "keep_copy", "keep_id", "group_size"],
        )

    for batch in non_empty(batches):
        columns = [batch.column(n).to_pylist() for n in ("bucket", "hash", "text", "copy", "id", "copies")]
        for b, h, text, copy, key, copies in zip(*columns, strict=True):
            if b != bucket:
                if seen:
                    yield results()
                held, bucket, seen = Table(), b, []
            seen.append((held.place(h & (1 << 64) - 1, text.encode()), copy, key, copies))
    if seen:
        yield results()


def exact_groups(
    docs: DataFrame,
    *,
    id_column: str = "doc_id",
    text_column: str = "text",
    normalise: Callable[[str], str] | None = None,
    fanout: int = FANOUT,
    bucket_bytes: int = BUCKET_BYTES,
) -> DataFrame:
    """One row per row of docs: id, keep_id, group_size, kept, text_sha256 (of the normalised text).

    Other columns of docs are not read.  `fanout` is rounded up to a power of two.
    """
    spark = docs.sparkSession
    bits = max(1, (fanout - 1).bit_length())
    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text"))
    records = write_through(rows.mapInArrow(_fold(normalise, min(bucket_bytes, FOLD_BYTES)), RECORDS), "grace")
    level = records.where("text is not null").select("id", "copy", "hash", "size", "copies", "text")
    level, depth, settled = level.withColumn("bucket", F.shiftrightunsigned("hash", 64 - bits)), 1, []
    while True:
        contents = level.groupBy("bucket", "hash").agg(F.max("size").alias("size"))
        sizes = contents.groupBy("bucket").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
        large = sizes.where((F.col("bytes") > bucket_bytes) & (F.col("n") > 1)).select("bucket")
        if bits * (depth + 1) > 63 or large.isEmpty():
            settled.append(level)
            break
        large = write_through(large, "grace-large")
        settled.append(level.join(large, "bucket", "left_anti"))
        depth += 1
        deeper = level.join(large, "bucket", "left_semi")
        level = write_through(deeper.withColumn("bucket", F.shiftrightunsigned("hash", 64 - bits * depth)), f"grace-{depth}")
    groups = []
    for part in settled:
        dealt = part.repartition(partitions(spark), "bucket").sortWithinPartitions("bucket")
        groups.append(dealt.mapInArrow(_settle, "copy long, keep_copy long, keep_id long, group_size long"))
    found = groups[0]
    for other in groups[1:]:
        found = found.unionByName(other)
    return (
        records.select("id", "copy", "stays", "sha256")
        .join(found, "copy")
        .select(
            F.col("id").alias(id_column),
            "keep_id",
            "group_size",
            (F.col("stays") & (F.col("copy") == F.col("keep_copy"))).alias("kept"),
            F.col("sha256").alias("text_sha256"),
        )
    )


def drop_copies(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", **options) -> DataFrame:
    """The rows of docs that stay, with all their columns.

    Rows that agree in id and text count as one row: one of them stays.
    """
    if options.get("normalise"):
        raise ValueError("drop_copies compares texts as they are")
    return keep_rows(docs, exact_groups(docs, id_column=id_column, text_column=text_column, **options), id_column, text_column)
