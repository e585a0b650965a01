"""What the queries and operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bandwise.session import configure, write_through


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def remainder(doc_id: Column | str, divisor: int) -> Column:
    """crc32 of the id as text, modulo a divisor: the fold of a row.  A null id counts as an empty text."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(column.cast("string"), F.lit(""))) % divisor


def fresh(table: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that the table does not have, in any case of letters."""
    taken = {c.lower() for c in table.columns}
    found = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        found.append(name)
    return found


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def replaced(batch, **columns):
    """A record batch or table with some columns replaced or added."""
    import pyarrow as pa

    names = [*batch.schema.names]
    arrays = [batch.column(i) for i in range(len(names))]
    for name, values in columns.items():
        if name in names:
            arrays[names.index(name)] = values
        else:
            names.append(name)
            arrays.append(values)
    return pa.RecordBatch.from_arrays(arrays, names=names)


def non_empty(batches: Iterator) -> Iterator:
    return (b for b in batches if b.num_rows)


def keep_rows(docs: DataFrame, flags: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """The rows of docs that `flags` (id, text_sha256, kept; one row per row of docs) keeps, with all their columns.

    Rows are matched by id and text.  Where rows agree in both, one of them stays if any is kept.
    """
    key, sha, stays, rows = fresh(docs, "__id", "__sha", "__kept", "__rows")
    keys = flags.groupBy(F.col(id_column).alias(key), F.col("text_sha256").alias(sha)).agg(
        F.max("kept").alias(stays), F.count("*").alias(rows)
    )
    keys = write_through(keys.where(F.col(stays)), "kept")
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    same = F.col(id_column).cast("long").eqNullSafe(F.col(key)) & (F.sha2(text, 256) == F.col(sha))
    kept = docs.join(keys.where(F.col(rows) == 1), same, "left_semi")
    repeated = keys.where(F.col(rows) > 1)
    if not repeated.isEmpty():
        kept = kept.unionByName(docs.join(repeated, same, "left_semi").dropDuplicates([id_column, text_column]))
    return kept.select(*docs.columns)
