"""Ranked lexical search by pipelined term partitioning.

The terms of all items are divided among a few owners, rarest terms first, with about as many postings each.  Items
travel as bundles through the owners' stages: a bundle carries an item's terms and, sparsely, the documents met so far
with their integer scores; a stage cogroups the bundles with its owner's postings and adds their contributions.  After
the last stage every bundle selects its best documents, and those of all bundles of an item are ranked.

* Documents are dealt to shards by row, so a stage's group is the postings of some thousand documents, however frequent a
  term is, and up to `BLOCK_ITEMS` items.  A bundle is an item in a shard.  No task sees all documents of an item.
* A term's largest contribution bounds what later stages can add.  Once `k` documents of a bundle are ahead by more than
  that, documents that cannot reach them are left out, and no new ones are taken up.  This never changes a result:
  what is left out is strictly behind `k` others of the same shard.
* Which terms any item has reaches the document pass as a bitmap of fixed size; what passes it by chance is removed by an
  exact join later.  So the pass ships postings of the items' terms only, and more items only fill the bitmap.

Counts of terms are kernels of Arrow over whole texts.  Null texts have no term.  Every row of either table counts for
itself, repeated rows and null ids too: equal scores are ranked by ascending document id (nulls last).  Items without
terms or hits give no row; empty tables give an empty result.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bandwise.llm.common import non_empty
from bandwise.llm.text import coded_words
from bandwise.session import write_through

#: Documents of an item, stages, bits of the bitmap, postings of a shard and items of a block.
K, OWNERS, BITS, SHARD_POSTINGS, BLOCK_ITEMS = 10, 3, 1 << 18, 400_000, 256
# fixed values of the score: saturation and length share, in hundredths and thousandths of the usual parameters
LENGTH_SHARE, SCALE = 90, 1_000_000_000


def _terms(bits: np.ndarray | None) -> Callable[[Iterator], Iterator]:
    """Rows (row, id, text) to (row, id, n, terms, tfs): all terms counted, those that the bitmap knows are listed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in non_empty(batches):
            owner, index, names = coded_words(batch.column(2))
            n = np.bincount(owner, minlength=batch.num_rows).astype(np.int64)
            if bits is not None:
                known = np.fromiter((bits[crc32(w.encode()) % len(bits)] for w in names), bool, len(names))
                owner, index = owner[known[index]], index[known[index]]
            pairs, tf = np.unique(owner * max(1, len(names)) + index, return_counts=True)
            borders = np.searchsorted(pairs, np.arange(batch.num_rows + 1) * max(1, len(names)))
            dictionary = pa.array(names, pa.string())
            terms = dictionary.take(pa.array(pairs % max(1, len(names))))
            lists = [pa.ListArray.from_arrays(pa.array(borders, pa.int32()), x) for x in (terms, pa.array(tf.astype(np.int64)))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n), *lists], names=["row", "id", "n", "terms", "tfs"]
            )

    return run


def counted(table: DataFrame, id_column: str, text_column: str, bits: np.ndarray | None = None) -> DataFrame:
    """One row per row of the table: row, id, n terms with repeats, and its distinct terms with their counts."""
    rows = table.select(F.monotonically_increasing_id().alias("row"), F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(_terms(bits), f"row long, id {kind}, n long, terms array<string>, tfs array<long>")


BUNDLE = "shard long, block long, item long, owners array<long>, terms array<long>, tops array<long>, rows array<long>, ids array<long>, scores array<long>, floor long"


def _lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    borders = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(borders), pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64), kind))


def _stage(owner: int, last: bool, k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Bundles and postings of one shard and block: the owner's contributions are added."""

    def values(column: pa.ChunkedArray) -> np.ndarray:
        return column.combine_chunks().to_numpy(zero_copy_only=False)

    def run(bundles: pa.Table, postings: pa.Table) -> pa.Table:
        term = values(postings["term_id"])
        by_term = np.argsort(term, kind="stable")
        term, contribution = term[by_term], values(postings["added"])[by_term]
        carried = bundles["rows"].combine_chunks()
        # documents of the group, numbered by id and row: of equal scores the smaller number is first
        rows = np.concatenate((values(postings["row"]), carried.values.to_numpy(zero_copy_only=False)))
        ids = np.concatenate((values(postings["id"]), bundles["ids"].combine_chunks().values.to_numpy(zero_copy_only=False)))
        distinct, first, number = np.unique(rows, return_index=True, return_inverse=True)
        order = np.lexsort((distinct, ids[first]))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        number = rank[number]
        rows, ids = distinct[order], ids[first][order]
        posted, held = number[: len(term)][by_term], number[len(term) :]
        held_scores = bundles["scores"].combine_chunks().values.to_numpy(zero_copy_only=False)
        border = carried.offsets.to_numpy() - carried.offsets[0].as_py()
        lists = {name: bundles[name].combine_chunks() for name in ("owners", "terms", "tops")}
        at = lists["terms"].offsets.to_numpy() - lists["terms"].offsets[0].as_py()
        flat = {name: x.flatten().to_numpy(zero_copy_only=False) for name, x in lists.items()}
        floors = values(bundles["floor"]).copy()
        kept, scores = [], []
        for i in range(bundles.num_rows):
            mine = slice(at[i], at[i + 1])
            here, later = flat["owners"][mine] == owner, flat["owners"][mine] > owner
            to_come = int(flat["tops"][mine][later].sum())
            before = held[border[i] : border[i + 1]]
            total = np.zeros(len(rows), np.int64)
            total[before] = held_scores[border[i] : border[i + 1]]
            wanted = flat["terms"][mine][here]
            for low, high in zip(np.searchsorted(term, wanted), np.searchsorted(term, wanted, "right")):
                total[posted[low:high]] += contribution[low:high]  # a document has one posting of a term
            if floors[i] > to_come + int(flat["tops"][mine][here].sum()):
                found = before  # what was not met so far cannot reach the floor any more
            else:
                found = np.flatnonzero(total)
            reached = total[found]
            if len(found) >= k:
                floors[i] = max(floors[i], int(np.partition(reached, len(found) - k)[len(found) - k]))
                found = found[reached + to_come >= floors[i]]
            if last:
                found = np.sort(found)
                found = found[np.argsort(-total[found], kind="stable")[:k]]
            kept.append(found)
            scores.append(total[found])
        long = pa.int64()
        new = {
            "rows": _lists([rows[f] for f in kept], long),
            "ids": _lists([ids[f] for f in kept], long),
            "scores": _lists(scores, long),
            "floor": pa.array(floors, long),
        }
        same = {name: bundles[name] for name in bundles.column_names if name not in new}
        return pa.table({name: new[name] if name in new else same[name] for name in bundles.column_names})

    return run


#: Stands for a null document id, behind all others.
_NO_ID = (1 << 63) - 1


def search(
    docs: DataFrame, items: DataFrame, *, id_column: str = "doc_id", item_column: str = "item_id", text_column: str = "text",
    k: int = K, owners: int = OWNERS, shard_postings: int = SHARD_POSTINGS, block_items: int = BLOCK_ITEMS,
) -> DataFrame:
    """The k best documents of each item: its id, rank (from 1), the document's id (as long) and score above 0."""
    spark = docs.sparkSession
    asked = write_through(counted(items, item_column, text_column).select("row", "id", "terms"), "lexical-items")
    item_kind = asked.schema["id"].dataType.simpleString()
    empty = spark.createDataFrame([], f"{item_column} {item_kind}, rank int, {id_column} long, score long")
    wanted = asked.select(F.col("row").alias("item"), F.explode("terms").alias("term"))
    bits = np.zeros(BITS, bool)
    bits[[r[0] for r in wanted.select((F.crc32("term") % BITS).alias("bit")).distinct().collect()]] = True  # BITS rows at most
    own_id = F.coalesce(F.col(id_column).cast("long"), F.lit(_NO_ID))
    index = write_through(counted(docs.withColumn(id_column, own_id), id_column, text_column, bits).where("n > 0"), "lexical-index")
    n_docs, n_terms = index.agg(F.count("*"), F.sum("n")).first()
    if not n_docs:
        return empty
    postings = index.select("row", "id", "n", F.explode(F.arrays_zip("terms", "tfs")).alias("p")).select(
        "row", "id", "n", F.col("p.terms").alias("term"), F.col("p.tfs").alias("tf")
    )
    weight = F.floor(1000 * F.log(F.lit(2.0 * n_docs + 2) / (2 * F.col("df") + 1))).cast("long")
    terms = postings.groupBy("term").agg(F.count("*").alias("df")).join(wanted.select("term").distinct(), "term")
    terms = write_through(terms.select("term", "df", weight.alias("w"), F.monotonically_increasing_id().alias("term_id")).where("w > 0"), "lexical-terms")
    shares = ", ".join(str(1 - i / owners) for i in range(1, owners))
    cuts, volume = terms.agg(F.expr(f"percentile(w, array({shares or '0.0'}), df)"), F.sum("df")).first()
    if not volume:
        return empty
    owner = sum(((F.col("w") < cut).cast("long") for cut in (cuts if owners > 1 else [])), F.lit(0).cast("long"))
    shards = -(-volume // shard_postings)
    n_blocks = max(1, -(-asked.count() // block_items))
    block = F.pmod(F.xxhash64("item"), F.lit(n_blocks)).alias("block")
    blocks = wanted.select("term", block).distinct()
    length = f"({100 - LENGTH_SHARE} + ({LENGTH_SHARE} * n * {n_docs}) div {n_terms})"
    added = postings.join(terms.select("term", "term_id", "w", owner.alias("owner")).join(blocks, "term"), "term").select(
        F.pmod(F.xxhash64("row"), F.lit(shards)).alias("shard"), "block", "owner", "term_id", "row", "id",
        F.expr(f"w * (({SCALE} * tf) div (1000 * tf + 8 * {length}))").alias("added"),
    )
    added = write_through(added.where("added > 0"), "lexical-postings", partition_by="owner")
    tops = added.groupBy("term_id", F.col("owner").cast("long").alias("owner")).agg(F.max("added").alias("top"))
    held = wanted.join(terms.select("term", "term_id"), "term").join(tops, "term_id")
    held = held.groupBy("item").agg(F.sort_array(F.collect_list(F.struct("owner", "term_id", "top"))).alias("t"))
    nothing = F.array().cast("array<long>")
    bundles = held.select(
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"), block, "item",
        F.col("t.owner").alias("owners"), F.col("t.term_id").alias("terms"), F.col("t.top").alias("tops"),
        nothing.alias("rows"), nothing.alias("ids"), nothing.alias("scores"), F.lit(0).cast("long").alias("floor"),
    )
    for i in range(owners):
        owned = added.where(F.col("owner") == i).select("shard", "block", "term_id", "row", "id", "added")
        bundles = bundles.groupBy("shard", "block").cogroup(owned.groupBy("shard", "block")).applyInArrow(
            _stage(i, i == owners - 1, k), BUNDLE
        )
    best = bundles.select("item", F.explode(F.arrays_zip("rows", "ids", "scores")).alias("b")).select("item", "b.*")
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("scores"), "ids", "rows"))
    best = best.withColumn("rank", place).where(F.col("rank") <= k)
    return best.join(asked.select(F.col("row").alias("item"), F.col("id").alias("item_id")), "item").select(
        F.col("item_id").alias(item_column), F.col("rank").cast("int").alias("rank"),
        F.when(F.col("ids") != _NO_ID, F.col("ids")).alias(id_column), F.col("scores").alias("score"),
    )
