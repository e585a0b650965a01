"""Near-duplicate vectors by spherical-cap filters from a structured random product code.

1.  Vectors are cut into two blocks, after a seeded rotation.  Each block has a code of B random unit vectors; a filter is
    one code word from each, so 2 B code words stand for B * B directions.
2.  A vector is list-decoded to all filters whose direction it exceeds (inner product at least the threshold): code
    words of the first block in question, and for each the words of the second that make up the rest.  Threshold and B
    follow from the number of vectors, so that a filter holds `bucket` vectors and a vector exceeds `filters` filters on
    average: the inner product of a fixed vector with a random direction has a known distribution, whatever the data.
    A vector that exceeds too few takes a lower threshold of its own, which gives it its `enough` best filters.  That
    number grows with the logarithm of the table, as the share of filters that a pair has in common falls: pairs of
    cosine 0.9 meet with probability above 0.95 in tables of 1e4 to 1e9 vectors (tested).
3.  Vectors join on filters.  Filters with the same first word whose second words are of one of `groups` kinds are one
    cell, and a vector is sent once to each cell it has a filter in.  The number of kinds grows with the table, so that
    an average cell fits a block at any size.  Cells of more than `block` vectors, as made by many near copies, are dealt
    as pairs of blocks, so no task grows with a cell.
4.  Every pair in a cell is verified by its cosine in double precision, and counted only in the smallest cell that both
    share.  A task returns per vector its number of links and one link to the root of its local group, not the pairs.

Equal vectors are one class from the start, with a weight.  Vectors that are null, zero, or hold a null or non-finite
component link with nothing; so do rows with a null id, whose component is null.  Vectors of different lengths don't link.
Repeated rows count as vectors.  An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bandwise.llm.common import non_empty, partitions
from bandwise.llm.components import components, local_roots
from bandwise.session import write_through


def threshold(dims: int, share: float) -> float:
    """Inner product with a random direction that a share of directions exceeds."""
    t = np.linspace(-1, 1, 200_001)
    density = np.exp((dims - 3) / 2 * np.log1p(-np.minimum(t**2, 1 - 1e-12))) if dims > 2 else np.ones_like(t)
    tail = 1 - np.cumsum(density) / density.sum()
    return float(t[np.searchsorted(-tail, -share)])


@cache
def code(dims: int, size: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rotation, and the code words of both blocks (rows, of length 1)."""
    random = np.random.default_rng([seed, dims, size])
    rotation, _ = np.linalg.qr(random.normal(size=(dims, dims)))
    words = [random.normal(size=(size, max(n, 1))) for n in (dims - dims // 2, dims // 2)]
    return rotation, *(w / np.linalg.norm(w, axis=1, keepdims=True) for w in words)


class Shape(NamedTuple):
    """Words of a block, threshold, least number of filters of a vector, and kinds of second words."""

    size: int
    least: float
    enough: int
    groups: int


def shape(dims: int, n: int, filters: int, bucket: int, block: int) -> Shape:
    """What suits n vectors."""
    share = min(0.5, bucket / max(n, 1))
    size = math.ceil(math.sqrt(filters / share))
    enough = min(size, max(16, round(12 * math.log10(max(n, 1)) - 36)))
    # as if every filter were alone in its cell
    groups = math.ceil(n * max(filters, enough) / (size * 0.9 * block))
    return Shape(size, threshold(dims, share), enough, max(1, min(size, groups)))


def _best(scores: np.ndarray, k: int) -> np.ndarray:
    """The k highest of every row, in any order."""
    return np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k :]


def decode(vectors: np.ndarray, plan: Shape, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """List decoding of unit vectors: (vector, first word, second word) of all filters that they exceed, where the
    threshold of a vector is low enough for `enough` filters."""
    size, enough = plan.size, plan.enough
    rotation, first, second = code(vectors.shape[1], size, seed)
    turned, half = vectors @ rotation, vectors.shape[1] - vectors.shape[1] // 2
    a = turned[:, :half] @ first.T
    b = turned[:, half:] @ second.T if vectors.shape[1] > 1 else np.zeros((len(vectors), size))
    top = b.max(axis=1)
    # the best sums are sums of best terms
    sums = (_best(a, enough)[:, :, None] + _best(b, enough)[:, None, :]).reshape(len(a), -1)
    need = np.minimum(plan.least * math.sqrt(2), _best(sums, enough).min(axis=1) - 1e-12)
    row, i = np.nonzero(a >= (need - top)[:, None])
    found = []
    step = max(1, 8_000_000 // size)
    for at in range(0, len(row), step):
        r, w = row[at : at + step], i[at : at + step]
        k, j = np.nonzero(b[r] >= (need[r] - a[r, w])[:, None])
        found.append((r[k], w[k], j))
    if not found:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Unit vectors as rows, in double precision."""
    x = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims).astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def verify(group: pa.Table, least: float) -> pa.Table:
    """Links in one pair of blocks of a cell: id, links (weights of partners counted here), root."""
    dims = len(group.column("embedding")[0])
    group = group.combine_chunks()
    x = _matrix(group.column("embedding").chunk(0), dims)
    ids, weight, side = (group.column(c).to_numpy() for c in ("cid", "weight", "side"))
    cell = int(group.column("cell")[0].as_py())
    lists = group.column("cells").chunk(0)
    offsets, flat = lists.offsets.to_numpy(), lists.flatten().to_numpy()
    offsets = offsets - offsets[0]
    within = group.column("x")[0].as_py() == group.column("y")[0].as_py()
    left = np.arange(len(x)) if within else np.flatnonzero(side == 0)
    right = left if within else np.flatnonzero(side == 1)
    cosine = x[left] @ x[right].T
    p, q = np.nonzero(cosine >= least)
    p, q = left[p], right[q]
    p, q = p[p != q], q[p != q]
    if not within:
        p, q = np.concatenate([p, q]), np.concatenate([q, p])
        order = np.argsort(p, kind="stable")
        p, q = p[order], q[order]
    # one bit for each smaller cell that any vector here has; a pair with a common bit is counted elsewhere
    holder, smaller = np.repeat(np.arange(len(x)), np.diff(offsets)), flat[offsets[0] : offsets[-1]]
    holder, smaller = holder[smaller < cell], smaller[smaller < cell]
    names, bit, times = np.unique(smaller, return_inverse=True, return_counts=True)
    shared = times[bit] > 1
    holder, smaller = holder[shared], smaller[shared]
    names, bit = np.unique(smaller, return_inverse=True)
    bits = np.zeros((len(x), max(1, -(-len(names) // 64))), np.uint64)
    np.bitwise_or.at(bits, (holder, bit // 64), np.uint64(1) << (bit % 64).astype(np.uint64))
    counts = np.zeros(len(x))
    for at in range(0, len(p), 200_000):
        s, t = p[at : at + 200_000], q[at : at + 200_000]
        here = ~(bits[s] & bits[t]).any(axis=1)
        counts += np.bincount(s[here], weight[t[here]], len(x))
    counts = np.rint(counts).astype(np.int64)
    roots = local_roots(p, q, len(x))
    linked = np.unique(p)
    return pa.table({"cid": ids[linked], "links": counts[linked], "root": ids[roots[linked]]})


def near_vectors(
    vectors: DataFrame, *, id_column: str = "vec_id", vector_column: str = "embedding", least: float = 0.9, filters: int = 24,
    bucket: int = 64, block: int = 2048, seed: int = 11,
) -> DataFrame:
    """One row per row: id, n_links (other vectors linked), component_id (smallest id reachable), kept (id = component)."""
    spark = vectors.sparkSession
    # float components travel as such; cosines are taken in double precision
    kind = "array<float>" if dict(vectors.dtypes)[vector_column] == "array<float>" else "array<double>"
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast(kind).alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.coalesce(F.col("id").isNotNull() & finite & F.exists("embedding", lambda x: x != 0), F.lit(False))
    rows = write_through(rows.withColumn("usable", usable), "cap-rows")
    classes = rows.where("usable").groupBy("embedding").agg(F.min("id").alias("least_id"), F.count("*").alias("weight"))
    classes = write_through(classes.withColumn("cid", F.monotonically_increasing_id()), "cap-classes")
    found = []
    # one pass for each length of vectors; tables hold one or very few
    for dims, n in classes.groupBy(F.size("embedding")).count().collect():
        plan = shape(dims, n, filters, bucket, block)

        def cells(batches: Iterator[pa.RecordBatch], dims=dims, plan=plan) -> Iterator[pa.RecordBatch]:
            count = plan.size * plan.groups
            for batch in non_empty(batches):
                for at in range(0, batch.num_rows, 1000):
                    part = batch.slice(at, 1000)
                    row, first, second = decode(_matrix(part.column(1), dims), plan, seed)
                    pairs = np.unique(row.astype(np.int64) * count + first * plan.groups + second % plan.groups)
                    row, cell = pairs // count, pairs % count
                    offsets = np.searchsorted(row, np.arange(part.num_rows + 1)).astype(np.int32)
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0), part.column(1), part.column(2), pa.ListArray.from_arrays(offsets, pa.array(cell, pa.int64()))],
                        names=["cid", "embedding", "weight", "cells"],
                    )

        decoded = classes.where(F.size("embedding") == dims).select("cid", "embedding", "weight")
        decoded = write_through(decoded.mapInArrow(cells, f"cid long, embedding {kind}, weight long, cells array<long>"), "cap-cells")
        sizes = decoded.select(F.explode("cells").alias("cell")).groupBy("cell").count()
        sizes = sizes.select("cell", F.ceil(F.col("count") / block).alias("parts"))
        dealt = decoded.select("*", F.explode("cells").alias("cell")).join(sizes, "cell")
        own = F.pmod(F.xxhash64("cid"), F.col("parts"))
        other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("other")
        dealt = dealt.select("cell", "cid", "embedding", "weight", "cells", own.alias("own"), other)
        dealt = dealt.select(
            "cell", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "cid", "embedding", "weight", "cells",
            (F.col("own") > F.col("other")).cast("int").alias("side"),
        )
        found.append(dealt.groupBy("cell", "x", "y").applyInArrow(lambda t: verify(t, least), "cid long, links long, root long"))
    links = spark.createDataFrame([], "cid long, links long, root long")
    for part in found:
        links = links.unionByName(part)
    links = write_through(links.repartition(partitions(spark)), "cap-links") if not found else write_through(links, "cap-links")
    groups = components(links.select(F.col("cid").alias("a"), F.col("root").alias("b")))
    counts = links.groupBy("cid").agg(F.sum("links").alias("links"))
    named = classes.select("cid", "least_id").join(groups.withColumnRenamed("node", "cid"), "cid")
    named = named.groupBy("component").agg(F.min("least_id").alias("component_id"))
    result = classes.join(counts, "cid", "left").join(groups.withColumnRenamed("node", "cid"), "cid", "left").join(named, "component", "left")
    result = result.select(
        F.col("embedding").alias("__e"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
        F.coalesce("component_id", "least_id").alias("component_id"),
    )
    result = write_through(result, "cap-result")
    joined = rows.join(result, F.col("usable") & (F.col("embedding") == F.col("__e")), "left")
    component = F.coalesce("component_id", "id")
    return joined.select(
        F.col("id").alias(id_column), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"),
    )
