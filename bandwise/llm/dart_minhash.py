"""Near-duplicate texts by DartMinHash signatures and a banded join.

1.  Elements are the distinct shingles of five words of a document (a document of fewer words is one shingle), lower case in
    A-Z; weights are 1 ("presence", so similarity is Jaccard's) or the number of occurrences ("count", weighted Jaccard).
2.  An element's weight axis is cut into slabs [0,1), [1,2), [2,4), ...  In each slab darts arrive as a Poisson process in
    rank whose generator is seeded by element and slab, so that every document with the element sees the same darts; a
    dart hits if it lies below the element's weight.  A dart also carries a hashed coordinate; the signature keeps the
    earliest hit of each of the k coordinates.  Ranks are only followed up to (k ln k + 2 k) over the document's total
    weight, so the work is proportional to elements plus k ln k; documents with an empty coordinate go twice as far.
3.  Documents with the same elements are one class.  Classes meet in bands of `rows` coordinates.
4.  In each bucket every member is compared with the bucket's leader (the member that shares most buckets), exactly, on
    the whole sets.  That settles most buckets, large ones of near copies above all: their members are in one group.  In
    a bucket that still holds several groups, all pairs of different groups are compared, inside tasks that get a
    pair of blocks of at most `block` members and return one link per member, to the root of its local group.  So
    no candidate pair of different groups goes untested, and no pairs are written out.

Two documents of similarity 0.8 miss each other in all 30 bands of 5 with probability 7e-6.
Null and empty texts have no elements and are groups of their own.  A null id counts as larger than all others; rows
that repeat are members each, and one of them stays.  Extra columns are kept by `drop_near_copies`, else not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bandwise.llm.common import keep_rows, non_empty
from bandwise.llm.components import components, local_roots
from bandwise.llm.text import LOWER, NOT_BLANK, Block, Hasher, blocks, mix, unit, words
from bandwise.session import write_through

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 30, 5
_ODD = np.uint64(0x9E3779B97F4A7C15)
#: Bits of an element's hash that are kept; the rest holds the number of the document within a batch.
_KEPT = 50


def elements(block: Block, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of a block: document, hash, number of occurrences; sorted by document and hash."""
    data = LOWER[block.data]
    spans = words(block, NOT_BLANK)
    hashes = Hasher(data).slices(spans.start, spans.end)
    counts = spans.counts
    total = np.maximum(counts - width + 1, np.minimum(counts, 1))
    doc = np.repeat(np.arange(len(block)), total)
    at = np.repeat(spans.first[:-1] - np.concatenate([[0], np.cumsum(total)[:-1]]), total) + np.arange(total.sum())
    value = np.zeros(len(doc), np.uint64)
    last = spans.first[doc + 1]
    for k in range(width):
        inside = at + k < last
        value = value * _ODD + np.where(inside, hashes[np.minimum(at + k, max(len(hashes) - 1, 0))], np.uint64(k + 1)) if len(hashes) else value
    keys = np.sort((doc.astype(np.uint64) << np.uint64(_KEPT)) | (mix(value) >> np.uint64(64 - _KEPT)))
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    times = np.diff(np.append(first, len(keys)))
    return (keys[first] >> np.uint64(_KEPT)).astype(np.int64), keys[first] & np.uint64((1 << _KEPT) - 1), times


def signatures(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, docs: int, k: int, seed: int) -> np.ndarray:
    """k coordinates for each document: the earliest dart of each (0 throughout for a document without elements)."""
    signature = np.zeros((docs, k), np.uint64)
    total = np.bincount(doc, weight, minlength=docs)
    todo, reach = total > 0, k * (np.log(k) + 2)
    while todo.any():
        chosen = todo[doc]
        d, x, w = doc[chosen], element[chosen], weight[chosen].astype(np.float64)
        slabs = np.where(w > 1, np.ceil(np.log2(np.maximum(w, 1))), 0).astype(np.int64) + 1
        region = np.repeat(np.arange(len(d)), slabs)
        slab = np.arange(len(region)) - np.repeat(np.cumsum(slabs) - slabs, slabs)
        low = np.where(slab > 0, 2.0 ** (slab - 1), 0.0)
        height = np.maximum(low, 1.0)
        owner, limit = d[region], w[region]
        state = mix(mix(x[region]) + slab.astype(np.uint64) * _ODD + np.uint64(seed))
        end = (reach / np.maximum(total, 1e-300))[owner]
        rank = np.zeros(len(region))
        best = np.full(docs * k, np.inf)
        hits: list[tuple] = []
        while len(region):
            state = mix(state + _ODD)
            rank = rank - np.log(unit(state)) / height
            live = rank < end
            state, rank, owner, limit, low, height, end = (a[live] for a in (state, rank, owner, limit, low, height, end))
            region = region[live]
            hit = low + height * unit(mix(state ^ np.uint64(0x5851F42D4C957F2D))) < limit
            place = owner[hit] * k + (mix(state[hit] ^ np.uint64(0x2545F4914F6CDD1D)) % np.uint64(k)).astype(np.int64)
            np.minimum.at(best, place, rank[hit])
            hits.append((place, rank[hit], state[hit]))
        for place, at, dart in hits:
            first = at == best[place]
            signature.reshape(-1)[place[first]] = dart[first]
        full = np.isfinite(best.reshape(docs, k)).all(axis=1)
        todo &= ~full
        reach *= 2
    return signature


def bands(signature: np.ndarray, n_bands: int, rows: int) -> np.ndarray:
    """One hash for each band of each signature."""
    value = np.zeros((len(signature), n_bands), np.uint64) + np.arange(n_bands, dtype=np.uint64)
    for r in range(rows):
        value = mix(value * _ODD + signature[:, r : n_bands * rows : rows])
    return value


def digests(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, docs: int) -> np.ndarray:
    """Two 64-bit sums over the (element, weight) pairs of each document, and their number."""
    first = np.searchsorted(doc, np.arange(docs + 1))
    out = np.zeros((docs, 2), np.uint64)
    for i in range(2):
        sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(mix(element + np.uint64(i) * _ODD) + weight.astype(np.uint64)))])
        out[:, i] = sums[first[1:]] - sums[first[:-1]]
    return out


def _weights(times: np.ndarray, kind: str) -> np.ndarray:
    return times if kind == "count" else np.ones_like(times)


def _signed(batches: Iterator[pa.RecordBatch], weights: str, n_bands: int, rows: int, seed: int) -> Iterator[pa.RecordBatch]:
    """(id, sha, text) to (uid, id, sha, d1, d2, n, bands); uid numbers the rows of the input."""
    uid = TaskContext.get().partitionId() << 36
    for batch in non_empty(batches):
        for part in blocks(batch.column(2)):
            doc, element, times = elements(part)
            weight = _weights(times, weights)
            found = bands(signatures(doc, element, weight, len(part), n_bands * rows, seed), n_bands, rows).view(np.int64)
            sums = digests(doc, element, weight, len(part)).view(np.int64)
            own = batch.slice(part.first, len(part))
            offsets = np.arange(len(part) + 1, dtype=np.int32) * n_bands
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.arange(uid, uid + len(part))),
                    own.column(0),
                    own.column(1),
                    pa.array(sums[:, 0]),
                    pa.array(sums[:, 1]),
                    pa.array(np.bincount(doc, minlength=len(part))),
                    pa.ListArray.from_arrays(offsets, pa.array(found.ravel())),
                ],
                names=["uid", "id", "sha", "d1", "d2", "n", "bands"],
            )
            uid += len(part)


def _sets(batches: Iterator[pa.RecordBatch], weights: str) -> Iterator[pa.RecordBatch]:
    """(uid, d1, d2, text) to (uid, members): the sorted hashes of the text's elements, if it is the text meant."""
    for batch in non_empty(batches):
        for part in blocks(batch.column(3)):
            doc, element, times = elements(part)
            weight = _weights(times, weights)
            own = batch.slice(part.first, len(part))
            same = (digests(doc, element, weight, len(part)).view(np.int64) == np.stack([own.column(i).to_numpy() for i in (1, 2)], 1)).all(1)
            first = np.searchsorted(doc, np.arange(len(part) + 1))
            # an element of weight w is w elements, so that all sets have weight 1
            again = np.repeat(np.arange(len(element)), weight)
            copy = (np.arange(len(again)) - np.repeat(np.cumsum(weight) - weight, weight)).astype(np.uint64)
            element = element[again] if weights == "presence" else mix(element[again] + copy * _ODD)
            first = np.concatenate([[0], np.cumsum(weight)])[first]
            members = [np.sort(element[a:b]).tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]
            chosen = np.flatnonzero(same)
            yield pa.RecordBatch.from_arrays(
                [own.column(0).take(pa.array(chosen)), pa.array([members[i] for i in chosen], pa.binary())], names=["uid", "members"]
            )


def similarity(a: bytes, b: bytes) -> float:
    """Jaccard similarity of two sets of sorted hashes."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    if not len(x) or not len(y):
        return 0.0
    common = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
    return common / (len(x) + len(y) - common)


def _compare(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    for batch in non_empty(batches):
        a, b = batch.column(2).to_pylist(), batch.column(3).to_pylist()
        linked = pa.array([similarity(x, y) >= least for x, y in zip(a, b, strict=True)], pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(linked)


def compare_blocks(group: pa.Table, least: float) -> pa.Table:
    """Links between the two sides of a pair of blocks (side 2: both), as one link per member: a, b."""
    uid, side = group.column("uid").to_numpy(), group.column("side").to_numpy()
    sets = [np.frombuffer(m, np.uint64) for m in group.column("members").to_pylist()]
    size = np.array([len(x) for x in sets], np.float32)
    owner = np.repeat(np.arange(len(sets)), size.astype(np.int64))
    _, word, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times > 1
    column = np.cumsum(shared) - 1
    owner, word = owner[shared[word]], column[word[shared[word]]]
    order = np.argsort(word, kind="stable")
    owner, word = owner[order], word[order]
    left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
    common = np.zeros((len(left), len(right)), np.float32)
    for at in range(0, int(shared.sum()), 4096):
        a, b = np.searchsorted(word, [at, at + 4096])
        present = np.zeros((len(sets), 4096), np.float32)
        present[owner[a:b], word[a:b] - at] = 1
        common += present[left] @ present[right].T
    whole = size[left][:, None] + size[right][None, :] - common
    p, q = np.nonzero(common >= np.float64(least) * whole)
    p, q = left[p], right[q]
    p, q = np.concatenate([p, q]), np.concatenate([q, p])
    p, q = p[p != q], q[p != q]
    order = np.argsort(p, kind="stable")
    p, q = p[order], q[order]
    linked = np.unique(p)
    return pa.table({"a": uid[linked], "b": uid[local_roots(p, q, len(uid))[linked]]})


def _block_pairs(placed: DataFrame, block: int) -> DataFrame:
    """Members (bucket, uid, group) dealt to pairs of blocks x, y: every pair of different groups meets in one.

    A group of more than `block` members in a bucket has blocks of its own, which are not compared with each other.
    """
    per_group = placed.groupBy("bucket", "group").agg(F.count("*").alias("n"))
    own = F.when(F.col("n") > block, F.col("group").cast("string")).otherwise(F.lit("-"))
    pools = per_group.withColumn("pool", own)
    parts = pools.groupBy("bucket", "pool").agg(F.ceil(F.sum("n") / block).alias("parts"))
    parts = write_through(parts, "dart-pools")
    known = placed.join(pools.select("bucket", "group", "pool"), ["bucket", "group"]).join(parts, ["bucket", "pool"])
    known = known.select("bucket", "pool", "uid", F.concat_ws("/", "pool", F.pmod(F.xxhash64("uid"), "parts").cast("string")).alias("part"))
    known = write_through(known, "dart-parts")
    all_parts = parts.select("bucket", "pool", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("no"))
    all_parts = all_parts.select("bucket", "pool", F.concat_ws("/", "pool", F.col("no").cast("string")).alias("part"))
    other = all_parts.select("bucket", F.col("pool").alias("pool2"), F.col("part").alias("y"))
    pairs = all_parts.withColumnRenamed("part", "x").join(other, "bucket")
    pairs = pairs.where("x <= y and (pool = '-' or pool <> pool2)").select("bucket", "x", "y")
    pairs = write_through(pairs, "dart-pairs")
    one = known.join(pairs.withColumn("part", F.col("x")), ["bucket", "part"])
    one = one.select("bucket", "x", "y", "uid", F.when(F.col("x") == F.col("y"), 2).otherwise(0).alias("side"))
    two = known.join(pairs.where("x <> y").withColumn("part", F.col("y")), ["bucket", "part"])
    return one.unionByName(two.select("bucket", "x", "y", "uid", F.lit(1).alias("side")))


def near_groups(
    docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", least: float = SIMILARITY, weights: str = "presence",
    n_bands: int = BANDS, rows: int = ROWS, seed: int = 29, block: int = 256,
) -> DataFrame:
    """One row per row of docs: id, class_id (smallest id of its group), class_size, kept, text_sha256."""
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    named = docs.select(F.col(id_column).cast("long").alias("id"), F.sha2(text, 256).alias("sha"), text.alias("text"))
    schema = "uid long, id long, sha string, d1 long, d2 long, n long, bands array<long>"
    signed = write_through(named.mapInArrow(lambda b: _signed(b, weights, n_bands, rows, seed), schema), "dart-signatures")
    filled = signed.where("n > 0")
    classes = write_through(filled.groupBy("d1", "d2").agg(F.min("uid").alias("rep")), "dart-classes")
    reps = signed.join(classes.select(F.col("rep").alias("uid")), "uid", "left_semi")
    banded = reps.select("uid", F.explode("bands").alias("bucket"))
    sizes = banded.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    members = write_through(banded.join(sizes, "bucket"), "dart-buckets")
    shared = members.groupBy("uid").agg(F.sum(F.col("size") - 1).alias("shared"))
    members = write_through(members.drop("size").join(shared, "uid"), "dart-members")
    wanted = reps.join(shared, "uid", "left_semi").select("uid", F.col("id").alias("__id"), F.col("sha").alias("__sha"), "d1", "d2")
    texts = named.join(write_through(wanted, "dart-wanted"), F.col("id").eqNullSafe(F.col("__id")) & (F.col("sha") == F.col("__sha")))
    sets = texts.select("uid", "d1", "d2", "text").mapInArrow(lambda b: _sets(b, weights), "uid long, members binary")
    sets = write_through(sets.dropDuplicates(["uid"]), "dart-sets")

    left = sets.select(F.col("uid").alias("a"), F.col("members").alias("x"))
    right = sets.select(F.col("uid").alias("b"), F.col("members").alias("y"))
    leaders = members.groupBy("bucket").agg(F.max(F.struct("shared", "uid"))["uid"].alias("leader"))
    members = write_through(members.drop("shared").join(leaders, "bucket").where("uid <> leader"), "dart-led")
    pairs = members.select(F.col("uid").alias("a"), F.col("leader").alias("b")).distinct()
    pairs = pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y")
    links = write_through(pairs.mapInArrow(lambda b: _compare(b, least), "a long, b long"), "dart-led-links")
    groups = components(links)
    placed = members.drop("leader").join(groups.select(F.col("node").alias("uid"), "component"), "uid", "left")
    placed = placed.select("bucket", "uid", F.coalesce("component", "uid").alias("group"))
    mixed = placed.groupBy("bucket").agg(F.min("group").alias("least"), F.max("group").alias("most")).where("least <> most")
    placed = write_through(placed.join(mixed.select("bucket"), "bucket", "left_semi"), "dart-open")
    blocked = _block_pairs(placed, block).join(sets, "uid")
    more = blocked.groupBy("bucket", "x", "y").applyInArrow(lambda t: compare_blocks(t, least), "a long, b long")
    more = write_through(more, "dart-block-links")
    if not more.isEmpty():
        groups = components(links.unionByName(more))
    named_classes = classes.join(groups.select(F.col("node").alias("rep"), "component"), "rep", "left")
    named_classes = write_through(named_classes.select("d1", "d2", F.coalesce("component", "rep").alias("group")), "dart-groups")
    placed = signed.drop("bands").join(named_classes, ["d1", "d2"], "left")
    placed = write_through(placed.select("uid", "id", "sha", F.when(F.col("n") > 0, F.col("group")).otherwise(F.col("uid")).alias("group")), "dart-placed")
    first = F.min(F.struct(F.col("id").isNull(), F.col("id").alias("id"), F.col("uid").alias("uid")))
    heads = write_through(placed.groupBy("group").agg(first.alias("head"), F.count("*").alias("class_size")), "dart-heads")
    return placed.join(heads, "group").select(
        F.col("id").alias(id_column), F.col("head.id").alias("class_id"), "class_size", (F.col("uid") == F.col("head.uid")).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def drop_near_copies(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", **options) -> DataFrame:
    """The rows of docs that stay, one of each group, with all their columns."""
    return keep_rows(docs, near_groups(docs, id_column=id_column, text_column=text_column, **options), id_column, text_column)
