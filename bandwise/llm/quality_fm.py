"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

Features of a document: its distinct words, hashed (value: damped count over the root of the sum of squares); about
twenty statistics of its structure (shares of character classes, word and line lengths, repetition), each as one of a
few bins whose borders are quantiles of the sample; and one bin for the declared length, if there is such a column.
The score is the logistic of  b + sum w_i x_i + 1/2 sum_f ((sum v_if x_i)^2 - sum v_if^2 x_i^2),  which is linear in
the number of features.

It is fitted in the driver on at most `sample_rows` labelled rows, chosen by hash: a documented bound.  Scoring is one
pass over the table without a shuffle; the model has a fixed size (2**bits rows).

Null and empty texts have no words and the statistics of an empty text; they are scored like all others.  Without any
labelled row every score is `PRIOR`.  Rows that repeat are scored each; extra columns are kept by `score`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bandwise.llm.common import fresh, non_empty, replaced
from bandwise.llm.text import LETTERS, LOWER, NOT_BLANK, Block, Hasher, blocks, byte_class, per_document, words

PRIOR = 0.5
THRESHOLD = 0.3

_UPPER = byte_class((0x41, 0x5A), high=False)
_DIGIT = byte_class((0x30, 0x39), high=False)
_PLAIN_MARKS = byte_class((0x2C, 0x2C), (0x2E, 0x2E), (0x3A, 0x3B), (0x27, 0x27), high=False)
_MARKS = byte_class((0x21, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7E), high=False) & ~_PLAIN_MARKS
_LOUD = byte_class((0x21, 0x21), (0x3F, 0x3F), high=False)
_LINE = ~byte_class((0x0A, 0x0A), high=False)


def _distinct(first: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents, keys and counts of the distinct keys of each document; keys below 2**40."""
    doc = np.repeat(np.arange(len(first) - 1, dtype=np.uint64), np.diff(first))
    joined = np.sort((doc << np.uint64(40)) | keys)
    new = np.ones(len(joined), bool)
    new[1:] = joined[1:] != joined[:-1]
    at = np.flatnonzero(new)
    counts = np.diff(np.append(at, len(joined)))
    return (joined[at] >> np.uint64(40)).astype(np.int64), joined[at] & np.uint64((1 << 40) - 1), counts


def _repetition(first: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per document: share of distinct items, and the share of the most frequent one (1, 0 if there are none)."""
    n, docs = np.diff(first), len(first) - 1
    doc, _, counts = _distinct(first, hashes >> np.uint64(24))
    most = np.zeros(docs)
    if len(doc):
        at = np.flatnonzero(np.diff(doc, prepend=-1))
        most[doc[at]] = np.maximum.reduceat(counts, at)
    some = np.maximum(n, 1)
    return np.where(n > 0, np.bincount(doc, minlength=docs) / some, 1.0), most / some


@dataclass
class Features:
    """Words of documents as (document, bucket, value), and the statistics of each document."""

    doc: np.ndarray
    bucket: np.ndarray
    value: np.ndarray
    statistics: np.ndarray


def extract(block: Block, declared: np.ndarray, bits: int) -> Features:
    data, offsets = block.data, block.offsets
    low = LOWER[data]
    hasher = Hasher(low)
    letters, tokens, lines = words(block, LETTERS), words(block, NOT_BLANK), words(block, _LINE)
    hashes = hasher.slices(letters.start, letters.end)
    size = np.maximum(block.lengths, 1)

    def share(kind: np.ndarray) -> np.ndarray:
        return np.diff(np.searchsorted(np.flatnonzero(kind[data]), offsets)) / size

    def mean(spans) -> np.ndarray:
        return per_document(spans.end - spans.start, spans.first) / np.maximum(spans.counts, 1)

    def has(kind: np.ndarray) -> np.ndarray:
        """Share of the tokens that hold a byte of the class."""
        token = np.searchsorted(tokens.start, np.flatnonzero(kind[data]), "right") - 1
        marked = np.zeros(len(tokens), bool)
        marked[token] = True
        return share_of(marked)

    def share_of(tokens_with: np.ndarray) -> np.ndarray:
        return np.diff(np.searchsorted(np.flatnonzero(tokens_with), tokens.first)) / n_tokens

    n_tokens = np.maximum(tokens.counts, 1)
    capital = _UPPER[data[tokens.start]] if len(tokens) else np.zeros(0, bool)
    last = data[tokens.end - 1] if len(tokens) else np.zeros(0, np.uint8)
    alone = (tokens.end - tokens.start) == 1
    token_hashes = hasher.slices(tokens.start, tokens.end)
    pair = token_hashes.copy()
    pair[1:] += token_hashes[:-1] * np.uint64(0x9E3779B97F4A7C15)
    statistics = np.stack(
        [
            np.log1p(block.lengths),
            np.log1p(tokens.counts),
            share(_UPPER),
            share(_DIGIT),
            share(_MARKS),
            share(_PLAIN_MARKS),
            share(_LOUD),
            share(LETTERS),
            mean(letters),
            mean(tokens),
            mean(lines),
            np.log1p(lines.counts),
            has(_MARKS),
            has(_PLAIN_MARKS),
            share_of(capital),
            share_of((last == 0x2E) | (last == 0x2C)),
            share_of(alone),
            *_repetition(letters.first, hashes),
            *_repetition(tokens.first, pair),
            *_repetition(lines.first, hasher.slices(lines.start, lines.end)),
            np.where(np.isnan(declared), -1.0, np.log1p(np.maximum(np.nan_to_num(declared), 0))),
        ],
        axis=1,
    )
    doc, bucket, counts = _distinct(letters.first, hashes >> np.uint64(64 - bits))
    value = 1 + np.log(counts)
    norm = np.sqrt(np.bincount(doc, value**2, minlength=len(block)))
    return Features(doc, bucket.astype(np.int64), (value / norm[doc]).astype(np.float32), statistics)


@dataclass
class Machine:
    """Bins of the statistics, bias, weights and vectors.  Rows of `weights`: word buckets, then the bins."""

    bits: int
    borders: np.ndarray
    bias: float
    weights: np.ndarray
    #: values of the active bins, against words whose squares add up to 1
    scale: float

    def rows(self, statistics: np.ndarray) -> np.ndarray:
        """Row of `weights` for each statistic of each document."""
        n, bins = self.borders.shape[0], self.borders.shape[1] + 1
        found = np.stack([np.searchsorted(self.borders[k], statistics[:, k], "right") for k in range(n)], axis=1)
        return (1 << self.bits) + np.arange(n) * bins + found

    def scores(self, f: Features) -> np.ndarray:
        """One pass over the features: sums of w x and v x, and of (v x)^2."""
        docs = len(f.statistics)
        first = np.searchsorted(f.doc, np.arange(docs + 1))
        part = self.weights[f.bucket] * f.value[:, None]
        sums, squares = per_document(part, first), per_document(part[:, 1:] ** 2, first).sum(axis=1)
        bins = self.weights[self.rows(f.statistics)] * self.scale
        sums += bins.sum(axis=1)
        squares += (bins[:, :, 1:] ** 2).sum(axis=(1, 2))
        raw = self.bias + sums[:, 0] + 0.5 * ((sums[:, 1:] ** 2).sum(axis=1) - squares)
        return 1 / (1 + np.exp(-np.clip(raw, -30, 30)))


def fit_machine(
    indices: list[np.ndarray], values: list[np.ndarray], statistics: np.ndarray, labels: np.ndarray,
    *, bits: int, rank: int = 8, bins: int = 10, steps: int = 1200, rate: float = 0.08, penalty: float = 1e-4, seed: int = 7,
) -> Machine:
    """Adaptive gradient steps on the logistic loss, class by class of equal total weight."""
    borders = np.quantile(statistics, np.linspace(0, 1, bins + 1)[1:-1], axis=0).T
    scale = 1 / np.sqrt(statistics.shape[1])
    machine = Machine(bits, borders, 0.0, np.zeros(0), scale)
    random = np.random.default_rng(seed)
    total = (1 << bits) + statistics.shape[1] * bins
    weights = random.normal(0, 0.05, (total, rank + 1))
    weights[:, 0] = 0
    rows = machine.rows(statistics)
    positive = labels.mean()
    weight = np.where(labels > 0, 0.5 / max(positive, 1e-9), 0.5 / max(1 - positive, 1e-9))
    bias, seen, seen_bias, batch = 0.0, np.full_like(weights, 1e-6), 1e-6, 64
    full = [np.concatenate([indices[i], rows[i]]) for i in range(len(labels))]
    x = [np.concatenate([values[i], np.full(rows.shape[1], scale)]) for i in range(len(labels))]
    for _ in range(max(3, -(-steps * batch // len(labels)))):
        order = random.permutation(len(labels))
        for at in range(0, len(order), batch):
            chosen = order[at : at + batch]
            lengths = [len(full[i]) for i in chosen]
            first = np.concatenate([[0], np.cumsum(lengths)])
            ids, xs = np.concatenate([full[i] for i in chosen]), np.concatenate([x[i] for i in chosen])[:, None]
            used, inverse = np.unique(ids, return_inverse=True)
            part = weights[ids] * xs
            sums = per_document(part, first)
            raw = bias + sums[:, 0] + 0.5 * ((sums[:, 1:] ** 2).sum(1) - per_document(part[:, 1:] ** 2, first).sum(1))
            error = weight[chosen] * (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - labels[chosen]) / len(chosen)
            each = np.repeat(np.arange(len(chosen)), lengths)
            slope = np.empty_like(part)
            slope[:, :1] = xs
            slope[:, 1:] = xs * (sums[each, 1:] - part[:, 1:])
            slope *= error[each, None]
            gradient = np.zeros((len(used), rank + 1))
            np.add.at(gradient, inverse, slope)
            gradient += penalty * weights[used]
            seen[used] += gradient**2
            weights[used] -= rate * gradient / np.sqrt(seen[used])
            seen_bias += error.sum() ** 2
            bias -= rate * error.sum() / np.sqrt(seen_bias)
    machine.bias, machine.weights = bias, weights.astype(np.float32)
    return machine


def _declared(batch: pa.RecordBatch, name: str | None) -> np.ndarray:
    if name is None or name not in batch.schema.names:
        return np.full(batch.num_rows, np.nan)
    column = batch.column(batch.schema.names.index(name)).cast(pa.float64())
    return np.asarray(column.to_numpy(zero_copy_only=False), dtype=np.float64)


def fit(
    docs: DataFrame, labels: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality",
    metadata: str | None = "n_chars", bits: int = 15, sample_rows: int = 8_000, **options,
) -> Machine | None:
    """Fit on at most `sample_rows` rows of labels (lowest hashes of the id), joined with their texts.

    Rows without a label or id are passed over.  None if there is nothing to learn from.
    """
    key, label = F.col(id_column).alias("__key"), F.col(label_column).cast("double").alias("__label")
    chosen = labels.select(key, label).where("__key is not null and __label is not null").distinct()
    chosen = chosen.orderBy(F.xxhash64("__key"), "__key", "__label").limit(sample_rows)
    keep = [F.col(id_column).alias("__id"), F.col(text_column).cast("string").alias("__text")]
    if metadata in docs.columns:
        keep.append(F.col(metadata).cast("double").alias("__declared"))
    # the sample has at most sample_rows short rows
    rows = docs.select(*keep).join(F.broadcast(chosen), F.col("__id") == F.col("__key"))

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in non_empty(batches):
            declared, y = _declared(batch, "__declared"), batch.column(batch.schema.names.index("__label"))
            ids = batch.column(0)
            for block in blocks(batch.column(1)):
                f = extract(block, declared[block.first : block.first + len(block)], bits)
                first = np.searchsorted(f.doc, np.arange(len(block) + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(block.first, len(block)).cast(pa.int64()),
                        y.slice(block.first, len(block)),
                        pa.ListArray.from_arrays(first, pa.array(f.bucket, pa.int32())),
                        pa.ListArray.from_arrays(first, pa.array(f.value, pa.float32())),
                        pa.FixedSizeListArray.from_arrays(f.statistics.ravel(), f.statistics.shape[1]).cast(pa.list_(pa.float64())),
                    ],
                    names=["id", "label", "bucket", "value", "statistics"],
                )

    schema = "id long, label double, bucket array<int>, value array<float>, statistics array<double>"
    found = rows.mapInArrow(sample, schema).orderBy(F.xxhash64("id"), "id", "label").limit(sample_rows).toArrow()
    if not found.num_rows:
        return None
    columns = {n: found.column(n).combine_chunks() for n in found.schema.names}
    arrays = lambda c: np.split(c.flatten().to_numpy(), c.offsets.to_numpy()[1:-1]) if len(c) else []
    statistics = columns["statistics"].flatten().to_numpy().reshape(found.num_rows, -1)
    return fit_machine(
        [a.astype(np.int64) for a in arrays(columns["bucket"])], arrays(columns["value"]), statistics, columns["label"].to_numpy(), bits=bits, **options,
    )


def score(
    docs: DataFrame, machine: Machine | None, *, text_column: str = "text", metadata: str | None = "n_chars", output: str = "score"
) -> DataFrame:
    """All columns of docs and the score, 0 to 1 (a column of that name is replaced).

    Null and empty texts are scored by their statistics, repeated rows alike; an empty table gives an empty one.
    """
    base = docs.drop(output)
    text, number = fresh(docs, "__text", "__declared")
    if machine is None:
        return base.withColumn(output, F.lit(PRIOR))
    held = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in non_empty(batches):
            declared = _declared(batch, number)
            scores = [
                held.value.scores(extract(b, declared[b.first : b.first + len(b)], held.value.bits))
                for b in blocks(batch.column(batch.schema.names.index(text)))
            ]
            names = [n for n in batch.schema.names if n not in (text, number)]
            yield replaced(batch.select(names), **{output: pa.array(np.concatenate(scores), pa.float64())})

    read = [F.col(text_column).cast("string").alias(text)]
    if metadata in docs.columns:
        read.append(F.col(metadata).cast("double").alias(number))
    # read before a column of the output's name goes
    rows = docs.select("*", *read).drop(output)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema) + f", `{output}` double"
    return rows.mapInArrow(run, schema)
