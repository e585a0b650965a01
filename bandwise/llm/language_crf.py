"""Language identification by a linear-chain conditional random field over the words of a text.

A word (run of letters, lower case) has features: itself (the lexicon), its first one to three and last one to four bytes
(affixes), and its byte pairs and triples (n-grams), all hashed.  A chain is a whole document; the model has a weight per
feature and language, and a learned transition weight per pair of languages.  Forward-backward gives every word a
probability per language, so a text may switch between languages; a document's shares are the means over its words.

The model is fitted in the driver on at most `sample_docs` documents of at most `max_bytes` bytes (documented bounds), in
chains of `chain` words that together cover those texts.  Labelling is one pass without a shuffle.  All documents of a block
are worked on together, one position at a time, so a long document costs steps but no copy of its neighbours.

A text that is null or has no letter is "und" with score 0; so is everything if there is nothing to learn from.  Rows with
a null language are not learned from, but predicted.  Repeated rows are predicted each; extra columns are passed on.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bandwise.llm.common import fresh, non_empty, replaced
from bandwise.llm.text import LETTERS, Hasher, blocks, mix, per_document, words

UNKNOWN = "und"
BLOCK_BYTES = 6_000_000
_PREFIXES, _SUFFIXES, _GRAMS = (1, 2, 3), (1, 2, 3, 4), (2, 3)


@dataclass
class Types:
    """Distinct words by their features: one bucket per word and kind (-1: none), and flat lists of n-grams."""

    single: list[np.ndarray]
    grams: list[tuple[np.ndarray, np.ndarray]]

    def emissions(self, weights: np.ndarray) -> np.ndarray:
        total = np.zeros((len(self.single[0]), weights.shape[1]))
        for bucket in self.single:
            total += np.where(bucket[:, None] >= 0, weights[bucket], 0)
        for flat, first in self.grams:
            total += per_document(weights[flat], first)
        return total

    def gradient(self, slope: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
        """Slopes per word and language to slopes per feature and language."""
        out = np.zeros(shape)
        for k in range(shape[1]):
            for bucket in self.single:
                some = bucket >= 0
                out[:, k] += np.bincount(bucket[some], slope[some, k], shape[0])
            for flat, first in self.grams:
                out[:, k] += np.bincount(flat, np.repeat(slope[:, k], np.diff(first)), shape[0])
        return out


def word_types(data: np.ndarray, hasher: Hasher, start: np.ndarray, end: np.ndarray, bits: int) -> Types:
    def bucket(begin: np.ndarray, stop: np.ndarray, kind: int) -> np.ndarray:
        return (mix(hasher.slices(begin, stop) + np.uint64(kind)) >> np.uint64(64 - bits)).astype(np.int64)

    length = end - start
    single = [bucket(start, end, 1)]
    for n in _PREFIXES:
        single.append(np.where(length >= n, bucket(start, np.minimum(start + n, end), 10 + n), -1))
    for n in _SUFFIXES:
        single.append(np.where(length >= n, bucket(np.maximum(end - n, start), end, 20 + n), -1))
    grams = []
    for n in _GRAMS:
        many = np.maximum(length - n + 1, 0)
        first = np.concatenate([[0], np.cumsum(many)])
        at = np.repeat(start - first[:-1], many) + np.arange(first[-1])
        grams.append((bucket(at, at + n, 30 + n), first))
    return Types(single, grams)


def marginals(emission: np.ndarray, transition: np.ndarray, first: np.ndarray, pairs: np.ndarray | None = None) -> np.ndarray:
    """Forward-backward: probabilities per position and language, for all chains `first[c]:first[c + 1]` at once.

    `pairs`, if given, gets the expected number of transitions added.
    """
    n, k = emission.shape
    e = np.exp(emission - emission.max(axis=1, keepdims=True, initial=-np.inf)).astype(np.float32)
    t = np.exp(transition - transition.max()).astype(np.float32)
    length = np.diff(first)
    order = np.argsort(-length, kind="stable")
    begin, length = first[:-1][order], length[order]
    steps = int(length[0]) if len(length) else 0
    active = np.searchsorted(-length, -np.arange(steps), "left")
    alpha = np.empty((n, k), np.float32)
    now = None
    for s in range(steps):
        at = begin[: active[s]] + s
        now = e[at] if s == 0 else (now[: active[s]] @ t) * e[at]
        now /= now.sum(axis=1, keepdims=True)
        alpha[at] = now
    gamma = np.empty((n, k), np.float32)
    beta = np.zeros((0, k), np.float32)
    for s in range(steps - 1, -1, -1):
        at = begin[: active[s]] + s
        full = np.ones((active[s], k), np.float32)
        if len(beta):
            following = e[at[: len(beta)] + 1] * beta
            full[: len(beta)] = following @ t.T
            if pairs is not None:
                joint = alpha[at[: len(beta)], :, None] * t[None] * following[:, None, :]
                pairs += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
            full /= full.sum(axis=1, keepdims=True)
        now = alpha[at] * full
        gamma[at] = now / now.sum(axis=1, keepdims=True)
        beta = full
    return gamma


@dataclass
class Model:
    languages: list[str]
    bits: int
    weights: np.ndarray
    transition: np.ndarray

    def labelled(self, column: pa.Array) -> Iterator[tuple]:
        """(block, its words, probability of each language per word), block by block."""
        for block in blocks(pc.utf8_lower(pc.fill_null(column.cast(pa.large_string()), "")), BLOCK_BYTES):
            spans = words(block, LETTERS)
            if not len(spans):
                yield block, spans, np.zeros((0, len(self.languages)), np.float32)
                continue
            hasher = Hasher(block.data)
            _, one, which = np.unique(hasher.slices(spans.start, spans.end), return_index=True, return_inverse=True)
            kinds = word_types(block.data, hasher, spans.start[one], spans.end[one], self.bits)
            emission = kinds.emissions(self.weights).astype(np.float32)[which]
            yield block, spans, marginals(emission, self.transition, spans.first)

    def shares(self, column: pa.Array) -> np.ndarray:
        """Mean probability of each language over the words of each text (0 if there is no word)."""
        found = []
        for block, spans, gamma in self.labelled(column):
            if not len(spans):
                found.append(np.zeros((len(block), len(self.languages))))
                continue
            found.append(per_document(gamma, spans.first) / np.maximum(spans.counts, 1)[:, None])
        return np.concatenate(found) if found else np.zeros((0, len(self.languages)))


def fit_model(texts: list[str], labels: list[str], *, bits: int = 16, chain: int = 100, rounds: int = 30, rate: float = 0.3, penalty: float = 2.0) -> Model:
    """Adaptive gradient ascent on the likelihood of the word labels given the words, with a Gaussian prior.

    Texts are cut into chains of at most `chain` words, and every two chains of a fixed shuffle are joined, so that
    transitions between languages are observed too.
    """
    languages = sorted(set(labels))
    number = {name: i for i, name in enumerate(languages)}
    block = next(blocks(pc.utf8_lower(pa.array(texts, pa.large_string())), 1 << 60))
    spans = words(block, LETTERS)
    truth = np.array([number[x] for x in labels], np.int64)[spans.doc]
    starts = [np.arange(a, b, chain) for a, b in zip(spans.first[:-1], spans.first[1:], strict=True)]
    border = np.append(np.concatenate(starts) if starts else np.zeros(0, np.int64), len(spans)).astype(np.int64)
    shuffled = np.random.default_rng(5).permutation(len(border) - 1)
    sizes = np.diff(border)[shuffled]
    ends = np.cumsum(sizes)
    place = np.repeat(border[:-1][shuffled] - (ends - sizes), sizes) + np.arange(len(spans))
    truth, first = truth[place], np.append((ends - sizes)[::2], len(spans)).astype(np.int64)
    hasher = Hasher(block.data)
    _, one, which = np.unique(hasher.slices(spans.start, spans.end), return_index=True, return_inverse=True)
    which = which[place]
    kinds = word_types(block.data, hasher, spans.start[one], spans.end[one], bits)
    k, shape = len(languages), (1 << bits, len(languages))
    weights, transition = np.zeros(shape), np.zeros((k, k))
    seen, seen_transition = np.full(shape, 1e-6), np.full((k, k), 1e-6)
    inside = np.ones(len(spans), bool)
    inside[first[:-1][first[:-1] < len(spans)]] = False
    later = np.flatnonzero(inside)
    observed = np.zeros((k, k))
    np.add.at(observed, (truth[later - 1], truth[later]), 1)
    for _ in range(rounds if len(spans) else 0):
        pairs = np.zeros((k, k))
        gamma = marginals(kinds.emissions(weights)[which], transition, first, pairs)
        slope = -gamma.astype(np.float64)
        slope[np.arange(len(truth)), truth] += 1
        by_type = np.stack([np.bincount(which, slope[:, j], len(one)) for j in range(k)], axis=1)
        gradient = kinds.gradient(by_type, shape) - penalty * weights
        seen += gradient**2
        weights += rate * gradient / np.sqrt(seen)
        gradient = observed - pairs - penalty * transition
        seen_transition += gradient**2
        transition += rate * gradient / np.sqrt(seen_transition)
    return Model(languages, bits, weights.astype(np.float32), transition)


def fit(
    docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", label_column: str = "lang", sample_docs: int = 1_500, max_bytes: int = 100_000, **options
) -> Model | None:
    """Fit on at most `sample_docs` rows with a label and a text of 1 to `max_bytes` bytes, those of the lowest hashes."""
    rows = docs.select(
        F.coalesce(F.col(id_column).cast("string"), F.lit("")).alias("id"), F.col(text_column).cast("string").alias("text"), F.col(label_column).alias("label")
    )
    rows = rows.where("label is not null and text is not null").where(F.octet_length("text").between(1, max_bytes))
    order = [F.xxhash64("id"), "id", "label", "content"]
    rows = rows.withColumn("content", F.xxhash64("text"))
    # at most sample_docs keys, without their texts
    chosen = rows.select("id", "label", "content").distinct().orderBy(*order).limit(sample_docs)
    found = rows.join(F.broadcast(chosen), ["id", "label", "content"], "left_semi").dropDuplicates(["id", "label", "content"])
    found = found.orderBy(*order).toArrow()
    if not found.num_rows:
        return None
    return fit_model(found.column("text").to_pylist(), found.column("label").to_pylist(), **options)


def label_runs(docs: DataFrame, model: Model | None, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Runs of words of one language: id, run, first_word, last_word (words of letters, from 0), lang, probability (mean).

    A word has the language of its highest marginal probability.  Texts without a word have no run, repeated rows are
    reported each, and an empty table or no model gives an empty table.  Other columns of docs are not read.
    """
    schema = f"`{id_column}` {docs.schema[id_column].dataType.simpleString()}, run int, first_word long, last_word long, lang string, probability double"
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))
    if model is None:
        return docs.sparkSession.createDataFrame([], schema)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array(held.value.languages, object)
        for batch in non_empty(batches):
            for block, spans, gamma in held.value.labelled(batch.column(1)):
                if not len(spans):
                    continue
                best, doc = gamma.argmax(axis=1), spans.doc
                at = np.flatnonzero(np.append(True, (best[1:] != best[:-1]) | (doc[1:] != doc[:-1])))
                size = np.diff(np.append(at, len(best)))
                mean = np.add.reduceat(gamma[np.arange(len(best)), best].astype(np.float64), at) / size
                owner = doc[at]
                number = np.arange(len(at)) - np.searchsorted(owner, owner)
                begin = at - spans.first[owner]
                ids = batch.column(0).slice(block.first, len(block)).take(pa.array(owner))
                yield pa.RecordBatch.from_arrays(
                    [
                        ids, pa.array(number, pa.int32()), pa.array(begin, pa.int64()), pa.array(begin + size - 1, pa.int64()),
                        pa.array(names[best[at]], pa.string()), pa.array(np.clip(mean, 0, 1), pa.float64()),
                    ],
                    names=[id_column, "run", "first_word", "last_word", "lang", "probability"],
                )

    return rows.mapInArrow(run, schema)


def predict(docs: DataFrame, model: Model | None, *, text_column: str = "text") -> DataFrame:
    """docs without the text, with lang_pred, score (mean probability of that language), n_languages (over 5 % of the words)."""
    plain, letters = fresh(docs, "__text", "__letter")
    rows = docs.withColumn(plain, F.col(text_column).cast("string")).drop(text_column, "lang_pred", "score", "n_languages")
    rest = [f for f in rows.schema.fields if f.name != plain]
    if model is None:
        return rows.select(*(f.name for f in rest), F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(0).alias("n_languages"))
    held = docs.sparkSession.sparkContext.broadcast(model)
    rows = rows.withColumn(letters, F.coalesce(F.col(plain).rlike(r"\p{L}"), F.lit(False)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in non_empty(batches):
            names = batch.schema.names
            shares = held.value.shares(batch.column(names.index(plain)))
            letter = batch.column(names.index(letters)).to_numpy(zero_copy_only=False).astype(bool)
            best = shares.argmax(axis=1)
            name = np.where(letter, np.array(held.value.languages, object)[best], UNKNOWN)
            score = np.where(letter, np.clip(shares.max(axis=1), 0, 1), 0.0)
            out = batch.select([f.name for f in rest])
            yield replaced(
                out, lang_pred=pa.array(name, pa.string()), score=pa.array(score, pa.float64()),
                n_languages=pa.array(np.where(letter, (shares > 0.05).sum(axis=1), 0), pa.int32()),
            )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest)
    return rows.mapInArrow(run, schema + ", lang_pred string, score double, n_languages int")
