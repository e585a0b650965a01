"""Language-model scoring with Elias-Fano n-gram tries, one per shard of the vocabulary.

Model: p(w | v) = (c(v w) + m p(w)) / (c(v) + m) with p(w) = (c(w) + 0.1) / (N + 0.1 (V + 1)) over all training tokens;
every text ends with an end token, and v is the start mark for its first token.  Its logarithm is a sum of a numerator,
which depends on w and the pair, and a denominator, which depends on v alone; so shards add up without meeting.

1.  Counts: tasks fold their words to distinct ones and send them, packed, to shards by hash.  The shards' tables hold the
    exact counts; N and V are their sums.  Words with at least 1/65536 of all tokens are heavy: at most 65536 words, which is
    the proven bound of the only table that is broadcast.
2.  Entries: tasks pack their texts in chunks to (word, context, document, times).  An entry goes to the shard of its word, or, if the
    word is heavy, to that of the pair, so that frequent words are spread over all shards.  Unigram terms of heavy words
    are added where the text is.
3.  A shard builds tries of two levels, for one range of its words after another: words, and below each word its contexts, from the training documents' entries.
    Sorted keys and pointers are monotone and kept as Elias-Fano sequences, logarithms of smoothed probabilities as 16-bit
    codes.  The levels are a memory-mapped file, and looked up by successor search among the contexts of the word.
4.  Shards answer with packed sums per chunk, for its documents that have words there, which are added up per chunk.

Words are compared by 64-bit hashes; contexts, below one word, by 40 bits of theirs.  All counts cover all training
documents.  Null texts count as empty: one end token.  Without training documents N and all counts are 0.  A null id is kept, and its
row is told apart by position; repeated rows count and are scored each.  Other columns are not read.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bandwise.llm.common import non_empty, partitions
from bandwise.llm.text import LOWER, NOT_BLANK, Block, Hasher, blocks, mix, words
from bandwise.session import write_through

END, START = np.uint64(0x0DDC0FFEE0DDF00D), np.uint64(0x5EED5EED5EED5EED)
ADDED = 0.1
#: Weight of the unigram distribution, in observations of a context.
MASS = 100.0
HEAVY_SHARE = 65_536
CHUNK_BYTES = 4_000_000
#: Entries of a shard whose trie is built at a time: a shard is worked on in ranges of its words.
RANGE_ENTRIES = 250_000
CHUNK_DOCS = 60_000
_CONTEXT_BITS = 40


class EliasFano:
    """Sorted non-negative integers: low bytes as they are, high bits as a bitmap in unary."""

    def __init__(self, values: np.ndarray):
        values = values.astype(np.uint64)
        spread = (int(values[-1]) + 1) // len(values) if len(values) else 1
        self.bytes = min(7, -(-max(spread.bit_length() - 1, 0) // 8))
        self.n = len(values)
        self.low = values.view(np.uint8).reshape(-1, 8)[:, : self.bytes].copy()
        high = (values >> np.uint64(8 * self.bytes)).astype(np.int64)
        bits = np.zeros((int(high[-1]) if self.n else 0) + self.n + 1, np.uint8)
        bits[high + np.arange(self.n)] = 1
        self.high = np.packbits(bits)
        self.size = len(bits)

    def arrays(self) -> list[np.ndarray]:
        return [self.low, self.high]

    def mapped(self, low: np.ndarray, high: np.ndarray) -> EliasFano:
        self.low, self.high = low, high
        bits = np.unpackbits(high, count=self.size)
        gaps = np.flatnonzero(bits == 0)
        #: number of values below each high part
        self.below = np.concatenate([[0], gaps - np.arange(len(gaps))])
        return self

    def _low(self, at: np.ndarray) -> np.ndarray:
        found = np.zeros(len(at), np.uint64)
        for k in range(self.bytes):
            found |= self.low[at, k].astype(np.uint64) << np.uint64(8 * k)
        return found

    def values(self, at: np.ndarray) -> np.ndarray:
        high = np.searchsorted(self.below, at, "right") - 1
        return (high.astype(np.uint64) << np.uint64(8 * self.bytes)) | self._low(at)

    def find(self, x: np.ndarray, least: np.ndarray | None = None, most: np.ndarray | None = None) -> np.ndarray:
        """Place of each x, -1 if it isn't there; by successor search among places least to most (excluded)."""
        if not self.n:
            return np.full(len(x), -1)
        x = x.astype(np.uint64)
        high = (x >> np.uint64(8 * self.bytes)).astype(np.int64)
        inside = high < len(self.below) - 1
        high = np.where(inside, high, 0)
        a, b = self.below[high], self.below[high + 1]
        if least is not None:
            a, b = np.maximum(a, least), np.minimum(b, most)
        last, low = b.copy(), x & np.uint64((1 << (8 * self.bytes)) - 1)
        while len(todo := np.flatnonzero(a < b)):
            middle = (a[todo] + b[todo]) // 2
            small = self._low(middle) < low[todo]
            a[todo[small]] = middle[small] + 1
            b[todo[~small]] = middle[~small]
        at = np.minimum(a, self.n - 1)
        return np.where(inside & (a < last) & (self._low(at) == low), at, -1)


class Codes:
    """Numbers as 16-bit codes between their extremes."""

    def __init__(self, values: np.ndarray):
        self.least = float(values.min()) if len(values) else 0.0
        self.step = max((float(values.max()) - self.least) / 65535, 1e-12) if len(values) else 1.0
        self.codes = np.rint((values - self.least) / self.step).astype(np.uint16)

    def __call__(self, codes: np.ndarray) -> np.ndarray:
        return self.least + codes * self.step


class Trie:
    """Words, and below each its contexts with counts, in memory-mapped levels."""

    def __init__(self, word: np.ndarray, word_share: np.ndarray, node: np.ndarray, context: np.ndarray, count: np.ndarray, mass: float):
        """word: sorted hashes; word_share: m p(w); node, context: sorted pairs (index of the word, 40 bits); their counts."""
        prior = np.log10(mass * word_share) if len(word) else np.zeros(0)
        known = np.log10(count + mass * word_share[node]) if len(node) else np.zeros(0)
        levels = [
            EliasFano(word),
            EliasFano(np.searchsorted(node, np.arange(len(word) + 1))),
            EliasFano((node.astype(np.uint64) << np.uint64(_CONTEXT_BITS)) | context),
        ]
        self.prior, self.known = Codes(prior), Codes(known)
        parts = [a for level in levels for a in level.arrays()] + [self.prior.codes, self.known.codes]
        self.file = tempfile.TemporaryFile()  # has no name, and goes with the task
        places = []
        for part in parts:
            self.file.seek(-self.file.tell() % 8, 1)
            places.append(self.file.tell())
            self.file.write(part.tobytes())
        self.file.write(b"\0")
        self.file.flush()
        held = [
            np.memmap(self.file, part.dtype, "r", at, part.shape) if part.size else part for part, at in zip(parts, places, strict=True)
        ]
        self.words, self.pointers, self.contexts = (level.mapped(*held[2 * i : 2 * i + 2]) for i, level in enumerate(levels))
        self.prior.codes, self.known.codes = held[6:]

    def log_numerators(self, word: np.ndarray, context: np.ndarray) -> np.ndarray:
        """log10 (c(v w) + m p(w)) of pairs whose words are all in the trie."""
        node = self.words.find(word)
        least, most = self.pointers.values(node).astype(np.int64), self.pointers.values(node + 1).astype(np.int64)
        at = self.contexts.find((node.astype(np.uint64) << np.uint64(_CONTEXT_BITS)) | context, least, most)
        found = self.prior(self.prior.codes[node])
        seen = np.flatnonzero(at >= 0)
        found[seen] = self.known(self.known.codes[at[seen]])
        return found


def _tokens(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of a block, and where each document's begin."""
    data = LOWER[block.data]
    spans = words(block, NOT_BLANK)
    return Hasher(data).slices(spans.start, spans.end), spans.first


def _counted(batches: Iterator[pa.RecordBatch], shards: int) -> Iterator[pa.RecordBatch]:
    """Training texts to (shard, keys, counts): the distinct words of a task."""
    keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    held: list[np.ndarray] = []

    def fold() -> None:
        nonlocal keys, counts, held
        new, times = np.unique(np.concatenate([np.zeros(0, np.uint64), *held]), return_counts=True)
        joined, inverse = np.unique(np.concatenate([keys, new]), return_inverse=True)
        counts = np.rint(np.bincount(inverse, np.concatenate([counts, times]), len(joined))).astype(np.int64)
        keys, held = joined, []

    def flush() -> Iterator[pa.RecordBatch]:
        shard = keys % np.uint64(shards)
        order = np.argsort(shard, kind="stable")
        border = np.searchsorted(shard[order], np.arange(shards + 1))
        for s in range(shards):
            mine = order[border[s] : border[s + 1]]
            if len(mine):
                columns = [pa.array([s], pa.int64()), pa.array([keys[mine].tobytes()], pa.binary()), pa.array([counts[mine].tobytes()], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["shard", "keys", "counts"])

    for batch in non_empty(batches):
        for block in blocks(batch.column(0)):
            found, _ = _tokens(block)
            held += [found, np.full(len(block), END)]
            if sum(map(len, held)) > 1_000_000:
                fold()
            if len(keys) > 1_000_000:
                yield from flush()
                keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    fold()
    yield from flush()


def _merged(group: pa.Table) -> pa.Table:
    keys = np.concatenate([np.frombuffer(k, np.uint64) for k in group.column("keys").to_pylist()])
    times = np.concatenate([np.frombuffer(c, np.int64) for c in group.column("counts").to_pylist()])
    joined, inverse = np.unique(keys, return_inverse=True)
    counts = np.rint(np.bincount(inverse, times, len(joined))).astype(np.int64)
    return pa.table(
        {"shard": group.column("shard")[:1], "types": [len(joined)], "tokens": [int(counts.sum())], "keys": pa.array([joined.tobytes()], pa.binary()), "counts": pa.array([counts.tobytes()], pa.binary())}
    )


def _above(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    for batch in non_empty(batches):
        for k, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            keys, counts = np.frombuffer(k, np.int64), np.frombuffer(c, np.int64)
            # the end token always goes along: it opens and closes every text, however few and long they are
            chosen = np.flatnonzero((counts >= least) | (keys.view(np.uint64) == END))
            yield pa.RecordBatch.from_arrays([pa.array(keys[chosen]), pa.array(counts[chosen])], names=["key", "count"])


_PACKED = ("words", "n_contexts", "contexts", "n_docs", "docs", "times", "u_words", "u_n", "u_docs", "u_times", "train")
_SUMS = ("base", "known", "score")
ENTRY = "shard long, chunk long, " + ", ".join(f"{n} binary" for n in (*_PACKED, *_SUMS, "keys", "counts")) + ", ids array<long>, held array<boolean>, n_tokens array<long>"


def _rows(rows: list[dict]) -> pa.RecordBatch:
    kinds = {"shard": pa.int64(), "chunk": pa.int64(), "ids": pa.list_(pa.int64()), "held": pa.list_(pa.bool_()), "n_tokens": pa.list_(pa.int64())}
    names = [c.split()[0] for c in ENTRY.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], kinds.get(n, pa.binary())) for n in names], names=names)


def _runs(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places where a new value begins, and the lengths of the runs."""
    if not len(sorted_values):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.flatnonzero(np.concatenate([[True], sorted_values[1:] != sorted_values[:-1]]))
    return at, np.diff(np.append(at, len(sorted_values)))


def _packed(found: list[tuple[np.ndarray, np.ndarray]], train: np.ndarray, shards: int, heavy: tuple[np.ndarray, np.ndarray], start: int) -> tuple[list[dict], dict]:
    """One chunk's entries by shard, and what it can add up itself: sums of heavy words' unigram terms."""
    n_words = np.concatenate([np.diff(first) for _, first in found])
    docs = len(n_words)
    ends = np.cumsum(n_words + 1) - 1
    word = np.full(int(n_words.sum()) + docs, END)
    own = np.ones(len(word), bool)
    own[ends] = False
    word[own] = np.concatenate([h for h, _ in found])
    context = np.concatenate([[START], word[:-1]])
    context[np.concatenate([[0], ends[:-1] + 1])] = START
    doc = np.repeat(np.arange(docs, dtype=np.uint64), n_words + 1)
    vocabulary, number = np.unique(np.append(word, START), return_inverse=True)
    at_start, number = number[-1], number[:-1].astype(np.uint64)
    before = np.concatenate([[at_start], number[:-1]]).astype(np.uint64)
    before[np.concatenate([[0], ends[:-1] + 1])] = at_start
    heavy_keys, heavy_counts = heavy
    place = np.minimum(np.searchsorted(heavy_keys, vocabulary), max(len(heavy_keys) - 1, 0))
    is_heavy = heavy_keys[place] == vocabulary if len(heavy_keys) else np.zeros(len(vocabulary), bool)
    count = np.where(is_heavy, heavy_counts[place], 0) if len(heavy_keys) else np.zeros(len(vocabulary), np.int64)
    count[at_start] = start

    size = np.uint64(len(vocabulary))
    keys = np.sort(((number * size + before) << np.uint64(16)) | doc)
    at, times = _runs(keys)
    entry = keys[at]
    pair_at, n_docs = _runs(entry >> np.uint64(16))
    pair = entry[pair_at] >> np.uint64(16)
    w, v = (pair // size).astype(np.int64), (pair % size).astype(np.int64)
    key = np.where(is_heavy[w], mix(vocabulary[w] ^ (vocabulary[v] * np.uint64(3))), vocabulary[w])
    shard = (key % np.uint64(shards)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    entry_shard = np.repeat(shard, n_docs)
    entry_order = np.argsort(entry_shard, kind="stable")
    docs_sorted, times_sorted = (entry & np.uint64(0xFFFF)).astype(np.uint16)[entry_order], times.astype(np.uint32)[entry_order]
    w, v, n_docs, shard = w[order], v[order], n_docs[order], shard[order]
    pairs, entries = np.searchsorted(shard, np.arange(shards + 1)), np.searchsorted(entry_shard[entry_order], np.arange(shards + 1))

    rare = own & ~is_heavy[number.astype(np.int64)]
    u_keys = np.sort((number[rare] << np.uint64(16)) | doc[rare])
    u_at, u_times = _runs(u_keys)
    u_entry = u_keys[u_at]
    u_shard = (vocabulary[(u_entry >> np.uint64(16)).astype(np.int64)] % np.uint64(shards)).astype(np.int64)
    u_order = np.argsort(u_shard, kind="stable")
    u_entry, u_times = u_entry[u_order], u_times[u_order]
    uni = np.searchsorted(u_shard[u_order], np.arange(shards + 1))

    rows = []
    for s in range(shards):
        a, b, c, d, e, f = *pairs[s : s + 2], *entries[s : s + 2], *uni[s : s + 2]
        word_at, n_contexts = _runs(w[a:b])
        u_word = (u_entry[e:f] >> np.uint64(16)).astype(np.int64)
        u_at, u_n = _runs(u_word)
        packed = {
            "words": vocabulary[w[a:b][word_at]],
            "n_contexts": n_contexts.astype(np.uint32),
            "contexts": (vocabulary[v[a:b]] >> np.uint64(64 - _CONTEXT_BITS)).view(np.uint8).reshape(-1, 8)[:, :5],
            "n_docs": n_docs[a:b].astype(np.uint32), "docs": docs_sorted[c:d], "times": times_sorted[c:d],
            "u_words": vocabulary[u_word[u_at]], "u_n": u_n.astype(np.uint32),
            "u_docs": (u_entry[e:f] & np.uint64(0xFFFF)).astype(np.uint16), "u_times": u_times[e:f].astype(np.uint32),
            "train": np.packbits(train),
        }
        rows.append({"shard": s} | {k: np.ascontiguousarray(x).tobytes() for k, x in packed.items()})
    terms = is_heavy[number.astype(np.int64)]
    which, c = doc[terms].astype(np.int64), count[number[terms].astype(np.int64)].astype(np.float64)
    contexts = terms & own
    sums = {
        "base": np.bincount(which, np.log10(c + ADDED), docs),
        "known": np.bincount(which, c > 0, docs),
        "score": -np.bincount(doc[contexts].astype(np.int64), np.log10(count[number[contexts].astype(np.int64)] + MASS), docs) - np.log10(start + MASS),
    }
    # without training documents there is no count of the end token
    if END not in heavy_keys:
        sums["base"] = sums["base"] + np.log10(ADDED)
    return rows, sums


def _entries(batches: Iterator[pa.RecordBatch], shards: int, heavy, start: int) -> Iterator[pa.RecordBatch]:
    """(id, text, held) to rows of ENTRY: packed entries by shard, and one row with the documents of each chunk."""
    chunk = TaskContext.get().partitionId() << 32
    found, ids, held, size = [], [], [], 0

    def flush() -> pa.RecordBatch:
        rows, sums = _packed(found, ~np.array(held, bool), shards, heavy.value, start)
        n_tokens = np.concatenate([np.diff(first) for _, first in found]) + 1
        rows.append({"shard": chunk % shards, "ids": ids, "held": held, "n_tokens": n_tokens.tolist()} | {k: sums[k].astype(np.float64).tobytes() for k in _SUMS})
        return _rows([r | {"chunk": chunk} for r in rows])

    for batch in non_empty(batches):
        for part in blocks(batch.column(1)):
            for at in range(0, len(part), CHUNK_DOCS):
                to = min(len(part), at + CHUNK_DOCS)
                piece = part if to - at == len(part) else Block(part.data[part.offsets[at] : part.offsets[to]], part.offsets[at : to + 1] - part.offsets[at], part.first + at)
                if found and (size + len(piece.data) > CHUNK_BYTES or len(ids) + len(piece) > CHUNK_DOCS):
                    yield flush()
                    chunk += 1
                    found, ids, held, size = [], [], [], 0
                found.append(_tokens(piece))
                ids += batch.column(0).slice(piece.first, len(piece)).to_pylist()
                held += batch.column(2).slice(piece.first, len(piece)).to_pylist()
                size += len(piece.data)
    if found:
        yield flush()


def _add_range(pieces: list[tuple], train: np.ndarray, score: np.ndarray, share) -> None:
    """Builds the trie of one range of words from all chunks' entries, and adds their numerators to the documents' scores.

    A piece is what one chunk has in the range: words, n_contexts, contexts, n_docs, documents (numbered in the shard), times.
    Pairs are looked up once for all chunks, so the work follows the entries and not the number of chunks.
    """
    mask = np.uint64((1 << _CONTEXT_BITS) - 1)
    word, n_contexts, contexts, n_docs, doc, times = (np.concatenate(column) for column in zip(*pieces, strict=True))
    vocabulary, node = np.unique(word, return_inverse=True)
    wide = np.zeros((len(n_docs), 8), np.uint8)
    wide[:, :5] = contexts.reshape(-1, 5)
    pairs = (np.repeat(node, n_contexts).astype(np.uint64) << np.uint64(_CONTEXT_BITS)) | wide.view(np.uint64).ravel()
    distinct, inverse = np.unique(pairs, return_inverse=True)
    pair = np.repeat(inverse, n_docs)
    learned = np.bincount(pair, times * train[doc], len(distinct))
    used = learned > 0
    known, nodes = distinct[used], (distinct >> np.uint64(_CONTEXT_BITS)).astype(np.int64)
    trie = Trie(vocabulary, share(vocabulary), nodes[used], known & mask, learned[used], MASS)
    numerators = trie.log_numerators(vocabulary[nodes], distinct & mask)
    np.add.at(score, doc, times * numerators[pair])


def _answer(group: pa.Table, total: float, heavy) -> pa.Table:
    """One shard: builds its trie from the training entries and answers every chunk with sums per document."""
    rows = group.to_pylist()
    heavy_keys, heavy_counts = heavy.value
    tables = [r for r in rows if r["keys"] is not None]
    keys = np.concatenate([np.frombuffer(r["keys"], np.uint64) for r in tables]) if tables else np.zeros(0, np.uint64)
    own = np.concatenate([np.frombuffer(r["counts"], np.int64) for r in tables]) if tables else np.zeros(0, np.int64)

    def counts(word: np.ndarray) -> np.ndarray:
        found = np.zeros(len(word))
        for known, number in ((keys, own), (heavy_keys, heavy_counts)):
            if len(known):
                at = np.minimum(np.searchsorted(known, word), len(known) - 1)
                found = np.where(known[at] == word, number[at], found)
        return found

    chunks = [r for r in rows if r["words"] is not None]
    out = [
        {"chunk": r["chunk"], "ids": r["ids"], "held": r["held"], "n_tokens": r["n_tokens"]} | {k: r[k] for k in _SUMS}
        for r in rows if r["ids"] is not None
    ]
    view = lambda r, n, kind: np.frombuffer(r[n], kind)
    trains = [np.unpackbits(view(r, "train", np.uint8)).astype(bool) for r in chunks]
    #: where each chunk's documents begin among the shard's
    first = np.concatenate([[0], np.cumsum([len(t) for t in trains], dtype=np.int64)])
    train = np.concatenate([np.zeros(0, bool), *trains])
    score = np.zeros(len(train))
    ranges = max(1, -(-sum(len(r["docs"]) // 2 for r in chunks) // RANGE_ENTRIES))
    borders = np.array([k * (1 << 64) // ranges for k in range(1, ranges)], np.uint64)
    parts: list[list[tuple]] = [[] for _ in range(ranges)]
    for r, at, to in zip(chunks, first, first[1:], strict=False):
        u_doc, u_times = view(r, "u_docs", np.uint16).astype(np.int64), view(r, "u_times", np.uint32)
        c = np.repeat(counts(view(r, "u_words", np.uint64)), view(r, "u_n", np.uint32))
        docs = to - at
        score[at:to] -= np.bincount(u_doc, u_times * np.log10(c + MASS), docs)
        base, known = np.bincount(u_doc, u_times * np.log10(c + ADDED), docs), np.bincount(u_doc, u_times * (c > 0), docs)
        out.append({"chunk": r["chunk"], "base": base, "known": known})
        word, n_contexts, n_docs = view(r, "words", np.uint64), view(r, "n_contexts", np.uint32), view(r, "n_docs", np.uint32)
        cuts = np.concatenate([[0], np.searchsorted(word, borders), [len(word)]])
        context_at = np.concatenate([[0], np.cumsum(n_contexts, dtype=np.int64)])[cuts]
        entry_at = np.concatenate([[0], np.cumsum(n_docs, dtype=np.int64)])[context_at]
        held = (word, n_contexts, view(r, "contexts", np.uint8), n_docs, view(r, "docs", np.uint16), view(r, "times", np.uint32), at)
        for k in np.flatnonzero(np.diff(cuts)):
            parts[k].append((held, *cuts[k : k + 2].tolist(), *context_at[k : k + 2].tolist(), *entry_at[k : k + 2].tolist()))
    for part in filter(None, parts):
        pieces = [
            (word[a:b], n_contexts[a:b], contexts[5 * c : 5 * d], n_docs[c:d], docs[e:f] + at, times[e:f])
            for (word, n_contexts, contexts, n_docs, docs, times, at), a, b, c, d, e, f in part
        ]
        _add_range(pieces, train, score, lambda w: (counts(w) + ADDED) / total)
    for row, r, at, to in zip(out[len(out) - len(chunks) :], chunks, first, first[1:], strict=False):
        # documents that have none of the shard's words need no answer: with many shards, that is most of them
        met = np.zeros(to - at, bool)
        met[view(r, "u_docs", np.uint16)] = True
        met[view(r, "docs", np.uint16)] = True
        places = np.flatnonzero(met)
        row |= {"docs": places.astype(np.uint16).tobytes(), "base": row["base"][places].astype(np.float64).tobytes()}
        row |= {"known": row["known"][places].astype(np.float32).tobytes(), "score": score[at:to][places].astype(np.float32).tobytes()}
    return pa.Table.from_batches([_rows(out)]).select(["chunk", "docs", *_SUMS, "ids", "held", "n_tokens"])


def _added(group: pa.Table, tokens: int, types: int) -> pa.Table:
    """All answers for one chunk to one row per document."""
    rows = group.to_pylist()
    head = next(r for r in rows if r["ids"] is not None)
    docs = len(head["ids"])
    sums = {k: np.zeros(docs) for k in _SUMS}
    for r in rows:
        places = slice(None) if r is head else np.frombuffer(r["docs"], np.uint16)
        for k in _SUMS:
            sums[k][places] += np.frombuffer(r[k], np.float64 if k == "base" or r is head else np.float32)
    n_tokens = np.array(head["n_tokens"], np.int64)
    return pa.table(
        {
            "id": pa.array(head["ids"], pa.int64()), "held_out": pa.array(head["held"], pa.bool_()), "n_tokens": n_tokens,
            "n_known": np.rint(sums["known"]).astype(np.int64), "train_tokens": np.full(docs, tokens, np.int64),
            "base_score": sums["base"] - n_tokens * np.log10(tokens + ADDED * (types + 1)), "score": sums["score"],
        }
    )


def score(docs: DataFrame, held_out: Column, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of docs: id, held_out, n_tokens, n_known, train_tokens, base_score, score; learns from the others."""
    spark = docs.sparkSession
    shards = partitions(spark)
    held = F.coalesce(held_out, F.lit(False))
    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text"), held.alias("held"))
    counted = rows.where("not held").select("text").mapInArrow(lambda b: _counted(b, shards), "shard long, keys binary, counts binary")
    merged = counted.groupBy("shard").applyInArrow(_merged, "shard long, types long, tokens long, keys binary, counts binary")
    merged = write_through(merged, "trie-counts")
    tokens, types = (x or 0 for x in merged.agg(F.sum("tokens"), F.sum("types")).first())
    least = max(1.0, tokens / HEAVY_SHARE)
    # counts that reach this share of all tokens: at most HEAVY_SHARE words and the end token
    frequent = merged.select("keys", "counts").mapInArrow(lambda b: _above(b, least), "key long, count long").toArrow()
    heavy_keys, heavy_counts = frequent.column("key").to_numpy().view(np.uint64), frequent.column("count").to_numpy()
    order = np.argsort(heavy_keys)
    heavy = spark.sparkContext.broadcast((heavy_keys[order], heavy_counts[order]))
    start = int(heavy_counts[heavy_keys == END].sum())
    entries = rows.mapInArrow(lambda b: _entries(b, shards, heavy, start), ENTRY)
    known = merged.select("shard", *(F.lit(None).cast(t).alias(n) for n, t in (c.split() for c in ENTRY.split(", ")) if n not in ("shard", "keys", "counts")), "keys", "counts")
    total = tokens + ADDED * (types + 1)
    answers = entries.unionByName(known).groupBy("shard").applyInArrow(
        lambda t: _answer(t, total, heavy),
        "chunk long, docs binary, base binary, known binary, score binary, ids array<long>, held array<boolean>, n_tokens array<long>",
    )
    found = answers.groupBy("chunk").applyInArrow(
        lambda t: _added(t, tokens, types),
        "id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double",
    )
    return found.withColumnRenamed("id", id_column)
