"""SentencePiece encoding and decoding as a weighted finite-state transducer.

Compiled from a model's vocabulary, whose path is a parameter:
- normaliser: the identity with a blank put in front of a text that is not empty, and U+2581 standing for a blank;
- pieces: a deterministic trie over bytes that emits a piece where one ends;
- byte fallback: a character without a piece of its own emits its bytes.
Composed with an input this is a lattice of arcs (begin, end, piece).  The path of least total weight in the tropical
semiring (min, +) is the encoding:
- merge models (BPE): an arc weighs 1, and infinity after a piece it can't follow.  Merges by rank are local: a sequence of
  pieces is the model's encoding if and only if every two neighbours are the encoding of their own concatenation.  So the state of the
  composed machine is the last piece, and one path of finite weight reaches each position;
- unigram models: an arc weighs the negative score of its piece.

Arcs of all distinct words of a block are followed together, one position at a time.  A word is a run of blanks with what
follows it, or a line feed; no piece has a blank after another character or a line feed, which `compile_model` verifies.
Encodings of words and facts about neighbours are kept by the worker up to fixed sizes.

Null and empty texts have no tokens.  Decoding gives the normalised text, so a text comes back as it was, with U+2581 as a blank.
Whole texts of any length are encoded; repeated rows each; other columns are passed on by `encode`, clashing ones replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bandwise.llm.common import fresh, non_empty, replaced
from bandwise.llm.text import Block, Hasher, blocks

BLANK = "▁"
_UNKNOWN, _NONE, _BEGIN = -2, -1, (1 << 20) - 1
#: Words whose encodings a worker keeps, and pairs of pieces.
KEPT_WORDS, KEPT_PAIRS = 800_000, 2_000_000
BLOCK_BYTES = 2_000_000


def default_model() -> str:
    """The public vocabulary that is installed beside the tokenizer libraries."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Transducer:
    def __init__(self, pieces: list[str], scores: list[float], usable: list[bool], byte_ids: list[int], *, merges: bool = True):
        self.merges, self.byte_ids = merges, np.array(byte_ids, np.int64)
        self.score = {p.replace(BLANK, " "): s for p, s, u in zip(pieces, scores, usable, strict=True) if u}
        self.names = [p.replace(BLANK, " ") for p in pieces]
        if any("\n" in p or " " in p.lstrip(" ") for p in self.score):
            raise ValueError("pieces that reach across words are not supported")
        self.weight = np.where(usable, 1.0 if merges else -np.array(scores), np.inf)
        self.unknown_weight = 1.0 if merges else 10.0 - min(scores)
        nodes: dict[tuple[int, int], int] = {}
        emitted = {}
        for i, (piece, u) in enumerate(zip(self.names, usable, strict=True)):
            if u:
                node = 0
                for byte in piece.encode():
                    node = nodes.setdefault((node, byte), len(nodes) + 1)
                emitted[node] = i
        arcs = sorted((a * 256 + b, to) for (a, b), to in nodes.items())
        self.arcs, self.to = np.array([a for a, _ in arcs], np.int64), np.array([t for _, t in arcs], np.int64)
        self.emits = np.full(len(nodes) + 1, _NONE, np.int64)
        for node, i in emitted.items():
            self.emits[node] = i
        # decoding: bytes of every id
        raw = [n.encode() if u else b"" for n, u in zip(self.names, usable, strict=True)]
        for value, i in enumerate(byte_ids):
            raw[i] = bytes([value])
        self.spelled = np.frombuffer(b"".join(raw), np.uint8)
        self.spell_at = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
        self.forget()

    def forget(self) -> None:
        # pairs of pieces: an open-addressing table
        self.pair_keys, self.pair_fits, self.n_pairs = np.full(1 << 16, -1), np.zeros(1 << 16, bool), 0
        self.word_keys, self.word_at, self.word_n = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.int32)

    def _follows(self, a: str, b: str) -> bool:
        """Whether merging the characters of a + b by rank ends with a and b."""
        parts = list(a + b)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = self.score.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if at < 0:
                return parts == ([a, b] if a else [b])
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def fits(self, before: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """Whether each piece can follow the one before (_BEGIN: nothing)."""
        keys = (before << 20) | piece
        at, known = self._pair_places(keys)
        if not known.all():
            new = np.unique(keys[~known])
            if 2 * (self.n_pairs + len(new)) > len(self.pair_keys):
                old = np.flatnonzero(self.pair_keys >= 0) if self.n_pairs < KEPT_PAIRS else np.zeros(0, np.int64)
                held, answers = self.pair_keys[old], self.pair_fits[old]
                size = max(len(self.pair_keys), 1 << (4 * (len(old) + len(new))).bit_length())
                self.pair_keys, self.pair_fits, self.n_pairs = np.full(size, -1), np.zeros(size, bool), 0
                self._add_pairs(held, answers)
                at, known = self._pair_places(keys)
                new = np.unique(keys[~known])
            answers = [self._follows("" if k >> 20 == _BEGIN else self.names[k >> 20], self.names[k & 0xFFFFF]) for k in new.tolist()]
            self._add_pairs(new, np.array(answers, bool))
            at, _ = self._pair_places(keys)
        return self.pair_fits[at]

    def _pair_places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Slots of keys by linear probing, and whether they are there."""
        mask = len(self.pair_keys) - 1
        at = (keys * 0x9E3779B97F4A7C1 >> 20) & mask
        held = self.pair_keys[at]
        todo = np.flatnonzero((held != keys) & (held >= 0))
        while len(todo):
            at[todo] = (at[todo] + 1) & mask
            held[todo] = self.pair_keys[at[todo]]
            todo = todo[(held[todo] != keys[todo]) & (held[todo] >= 0)]
        return at, held == keys

    def _add_pairs(self, keys: np.ndarray, answers: np.ndarray) -> None:
        self.n_pairs += len(keys)
        while len(keys):
            at, _ = self._pair_places(keys)
            at, one = np.unique(at, return_index=True)
            self.pair_keys[at], self.pair_fits[at] = keys[one], answers[one]
            rest = np.ones(len(keys), bool)
            rest[one] = False
            keys, answers = keys[rest], answers[rest]

    def _lattice(self, data: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Arcs of the composition: begin, end, piece (or _UNKNOWN).  `stop`: end of the word each byte is in."""
        begin = np.flatnonzero((data & 0xC0) != 0x80)
        at, node, length = begin, np.zeros(len(begin), np.int64), 0
        found = []
        while len(at):
            inside = at + length < stop[at]
            at, node = at[inside], node[inside]
            keys = node * 256 + data[at + length]
            place = np.minimum(np.searchsorted(self.arcs, keys), len(self.arcs) - 1)
            some = self.arcs[place] == keys
            at, node, length = at[some], self.to[place[some]], length + 1
            ends = self.emits[node] >= 0
            found.append((at[ends], at[ends] + length, self.emits[node[ends]]))
        char_end = np.append(begin[1:], len(data))
        single = np.zeros(len(data) + 1, bool)
        for a, b, _ in found:
            single[a[b == char_end[np.searchsorted(begin, a)]]] = True
        lone = ~single[begin]
        found.append((begin[lone], char_end[lone], np.full(int(lone.sum()), _UNKNOWN)))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def shortest(self, data: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words (word i is data[first[i]:first[i + 1]], not empty), and how many each has."""
        words = len(first) - 1
        word = np.repeat(np.arange(words), np.diff(first))
        begin, end, piece = self._lattice(data, first[1:][word])
        number = word[begin]
        # word i's positions take the slots first[i] + i to first[i + 1] + i
        source, target, position = begin + number, end + number, end - first[number]
        order = np.lexsort((target, position))
        source, target, piece, position = source[order], target[order], piece[order], position[order]
        slots = len(data) + words
        distance, last, back = np.full(slots, np.inf), np.full(slots, _NONE), np.zeros(slots, np.int64)
        origin = first[:-1] + np.arange(words)
        distance[origin], last[origin] = 0, _BEGIN
        borders = np.append(np.flatnonzero(np.diff(position, prepend=-1)), len(position))
        for a, b in zip(borders[:-1], borders[1:], strict=True):
            s, t, p = source[a:b], target[a:b], piece[a:b]
            cost = distance[s] + np.where(p >= 0, self.weight[p], self.unknown_weight)
            if self.merges:
                ask = np.flatnonzero(np.isfinite(cost) & (p >= 0))
                before = np.where(last[s[ask]] == _UNKNOWN, _BEGIN, last[s[ask]])
                cost[ask[~self.fits(before, p[ask])]] = np.inf
            best = np.lexsort((cost, t))
            best = best[np.flatnonzero(np.diff(t[best], prepend=-1))]
            distance[t[best]], last[t[best]], back[t[best]] = cost[best], np.where(np.isfinite(cost[best]), p[best], _NONE), s[best]
        on_path = np.zeros(slots, bool)
        now, goal = first[1:] + np.arange(words), origin
        if not np.isfinite(distance[now]).all():
            raise ValueError("a word has no path")
        while len(now):
            on_path[now] = True
            now = back[now]
            more = now != goal
            now, goal = now[more], goal[more]
        slot = np.flatnonzero(on_path)
        found = last[slot]
        of = np.searchsorted(origin, slot, "right") - 1
        unknown = found == _UNKNOWN
        many = np.where(unknown, slot - back[slot], 1)
        ids = np.repeat(found, many)
        spread = np.repeat(unknown, many)
        offset = np.arange(len(ids)) - np.repeat(np.cumsum(many) - many, many)
        byte = np.repeat(back[slot] - of, many) + offset
        ids[spread] = self.byte_ids[data[byte[spread]]]
        return ids.astype(np.int32), np.bincount(np.repeat(of, many), minlength=words)

    def encode_block(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """Ids of normalised texts, and where each document's begin."""
        data, n = block.data, len(block.data)
        if not n:
            return np.zeros(0, np.int32), np.zeros(len(block) + 1, np.int64)
        blank, feed = data == 0x20, data == 0x0A
        starts = blank.copy()
        starts[1:] &= ~blank[:-1]
        starts[1:] |= feed[1:] | feed[:-1]
        starts[block.offsets[:-1][block.lengths > 0]] = True
        begin = np.flatnonzero(starts)
        end = np.append(begin[1:], n)
        keys = Hasher(data).slices(begin, end)
        unique, one, which = np.unique(keys, return_index=True, return_inverse=True)
        if len(self.word_keys) > KEPT_WORDS:
            self.word_keys, self.word_at, self.word_n, self.pool = self.word_keys[:0], self.word_at[:0], self.word_n[:0], self.pool[:0]
        new = np.ones(len(unique), bool)
        if len(self.word_keys):
            at = np.minimum(np.searchsorted(self.word_keys, unique), len(self.word_keys) - 1)
            new = self.word_keys[at] != unique
        if new.any():
            a, b = begin[one[new]], end[one[new]]
            first = np.concatenate([[0], np.cumsum(b - a)])
            gathered = data[np.repeat(a - first[:-1], b - a) + np.arange(first[-1])]
            ids, many = self.shortest(gathered, first)
            joined = np.concatenate([self.word_keys, unique[new]])
            order = np.argsort(joined, kind="stable")
            self.word_at = np.concatenate([self.word_at, len(self.pool) + np.cumsum(many) - many])[order]
            self.word_n, self.word_keys = np.concatenate([self.word_n, many])[order], joined[order]
            self.pool = np.concatenate([self.pool, ids])
        at = np.searchsorted(self.word_keys, unique)[which]
        many = self.word_n[at]
        total = np.concatenate([[0], np.cumsum(many)])
        ids = self.pool[np.repeat(self.word_at[at] - total[:-1], many) + np.arange(total[-1])]
        return ids, total[np.searchsorted(begin, block.offsets)]

    def decode_ids(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes that ids stand for, the blank in front included, and where each id's begin."""
        size = np.diff(self.spell_at)[ids]
        first = np.concatenate([[0], np.cumsum(size)])
        return self.spelled[np.repeat(self.spell_at[ids] - first[:-1], size) + np.arange(first[-1])], first


@cache
def compile_model(path: str, merges: bool = True) -> Transducer:
    """Reads a vocabulary; the library serves as a reader of the model file only."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    many = range(model.get_piece_size())
    pieces = [model.id_to_piece(i) for i in many]
    usable = [not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)) for i in many]
    byte_ids = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
    return Transducer(pieces, [model.get_score(i) for i in many], usable, byte_ids, merges=merges)


def normalised(column: pa.Array) -> pa.Array:
    text = pc.replace_substring(pc.fill_null(column.cast(pa.large_string()), ""), BLANK, " ")
    front = pc.if_else(pc.equal(pc.binary_length(text), 0), pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string()))
    return pc.binary_join_element_wise(front, text, pa.scalar("", pa.large_string()))


def encode(docs: DataFrame, *, text_column: str = "text", model: str | None = None, merges: bool = True) -> DataFrame:
    """docs without the text, with ids, n_tokens, n_fallback (ids that are bytes), round_trip (decoding gives the text).

    Columns of these names are replaced.  Null and empty texts have no ids; an empty table gives an empty one.
    """
    path = model or default_model()
    (text,) = fresh(docs, "__text")
    rows = docs.withColumn(text, F.col(text_column).cast("string")).drop(text_column, "ids", "n_tokens", "n_fallback", "round_trip")
    rest = [f for f in rows.schema.fields if f.name != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = compile_model(path, merges)
        is_byte = np.zeros(len(machine.spell_at) - 1, bool)
        is_byte[machine.byte_ids] = True
        for batch in non_empty(batches):
            column = normalised(batch.column(batch.schema.names.index(text)))
            for block in blocks(column, BLOCK_BYTES):
                ids, first = machine.encode_block(block)
                spelled, at = machine.decode_ids(ids)
                border = at[first]
                same = np.diff(border) == block.lengths
                if same.all():
                    wrong = np.flatnonzero(spelled != block.data)
                    same[np.searchsorted(block.offsets, wrong, "right") - 1] = False
                else:
                    same = np.array([spelled[border[i] : border[i + 1]].tobytes() == block.bytes(i) for i in range(len(block))])
                out = batch.slice(block.first, len(block)).select([f.name for f in rest])
                yield replaced(
                    out, ids=pa.ListArray.from_arrays(first.astype(np.int32), pa.array(ids, pa.int32())), n_tokens=pa.array(np.diff(first), pa.int64()),
                    n_fallback=pa.array(np.diff(np.concatenate([[0], np.cumsum(is_byte[ids])])[first]), pa.int64()), round_trip=pa.array(same, pa.bool_()),
                )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest)
    return rows.mapInArrow(run, f"{schema}, ids array<int>, n_tokens long, n_fallback long, round_trip boolean")


def decode(tokens: DataFrame, *, ids_column: str = "ids", output: str = "text", model: str | None = None) -> DataFrame:
    """tokens with the text that the ids stand for (null ids: null); bytes that are no UTF-8 become U+FFFD."""
    path = model or default_model()
    rows = tokens.drop(output) if output != ids_column else tokens
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = compile_model(path)
        for batch in non_empty(batches):
            texts = []
            for ids in batch.column(batch.schema.names.index(ids_column)).to_pylist():
                spelled = None if ids is None else machine.decode_ids(np.array(ids, np.int64))[0].tobytes().decode(errors="replace")
                texts.append(spelled[1:] if spelled and spelled[0] == " " else spelled)
            yield replaced(batch, **{output: pa.array(texts, pa.string())})

    return rows.mapInArrow(run, f"{schema}, `{output}` string")
