"""Secret scan: strings that a dictionary-primed zstandard compressor cannot shorten, next to sensitive words.

1.  `identifiers` counts the words of all documents in Spark (per task first, then by word) and keeps the most frequent
    ones: a bounded dictionary of what names and prose of this corpus look like.  Words with digits, `+` or `/` are never in it.
2.  A candidate is a maximal run of `[A-Za-z0-9+/_.-]` of at least `MIN_BYTES`
    bytes, with a sensitive word up to `REACH` bytes before it or half as many behind it.
3.  Its novelty is what it adds to the compressed size of the code around it: the size of context and candidate less
    the size of the context alone, both compressed with the dictionary, by byte of the candidate.  Other copies of the
    candidate in the context are taken out first, so a secret that is written twice does not explain itself.
4.  Candidates that add as much as random digits would (`least_added`) are reported as kind `novel`, beside the pattern matches of the kinds
    `assign`, `access` and `hex`, which always stay.  A secret may so be reported by a pattern and by its novelty.

Places are code points, ends excluded; a pattern match is reported from the first to the last character of the whole
match.  Null texts count as empty, and empty texts have no spans.  Every row gives one row, repeated rows and null ids
too.  Texts are read whole: a candidate of any length is compressed whole, only its surroundings are a window.  An empty
table gives an empty result; other columns of the table are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bandwise.llm.common import non_empty
from bandwise.llm.text import Hasher, blocks, byte_class, words

#: Shortest candidate, bytes of code on each side that it is compressed with, and how near a sensitive word must be.
MIN_BYTES, CONTEXT, REACH = 16, 256, 64
#: Compressed bytes that a reported candidate adds at least: a share of its bytes, and a further one of its first 64.
#: Random hexadecimal digits add 0.75 a byte when there are 40 of them and 0.5 in the long run, names less than 0.7.
THRESHOLD, SHORT = 0.48, 0.22
#: Words of the learned dictionary: 4 to 24 bytes each, so at most 50 kB.
DICTIONARY_WORDS = 2000
#: Words that a task counts before it passes the counts on.
HELD_WORDS = 300_000

# fixed values: the kinds and their patterns (letters of `assign` in either case), and the least length of a match
KINDS = ("assign", "access", "hex", "novel")
_ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([a-z0-9+/_.=-]+)""")
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_HEX = re.compile(rb"[0-9a-f]+")
LEAST = {"assign": 8, "access": 16, "hex": 32}

_SENSITIVE = re.compile(
    rb"passw|passphrase|pwd|secret|token|api[_ -]?key|access[_ -]?key|private[_ -]?key|credential|authori|authenti|bearer|"
    rb"signature|session|cookie|login|encrypt|webhook|connection ?string"
)
#: Names that code uses around secrets; the dictionary ends with them, as later bytes are cheapest to refer to.
CODE_NAMES = (
    "import return function class const static public private string config settings options default value "
    "environment variable process client server service request response header content database connection username "
    "account endpoint url https http localhost www example com org net version production development process.env os.environ "
    "/usr/local/lib /usr/bin /home/ /var/lib /etc/ site-packages node_modules src/main/java .json .yaml .properties "
    "Authorization Bearer access_key secret_key api_key client_id client_secret private_key public_key access_token "
    "refresh_token session_id password passwd credential signature encryption "
)

_RUN = byte_class((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x2B, 0x2B), (0x2D, 0x2F), (0x5F, 0x5F), high=False)
# names are runs of the first class without a byte of the second: pieces of a secret between its digits are no names
_NAME = byte_class((0x2B, 0x2B), (0x2D, 0x2D), (0x2F, 0x39), (0x41, 0x5A), (0x5F, 0x5F), (0x61, 0x7A))
_NO_NAME = byte_class((0x2B, 0x2B), (0x2F, 0x39), high=False)

SPANS = "array<struct<kind:string,start:bigint,end:bigint,value:string,added:bigint,novelty:double>>"


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts to (word, n), added up over the task as long as the words fit."""
    held: dict[bytes, int] = {}

    def flush() -> pa.RecordBatch:
        found = pa.RecordBatch.from_arrays(
            [pa.array([k.decode("utf-8", "replace") for k in held], pa.string()), pa.array(list(held.values()), pa.int64())],
            names=["word", "n"],
        )
        held.clear()
        return found

    for batch in non_empty(batches):
        for block in blocks(batch.column(0)):
            spans = words(block, _NAME)
            foreign = np.concatenate(([0], np.cumsum(_NO_NAME[block.data])))
            size = spans.end - spans.start
            fits = (size >= 4) & (size <= 24) & (foreign[spans.end] == foreign[spans.start])
            start, end = spans.start[fits], spans.end[fits]
            _, first, n = np.unique(Hasher(block.data).slices(start, end), return_index=True, return_counts=True)
            for s, e, k in zip(start[first].tolist(), end[first].tolist(), n.tolist()):
                word = block.data[s:e].tobytes()
                held[word] = held.get(word, 0) + k
            if len(held) > HELD_WORDS:
                yield flush()
    if held:
        yield flush()


def identifiers(docs: DataFrame, *, text_column: str = "text", size: int = DICTIONARY_WORDS) -> bytes:
    """The most frequent words of all documents, rarest first, as one string of at most 25 bytes a word."""
    counted = docs.select(F.col(text_column).cast("string").alias("text")).mapInArrow(_count, "word string, n long")
    top = counted.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(size)
    return " ".join(r.word for r in reversed(top.collect())).encode()


class Novelty:
    """Marginal compressed size of strings, primed with a dictionary."""

    def __init__(self, dictionary: bytes):
        primed = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        primed.precompute_compress(level=9)
        self._compress = zstandard.ZstdCompressor(dict_data=primed, write_content_size=False, write_checksum=False).compress

    def added(self, before: bytes, candidate: bytes, after: bytes) -> int:
        """Bytes that the candidate adds to the compressed code around it."""
        before, after = before.replace(candidate, b""), after.replace(candidate, b"")
        return max(0, len(self._compress(before + candidate + after)) - len(self._compress(before + after)))


def least_added(size: int) -> float:
    """Bytes that an incompressible string of this size adds at least."""
    return THRESHOLD * size + SHORT * min(size, 64)


def _places(data: bytes, offsets: np.ndarray) -> np.ndarray:
    """Byte offsets as code points: bytes before them that do not continue a character."""
    begins = (np.frombuffer(data, np.uint8) & 0xC0) != 0x80
    return np.concatenate(([0], np.cumsum(begins)))[offsets]


def _spans(data: bytes, runs: list[tuple[int, int]], novelty: Novelty) -> list[tuple]:
    """Spans of one text: (start, number of the kind, end, bytes added), by start and kind; `runs` are its long runs."""
    found = []
    lower = data.lower()
    for m in _ASSIGN.finditer(lower):
        if m.end(2) - m.start(2) >= LEAST["assign"]:
            found.append((m.start(), 0, m.end(), None))
    if b"AKIA" in data:
        found += [(m.start(), 1, m.end(), None) for m in _ACCESS.finditer(data) if m.end() - m.start() >= LEAST["access"]]
    for start, end in runs:
        if end - start >= LEAST["hex"]:
            for m in _HEX.finditer(data, start, end):
                if m.end() - m.start() >= LEAST["hex"]:
                    found.append((m.start(), 2, m.end(), None))
    for start, end in runs:
        near = _SENSITIVE.search(lower, max(0, start - REACH), start) or _SENSITIVE.search(lower, end, end + REACH // 2)
        if near:
            added = novelty.added(data[max(0, start - CONTEXT) : start], data[start:end], data[end : end + CONTEXT])
            if added >= least_added(end - start):
                found.append((start, 3, end, added))
    return sorted(found, key=lambda x: x[:3])


def scan(docs: DataFrame, dictionary: bytes, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: its id and `spans`, a list of (kind, start, end, value, added, novelty) by start and kind.

    `dictionary` is that of `identifiers`, or any other sample of names; `added` and `novelty` are null for patterns.
    """
    primer = dictionary + b" " + CODE_NAMES.encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty(primer)
        for batch in non_empty(batches):
            offsets, kinds, starts, ends, values, sizes, shares = [0], [], [], [], [], [], []
            for block in blocks(batch.column(1)):
                spans = words(block, _RUN)
                long = np.flatnonzero(spans.end - spans.start >= MIN_BYTES)
                first = np.searchsorted(long, spans.first)
                for i in range(len(block)):
                    data = block.bytes(i)
                    at = int(block.offsets[i])
                    inside = long[first[i] : first[i + 1]]
                    runs = list(zip((spans.start[inside] - at).tolist(), (spans.end[inside] - at).tolist()))
                    found = _spans(data, runs, novelty)
                    if found:
                        starts += _places(data, np.array([x[0] for x in found])).tolist()
                        ends += _places(data, np.array([x[2] for x in found])).tolist()
                        for start, kind, end, added in found:
                            kinds.append(KINDS[kind])
                            values.append(data[start:end].decode())
                            sizes.append(added)
                            shares.append(None if added is None else added / (end - start))
                    offsets.append(len(kinds))
            struct = pa.StructArray.from_arrays(
                [pa.array(kinds, pa.string()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64()),
                 pa.array(values, pa.string()), pa.array(sizes, pa.int64()), pa.array(shares, pa.float64())],
                names=["kind", "start", "end", "value", "added", "novelty"],
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), struct)], names=["id", "spans"]
            )

    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    found = rows.mapInArrow(run, f"id {kind}, spans {SPANS}")
    return found.select(F.col("id").alias(id_column), "spans")


def listed(spans: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def report(found: DataFrame) -> DataFrame:
    """Counts and digests of the spans that `scan` found."""
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        *(c for c in found.columns if c != "spans"),
        *(of(k).alias(f"n_{k}") for k in KINDS),
        F.sha2(listed(F.filter("spans", lambda s: s["kind"] != "novel")), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["novelty"])), F.lit(0.0)).alias("max_novelty"),
    )
