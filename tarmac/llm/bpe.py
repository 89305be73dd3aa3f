"""Byte-level BPE without a regex: arrays of codepoint classes, scanned by an associative product of
transition functions, give the slices that cached pair merging turns into ids."""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StringType, StructField, StructType

from tarmac.llm.common import annotate, query, table

_QUEUED = 512  # bytes of a slice from which merges are queued

#: The code points with Unicode's White_Space property.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: What may follow an apostrophe in a contraction.
SUFFIXES = ("s", "t", "re", "ve", "m", "ll", "d")

OTHER, LETTER, NUMBER, BLANK, SPACE, END = range(6)

# The states before a character: in a run of OTHER, after a SPACE (which joins what follows), anything else.
# Each character is a function on them. The functions that occur are closed under composition:
ELSE, RUN, JOIN, QUOTE, SAME = range(5)  # constant ELSE, RUN, JOIN; QUOTE: JOIN becomes RUN, others stay; identity
_OF_CLASS = np.array([RUN, ELSE, ELSE, ELSE, JOIN, ELSE], np.uint8)


def _products() -> np.ndarray:
    """PRODUCT[8 * f + g]: f, then g."""
    out = np.zeros(64, np.uint8)
    for f in range(5):
        for g in range(5):
            if g in (ELSE, RUN, JOIN):
                out[8 * f + g] = g
            elif g == SAME:
                out[8 * f + g] = f
            else:
                out[8 * f + g] = {JOIN: RUN, SAME: QUOTE}.get(f, f)
    return out


PRODUCT = _products()
_tables: dict[str, np.ndarray] = {}


def class_table() -> np.ndarray:
    """The class of every code point."""
    if "classes" not in _tables:
        kinds = {"L": LETTER, "N": NUMBER}
        t = np.array([kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)], np.uint8)
        t[WHITE_SPACE] = BLANK
        t[0x20] = SPACE
        _tables["classes"] = t
    return _tables["classes"]


def scan(f: np.ndarray, width: int = 64) -> np.ndarray:
    """The product of all functions up to each place, block-wise: inside blocks, over the blocks, both together."""
    n = len(f)
    if n and int(f.max()) < QUOTE:  # constants only: each place is its own product
        return f.copy()
    if n <= width:
        out = f.copy()
        for i in range(1, n):
            out[i] = PRODUCT[8 * int(out[i - 1]) + int(f[i])]
        return out
    rows = -(-n // width)
    grid = np.full(rows * width, SAME, np.uint8)
    grid[:n] = f
    grid = np.ascontiguousarray(grid.reshape(rows, width).T)
    for i in range(1, width):
        grid[i] = PRODUCT[(grid[i - 1] << 3) + grid[i]]
    before = np.concatenate([np.array([SAME], np.uint8), scan(grid[-1], width)[:-1]])
    return PRODUCT[(before << 3)[None, :] + grid].T.reshape(-1)[:n]


def token_starts(cp: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Whether each code point starts a slice. `ends` are the places of separators between texts (slices of their own)."""
    n = len(cp)
    cls = class_table()[cp]
    cls[ends] = END
    tail = np.zeros(n, np.uint8)  # length of the contraction's letters, were this apostrophe to start one
    quotes = np.flatnonzero(cp == ord("'"))
    for s in SUFFIXES:
        ok = np.ones(len(quotes), bool)
        for k, c in enumerate(s, 1):
            ok &= cp[np.minimum(quotes + k, n - 1)] == ord(c)  # texts end with a separator, so none is mistaken
        tail[quotes[ok]] = len(s)
    f = _OF_CLASS[cls]
    f[tail > 0] = QUOTE
    state = scan(f)
    before = np.concatenate([np.array([SAME], np.uint8), state[:-1]])
    short = (tail > 0) & ((before == ELSE) | (before == SAME) | (before == QUOTE))  # from the start, QUOTE keeps ELSE
    prev = np.concatenate([np.array([END], np.uint8), cls[:-1]])
    following = np.concatenate([cls[1:], np.array([END], np.uint8)])
    blank, was = (cls == BLANK) | (cls == SPACE), (prev == BLANK) | (prev == SPACE)
    last = blank & ~((following == BLANK) | (following == SPACE) | (following == END))  # given back to what follows
    start = np.where(blank, ~was | last, (cls != prev) & (prev != SPACE)) | (cls == END) | (prev == END)
    at = np.flatnonzero(short)
    start[at] = True
    start[at + 1] = False
    two = at[tail[at] == 2]
    start[two + 2] = False
    done = at + 1 + tail[at]
    done = done[done < n]
    start[done[cls[done] != OTHER]] = True  # whatever follows the contraction starts anew
    return start


def slices(texts: list[str]) -> Iterator[list[bytes]]:
    """The slices of each text, in order."""
    joined = "\0".join(texts) + "\0"
    cp = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1) - 1
    start = token_starts(cp, ends)
    more = (cp >= 0x80).view(np.uint8) + (cp >= 0x800) + (cp >= 0x10000)  # bytes past the first
    places = np.flatnonzero(start)
    at = places + (np.cumsum(more, dtype=np.int64) - more)[places]
    data = np.frombuffer(joined.encode(), np.uint8)
    mark = np.zeros(len(data), np.int32)
    mark[at] = 1
    spaced = np.full(len(data) + len(at), 0xFF, np.uint8)  # a byte UTF-8 never has, before each slice
    spaced[np.cumsum(mark, dtype=np.int32) + np.arange(len(data), dtype=np.int32)] = data
    pieces = spaced.tobytes().split(b"\xff")[1:]
    a = 0
    for m in np.searchsorted(places, ends).tolist():
        yield pieces[a:m]
        a = m + 1


class Encoder:
    """Ids of texts by ranks (bytes to id); slices already merged are kept, up to `keep` of them."""

    def __init__(self, ranks: dict[bytes, int], keep: int = 500_000) -> None:
        self.ranks, self.keep = ranks, keep
        self.bytes_of = dict((i, b) for b, i in ranks.items())
        self.pairs = {}
        for whole, i in ranks.items():
            for k in range(1, len(whole)):
                a, b = ranks.get(whole[:k]), ranks.get(whole[k:])
                if a is not None and b is not None:
                    self.pairs[a << 32 | b] = i
        self.known = _Known(self)
        top = max(ranks.values()) + 1
        self.lengths = np.array([len(self.bytes_of.get(i, b"")) for i in range(top)], np.int64)
        self.places = np.cumsum(self.lengths) - self.lengths
        self.flat = np.frombuffer(b"".join(self.bytes_of.get(i, b"") for i in range(top)), np.uint8)

    def merge(self, piece: bytes) -> list[int]:
        """The leftmost pair of lowest rank is merged until no pair has one."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        get, none = self.pairs.get, 1 << 40
        ids = [self.ranks[piece[i : i + 1]] for i in range(len(piece))]
        if len(ids) > _QUEUED:
            return self._merge_long(ids)
        near = [get(a << 32 | b, none) for a, b in zip(ids, ids[1:])]
        while near and (low := min(near)) < none:
            i = near.index(low)
            ids[i : i + 2] = [low]
            del near[i]
            if i:
                near[i - 1] = get(ids[i - 1] << 32 | low, none)
            if i < len(near):
                near[i] = get(low << 32 | ids[i + 1], none)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same for a long piece: pairs wait in a queue by rank and place, ids are linked to their neighbours."""
        get, n = self.pairs.get, len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank = [get(a << 32 | b, -1) for a, b in zip(ids, ids[1:])] + [-1]  # of the pair that begins at each place, -1: none
        queue = [(r, i) for i, r in enumerate(rank) if r >= 0]
        heapq.heapify(queue)
        while queue:
            r, i = heapq.heappop(queue)
            if rank[i] != r:
                continue  # one of the pair has been merged since
            gone = after[i]
            ids[i], after[i], rank[gone] = r, after[gone], -1
            if after[i] < n:
                before[after[i]] = i
            for at in (before[i], i):
                if at >= 0:
                    right = after[at]
                    rank[at] = get(ids[at] << 32 | ids[right], -1) if right < n else -1
                    if rank[at] >= 0:
                        heapq.heappush(queue, (rank[at], at))
        out, i = [], 0
        while i < n:
            out.append(ids[i])
            i = after[i]
        return out

    def encode(self, texts: Iterable[str]) -> Iterator[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        group: list[str] = []
        size = 0
        for t in texts:
            if len(t) > _LONG:
                yield from self._encode(group)
                yield b"".join(self._encode(list(cut(t))))
                group, size = [], 0
                continue
            group.append(t)
            size += len(t)
            if size > _LONG:
                yield from self._encode(group)
                group, size = [], 0
        yield from self._encode(group)

    def _encode(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > self.keep:
            self.known.clear()
        return [b"".join(map(self.known.__getitem__, s)) for s in slices(texts)] if texts else []

    def decode(self, ids: bytes) -> bytes:
        """The bytes of packed ids: a gather from one flat table by offsets."""
        x = np.frombuffer(ids, "<u4").astype(np.int64)
        out = []
        for a in range(0, len(x), 1 << 18):
            part = x[a : a + (1 << 18)]
            n = self.lengths[part]
            end = np.cumsum(n)
            out.append(self.flat[np.repeat(self.places[part] - (end - n), n) + np.arange(end[-1])].tobytes())
        return b"".join(out)

    def offsets(self, ids: bytes) -> np.ndarray:
        """Where each id's bytes start in the text."""
        n = self.lengths[np.frombuffer(ids, "<u4")]
        return np.cumsum(n) - n


class _Known(dict):
    def __init__(self, encoder: Encoder) -> None:
        super().__init__()
        self.encoder = encoder

    def __missing__(self, piece: bytes) -> bytes:
        self[piece] = out = np.array(self.encoder.merge(piece), "<u4").tobytes()
        return out


_LONG = 1 << 20
_SAFE = re.compile(r"(?<=\S) (?=\S)")  # a slice always starts at a space between two others


def cut(text: str) -> Iterator[str]:
    at = 0
    while len(text) - at > _LONG and (m := _SAFE.search(text, at + _LONG)):
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


_encoders: dict[str, Encoder] = {}


def load(lines: bytes) -> dict[bytes, int]:
    """Ranks of a rank file: a base64 token and its id on each line."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines.splitlines()) if a}


def shipped(spark, path: str):
    """A function that gives the encoder of the rank file at `path` (on the driver), on any executor."""
    spark.sparkContext.addFile(path)
    name = path.rsplit("/", 1)[-1]

    def encoder() -> Encoder:
        if name not in _encoders:
            with open(SparkFiles.get(name), "rb") as f:
                _encoders[name] = Encoder(load(f.read()))
        return _encoders[name]

    return encoder


def encode(docs: DataFrame, ranks: str, text_col: str = "text") -> DataFrame:
    """`docs` with _ids (array of int) and _offsets (of each id's bytes in the text).

    Null and empty texts have no ids; text that looks like a special token is ordinary text; whole texts are
    encoded; equal texts get equal ids. Other columns stay, but for any of these names, which are replaced.
    """
    encoder = shipped(docs.sparkSession, ranks)
    docs = docs.drop("_ids", "_offsets")
    at = docs.columns.index(text_col)
    schema = StructType([*docs.schema.fields, StructField("_ids", ArrayType(IntegerType(), False)), StructField("_offsets", ArrayType(IntegerType(), False))])

    def run(batches):
        e = encoder()
        for b in batches:
            packed = list(e.encode(t or "" for t in b.column(at).to_pylist()))
            ids = [np.frombuffer(p, "<u4").view(np.int32) for p in packed]
            places = [e.offsets(p).astype(np.int32) for p in packed]
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(x, pa.list_(pa.int32())) for x in (ids, places))], names=schema.names)

    return docs.mapInArrow(run, schema)


def decode(rows: DataFrame, ranks: str, ids_col: str = "_ids") -> DataFrame:
    """`rows` with _bytes, what their ids stand for (null ids: empty); a column of that name is replaced."""
    encoder = shipped(rows.sparkSession, ranks)
    rows = rows.drop("_bytes")
    at = rows.columns.index(ids_col)
    schema = StructType([*rows.schema.fields, StructField("_bytes", BinaryType())])

    def run(batches):
        e = encoder()
        for b in batches:
            out = [e.decode(np.array(x or [], "<u4").tobytes()) for x in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.binary())], names=schema.names)

    return rows.mapInArrow(run, schema)


def digests(docs: DataFrame, ranks: str, text_col: str = "text") -> DataFrame:
    """`docs` (text column left out) with _n, _ids_sha and _text_sha: what encoding, then decoding, gives.

    The ids and bytes themselves stay in the task, batch by batch.
    """
    encoder = shipped(docs.sparkSession, ranks)
    sha = lambda x: hashlib.sha256(x).hexdigest()

    def run(rows):
        e, out = encoder(), ([], [], [])
        for ids in e.encode(t.decode() for t in rows):
            out[0].append(len(ids) // 4)
            out[1].append(sha(ids))
            out[2].append(sha(e.decode(ids)))
        return list(out)

    return annotate(docs, text_col, "_n long, _ids_sha string, _text_sha string", run)


def multi_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def token_digests(docs: DataFrame, ranks: str) -> DataFrame:
    return digests(docs.select("doc_id", F.col("text").cast(StringType()).alias("text")), ranks).select(
        "doc_id", F.col("_n").alias("n_tokens"), F.col("_ids_sha").alias("ids_sha256"), F.col("_text_sha").alias("decoded_sha256")
    )


@query("op10_byte_bpe")
def op10(spark, sf_dir):
    return token_digests(table(spark, sf_dir, "documents"), multi_path())
