"""Token ids in seekable files: independent zstandard frames, a document index and a trailing seek table.

A file is: frames, each the little-endian ids (2 or 4 bytes) of whole documents (a very long document is
cut over several) with zstandard's own content checksum; a skippable frame with the index (id and number of
ids of each document, in order); a skippable frame with the seek table of the public seekable format: sizes
and XXH64 checksum of each frame, number of frames, flags, magic. Readers open the end of the file, then
only the frames they need.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from array import array
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import xxhash
import zstandard
from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarmac.llm.bpe import cut, slices
from tarmac.llm.common import query, table
from tarmac.session import shared_dir, stage

# Fixed values of the zstandard and seekable formats.
SKIPPABLE_INDEX, SKIPPABLE_TABLE, SEEK_MAGIC, WITH_CHECKSUMS = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1, 0x80

FRAME_IDS = 1 << 16


class Writer:
    """Documents, in the order of the file, into an open binary stream."""

    def __init__(self, out, width: int, frame_ids: int = FRAME_IDS) -> None:
        self.out, self.kind, self.frame_ids = out, f"<u{width}", frame_ids
        self.zstd = zstandard.ZstdCompressor(level=3, write_checksum=True)
        self.frames: list[tuple[int, int, int]] = []
        self.ids, self.counts, self.held, self.size = [], [], [], 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.ids.append(_NO_ID if doc_id is None else doc_id)
        self.counts.append(len(ids))
        for a in range(0, len(ids), 16 * self.frame_ids):
            part = ids[a : a + 16 * self.frame_ids]
            self.held.append(part)
            self.size += len(part)
            if self.size >= self.frame_ids:
                self._flush()

    def _flush(self) -> None:
        if self.size:
            data = np.concatenate(self.held).astype(self.kind).tobytes()
            self._frame(self.zstd.compress(data), data)
            self.held, self.size = [], 0

    def _frame(self, packed: bytes, data: bytes) -> None:
        self.out.write(packed)
        self.frames.append((len(packed), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))

    def close(self) -> None:
        self._flush()
        index = struct.pack("<BQ", int(self.kind[-1]), len(self.ids)) + self.zstd.compress(
            np.array(self.ids, "<i8").tobytes() + np.array(self.counts, "<u8").tobytes())
        self._frame(struct.pack("<II", SKIPPABLE_INDEX, len(index)) + index, b"")
        table = b"".join(struct.pack("<III", *f) for f in self.frames)
        self.out.write(struct.pack("<II", SKIPPABLE_TABLE, len(table) + 9) + table + struct.pack("<IBI", len(self.frames), WITH_CHECKSUMS, SEEK_MAGIC))


class Reader:
    """Reads the end of a file first; `opened` counts the frames decompressed."""

    def __init__(self, source) -> None:
        self.source, self.opened = source, 0
        size = source.size()
        n, flags, magic = struct.unpack("<IBI", self._read(size - 9, 9))
        if magic != SEEK_MAGIC or flags != WITH_CHECKSUMS:
            raise ValueError("not a seekable file with checksums")
        entries = np.frombuffer(self._read(size - 9 - 12 * n, 12 * n), "<u4").reshape(n, 3).astype(np.int64)
        self.packed, self.plain, self.sums = entries.T
        self.at = np.cumsum(self.packed) - self.packed
        index = self._read(self.at[-1] + 8, self.packed[-1] - 8)
        width, docs = struct.unpack("<BQ", index[:9])
        self.kind, self.width = f"<u{width}", width
        both = zstandard.ZstdDecompressor().decompress(index[9:], max_output_size=16 * docs) if docs else b""
        self.doc_ids, self.counts = np.frombuffer(both[: 8 * docs], "<i8"), np.frombuffer(both[8 * docs :], "<u8").astype(np.int64)
        self.starts = np.cumsum(self.counts) - self.counts
        self.first = (np.cumsum(self.plain) - self.plain) // width  # ids before each frame
        self._kept: tuple[int, np.ndarray] | None = None

    def _read(self, at: int, n: int) -> bytes:
        self.source.seek(int(at))
        return self.source.read(int(n))

    def frame(self, k: int) -> np.ndarray:
        if self._kept is None or self._kept[0] != k:
            data = zstandard.ZstdDecompressor().decompress(self._read(self.at[k], self.packed[k]))
            if xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != self.sums[k]:
                raise ValueError(f"frame {k} is damaged")
            self.opened += 1
            self._kept = k, np.frombuffer(data, self.kind)
        return self._kept[1]

    def document(self, d: int) -> np.ndarray:
        """The ids of the document at place d of the file."""
        a, n, out = int(self.starts[d]), int(self.counts[d]), []
        k = bisect_right(self.first, a, 0, len(self.first) - 1) - 1
        while n:
            part = self.frame(k)[a - int(self.first[k]) :][:n]
            out.append(part)
            a, n, k = a + len(part), n - len(part), k + 1
        return np.concatenate(out).astype(np.uint32) if out else np.zeros(0, np.uint32)

    def find(self, doc_id: int) -> Iterator[np.ndarray]:
        for d in np.flatnonzero(self.doc_ids == doc_id).tolist():
            yield self.document(d)


_NO_ID = -(2**63)


def _byte_chars() -> str:
    """The character for each byte: itself if it prints, else the next ones from U+0100 on, as byte-level BPE has it."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in shown]
    return "".join(chr(b) if b in shown else chr(256 + rest.index(b)) for b in range(256))


BYTE_CHARS = _byte_chars()


class Tokens:
    """Ids by a tokenizers file. Slices of the text are what its model sees: each distinct one is encoded once.

    With `added`, the file's added tokens are found in texts as the library does by default; else they are text.
    """

    def __init__(self, path: str, keep: int = 1_000_000, added: bool = False) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tool = Tokenizer.from_file(path)
        self.tool.encode_special_tokens = not added
        self.keep, self.known = keep, {}
        self.width = 2 if self.tool.get_vocab_size() <= 1 << 16 else 4
        known = self.tool.get_added_tokens_decoder() if added else {}
        plain = not any(t.single_word or t.lstrip or t.rstrip for t in known.values())
        self.added = {t.content: np.array([i], np.uint32) for i, t in known.items()}
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")").split if self.added else None
        self.sliced = plain and self.tool.normalizer is None and "ByteLevel(add_prefix_space=False" in str(self.tool.pre_tokenizer)

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tool.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def _learn(self, new: list[bytes]) -> None:
        """The library's model merges each slice, given as the characters that stand for its bytes."""
        merge = self.tool.model.tokenize
        for p in new:
            self.known[p] = array("I", [t.id for t in merge(p.decode("latin-1").translate(BYTE_CHARS))]).tobytes()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if not self.sliced:
            return [self._ids(t) for t in texts]
        if self.split and any(a in t for a in self.added for t in texts):
            own = [self.split(t) for t in texts]
            found = iter(self._encode([x for parts in own for x in parts[::2]]))
            return [np.concatenate([self.added[x] if k % 2 else next(found) for k, x in enumerate(parts)]) for parts in own]
        return self._encode(texts)

    def encode_long(self, text: str) -> np.ndarray:
        """A long text piece by piece, cut outside of added tokens; whole if the library is to encode it."""
        if not self.sliced:
            return self._ids(text)
        parts = self.split(text) if self.split else [text]
        return np.concatenate([x for k, t in enumerate(parts) for x in ([self.added[t]] if k % 2 else self._encode_cut(t))])

    def _encode_cut(self, text: str) -> Iterator[np.ndarray]:
        for piece in cut(text):
            yield from self._encode([piece])

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.known) > self.keep:
            self.known.clear()
        own = list(slices(texts))
        self._learn([p for p in set().union(*own) if p not in self.known])
        return [np.frombuffer(b"".join(map(self.known.__getitem__, s)), np.uint32) for s in own]


_tokens: dict[str, Tokens] = {}


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", frame_ids: int = FRAME_IDS) -> DataFrame:
    """Encode whole texts and write them in ascending id order; the list of files, one row each.

    Files are `part`s of one range of ids: file, docs, ids (how many), start (ids in all files before it).
    Null and empty texts have the end id only; null ids come first; rows with equal ids are ordered by a hash of
    the text; other columns are left out; an empty table gives no file. A task that is run again
    writes under another name, and only the files of the list count.
    """
    spark = docs.sparkSession
    spark.sparkContext.addFile(tokenizer)
    name = os.path.basename(tokenizer)

    def run(batches):
        if name not in _tokens:
            _tokens[name] = Tokens(SparkFiles.get(name), added=True)
        tool, task = _tokens[name], TaskContext.get()
        file = f"part-{task.partitionId():06d}-{task.taskAttemptId()}.zst"
        out = writer = None
        for b in batches:
            for ids, texts in _groups(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if writer is None:
                    fs, path = pyarrow.fs.FileSystem.from_uri(f"{folder}/{file}")
                    out = fs.open_output_stream(path, compression=None)
                    writer = Writer(out, tool.width, frame_ids)
                long = len(texts[0]) > _LONG
                found = [tool.encode_long(texts[0])] if long else tool.encode(texts)
                for i, x in zip(ids, found, strict=True):
                    writer.add(i, np.append(x, np.uint32(end_id)))
        if writer is not None:
            writer.close()
            out.close()
            yield pa.RecordBatch.from_pydict({"part": [task.partitionId()], "file": [file], "docs": [len(writer.ids)], "ids": [sum(writer.counts)]},
                                             pa.schema([("part", pa.int32()), ("file", pa.string()), ("docs", pa.int64()), ("ids", pa.int64())]))

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("i"), text.alias("t"), F.xxhash64(text).alias("h"))
    rows = rows.repartitionByRange("i", "h").sortWithinPartitions("i", "h").select("i", "t")
    parts = stage(rows.mapInArrow(run, "part int, file string, docs long, ids long"))
    start, listed = 0, []
    for r in parts.orderBy("part").collect():  # a row for each file
        listed.append((r.file, r.docs, r.ids, start))
        start += r.ids
    return spark.createDataFrame(listed, "file string, docs long, ids long, start long")


_LONG = 1 << 20


def _groups(ids: list, texts: list[str]) -> Iterator[tuple[list, list[str]]]:
    """Runs of rows of at most _LONG characters; a longer text stands alone."""
    a = size = 0
    for k, t in enumerate(texts):
        if k > a and size + len(t) > _LONG:
            yield ids[a:k], texts[a:k]
            a, size = k, 0
        size += len(t)
    if texts:
        yield ids[a:], texts[a:]


def read(files: DataFrame, folder: str, only: Iterable[int] | None = None, digest: bool = False) -> DataFrame:
    """Documents of the listed files: doc_id, start (ids before it), n_tokens, and their ids, or with `digest`
    the crc32 of them as 32-bit integers. With `only`, just the frames that hold these documents are opened."""
    wanted = None if only is None else sorted(set(only))
    kind = pa.int64() if digest else pa.list_(pa.int64())
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32" if digest else "ids", kind)])

    def run(batches):
        for b in batches:
            for file, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                fs, path = pyarrow.fs.FileSystem.from_uri(f"{folder}/{file}")
                with fs.open_input_file(path) as source:
                    r = Reader(source)
                    places = range(len(r.counts)) if wanted is None else np.flatnonzero(np.isin(r.doc_ids, wanted)).tolist()
                    out = []
                    for d in places:
                        ids = r.document(d)
                        own = int(r.doc_ids[d])
                        out.append((None if own == _NO_ID else own, start + int(r.starts[d]), len(ids), zlib.crc32(ids.astype("<u4").tobytes()) if digest else ids))
                        if len(out) == 512:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)
                            out = []
                    if out:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)

    ddl = f"doc_id long, start long, n_tokens long, {'ids_crc32 long' if digest else 'ids array<bigint>'}"
    n = max(1, files.count())
    return files.select("file", "start").repartition(n, "file").mapInArrow(run, ddl)


def new_folder(spark: SparkSession) -> str:
    """A new folder in the place that driver and executors share."""
    folder = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    fs, path = pyarrow.fs.FileSystem.from_uri(folder)
    fs.create_dir(path)
    return folder


def gpt_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query("op6_token_files")
def op6(spark, sf_dir):
    folder = new_folder(spark)
    files = write(table(spark, sf_dir, "documents"), folder, gpt_path(), end_id=2)
    return read(files, folder, digest=True)
