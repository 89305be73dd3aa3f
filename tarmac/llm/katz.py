"""Language-model scores by Katz backoff over bigrams, counted and looked up in packed hash buckets.

Texts become chunks: word hashes and local ids of some million tokens. A chunk asks for the counts of its
distinct words and bigrams, one packed row for each bucket of their hashes; a bucket adds up what the chunks
have counted in training texts, stores its part of the table and answers every chunk. So each distinct
n-gram of a chunk travels once, a frequent one no more than once a chunk, and no key is a hot key.
"""

from __future__ import annotations

import gc
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmac.llm.common import blocks, fold, query, table, texts
from tarmac.session import shared_dir, stage

CUTOFF = 5  # counts above it are not discounted
RESERVE = 0.01  # of a count, for every history: even one seen only with large counts leaves mass to back off to
END, START = xxhash.xxh64_intdigest(b" end"), xxhash.xxh64_intdigest(b" start")  # no word holds a space


# --- packed arrays -------------------------------------------------------------------------------------


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays in a zstandard frame, byte planes apart; sorted unsigned 64-bit arrays as differences."""
    head, planes = [], []
    for a in arrays:
        a = np.ascontiguousarray(a)
        rising = a.dtype == np.uint64 and len(a) > 1 and bool((a[1:] >= a[:-1]).all())
        if rising:
            a = np.r_[a[:1], np.diff(a)]
        head.append(f"{a.dtype.str}:{len(a)}:{int(rising)}")
        planes.append(a.view(np.uint8).reshape(-1, a.itemsize).T.tobytes())
    top = ",".join(head).encode()
    return zstandard.ZstdCompressor(level=1).compress(len(top).to_bytes(4, "little") + top + b"".join(planes))


def unpack(data: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n = int.from_bytes(raw[:4], "little")
    at, out = 4 + n, []
    for part in raw[4:at].decode().split(","):
        kind, size, rising = part.split(":")
        kind, size = np.dtype(kind), int(size)
        planes = np.frombuffer(raw, np.uint8, size * kind.itemsize, at).reshape(kind.itemsize, size)
        a = np.ascontiguousarray(planes.T).view(kind).ravel()
        out.append(np.cumsum(a, dtype=np.uint64) if rising == "1" else a)
        at += size * kind.itemsize
    return out


def pair_key(history: np.ndarray, word: np.ndarray) -> np.ndarray:
    x = (history ^ (history >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + word
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def small(a: np.ndarray) -> np.ndarray:
    """The same whole numbers in the narrowest unsigned type."""
    return a.astype(np.min_scalar_type(int(a.max()))) if len(a) else a.astype(np.uint8)


# --- discounts -----------------------------------------------------------------------------------------


class Level:
    """Good-Turing discounts of one order, from its numbers of n-grams seen once, twice, ... (of[r - 1])."""

    def __init__(self, of: list[int]) -> None:
        n = [0, *of]
        d = [0.0]
        tail = (CUTOFF + 1) * n[CUTOFF + 1] / n[1] if n[1] else 1.0
        for r in range(1, CUTOFF + 1):
            star = (r + 1) * n[r + 1] / n[r] / r if n[r] else 0.0
            d.append((star - tail) / (1 - tail) if tail < 1 else 0.0)
        good = all(0 < x < 1 for x in d[1:])
        self.d = np.array(d if good else [0.0, *((r - 0.5) / r for r in range(1, CUTOFF + 1))])
        self.left = sum(n[r] * r * (1 - self.d[r]) for r in range(1, CUTOFF + 1))  # what is taken from all counts

    def taken(self, c: np.ndarray) -> np.ndarray:
        """What the discount takes from counts c."""
        low = np.minimum(c, CUTOFF).astype(np.int64)
        return np.where((c > 0) & (c <= CUTOFF), c * (1 - self.d[low]), 0.0)


def unigram(c: np.ndarray, total: int, level: Level) -> np.ndarray:
    """p(word) of words seen c times; 0 is the one unknown word, which gets all that was taken."""
    return np.where(c > 0, c - level.taken(c), level.left + RESERVE) / (total + RESERVE)


# --- chunks --------------------------------------------------------------------------------------------


class _Ids(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = out = len(self)
        return out


def _chunks(docs: DataFrame, tokens: int) -> DataFrame:
    """(chunk, n, body) with the tokens of whole documents; columns of docs: _id, _train, _text."""

    def run(batches):
        seq = 0
        ids, lens, own, null, train, words, held = [], [], [], [], [], _Ids(), 0

        def out():
            hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in words), np.uint64, len(words))
            body = pack(np.concatenate(ids), np.array(lens, np.int64), np.array(own, np.int64), np.array(null, bool), np.array(train, bool), hashes)
            return pa.RecordBatch.from_pydict({"chunk": [(TaskContext.get().partitionId() << 20) + seq], "n": [held], "body": [body]},
                                              pa.schema([("chunk", pa.int64()), ("n", pa.int64()), ("body", pa.binary())]))

        for b in batches:
            for i, t, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), texts(b.column(2)), strict=True):
                n = 0
                for block in blocks(text):
                    w = block.lower().split()
                    ids.append(np.fromiter(map(words.__getitem__, w), np.uint32, len(w)) + np.uint32(1))  # 0 is the end
                    n += len(w)
                ids.append(np.zeros(1, np.uint32))
                lens.append(n + 1)
                own.append(i or 0)
                null.append(i is None)
                train.append(bool(t))
                held += n + 1
                if held >= tokens:
                    yield out()
                    seq += 1
                    ids, lens, own, null, train, words, held = [], [], [], [], [], _Ids(), 0
        if lens:
            yield out()

    return docs.select("_id", "_train", "_text").mapInArrow(run, "chunk long, n long, body binary")


class Chunk:
    """A chunk's tokens: word[i] is an index into the sorted words, before[i] that of the word before (or START)."""

    def __init__(self, body: bytes) -> None:
        ids, self.lens, self.ids, self.null, self.train, hashes = unpack(body)
        self.words, place = np.unique(np.r_[np.uint64(END), hashes], return_inverse=True)
        self.word = place[ids]
        last = np.cumsum(self.lens)
        self.doc = np.repeat(np.arange(len(self.lens)), self.lens)
        self.before = np.r_[-1, self.word[:-1]]
        self.before[np.r_[0, last[:-1]]] = len(self.words)  # START is one past the words
        self.learnt = self.train[self.doc]
        self.histories = np.r_[self.words, np.uint64(START)]

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(keys, history, word, of) of the distinct bigrams, sorted by key; of[i] is that of token i."""
        code, of = np.unique(self.before.astype(np.int64) * len(self.words) + self.word, return_inverse=True)
        h, w = code // len(self.words), code % len(self.words)
        key = pair_key(self.histories[h], self.words[w])
        order = np.argsort(key, kind="stable")
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        return key[order], h[order], w[order], rank[of]


def bucketed(keys: np.ndarray, bits: int) -> Iterator[tuple[int, slice]]:
    """The slices of sorted keys that share their leading bits."""
    bucket = (keys >> np.uint64(64 - bits)).astype(np.int64)
    cuts = np.r_[0, np.flatnonzero(np.diff(bucket)) + 1, len(keys)]
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        if a < b:
            yield int(bucket[a]), slice(a, b)


# --- counts: asked for by chunks, added up and answered by buckets -----------------------------------------

_ROW = pa.schema([("order", pa.int32()), ("bucket", pa.int32()), ("chunk", pa.int64()), ("payload", pa.binary())])
_DDL = "order int, bucket int, chunk long, payload binary"


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _ROW.types, strict=True)], schema=_ROW)


def _ask(bits: int):
    def run(batches):
        for b in batches:
            for chunk, body in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                c = Chunk(body.as_py())
                count = small(np.bincount(c.word, c.learnt, len(c.words)).astype(np.int64))
                yield _rows([(1, k, chunk, pack(c.words[s], count[s])) for k, s in bucketed(c.words, bits)])
                keys, _, _, of = c.pairs()
                count = small(np.bincount(of, c.learnt, len(keys)).astype(np.int64))
                yield _rows([(2, k, chunk, pack(keys[s], count[s])) for k, s in bucketed(keys, bits)])

    return run


def _groups(batches) -> Iterator[tuple[int, int, list[tuple[int, list[np.ndarray]]]]]:
    """(order, bucket, [(chunk, arrays)]) of rows sorted by these."""
    now, held = None, []
    for b in batches:
        for order, bucket, chunk, payload in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
            if now != (order, bucket):
                if held:
                    yield *now, held
                now, held = (order, bucket), []
            held.append((chunk, unpack(payload)))
    if held:
        yield *now, held


def _answer(batches):
    """Counts of each chunk's keys, negative for the one chunk that stands for the key; the table (chunk -1);
    numbers of keys seen 1, 2, ... times, their number and sum (chunk -2)."""
    for order, bucket, asked in _groups(batches):
        keys, at = np.unique(np.concatenate([a[0] for _, a in asked]), return_inverse=True)
        counts = np.concatenate([a[1].astype(np.int64) for _, a in asked])
        total = np.bincount(at, counts, len(keys)).astype(np.int64)
        owner = np.zeros(len(keys), bool)
        place = 0
        out = []
        for chunk, a in asked:
            own = at[place : place + len(a[0])]
            mine = (a[1] > 0) & ~owner[own]
            owner[own[mine]] = True
            out.append((order, bucket, chunk, pack(small(2 * total[own] + mine))))
            place += len(own)
        seen = total > 0
        out.append((order, bucket, -1, pack(keys[seen], small(total[seen]))))
        of = np.bincount(np.minimum(total, CUTOFF + 2), minlength=CUTOFF + 2)[1 : CUTOFF + 2]
        out.append((order, bucket, -2, pack(np.r_[of, seen.sum(), total.sum()].astype(np.int64))))
        for a in range(0, len(out), 16):
            yield _rows(out[a : a + 16])


# --- scores --------------------------------------------------------------------------------------------


def _evaluate(bits: int, starts: int, stats):
    """Per chunk, with its answers: what is known of each document's score, and questions about backoff weights."""
    (_, v1, n1, level1), (_, _, _, level2) = stats

    def run(batches):
        for b in batches:
            for chunk, body, answers in zip(b.column(0).to_pylist(), b.column(1), b.column(2), strict=True):
                yield from one(chunk, Chunk(body.as_py()), answers.as_py())

    def one(chunk, c, answers):
        got = {k: np.concatenate([unpack(a["payload"])[0].astype(np.int64) for a in sorted((a for a in answers if a["order"] == k), key=lambda a: a["bucket"])]) for k in (1, 2)}
        cw = got[1] >> 1
        ch = np.r_[cw, starts]  # counts of histories
        _, h, w, of = c.pairs()
        c2, mine = got[2] >> 1, (got[2] & 1) > 0
        p1 = unigram(cw, n1, level1)
        seen = c2 > 0
        with np.errstate(divide="ignore", invalid="ignore"):
            p2 = np.where(seen, (c2 - level2.taken(c2)) / (ch[h] + RESERVE), 1.0)
        # a token not seen after its history: the unigram, times the history's weight if that is in the table
        value = np.where(seen, np.log10(p2), np.log10(p1[w]))
        docs = len(c.lens)
        known = np.bincount(c.doc, value[of], docs)
        base = np.log10((cw + 0.5) / (n1 + 0.5 * (v1 + 1)))
        rid = (chunk << 24) + np.arange(docs)
        yield out(rid, c.ids, c.null, ~c.train, c.lens, np.bincount(c.doc, cw[c.word] > 0, docs).astype(np.int64), np.bincount(c.doc, base[c.word], docs), known)
        taken = np.bincount(h[mine], level2.taken(c2[mine]), len(c.histories))
        below = np.bincount(h[mine], p1[w[mine]], len(c.histories))
        back = np.flatnonzero(~seen[of] & (ch[c.before] > 0))
        event, times = np.unique(c.before[back].astype(np.int64) * docs + c.doc[back], return_counts=True)
        eh, ed = event // docs, event % docs
        need = np.unique(np.r_[np.flatnonzero(below > 0), eh])
        need = need[np.argsort(c.histories[need], kind="stable")]
        place = np.zeros(len(c.histories), np.int64)
        place[need] = np.arange(len(need))
        order = np.argsort(place[eh], kind="stable")
        eh, ed, times = place[eh][order], ed[order], times[order]
        keys = c.histories[need]
        rows = []
        for k, s in bucketed(keys, bits):
            i, j = np.searchsorted(eh, [s.start, s.stop])
            owned = np.flatnonzero(below[need[s]] > 0)
            rows.append((k, chunk, pack(keys[s], small(ch[need[s]]), owned.astype(np.uint32), taken[need[s]][owned], below[need[s]][owned], small(eh[i:j] - s.start), small(ed[i:j]), small(times[i:j]))))
        if rows:
            yield ask(rows)

    kinds = [("rid", pa.int64()), ("id", pa.int64()), ("null", pa.bool_()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("known", pa.float64()),
             ("bucket", pa.int32()), ("chunk", pa.int64()), ("payload", pa.binary())]
    schema = pa.schema(kinds)

    def out(*columns):
        n = len(columns[0])
        return pa.RecordBatch.from_arrays([*(pa.array(x, t) for x, (_, t) in zip(columns, kinds)), *(pa.nulls(n, t) for _, t in kinds[8:])], schema=schema)

    def ask(rows):
        return pa.RecordBatch.from_arrays([*(pa.nulls(len(rows), t) for _, t in kinds[:8]), *(pa.array(x, t) for x, (_, t) in zip(zip(*rows, strict=True), kinds[8:]))], schema=schema)

    return run


_SCORED = "rid long, id long, null boolean, held_out boolean, n_tokens long, n_known long, base double, known double, bucket int, chunk long, payload binary"


def _weigh(batches):
    """Backoff weights of a bucket's histories, from the shares of the chunks: (left mass) / (unseen mass below).
    Gives the sum of log10 weights for each document that backs off, and the table (rid null)."""
    schema = pa.schema([("rid", pa.int64()), ("more", pa.float64()), ("bucket", pa.int32()), ("payload", pa.binary())])

    def bucket_out(bucket, held):
        keys, at = np.unique(np.concatenate([a[0] for _, a in held]), return_inverse=True)
        taken, below, count, place = np.zeros(len(keys)), np.zeros(len(keys)), np.zeros(len(keys)), 0
        spans = []
        for _, a in held:
            own = at[place : place + len(a[0])]
            place += len(own)
            spans.append(own)
            count[own] = a[1]
            np.add.at(taken, own[a[2]], a[3])
            np.add.at(below, own[a[2]], a[4])
        weight = np.log10((taken + RESERVE) / (count + RESERVE)) - np.log10(np.maximum(1 - below, 1e-300))
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.float64()), pa.array([bucket], pa.int32()), pa.array([pack(keys, weight)], pa.binary())], schema=schema)
        for (chunk, a), own in zip(held, spans, strict=True):
            if len(a[6]):
                docs, i = np.unique(a[6], return_inverse=True)
                more = np.bincount(i, weight[own[a[5]]] * a[7], len(docs))
                yield pa.RecordBatch.from_arrays([pa.array((chunk << 24) + docs.astype(np.int64)), pa.array(more), pa.nulls(len(docs), pa.int32()), pa.nulls(len(docs), pa.binary())], schema=schema)

    now, held = None, []
    for b in batches:
        for bucket, chunk, payload in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
            if now != bucket:
                if held:
                    yield from bucket_out(now, held)
                now, held = bucket, []
            held.append((chunk, unpack(payload)))
    if held:
        yield from bucket_out(now, held)


def score(docs: DataFrame, train, id_col: str = "doc_id", text_col: str = "text", chunk_tokens: int = 1 << 21, bits: int = 6, folder: str | None = None) -> DataFrame:
    """Katz bigram scores of all texts, learning from the rows where the Column `train` holds.

    Columns: id, held_out, n_tokens, n_known, train_tokens, base_score, score. A-Z are lowered; words are what
    white space separates; an end follows each text and a start, which is not scored, comes before. Null and empty
    texts are one end; repeated rows count and are scored each; null ids stay; other columns are left out; with no
    training rows every token is the one unknown word of probability 1; no rows give none.

    `folder` gets the model: kind=counts (order, bucket, keys and counts) and kind=weights (bucket, histories
    and log10 backoff weights), partitioned tables of packed arrays. Texts are counted by 2^bits buckets
    of their n-grams' hashes; more data take more bits, so that a bucket stays some million keys.
    """
    spark = docs.sparkSession
    folder = folder or f"{shared_dir(spark)}/katz-{uuid.uuid4().hex}"
    own = docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(train, F.lit(False)).alias("_train"), F.col(text_col).alias("_text"))
    _chunks(own, chunk_tokens).write.parquet(f"{folder}/kind=chunks")
    chunks = spark.read.schema("chunk long, n long, body binary").parquet(f"{folder}/kind=chunks")
    size = chunks.agg(F.sum("n")).first()[0] or 0
    bits = max(bits, min(20, (size >> 23).bit_length()))
    starts = own.where("_train").count()
    asked = chunks.select("chunk", "body").mapInArrow(_ask(bits), _DDL)
    found = asked.repartition("order", "bucket").sortWithinPartitions("order", "bucket", "chunk").mapInArrow(_answer, _DDL)
    kind = F.when(F.col("chunk") == -1, "counts").when(F.col("chunk") == -2, "stats").otherwise("answers")
    found.withColumn("kind", kind).write.mode("append").partitionBy("kind").parquet(folder)
    _let_go(spark)
    read = lambda name: spark.read.schema(_DDL).parquet(f"{folder}/kind={name}") if size else spark.createDataFrame([], _DDL)
    stats = []
    for order in (1, 2):
        rows = [unpack(r.payload)[0] for r in read("stats").where(F.col("order") == order).select("payload").collect()]  # a row for each bucket
        s = np.sum(rows, axis=0) if rows else np.zeros(CUTOFF + 3, np.int64)
        stats.append((order, int(s[-2]), int(s[-1]), Level(s[: CUTOFF + 1].tolist())))
    answers = read("answers").groupBy("chunk").agg(F.collect_list(F.struct("order", "bucket", "payload")).alias("answers"))  # 2^(bits + 1) at most
    scored = stage(chunks.select("chunk", "body").join(answers, "chunk").mapInArrow(_evaluate(bits, starts, stats), _SCORED))
    _drop(spark, f"{folder}/kind=chunks")  # what follows needs neither
    _drop(spark, f"{folder}/kind=answers")
    _let_go(spark)
    asked = scored.where("payload IS NOT NULL").select("bucket", "chunk", "payload")
    weighed = stage(asked.repartition("bucket").sortWithinPartitions("bucket", "chunk").mapInArrow(_weigh, "rid long, more double, bucket int, payload binary"))
    weighed.where("rid IS NULL").select("bucket", "payload").write.parquet(f"{folder}/kind=weights")
    more = weighed.where("rid IS NOT NULL").groupBy("rid").agg(F.sum("more").alias("more"))
    return scored.where("rid IS NOT NULL").drop("bucket", "chunk", "payload").join(more, "rid", "left").select(
        F.when(~F.col("null"), F.col("id")).alias(id_col), "held_out", "n_tokens", "n_known", F.lit(stats[0][2]).cast("long").alias("train_tokens"),
        F.col("base").alias("base_score"), (F.col("known") + F.coalesce("more", F.lit(0.0))).alias("score"),
    )


def _drop(spark, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _let_go(spark) -> None:
    """Shuffle files go when the driver collects what referred to them; after a large step, do it now."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


@query("op3_katz_backoff")
def op3(spark, sf_dir):
    return score(table(spark, sf_dir, "documents"), fold("doc_id", 5) != 1)
