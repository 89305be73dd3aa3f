"""Near duplicates by SimHash: fingerprints compared at the anchors of a covering code.

Two fingerprints within 3 bits differ in at most one bit of one of their 32-bit halves. On 31 bits of a
half the words of the perfect Hamming code [31, 26] are the anchors: every value lies within 1 (the
covering radius) of exactly one, its home. A fingerprint goes to all anchors within radius + threshold
= 1 + 1 of either half, at most 16 each, so any linked pair meets at the home of each of the two.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmac.llm.common import annotate, blocks, components, query, shielded, table
from tarmac.session import stage

SEED = 42
BITS = 3
NEAR_WIDTH, BANDS, ROWS = 5, 24, 5  # at a similarity of 0.8 a pair shares no band in 1 of 14,000 cases, at 0.85 in 1 of 1.3 million
_LAST = 2**63 - 1  # stands for a null id in "smallest id": after all others


def shingle_hashes(text: bytes, width: int) -> Iterator[np.ndarray]:
    """XXH64 of each shingle of `width` words, A-Z lowered, block by block; short texts give one."""
    digest, tail, done = xxhash.xxh64_intdigest, [], False
    for block in blocks(text):
        words = tail + block.lower().split()
        n = len(words) - width + 1
        if n > 0:
            lens = np.fromiter(map(len, words), np.int64, len(words))
            ends = np.cumsum(lens + 1) - 1
            joined = b" ".join(words)
            pairs = zip((ends - lens)[:n].tolist(), ends[width - 1 :].tolist(), strict=True)
            yield np.fromiter((digest(joined[a:b], SEED) for a, b in pairs), np.uint64, n)
            done = True
        tail = words[max(0, n) :]
    if not done and tail:
        yield np.array([digest(b" ".join(tail), SEED)], np.uint64)


def fingerprint(text: bytes, width: int = 3) -> int:
    """A bit is 1 if it is set in over half of the shingle hashes; no words: 0."""
    ones, n = np.zeros(64, np.int64), 0
    for h in shingle_hashes(text, width):
        for at in range(0, len(h), 1 << 15):
            part = h[at : at + (1 << 15)].astype("<u8")
            ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        n += len(h)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0]) if n else 0


def fingerprints(docs: DataFrame, text_col: str = "text", width: int = 3) -> DataFrame:
    """`docs` with a column _fp (long, the 64 bits). Null and empty texts have 0."""

    def run(rows):
        return [np.array([fingerprint(t, width) for t in rows], np.uint64).view(np.int64)]

    return annotate(docs, text_col, "_fp long", run)


def _checks() -> np.ndarray:
    """Row j has the positions (1 to 31, at bit p-1) whose number has bit j."""
    return np.array([sum(1 << (p - 1) for p in range(1, 32) if p >> j & 1) for j in range(5)], np.uint64)


def anchors(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, index into fps, whether it is home) of each anchor that fps are sent to."""
    out = []
    for half in (0, 1):
        x = fps >> np.uint64(32 * half) & np.uint64(0x7FFFFFFF)
        syn = np.zeros(len(x), np.int64)
        for j, mask in enumerate(_checks()):
            syn |= (np.bitwise_count(x & mask) & 1).astype(np.int64) << j
        flip = np.where(syn > 0, np.uint64(1) << np.maximum(syn - 1, 0).astype(np.uint64), np.uint64(0))
        base = np.uint64(half << 31)
        out.append(((x ^ flip) | base, np.arange(len(x)), np.ones(len(x), bool)))
        for p in range(1, 32):  # two flips p < q with p ^ q = syndrome reach the codewords at distance 2
            q = p ^ syn
            at = np.flatnonzero((syn > 0) & (q > p))
            two = (np.uint64(1) << np.uint64(p - 1)) | (np.uint64(1) << (q[at] - 1).astype(np.uint64))
            out.append(((x[at] ^ two) | base, at, np.zeros(len(at), bool)))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _stars(key: np.ndarray, fp: np.ndarray, home: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links inside runs of equal keys: a pair each in small runs, a star for each linked set in large ones."""
    out_a, out_b = [], []
    cut = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    sizes = np.diff(np.r_[cut, len(key)])
    small = np.repeat(sizes <= 48, sizes)
    for s in range(1, 48):
        at = np.flatnonzero(small[:-s] & (key[:-s] == key[s:]))
        if not len(at):
            break
        at = at[(home[at] | home[at + s]) & (np.bitwise_count(fp[at] ^ fp[at + s]) <= bits)]
        out_a.append(fp[at])
        out_b.append(fp[at + s])
    for c, n in zip(cut[sizes > 48], sizes[sizes > 48], strict=True):
        x = np.unique(fp[c : c + n])
        label, step = np.arange(len(x)), max(1, (1 << 22) // len(x))
        while True:
            new = label.copy()
            for i in range(0, len(x), step):
                near = np.bitwise_count(x[i : i + step, None] ^ x[None, :]) <= bits
                new[i : i + step] = np.where(near, label[None, :], len(x)).min(1)
            new = new[new]
            if (new == label).all():
                break
            label = new
        at = np.flatnonzero(label != np.arange(len(x)))
        out_a.append(x[at])
        out_b.append(x[label[at]])
    return np.concatenate(out_a or [fp[:0]]), np.concatenate(out_b or [fp[:0]])


def links(fps: DataFrame, bits: int = BITS, hot: int = 4096) -> DataFrame:
    """(a, b) links between distinct fingerprints (column _fp) within `bits` <= 3.

    Linked sets are whole, not every pair in them is listed. An anchor with over `hot` members is dealt
    out as pairs of parts of it, so no task holds an unbounded group.
    """
    if not 0 <= bits <= 3:
        raise ValueError("the code's halves cover up to 3 bits")

    def send(batches):
        for b in batches:
            x = b.column(0).to_numpy().view(np.uint64)
            key, at, home = anchors(x)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(x[at].view(np.int64)), pa.array(home)], names=["key", "fp", "home"])

    def compare(batches):
        rest = None
        for b in batches:
            k, p, x, h = (b.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            own = np.stack([k, p])
            if rest is not None:
                own, x, h = np.concatenate([rest[0], own], 1), np.concatenate([rest[1], x]), np.concatenate([rest[2], h])
            new = np.flatnonzero((own[:, 1:] != own[:, :-1]).any(0)) + 1
            end = new[-1] if len(new) else 0
            rest = own[:, end:], x[end:], h[end:]
            if end:
                yield from emit(own[:, :end], x[:end], h[:end])
        if rest is not None:
            yield from emit(*rest)

    def emit(own, x, h):
        run = np.cumsum(np.r_[0, (own[:, 1:] != own[:, :-1]).any(0)])
        a, b = _stars(run, x.view(np.uint64), h, bits)
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    sent = fps.select("_fp").mapInArrow(send, "key long, fp long, home boolean")
    large = sent.groupBy("key").count().where(F.col("count") > hot).select("key", F.ceil(F.col("count") * 2 / hot).cast("int").alias("n"))
    own = F.pmod(F.xxhash64("fp"), F.col("n")).cast("int")
    parts = F.when(F.col("n").isNull(), F.array(F.lit(0))).otherwise(
        F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda j: F.least(own, j) * F.col("n") + F.greatest(own, j))
    )
    dealt = sent.join(large, "key", "left").select("key", F.explode(parts).alias("part"), "fp", "home")
    return (
        dealt.repartition("key", "part").sortWithinPartitions("key", "part").mapInArrow(compare, "a long, b long").distinct()
    )


def _members(docs: DataFrame, id_col: str, text_col: str, width: int, bits: int) -> DataFrame:
    """_id, _hash (of the text), _fp and _rep, the (id, hash) that stands for the class, of each document."""
    own = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"), F.xxhash64(text_col).alias("_hash"))
    own = stage(fingerprints(own, "_text", width))
    me = F.struct(F.coalesce("_id", F.lit(_LAST)).alias("id"), F.col("_hash").alias("hash"))
    first = stage(own.groupBy("_fp").agg(F.min(me).alias("first"), F.count("*").alias("n")))
    roots = stage(components(links(first, bits)))
    linked = first.drop("n").join(roots.select(F.col("node").alias("_fp"), "root"), "_fp")
    least = linked.groupBy("root").agg(F.min("first").alias("least"))
    small = linked.join(least, "root").select("_fp", "least")
    member = first.join(small, "_fp", "left").select("_fp", F.coalesce("least", "first").alias("_rep"))
    # a fingerprint that holds more than a thousandth of all rows is dealt out; there are a thousand of these at most
    share = max(64, own.count() // 1000)
    hot = F.broadcast(first.where(F.col("n") > share).select("_fp", F.ceil(F.col("n") / share).cast("int").alias("_k")))
    dealt = own.join(hot, "_fp", "left").withColumn("_part", F.coalesce(F.pmod(F.xxhash64("_id"), F.col("_k")).cast("int"), F.lit(0))).drop("_k")
    member = member.join(hot, "_fp", "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_k", F.lit(1)) - 1))).drop("_k")
    return dealt.join(member, ["_fp", "_part"]).drop("_part")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, bits: int = BITS) -> DataFrame:
    """One row per document: id, fingerprint (16 hex digits), component_id (smallest id reachable, itself included).

    Null and empty texts share fingerprint 0 and are linked like any other; equal texts, ties and repeated
    rows fall in one class; a null id is the smallest of a class only if all its ids are null. Other columns
    of `docs` are ignored; an empty table gives an empty result.
    """
    return _members(docs, id_col, text_col, width, bits).select(
        F.col("_id").alias(id_col), F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"),
        F.when(F.col("_rep.id") < _LAST, F.col("_rep.id")).alias("component_id"),
    )


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, bits: int = BITS) -> DataFrame:
    """`docs` with one document of each class: the one with the smallest id (one copy of a repeated row).

    Columns stay as they are. Documents without words are one class.
    """
    docs, to, back = shielded(docs)
    id_col, text_col = to(id_col), to(text_col)
    found = _members(docs, id_col, text_col, width, bits)
    kept = stage(
        found.where((F.coalesce("_id", F.lit(_LAST)) == F.col("_rep.id")) & (F.col("_hash") == F.col("_rep.hash")))
        .groupBy("_id", "_hash").count()
    )
    same = docs[id_col].cast("long").eqNullSafe(F.col("_id")) & (F.xxhash64(docs[text_col]) == F.col("_hash"))
    out = docs.join(kept.select("_id", "_hash"), same, "left_semi")
    return back(out if kept.where("count > 1").isEmpty() else out.dropDuplicates([id_col, text_col]))


def shingle_set(text: bytes, width: int = NEAR_WIDTH) -> np.ndarray:
    """The distinct shingle hashes, sorted."""
    parts = list(shingle_hashes(text, width))
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)


_FLIP, _TIMES = np.random.default_rng(SEED).integers(0, 2**64, (2, BANDS * ROWS, 1), dtype=np.uint64)
_TIMES |= np.uint64(1)


def bands(found: np.ndarray) -> list[int]:
    """A key for each band of least shingle hashes (over ROWS permutations each); no shingles: no keys."""
    if not len(found):
        return []
    least = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for at in range(0, len(found), 1 << 11):
        least = np.minimum(least, ((found[None, at : at + (1 << 11)] ^ _FLIP) * _TIMES).min(1))
    return [xxhash.xxh64_intdigest(least[i * ROWS : (i + 1) * ROWS].tobytes(), i) - 2**63 for i in range(BANDS)]


def _forest(sets: list[np.ndarray], across: int) -> list[tuple[int, int]]:
    """Links i, j that join what is linked at a similarity of 0.8 or more; the first `across` sets are not compared with each other."""
    sizes = np.array([len(x) for x in sets])
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
    starts = np.cumsum(sizes) - sizes
    mark, top, out = np.zeros(ids.max() + 1, np.int64), np.arange(len(sets)), []
    for i in range(len(sets)):
        own = ids[starts[i] : starts[i] + sizes[i]]
        mark[own] = 1
        both = np.add.reduceat(mark[ids], starts)
        mark[own] = 0
        near = 5 * both >= 4 * (sizes + sizes[i] - both)
        near[: max(i + 1, across if i < across else 0)] = False
        for j in np.flatnonzero(near & (top != top[i])).tolist():
            if top[j] != top[i]:
                top[top == top[j]] = top[i]
                out.append((i, j))
    return out


def near_links(nodes: DataFrame, sets: DataFrame, few: int = 8, hot: int = 1024) -> DataFrame:
    """(a, b) links of nodes (_node, _keys) whose sets (_node, _set array<bigint>) have a Jaccard similarity of 0.8 or more.

    Pairs that share a band are compared. Bands of at most `few` nodes give pairs, each compared once; larger
    ones are compared where they meet, in pairs of parts of at most about `hot` nodes, and linked sets are whole.
    """

    def compare(batches):
        key, held = None, []
        for b in batches:
            for k, p, own, node, s in zip(*(b.column(i).to_pylist() for i in range(4)), b.column(4), strict=True):
                if key != (k, p):
                    yield from emit(held)
                    key, held = (k, p), []
                held.append((own, node, s.values.to_numpy().view(np.uint64)))
        yield from emit(held)

    def emit(held):
        if len(held) > 1:
            held.sort(key=lambda r: r[:2])
            least = sum(r[0] == held[0][0] for r in held)  # the same part is compared with itself elsewhere
            links = _forest([r[2] for r in held], 0 if least == len(held) else least)
            if links:
                a, b = zip(*links, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array([held[i][1] for i in x], pa.int64()) for x in (a, b)], names=["a", "b"])

    rows = nodes.select("_node", F.explode("_keys").alias("key"))
    shared = stage(rows.groupBy("key").count().where("count > 1"))
    few_rows = rows.join(shared.where(F.col("count") <= few).select("key"), "key")
    pairs = few_rows.select("key", F.col("_node").alias("a")).join(few_rows.select("key", F.col("_node").alias("b")), "key").where("a < b")
    a, b = (sets.select(F.col("_node").alias(c), F.col("_set").alias(f"s{c}")) for c in "ab")
    both = F.size(F.array_intersect("sa", "sb"))
    near = pairs.select("a", "b").distinct().join(a, "a").join(b, "b").where(5 * both >= 4 * (F.size("sa") + F.size("sb") - both)).select("a", "b")
    large = shared.where(F.col("count") > few).select("key", F.ceil(F.col("count") * 2 / hot).cast("int").alias("n"))
    own = F.pmod(F.xxhash64("_node"), F.col("n")).cast("int")
    parts = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda j: F.least(own, j) * F.col("n") + F.greatest(own, j))
    dealt = rows.join(large, "key").select("key", F.explode(parts).alias("part"), own.alias("own"), "_node").join(sets, "_node")
    dealt = dealt.select("key", "part", "own", "_node", "_set").repartition("key", "part").sortWithinPartitions("key", "part")
    return near.union(dealt.mapInArrow(compare, "a long, b long")).distinct()


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with one document, that with the smallest id, of each class linked by near copies: a Jaccard similarity of 0.8 or more of the sets of five-word shingles.

    No 64-bit fingerprint tells 0.8 from less, so candidates share a band of least hashes; all are checked exactly.
    Texts under five words are one shingle. Columns stay as they are. Documents without words are one class.
    """
    docs, to, back = shielded(docs)
    id_col, text_col = to(id_col), to(text_col)

    def sketch(rows):
        found = [shingle_set(t) for t in rows]
        return [[xxhash.xxh64_intdigest(s.tobytes()) - 2**63 for s in found], [bands(s) for s in found]]

    me = F.struct(F.coalesce("_id", F.lit(_LAST)).alias("id"), F.col("_hash").alias("hash"))
    own = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"), F.xxhash64(text_col).alias("_hash"))
    own = stage(annotate(own, "_text", "_node long, _keys array<bigint>", sketch))
    nodes = stage(own.groupBy("_node").agg(F.min(me).alias("first"), F.first("_keys").alias("_keys")))
    keys = nodes.select("_node", "first", F.explode("_keys").alias("key"))
    shared = keys.join(keys.groupBy("key").count().where("count > 1").select("key"), "key", "left_semi")
    need = stage(shared.select("_node", F.col("first.id").alias("_id"), F.col("first.hash").alias("_hash")).distinct())
    texts = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)).alias("_id"), F.col(text_col).alias("_text"), F.xxhash64(text_col).alias("_hash"))
    texts = texts.join(need, ["_id", "_hash"]).select("_node", "_text").dropDuplicates(["_node"])
    sets = stage(annotate(texts, "_text", "_set array<bigint>", lambda rows: [[shingle_set(t).view(np.int64) for t in rows]]))
    roots = stage(components(near_links(nodes, sets)))
    linked = nodes.join(roots.select(F.col("node").alias("_node"), "root"), "_node")
    least = linked.groupBy("root").agg(F.min("first").alias("least"))
    small = linked.join(least, "root").select("_node", "least")
    rep = nodes.join(small, "_node", "left").select(F.coalesce("least", "first").alias("_rep")).distinct()
    kept = stage(own.groupBy("_id", "_hash").count().join(rep, (F.coalesce("_id", F.lit(_LAST)) == F.col("_rep.id")) & (F.col("_hash") == F.col("_rep.hash")), "left_semi"))
    same = docs[id_col].cast("long").eqNullSafe(F.col("_id")) & (F.xxhash64(docs[text_col]) == F.col("_hash"))
    out = docs.join(kept.select("_id", "_hash"), same, "left_semi")
    return back(out if kept.where("count > 1").isEmpty() else out.dropDuplicates([id_col, text_col]))


@query("op5_simhash_anchors")
def op5(spark, sf_dir):
    return classes(table(spark, sf_dir, "documents"))
