"""Benchmark passages in documents: SimHash of item-sized windows, multi-index Hamming blocks, exact check.

Every window of an item's size class is fingerprinted (a difference of running bit counts), looked up in
the class's items and, if within the radius, verified by the weighted Jaccard similarity of five-word
shingles between the item and the windows of its exact length around the place. So that no class's size or
radius loses a passage, windows around an exact shingle of an item are verified too: one that reaches 0.8
holds one of any fifth of the item's shingles, so the rarest fifth (and one) of each item are looked up.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmac.llm.common import annotate, blocks, query, shielded, table

RADIUS, QUARTERS = 11, 4  # within 11 bits, one of four 16-bit blocks is within 2
SHINGLE, LEAST = 5, 0.8
RATIO = 1.2  # between size classes; an item's class is the nearest size, at most a tenth away
CHUNK = 1 << 14  # words fingerprinted at once


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def features(h: np.ndarray) -> np.ndarray:
    """A hash for each pair of neighbouring words, from the words' hashes."""
    with np.errstate(over="ignore"):
        return _mix(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + _mix(h[1:]))


_STEP = 0x9E3779B97F4A7C15
_LOW = np.arange(1, 257, dtype=np.uint64)
_LOW[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[*range(9, 14), 32]] = True
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """The first n (or more) powers of base, modulo 2^64."""
    if len(_powers.get(base, ())) < n:
        _powers[base] = np.cumprod(np.r_[np.uint64(1), np.full(max(n, 1 << 16), base, np.uint64)])
    return _powers[base]


def words_of(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, hash) of each word, A-Z lowered for the hash: differences of one running polynomial hash."""
    a = np.frombuffer(text, np.uint8)
    if not len(a):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    gap = np.r_[True, _BLANK[a], True]
    start, end = np.flatnonzero(gap[:-1] & ~gap[1:]), np.flatnonzero(~gap[:-1] & gap[1:])
    run = np.zeros(len(a) + 1, np.uint64)
    np.cumsum(_LOW[a] * powers(_STEP, len(a))[: len(a)], out=run[1:])
    return start, end, _mix((run[end] - run[start]) * powers(pow(_STEP, -1, 1 << 64), len(a))[start])


def shingle_hashes(h: np.ndarray, width: int) -> np.ndarray:
    """A hash for each `width` neighbouring words, from the words' hashes."""
    n, out = max(0, len(h) - width + 1), np.uint64(0)
    with np.errstate(over="ignore"):
        for i in range(width):
            out = _mix(out * np.uint64(_STEP) + h[i : i + n])
    return out


def bits_of(x: np.ndarray) -> np.ndarray:
    return np.unpackbits(x.astype("<u8").view(np.uint8), bitorder="little").reshape(-1, 64)


def packed(bits: np.ndarray) -> np.ndarray:
    return np.packbits(np.ascontiguousarray(bits).ravel(), bitorder="little").view("<u8")


def running(bits: np.ndarray, kind: type, width: int = 61) -> np.ndarray:
    """Counts of set bits before each row, modulo the kind's size: inside blocks, then over them."""
    n = len(bits)
    rows = n // width + 1
    grid = np.zeros((rows * width, 64), kind)
    grid[1 : n + 1] = bits
    grid = np.ascontiguousarray(grid.reshape(rows, width, 64).transpose(1, 0, 2))
    for i in range(1, width):
        grid[i] += grid[i - 1]
    grid[:, 1:] += np.cumsum(grid[-1], axis=0, dtype=kind)[None, :-1]
    return grid.transpose(1, 0, 2).reshape(-1, 64)[: n + 1]


def window_sizes(longest: int) -> list[int]:
    """1, 2, ... while steps of RATIO are under one word, then geometric, up to past the longest."""
    out = [1]
    while out[-1] < longest:
        out.append(max(out[-1] + 1, int(out[-1] * RATIO)))
    return out


def shingles(words: list[bytes]) -> Counter:
    n = min(SHINGLE, len(words))
    return Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1)) if words else Counter()


def similarity(a: Counter, b: Counter) -> float:
    """Weighted Jaccard: shingles count as often as they occur."""
    total = a.total() + b.total()
    both = (a & b).total()
    return both / (total - both) if total > both else 0.0


@dataclass
class Items:
    """The items of one size class: fingerprints and, for each block, the values within 2 of an item's."""

    size: int
    at: list[int] = field(default_factory=list)
    fps: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    near: list[np.ndarray] = field(default_factory=list)


class Index:
    def __init__(self, items: list[tuple[int | None, bytes]]) -> None:
        self.ids, self.words = [], []
        for i, text in items:
            if words := text.lower().split():
                self.ids.append(i)
                self.words.append(words)
        self.shingles = [shingles(w) for w in self.words]
        self.longest = max(map(len, self.words), default=0)
        sizes = window_sizes(self.longest)
        groups: dict[int, list[int]] = {}
        for k, w in enumerate(self.words):
            groups.setdefault(min(sizes, key=lambda s: max(s, len(w)) / min(s, len(w))), []).append(k)
        self.classes = [self._class(s, at) for s, at in sorted(groups.items())]
        self.keys = self._keys()

    def _keys(self) -> list[tuple]:
        """For each shingle width: hashes looked up, where their items start and end, the items, whether a hash can be one."""
        found = [shingle_hashes(words_of(b" ".join(w))[2], min(SHINGLE, len(w))) for w in self.words]
        often = Counter(h for f in found for h in set(f.tolist()))
        by: dict[int, set[tuple[int, int]]] = {}
        for k, f in enumerate(found):
            rarest = sorted(f.tolist(), key=lambda h: (often[h], h))
            by.setdefault(min(SHINGLE, len(self.words[k])), set()).update((h, k) for h in rarest[: len(f) // 5 + 1])
        out = []
        for width, rows in sorted(by.items()):
            h, k = (np.array(c, t) for c, t in zip(zip(*sorted(rows), strict=True), (np.uint64, np.int64), strict=True))
            own, start, n = np.unique(h, return_index=True, return_counts=True)
            lut = np.zeros(1 << 20, bool)
            lut[own >> np.uint64(44)] = True
            out.append((width, own, start, start + n, k, lut))
        return out

    def _shared(self, h: np.ndarray, left: np.ndarray) -> list[tuple[int, int]]:
        """(place, item) where a looked-up shingle of the item stands."""
        out = []
        for width, own, start, stop, item, lut in self.keys:
            for a in range(0, len(h) - width + 1, CHUNK):
                g = shingle_hashes(h[a : a + CHUNK + width - 1], width)
                at = np.flatnonzero(lut[g >> np.uint64(44)] & (left[a : a + len(g)] >= width))
                i = np.minimum(np.searchsorted(own, g[at]), len(own) - 1)
                ok = own[i] == g[at]
                out += [(a + p, k) for p, j in zip(at[ok].tolist(), i[ok].tolist(), strict=True) for k in item[start[j] : stop[j]].tolist()]
        return out

    def _class(self, size: int, at: list[int]) -> Items:
        fps = np.array([self._fingerprint(self.words[k]) for k in at], np.uint64)
        one = np.uint16(1) << np.arange(16, dtype=np.uint16)
        flips = np.unique(np.concatenate([[np.uint16(0)], one, (one[:, None] ^ one[None, :]).ravel()]))
        near = []
        for q in range(QUARTERS):
            lut = np.zeros(1 << 16, bool)
            lut[(fps.astype("<u8").view("<u2").reshape(-1, 4)[:, q][:, None] ^ flips[None, :]).ravel()] = True
            near.append(lut)
        return Items(size, at, fps, near)

    def _fingerprint(self, words: list[bytes]) -> int:
        h = words_of(b" ".join(words))[2]
        if len(h) == 1:
            return int(h[0])
        f = bits_of(features(h))
        return int(packed((2 * f.sum(0, dtype=np.int64) > len(f))[None, :])[0])

    def _hits(self, items: Items, fps: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        part = fps.view("<u2").reshape(-1, 4)
        found = items.near[0][part[:, 0]]
        for q in range(1, QUARTERS):
            found |= items.near[q][part[:, q]]
        at = np.flatnonzero(found & valid)
        step = max(1, (1 << 22) // max(1, len(items.fps)))
        rows, cols = [], []
        for a in range(0, len(at), step):
            r, c = np.nonzero(np.bitwise_count(fps[at[a : a + step], None] ^ items.fps[None, :]) <= RADIUS)
            rows.append(at[a + r])
            cols.append(c)
        return (np.concatenate(rows), np.concatenate(cols)) if rows else (at, at)

    def search(self, parts: list[tuple[int, int, bytes]]) -> Iterable[tuple[int, int, float, int]]:
        """(row, item, similarity, word) for parts (row, words before, text)."""
        if not self.classes:
            return
        data = b"\n".join(t for *_, t in parts)
        begin, end, h = words_of(data)
        n = len(h)
        if not n:
            return
        at = np.cumsum([len(t) + 1 for *_, t in parts])
        last = np.searchsorted(begin, at)
        first = np.r_[0, last[:-1]]
        sizes = last - first
        part = np.repeat(np.arange(len(parts)), sizes)
        left = last[part] - np.arange(n)  # words up to the end of the part
        ones = running(bits_of(features(h)), np.uint8 if self.classes[-1].size <= 256 else np.uint32)
        whole = np.flatnonzero((sizes > 1) & (sizes < self.classes[-1].size))
        seen = set()
        for c in self.classes:
            s = c.size
            for a in range(0, n - s + 1, CHUNK):
                b = min(a + CHUNK, n - s + 1)
                fps = h[a:b] if s == 1 else packed((ones[a + s - 1 : b + s - 1] - ones[a:b]) > (s - 1) // 2)
                rows, cols = self._hits(c, fps, left[a:b] >= s)
                seen.update((int(a + r), c.at[k]) for r, k in zip(rows.tolist(), cols.tolist(), strict=True))
            short = whole[(sizes[whole] < s) & (sizes[whole] >= LEAST * s)] if len(whole) else whole
            if len(short):  # texts a little shorter than the class: one window
                m = (sizes[short] - 1)[:, None]
                fps = packed(2 * (ones[first[short] + sizes[short] - 1] - ones[first[short]]).astype(np.int64) > m)
                rows, cols = self._hits(c, fps, np.ones(len(short), bool))
                seen.update((int(first[short[r]]), c.at[k]) for r, k in zip(rows.tolist(), cols.tolist(), strict=True))
        done: dict[tuple[int, int], float] = {}
        for at, k in seen:
            p = int(part[at])
            own, lo, hi = self.words[k], int(first[p]), int(first[p] + sizes[p])
            slack = max(2, len(own) // 8)
            for start in range(max(lo, at - slack), min(at + slack, max(lo, hi - len(own))) + 1):
                if (start, k) not in done:
                    stop = min(hi, start + len(own))
                    words = [data[i:j].lower() for i, j in zip(begin[start:stop].tolist(), end[start:stop].tolist(), strict=True)]
                    done[start, k] = similarity(self.shingles[k], shingles(words))
        near: dict[tuple[int, int], set[int]] = {}
        for at, k in self._shared(h, left):
            p = int(part[at])
            lo, last_start = int(first[p]), max(int(first[p]), int(last[p]) - len(self.words[k]))
            back = max(0, len(self.words[k]) - SHINGLE)
            near.setdefault((p, k), set()).update(range(max(lo, min(at - back, last_start)), min(at, last_start) + 1))
        for (p, k), starts in near.items():
            own, hi = self.words[k], int(last[p])
            whole, n = self.shingles[k].total(), min(SHINGLE, len(own))
            words, known = {}, {}

            def word(i):
                if i not in words:
                    words[i] = data[begin[i] : end[i]].lower()
                return words[i]

            def known_at(i):
                if i not in known:
                    known[i] = tuple(map(word, range(i, i + n))) in self.shingles[k]
                return known[i]

            before, count = None, 0
            for start in sorted(starts):
                stop = min(hi, start + len(own))
                if before == start - 1 and stop == start + len(own):
                    count += known_at(stop - n) - known_at(start - 1)
                else:
                    count = sum(map(known_at, range(start, stop - n + 1)))
                before = start
                if 5 * count >= 4 * whole and (start, k) not in done:
                    done[start, k] = similarity(self.shingles[k], shingles(list(map(word, range(start, stop)))))
        for (start, k), sim in done.items():
            if sim >= LEAST:
                p = int(part[start])
                yield parts[p][0], k, sim, parts[p][1] + start - int(first[p])

    def run(self, rows: Iterable[bytes], budget: int = 1 << 19) -> list[list[dict]]:
        """For each text the items in it: item, similarity (the best), word (where it starts)."""
        best: list[dict[int, tuple[float, int]]] = []
        parts: list[tuple[int, int, bytes]] = []
        held = 0
        overlap = self.longest + max(2, self.longest // 8)

        def flush():
            for row, k, sim, word in self.search(parts):
                if (sim, -word) > best[row].get(k, (0.0, 0)):
                    best[row][k] = (sim, -word)
            parts.clear()

        for i, text in enumerate(rows):
            best.append({})
            before, tail = 0, b""
            for block in blocks(text, budget):
                block = tail + block
                parts.append((i, before, block))
                held += len(block)
                if len(text) > budget:  # the next part repeats the last words of this one
                    again = block.rsplit(None, overlap)[-overlap:]
                    before += len(block.split()) - len(again)
                    tail = b" ".join(again) + b" "
                if held > budget:
                    flush()
                    held = 0
        flush()
        return [[{"item": self.ids[k], "similarity": s, "word": -w} for k, (s, w) in sorted(b.items())] for b in best]


HITS = "_hits array<struct<item: bigint, similarity: double, word: int>>"


def find(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
         keep_text: bool = False, at_once: int = 50_000) -> DataFrame:
    """`docs` with _hits: item id, similarity >= 0.8 and first word of each benchmark item found in the text.

    Whole texts are searched, with A-Z lowered. Null and empty texts and items have no hits; an item under
    five words is one shingle; equal items are all reported; repeated rows get equal answers; other columns
    stay. Items go to every task `at_once` of them at a time, so what is broadcast is bounded; more are
    searched in further passes.
    """
    own = items.where(F.col(item_text).isNotNull()).select(F.col(item_id).cast("long").alias("i"), F.col(item_text).alias("t"))
    passes = -(-own.count() // at_once) or 1
    out = docs
    spark = docs.sparkSession
    for p in range(passes):
        part = own.where(F.pmod(F.xxhash64("i", "t"), F.lit(passes)) == p) if passes > 1 else own
        rows = sorted(((r.i, r.t.encode()) for r in part.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        sent = spark.sparkContext.broadcast(rows)
        out = annotate(out, text_col, HITS if p == passes - 1 else HITS.replace("_hits", f"_hits{p}"), _searcher(sent), keep_text or p < passes - 1)
    for p in range(passes - 1):
        out = out.withColumn("_hits", F.concat("_hits", f"_hits{p}")).drop(f"_hits{p}")
    return out


def _searcher(sent):
    made: list[Index] = []

    def run(rows):
        if not made:
            made.append(Index(sent.value))
        return [made[0].run(rows)]

    return run


def drop_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text") -> DataFrame:
    """`docs` without those that hold a benchmark item."""
    docs, to, back = shielded(docs)
    return back(find(docs, items, to(text_col), keep_text=True).where(F.size("_hits") == 0))


@query("op7_decontaminate_simhash")
def op7(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.explode("_hits").alias("h")).select(
        "doc_id", F.col("h.item").alias("item_id"), F.col("h.similarity").alias("similarity"), F.col("h.word").alias("start_word")
    )
