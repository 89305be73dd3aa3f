"""The prefix trie of conversations, from their order and the lengths of their neighbours' common prefixes (LCPs).

Conversations are sorted by their turns over all tasks and cut into blocks. In a block every conversation is a
component; the LCPs of neighbours, as edges in descending depth, merge them by union-find. A merge at depth d is the
branching node of depth d, and a component keeps its members from its depth up to that of its next merge, so a chain
of nodes is one record. What a node holds is a sum over its members and edges. Nodes that reach over a block's
boundary (prefixes of its first or last conversation, down to the LCP with the neighbour) are contracted to their
partial sums, merged by the hash of the prefix, and given back to the blocks, which then write their nodes.

Long conversations are sorted by segments: the parts after the first `segment` turns are tries of their own, one for
each prefix before them, worked off from the deepest; their sums enter the last node of the segment above.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarmac.llm.common import query, table
from tarmac.operators.sequence import number_rows
from tarmac.session import stage

SEGMENT, BLOCK_ROWS, BLOCK_BYTES = 256, 4096, 1 << 20
_LONG_BLOCK = 4096  # turns of one conversation that go to a task
_EMPTY = hashlib.sha256(b"").hexdigest()
_NODE = ("conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, "
         "rel int, p1 long, p2 long, q1 long, q2 long")
_NAMES = [c.split()[0] for c in _NODE.split(", ")]


def turns(conversations: DataFrame) -> DataFrame:
    """(conv, pos from 1, k1, k2, size): turns in order (null first; equal ones by the hash of role and text), roles and texts as a
    128-bit hash, size in bytes of the text. Null roles and texts are empty; rows without a conversation are left out."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    t = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), F.xxhash64(role, text).alias("k1"),
        F.xxhash64(F.lit("second"), text, role).alias("k2"), F.octet_length(text).cast("long").alias("size"))
    chunk = F.coalesce(F.floor(F.col("turn") / _LONG_BLOCK), F.lit(-(2**62)))
    return number_rows(t, ["conv"], ["turn", "k1", "k2"], chunk, "pos").drop("turn")


def rebuilt(own: DataFrame, share: F.Column, base: F.Column) -> tuple[DataFrame, DataFrame]:
    """(turns, (conv) of all conversations): the first `share` turns of conversation `base`, then what follows the own first `share`."""
    own = stage(own)
    heads = own.groupBy("conv").agg(F.count("*").alias("n")).select("conv", "n", share.alias("h"), base.alias("base"))
    heads = stage(heads)
    given = heads.join(heads.select(F.col("conv").alias("base"), F.col("n").alias("base_n")), "base", "left")
    given = given.withColumn("m", F.least("h", F.coalesce("base_n", F.lit(0))))
    start = given.where("m > 0").select("conv", "base", "m")
    most = start.agg(F.max("m")).first()[0] or 0
    start = own.where(F.col("pos") <= most).withColumnRenamed("conv", "base").join(start, "base").where("pos <= m")
    piece = F.floor((F.col("pos") - 1) / _LONG_BLOCK)
    shift = given.select("conv", "h", "m", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / _LONG_BLOCK))).alias("piece"))
    rest = own.withColumn("piece", piece).join(shift, ["conv", "piece"]).where("pos > h").withColumn("pos", F.col("pos") - F.col("h") + F.col("m"))
    cols = ["conv", "pos", "k1", "k2", "size"]
    return start.select(cols).union(rest.select(cols)), heads.select("conv")


class Forest:
    """The components of a block of sorted conversations, each with its deepest node and the component it merged into."""

    def __init__(self, t: pa.Table, left: int, right: int) -> None:
        """left, right: the LCP of the first (last) conversation with the one before (after) the block, -1 if none."""
        self.left, self.right = left, right
        col = {c: t.column(c).combine_chunks() for c in t.column_names}
        self.conv = col["conv"].to_numpy()
        self.keys, at = _keys(col["keys"])
        self.at = at.tolist()
        self.prefix = [col[c].to_numpy() for c in ("p1", "p2", "q1", "q2")]
        self.bytes = np.r_[0, np.cumsum(col["sizes"].flatten().to_numpy())]
        n, length = len(self.conv), np.diff(at)
        lcp = np.full(n + 1, -1)
        lcp[0], lcp[n] = left, right
        for i in range(1, n):
            if self.prefix[0][i] == self.prefix[0][i - 1] and self.prefix[1][i] == self.prefix[1][i - 1]:
                lcp[i] = common(self.keys[at[i - 1] : at[i]], self.keys[at[i] : at[i + 1]])
        more = col["more"].to_numpy(zero_copy_only=False)
        leaf = ~more & (lcp[1:] < length)
        # one entry for each component: depth, first and last row, members, smallest member, children, leaves, sum, rows that end at depth
        self.depth, self.first, self.last = length.tolist(), list(range(n)), list(range(n))
        self.n, self.low, self.kids = [1] * n, self.conv.tolist(), col["b_kids"].to_pylist()
        self.leaves = (leaf + col["b_leaves"].to_numpy()).tolist()
        self.sum, self.ends = col["b_saved"].to_pylist(), (~more).astype(int).tolist()
        self.up, self.top = [-1] * n, [0] * n  # the component merged into; the depth of the uppermost node of the chain
        self._merge(lcp[1:n])

    def _merge(self, edges: np.ndarray) -> None:
        owner = list(range(len(self.conv)))  # union-find over rows; each root's component

        def root(i):
            while owner[i] != i:
                owner[i] = owner[owner[i]]
                i = owner[i]
            return i

        comp = list(range(len(self.conv)))
        for e in np.argsort(-edges, kind="stable").tolist():
            d = int(edges[e])
            if d < 0:
                break
            a, b = root(e), root(e + 1)
            x, y = comp[a], comp[b]
            owner[b] = a
            gain = int(self.bytes[self.at[e + 1] + d] - self.bytes[self.at[e + 1]])
            if self.depth[x] != d:  # a new node; in order, a prefix comes first, so y can't be the node either
                z = len(self.depth)
                for values, v in ((self.depth, d), (self.first, self.first[x]), (self.last, self.first[x]), (self.n, 0), (self.low, self.low[x]),
                                  (self.kids, 0), (self.leaves, 0), (self.sum, 0), (self.ends, 0), (self.up, -1), (self.top, 0)):
                    values.append(v)
                self._under(x, z, 0)
                comp[a] = x = z
            if self.depth[y] == d:  # a copy of x's first row: its nodes are x's
                self._absorb(x, y, gain)
                self.up[y], self.top[y] = x, d + 1
            else:
                self._under(y, x, gain)

    def _absorb(self, x: int, y: int, gain: int) -> None:
        self.last[x] = max(self.last[x], self.last[y])
        self.n[x] += self.n[y]
        self.low[x] = min(self.low[x], self.low[y])
        self.kids[x] += self.kids[y]
        self.leaves[x] += self.leaves[y]
        self.sum[x] += self.sum[y] + gain
        self.ends[x] += self.ends[y]

    def _under(self, child: int, node: int, gain: int) -> None:
        """`child` becomes a child of `node`."""
        d = self.depth[node]
        kids, ends = self.kids[node] + self.begins(child, d + 1), self.ends[node]
        self._absorb(node, child, gain)
        self.kids[node], self.ends[node] = kids, ends
        self.up[child], self.top[child] = node, d + 1

    def begins(self, x: int, d: int) -> bool:
        """Whether no block before this one has members of the component's node of depth d."""
        return not (self.first[x] == 0 and d <= self.left)

    def open(self, x: int, d: int) -> bool:
        return not self.begins(x, d) or (self.last[x] == len(self.conv) - 1 and d <= self.right)

    def nodes(self) -> Iterator[tuple[int, int]]:
        """(component, depth) of every node that the block has members of."""
        for x in range(len(self.depth)):
            for d in range(self.depth[x], self.top[x] - 1, -1):
                yield x, d

    def part(self, x: int, d: int) -> tuple:
        """(members, smallest, children, leaves, sum) of what the block knows of a node."""
        kids = self.kids[x] if d == self.depth[x] else int(self.begins(x, d + 1))
        total = self.sum[x] if self.begins(x, d) else self.sum[x] + self.size(0, self.left)
        return self.n[x], self.low[x], kids, self.leaves[x], total

    def size(self, row: int, d: int) -> int:
        """Bytes of the first d turns of a row."""
        return int(self.bytes[self.at[row] + max(d, 0)] - self.bytes[self.at[row]])

    def ids(self, x: int, d: int) -> str:
        """The ids of the rows that end in a node, comma-joined: they come first in it, in order."""
        if d != self.depth[x] or not self.ends[x]:
            return ""
        return ",".join(map(str, self.conv[self.first[x] : self.first[x] + self.ends[x]].tolist()))

    def key(self, x: int, d: int) -> bytes:
        i = self.first[x]
        h = hashlib.blake2b(np.array([self.prefix[0][i], self.prefix[1][i], d], "<i8").tobytes(), digest_size=16)
        h.update(np.ascontiguousarray(self.keys[self.at[i] : self.at[i] + d]).tobytes())
        return h.digest()


def _keys(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all turns' keys, where each row's begin) of a list column."""
    at = np.r_[0, np.cumsum(col.value_lengths().to_numpy())]
    flat = col.flatten()
    return np.stack([flat.field("k1").to_numpy(), flat.field("k2").to_numpy()], 1), at


def common(a: np.ndarray, b: np.ndarray) -> int:
    """The length of the common prefix of two sequences of keys."""
    m = min(len(a), len(b))
    other = (a[:m] != b[:m]).any(1)
    return int(other.argmax()) if other.any() else m


def _edge(row: pa.RecordBatch) -> bytes:
    keys, _ = _keys(row.column("keys"))
    return np.array([row.column("p1")[0].as_py(), row.column("p2")[0].as_py()], "<i8").tobytes() + keys.astype("<i8").tobytes()


def _met(a: bytes | None, b: bytes | None) -> int:
    """The LCP of two blocks' edges; -1 where there is none or the prefixes before the segment differ."""
    if a is None or b is None or a[:16] != b[:16]:
        return -1
    return common(np.frombuffer(a, "<i8", offset=16).reshape(-1, 2), np.frombuffer(b, "<i8", offset=16).reshape(-1, 2))


def _read(raw: bytes) -> pa.Table:
    return pa.ipc.open_stream(raw).read_all()


def segments(turn: DataFrame, heads: DataFrame, segment: int) -> tuple[DataFrame, int]:
    """(conv, seg, keys, sizes, p1, p2: hash of all turns before, q1, q2: with its own, more: others follow), and the last seg."""
    cut = turn.withColumn("seg", F.floor((F.col("pos") - 1) / segment).cast("int"))
    by = F.array_sort(F.collect_list(F.struct("pos", "k1", "k2", "size")))  # `segment` turns at most
    some = cut.groupBy("conv", "seg").agg(by.alias("t")).select(
        "conv", "seg", F.transform("t", lambda x: F.struct(x.k1.alias("k1"), x.k2.alias("k2"))).alias("keys"), F.transform("t", lambda x: x.size).alias("sizes"))
    some = stage(some)
    bare = heads.join(some.where("seg = 0").select("conv"), "conv", "left_anti").select(
        "conv", F.lit(0).alias("seg"), *(F.array().cast(some.schema[c].dataType).alias(c) for c in ("keys", "sizes")))
    all_ = some.union(bare)
    last = some.agg(F.max("seg")).first()[0] or 0
    zero = F.lit(0).cast("long")
    if not last:
        return all_.select("*", *(zero.alias(c) for c in ("p1", "p2", "q1", "q2")), F.lit(False).alias("more")), 0
    w = Window.partitionBy("conv").orderBy("seg")
    for k in "12":
        h = F.xxhash64(F.lit(k), "seg", "keys")
        all_ = all_.withColumn(f"p{k}", F.coalesce(F.bit_xor(h).over(w.rowsBetween(Window.unboundedPreceding, -1)), zero))
        all_ = all_.withColumn(f"q{k}", F.bit_xor(h).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return stage(all_.withColumn("more", F.lead("seg").over(w).isNotNull())), last


def nodes(turn: DataFrame, heads: DataFrame, segment: int = SEGMENT, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """A row for each distinct prefix of the conversations' turns, the empty one too: conv_id (smallest member), depth, parent_conv_id,
    n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    `turn` as turns() gives it, `heads` the (conv) of all conversations, those without turns as well. No conversations: no rows.
    """
    segs, last = segments(turn, heads, segment)
    found, below = [], None
    for k in range(last, -1, -1):
        items = segs.where(F.col("seg") == k).drop("seg")
        if below is not None:
            items = items.join(below, "conv", "left")
        cols = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) if below is not None else F.lit(0).cast("long").alias(c) for c in ("b_kids", "b_leaves", "b_saved")]
        level = stage(_level(items.select("conv", "keys", "sizes", "p1", "p2", "q1", "q2", "more", *cols), k * segment, block_rows))
        if k:
            below = level.where("rel = 0").select(F.col("conv_id").alias("conv"), F.col("n_children").alias("b_kids"),
                                                  F.col("n_leaves").alias("b_leaves"), F.col("saved_tokens").alias("b_saved"))
        found.append(level)
    out, names = found[-1], _NAMES[:8]
    for upper, level in zip(found[:0:-1], found[-2::-1], strict=True):
        ends = upper.where(F.col("rel") == segment).select(F.col("q1").alias("p1"), F.col("q2").alias("p2"), F.col("conv_id").alias("_up"))
        level = level.where("rel > 0").join(ends, ["p1", "p2"]).withColumn("parent_conv_id", F.when(F.col("rel") == 1, F.col("_up")).otherwise(F.col("parent_conv_id")))
        out = out.select(names).union(level.select(names))
    return out.select(names)


def _level(items: DataFrame, above: int, block_rows: int) -> DataFrame:
    """The nodes of one segment of all conversations; depth 0 stands for the last node of the segment above."""
    spark = items.sparkSession
    items = stage(items)
    parts = max(2 * spark.sparkContext.defaultParallelism, items.count() // (1 << 16))
    names = items.columns

    def pack(batches):
        from pyspark import TaskContext

        task, seq, held, size = TaskContext.get().partitionId(), 0, [], 0
        for b in batches:
            cost, lo = (64 + 24 * b.column("keys").value_lengths().to_numpy()).tolist(), 0
            for i, c in enumerate(cost):
                rows = sum(map(len, held)) + i - lo
                if rows and (rows == block_rows or size + c > BLOCK_BYTES):
                    yield packed(task, seq, [*held, b.slice(lo, i - lo)])
                    seq, held, size, lo = seq + 1, [], 0, i
                size += c
            held.append(b.slice(lo))
        if held and any(map(len, held)):
            yield packed(task, seq, held)

    def packed(task, seq, held):
        held = [b for b in held if len(b)]
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, held[0].schema) as out:
            for b in held:
                out.write_batch(b)
        row = {"part": task, "seq": seq, "first": _edge(held[0].slice(0, 1)), "last": _edge(held[-1].slice(len(held[-1]) - 1)), "payload": sink.getvalue().to_pybytes()}
        return pa.RecordBatch.from_pylist([row], pa.schema([("part", pa.int32()), ("seq", pa.int32()), *((c, pa.binary()) for c in ("first", "last", "payload"))]))

    order = ["p1", "p2", "keys", "more", "conv"]
    blocks = stage(items.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(pack, "part int, seq int, first binary, last binary, payload binary"))
    begin, at = [], 0
    for r in blocks.groupBy("part").agg(F.count("*").alias("n")).orderBy("part").collect():  # a row for each task
        begin.append((r.part, at))
        at += r.n
    begin = spark.createDataFrame(begin, "part int, begin long")
    blocks = blocks.join(F.broadcast(begin), "part").withColumn("idx", F.col("begin") + F.col("seq"))
    edges = blocks.select("idx", "first", "last")
    sides = edges.join(edges.select((F.col("idx") + 1).alias("idx"), F.col("last").alias("before")), "idx", "left").join(
        edges.select((F.col("idx") - 1).alias("idx"), F.col("first").alias("after")), "idx", "left")

    def measure(batches):
        for b in batches:
            c = [b.column(k).to_pylist() for k in ("before", "first", "last", "after")]
            yield pa.RecordBatch.from_arrays([b.column("idx"), pa.array([_met(x, y) for x, y in zip(c[0], c[1], strict=True)], pa.int32()),
                                              pa.array([_met(x, y) for x, y in zip(c[2], c[3], strict=True)], pa.int32())], names=["idx", "l", "r"])

    blocks = blocks.select("idx", "payload").join(stage(sides.mapInArrow(measure, "idx long, l int, r int")), "idx")
    partial = "idx long, at int, d int, key binary, n long, low long, kids long, leaves long, total long, ids string"

    def contract(batches):
        for b in batches:
            for idx, raw, left, right in zip(*(b.column(c).to_pylist() for c in ("idx", "payload", "l", "r")), strict=True):
                f = Forest(_read(raw), left, right)
                rows = [(idx, f.first[x], d, f.key(x, d), *f.part(x, d), f.ids(x, d)) for x, d in f.nodes() if f.open(x, d)]
                yield _batch(rows, partial)

    reach = stage(blocks.mapInArrow(contract, partial))
    sums = reach.groupBy("key").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.sum("kids").alias("kids"), F.sum("leaves").alias("leaves"), F.sum("total").alias("total"))
    ends = reach.where("ids <> ''").select("key", "idx", "ids").repartition("key").sortWithinPartitions("key", "idx").mapInArrow(_digests, "key binary, sha string")
    whole = stage(sums.join(ends, "key", "left"))
    spine = reach.select("idx", "at", "d", "key").join(whole, "key").groupBy("idx").agg(
        F.collect_list(F.struct("at", "d", "n", "low", "kids", "leaves", "total", "sha")).alias("spine"))  # two paths of a segment's depth at most

    def write(batches):
        for b in batches:
            for raw, left, right, spine_ in zip(*(b.column(c).to_pylist() for c in ("payload", "l", "r", "spine")), strict=True):
                f = Forest(_read(raw), left, right)
                known = {(s["at"], s["d"]): s for s in spine_ or []}
                yield _batch(list(_rows(f, known, above)), _NODE)

    return blocks.join(spine, "idx", "left").select("payload", "l", "r", "spine").mapInArrow(write, _NODE)


def _rows(f: Forest, known: dict, above: int) -> Iterator[tuple]:
    def low(x, d):
        s = known.get((f.first[x], d))
        return s["low"] if s else f.low[x]

    for x, d in f.nodes():
        if not f.begins(x, d):
            continue  # the block that has its first member writes it
        row, s = f.first[x], known.get((f.first[x], d))
        n, least, kids, leaves, total = (s[c] for c in ("n", "low", "kids", "leaves", "total")) if s else f.part(x, d)
        if s:
            sha = s["sha"] or _EMPTY
        else:
            ids = f.ids(x, d)
            sha = hashlib.sha256(ids.encode()).hexdigest() if ids else _EMPTY
        parent = None if d == 0 else low(x, d - 1) if d > f.top[x] else low(f.up[x], d - 1)
        yield (least, above + d, parent, n, kids, leaves, total - (n - 1) * f.size(row, d - 1), sha, d, *(int(p[row]) for p in f.prefix))


def _digests(batches) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each key's pieces, which come in order, comma-joined."""
    own = h = None
    for b in batches:
        for key, ids in zip(b.column("key").to_pylist(), b.column("ids"), strict=True):
            if key != own:
                if h:
                    yield _batch([(own, h.hexdigest())], "key binary, sha string")
                own, h = key, hashlib.sha256()
            else:
                h.update(b",")
            h.update(ids.as_py().encode())
    if h:
        yield _batch([(own, h.hexdigest())], "key binary, sha string")


def _batch(rows: list, ddl: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
    fields = [c.split() for c in ddl.split(", ")]
    cols = list(zip(*rows, strict=True)) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(cols, fields, strict=True)], names=[c for c, _ in fields])


def shared_conversations(conversations: DataFrame) -> DataFrame:
    """The trie of conversations that begin with up to eight turns of the one whose id is theirs less its remainder by five."""
    h = F.crc32(F.col("conv").cast("string").cast("binary")) % 9
    return nodes(*rebuilt(turns(conversations), h, F.col("conv") - F.col("conv") % 5))


_SQL = """
WITH t AS (SELECT conv_id, md5(length(role) || ':' || role || text) AS k, strlen(text) AS size,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos
    FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)),
own AS (SELECT conv_id, list(k ORDER BY pos) AS k, list(size ORDER BY pos) AS size, xor(list_reduce(
        [4294967295::BIGINT] || flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0])),
        lambda x, v: xor(xor(x, v) >> 1, 3988292384 * (xor(x, v) & 1))), 4294967295) % 9 AS h
    FROM t GROUP BY conv_id),
r AS (SELECT c.conv_id, coalesce(b.k[1:c.h], []) || c.k[c.h + 1:] AS k, coalesce(b.size[1:c.h], []) || c.size[c.h + 1:] AS size
    FROM own c LEFT JOIN own b ON b.conv_id = c.conv_id - c.conv_id % 5),
m AS (SELECT conv_id, d, array_to_string(k[1:d], ',') AS p, array_to_string(k[1:d - 1], ',') AS up, len(k) AS n, CASE WHEN d > 0 THEN size[d] ELSE 0 END AS size, k
    FROM (SELECT *, unnest(range(len(k) + 1)) AS d FROM r)),
node AS (SELECT d, p, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(size) AS size, any_value(k[1:d]) AS k,
        sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = d), '')) AS ends_sha256 FROM m GROUP BY d, p),
kids AS (SELECT d - 1 AS d, up AS p, count(*) AS n FROM node WHERE d > 0 GROUP BY ALL),
full_ AS (SELECT node.*, coalesce(kids.n, 0) AS n_children FROM node LEFT JOIN kids USING (d, p)),
sub AS (SELECT e AS d, array_to_string(k[1:e], ',') AS p, sum((n_convs - 1) * size)::BIGINT AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves
    FROM (SELECT *, unnest(range(d + 1)) AS e FROM full_) GROUP BY ALL)
SELECT f.conv_id, f.d AS depth, u.conv_id AS parent_conv_id, f.n_convs, f.n_children, s.n_leaves, s.saved_tokens, f.ends_sha256
FROM full_ f JOIN sub s USING (d, p) LEFT JOIN node u ON u.d = f.d - 1 AND u.p = f.up
"""


@query("op12_prefix_trie", _SQL)
def op12(spark, sf_dir):
    """A row for each node of the trie of the rebuilt conversations."""
    return shared_conversations(table(spark, sf_dir, "conversations"))
