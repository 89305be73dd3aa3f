"""Near-duplicate vectors by an epsilon grid order join on leading principal dimensions."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmac.llm.common import components, query, table
from tarmac.session import stage

LEADING, SORTED = 16, 4  # principal dimensions kept for boxes; those the grid order sorts by
LEAF = 512
_LAST = 2**63 - 1


def radius(threshold: float) -> float:
    """The chord between unit vectors of that cosine, with room for rounding."""
    return math.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-7


def basis(sample: np.ndarray) -> np.ndarray:
    """Orthonormal columns: the leading principal dimensions of unit vectors."""
    _, axes = np.linalg.eigh(np.cov(sample.T, ddof=0).reshape(sample.shape[1], -1))
    return axes[:, ::-1][:, :LEADING]


def distant(a: np.ndarray, b: np.ndarray, eps: float) -> bool:
    """Whether no vector of a is within eps of one of b, by the boxes of their leading dimensions."""
    gap = np.maximum(0, np.maximum(a.min(0) - b.max(0), b.min(0) - a.max(0)))
    return float(gap @ gap) > eps * eps


class Sequence:
    """Vectors in grid order: nodes, how many rows each stands for, raw and unit vectors, leading dimensions."""

    def __init__(self, payload: bytes, dim: int, axes: np.ndarray) -> None:
        n = len(payload) // (16 + 8 * dim)
        self.nodes = np.frombuffer(payload, "<i8", n)
        self.rows = np.frombuffer(payload, "<i8", n, 8 * n)
        self.raw = np.frombuffer(payload, "<f8", n * dim, 16 * n).reshape(n, dim)
        self.unit = unit(self.raw)
        self.lead = self.unit @ axes


def unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(1, keepdims=True)  # far from overflow
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def pairs(a: Sequence, b: Sequence, eps: float) -> Iterator[tuple[slice, slice]]:
    """The leaf intervals that must be compared: intervals are halved, distant ones skipped. a is b: each pair once."""
    todo = [(0, len(a.nodes), 0, len(b.nodes))]
    while todo:
        i, j, k, m = todo.pop()
        if i >= j or k >= m or distant(a.lead[i:j], b.lead[k:m], eps):
            continue
        if j - i <= LEAF and m - k <= LEAF:
            yield slice(i, j), slice(k, m)
        elif a is b and (i, j) == (k, m):
            h = (i + j) // 2
            todo += [(i, h, i, h), (i, h, h, j), (h, j, h, j)]
        elif j - i >= m - k:
            h = (i + j) // 2
            todo += [(i, h, k, m), (h, j, k, m)]
        else:
            h = (k + m) // 2
            todo += [(i, j, k, h), (i, j, h, m)]


def linked(a: Sequence, b: Sequence, x: slice, y: slice, threshold: float) -> np.ndarray:
    """Which pairs of two leaves reach the threshold, in double precision; close calls from the raw vectors."""
    g = a.unit[x] @ b.unit[y].T
    found = g >= threshold
    for i, j in zip(*np.nonzero(np.abs(g - threshold) < 1e-9), strict=True):
        v, w = a.raw[x][i], b.raw[y][j]
        found[i, j] = v @ w / (np.linalg.norm(v) * np.linalg.norm(w)) >= threshold
    if a is b and x == y:
        np.fill_diagonal(found, False)
    return found


def joined(a: Sequence, b: Sequence, eps: float, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(node, root, rows): what each node gains in linked rows, and a star for each linked set of two leaves."""
    for x, y in pairs(a, b, eps):
        m = linked(a, b, x, y, threshold)
        if not m.any():
            continue
        r, c = np.flatnonzero(m.any(1)), np.flatnonzero(m.any(0))
        m = m[np.ix_(r, c)]
        label = np.arange(len(r))
        near = m | np.eye(len(r), dtype=bool) if a is b and x == y else m  # there rows and columns are the same nodes
        while True:
            over = np.where(near, label[:, None], len(r)).min(0)
            new = np.where(near, over[None, :], len(r)).min(1)
            if (new == label).all():
                break
            label = new
        rows_a, rows_b = a.nodes[x][r], b.nodes[y][c]
        yield rows_a, rows_a[label], m @ b.rows[y][c]
        if not (a is b and x == y):
            yield rows_b, rows_a[over], a.rows[x][r] @ m


def classes(vectors: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding",
            group_bytes: int = 8 << 20, sample_rows: int = 4096) -> DataFrame:
    """Per row: id, n_links (other rows with a cosine >= threshold), component_id (smallest id reachable), kept.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing; vectors of
    different lengths don't link; equal vectors are one node that stands for its rows; a null id is its
    component's smallest only if all are null; repeated rows each count; other columns are left out. The principal
    dimensions are fitted on a bounded sample (`sample_rows` at most, about): they steer what is skipped, not what links.
    """
    if not 0 < threshold <= 1:
        raise ValueError("a threshold over 0 to 1")
    spark, eps = vectors.sparkSession, radius(threshold)
    v = F.col(vector_col).cast("array<double>")
    sound = F.coalesce(
        F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False)
    )
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.when(sound, v).alias("v"))
    rows = rows.select("id", "v", F.when(F.col("v").isNotNull(), F.xxhash64("v")).alias("k1"),
                       F.when(F.col("v").isNotNull(), F.xxhash64(F.lit("second"), "v")).alias("k2"))
    nodes = rows.where("v IS NOT NULL").groupBy("k1", "k2").agg(
        F.min(F.coalesce("id", F.lit(_LAST))).alias("first"), F.count("*").alias("rows"), F.first("v").alias("v")
    )
    nodes = stage(nodes.withColumn("node", F.monotonically_increasing_id()).withColumn("dim", F.size("v")))
    size = {r.dim: r.n for r in nodes.groupBy("dim").agg(F.count("*").alias("n")).collect()}  # a row for each vector length
    axes: dict[int, np.ndarray] = {}
    for dim, n in size.items():
        some = nodes.where((F.col("dim") == dim) & (F.pmod("k1", F.lit(1 << 30)) < min(1.0, sample_rows / n) * (1 << 30)))
        sample = np.array([r.v for r in some.select("v").collect()] or [[1.0] * dim])
        axes[dim] = basis(unit(sample))
    sent = spark.sparkContext.broadcast(axes)

    def order(batches):
        for b in batches:
            dims = b.column("dim").to_numpy()
            raw = b.column("v").flatten().to_numpy()
            ends = np.cumsum(dims)
            cells = np.zeros((b.num_rows, SORTED), np.int32)
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                x = np.stack([raw[e - d : e] for e in ends[at]])
                lead = unit(x) @ sent.value[int(d)][:, :SORTED]
                cells[at, : lead.shape[1]] = np.floor(lead / eps)
            yield pa.RecordBatch.from_arrays(
                [*b.columns, *(pa.array(cells[:, k]) for k in range(SORTED))], names=[*b.schema.names, *(f"c{k}" for k in range(SORTED))])

    def pack(batches):
        held: list[tuple] = []
        bytes_held = seq = 0
        for b in batches:
            vs = b.column("v")
            for i, (node, n, dim, c) in enumerate(zip(*(b.column(k).to_pylist() for k in ("node", "rows", "dim", "c0")), strict=True)):
                if held and (held[0][2] != dim or bytes_held > group_bytes):
                    yield block(held, seq)
                    held, bytes_held, seq = [], 0, seq + 1
                held.append((node, n, dim, c, vs[i].values.to_numpy()))
                bytes_held += 16 + 8 * dim
        if held:
            yield block(held, seq)

    def block(held, seq):
        from pyspark import TaskContext

        dim = held[0][2]
        raw = np.stack([h[4] for h in held])
        payload = b"".join([np.array([h[0] for h in held], "<i8").tobytes(), np.array([h[1] for h in held], "<i8").tobytes(), raw.astype("<f8").tobytes()])
        lead = unit(raw) @ sent.value[dim]
        lo, hi = lead.min(0), lead.max(0)
        row = {"block": [(TaskContext.get().partitionId() << 24) + seq], "dim": [dim], "low": [min(h[3] for h in held)], "high": [max(h[3] for h in held)],
               "lo": [lo.tolist()], "hi": [hi.tolist()], "payload": [payload]}
        return pa.RecordBatch.from_pydict(row, pa.schema([("block", pa.int64()), ("dim", pa.int32()), ("low", pa.int32()), ("high", pa.int32()), (
            "lo", pa.list_(pa.float64())), ("hi", pa.list_(pa.float64())), ("payload", pa.binary())]))

    cells = ", ".join(f"c{k} int" for k in range(SORTED))
    keyed = nodes.select("node", "rows", "dim", "v").mapInArrow(order, f"node long, rows long, dim int, v array<double>, {cells}")
    whole = sum((16 + 8 * d) * n for d, n in size.items())
    parts = max(1, -(-whole // group_bytes), 3 * spark.sparkContext.defaultParallelism)
    keys = ["dim", *(f"c{k}" for k in range(SORTED)), "node"]
    packed = stage(
        keyed.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
        .mapInArrow(pack, "block long, dim int, low int, high int, lo array<double>, hi array<double>, payload binary")
    )
    # blocks whose first cells are neighbours and whose boxes are within reach; each pair has one home
    box = packed.select("block", "dim", "lo", "hi", "low", "high")
    left = box.select(F.col("block").alias("a"), "dim", F.col("lo").alias("alo"), F.col("hi").alias("ahi"), F.explode(F.sequence("low", "high")).alias("cell"))
    right = box.select(F.col("block").alias("b"), "dim", "lo", "hi", F.explode(F.sequence(F.col("low") - 1, F.col("high") + 1)).alias("cell"))
    gaps = F.zip_with(F.zip_with("alo", "hi", lambda p, q: p - q), F.zip_with("lo", "ahi", lambda p, q: p - q), lambda p, q: F.greatest(p, q, F.lit(0.0)))
    reach = F.aggregate(gaps, F.lit(0.0), lambda s, g: s + g * g) <= eps * eps
    met = left.join(right, ["dim", "cell"]).where((F.col("a") <= F.col("b")) & reach).select("a", "b").distinct()
    odd = (F.hash("a", "b") % 2) == 0
    work = stage(met.select(F.when(odd, F.col("a")).otherwise(F.col("b")).alias("home"), F.when(odd, F.col("b")).otherwise(F.col("a")).alias("block")))
    with_home = work.select("home", "block", F.lit(1).alias("guest")).union(work.select("home", F.col("home").alias("block"), F.lit(0).alias("guest")).distinct())
    tasks = with_home.join(packed.select("block", "dim", "payload"), "block").repartition(parts, "home").sortWithinPartitions("home", "guest", "block")

    def compare(batches):
        home, own = None, None
        for b in batches:
            for h, guest, dim, payload, blk in zip(*(b.column(k) for k in ("home", "guest", "dim", "payload", "block")), strict=True):
                seq = None
                if not guest.as_py():
                    home, own = h.as_py(), Sequence(payload.as_py(), dim.as_py(), sent.value[dim.as_py()])
                    continue
                seq = own if blk.as_py() == home else Sequence(payload.as_py(), dim.as_py(), sent.value[dim.as_py()])
                for node, root, n in joined(own, seq, eps, threshold):
                    yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(root), pa.array(n.astype(np.int64))], names=["a", "b", "n"])

    found = stage(tasks.mapInArrow(compare, "a long, b long, n long"))
    gained = found.groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("gained"))
    roots = components(found.select("a", "b"))
    per = nodes.select("k1", "k2", "node", "first", "rows").join(gained, "node", "left").join(roots, "node", "left")
    per = stage(per.withColumn("root", F.coalesce("root", "node")))
    least = per.groupBy("root").agg(F.min("first").alias("least"))
    per = per.join(least, "root").select("k1", "k2", "least", (F.col("rows") - 1 + F.coalesce("gained", F.lit(0))).alias("n"))
    out = rows.select("id", "k1", "k2").join(per, ["k1", "k2"], "left").select(
        F.col("id").alias(id_col), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("least") == _LAST, None).otherwise(F.coalesce("least", "id")).alias("component_id"),
    )
    return out.withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))


@query("op1_ego_join")
def op1(spark, sf_dir):
    return classes(table(spark, sf_dir, "embeddings"))
