"""Nearest neighbours by inner product on robust-pruned graphs, one for each bounded shard of the vectors.

A shard's vectors have similar lengths (within an octave) and get one more component, so that all have the length
of the longest; then the largest inner product is the nearest point. The graph grows in batches: a beam search of the graph so far proposes each new
node's neighbours, pruning keeps those that no kept, nearer neighbour stands for, and edges also run backwards.
A second round, with relaxed pruning, mends what the first batches could not see. Queries are beam searches of
every shard's graph; the best of all shards are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarmac.llm.common import query, table
from tarmac.session import stage

SHARD_ROWS = 8192
DEGREE, BUILD_BEAM, BEAM, RELAX = 32, 64, 160, 1.15
BATCH = 256


class Graph:
    """Distinct vectors, the points they are searched as, and each node's out-edges (-1: none)."""

    def __init__(self, points: np.ndarray, links: np.ndarray) -> None:
        self.points, self.links = points, links

    @classmethod
    def build(cls, vectors: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, relax: float = RELAX, seed: int = 1) -> Graph:
        n = len(vectors)
        self = cls(lifted(vectors), np.full((n, degree + degree // 2), -1, np.int32))
        order = np.random.default_rng(seed).permutation(n)
        order = np.r_[0, order[order != 0]]  # every search begins at node 0
        first = order[:BATCH]
        self._insert(first, np.tile(first, (len(first), 1)), degree, 1.0)
        done = len(first)
        while done < n:
            new = order[done : done + min(done, 4 * BATCH)]
            for lo in range(0, len(new), BATCH):
                some = new[lo : lo + BATCH]
                self._insert(some, self.search(self.points[some], beam)[0], degree, 1.0)
            done += len(new)
        for lo in range(0, n, BATCH):
            some = order[lo : lo + BATCH]
            self._insert(some, np.concatenate([self.search(self.points[some], beam)[0], self.links[some]], 1), degree, relax)
        return self

    def _insert(self, nodes: np.ndarray, proposed: np.ndarray, degree: int, relax: float) -> None:
        kept = self._pruned(nodes, proposed, degree, relax)
        self.links[nodes] = -1
        self.links[nodes, :degree] = kept
        source, target = np.repeat(nodes, degree), kept.ravel()
        source, target = source[target >= 0], target[target >= 0]
        by = np.argsort(target, kind="stable")
        source, target = source[by], target[by]
        heads, at, count = np.unique(target, return_index=True, return_counts=True)
        rank = np.arange(len(target)) - np.repeat(at, count)
        back = np.full((len(heads), count.max(initial=0)), -1, np.int32)
        back[np.repeat(np.arange(len(heads)), count), rank] = source
        both = np.concatenate([self.links[heads], back], 1)
        both.sort(1)
        both[:, 1:][both[:, 1:] == both[:, :-1]] = -1  # an edge that is there already
        full = (both >= 0).sum(1) > self.links.shape[1]
        both[~full] = -np.sort(-both[~full], 1)
        self.links[heads[~full]] = both[~full, : self.links.shape[1]]
        hard = np.flatnonzero(full)
        for lo in range(0, len(hard), BATCH):
            some = hard[lo : lo + BATCH]
            self.links[heads[some]] = -1
            self.links[heads[some], :degree] = self._pruned(heads[some], both[some], degree, relax)

    def _pruned(self, nodes: np.ndarray, proposed: np.ndarray, degree: int, relax: float) -> np.ndarray:
        """Nearest first, each node keeps those of `proposed` to which no kept one is `relax` times nearer than it is."""
        proposed = np.sort(np.where(proposed == nodes[:, None], -1, proposed), 1)
        proposed[:, 1:][proposed[:, 1:] == proposed[:, :-1]] = -1
        out = np.full((len(nodes), degree), -1, np.int32)
        step = max(1, (1 << 22) // max(1, proposed.shape[1] ** 2))
        for lo in range(0, len(nodes), step):
            cand = proposed[lo : lo + step]
            own, x = self.points[nodes[lo : lo + step]], self.points[cand]
            near = 2 - 2 * np.einsum("nd,ncd->nc", own, x)
            near[cand < 0] = np.inf
            by = np.argsort(near, 1, kind="stable")
            cand, near = np.take_along_axis(cand, by, 1), np.take_along_axis(near, by, 1)
            x = np.take_along_axis(x, by[:, :, None], 1)
            between = (2 - 2 * x @ x.transpose(0, 2, 1)) * relax**2
            alive, rows = np.isfinite(near), np.arange(len(cand))
            for k in range(degree):
                pick = alive.argmax(1)
                has = alive[rows, pick]
                if not has.any():
                    break
                out[lo : lo + step, k] = np.where(has, cand[rows, pick], -1)
                alive &= ~((between[rows, pick] <= near) & has[:, None])
                alive[rows, pick] = False
        return out

    def search(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(queries x beam: nodes, nearest first, -1 where none; similarities), by greedy expansion from node 0."""
        n, q = len(self.points), len(queries)
        rows = np.arange(q)[:, None]
        ids = np.full((q, beam), -1, np.int32)
        near = np.full((q, beam), -np.inf, np.float32)
        open_ = np.zeros((q, beam), bool)
        seen = np.zeros((q, n + 1), bool)  # the last column is for "no node"
        seen[:, [0, -1]] = True
        ids[:, 0], near[:, 0], open_[:, 0] = 0, queries @ self.points[0], True
        while True:
            act = np.flatnonzero(open_.any(1))
            if not len(act):
                return ids, near
            at = open_[act].argmax(1)
            open_[act, at] = False
            new = self.links[ids[act, at]]
            fresh = ~seen[act[:, None], new]
            new = np.where(fresh, new, -1)
            seen[act[:, None], new] = True
            sim = np.einsum("nd,nkd->nk", queries[act], self.points[new])
            sim[~fresh] = -np.inf
            pool = np.concatenate([near[act], sim], 1)
            top = np.argsort(-pool, 1, kind="stable")[:, :beam]
            near[act] = np.take_along_axis(pool, top, 1)
            ids[act] = np.take_along_axis(np.concatenate([ids[act], new], 1), top, 1)
            open_[act] = np.take_along_axis(np.concatenate([open_[act], fresh], 1), top, 1)


def lifted(vectors: np.ndarray) -> np.ndarray:
    """Unit points, one component longer: nearer where the inner product with a query is larger."""
    v = vectors / max(np.abs(vectors).max(initial=0), 1e-300)
    sq = (v * v).sum(1)
    top = sq.max(initial=1e-300)
    return np.concatenate([v, np.sqrt(np.maximum(top - sq, 0))[:, None]], 1).astype(np.float32) / np.float32(np.sqrt(top))


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of paired rows, components added in order, so that they are the same everywhere."""
    total = np.zeros(len(a))
    for d in range(a.shape[1]):
        total += a[:, d] * b[:, d]
    return total


class Shard:
    """The rows of a shard: distinct vectors, their graph and, for each, its rows' ids in order."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, links: np.ndarray | None = None) -> None:
        by = np.lexsort((ids, *vectors.T[::-1]))
        ids, vectors = ids[by], vectors[by]
        new = np.r_[True, (vectors[1:] != vectors[:-1]).any(1)]
        self.ids, self.start = ids, np.r_[np.flatnonzero(new), len(ids)]
        self.vectors = vectors[new]
        self.graph = Graph(lifted(self.vectors), links) if links is not None else Graph.build(self.vectors)

    def pack(self) -> dict:
        whole = np.repeat(self.vectors, np.diff(self.start), 0)
        return {"ids": self.ids.astype("<i8").tobytes(), "vectors": whole.astype("<f8").tobytes(), "links": self.graph.links.astype("<i4").tobytes()}

    @classmethod
    def unpack(cls, ids: bytes, vectors: bytes, links: bytes, dim: int) -> Shard:
        ids, vectors = np.frombuffer(ids, "<i8"), np.frombuffer(vectors, "<f8").reshape(-1, dim)
        nodes = 1 + int((vectors[1:] != vectors[:-1]).any(1).sum())
        return cls(ids, vectors, np.frombuffer(links, "<i4").reshape(nodes, -1))

    def nearest(self, ids: np.ndarray, queries: np.ndarray, k: int, beam: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(query, id, score) of each query's k best rows among the nodes that its search found."""
        scaled = queries / np.abs(queries).max(1, keepdims=True)
        scaled = np.pad(scaled / np.linalg.norm(scaled, axis=1, keepdims=True), ((0, 0), (0, 1))).astype(np.float32)
        beam = max(beam, 2 * k)
        step = max(64, (1 << 22) // (len(self.vectors) + 1))
        for lo in range(0, len(ids), step):
            found, _ = self.graph.search(scaled[lo : lo + step], beam)
            q, at = np.nonzero(found >= 0)
            node = found[q, at]
            score = inner(queries[lo + q], self.vectors[node])
            # a node stands for its rows in order; k + 1 of them are enough, as one may be the query's own
            count = np.minimum(np.diff(self.start)[node], k + 1)
            row = np.repeat(self.start[node] - np.cumsum(count) + count, count) + np.arange(count.sum())
            q, score = np.repeat(q, count), np.repeat(score, count)
            other = self.ids[row] != ids[lo + q]
            q, row, score = q[other], row[other], score[other]
            by = np.lexsort((self.ids[row], -score, q))
            q, row, score = q[by], row[by], score[by]
            first = np.searchsorted(q, np.arange(len(found)))
            best = np.arange(len(q)) - first[q] < k
            yield ids[lo + q[best]], self.ids[row[best]], score[best]


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding",
           beam: int = BEAM, shard_rows: int = SHARD_ROWS, query_rows: int = 4096) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of `vectors` with the largest inner product for each row of `queries`.

    A row is never its own neighbour: ids equal to the query's are left out. Equal scores go to the smaller id; fewer than
    k others give fewer rows. Vectors that are null, empty, zero or hold null or non-finite components take no part, nor do rows without an
    id; only vectors of a query's length are its candidates. Rows of one id are one row, that with the least vector.
    Other columns are left out. A graph is built on all rows of a shard; the search is approximate, scores are exact.
    """
    spark = vectors.sparkSession
    points = stage(_sound(vectors, id_col, vector_col))
    wanted = _sound(queries, id_col, vector_col)
    sizes = points.groupBy("dim", "octave").agg(F.count("*").alias("n")).orderBy("dim", "octave").collect()  # a row for each vector length and octave
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    first, many, of_dim, total = [], [], {}, 0
    for r in sizes:
        n = max(1, -(-r.n // shard_rows))
        key = F.lit(f"{r.dim}:{r.octave}")
        first += [key, F.lit(total)]
        many += [key, F.lit(n)]
        of_dim.setdefault(r.dim, []).extend(range(total, total + n))
        total += n
    kind = F.concat_ws(":", "dim", "octave")
    shard = (F.create_map(*first)[kind] + F.pmod(F.xxhash64("id"), F.create_map(*many)[kind])).cast("int")

    def build(batches):
        held = []
        for b in batches:  # rows come sorted by shard
            shard, ids, v = b.column("shard").to_numpy(), b.column("id").to_numpy(), b.column("v")
            for cut in np.split(np.arange(b.num_rows), np.flatnonzero(np.diff(shard)) + 1) if b.num_rows else []:
                key = int(shard[cut[0]])
                if held and held[0][0] != key:
                    yield built(held)
                    held = []
                own = v.slice(cut[0], len(cut)).flatten().to_numpy().reshape(len(cut), -1)
                held.append((key, ids[cut], own))
        if held:
            yield built(held)

    def built(held):
        s = Shard(np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held]))
        return pa.RecordBatch.from_pylist([{"shard": held[0][0], **s.pack()}], pa.schema([("shard", pa.int32()), *((c, pa.binary()) for c in ("ids", "vectors", "links"))]))

    keyed = points.select(shard.alias("shard"), "id", "v").repartitionById(total, F.col("shard")).sortWithinPartitions("shard")
    graphs = stage(keyed.mapInArrow(build, "shard int, ids binary, vectors binary, links binary"))
    # bounded blocks of queries go to every shard of their length
    groups = max(1, -(-wanted.count() // query_rows))
    block = F.pmod(F.xxhash64(F.lit("query"), "id"), F.lit(groups)).cast("int")
    shards = F.create_map(*[x for d, at in of_dim.items() for x in (F.lit(d), F.array(*map(F.lit, at)))])
    asked = wanted.withColumn("block", block).groupBy("dim", "block").agg(F.collect_list(F.struct("id", "v")).alias("q"))
    asked = stage(asked).withColumn("shard", F.explode(shards[F.col("dim")]))

    def look(batches):
        for b in batches:
            for r in range(b.num_rows):
                dim, ids, vecs, links = (b.column(c)[r].as_py() for c in ("dim", "ids", "vectors", "links"))
                s, q = Shard.unpack(ids, vecs, links, dim), b.column("q")[r].values
                own, qs = q.field("id").to_numpy(), q.field("v").flatten().to_numpy().reshape(-1, dim)
                for x, y, z in s.nearest(own, qs, k, beam):
                    yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y), pa.array(z)], names=["query_id", "vec_id", "score"])

    task = (F.col("shard") * groups + F.col("block")).cast("int")
    tasks = asked.join(graphs, "shard").repartitionById(total * groups, task).select("dim", "ids", "vectors", "links", "q")
    found = tasks.mapInArrow(look, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _sound(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v, dim, octave) of the rows that take part; one for each id. Octave: lengths that differ by a factor of 2 at most."""
    v = F.col(vector_col).cast("array<double>")
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = df.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(F.coalesce(sound, F.lit(False)) & F.col("id").isNotNull())
    rows = rows.groupBy("id").agg(F.min("v").alias("v"))
    top = F.array_max(F.transform("v", F.abs))
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + (x / top) * (x / top))
    return rows.select("id", "v", F.size("v").alias("dim"), F.floor(F.log2(top) + F.log2(square) / 2 + 0.5).cast("int").alias("octave"))


@query("op11_vamana_search")
def op11(spark, sf_dir):
    """The 20 nearest of every vector whose id is divisible by 20."""
    vectors = table(spark, sf_dir, "embeddings")
    return search(vectors, vectors.where("vec_id % 20 = 0"))
