import numpy as np
import pytest

from tarmac.llm import graph


def brute(rows, asked, k):
    """{query: [(id, score)]} by comparing everything, components added in order."""
    ok = {i: v for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    out = {}
    for q in asked:
        if q in ok:
            near = [i for i, v in ok.items() if i != q and len(v) == len(ok[q])]
            score = {}
            if near:
                both = np.broadcast_arrays(np.array([ok[q]], float), np.array([ok[i] for i in near], float))
                score = dict(zip(near, graph.inner(*both).tolist(), strict=True))
            out[q] = sorted(score.items(), key=lambda x: (-x[1], x[0]))[:k]
    return out


def recall(got, want):
    found = {(r.query_id, r.vec_id) for r in got}
    return sum((q, i) in found for q, best in want.items() for i, _ in best) / sum(map(len, want.values()))


def check_order(got, want):
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert {q: len(x) for q, x in by.items()} == {q: len(x) for q, x in want.items() if x}
    for x in by.values():
        x.sort()
        assert [r for r, _, _ in x] == list(range(1, len(x) + 1))
        assert [(-s, i) for _, i, s in x] == sorted((-s, i) for _, i, s in x)


@pytest.mark.parametrize("sf", ["0.001", "0.1"])
def test_query_recall(spark, sf):
    path = f"/root/testdata/sf{sf}"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{path}/embeddings.parquet").collect()]
    want = brute(rows, [i for i, _ in rows if i % 20 == 0], 20)
    got = graph.op11(spark, path).collect()
    check_order(got, want)
    exact = {(q, i): s for q, best in want.items() for i, s in best}
    assert recall(got, want) >= 0.98
    assert all(exact.get((r.query_id, r.vec_id), r.score) == r.score for r in got)


def test_norms_clusters_copies_and_shards(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(8, 24))
    rows = [(i, (centres[i % 8] + rng.normal(0, [0.01, 0.5][i % 2], 24)).tolist()) for i in range(1500)]
    rows += [(2000 + i, (rng.normal(size=24) * rng.lognormal(0, 1.5)).tolist()) for i in range(500)]
    rows += [(3000 + i, [1000 * x for x in rows[5][1]]) for i in range(300)]  # copies tie: the smaller ids count
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS id", "2 AS shard", "3 AS block", "4 AS score", "5 AS dim")
    want = brute(rows, range(0, 3300, 20), 10)
    for size in (500, 8192):
        got = graph.search(df, df.where("vec_id % 20 = 0"), 10, shard_rows=size, query_rows=100).collect()
        check_order(got, want)
        assert recall(got, want) >= 0.95
    own = {r.rank: r.vec_id for r in got if r.query_id == 3000}
    assert own == {r: i for r, i in zip(range(1, 11), range(3001, 3011))}


def test_pruned_graph_against_its_definition():
    rng = np.random.default_rng(0)
    g = graph.Graph(graph.lifted(rng.normal(size=(60, 5))), np.full((60, 12), -1, np.int32))
    cand = np.stack([rng.choice(60, 30, replace=False) for _ in range(10)]).astype(np.int32)
    got = g._pruned(np.arange(10), cand, 8, 1.2)
    far = 2 - 2 * g.points.astype(float) @ g.points.T.astype(float)
    for p in range(10):
        kept = []
        for c in sorted((c for c in cand[p] if c != p), key=lambda c: far[p, c]):
            if len(kept) < 8 and all(far[k, c] * 1.2**2 > far[p, c] for k in kept):
                kept.append(c)
        assert [c for c in got[p] if c >= 0] == kept


def test_odd_rows(spark):
    rows = [(0, [1.0, 0.0]), (20, [0.0, 2.0]), (1, [3.0, 1.0]), (1, [3.0, 1.0]), (2, [1.0, 1.0]), (2, [0.5, 9.0]), (None, [9.0, 9.0]), (40, None), (60, []), (80, [0.0, 0.0]),
            (100, [1.0, None]), (120, [float("nan"), 1.0]), (140, [float("-inf"), 1.0]), (160, [1.0, 2.0, 3.0]), (180, [1e200, 1e-200]), (3, [-1.0, -1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = graph.search(df, df.where("vec_id % 20 = 0")).collect()
    want = brute([r for r in rows if r != (2, [1.0, 1.0])], [r for r, _ in rows if r is not None and r % 20 == 0], 20)
    check_order(got, want)
    assert sorted((r.query_id, r.vec_id, r.score) for r in got) == sorted((q, i, s) for q, best in want.items() for i, s in best)
    assert graph.search(df.limit(0), df).count() == 0 and graph.search(df, df.limit(0)).count() == 0
    assert graph.search(df.where("vec_id = 0"), df.where("vec_id = 0")).count() == 0
