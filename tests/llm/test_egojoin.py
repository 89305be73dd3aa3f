import numpy as np

from tarmac.llm import egojoin


def brute(rows, threshold=0.95):
    """{id: (n_links, component)} by comparing all pairs."""
    ok = [i for i, (_, v) in enumerate(rows) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    parent = list(range(len(rows)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    n = [0] * len(rows)
    for p, i in enumerate(ok):
        v = np.array(rows[i][1], float) / np.abs(rows[i][1]).max()
        for j in ok[:p]:
            w = np.array(rows[j][1], float) / np.abs(rows[j][1]).max()
            if len(v) == len(w) and v @ w / (np.linalg.norm(v) * np.linalg.norm(w)) >= threshold:
                n[i] += 1
                n[j] += 1
                parent[top(i)] = top(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        low[top(i)] = min(low.get(top(i), d), d)
    return sorted((d, n[i], low[top(i)]) for i, (d, _) in enumerate(rows))


def test_query_equals_brute_force(spark, small):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{small}/embeddings.parquet").collect()]
    got = egojoin.op1(spark, small).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == brute(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_odd_vectors_and_small_blocks(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 10))
    rows = [(i, (centres[i % 6] * rng.uniform(0.1, 9) + rng.normal(0, 0.25, 10)).tolist()) for i in range(400)]
    rows += [(1000 + i, [1.0] * 10) for i in range(150)] + [(2000, None), (2001, []), (2002, [0.0] * 10), (2003, [1.0, None]), (2004, [1.0, float("nan")]),
             (2005, [float("inf"), 1.0]), (2006, [1.0]), (2007, [3.0]), (2008, [-3.0]), (2009, [1e200] * 10), (2010, [1e-200] * 10), (2011, [1.0, 2.0]), (2012, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS n_links", "2 AS node", "3 AS id")
    for size in (2000, 8 << 20):
        got = sorted((r.vec_id, r.n_links, r.component_id) for r in egojoin.classes(df, group_bytes=size).collect())
        assert got == brute(rows)
    assert egojoin.classes(df.where("false")).count() == 0
    again = spark.createDataFrame([(5, [1.0, 0.0]), (5, [1.0, 0.0]), (None, [1.0, 0.1]), (None, [0.0, 1.0])], "vec_id long, embedding array<float>")
    got = sorted(((r.vec_id or -1), r.n_links, r.component_id, r.kept) for r in egojoin.classes(again).where("vec_id is not null or n_links > 0").collect())
    assert got == [(-1, 2, 5, False), (5, 2, 5, True), (5, 2, 5, True)]
