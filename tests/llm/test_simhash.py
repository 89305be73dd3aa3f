import numpy as np
import pytest
import xxhash

from tarmac.llm import simhash
from tarmac.llm.common import components


def plain_fingerprint(text, k=3):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = [x for x in __import__("re").split("[\x20\x09-\x0d]+", w) if x]
    sh = [" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def plain_classes(ids, fps, bits=3):
    parent = list(range(len(ids)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= bits:
                parent[top(i)] = top(j)
    groups = {}
    for i in range(len(ids)):
        groups.setdefault(top(i), []).append(ids[i])
    return {d: min(g) for g in groups.values() for d in g}


def test_anchor_codes_cover():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2**63, 300, dtype=np.uint64)
    key, at, home = simhash.anchors(x)
    sent = {(int(k), int(i)) for k, i in zip(key, at)}
    homes = {}
    for k, i, h in zip(key, at, home):
        if h:
            homes.setdefault(int(i), []).append(int(k))
    assert all(len(v) == 2 for v in homes.values())
    for _ in range(400):
        i = int(rng.integers(300))
        y = x[i] ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, 3, replace=False)))
        k2, _, _ = simhash.anchors(np.array([y], np.uint64))
        assert set(map(int, k2)) & set(homes[i])
    assert len(sent) == len(key)


def test_classes_equal_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    odd = spark.createDataFrame(
        [(9001, None), (9002, ""), (9003, " \t"), (9004, "one two"), (9005, "one TWO"), (9006, "x " * 50000), (9007, "x " * 50001), (9006, "x " * 50000)],
        "doc_id long, text string",
    )
    rows = docs.select("doc_id", "text").union(odd)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.classes(rows.selectExpr("*", "1 AS fingerprint", "2 AS _fp")).collect()}
    want = {r.doc_id: plain_fingerprint(r.text) for r in rows.collect()}
    comp = plain_classes(list(want), list(want.values()))
    assert got == {d: (f"{want[d]:016x}", comp[d]) for d in want}


def test_large_groups_keep_their_links(spark):
    rng = np.random.default_rng(3)
    base = int(rng.integers(1 << 62))
    fps = {base}
    for _ in range(900):
        fps.add(base ^ sum(1 << int(b) for b in rng.choice(62, int(rng.integers(1, 5)), replace=False)))
    fps = sorted(fps)
    df = spark.createDataFrame([(f,) for f in fps], "_fp long")
    want = plain_classes(fps, fps)
    for hot in (64, 4096):
        root = {r.node: r.root for r in components(simhash.links(df, hot=hot)).collect()}
        assert {f: root.get(f, f) for f in fps} == want


def test_empty_and_null_ids(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.classes(empty).collect() == []
    rows = spark.createDataFrame([(None, "a b c"), (7, "a b c"), (None, "q r s t"), (3, "z"), (3, "z")], "doc_id long, text string")
    got = [(r.doc_id if r.doc_id is not None else -1, r.component_id) for r in simhash.classes(rows).collect()]
    assert [g for g in got if g[0] == 7] == [(7, 7)] and (-1, 7) in got and (-1, None) in got
    kept = simhash.drop_near_duplicates(rows, width=3)
    assert sorted((r.doc_id or -1, r.text) for r in kept.collect()) == [(-1, "q r s t"), (3, "z"), (7, "a b c")]


@pytest.mark.parametrize("edges,want", [([(1, 2), (2, 3), (5, 4)], {1: 1, 2: 1, 3: 1, 4: 4, 5: 4}), ([(i, i + 1) for i in range(40)], {i: 0 for i in range(41)}), ([], {})])
def test_components(spark, edges, want):
    df = spark.createDataFrame(edges, "a long, b long")
    assert {r.node: r.root for r in components(df).collect()} == want
