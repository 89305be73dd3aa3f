import hashlib

import numpy as np
import oracle
import pytest

from tarmac.llm import codes


def brute(rows, entries, rounds, parts=4):
    """Plain loops over Python integers: ({id: (code, error)}, entries' sha256)."""
    kept = [(i, [int(np.floor(1024 * x)) for x in v]) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    dim = len(kept[0][1])
    cut = [dim * p // parts for p in range(parts + 1)]
    book = [[v[a:b] for _, v in kept[:entries]] for a, b in zip(cut, cut[1:])]

    def assign(v):
        out = []
        for p in range(parts):
            x = v[cut[p] : cut[p + 1]]
            out.append(min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book[p])))
        return out

    for _ in range(rounds):
        got = [assign(v) for _, v in kept]
        new = [list(b) for b in book]
        for p in range(parts):
            for k in range(len(book[p])):
                mine = [v[cut[p] : cut[p + 1]] for (_, v), a in zip(kept, got) if a[p][1] == k]
                if mine:
                    new[p][k] = [sum(c) // len(mine) for c in zip(*mine)]
        book = new
    text = ",".join(str(c) for b in book for e in b for c in e)
    found = [(i, "".join(f"{k:02x}" for _, k in assign(v)), sum(f for f, _ in assign(v))) for i, v in kept]
    return sorted(found, key=repr), hashlib.sha256(text.encode()).hexdigest()


def test_query_equals_sql(spark, small):
    _, problems = oracle.compare(spark, oracle.connect(small), small, codes.op13, codes._sql())
    assert not problems


@pytest.mark.parametrize("dim", [8, 10, 3])
def test_odd_rows_equal_brute_force(spark, dim):
    rng = np.random.default_rng(dim)
    rows = [(i, rng.normal(0, 1, dim).round(3).tolist()) for i in range(300)]
    rows += [(None, rng.normal(0, 1, dim).tolist()), (7, rows[7][1]), (7, rows[9][1]), (-5, [-0.25] * dim), (-5, [0.5] * dim)] + [(500 + i, rows[3][1]) for i in range(90)]
    odd = [(900, None), (901, [None] * dim), (902, [float("nan")] * dim), (903, [float("inf")] + [0.0] * (dim - 1))]
    df = spark.createDataFrame([(i, v, None if j % 3 == 0 else j % 2) for j, (i, v) in enumerate(rows + odd)], "vec_id long, embedding array<double>, label int")
    df = df.selectExpr("*", "1 AS id", "2 AS code", "3 AS error", "4 AS payload", "5 AS n", "6 AS v").repartition(5)
    coded, books = codes.encode(df, entries=20, rounds=3, block_rows=64)
    want, digest = brute(rows + odd, 20, 3)
    assert sorted([(r.id, r.code, r.error) for r in coded.collect()], key=repr) == want
    assert codes.sha256(books) == digest


def test_label_errors(spark):
    rows = [(i, None if i < 40 else i // 50, "00", i) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, label int, code string, error long")
    want = {}
    for _, k, _, e in rows:
        want[k] = want.get(k, 0) + e
    for hot in (2, 3, 1024):  # all labels rare, some, all frequent
        got = codes.label_errors(df, hot).collect()
        assert sorted((r.id, r.label_error) for r in got) == [(i, want[k]) for i, k, _, _ in rows]


def test_empty_tables_and_refusals(spark):
    kind = "vec_id long, embedding array<float>, label int"
    none = spark.createDataFrame([(1, None, 1), (2, [None, 1.0], 1)], kind)
    coded, books = codes.encode(none)
    assert codes.label_errors(coded).count() == 0 and books == [] and codes.encode(none.limit(0))[0].count() == 0
    assert [tuple(r) for r in codes.encode(spark.createDataFrame([(1, [], 2)], kind))[0].collect()] == [(1, 2, "00000000", 0)]
    for bad in ([(1, [1.0], 1), (2, [1.0, 2.0], 1)], [(1, [1e9], 1)]):
        with pytest.raises(ValueError):
            codes.encode(spark.createDataFrame(bad, kind))
