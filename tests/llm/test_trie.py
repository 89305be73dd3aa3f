import hashlib
import zlib

import oracle
import pytest

from tarmac.llm import trie


def brute(convs):
    """The nodes of {conv: [(role, text)]}, each with its columns, by plain sets."""
    members, last = {}, {}
    for c, seq in convs.items():
        for d in range(len(seq) + 1):
            members.setdefault(seq[:d], []).append(c)
            last[seq[:d]] = len(seq[d - 1][1].encode()) if d else 0
    kids = {}
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)

    def below(p):
        todo, leaves, saved = [p], 0, 0
        while todo:
            q = todo.pop()
            todo += kids.get(q, [])
            leaves += q not in kids
            saved += (len(members[q]) - 1) * last[q]
        return leaves, saved

    out = []
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in m if convs[c] == p))
        up = min(members[p[:-1]]) if p else None
        out.append((min(m), len(p), up, len(m), len(kids.get(p, [])), *below(p), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def own(rows):
    convs = {}
    for c, t, r, x in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[1] is not None, r[1] or 0)):
        convs.setdefault(c, []).append((r or "", x or ""))
    return {c: tuple(s) for c, s in convs.items()}


def rebuilt(convs):
    out = {}
    for c, s in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = convs.get(c - c % 5, ())[:h] + s[h:]
    return out


KIND = "conv_id long, turn long, role string, text string"


def got(df):
    return sorted([tuple(r) for r in df.collect()], key=repr)


def test_query_equals_sql(spark, small):
    _, problems = oracle.compare(spark, oracle.connect(small), small, trie.op12, trie._SQL)
    assert not problems


def sample():
    rows = [(c, t, "u" if t % 2 else None, f"{c % k} {t}") for k, cs in ((2, range(0, 40)), (50, range(40, 60))) for c in cs for t in range(c % 7)]
    rows += [(c, t, "u", "same é") for c in range(100, 160) for t in range(12)]  # copies
    rows += [(c, t, "u", "same é") for c in range(160, 175) for t in range(12 + c % 3)]
    rows += [(200 + c, t, "u", f"long {t if t < 30 + c else (c, t)}") for c in range(4) for t in range(40)]
    rows += [(300, None, "a", ""), (300, 0, None, None), (301, None, "a", None), (7, 5, "x", "alone"), (None, 1, "u", "nobody")]
    return rows


@pytest.mark.parametrize("segment,block", [(256, 4096), (256, 7), (3, 5), (12, 1)])
def test_equals_brute_force(spark, segment, block):
    df = spark.createDataFrame(sample(), KIND).selectExpr("*", "1 AS pos", "2 AS conv", "3 AS idx", "4 AS size", "5 AS d").repartition(6)
    turns = trie.turns(df)
    heads = turns.select("conv").distinct().union(spark.createDataFrame([(999,), (998,)], "conv long"))
    convs = own(sample()) | {999: (), 998: ()}
    assert got(trie.nodes(turns, heads, segment, block)) == brute(convs)


def test_shared_conversations(spark):
    rows = sample() + [(c, t, "u", f"t{t}") for c in (1001, 1002, 1004) for t in range(2)]  # no base: turnless if h > 1
    df = spark.createDataFrame(rows, KIND)
    assert got(trie.shared_conversations(df)) == brute(rebuilt(own(rows)))
    assert trie.shared_conversations(df.limit(0)).count() == 0
    assert trie.shared_conversations(df.where("conv_id IS NULL")).count() == 0


def test_equal_turn_numbers_are_deterministic(spark):
    rows = [(c, 1, "u", x) for c in (0, 5) for x in ("a", "b", "b", None)]
    a = got(trie.nodes(trie.turns(spark.createDataFrame(rows, KIND)), spark.createDataFrame([(0,), (5,)], "conv long")))
    b = got(trie.nodes(trie.turns(spark.createDataFrame(rows[::-1], KIND).repartition(5)), spark.createDataFrame([(0,), (5,)], "conv long")))
    assert a == b and len(a) == 5 and {r[3] for r in a} == {2}
