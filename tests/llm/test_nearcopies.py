import random

import numpy as np

from tarmac.llm import simhash


def plain_kept(rows):
    """Smallest id of each class of texts linked at a Jaccard similarity of five-word shingles of 0.8 or more."""
    sets = []
    for _, t in rows:
        w = t.lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    top = list(range(len(rows)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if 5 * min(len(sets[i]), len(sets[j])) < 4 * max(len(sets[i]), len(sets[j])):
                continue
            both = len(sets[i] & sets[j])
            if sets[i] == sets[j] or 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                top[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(d, least.get(find(i), d))
    return set(least.values())


def test_near_copies_equal_brute_force(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefghij", k=4))
    rows = [(9000, ""), (9001, " \t"), (9002, "one two"), (9003, "one TWO")]
    for n, changes in ((60, 1), (100, 1), (200, 2), (400, 4), (200, 4), (400, 8), (100, 2), (100, 3)):
        for _ in range(25):
            own = [word() for _ in range(n)]
            copy = list(own)
            for i in rng.sample(range(5, n - 5), changes):
                copy[i] = word()
            rows += [(len(rows), " ".join(own)), (len(rows) + 1, " ".join(copy))]
    base = [word() for _ in range(120)]  # a large group, in which most pairs are under 0.8
    for _ in range(150):
        copy = list(base)
        for i in rng.sample(range(120), rng.randrange(5)):
            copy[i] = word()
        rows.append((len(rows), " ".join(copy)))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [r.doc_id for r in simhash.drop_near_copies(df).collect()]
    assert len(got) == len(set(got)) and set(got) == plain_kept(rows)
    # pieces of large groups meet as well
    ids, found = zip(*((d, simhash.shingle_set(t.encode())) for d, t in rows if t.split()), strict=True)
    nodes = spark.createDataFrame([(d, simhash.bands(s)) for d, s in zip(ids, found)], "_node long, _keys array<bigint>")
    sets = spark.createDataFrame([(d, s.view(np.int64).tolist()) for d, s in zip(ids, found)], "_node long, _set array<bigint>")
    sizes = []
    for few, hot in ((1, 16), (8, 1024)):
        root = {r.node: r.root for r in simhash.components(simhash.near_links(nodes, sets, few, hot)).collect()}
        sizes.append({d: root.get(d, d) for d in ids})
    assert sizes[0] == sizes[1]


def test_odd_rows(spark):
    rows = [(None, "a b c"), (7, "a b c"), (None, "q r s t"), (3, "z"), (3, "z"), (8, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = simhash.drop_near_copies(df)
    assert sorted((r.doc_id or -1, r.text or "") for r in kept.collect()) == [(-1, "q r s t"), (3, "z"), (7, "a b c"), (8, "")]
    assert simhash.drop_near_copies(df.where("false")).collect() == []
