import random

from tarmac.llm import decontaminate as D


def brute(texts, items):
    """Items whose best window of their own length has a weighted Jaccard similarity of 0.8 or more."""
    own = {i: t.lower().split() for i, t in items if t.split()}
    found = set()
    for k, text in enumerate(texts):
        w = text.lower().split()
        have = set(D.shingles(w)) | set(tuple(w[i : i + n]) for n in range(1, 5) for i in range(len(w)))
        for i, v in own.items():
            s = D.shingles(v)
            if have & set(s) and any(D.similarity(s, D.shingles(w[a : a + len(v)])) >= 0.8 for a in range(max(1, len(w) - len(v) + 1))):
                found.add((k, i))
    return found


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    items = [(r.item_id, r.text.encode()) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    want = {(docs[k].doc_id, i) for k, i in brute([d.text.encode() for d in docs], items)}
    got = D.op7(spark, sf).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want) > 10


def test_edited_passages():
    rng = random.Random(2)
    word = lambda: "".join(rng.choices("abcdefgh", k=5)).encode()
    items = [(i, b" ".join(word() for _ in range(rng.choice((1, 2, 3, 5, 9, 16, 31, 44, 70))))) for i in range(120)]
    texts = []
    for _ in range(300):
        own = list(items[rng.randrange(120)][1].split())
        if len(own) > 40 and rng.random() < 0.5:
            own[rng.choice((0, 1, len(own) - 1, len(own) // 2))] = word()
        elif len(own) > 20 and rng.random() < 0.5:
            own = own[1:]
        texts.append(b" ".join([*(word() for _ in range(rng.choice((0, 3, 200)))), *own, *(word() for _ in range(rng.choice((0, 5, 90))))]).upper())
    index = D.Index(items)
    got = {(k, h["item"]) for k, hits in enumerate(index.run(texts)) for h in hits}
    want = brute(texts, items)
    assert got <= want and len(got) >= 0.99 * len(want) > 250
    assert index.run([b" ".join(texts)], budget=100)[0] and {h["item"] for h in index.run([b"q " * 600_000 + texts[0]])[0]} == {i for k, i in got if k == 0}


def test_odd_rows_and_passes(spark):
    docs = spark.createDataFrame([(1, "x a b c d e f g y", 1), (2, None, 1), (3, "", 1), (None, "A B C D E F G", 1), (1, "x a b c d e f g y", 1)], "doc_id long, text string, _x int")
    items = spark.createDataFrame([(7, "a b c d e f g"), (8, "a b c d e f g"), (None, "zz"), (9, None), (10, "")], "item_id long, text string")
    for at_once in (1, 50):
        got = sorted((r.doc_id or 0, [h["item"] for h in r._hits]) for r in D.find(docs, items, at_once=at_once).collect())
        assert [(d, sorted(h)) for d, h in got] == [(0, [7, 8]), (1, [7, 8]), (1, [7, 8]), (2, []), (3, [])]
    assert sorted(r.doc_id for r in D.drop_contaminated(docs, items).collect()) == [2, 3]
    assert D.find(docs, items.where("false")).where("size(_hits) > 0").count() == 0
    assert D.find(docs.where("false"), items).count() == 0
