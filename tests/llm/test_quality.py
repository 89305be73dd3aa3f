import zlib

from tarmac.llm import quality


def auc(pairs):
    pos, neg = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    got = {r.doc_id: r for r in quality.op9(spark, sf).collect()}
    assert len(got) == 10000 and all(0 <= r.score <= 1 for r in got.values())
    held = [(got[r.doc_id].score, r.quality) for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    right = sum((s >= 0.5) == y for s, y in held) / len(held)
    lost = sum(s < 0.5 for s, y in held if y) / sum(y for _, y in held)
    print("auc", auc(held), "right", right, "good lost", lost)
    assert auc(held) > 0.97 and right > 0.95 and lost < 0.02


def test_odd_rows(spark):
    docs = spark.createDataFrame(
        [(1, "good words here", 3), (2, "*** !!! ###", 3), (None, None, 3), (4, "", 3), (4, "", 3), (5, "w " * 1_200_000, 3)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(1, 1, "x"), (2, 0, "x"), (2, None, "x"), (9, 1, "x")], "doc_id long, quality int, text string")
    model = quality.fit(docs, labels)
    got = quality.score(docs, model, keep_text=True).collect()
    assert len(got) == 6 and all(0 <= r._score <= 1 and r.score == 3 for r in got)
    assert quality.fit(docs, labels.where("quality = 1")) is None
    assert {r._score for r in quality.score(docs, None).collect()} == {0.5}
    assert quality.keep_good(docs.where("false"), labels).columns == docs.columns
