import zlib

from tarmac.llm import langid


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in langid.op4(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    held = [d for d in docs if zlib.crc32(str(d.doc_id).encode()) % 3 == 1]
    assert len(got) == len(docs) and all(got[d.doc_id].held_out for d in held)
    assert sum(got[d.doc_id].lang_pred == d.lang for d in held) / len(held) > 0.97
    assert sum(not r.rejected for r in got.values()) > 0.99 * len(docs)
    assert all(0 <= r.score <= 1 for r in got.values())


def test_odd_rows(spark):
    rows = [(1, None, "en", 5), (2, "", "en", 5), (3, "123 !!", None, 5), (None, "the cat and the dog", "en", 5), (5, "der Hund und die Katze", "de", 5),
            (5, "der Hund und die Katze", "de", 5), (6, "x" * 3_000_000, None, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    learned = langid.fit(docs)
    assert set(learned) == {"en", "de"}
    got = langid.identify(docs, learned, keep_text=True).collect()
    assert [r._lang for r in got if not r.text or r.doc_id == 3] == ["und"] * 3
    assert [r._lang for r in got if r.doc_id == 5] == ["de", "de"] and all(r.score == 5 for r in got)
    assert langid.identify(docs, {}).where("_lang <> 'und'").count() == 0
    assert langid.keep_identified(docs).columns == docs.columns
    empty = docs.where("false")
    assert langid.fit(empty) == {} and langid.keep_identified(empty).count() == 0
