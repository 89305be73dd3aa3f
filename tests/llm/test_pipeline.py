import test_decontaminate
import test_nearcopies

import corpus_pipeline
from tarmac.llm import langid, quality
from tarmac.llm.common import prepare
from tarmac.session import stage


def test_stages(spark):
    sf = "/root/testdata/sf0.01"
    prepare(spark)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    at = [docs]
    for name, step in corpus_pipeline.STAGES[:-1]:
        at.append(stage(step(spark, at[-1], sf)))
        assert at[-1].columns == docs.columns, name
    rows = [{r.doc_id: r.text for r in d.collect()} for d in at]
    assert all(set(b) <= set(a) for a, b in zip(rows, rows[1:]))
    # language: what goes is what the operator rejects
    learned = langid.fit(docs.where("crc32(cast(doc_id as string)) % 3 <> 1"))
    gone = {r.doc_id for r in langid.identify(docs, learned).collect() if r._rejected}
    assert set(rows[0]) - set(rows[1]) == gone and len(gone) < 20
    # quality: labelled rows mostly stay or go as labelled
    y = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    good = [d for d in rows[1] if y.get(d) == 1]
    assert sum(d in rows[2] for d in good) > 0.97 * len(good)
    bad = [d for d in rows[1] if y.get(d) == 0]
    assert sum(d in rows[2] for d in bad) < 0.2 * len(bad)
    assert quality.DIM
    # near duplicates: the smallest id of each class of a brute-force search
    assert set(rows[3]) == test_nearcopies.plain_kept([(d, rows[2][d]) for d in sorted(rows[2])])
    # contamination: as a brute-force search has it
    ids = sorted(rows[3])
    items = [(r.item_id, r.text.encode()) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    hit = {ids[k] for k, _ in test_decontaminate.brute([rows[3][d].encode() for d in ids], items)}
    assert set(rows[4]) == set(ids) - hit and hit
    last = corpus_pipeline.STAGES[-1][1](spark, at[-1], sf).collect()
    assert {r.doc_id for r in last} == set(rows[4])
    assert sorted(tuple(r) for r in last) == sorted(tuple(r) for r in corpus_pipeline.run(spark, sf).collect())
