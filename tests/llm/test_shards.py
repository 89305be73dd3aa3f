import zlib
from collections import Counter, defaultdict

from tarmac.llm import shards


def check(rows, want, n=24):
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter((d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t in want)
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
        assert r.grown_shard is None
    assert set(slots) <= set(range(n)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    return slots


def test_sizes_are_near_equal(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    rows = shards.op8(spark, "/root/testdata/sf0.1").collect()
    check(rows, [(r.doc_id, r.text) for r in docs.collect()])
    size = Counter()
    for r in rows:
        size[r.shard] += r.size
    mean = sum(size.values()) / 24
    assert len(size) == 24 and max(abs(v - mean) for v in size.values()) <= 0.002 * mean + 1.01 * max(r.size for r in rows)
    of = defaultdict(set)
    for r in rows:
        of[r.text_crc32, r.size].add(r.shard)
    assert sum(len(s) > 1 for s in of.values()) <= 3  # groups stay together
    counts = Counter(r.shard for r in shards.assign(docs, law="rows").collect())
    assert max(counts.values()) - min(counts.values()) <= 1


def test_hot_group_and_odd_rows(spark):
    rows = [(i, "same text " * 20) for i in range(3000)] + [(i, f"text {i} " * (i % 7)) for i in range(3000, 6000)]
    rows += [(9000, "repeated")] * 2000 + [(None, "x"), (None, None), (9001, None), (9002, ""), (9003, "y" * 400_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS shard", "2 AS h", "3 AS size")
    got = shards.assign(docs, shards=5).collect()
    check(got, rows, 5)
    size = Counter()
    for r in got:
        size[r.shard] += r.size
    mean = sum(size.values()) / 5
    assert sorted(size.values())[1] >= 0.5 * mean or max(size.values()) <= mean + 400_008
    assert shards.assign(docs.where("false")).count() == 0
    assert len(shards.assign(docs.where("doc_id = 9001")).collect()) == 1
