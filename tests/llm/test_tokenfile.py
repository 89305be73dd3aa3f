import io
import random
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pytest
from tokenizers import Tokenizer

from tarmac.llm import tokenfile

TOOL = Tokenizer.from_file(tokenfile.gpt_path())
TOOL.encode_special_tokens = True


def plain(rows, end=2):
    """doc_id, start, n_tokens, crc32 of each row in ascending id order."""
    out, start = [], 0
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array([*TOOL.encode(t or "", add_special_tokens=False).ids, end], "<u4")
        out.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_slices_give_the_librarys_ids():
    rng = random.Random(6)
    texts = ["", "<|endoftext|> a", "it's  'S\n\n x", "　a \t b\x85c", "\n", "'s", " 's"] + [
        "".join(rng.choices([" ", "\n", "a", "Bc", "'ll", "'", "1", "é", "!?", "\t", "你"], k=rng.randrange(30))) for _ in range(500)]
    got = tokenfile.Tokens(tokenfile.gpt_path()).encode(texts)
    assert [g.tolist() for g in got] == [TOOL.encode(t, add_special_tokens=False).ids for t in texts]


def test_query_round_trip(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    got = sorted(tuple(r) for r in tokenfile.op6(spark, small).collect())
    assert got == plain([tuple(r) for r in docs])


def test_odd_rows_and_selective_reading(spark):
    rows = [(5, "five"), (None, "none"), (3, None), (4, ""), (9, "ab cd " * 250_000), (7, "x y"), (7, "x y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS i", "2 AS h")
    folder = tokenfile.new_folder(spark)
    files = tokenfile.write(docs, folder, tokenfile.gpt_path(), 2, frame_ids=100)
    got = sorted((tuple(r) for r in tokenfile.read(files, folder, digest=True).collect()), key=lambda r: r[1])
    assert got == plain(rows)
    some = tokenfile.read(files, folder, only=[7, 4]).collect()
    assert sorted((r.doc_id, list(r.ids)) for r in some) == [(4, [2]), *[(7, [*TOOL.encode("x y").ids, 2])] * 2]
    empty = tokenfile.write(docs.where("false"), folder, tokenfile.gpt_path(), 2)
    assert empty.count() == 0 and tokenfile.read(empty, folder, digest=True).count() == 0


def test_reader_opens_only_the_frames_it_needs():
    out = io.BytesIO()
    w = tokenfile.Writer(out, 2, frame_ids=50)
    want = [np.random.default_rng(d).integers(0, 50000, n, dtype=np.uint32) for d, n in enumerate((10, 60, 0, 5000, 3, 70))]
    for d, ids in enumerate(want):
        w.add(d * 10, ids)
    w.close()
    r = tokenfile.Reader(pa.BufferReader(out.getvalue()))
    assert [x.tolist() for x in r.find(50)] == [want[5].tolist()] and r.opened == 1
    assert all((r.document(d) == x).all() for d, x in enumerate(want))
    bad = bytearray(out.getvalue())
    bad[r.at[0] + 20] ^= 1
    with pytest.raises(Exception):
        tokenfile.Reader(pa.BufferReader(bytes(bad))).document(0)
