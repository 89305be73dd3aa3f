import hashlib
import random

import numpy as np
import public_tokenizers
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tarmac.llm import bpe

RANKS = bpe.load(open(bpe.multi_path(), "rb").read())
TOOL = bpe.Encoder(RANKS)
REFERENCE = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def ids(text):
    return np.frombuffer(next(iter(TOOL.encode([text]))), "<u4").tolist()


ODD = ["", " ", "  ", "'s", " 's", "it's", "don't've 'llama'll'", "\n's", "!'s", "''s", "'s's'd", "a  b", "a \n b\n", "\n\nx ", "x 's", "　 a", "1'2'm",
       "<|endoftext|>", "'ł", "\0a\0", "éa", "你好 123½", "a'", "'r", "'re", "'rex", "  'tis", "\x85\x1c x", "\U0001f600's"]


def test_equals_library_on_odd_texts():
    for t in ODD:
        assert ids(t) == REFERENCE.encode_ordinary(t), repr(t)
    together = [np.frombuffer(x, "<u4").tolist() for x in TOOL.encode(ODD)]
    assert together == [REFERENCE.encode_ordinary(t) for t in ODD]


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(), st.text(alphabet="a1 '\n!stremvldé\t "), st.lists(st.sampled_from([" ", "'s", "'ll", "ab", "12", "!?", "\n", "'", "　"])).map("".join)))
def test_equals_library(text):
    assert ids(text) == REFERENCE.encode_ordinary(text)
    packed = next(iter(TOOL.encode([text])))
    assert TOOL.decode(packed) == text.encode()


def test_scan_is_the_serial_product():
    f = np.array([random.Random(5).randrange(5) for _ in range(9000)], np.uint8)
    want = [f[0]]
    for g in f[1:]:
        want.append(bpe.PRODUCT[8 * int(want[-1]) + int(g)])
    assert (bpe.scan(f) == np.array(want)).all()


def test_long_text_and_full_cache():
    rng = random.Random(4)
    text = " ".join("".join(rng.choices("abcdetion", k=rng.randrange(1, 12))) for _ in range(400_000))
    small = bpe.Encoder(RANKS, keep=100)
    assert np.frombuffer(next(iter(small.encode([text]))), "<u4").tolist() == REFERENCE.encode_ordinary(text)


def test_query(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    rows = docs.union(spark.createDataFrame([(9001, None), (9002, ""), (9002, "")], docs.schema)).selectExpr("*", "'x' AS _n")
    got = sorted(tuple(r) for r in bpe.token_digests(rows, bpe.multi_path()).collect())
    want = []
    for r in rows.collect():
        x = REFERENCE.encode_ordinary(r.text or "")
        want.append((r.doc_id, len(x), hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    assert got == sorted(want)
    assert bpe.token_digests(docs.where("false"), bpe.multi_path()).count() == 0


def test_encode_decode_frames(spark):
    docs = spark.createDataFrame([(1, "It's a café."), (2, None)], "doc_id long, text string")
    out = bpe.decode(bpe.encode(docs, bpe.multi_path()), bpe.multi_path()).orderBy("doc_id").collect()
    assert bytes(out[0]._bytes).decode() == "It's a café." and out[0]._ids == REFERENCE.encode_ordinary("It's a café.")
    assert out[0]._offsets[0] == 0 and out[1]._ids == []
