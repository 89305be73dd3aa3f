import zlib

import numpy as np
from tokenizers import Tokenizer

from tarmac.llm import tokenfile

TOOL = Tokenizer.from_file(tokenfile.gpt_path())


def test_added_tokens_have_the_librarys_ids(spark):
    texts = ["a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|> x", "<|endoftext|", "a<|endoftext|>'s\n", " plain", "", "ab <|endoftext|> cd " * 90_000]
    assert TOOL.encode(texts[0], add_special_tokens=False).ids == [64, 220, 50256, 275]
    want = [TOOL.encode(t, add_special_tokens=False).ids for t in texts]
    assert [x.tolist() for x in tokenfile.Tokens(tokenfile.gpt_path(), added=True).encode(texts)] == want
    folder = tokenfile.new_folder(spark)
    files = tokenfile.write(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), folder, tokenfile.gpt_path(), 2)
    got = {r.doc_id: (r.n_tokens, r.ids_crc32) for r in tokenfile.read(files, folder, digest=True).collect()}
    assert got == {d: (len(x) + 1, zlib.crc32(np.array([*x, 2], "<u4").tobytes())) for d, x in enumerate(want)}
