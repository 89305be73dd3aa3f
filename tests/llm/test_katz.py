import math
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tarmac.llm import katz


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in __import__("re").split("[\x20\x09-\x0d]+", low) if w]


class Plain:
    """The same model with dictionaries."""

    def __init__(self, texts):
        self.one, self.two = Counter(), Counter()
        for t in texts:
            w = ["<s>", *words(t), "</s>"]
            self.one.update(w[1:])
            self.two.update(zip(w, w[1:]))
        self.n, self.v, self.starts = self.one.total(), len(self.one), len(texts)
        of = lambda c: [sum(x == r for x in c.values()) for r in range(1, katz.CUTOFF + 2)]
        self.l1, self.l2 = katz.Level(of(self.one)), katz.Level(of(self.two))
        self.after = {}
        for (h, w), c in self.two.items():
            self.after.setdefault(h, {})[w] = c

    def left(self, c, level):
        return c * level.d[c] if c <= katz.CUTOFF else c

    def p1(self, w):
        c = self.one[w]
        return (self.left(c, self.l1) if c else self.l1.left + katz.RESERVE) / (self.n + katz.RESERVE)

    def p2(self, h, w):
        seen = self.after.get(h)
        if not seen:
            return self.p1(w)
        ch = self.starts if h == "<s>" else self.one[h]
        if w in seen:
            return self.left(seen[w], self.l2) / (ch + katz.RESERVE)
        mass = 1 - sum(self.left(c, self.l2) for c in seen.values()) / (ch + katz.RESERVE)
        return mass / (1 - sum(map(self.p1, seen))) * self.p1(w)

    def score(self, t):
        w = ["<s>", *words(t), "</s>"]
        return sum(math.log10(self.p2(a, b)) for a, b in zip(w, w[1:]))

    def base(self, t):
        return sum(math.log10((self.one[w] + 0.5) / (self.n + 0.5 * (self.v + 1))) for w in [*words(t), "</s>"])


def test_model_is_normalised():
    m = Plain(["a b c a b", "a b d", "b b b b b b b b b", "x", ""])
    for h in ["a", "b", "x", "<s>", "never"]:
        assert abs(sum(m.p2(h, w) for w in [*m.one, "unknown"]) - 1) < 1e-12


@pytest.mark.parametrize("chunk,bits", [(1 << 22, 6), (3000, 2)])
def test_scores_equal_a_plain_model(spark, small, chunk, bits):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(9001, None), (9002, ""), (9003, "The the THE zzz"), (None, "of the"), (9003, "The the THE zzz")], "doc_id long, text string")
    rows = docs.union(odd).selectExpr("*", "1 AS score", "2 AS _id")
    got = katz.score(rows, katz.fold("doc_id", 5) != 1, chunk_tokens=chunk, bits=bits).collect()
    all_rows = [(r.doc_id, r.text) for r in rows.collect()]
    held = lambda d: zlib.crc32(str(d if d is not None else "").encode()) % 5 == 1
    m = Plain([t for d, t in all_rows if not held(d)])
    assert len(got) == len(all_rows)
    want = Counter((d, held(d), len(words(t)) + 1, sum(m.one[w] > 0 for w in [*words(t), "</s>"]), m.n) for d, t in all_rows)
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens) for r in got) == want
    text = dict(all_rows)
    for r in got:
        assert math.isclose(r.score, m.score(text[r.doc_id]), rel_tol=1e-9) and math.isclose(r.base_score, m.base(text[r.doc_id]), rel_tol=1e-9)
    unseen = [r for r in got if r.held_out and r.doc_id and r.doc_id < 9000]
    assert sum(r.score for r in unseen) > sum(r.base_score for r in unseen)


def test_empty_and_untrained(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    assert katz.score(docs.where("false"), F.lit(True)).count() == 0
    got = {r.doc_id: r for r in katz.score(docs, F.lit(False)).collect()}
    assert [got[1].score, got[1].base_score, got[1].train_tokens, got[2].n_tokens] == [0.0, 0.0, 0, 1]


def test_pack_round_trip():
    import numpy as np

    rng = np.random.default_rng(1)
    a = [np.sort(rng.integers(0, 2**64, 900, dtype=np.uint64)), rng.random(7), np.zeros(0, np.uint8), np.array([3], np.uint64), np.array([True, False])]
    assert all((x == y).all() and x.dtype == y.dtype for x, y in zip(a, katz.unpack(katz.pack(*a)), strict=True))
