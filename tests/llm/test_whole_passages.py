import random

import pytest
from test_decontaminate import brute

from tarmac.llm import decontaminate as D


@pytest.mark.parametrize("seed", [1, 2])
def test_passages_of_all_lengths_equal_brute_force(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefgh", k=5)).encode()
    sizes = (1, 2, 3, 4, 5, 6, 9, 13, 15, 17, 34, 44, 70)
    items = [(i, b" ".join(word() for _ in range(sizes[i % len(sizes)]))) for i in range(260)]
    items += [(1000 + i, b" ".join([*b"what is the answer to".split(), *(word() for _ in range(13))])) for i in range(40)]
    texts = []
    for k in range(900):
        own = rng.choice(items)[1].split()
        cut = rng.randrange(1 + len(own) // 8)
        if k % 3 == 1:  # cut at an end
            own = own[cut:] if rng.random() < 0.5 else own[: len(own) - cut]
        elif k % 3 == 2 and len(own) > 20:  # a word changed, left out or put in
            own[(i := rng.randrange(len(own))) : i + rng.randrange(2)] = [word()] * rng.randrange(2)
        texts.append(b" ".join([*(word() for _ in range(rng.choice((0, 3, 60)))), *own, *(word() for _ in range(rng.choice((0, 5, 90))))]))
    index = D.Index(items)
    got = {(k, h["item"]) for k, hits in enumerate(index.run(texts)) for h in hits}
    want = brute(texts, items)
    assert got == want and len(want) > 700
    # similarity and place are those of the best window
    own = dict(items)
    for k, hits in list(enumerate(index.run(texts)))[:200]:
        w = texts[k].split()
        for h in hits:
            v = own[h["item"]].split()
            best = max((D.similarity(D.shingles(v), D.shingles(w[a : a + len(v)])), -a) for a in range(max(1, len(w) - len(v) + 1)))
            assert (h["similarity"], -h["word"]) == best
