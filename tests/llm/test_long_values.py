import time

import pytest

from tarmac.llm import pagetext as P


@pytest.mark.parametrize("q", "\"'")
def test_long_quoted_values_are_not_text(q):
    page = f"<p>Hello <img src={q}data:{'A' * 150_000}{q}> world</p>"
    assert [x.text for x in P.leaves(page)] == ["Hello world"]


def test_unclosed_values_take_linear_time():
    start = time.perf_counter()
    for page in ("<a b=\"" * 200_001, "<a b='<i c=\"" * 100_001, "<b" + " x=\"y\"" * 200_000):
        list(P.leaves(page))
    assert time.perf_counter() - start < 30


def test_sample_is_drawn_from_pages_with_mark_up(spark):
    plain = [(i, f"<div><p>page {i} of plain text without mark-up</p></div>") for i in range(600)]
    nav = "<nav><ul><li><a href=x>Home</a></li><li><a href=y>News</a></li></ul></nav>"
    long = [(1000 + i, f"<body>{nav}<article><p>{f'A long story number {i} goes on, and on. ' * 6000}</p></article><footer>Contact us</footer></body>") for i in range(3)]
    df = spark.createDataFrame(plain + long, "page_id long, html string")
    assert P.learn(df, sample=10) is not None
    with pytest.raises(ValueError):
        P.learn(df.where("page_id < 1000"))
    assert P.learn(df.where("false")) is None
