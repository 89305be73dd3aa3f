import html
import itertools
import random
import re

from tarmac.llm import pagetext as P


def plain(page):
    """The article of the sample pages, by their one layout."""
    body = re.search(r"<article>(.*)</article>", page, re.S)[1]
    parts = (" ".join(html.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split("</?(?:p|h1)>", body))
    return "\n\n".join(b for b in parts if b)


def test_query_gives_the_articles(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.page_id: r for r in P.op2(spark, sf).collect()}
    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    assert len(got) == len(pages) and all(r.n_chars == len(r.text) for r in got.values())
    assert sum(got[p.page_id].text == plain(p.html) for p in pages) >= 0.99 * len(pages)


def test_other_layouts_held_out(spark, small):
    pages = [r.html for r in spark.read.parquet(f"{small}/pages.parquet").collect()]
    crf = P.fit(P.labelled(pages[:30]))
    right = total = 0
    for page in P.labelled(pages[30:], seed=9):
        found = crf.decode(crf.scores([x for x, _ in page]))
        right += sum(a == b for a, (_, b) in zip(found, page))
        total += len(page)
    assert right / total > 0.98


def test_viterbi_is_the_best_path():
    rng = random.Random(1)
    for _ in range(60):
        crf = P.Crf({}, [[rng.gauss(0, 2) for _ in "ab"] for _ in "ab"], [rng.gauss(0, 1), 0.3], [0.1, rng.gauss(0, 1)])
        s = [rng.gauss(0, 2) for _ in range(rng.randrange(1, 8))]

        def value(path):
            return (crf.starts[path[0]] + crf.stops[path[-1]] + sum(s[i] for i, p in enumerate(path) if p)
                    + sum(crf.moves[a][b] for a, b in zip(path, path[1:])))

        assert crf.decode(s) == list(map(bool, max(itertools.product((0, 1), repeat=len(s)), key=value)))


def test_leaves_of_odd_mark_up():
    page = """<!DOCTYPE html><HTML><head><title>no</title><script>var x = "<p>no</p>";</script><style>p{}</style></head>
    <body><!-- <p>no</p> --><p>one &amp; two<br>three <a href='x>y'>link</a><p>four<ul><li>five<li>six</ul>se<b>ven</b> &lt;p&gt; 3 < 4</p>
    <div class="ad x">eight</div><p>&#233;&nbsp;end"""
    got = [(x.text, x.path[-1]) for x in P.leaves(page)]
    assert [t for t, _ in got] == ["one & two three link", "four", "five", "six", "seven <p> 3 < 4", "eight", "é end"]
    assert got[5][1] == ("div", "ad", "x")


def test_odd_rows(spark, small):
    crf = P.learn(spark.read.parquet(f"{small}/pages.parquet"))
    rows = [(1, None), (2, ""), (3, "just words"), (4, "<p>"), (5, "<article><p>" + "long text here. " * 200_000 + "</p></article>"), (5, "<script>"), (6, "<b" * 3000), (7, "<!--"), (8, "</p></div>" * 1000)]
    df = spark.createDataFrame(rows, "page_id long, html string").selectExpr("*", "1 AS text", "2 AS _t")
    got = {(r.page_id, len(r._text)) for r in P.extract(df, crf).collect()}
    assert {(1, 0), (2, 0), (4, 0), (7, 0), (8, 0)} <= got and any(d == 5 and n > 3_000_000 for d, n in got)
    assert P.learn(df.where("false")) is None and P.extract(df, None).where("_text <> ''").count() == 0
