"""Pages laid out and labelled by hand: main blocks stand between § signs."""

import re
import time
from collections import Counter

import pytest

from tarmac.llm import pagetext as P

H = "§The river came back to the valley this spring§"
A = "§After nine dry years the river returned in March, and with it came the herons that old people in the village remember.§"
B = "§Nobody had planned for it. The bridge had been sold for scrap, and the mill was a restaurant with tables on the former bank.§"
C = "§“We carried chairs all night,” said the owner, who has lived here since 1981.§"
D = "§Engineers now want to raise the road by a metre before autumn, which the council will discuss next week.§"
NAV = '<a href="/">Home</a> <a href="/news">News</a> <a href="/sport">Sport</a>'
LIST = '<ul><li><a href="/a">Politics</a></li><li><a href="/b">Weather</a></li><li><a href="/c">Travel guide</a></li></ul>'
TEASER = "<h3>Most read</h3><p><a href=/x>Ten gardens to see this summer</a></p><p><a href=/y>Why bread costs more</a></p>"
COOKIE = "<p>We use cookies to improve your visit.</p><button>Accept</button>"
FOOT = "&copy; 2021 Valley Courier. All rights reserved."
PS = f"<p>{A}</p><p>{B}</p><p>{C}</p><p>{D}</p>"
TALK = "<h3>2 comments</h3><ul><li><b>anna</b><p>Lovely piece, thank you.</p></li><li><b>ben</b><p>My mother worked in that mill.</p></li></ul>"
PAGES = {
    "article": f"<nav>{LIST}</nav><article><h1>{H}</h1>{PS}</article><footer>{FOOT}</footer>",
    "ends in the article": f"<nav>{LIST}</nav><article><h1>{H}</h1>{PS}</article>",
    "main": f"<header><p>Valley Courier</p></header><main><h1>{H}</h1>{PS}</main><footer><p>{FOOT}</p></footer>",
    "plain div": f"<div id=nav>{LIST}</div><div><h1>{H}</h1>{PS}</div>",
    "plain div and footer": f"<div id=nav>{LIST}</div><div><h1>{H}</h1>{PS}</div><div id=footer>{FOOT}</div>",
    "words of other parts": f'<nav>{LIST}</nav><div class="tag-politics post"><h1>{H}</h1>{PS}</div>',
    "promo off": f'<nav>{LIST}</nav><article class="share-enabled promo-off"><h1>{H}</h1>{PS}</article><footer>{FOOT}</footer>',
    "form round the page": f'<form id="aspnetForm"><div class="menu">{LIST}</div><article><h1>{H}</h1>{PS}</article><div class="footer">{FOOT}</div></form>',
    "form round a div": f'<form><div class="menu">{LIST}</div><div id="content"><h1>{H}</h1>{PS}</div></form>',
    "table": f"<table><tr><td width=150>{LIST}</td><td><h1>{H}</h1>{PS}</td></tr></table>",
    "table and footer": f"<table><tr><td>{LIST}</td><td><h1>{H}</h1>{PS}</td></tr><tr><td>{FOOT}</td></tr></table>",
    "rail": f'<div class="bar">{NAV}</div><div class="layout"><div class="story"><h1>{H}</h1>{PS}</div><div class="rail">{TEASER}</div></div>',
    "side before": f'<div class="wrap"><div id="sidebar">{TEASER}</div><div id="content"><h1>{H}</h1>{PS}</div></div>',
    "aside after": f"<header>{NAV}</header><main><article><h1>{H}</h1>{PS}</article><aside>{TEASER}</aside></main>",
    "cookies": f'<div class="cookie-banner">{COOKIE}</div><article><h1>{H}</h1>{PS}</article>',
    "late notice": f'<article><h1>{H}</h1>{PS}</article><div class="consent" role="dialog">{COOKIE}</div>',
    "advert inside": f'<article><h1>{H}</h1><p>{A}</p><p>{B}</p><div class="advert"><p>Buy two tyres, get one free.</p></div><p>{C}</p><p>{D}</p></article>',
    "newsletter inside": f'<article><h1>{H}</h1><p>{A}</p><form class="newsletter"><p>Get our letter every Friday.</p><input><button>Go</button></form><p>{B}</p><p>{D}</p></article>',
    "comments": f'<article><h1>{H}</h1>{PS}</article><section class="comments">{TALK}</section>',
    "comments in a div": f'<div class="post"><h1>{H}</h1>{PS}</div><div id="comments">{TALK}</div><div id="footer">{FOOT}</div>',
    "comments inside": f'<article><h1>{H}</h1>{PS}<div class="comment-list">{TALK}</div></article>',
    "header inside": f"<nav>{LIST}</nav><article><header><h1>{H}</h1></header>{PS}</article><footer>{FOOT}</footer>",
    "subheads": f"<nav>{LIST}</nav><article><h1>{H}</h1><p>{A}</p><h2>§A bridge too few§</h2><p>{B}</p><p>{C}</p><h2>§What comes next§</h2><p>{D}</p></article>",
    "list inside": f"<nav>{LIST}</nav><article><h1>{H}</h1><p>{A}</p><ul><li>§Raise the road by one metre.§</li><li>§Move the tables to the hill.§</li></ul><p>{D}</p></article>",
    "quote inside": f"<header>{NAV}</header><article><h1>{H}</h1><p>{A}</p><blockquote><p>{C}</p></blockquote><p>{D}</p></article>",
    "deep": f'<div><div><div class="grid"><div class="col"><div>{LIST}</div></div><div class="col"><div><div><h1>{H}</h1>{PS}</div></div></div></div></div></div>',
    "divs for paragraphs": f"<div class=top>{NAV}</div><div class=text><h1>{H}</h1><div>{A}</div><div>{B}</div><div>{C}</div><div>{D}</div></div><div class=bottom>{FOOT}</div>",
    "unclosed": f"<body>{LIST}<div><h1>{H}</h1><p>{A}<p>{B}<p>{C}<p>{D}",
    "no heading": f"<nav>{LIST}</nav><article>{PS}</article><footer>{FOOT}</footer>",
    "search and share": f'<form class="search"><label>Search</label><input></form><article><h1>{H}</h1>{PS}</article><div class="share"><a href=f>Share on F</a> <a href=t>Share on T</a></div>',
}


def score(text, want):
    a, b = Counter(text.split()), Counter(want.split())
    return 2 * sum((a & b).values()) / max(1, a.total() + b.total())


@pytest.fixture(scope="module", params=["sf0.001", "sf0.01"])
def crf(spark, request):
    return P.learn(spark.read.parquet(f"/root/testdata/{request.param}/pages.parquet"))


def test_hand_labelled_layouts(crf):
    found = {name: score("\n\n".join(crf.extract(page.replace("§", ""))), "\n\n".join(re.findall("§(.*?)§", page))) for name, page in PAGES.items()}
    print(sorted(found.items(), key=lambda x: x[1])[:12])
    assert sum(found.values()) / len(found) >= 0.95
    for name in ("plain div", "words of other parts", "table", "promo off", "form round the page", "ends in the article"):
        assert found[name] >= 0.95, name


def test_time_grows_with_the_length(crf):
    start = time.perf_counter()
    for page in ("<div>" * 200_000 + "end", "<div>a " * 60_000, "<b>a<i>" * 60_000 + "</i>" * 60_000, "<button>x" * 100_000, "<ul><li>a" * 40_000, "<a href=x>y" * 80_000):
        crf.extract(page)
    assert time.perf_counter() - start < 60
