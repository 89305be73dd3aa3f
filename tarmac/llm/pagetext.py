"""Main text of web pages: a linear-chain CRF over the DOM's leaf blocks, decoded by Viterbi."""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmac.llm.common import annotate, query, table

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/><]*+)((?:[^><\"']|\"[^\"]*+\"|'[^']*+')*+)>|[^<]+|<", re.S)
_NAMES = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_PART = re.compile(r"[A-Za-z]+")
#: Fixed values of HTML: elements that end a block, that have no end tag, whose content is not text, that close an open p.
BLOCK = frozenset("""address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form
 h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul""".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript template iframe svg math select option button object audio video canvas".split())
_ENDS_ITSELF = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
_SCOPE = frozenset("ul ol dl table".split())


#: Of a block's ancestors the nearest so many give features; the mark-up may be nested to any depth.
NEAREST = 32


@dataclass(slots=True)
class Leaf:
    """A leaf block: its nearest ancestors (outermost first, each a tag and its class and id words), text, letters in links.

    wide: how many of these ancestors hold at least half of the page's unlinked text, and an h1 if the page has one;
    share: of the page's text, what the outermost other ancestor holds; place: before, in or after the first h1.
    """

    path: tuple[tuple[str, ...], ...]
    text: str
    linked: int
    wide: int = 0
    share: float = 0.0
    place: str = "none"


class _Open:
    """The open elements, with the places of each tag among them, so that no step walks through all of them."""

    def __init__(self) -> None:
        self.nodes: list[int] = []
        self.tags: list[str] = []
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []

    def last(self, names: Iterable[str]) -> int:
        return max((self.places[n][-1] for n in names if self.places.get(n)), default=-1)

    def push(self, name: str, node: int) -> None:
        at = len(self.nodes)
        self.places.setdefault(name, []).append(at)
        if name in BLOCK:
            self.blocks.append(at)
        self.nodes.append(node)
        self.tags.append(name)

    def cut(self, at: int) -> None:
        while len(self.nodes) > at:
            self.nodes.pop()
            name = self.tags.pop()
            self.places[name].pop()
            if name in BLOCK:
                self.blocks.pop()


def leaves(page: str) -> list[Leaf]:
    """The blocks of a page with text, in order. Unclosed and stray tags are tolerated; the time grows with the length."""
    stack = _Open()
    element: list[tuple[str, ...]] = [("",)]
    above = [0]
    found: list[tuple[int, str, int]] = []  # node, text, letters in links
    held: list[str] = []
    endless: set[str] = set()
    linked = links = at = node = 0
    match = _TOKEN.match

    def close() -> None:
        text = " ".join(html.unescape("".join(held)).split())
        if text:
            found.append((node, text, linked))

    while m := match(page, at):
        at = m.end()
        name = m[2]
        if name is None:
            t = m[0]
            if t[0] != "<" or t == "<":
                if not held:
                    node = stack.nodes[-1] if stack.nodes else 0
                held.append(t)
                if links:
                    linked += len(t)
            continue
        name = name.lower()
        if name in BLOCK and held:
            close()
            held, linked = [], 0
        if m[1]:
            k = stack.last((name,))
            if k >= 0 and (name in BLOCK or not stack.blocks or k > stack.blocks[-1]):
                stack.cut(k)
        elif name in RAW:
            if not m[3].endswith("/") and name not in endless:
                end = _RAW_END[name].search(page, at)
                if end:
                    at = end.end()
                elif name in _UNTIL_END:
                    at = len(page)
                else:
                    endless.add(name)
        elif name not in VOID and not m[3].endswith("/"):
            if name in BLOCK:
                if (k := stack.last(("p",))) >= 0:
                    stack.cut(k)
                if (same := _ENDS_ITSELF.get(name)) and (k := stack.last(same)) > stack.last(_SCOPE):
                    stack.cut(k)
            words = [w.lower() for g in _NAMES.findall(m[3]) for v in g for w in _PART.findall(v)] if m[3] else ()
            above.append(stack.nodes[-1] if stack.nodes else 0)
            stack.push(name, len(element))
            element.append((name, *words))
        elif name in ("br", "img", "hr"):
            if not held:
                node = stack.nodes[-1] if stack.nodes else 0
            held.append(" ")
        if name == "a" or name in BLOCK:
            links = len(stack.places.get("a", ()))
    close()
    return _placed(element, above, found)


def _placed(element: list, above: list[int], found: list[tuple[int, str, int]]) -> list[Leaf]:
    size, headed = [0] * len(element), [x[0] == "h1" for x in element]
    for node, text, linked in found:
        size[node] += max(1, len(text) - linked)
    for k in range(len(element) - 1, 0, -1):  # a parent's number is below its children's
        size[above[k]] += size[k]
        headed[above[k]] |= headed[k]
    whole, any_h1 = max(1, size[0]), headed[0]
    out, place = [], "before" if any_h1 else "none"
    for node, text, linked in found:
        path, k, share, wide = [], node, 0.0, 0
        while k and len(path) < NEAREST:
            path.append(element[k])
            if 2 * size[k] >= whole and headed[k] >= any_h1 and element[k][0] != "h1":
                wide += 1
            else:
                share, wide = size[k] / whole, 0
            k = above[k]
        path.reverse()
        if any(x[0] == "h1" for x in path):
            place = "in"
        elif place == "in":
            place = "after"
        out.append(Leaf(tuple(path), text, linked, wide, share, place))
    return out


_RAW_END = {n: re.compile(rf"</{n}\s*>", re.I) for n in RAW}
_UNTIL_END = frozenset("script style title textarea".split())  # without an end tag, the rest of the page is theirs
_SKIP = frozenset(("html", "body"))


def ancestor_features(path: tuple[tuple[str, ...], ...], wide: int) -> list[str]:
    """Tags and words of classes and ids, whole and by their first four letters, apart for wide ancestors and others."""
    out = set()
    for k, (tag, *words) in enumerate(path):
        of = "w" if k < wide else "n"
        if tag not in _SKIP:
            out.add(f"{of}t:{tag}")
        for w in words:
            out.update((f"{of}c:{w}", f"{of}s:{w[:4]}"))
    block = next((p[0] for p in reversed(path) if p[0] in BLOCK), "")
    top = path[wide][0] if wide < len(path) else ""
    return [*sorted(out), f"b:{block}", f"u:{top}", f"d:{min(4, len(path) - wide)}"]


def _measures(leaf: Leaf) -> tuple[int, int]:
    n = leaf.text.count(" ") + 1
    return sum(n >= k for k in (2, 5, 10, 20, 50)), sum(leaf.linked > k * len(leaf.text) for k in (0, 0.3, 0.7))


def text_features(page: list[Leaf], at: int) -> list[str]:
    """Of block `at`: length, links, end, share and place; lengths and links of its neighbours (none beyond an edge)."""
    leaf = page[at]
    n, links = _measures(leaf)
    share = sum(leaf.share > k for k in (0.02, 0.05, 0.1, 0.2, 0.4))
    out = [f"n:{n}", f"l:{links}", f"e:{leaf.text[-1] in '.!?…:;'}", f"x:{'©' in leaf.text}", f"r:{share}", f"q:{leaf.place}", "bias"]
    for side, k in (("-", at - 1), ("+", at + 1)):
        if 0 <= k < len(page):
            n, links = _measures(page[k])
            out += [f"{side}n:{n}", f"{side}l:{links}"]
            if page[k].path[: page[k].wide + 1] == leaf.path[: leaf.wide + 1]:
                out.append(f"{side}same")
    return out


@dataclass
class Crf:
    """weights: of each feature for a main block; moves[i][j]: from state i to j; starts, stops: of each state."""

    weights: dict[str, float]
    moves: list[list[float]]
    starts: list[float]
    stops: list[float]

    def __post_init__(self) -> None:
        self.paths: dict[tuple, float] = {}

    def scores(self, page: list[Leaf]) -> list[float]:
        get, out = self.weights.get, []
        for at, leaf in enumerate(page):
            s = self.paths.get((leaf.path, leaf.wide))
            if s is None:
                if len(self.paths) > 20_000:
                    self.paths.clear()
                s = self.paths[leaf.path, leaf.wide] = sum(get(f, 0.0) for f in ancestor_features(leaf.path, leaf.wide))
            out.append(s + sum(get(f, 0.0) for f in text_features(page, at)))
        return out

    def decode(self, scores: list[float]) -> list[bool]:
        """Viterbi: the best sequence of states for the main-block scores of a page (ties: not main)."""
        if not scores:
            return []
        (m00, m01), (m10, m11) = self.moves
        a, b = self.starts[0], self.starts[1] + scores[0]
        back = []
        for s in scores[1:]:
            to0, to1 = b + m10 > a + m00, b + m11 > a + m01
            back.append((to0, to1))
            a, b = (b + m10 if to0 else a + m00), (b + m11 if to1 else a + m01) + s
        state = b + self.stops[1] > a + self.stops[0]
        out = [state]
        for to0, to1 in reversed(back):
            state = to1 if state else to0
            out.append(state)
        return out[::-1]

    def extract(self, page: str) -> list[str]:
        """The main blocks of a page, in order."""
        own = leaves(page)
        keep = self.decode(self.scores(own))
        return [x.text for x, k in zip(own, keep, strict=True) if k]


# --- labelled pages -----------------------------------------------------------------------------------

MAIN_TAGS = frozenset(("article", "main"))
ASIDE_TAGS = frozenset(("nav", "footer", "aside", "form", "menu", "dialog"))
#: What authors call the parts of a page, by kind. They name parts of made-up layouts; no label comes from them.
NAMES = {
    "menu": "menu nav navbar navigation breadcrumb breadcrumbs topbar toolbar tabs pagination pager",
    "header": "header masthead site-header branding logo top-bar",
    "footer": "footer site-footer copyright legal colophon bottom",
    "side": "sidebar side aside related recommended widget popular trending see-also more-stories tags share social",
    "notice": "notice alert banner cookie cookie-banner consent gdpr popup modal message warning newsletter subscribe paywall",
    "ad": "ad ads advert adverts advertisement sponsored sponsor promo promoted promotion adslot banner-ad",
    "form": "form search search-form login signup contact-form",
    "comments": "comments comment comment-list reader-comments discussion replies reply responses user-comments disqus",
}
CONTENT = "content post entry story text body-text post-content entry-content article-body main page-content body prose".split()
_MAIN = "\ue000"  # leads the main blocks of a made-up page, and is taken off again
PIECE = 64


def weak_label(leaf: Leaf) -> bool:
    """Main if inside an article or main element and, within it, nothing that its tag sets apart."""
    tags = [p[0] for p in leaf.path]
    first = next((k for k, t in enumerate(tags) if t in MAIN_TAGS), None)
    return first is not None and not any(t in ASIDE_TAGS for t in tags[first:])


def made_up(rng: random.Random) -> str:
    return "".join(rng.choices("abcdefghijklmnoprstuvwz", k=rng.randint(3, 8)))


def render(rng: random.Random, main: list[str], other: list[str]) -> list[tuple[Leaf, bool]]:
    """A page of the blocks `main` and boilerplate made of `other`, in one of many layouts; labelled as it was made."""
    chance = lambda p: rng.random() < p

    def say(least: int, most: int) -> str:
        return html.escape(" ".join(rng.choice(other).split()[: rng.randint(least, most)]) or "x")

    def named(own: list[str], known: float, noise: float) -> str:
        words = [rng.choice(own)] if own and chance(known) else [made_up(rng)] if chance(0.5) else []
        while chance(noise):
            kind = rng.choice([*NAMES, "", ""])
            words.append(f"{rng.choice(NAMES[kind].split()) if kind else made_up(rng)}{rng.choice(('', '-on', '-off', '-enabled', '-page'))}")
        return f' {rng.choice(("class", "class", "id"))}="{" ".join(words)}"' if words else ""

    def body(kind: str) -> str:
        if kind in ("menu", "side") and chance(0.6):
            items = [f'<a href="#">{say(1, 6)}</a>' for _ in range(rng.randint(2, 7))]
            return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>" if chance(0.7) else " | ".join(items)
        if kind == "form":
            return f"<label>{say(1, 4)}</label><input type=text><p>{say(2, 12)}</p><button>{say(1, 2)}</button>"
        if kind == "comments":
            one = rng.choice(("<li>{}</li>", "<p>{}</p>", "<article{n}><b>{}</b><p>{}</p></article>", "<div{n}><b>{}</b><p>{}</p></div>", "<div{n}><p>{}</p></div>"))
            one = one.replace("{n}", named(["comment", "reply"], 0.6, 0.1))
            head = rng.choice(("", f"<h2>{say(1, 3)}</h2>", f"<h3>{say(1, 3)}</h3>"))
            return head + "".join(one.format(say(2, 60), say(2, 60)) for _ in range(rng.randint(8, 25) if chance(0.15) else rng.randint(1, 6)))
        if kind == "footer":
            return rng.choice(("&copy; ", "<p>&copy; 2020 ", "")) + say(2, 25)
        if kind == "header":
            return rng.choice(("{}", "<p>{}</p>", "<div>{}</div><p>{}</p>", "<a href=x>{}</a>")).format(say(1, 6), say(2, 12))
        return rng.choice(("{}", "<p>{}</p>", "<div><p>{}</p></div>", "<h3>{}</h3><p>{}</p>", "<span>{}</span>")).format(say(2, 30), say(2, 40))

    def part(kind: str, known: float = 0.75) -> str:  # inside an article, nothing but its name or tag can tell a part
        tag = {"menu": "nav", "header": "header", "footer": "footer", "side": "aside", "form": "form", "comments": "section"}.get(kind, "div")
        tag = tag if chance(0.5) else rng.choice(("div", "div", "div", "section", "table"))
        inner = f"<tr><td>{body(kind)}</td></tr>" if tag == "table" else body(kind)
        return f"<{tag}{named(NAMES[kind].split(), known if tag in ('div', 'section', 'table') else 0.5, 0.12)}>{inner}</{tag}>"

    def parts(p: float, *kinds: str, known: float = 0.75) -> str:
        return "".join(part(k, known) for k in kinds if chance(p))

    out = []
    form = "<p>{}</p>"
    for k, text in enumerate(main):
        words = _MAIN + html.escape(text)
        if chance(0.2):
            form = rng.choice(("<p>{}</p>",) * 8 + ("<p><b>{}<br>", "<div>{}</div>", "<ul><li>{}</li></ul>", "<blockquote><p>{}</p></blockquote>",
                "<h2>{}</h2>", "<section><p>{}</p></section>", "<table><tr><td>{}</td></tr></table>", "<pre>{}</pre>", f"<p{named([], 0, 0.4)}>{{}}</p>",
                "<div><div><p>{}</p></div></div>", "<figure><figcaption>{}</figcaption></figure>", "<p><a href=x>{}</a></p>"))
        first = rng.choice(("<h1>{}</h1>",) * 6 + ("<header><h1>{}</h1></header>", "<h2>{}</h2>", "<p>{}</p>"))
        out.append((first if k == 0 else form).format(words) + (parts(0.5, *rng.sample(list(NAMES)[3:7], 1), known=1) if chance(0.15) else ""))
    tag = rng.choice(("article", "article", "main", "div", "div", "div", "section"))
    title = out.pop(0) if len(out) > 1 and chance(0.12) else ""
    core = title + f"<{tag}{named(CONTENT, 0.5, 0.25)}>" + "".join(out) + (parts(0.5, "comments", "side", known=1) if chance(0.3) else "") + f"</{tag}>"
    if chance(0.12):
        core = f"<table{named([], 0, 0.1)}><tr><td>{parts(0.8, 'menu', 'side')}</td><td>{core}</td></tr></table>"
    elif chance(0.45):
        outer = rng.choice(("main", "div", "div", "section"))
        core = f"<{outer}{named(['wrapper', 'container', 'page', 'layout'], 0.5, 0.2)}>{parts(0.3, 'side')}{core}{parts(0.4, 'comments', 'side')}</{outer}>"
    after = "" if chance(0.35) else parts(0.45, "ad", "comments", "side", "notice", "side", "form", "footer", "footer")
    page = ("" if chance(0.2) else parts(0.45, "notice", "menu", "header", "menu", "ad", "form")) + core + after
    if chance(0.12):
        page = f"<form{named([], 0, 0.2)}>{page}</form>"
    found = leaves(f"<body{named([], 0, 0.15)}>{page}</body>")
    labels = [x.text.startswith(_MAIN) for x in found]
    for x in found:
        x.text = x.text.removeprefix(_MAIN) or "x"
    return list(zip(found, labels, strict=True))


def labelled(pages: list[str], seed: int = 5, layouts: int = 8) -> list[list[tuple[Leaf, bool]]]:
    """Training pages: those given, labelled by their mark-up, and runs of their blocks in made-up layouts."""
    rng = random.Random(seed)
    out, others, own = [], [], []
    for p in pages:
        found = [(x, weak_label(x)) for x in leaves(p)]
        if any(y for _, y in found):
            out.append(found)
            own.append([x.text for x, y in found if y])
            others += [x.text for x, y in found if not y] + own[-1]
    for main in own:
        for _ in range(layouts):
            k = rng.randint(1, 12)
            at = rng.randrange(max(1, len(main) - k))
            out.append(render(rng, main[at : at + k], others))
    return [p for p in out if p]


def fit(training: list[list[tuple[Leaf, bool]]], steps: int = 200, l2: float = 0.0005) -> Crf | None:
    """Maximum likelihood by Adam on all pages at once; gradients from forward-backward. None without pages.

    Longer pages are cut into pieces of PIECE blocks, all of which count; only a page's real ends meet start and stop weights.
    """
    if not training:
        return None
    feats: dict[str, int] = {}
    flat, block, labels, begins, stops = [], [], [], [], []
    longest = min(PIECE, max(map(len, training)))
    for page in training:
        own = [x for x, _ in page]
        for t, (leaf, label) in enumerate(page):
            if t % PIECE == 0:
                labels.append([])
                begins.append(t == 0)
                stops.append(t + PIECE >= len(page))
            for f in ancestor_features(leaf.path, leaf.wide) + text_features(own, t):
                flat.append(feats.setdefault(f, len(feats)))
                block.append((len(labels) - 1) * longest + t % PIECE)
            labels[-1].append(label)
    n_pages = len(labels)
    y, live = np.zeros((n_pages, longest), int), np.zeros((n_pages, longest), bool)
    for p, own in enumerate(labels):
        y[p, : len(own)], live[p, : len(own)] = own, True
    begins, stops = np.array(begins, float)[:, None], np.array(stops, float)[:, None]
    flat, block = np.array(flat), np.array(block)
    theta = [np.zeros(len(feats)), np.zeros((2, 2)), np.zeros(2), np.zeros(2)]
    m, v = [np.zeros_like(x) for x in theta], [np.zeros_like(x) for x in theta]
    ends = live.sum(1) - 1
    rows, both_states = np.arange(n_pages), np.eye(2)
    for step in range(1, steps + 1):
        w, move, start, stop = theta
        e = np.zeros((n_pages, longest, 2))
        e[..., 1] = np.bincount(block, w[flat], n_pages * longest).reshape(n_pages, longest)
        fwd, bwd = np.zeros_like(e), np.zeros_like(e)
        fwd[:, 0] = start * begins + e[:, 0]
        for t in range(1, longest):
            before = fwd[:, t - 1]
            for j in (0, 1):
                reached = np.logaddexp(before[:, 0] + move[0, j], before[:, 1] + move[1, j]) + e[:, t, j]
                fwd[:, t, j] = np.where(live[:, t], reached, before[:, j])
        bwd[rows, ends] = stop * stops
        for t in range(longest - 2, -1, -1):
            after = e[:, t + 1] + bwd[:, t + 1]
            for i in (0, 1):
                onward = np.logaddexp(move[i, 0] + after[:, 0], move[i, 1] + after[:, 1])
                bwd[:, t, i] = np.where(t < ends, onward, bwd[:, t, i])
        z = np.logaddexp.reduce(fwd[rows, ends] + stop * stops, axis=1)
        marg = np.exp(fwd + bwd - z[:, None, None]) * live[..., None]
        err = (marg[..., 1] - y * live).reshape(-1)
        both = live[:, 1:]
        pair = np.exp(fwd[:, :-1, :, None] + move + (e[:, 1:] + bwd[:, 1:])[:, :, None, :] - z[:, None, None, None]) * both[..., None, None]
        seen = np.stack([[((y[:, :-1] == i) & (y[:, 1:] == j) & both).sum() for j in (0, 1)] for i in (0, 1)])
        grads = [np.bincount(flat, err[block], len(feats)), pair.sum((0, 1)) - seen,
                 (begins * (marg[:, 0] - both_states[y[:, 0]])).sum(0), (stops * (marg[rows, ends] - both_states[y[rows, ends]])).sum(0)]
        for k, g in enumerate(grads):
            g = g / n_pages + l2 * theta[k]
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.99 * v[k] + 0.01 * g * g
            theta[k] = theta[k] - 0.15 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)
    w, move, start, stop = theta
    return Crf({f: float(w[i]) for f, i in feats.items()}, move.tolist(), start.tolist(), stop.tolist())


_MARKED = r"(?i)<(article|main)[\s/>]"


def learn(pages: DataFrame, html_col: str = "html", sample: int = 120, budget: int = 48_000_000) -> Crf | None:
    """A CRF from a bounded sample of the pages that can be labelled: about `sample` with article or main mark-up.

    They are drawn by a hash, whatever their length; `budget` bounds the characters that reach the driver. None
    without pages; an error if there are pages, but none to learn from.
    """
    rows = pages.where(F.length(html_col) > 0).select(F.col(html_col).alias("t"), F.xxhash64(html_col).alias("h"))
    marked = rows.where(F.col("t").rlike(_MARKED))
    if crf := fit(labelled(_drawn(marked, sample, budget))):
        return crf
    main = annotate(marked, "t", "_main boolean", lambda ts: [[any(map(weak_label, leaves(t.decode()))) for t in ts]], keep_text=True)
    if crf := fit(labelled(_drawn(main.where("_main"), sample, budget))):  # what was drawn has the mark-up without text in it
        return crf
    if rows.isEmpty():
        return None
    raise ValueError(f"no page of at most {budget} characters has text in an article or main element: nothing to learn main text from")


def _drawn(rows: DataFrame, sample: int, budget: int) -> list[str]:
    n = rows.agg(F.approx_count_distinct("h")).first()[0]
    if not n:
        return []
    some = rows.where(F.pmod("h", F.lit(1 << 30)) < min(1.0, sample / n) * (1 << 30))
    chosen = []
    for r in some.groupBy("h").agg(F.max(F.length("t")).alias("n")).orderBy("h").collect():
        if r.n <= budget:
            chosen.append(r.h)
            budget -= r.n
    return [r.t for r in sorted(some.where(F.col("h").isin(chosen)).select("t", "h").distinct().collect(), key=lambda r: r.h)]


def extract(pages: DataFrame, crf: Crf | None, html_col: str = "html") -> DataFrame:
    """`pages` (html left out) with _text: the main blocks joined by an empty line.

    White space in a block is one space, character references are decoded, nothing else changes. A null,
    empty or blockless page has an empty text (and every page without a CRF). Repeated pages get equal
    texts; other columns stay.
    """
    sent = pages.sparkSession.sparkContext.broadcast(crf)  # a weight for each feature of the sample

    def run(rows: Iterable[bytes]) -> list:
        model = sent.value
        return [["\n\n".join(model.extract(t.decode())) if model else "" for t in rows]]

    return annotate(pages, html_col, "_text string", run)


@query("op2_html_crf")
def op2(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract(pages, learn(pages)).select("page_id", "url", F.col("_text").alias("text"), F.length("_text").cast("long").alias("n_chars"))
