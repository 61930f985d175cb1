"""Main text of web pages by a tree-structured graphical model.

A tolerant parser builds the tree of block elements; every one is a variable, content or not. Potentials on a node see
its tag, the words of its class, id and role and how they begin, the elements that it stands in, and the length,
punctuation and link share of its text; potentials between parent and child depend on what kind of pair they are.
Sum-product messages go up to the root and down again; the exact marginal of the block that owns a piece of text decides
on it, content from one half on. The weights are the maximum of the likelihood of labelled pages, which ``labelled_pages``
builds from many site layouts with articles, menus, headers, footers, sidebars, notices, adverts, forms and reader comments.

Scripts, styles, titles, templates and comments of the markup are never text. Character references are decoded, white
space (and a line-break element) inside a block becomes one space, blocks stand on lines of their own in page order.

Null and empty pages, and those without content, have an empty text; unclosed, misplaced and cut-off tags are
tolerated, and time grows in proportion to the page whatever its marks; very long pages are read whole; repeated rows
give repeated results, and null ids and addresses stay null; an empty table gives an empty result; other columns are not
looked at.
"""

from __future__ import annotations

import html
import math
import random
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rampart.llm import kernels as K

# What HTML says of its elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript template iframe".split())
BLOCK = frozenset(
    "html head body article section main header footer nav aside div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr td th blockquote pre figure figcaption form fieldset legend address details summary hr dialog menu center".split()
)
CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
    "tbody": ("tr", "td", "th", "thead", "tbody"), "tfoot": ("tr", "td", "th", "tbody"), "body": ("head",),
}
#: Elements that nodes know they stand in.
REGIONS = frozenset("article main section nav aside header footer form blockquote figure table ul ol dl details dialog menu".split())

_RAW_ENDS = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.IGNORECASE) for tag in RAW}
_OPEN = re.compile(r"<(?=[!?]|/?[a-zA-Z])")
_TAG = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
_STOP = re.compile(r"[>\"']")
_NAMED = re.compile(r"(?:^|[\s\"'])(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "names", "parent", "kids", "label", "score", "chars", "linked", "stops", "p", "whole", "whole_linked", "regions", "above")

    def __init__(self, tag: str, names: frozenset[str], parent: int, regions: frozenset[str], above: frozenset[str]) -> None:
        self.tag, self.names, self.parent, self.regions, self.above = tag, names, parent, regions, above
        self.kids: list[int] = []
        self.chars = self.linked = self.stops = 0
        self.label = 0


#: Words of the names of one element that features see.
NAMES = 16


@lru_cache(4096)
def _short_names(attributes: str) -> frozenset[str]:
    found = " ".join(" ".join(m) for m in _NAMED.findall(attributes))
    return frozenset([w.lower() for w in _WORDS.findall(found) if len(w) > 1][:NAMES])


def _names(attributes: str) -> frozenset[str]:
    """The words of class, id and role."""
    return _short_names(attributes) if len(attributes) < 500 else _short_names.__wrapped__(attributes)


class Frame:
    """An open block: its tag, its node, whether a link is open in it, and the regions that it and its like are in."""

    __slots__ = ("tag", "node", "link", "regions")

    def __init__(self, tag: str, node: int, link: bool, regions: frozenset[str]) -> None:
        self.tag, self.node, self.link, self.regions = tag, node, link, regions


def parse(page: str) -> tuple[list[Node], list[tuple[int, str]]]:
    """Block nodes in page order (0 is the root) and (owner, text) of every run of text, decoded.

    Each sign is looked at a bounded number of times: open blocks are counted, so that no end tag searches for what isn't
    there, and once quotes are found not to pair up, they no longer matter.
    """
    none: frozenset[str] = frozenset()
    nodes, runs = [Node("#root", none, 0, none, none)], []
    stack, open_ = [Frame("#root", 0, False, none)], Counter()
    at, n, quotes = 0, len(page), True

    def text(a: int, b: int) -> None:
        if b > a:
            frame, t = stack[-1], html.unescape(page[a:b])
            runs.append((frame.node, t))
            node, size = nodes[frame.node], len(t) - t.count(" ")
            node.chars += size
            node.stops += t.count(".") + t.count("?") + t.count("!")
            if frame.link:
                node.linked += size

    def close() -> None:
        open_[stack.pop().tag] -= 1

    while at < n:
        m = _OPEN.search(page, at)
        if not m:
            text(at, n)
            break
        start = m.start()
        text(at, start)
        if page[start + 1] in "!?":
            if page.startswith("<!--", start):
                end = page.find("-->", start + 4)
                at = n if end < 0 else end + 3
            else:
                end = page.find(">", start)
                at = n if end < 0 else end + 1
            runs.append((stack[-1].node, ""))
            continue
        m = _TAG.match(page, start + 1)
        tag, end = m[2].lower(), m.end()
        attributes = end
        while quotes:
            stop = _STOP.search(page, end)
            if not stop:
                quotes = False
            elif stop[0] == ">":
                end = stop.start()
                break
            else:
                end = page.find(stop[0], stop.end()) + 1
                quotes = end > 0
        if not quotes:  # some quote is never closed: from here on a tag ends at the first sign that may end it
            end = page.find(">", attributes)
            if end < 0:
                break  # a tag that is cut off is no text
        rest, at = page[attributes:end], end + 1
        if m[1]:
            if tag in BLOCK:
                if open_[tag]:
                    while stack[-1].tag != tag:
                        close()
                    close()
                runs.append((-1, ""))
            elif tag == "a":
                stack[-1].link = False
            continue
        if tag in RAW and not rest.endswith("/"):
            ends = _RAW_ENDS[tag].search(page, at)
            at = ends.end() if ends else n
            continue
        if tag in VOID:
            runs.append((stack[-1].node, " ") if tag == "br" else (-1, "") if tag == "hr" else (stack[-1].node, ""))
            continue
        if tag in BLOCK:
            runs.append((-1, ""))
            closing = CLOSES.get(tag, ())
            while len(stack) > 1 and (stack[-1].tag == "p" or stack[-1].tag in closing):  # an open paragraph ends at any block; list items and cells at their like
                close()
            above = stack[-1]
            regions = above.regions | {above.tag} if above.tag in REGIONS and above.tag not in above.regions else above.regions
            nodes[above.node].kids.append(len(nodes))
            parent = nodes[above.node]
            nodes.append(Node(tag, _names(rest) if rest else none, above.node, regions, parent.names or parent.above))
            stack.append(Frame(tag, len(nodes) - 1, above.link, regions))
            open_[tag] += 1
        elif tag == "a":
            stack[-1].link = not rest.endswith("/")
        elif tag == "option":
            runs.append((stack[-1].node, " "))
    return nodes, runs


#: First signs of a name that features see by themselves, so that words like those of the labelled pages count.
STEMS = (3, 5)


def features(node: Node) -> tuple[str, ...]:
    out = ["bias", "tag=" + node.tag, *("in=" + r for r in node.regions)]
    if node.names:
        out += ["name=" + w for w in node.names]
        out += ["stem=" + w for w in {w[:k] for w in node.names for k in STEMS}]
    if node.above:
        out += ["under=" + w for w in {w[: STEMS[0]] for w in node.above}]
    out.append(("deep=" if node.regions & {"article", "main", "section"} else "shallow=") + node.tag)
    if node.chars:
        share = node.linked / node.chars
        out.append(f"len={min(6, node.chars.bit_length() // 2)}")
        out.append("links=all" if share > 0.8 else "links=some" if share > 0.2 else "links=none")
        out.append("stops=" + ("0" if not node.stops else "1" if node.stops == 1 else "2"))
        if node.tag == "#root" and not node.kids:
            out.append("alone")
    else:
        out.append("empty")
    if node.kids:
        share = node.whole_linked / node.whole if node.whole else 0.0
        out.append("below=" + ("nothing" if not node.whole else "links" if share > 0.6 else "mixed" if share > 0.15 else "text"))
        out.append(f"size={min(7, node.whole.bit_length() // 2)}")
    return tuple(out)


#: What kind of pair a parent and a child are.
def relation(parent: Node, child: Node) -> str:
    if parent.tag in ("#root", "html", "body"):
        return "top"
    if parent.tag in ("nav", "aside", "footer", "form", "header", "dialog", "menu"):
        return "part " + parent.tag
    if parent.tag in ("article", "main", "section", "div"):
        return "wrap " + parent.tag + (" named" if parent.names else "")
    return "inner"


Weights = dict[str, float]


def _sums(nodes: list[Node]) -> None:
    for v in nodes:
        v.whole, v.whole_linked = v.chars, v.linked
    for v in reversed(nodes[1:]):
        p = nodes[v.parent]
        p.whole += v.whole
        p.whole_linked += v.whole_linked


def _log_add(a: float, b: float) -> float:
    return a + math.log1p(math.exp(b - a)) if a > b else b + math.log1p(math.exp(a - b))


def infer(nodes: list[Node], w: Weights, pairs: list | None = None, known: list[tuple[str, ...]] | None = None) -> None:
    """Sets each node's marginal ``p``; with ``pairs``, appends (relation, node, marginals of the four value pairs) too."""
    get = w.get
    n = len(nodes)
    if known is None:
        _sums(nodes)
        known = [features(v) for v in nodes]
    own = [sum([get(f, 0.0) for f in x]) for x in known]
    kinds = [relation(nodes[v.parent], v) for v in nodes]
    table = {k: [get(f"{k}:{c}", 0.0) for c in ("00", "01", "10", "11")] for k in set(kinds)}
    up, sent = own[:], [0.0] * n  # log-odds of content, from below; message to the parent
    for v in range(n - 1, 0, -1):
        a, b, c, d = table[kinds[v]]
        x = up[v]
        sent[v] = _log_add(c, d + x) - _log_add(a, b + x)
        up[nodes[v].parent] += sent[v]
    odds = up[:]
    for v in range(1, n):
        a, b, c, d = table[kinds[v]]
        above = odds[nodes[v].parent] - sent[v]
        odds[v] = up[v] + _log_add(b, d + above) - _log_add(a, c + above)
        if pairs is not None:
            x = [a, b + up[v], c + above, d + above + up[v]]
            top = max(x)
            x = [math.exp(y - top) for y in x]
            total = sum(x)
            pairs.append((kinds[v], v, [y / total for y in x]))
    for v, x in zip(nodes, odds, strict=True):
        v.p = 1 / (1 + math.exp(-x)) if x > -700 else 0.0


def train(pages: list[tuple[str, Callable[[list[Node]], list[int]]]], steps: int = 80, rate: float = 1.0, decay: float = 0.0005) -> Weights:
    """Weights that make labelled trees likely: observed minus expected features, by adaptive steps."""
    trees = []
    for page, label in pages:
        nodes, _ = parse(page)
        for v, known in zip(nodes, label(nodes), strict=True):
            v.label = known
        _sums(nodes)
        trees.append((nodes, [features(v) for v in nodes]))
    w: Weights = {}
    squares: Weights = {}
    for _ in range(steps):
        grad: Weights = {}
        for nodes, known in trees:
            pairs: list = []
            infer(nodes, w, pairs, known)
            for v, own in zip(nodes, known, strict=True):
                for f in own:
                    grad[f] = grad.get(f, 0.0) + v.label - v.p
            for kind, v, p in pairs:
                seen = 2 * nodes[nodes[v].parent].label + nodes[v].label
                for k, c in enumerate(("00", "01", "10", "11")):
                    grad[f"{kind}:{c}"] = grad.get(f"{kind}:{c}", 0.0) + (k == seen) - p[k]
        for f, g in grad.items():
            g = g / len(trees) - decay * w.get(f, 0.0)
            squares[f] = squares.get(f, 1e-6) + g * g
            w[f] = w.get(f, 0.0) + rate * g / math.sqrt(squares[f])
    return w


# Words that sites name the parts of their pages by, for the labelled pages.
SITE_WORDS = {
    "content": "article article-body articleBody content main-content post post-content entry entry-content story story-body body-text text copy prose markdown page-content hentry single blog-post news-text rich-text page wrapper container",
    "advert": "ad ads advert advertisement adslot ad-unit adsbygoogle banner-ad sponsored sponsor promo promotion google-ads dfp commercial banner",
    "aside": "sidebar side-bar aside related related-posts more-stories recommended widget widget-area rail right-rail trending popular teaser complementary also-read",
    "notice": "cookie cookie-notice cookies consent gdpr-banner notice alert popup modal overlay paywall subscribe-wall toast warning info-bar privacy-banner",
    "comments": "comments comment comment-list commentlist comments-area comment-thread commentary-readers disqus disqus_thread discussion replies reply respond responses reader-responses user-comments feedback livefyre fb-comments talkback",
    "share": "share sharing social social-links tags tag-list meta post-meta byline-tools newsletter subscribe pagination pager breadcrumbs breadcrumb toolbar print follow author-box",
    "menu": "nav navbar navigation menu main-menu topbar top-nav site-nav header site-header masthead login search searchbox skip-links toc-links language-switch",
    "footer": "footer site-footer colophon legal copyright imprint bottom-bar disclaimer credits",
}


def labelled_pages(n: int = 400, seed: int = 9) -> list[tuple[str, Callable[[list[Node]], list[int]]]]:
    """Pages of many layouts. Content is what lies in an element with the attribute ``y``, less what lies in one with ``z``."""
    r = random.Random(seed)
    named = {k: v.split() for k, v in SITE_WORDS.items()}

    def words(k: int) -> str:
        return " ".join("".join(r.choice(["ba", "ne", "ti", "ro", "lu", "sem", "or", "and"]) for _ in range(r.randint(1, 4))) for _ in range(k))

    def sentence(k: int) -> str:
        return words(max(1, k)).capitalize() + "."

    def prose(k: int | None = None) -> str:
        return " ".join(sentence(r.randint(1, 18)) for _ in range(k or r.randint(1, 6)))

    def link(k: int = 3) -> str:
        return f'<a href="/{words(1)}">{words(r.randint(1, k))}</a>'

    def links(tag: str = "ul") -> str:
        return f"<{tag}>" + "".join(f"<li>{link()}</li>" for _ in range(r.randint(2, 8))) + f"</{tag}>"

    def name(kind: str, odds: float = 1.0) -> str:
        """Attributes with one or two names, among others that say nothing."""
        if r.random() > odds:
            return ""
        own = [r.choice(named[kind]) for _ in range(r.choice([1, 1, 2]))] + ([words(1)] if r.random() < 0.3 else [])
        r.shuffle(own)
        return f' {r.choice(["class", "class", "id", "role"])}="{" ".join(own)}"'

    def paragraphs(least: int = 0) -> str:
        out = []
        for _ in range(max(least, r.choice([0, 1, 1, 2, 3, 5, 9]))):
            kind = r.random()
            if kind < 0.55:
                out.append(f"<p>{prose()}</p>")
            elif kind < 0.62:
                out.append(f"<p>{r.choice(['<b>', '<i>', ''])}{prose(1)}<br>{r.choice(['', prose(1)])}")
            elif kind < 0.68:
                out.append(f"<h2>{words(r.randint(1, 6))}</h2><p>{prose()} {link()} {prose(1)}</p>")
            elif kind < 0.74:
                out.append(f"<{(t := r.choice(['ul', 'ol']))}>" + "".join(f"<li>{r.choice([prose(1), words(3), link(6)])}</li>" for _ in range(r.randint(1, 6))) + f"</{t}>")
            elif kind < 0.78:
                out.append(f"<p>{words(3)}:</p>{links(r.choice(['ul', 'ol']))}")  # a list of links that the article gives
            elif kind < 0.82:
                out.append(f"<blockquote>{r.choice([f'<p>{prose()}</p>', prose(1)])}</blockquote>")
            elif kind < 0.86:
                out.append("<table>" + "".join(f"<tr><td>{words(2)}</td><td>{r.choice([sentence(4), words(1), '12.5'])}</td></tr>" for _ in range(3)) + "</table>")
            elif kind < 0.89:
                out.append(f"<pre>{words(12)}</pre>")
            elif kind < 0.92:
                out.append(f"<figure><img src=x><figcaption>{r.choice([sentence(5), words(3)])}</figcaption></figure>")
            elif kind < 0.94:
                out.append(f"<dl><dt>{words(2)}</dt><dd>{prose(1)}</dd></dl>")
            elif kind < 0.96:
                out.append(f"<p>{words(2)} <select><option>{words(1)}</option><option>{words(1)}</option></select> <math><mi>x</mi></math></p>")
            else:
                out.append(f"<div>{r.choice([prose(), f'<p>{prose()}</p><p>{prose()}</p>'])}</div>")
        return "".join(out) or f"<p>{prose(1)}<br>"

    def comments() -> str:
        each = [f'<div{name("comments", 0.6)}>{r.choice(["<p>" + prose() + "</p>", prose()])}</div>', f"<li{name('comments', 0.4)}><b>{words(1)}</b><p>{prose(2)}</p></li>", f"<p>{prose()}</p>", f"<article{name('comments')}><header>{words(1)}</header><p>{prose()}</p></article>", f"<blockquote>{prose()}</blockquote>"]
        tag = r.choice(["div", "section", "ul", "ol", "aside"])
        return f'<{tag}{name("comments")} z>{r.choice([f"<h3>{words(2)}</h3>", ""])}{"".join(r.choice(each) for _ in range(r.randint(1, 4)))}{r.choice(["", form(), ""])}</{tag}>'

    def form() -> str:
        return f"<form z><p>{r.choice([words(3), sentence(6)])}</p><input name=q><label>{words(2)}</label><select><option>{words(1)}<option>{words(1)}</select><button>{words(1)}</button></form>"

    def boiler(inside: bool = False) -> str:
        text, kind = r.choice([prose(1), words(4), prose(), prose(3)]), r.randrange(9)
        tag = r.choice(["div", "div", "section", "ul" if kind == 4 else "div", "p" if kind in (0, 2) else "div"])
        body = {0: r.choice([text, link(5), f"<p>{text}</p>"]) if tag != "p" else text, 2: r.choice([f"<p>{text}</p>", text]) if tag != "p" else text}
        if kind in body:
            return f'<{tag}{name("advert" if kind == 0 else "notice")} z>{body[kind]}</{tag}>'
        if kind == 1:
            return f'<aside{name("aside", 0.5)} z>{r.choice([f"<h3>{words(2)}</h3>", ""])}{r.choice([links(), f"<p>{text}</p>", f"<p>{prose()}</p><p>{prose()}</p>", text])}</aside>'
        if kind == 3:
            return form()
        if kind == 4:
            return comments()
        if kind == 5:
            return f'<{tag}{name("share")} z>{r.choice([links(), link() + " " + link(), text, f"<p>{link()} | {link()}</p>"])}</{tag}>'
        if kind == 6:
            return f'<div{name("aside")} z>{r.choice([f"<h3>{words(2)}</h3>", ""])}{r.choice([links(), f"<p>{text}</p>", f"<p>{prose()}</p>" * 2])}</div>'
        if kind == 7:
            return f"<nav{name('menu', 0.3)} z>{r.choice([links(), links('ol'), link() + ' &gt; ' + link()])}</nav>"
        return f"<footer z>{r.choice([text, f'<p>{text}</p>', links()])}</footer>" if inside else f'<section{name("aside")} z><h2>{words(2)}</h2>{links()}<p>{text}</p></section>'

    pages = []
    for _ in range(n):
        title = words(r.randint(2, 9))
        heading = r.choice([f"<h1>{title}</h1>", f"<h1>{title}.</h1>", f"<header><h1>{title}</h1></header>", f"<header><h1>{title}</h1><p>{sentence(5)}</p></header>", f"<h2>{title}</h2>", ""])
        parts = [paragraphs()]
        while r.random() < 0.35:
            parts += [boiler(True), r.choice(["", paragraphs()])]
        inner = "".join(parts)
        plain = r.choice(["article", "article", "main", "section", "div"])
        open_, close = r.choice([(f"<{plain} y>", f"</{plain}>"), ("<article y>", "</article>"), ("<main><article y>", f"</article>{r.choice(['', comments(), boiler(), boiler() + comments()])}</main>"), (f"<div{name('content')} y>", "</div>"), (f"<{plain}{name('content')} y>", f"</{plain}>"), (f"<div><div{name('content', 0.7)} y><div>", "</div></div></div>"), ("", "")])
        if not open_:  # paragraphs that stand in the body by themselves
            heading, inner = f"<h1 y>{title}</h1>", re.sub("<(p|h2|ul|ol|table|pre|blockquote|figure|dl|div)>", r"<\1 y>", paragraphs())
        tops = [f"<nav{name('menu', 0.3)} z>{links()}</nav>", f"<header z><h2>{words(2)}</h2>{r.choice([links(), ''])}</header>", f'<div{name("menu")} z>{words(3)}{links()}</div>', f"<div{name('menu')} z><ul><li>{link()}<ul><li>{link()}</ul><li>{link()}</ul></div>", f"<header z><p>{words(3)}</p><nav>{links()}</nav></header>", f"<header z><h1>{words(2)}</h1>{r.choice(['', f'<p>{words(4)}</p>', f'<p>{sentence(5)}</p>'])}</header>"]
        ends = [f"<footer z>&copy; {words(2)} &middot; {prose(1)}</footer>", f"<footer{name('footer', 0.5)} z><p>{prose(1)}</p>{links()}</footer>", f'<div{name("footer")} z>{r.choice([prose(1), f"<p>{prose(2)}</p>"])}</div>', f"<footer z>{words(3)} {link()}\n{prose()}", ""]
        before = [r.choice(tops), *(boiler() for _ in range(r.randint(0, 2)))]
        after = [*(boiler() for _ in range(r.randint(0, 3))), *([comments()] if r.random() < 0.3 else []), r.choice(ends)]
        r.shuffle(before)
        if r.random() < 0.04:
            pages.append(r.choice([prose(), f"<p y>{prose()}</p><p y>{prose()}</p>"]))
            continue
        around = r.choice([("", ""), ("", ""), (f"<div{r.choice(['', ' id=wrap', ' class=' + chr(34) + 'page container' + chr(34)])}>", "</div>")])
        pages.append(f'<html><head><title>{title}</title></head><body>{around[0]}{"".join(before)}{open_}{heading}{inner}{close}{"".join(after)}{around[1]}</body></html>')
    return [(p, _label(p)) for p in pages]


_MARK = re.compile(r"<([a-zA-Z][a-zA-Z0-9]*)((?:[^>\"]|\"[^\"]*\")*)>")


def _label(page: str) -> Callable[[list[Node]], list[int]]:
    """Labels by place: what lies in the marked element, itself included, but not in one that is marked as boilerplate."""
    marks = [m for m in _MARK.finditer(page) if m[1] in BLOCK and m[1] not in VOID]
    marked = [None, *(True if m[2].endswith(" y") else False if m[2].endswith(" z") else None for m in marks)]

    def label(nodes: list[Node]) -> list[int]:
        out = [int(not nodes[0].kids)]  # text outside of any element
        for v, own in zip(nodes[1:], marked[1:], strict=True):
            out.append(int(own) if own is not None else out[v.parent] if v.parent else 0)
        return out

    return label


_weights: list[Weights] = []


def weights() -> Weights:
    """Trained once for each driver process."""
    if not _weights:
        _weights.append(train(labelled_pages()))
    return _weights[0]


def extract(page: str | None, w: Weights, threshold: float = 0.5) -> str:
    if not page:
        return ""
    nodes, runs = parse(page)
    infer(nodes, w)
    blocks, part, last = [], [], None
    for own, text in [*runs, (-1, "")]:
        if own != last:
            if last is not None and last >= 0 and nodes[last].p >= threshold:
                block = _SPACE.sub(" ", "".join(part)).strip()
                if block:
                    blocks.append(block)
            part, last = [], own
        part.append(text)
    return "\n".join(blocks)


def report(df: DataFrame, page_id: str = "page_id", url: str = "url", page: str = "html", threshold: float = 0.5) -> DataFrame:
    """page_id, url, text and n_chars of every row."""
    w = weights()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(x, w, threshold) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kind = df.schema[page_id].dataType.simpleString()
    return df.select(F.col(page_id), F.col(url), F.col(page)).mapInArrow(K.lean(run), f"page_id {kind}, url string, text string, n_chars bigint")
