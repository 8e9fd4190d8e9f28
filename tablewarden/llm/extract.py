"""Main text of web pages: a linear-chain conditional random field over the leaf blocks of the DOM.

A page is cut into leaf blocks, the runs of text between block elements.  Each block has features of its ancestors (tags, and
words of their classes and ids) and of its text; the field tags it as main or other, and Viterbi decodes the page.  It is
trained on a bounded sample of pages that mark their article themselves, and on labelled pages of other layouts made by rule.
"""

from __future__ import annotations

import functools
import html as entities
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import crf
from .common import batches_by_size, rows_of

OTHER, MAIN = 0, 1
# Names of HTML elements by what they do.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style title noscript iframe textarea noembed noframes xmp".split())  # their content is no markup
CONTROL = set("template svg object canvas select button".split())  # markup whose text is no text of the page
HEAD = set("base link meta title style script noscript template".split())
BLOCK = set(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html "
    "legend li main menu nav ol p pre search section summary table tbody td tfoot th thead title tr ul".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
HOLDS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}}
# Parts that are no main text even inside an article.
CHROME = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "search"}

MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*+)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+|[^>]*+)(?:>|\Z)", re.DOTALL)
NAMED = re.compile(r"\b(?:class|id|role|data-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
WORDS = re.compile(r"[A-Za-z]+")
ANY_CONTROL = re.compile(rf"<(?:{'|'.join(sorted(CONTROL))})[\s/>]", re.IGNORECASE)
MARKED = "label main"  # set by data-label="label main" in pages made for training


@dataclass
class Block:
    text: str
    above: frozenset  # names of the ancestors
    tag: str  # nearest block element
    linked: int  # characters within links


@dataclass
class _Page:
    """Open elements, and the text since the last block boundary."""

    stack: list[tuple[str, list[str]]] = field(default_factory=list)
    above: Counter = field(default_factory=Counter)
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    blocks: list[Block] = field(default_factory=list)
    tags: list[str] = field(default_factory=lambda: [""])

    def push(self, tag: str, names: list[str]) -> None:
        self.stack.append((tag, names))
        self.above.update(names)
        if tag in BLOCK:
            self.tags.append(tag)

    def pop(self, at: int = -1) -> None:
        tag, names = self.stack.pop(at)
        for name in names:
            self.above[name] -= 1
            if not self.above[name]:
                del self.above[name]
        if tag in BLOCK:
            self.tags.pop()

    def end_block(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                self.blocks.append(Block(text, frozenset(self.above), self.tags[-1], self.linked))
            self.parts, self.linked = [], 0

    def close_to(self, closed: set[str], walls: set[str]) -> None:
        """Close the innermost open element of ``closed`` that no wall stands before, with all inside it."""
        for at in range(len(self.stack) - 1, -1, -1):
            tag = self.stack[at][0]
            if tag in closed:
                while len(self.stack) > at:
                    self.pop()
                return
            if tag in walls:
                return


def blocks_of(html: str) -> list[Block]:
    """Leaf blocks in page order, text decoded and its white space folded.  Head, scripts, styles, controls and comments give none."""
    page, at, ends = _Page(), 0, control_ends(html)
    while at < len(html):
        m = MARKUP.search(html, at)
        text = html[at : m.start()] if m else html[at:]
        if text and "tag head" not in page.above:
            text = entities.unescape(text) if "&" in text else text
            page.parts.append(text)
            if "tag a" in page.above:
                page.linked += len(text.strip())
        if not m:
            break
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            _end(page, tag)
        elif tag in RAW:
            close = _raw_end(tag).search(html, at)
            if not m[3].endswith("/"):
                at = close.end() if close else len(html)
            page.parts.append(" ")
        elif tag in CONTROL:
            if not m[3].endswith("/"):
                at = ends.get(at, at)
            page.parts.append(" ")
        else:
            _start(page, tag, m[3])
    page.end_block()
    return page.blocks


def control_ends(html: str) -> dict[int, int]:
    """Where each control that is closed by its own end tag ends, by the place after its start tag.  One pass over the page's tags: an end
    tag closes what is open inside its element, and a button or select ends with the next one of its kind, both without an end of their own."""
    ends: dict[int, int] = {}
    if not ANY_CONTROL.search(html):
        return ends
    stack: list[tuple[str, int]] = []
    held, at = Counter(), 0
    while m := MARKUP.search(html, at):
        at, tag = m.end(), (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if held[tag]:
                while True:
                    name, start = stack.pop()
                    held[name] -= 1
                    if name == tag:
                        break
                if tag in CONTROL and start >= 0:
                    ends[start] = at
        elif tag in RAW:
            close = _raw_end(tag).search(html, at)
            if not m[3].endswith("/"):
                at = close.end() if close else len(html)
        elif tag not in VOID and not m[3].endswith("/"):
            if tag in {"button", "select"} and held[tag]:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == tag and stack[i][1] >= 0:
                        stack[i] = tag, -1
                        break
            stack.append((tag, at))
            held[tag] += 1
    return ends


@functools.cache
def _raw_end(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*>?", re.IGNORECASE)


def _start(page: _Page, tag: str, attributes: str) -> None:
    if tag == "body" or ("tag head" in page.above and tag not in HEAD):
        page.close_to({"head"}, set())
    if tag == "br":
        page.parts.append(" ")
    if tag in BLOCK:
        page.end_block()
        page.close_to({"p"}, BLOCK - {"p"})
        if tag in CLOSES:
            page.close_to(CLOSES[tag], HOLDS[tag])
    if tag in VOID or attributes.endswith("/"):
        return
    names = {f"tag {tag}"}
    for groups in NAMED.findall(attributes) if "=" in attributes else ():
        value = "".join(groups)
        names |= {MARKED} if value == MARKED else {f"name {w.lower()}" for w in WORDS.findall(value)}
    page.push(tag, sorted(names))


def _end(page: _Page, tag: str) -> None:
    if f"tag {tag}" not in page.above:
        return
    if tag in BLOCK:
        page.end_block()
        page.close_to({tag}, set())
        return
    for at in range(len(page.stack) - 1, -1, -1):  # an inline end tag leaves the blocks inside it open
        if page.stack[at][0] == tag:
            page.pop(at)
            return


def _look(block: Block) -> tuple[int, int, bool]:
    """A block as its neighbours see it: words, share of links, whether it reads like a sentence."""
    return min((block.text.count(" ") + 1).bit_length(), 6), min(block.linked * 4 // len(block.text), 4), block.text[-1] in ".!?…:\"'"


def text_features(block: Block, first: bool, near: tuple = (None, None)) -> tuple[str, ...]:
    """Features of the text, and of the blocks before and after it (None at the ends of the page)."""
    n, (words, linked, ends) = len(block.text), _look(block)
    prose = words >= 4 and linked == 0 and ends
    around = [f"{side} {'none' if look is None else 'links' if look[1] > 1 else 'prose' if look[0] >= 4 and look[2] else 'short'}" for side, look in zip(("before", "after"), near)]
    return (f"block {block.tag}", f"words {words}", f"linked {linked}", f"ends {ends}", f"stops {min(block.text.count('. '), 3)}", f"sign {'©' in block.text or '|' in block.text}",
            f"first {first}", f"prose {prose}", *around, f"heading {block.tag[:1] == 'h' and block.tag[1:].isdigit()} {around[1]}", "always")


def looks_around(blocks: list[Block]) -> list[tuple]:
    looks = [None, *map(_look, blocks), None]
    return list(zip(looks, looks[2:]))


def above_features(block: Block) -> list[str]:
    return [f"in {name}" for name in block.above if name != MARKED]


class Tagger:
    """Decodes pages; scores of equal features are worked out once per task (bounded tables)."""

    def __init__(self, chain: crf.Chain, most: int = 50_000):
        self._chain, self._most, self._known = chain, most, {}
        self._move, self._first, self._last = chain.move.tolist(), chain.first.tolist(), chain.last.tolist()

    def _score(self, key, names) -> tuple[float, float]:
        if key not in self._known:
            if len(self._known) >= self._most:
                self._known.clear()
            self._known[key] = tuple(self._chain.emission(names).tolist())
        return self._known[key]

    def tags(self, blocks: list[Block]) -> list[int]:
        """Viterbi over two tags; ties go to other."""
        best, back = list(self._first), []
        around = looks_around(blocks)
        for i, block in enumerate(blocks):
            own = text_features(block, i == 0, around[i])
            a, b = self._score(block.above, above_features(block)), self._score(own, own)
            scores = a[0] + b[0], a[1] + b[1]
            if i:
                came, step = [0.0, 0.0], [0, 0]
                for tag in (OTHER, MAIN):
                    stay, turn = best[OTHER] + self._move[OTHER][tag], best[MAIN] + self._move[MAIN][tag]
                    came[tag], step[tag] = (turn, MAIN) if turn > stay else (stay, OTHER)
                back.append(step)
                best = came
            best = [best[0] + scores[0], best[1] + scores[1]]
        if not blocks:
            return []
        tags = [MAIN if best[MAIN] + self._last[MAIN] > best[OTHER] + self._last[OTHER] else OTHER]
        for step in reversed(back):
            tags.append(step[tags[-1]])
        return tags[::-1]

    def main_text(self, html: str | None) -> str:
        blocks = blocks_of(html or "")
        return "\n".join(b.text for b, tag in zip(blocks, self.tags(blocks)) if tag == MAIN)


def own_labels(html: str) -> tuple[list[Block], list[int]] | None:
    """Blocks and tags of a page that marks its article itself: exactly one article element (or else one main element)."""
    blocks = blocks_of(html)
    for tag in ("article", "main"):
        if len(re.findall(rf"<{tag}[\s>]", html, re.IGNORECASE)) == 1:
            inside = [f"tag {tag}" in b.above and not any(f"tag {c}" in b.above for c in CHROME) for b in blocks]
            return blocks, [MAIN if x else OTHER for x in inside]
    return None


def made_pages(n: int = 400, seed: int = 11) -> list[str]:
    """Labelled pages of many layouts, made by rule: main parts carry ``data-label``."""
    draw = random.Random(seed)
    word = lambda: "".join(draw.choices("etaoinshrdlucmfwyp", k=draw.randint(1, 9)))
    some = lambda k: " ".join(word() for _ in range(draw.randint(1, k))).capitalize()
    prose = lambda: " ".join(some(14) + draw.choice([".", ".", "!", "?", ","]) for _ in range(draw.choice([1, 1, 2, 4, 9])))
    links = lambda k: "".join(f'<li><a href="/{word()}">{some(3)}</a></li>' for _ in range(draw.randint(1, k)))
    mark = f' data-label="{MARKED}"'
    named = lambda names: draw.choice([f'class="{draw.choice(names)}"', f'id="{draw.choice(names)}"'])

    def chrome(tag: str, names: list[str]) -> str:
        tag = draw.choice([tag, "div", "section"])
        inner = draw.choice([lambda: f"<ul>{links(8)}</ul>", lambda: f"<p>{prose()}</p>", prose, lambda: f"<h3>{some(3)}</h3><p>{prose()}</p><ul>{links(4)}</ul>"])()
        return f"<{tag} {named(names)}>{inner}</{tag}>"

    def notice() -> str:
        return draw.choice([
            lambda: chrome("div", ["notice", "cookie-notice", "consent banner", "alert", "gdpr", "cookies", "privacy-bar"]), lambda: chrome("div", ["ad", "ads", "advert", "sponsored promo", "banner"]),
            lambda: f'<form {named(["search", "newsletter", "subscribe", "login"])}><label>{some(3)}</label><input><p>{prose()}</p></form>',
            lambda: chrome("aside", ["sidebar", "related", "widget", "share social", "secondary", "widget-area", "more-stories"]), lambda: f"<aside><h4>{some(3)}</h4><p>{prose()}</p></aside>"])()

    def comments() -> str:
        body = "".join(f'<{t} class="comment"><b>{word()}</b><p>{prose()}</p></{t}>' for t in [draw.choice(["div", "li", "article"])] * draw.randint(1, 4))
        return f'<section {named(["comments", "comment-list", "responses comments", "discussion", "respond", "replies"])}><h3>{some(2)}</h3>{body}</section>'

    pages = []
    for _ in range(n):
        bare_page = draw.random() < 0.2  # a few short blocks and nothing around them
        body = [] if bare_page or draw.random() < 0.2 else [f"<h{draw.choice('112')}>{some(9)}</h2>"]
        for _ in range(draw.randint(1, 2) if bare_page else draw.randint(1, 12)):
            body.append(draw.choice([
                lambda: f"<p>{prose()}</p>", lambda: f"<p>{some(3)}.</p>", lambda: f"<p>{some(4)} | {some(2)}</p>", lambda: f"<p>{some(2)}. |</p>", lambda: f"<p>{prose()} <a href='#'>{some(2)}</a> <em>{prose()}</em></p>", lambda: f"<p><b>{prose()}<br>",
                lambda: f"<h2>{some(6)}</h2>", lambda: f"<ul><li>{prose()}</li><li>{some(5)}</li></ul>", lambda: f"<blockquote>{prose()}</blockquote>", lambda: f"<div>{prose()}</div>",
                lambda: f"<pre>{prose()}</pre>", lambda: f"<table><tr><td>{some(3)}</td><td>{some(3)}</td></tr></table>"])())
        spots = [f"<div{mark}>{x}</div>" if draw.random() < 0.1 else None or x for x in body]
        wrap = draw.choice(["<article{m}>", "<main{m}>", '<div class="content"{m}>', '<div id="post-body"{m}>', '<section class="entry article"{m}>', '<div id="primary"{m}>', '<div class="story"{m}>', '<td{m}>', "<article class='post'{m}>"]).format(m=mark)
        tag = wrap[1:].split()[0]
        inner = "".join(spots)
        if not bare_page and draw.random() < 0.35:  # a notice inside the main part ends it and begins it anew
            cut = draw.randint(1, len(spots))
            outer = draw.choice(["article", "div class='page'", "main"])
            name = outer.split()[0]
            inner = f"<{outer}>{wrap}{''.join(spots[:cut])}</{tag}>{notice()}{wrap}{''.join(spots[cut:])}</{tag}>{comments() if draw.random() < 0.5 else ''}</{name}>"
        else:
            inner = f"{wrap}{inner}</{tag}>"
        head = [chrome("nav", ["menu", "nav", "navigation", "breadcrumb"]), chrome("header", ["header", "masthead", "top", "site-title"]), notice()]
        foot = [chrome("footer", ["footer", "bottom", "copyright"]), notice(), comments(), f"<footer>&copy; {word()} &middot; {prose()}</footer>"]
        bare = [f"<nav><ul>{links(8)}</ul></nav>", f"<header><h1>{some(4)}</h1></header>"]
        pages.append("<html><body>" + "".join(draw.sample(head + bare, 0 if bare_page else draw.randint(0, 4))) + inner + "".join(draw.sample(foot, 0 if bare_page else draw.randint(0, 3))) + "</body></html>")
    return pages


def foreign_pages(n: int = 500, seed: int = 12) -> list[str]:
    """Labelled pages whose names and elements say nothing: div-only, table and bare layouts, where length, links and neighbours tell
    the main part from menus, footers and short notes."""
    draw = random.Random(seed)
    word = lambda: "".join(draw.choices("etaoinshrdlucmfwyp", k=draw.randint(1, 9)))
    some = lambda k: " ".join(word() for _ in range(draw.randint(1, k))).capitalize()
    prose = lambda: " ".join(" ".join(word() for _ in range(draw.randint(5, 18))).capitalize() + draw.choice([".", ".", "!", "?"]) for _ in range(draw.choice([1, 2, 3, 6])))
    name = lambda: draw.choice(["", "", f' class="{word()}"', f' id="{word()}-{word()}"'])
    link = lambda: f'<a href="/{word()}">{some(3)}</a>'
    mark = f' data-label="{MARKED}"'

    def aside() -> str:
        return draw.choice([
            lambda: "<ul>" + "".join(f"<li>{link()}</li>" for _ in range(draw.randint(2, 9))) + "</ul>", lambda: " | ".join(link() for _ in range(draw.randint(2, 6))),
            lambda: "".join(f"<div>{link()}</div>" for _ in range(draw.randint(2, 6))), lambda: f"&copy; 20{draw.randint(10, 29)} {some(3)} | {link()}", lambda: f"<p>{some(3)}</p>",
            lambda: f"<h3>{some(2)}</h3><ul><li>{link()}</li><li>{link()}</li></ul>", lambda: f"<p>{link()} {link()}</p>"])()

    def body() -> str:
        made = [f"<h{draw.choice('112')}>{some(8)}</h1>"] if draw.random() < 0.6 else []
        for _ in range(draw.randint(1, 9)):
            made.append(draw.choice([
                lambda: f"<p>{prose()}</p>", lambda: f"<p>{prose()}</p>", lambda: f"<p>{prose()} {link()} {prose()}</p>", lambda: f"<div>{prose()}</div>", lambda: f"<h2>{some(6)}</h2><p>{prose()}</p>",
                lambda: f"<p>{prose()}</p><ul><li>{some(6)}</li><li>{some(9)}</li></ul><p>{prose()}</p>", lambda: f"<blockquote>{prose()}</blockquote>", lambda: f"{prose()}<br><br>{prose()}"])())
        return "".join(made)

    pages = []
    for _ in range(n):
        kind = draw.choice(["bare", "div", "div", "div", "table"])
        if kind == "bare":
            page = f"<span{mark}>{body()}</span>" if draw.random() < 0.3 else f"<div{mark}>{body()}</div>"
        elif kind == "div":
            parts = [f"<div{name()}>{aside()}</div>" for _ in range(draw.randint(1, 3))] + [f"<div{name()}{mark}>{body()}</div>"] + [f"<div{name()}>{aside()}</div>" for _ in range(draw.randint(0, 3))]
            page = f"<div{name()}>{''.join(parts)}</div>"
        else:
            page = f"<table><tr><td{name()}>{aside()}</td><td{name()}{mark}>{body()}</td>{f'<td>{aside()}</td>' if draw.random() < 0.4 else ''}</tr></table>"
        pages.append(f"<html><body>{page}</body></html>")
    return pages


def _training(blocks: list[Block], tags: list[int]) -> tuple[list[list[str]], list[int]]:
    return [[*above_features(b), *text_features(b, i == 0, near)] for i, (b, near) in enumerate(zip(blocks, looks_around(blocks)))], tags


def train(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", most: int = 400, blocks_per_page: int = 200) -> crf.Chain:
    """Fit the field on at most ``most`` pages that mark their article, those whose id hashes lowest, up to ``blocks_per_page``
    blocks each, and on pages made by rule, which alone serve an empty table."""
    flat = rows_of(pages, page_id=F.col(id_col).cast("bigint"), html=html_col)
    drawn = flat.select("page_id").dropna().distinct().orderBy(F.xxhash64("page_id"), "page_id").limit(most)

    def label(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [_training(b[:blocks_per_page], t[:blocks_per_page]) for b, t in filter(None, map(own_labels, frame["html"].dropna()))]
            if found:
                yield pd.DataFrame({"x": [x for x, _ in found], "y": [y for _, y in found]})

    # A page may teach what its own markup says, but not that nothing else is an article: as many pages have no telling names.
    rows = flat.join(F.broadcast(drawn), "page_id").select("html").mapInPandas(label, "x array<array<string>>, y array<int>").collect()
    pairs = sorted((([list(t) for t in r["x"]], list(r["y"])) for r in rows), key=str)
    for html in made_pages() + foreign_pages():
        blocks = blocks_of(html)
        pairs.append(_training(blocks, [MAIN if MARKED in b.above else OTHER for b in blocks]))
    return crf.fit([x for x, _ in pairs], [y for _, y in pairs], 2, penalty=0.1, rounds=120)


def extract(pages: DataFrame, chain: crf.Chain, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: ``page_id``, ``url``, ``text`` (blocks joined by a line end; empty if none), ``n_chars`` (code points).

    Null html counts as empty; broken, cut-off and very long pages are read as far as they go; repeated rows and null ids are
    kept as they are; an empty table gives no rows.
    """
    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tagger = Tagger(chain)
        for frame in batches_by_size(frames, "html", 16_000_000):
            texts = [tagger.main_text(html) for html in frame["html"]]
            yield pd.DataFrame({"page_id": frame["page_id"].astype("Int64"), "url": frame["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    flat = rows_of(pages, page_id=F.col(id_col).cast("bigint"), url=F.col(url_col).cast("string"), html=html_col)
    return flat.mapInPandas(work, "page_id bigint, url string, text string, n_chars bigint")
