"""Main text of web pages by a linear-chain conditional random field.

A page becomes its leaf blocks of text in page order, each with its chain of
ancestors. Features of a block are the tags and the words in class, id and
role of its ancestors, and measures of its text and links. A two-label chain
over the blocks of a page is trained by maximum likelihood on labelled pages
and decoded by Viterbi; the blocks labelled as content are the main text.

No table labels the blocks of a page, so the labelled pages are written by
``labelled_pages``: pages of many layouts whose parts are known. Their number
is the documented bound of what the model is fitted on.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veldra.session import ship_package

#: Labelled pages that the model is fitted on, and the seed of their layouts.
TRAINING_PAGES = 600
TRAINING_SEED = 7

BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html label legend li main menu nav noscript ol option p pre search section select summary table tbody td tfoot th thead title tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup: up to the end tag, or to the end of the page without one.
RAW_TAGS = frozenset("script style textarea".split())
#: Elements whose content a page doesn't show: up to the end tag; without one the start tag stands alone.
UNSHOWN_TAGS = frozenset("iframe noframes template".split())
#: Parts of a drawing that hold ordinary markup, and tags that end a drawing in which they stand.
DRAWING_PARTS = frozenset("foreignobject desc title".split())
DRAWING_ENDS = frozenset(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var "
    "article section main aside nav header footer form".split()
)
#: Open elements that the start of the key's element ends.
ENDED_BY = {
    "li": ("li", "p"), "dt": ("dt", "dd", "p"), "dd": ("dt", "dd", "p"), "tr": ("tr", "td", "th", "p"), "td": ("td", "th", "p"), "th": ("td", "th", "p"),
    "option": ("option",), "body": ("head",),
}
#: Elements that such an end does not reach over.
SCOPES = frozenset("ul ol dl table select menu body html article section div nav aside main header footer form".split())

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""", re.S)
_ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_XML = re.compile(r"<\?xml|XHTML|<html[^>]*\sxmlns=", re.I)
_WORD = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")

#: Words in class, id, role and the like, by what they say of an element (fixed value).
HINTS = {
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs toc pagination pager tabs toolbar skip dropdown",
    "head": "header masthead banner logo topbar branding",
    "foot": "footer copyright colophon legal bottom contentinfo",
    "side": "sidebar side aside widget rail complementary related recommended popular trending",
    "note": "cookie cookies consent notice gdpr alert modal popup overlay notification disclaimer paywall",
    "advert": "ad ads advert advertisement advertising adsense sponsor sponsored promo promotion banner",
    "form": "form login signup subscribe newsletter search contact feedback",
    "comment": "comment comments commentlist reply replies disqus discussion respond reader",
    "share": "share sharing social tags meta byline author",
    "content": "content article post entry story main body text articlebody page prose",
}
_HINT_OF: dict[str, list[str]] = {}
for _hint, _words in HINTS.items():
    for _word in _words.split():
        _HINT_OF.setdefault(_word, []).append(_hint)


class Block:
    __slots__ = ("text", "chain", "linked")

    def __init__(self, text: str, chain: tuple[tuple[str, frozenset[str]], ...], linked: float):
        self.text, self.chain, self.linked = text, chain, linked


def _hints(attributes: str) -> frozenset[str]:
    out: set[str] = set()
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name in ("class", "id", "role", "itemprop", "aria-label", "data-role"):
            spaced = re.sub(r"(?<=[a-z])(?=[A-Z])", " ", value).lower()
            for word in _WORD.findall(spaced):
                out.update(_HINT_OF.get(word, ()))
        elif name in ("hidden", "aria-hidden") and value.lower() != "false" or name == "style" and re.search(r"display\s*:\s*none", value):
            out.add("hidden")
    return frozenset(out)


_ENDS = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|\Z)", re.I) for tag in RAW_TAGS | UNSHOWN_TAGS | {"svg"}}
_TEMPLATE = re.compile(r"<(/?)template(?=[\s/>])[^>]*(?:>|\Z)", re.I)


def _after(page: str, tag: str, at: int, endless: set[str]) -> int:
    """Where an element whose start tag ends at ``at`` is over; templates may lie in templates. ``endless`` gathers the tags without a further end tag."""
    if tag not in endless:
        if tag == "template":
            depth = 1
            for found in _TEMPLATE.finditer(page, at):
                depth += -1 if found.group(1) else 1
                if not depth:
                    return found.end()
        elif over := _ENDS[tag].search(page, at):
            return over.end()
        endless.add(tag)
    return len(page) if tag in RAW_TAGS else at


def leaf_blocks(page: str) -> list[Block]:
    """The runs of text between the borders of block elements, in page order, with their block ancestors.

    Scripts, styles, typed text, templates, frames, drawings and comments have
    no text; what stands in for an object or a canvas, or where scripts don't
    run, has. A drawing ends at its end tag, at ``/>``, or before markup that
    can't stand in it; a template or frame without an end tag holds nothing.
    Character references are decoded after the markup is cut, white space
    becomes one space, and empty blocks are left out. Any string is a page.
    """
    xml = _XML.search(page, 0, 1000) is not None
    drawings = parts = 0
    endless: set[str] = set()
    blocks: list[Block] = []
    stack: list[tuple[str, frozenset[str]]] = []
    pieces: list[str] = []
    in_link = 0
    link_chars = 0
    hints: dict[str, frozenset[str]] = {}

    def close() -> None:
        nonlocal link_chars
        if pieces:
            text = _SPACE.sub(" ", html.unescape("".join(pieces))).strip()
            if text:
                blocks.append(Block(text, tuple(stack), min(1.0, link_chars / len(text))))
            pieces.clear()
        link_chars = 0

    at, size = 0, len(page)
    while at < size:
        found = _TOKEN.search(page, at)
        end = found.start() if found else size
        if end > at and not drawings:
            pieces.append(page[at:end])
            if in_link:
                link_chars += end - at
        if not found:
            break
        at = max(found.end(), end + 1)
        tag = found.group(2) or found.group(5)
        if not tag:
            if page.startswith("<![CDATA[", end) and not drawings:
                pieces.append(page[end + 9 : at - 3 if page.endswith("]]>", end, at) else at])
            continue
        tag = tag.lower()
        attributes = found.group(3) or found.group(6) or ""
        closing, alone = found.group(1) or found.group(4), attributes.endswith("/")
        if drawings:
            if tag == "svg" and (closing or not alone):
                drawings += -1 if closing else 1
                parts = parts if drawings else 0
                continue
            if tag in DRAWING_PARTS and (closing or not alone) and "svg" not in endless:
                parts = max(0, parts + (-1 if closing else 1))
            if closing and tag not in BLOCK_TAGS or parts or tag not in DRAWING_ENDS:
                continue
            if closing and not any(tag == name for name, _ in stack):
                continue
            drawings = 0
        if closing:
            if tag == "a":
                in_link = 0
            elif tag in BLOCK_TAGS:
                close()
                for depth in range(len(stack) - 1, -1, -1):
                    if stack[depth][0] == tag:
                        del stack[depth:]
                        in_link = 0
                        break
            continue
        if tag in RAW_TAGS or tag in UNSHOWN_TAGS:
            if not (alone and xml):
                at = _after(page, tag, at, endless)
        elif tag == "svg":
            drawings = 0 if alone else 1
            if "svg" not in endless and not _ENDS["svg"].search(page, at):
                endless.add("svg")
        elif tag == "br":
            pieces.append(" ")
        elif tag == "a":
            in_link = 1
        elif tag in BLOCK_TAGS:
            close()
            in_link = 0
            if tag == "hr":
                continue
            for depth in range(len(stack) - 1, -1, -1):
                name = stack[depth][0]
                if name in ENDED_BY.get(tag, ("p",)):
                    del stack[depth:]
                elif name in SCOPES:
                    break
            if attributes not in hints:
                hints[attributes] = _hints(attributes)
            stack.append((tag, hints[attributes]))
    close()
    return blocks


def features(block: Block) -> list[str]:
    out = ["bias", f"links:{min(3, int(block.linked * 4))}"]
    tags = {tag for tag, _ in block.chain}
    out += [f"in:{t}" for t in sorted(tags)]
    said: set[str] = set()
    for tag, own in block.chain:
        if tag not in ("body", "html"):
            said |= own
    out += [f"hint:{h}" for h in sorted(said)]
    if block.chain:
        tag, own = block.chain[-1]
        out.append(f"own:{tag}")
        out += [f"own-hint:{h}" for h in sorted(own)]
    if tags & {"article", "main"}:
        out.append("region:main")
    if tags & {"nav", "aside", "footer", "form", "head", "header", "button", "select", "label", "dialog"}:
        out.append("region:other")
    text = block.text
    words = text.count(" ") + 1
    out.append(f"words:{0 if words < 3 else 1 if words < 8 else 2 if words < 20 else 3 if words < 60 else 4}")
    if text[-1] in ".!?:…\"”":
        out.append("ends:sentence")
    if text[0] in "©&|›»":
        out.append("starts:mark")
    return out


class Chain:
    """A two-label linear-chain model: weights of features by label, of neighbouring labels, and of the first label."""

    def __init__(self, names: dict[str, int], emit: np.ndarray, step: np.ndarray, start: np.ndarray):
        self.names, self.emit, self.step, self.start = names, emit, step, start
        self.gain = emit[:, 1] - emit[:, 0]

    def decode(self, blocks: list[Block]) -> list[int]:
        """The likeliest labels, by Viterbi; of equal paths the one with label 0 earlier from the end."""
        if not blocks:
            return []
        names, emit = self.names, self.emit
        scores = [emit[[names[f] for f in features(b) if f in names]].sum(axis=0).tolist() for b in blocks]
        (s00, s01), (s10, s11) = self.step.tolist()
        zero, one = (self.start + scores[0]).tolist()
        back = []
        for e0, e1 in scores[1:]:
            a, b, c, d = zero + s00, one + s10, zero + s01, one + s11
            back.append((int(b > a), int(d > c)))
            zero, one = max(a, b) + e0, max(c, d) + e1
        label = int(one > zero)
        out = [label]
        for came in reversed(back):
            label = came[label]
            out.append(label)
        return out[::-1]


def fit(pages: Iterable[tuple[list[Block], list[int]]], rounds: int = 120, rate: float = 0.3, decay: float = 1e-3) -> Chain:
    """Maximum likelihood with a quadratic penalty, by forward-backward gradients over padded pages and adaptive steps."""
    names: dict[str, int] = {}
    rows: list[list[list[int]]] = []
    labels: list[list[int]] = []
    for blocks, own in pages:
        if blocks:
            rows.append([[names.setdefault(f, len(names)) for f in features(b)] for b in blocks])
            labels.append(own)
    count, longest = len(rows), max(map(len, rows))
    x = np.zeros((count, longest, len(names)), dtype=np.float32)
    y = np.zeros((count, longest), dtype=np.int64)
    there = np.zeros((count, longest), dtype=bool)
    for p, (page, own) in enumerate(zip(rows, labels)):
        for i, found in enumerate(page):
            x[p, i, found] = 1
        y[p, : len(own)] = own
        there[p, : len(own)] = True
    emit, step, start = np.zeros((len(names), 2)), np.zeros((2, 2)), np.zeros(2)
    sums = [np.full_like(w, 1e-8) for w in (emit, step, start)]
    flat = x.reshape(-1, len(names))
    truth = np.eye(2)[y] * there[..., None]
    for _ in range(rounds):
        score = (flat @ emit).reshape(count, longest, 2)
        ahead = np.zeros((count, longest, 2))
        ahead[:, 0] = start + score[:, 0]
        for i in range(1, longest):
            moved = np.logaddexp.reduce(ahead[:, i - 1, :, None] + step, axis=1) + score[:, i]
            ahead[:, i] = np.where(there[:, i, None], moved, ahead[:, i - 1])
        total = np.logaddexp.reduce(ahead[:, -1], axis=1)
        behind = np.zeros((count, longest, 2))
        g_step = np.zeros((2, 2))
        for i in range(longest - 2, -1, -1):
            reach = score[:, i + 1] + behind[:, i + 1]
            behind[:, i] = np.where(there[:, i + 1, None], np.logaddexp.reduce(step + reach[:, None, :], axis=2), 0)
            joint = np.exp(ahead[:, i, :, None] + step + reach[:, None, :] - total[:, None, None]) * there[:, i + 1, None, None]
            seen = truth[:, i, :, None] * truth[:, i + 1, None, :]
            g_step += (joint - seen).sum(axis=0)
        chance = np.exp(ahead + behind - total[:, None, None]) * there[..., None]
        excess = (chance - truth).reshape(-1, 2)
        gradients = [flat.T @ excess / count + decay * emit, g_step / count + decay * step, (chance[:, 0] - truth[:, 0]).sum(axis=0) / count + decay * start]
        for weight, gradient, seen in zip((emit, step, start), gradients, sums):
            seen += gradient**2
            weight -= rate * gradient / np.sqrt(seen)
    return Chain(names, emit, step, start)


def labelled_pages(count: int = TRAINING_PAGES, seed: int = TRAINING_SEED) -> list[tuple[str, list[int]]]:
    """Pages of many layouts, each with the labels of its leaf blocks (1: content)."""
    rnd, quirks = random.Random(seed), random.Random(seed + 1)

    def words(least: int, most: int, end: str = ".") -> str:
        return " ".join("".join(rnd.choice("abdefgiklmnoprstu") for _ in range(rnd.randint(2, 9))) for _ in range(rnd.randint(least, most))).capitalize() + end

    def put(tag: str, text: str, label: int, attributes: str = "") -> tuple[str, list[int]]:
        return f"<{tag}{attributes}>{text}</{tag}>", [label]

    def wrap(parts: list[tuple[str, list[int]]], tag: str, attributes: str = "") -> tuple[str, list[int]]:
        return f"<{tag}{attributes}>" + "".join(p for p, _ in parts) + f"</{tag}>", [x for _, own in parts for x in own]

    def named(*options: str) -> str:
        own = rnd.choice(options)
        return f' {rnd.choice(("class", "id"))}="{own}"' if own else ""

    def links(tag: str = "li", label: int = 0) -> list[tuple[str, list[int]]]:
        return [put(tag, f'<a href="/x">{words(1, 4, "")}</a>', label) for _ in range(rnd.randint(2, 7))]

    def prose(label: int) -> tuple[str, list[int]]:
        text = words(*rnd.choice(((1, 4), (5, 15), (20, 60), (60, 120))), rnd.choice((".", ".", "!", "?", "")))
        return put("p", f"<b>{text}</b>" if rnd.random() < 0.15 else f'{text} <a href="/y">{words(1, 3)}</a>' if rnd.random() < 0.2 else text, label)

    def article() -> list[tuple[str, list[int]]]:
        parts = [put("h1", words(2, 10, ""), 1)] if rnd.random() < 0.85 else []
        if parts and quirks.random() < 0.1:
            parts = [wrap(parts, "header", quirks.choice(("", ' class="entry-header"', ' class="post-header"')))]
        for _ in range(rnd.randint(1, 12)):
            kind = rnd.random()
            if kind < 0.7:
                parts.append(prose(1))
            elif kind < 0.8:
                parts.append(put(rnd.choice(("h2", "h3")), words(2, 7, ""), 1))
            elif kind < 0.87:
                parts.append(wrap([put("li", words(2, 20), 1) for _ in range(rnd.randint(2, 5))], rnd.choice(("ul", "ol"))))
            elif kind < 0.92:
                parts.append(wrap([prose(1)], "blockquote"))
            elif kind < 0.95:
                parts.append(put("pre", words(3, 20, ""), 1))
            elif kind < 0.96:
                parts.append(wrap([put(tag, words(1, 12, ""), 1) for tag in ("dt", "dd", "dt", "dd")], "dl"))
            elif kind < 0.97:
                parts.append(wrap([wrap([put("td", words(1, 5, ""), 1) for _ in range(3)], "tr") for _ in range(2)], "table"))
            else:
                parts.append(wrap([put("figcaption", words(3, 10), 1)], "figure"))
        return parts

    def aside_piece() -> tuple[str, list[int]]:
        kind = rnd.randrange(8)
        if kind == 0:
            return wrap([prose(0) for _ in range(rnd.randint(1, 2))], rnd.choice(("div", "section", "aside")), named("ad", "ads", "advert", "ad-slot", "sponsored", "promo-box", "advertisement"))
        if kind == 1:
            return wrap([put("h3", words(1, 3, ""), 0), *links()], rnd.choice(("aside", "div")), named("sidebar", "side-bar", "widget", "right-rail", "related", "related-posts"))
        if kind == 2:
            return wrap([prose(0), put("button", words(1, 2, ""), 0)], rnd.choice(("div", "section")), named("cookie-notice", "cookie-banner", "consent", "notice", "alert", "gdpr-popup"))
        if kind == 3:
            return wrap([put("label", words(1, 3, ""), 0), put("button", words(1, 2, ""), 0), prose(0)], "form", named("", "search", "newsletter", "subscribe-form", "login"))
        if kind == 4:
            return wrap(links(), "div", named("share", "social-share", "tags", "breadcrumbs"))
        if kind == 5:
            return wrap([prose(0) for _ in range(rnd.randint(1, 4))], "aside", rnd.choice(("", named("sidebar"))))
        if kind == 6:
            return wrap(links("p"), rnd.choice(("div", "section")), named("related", "recommended", "popular", "trending", "pagination"))
        return wrap([prose(0)], "div", named("promo", "banner", "disclaimer", "newsletter", "subscribe"))

    def comments() -> tuple[str, list[int]]:
        each = [wrap([put("p", words(1, 3, ""), 0), prose(0)], rnd.choice(("div", "li", "article")), named("comment", "reply", "comment-body", "reader-comment")) for _ in range(rnd.randint(1, 5))]
        return wrap([put("h2", words(1, 3, ""), 0), *each], rnd.choice(("section", "div", "ol")), named("comments", "commentlist", "discussion", "respond", "reader-comments"))

    out = []
    for _ in range(count):
        top: list[tuple[str, list[int]]] = []
        if rnd.random() < 0.6:
            inner = [put("h1" if rnd.random() < 0.3 else "p", words(1, 4, ""), 0)] + ([wrap(links(), "nav")] if rnd.random() < 0.5 else [])
            top.append(wrap(inner, *rnd.choice((("header", ""), ("header", ""), ("div", named("header", "masthead", "top-banner"))))))
        if rnd.random() < 0.8:
            top.append(wrap([wrap(links(), "ul")], *rnd.choice((("nav", ""), ("nav", ""), ("div", named("menu", "navigation", "nav-bar", "main-menu"))))))
        before = [aside_piece() for _ in range(rnd.choice((0, 0, 1, 1, 2)))]
        body = article()
        if rnd.random() < 0.4:
            body.insert(rnd.randint(1, len(body)), aside_piece())
        inside_comments = rnd.random() < 0.2
        if inside_comments:
            body.append(comments())
        if rnd.random() < 0.15:
            body.insert(0, wrap(links(), "nav"))
        if rnd.random() < 0.1:
            body.append(wrap([prose(0)], "footer"))
        holder = rnd.choice((("article", ""), ("article", ""), ("article", named("post", "entry")), ("main", ""), ("div", named("content", "post-content", "entry-content", "article-body", "story", "main-text", "post")), ("section", named("content", "article", "story-body"))))
        main = wrap(body, *holder)
        if rnd.random() < 0.3:
            main = wrap([main], *rnd.choice((("main", ""), ("div", named("main", "container", "wrapper", "page")))))
        after = [aside_piece() for _ in range(rnd.choice((0, 0, 1, 2)))]
        if not inside_comments and rnd.random() < 0.4:
            after.append(comments())
        foot = [wrap([prose(0) if rnd.random() < 0.5 else put("p", "&copy; " + words(1, 6), 0), *(links() if rnd.random() < 0.5 else [])], *rnd.choice((("footer", ""), ("footer", ""), ("div", named("footer", "site-footer", "copyright")))))] if rnd.random() < 0.85 else []
        page, labels = wrap([*top, *before, main, *after, *foot], "body")
        if quirks.random() < 0.08:  # cells of a table as the parts of a page
            cell = lambda own, *names: wrap(own, "td", f' {quirks.choice(("class", "id"))}="{quirks.choice(names)}"')
            rows = [wrap([cell([put("p", words(1, 5, ""), 0)] if quirks.random() < 0.5 else [(words(1, 5, ""), [0])], "header", "banner", "top")], "tr")]
            rows.append(wrap([cell(links("p"), "menu", "nav", "sidebar"), cell(article(), "content", "main", "text")], "tr"))
            rows.append(wrap([cell([(words(2, 9, ""), [0])], "footer", "bottom", "copyright")], "tr"))
            out.append((f"<html><head><title>{words(2, 8, '')}</title></head><body>{wrap(rows, 'table')[0]}</body></html>", [0, *(x for _, own in rows for x in own)]))
            continue
        if quirks.random() < 0.1:
            top.insert(0, wrap([put("p", words(4, 12), 0)], "noscript"))
            page, labels = wrap([*top, *before, main, *after, *foot], "body")
        if rnd.random() < 0.15:  # a bare article, as feeds and archives have it
            page, labels = wrap([main], "body") if rnd.random() < 0.7 else main
            out.append((page, labels))
            continue
        out.append((f"<!DOCTYPE html><html><head><title>{words(2, 8, '')}</title><style>p{{}}</style></head>{page}</html>", [0, *labels]))
    return out


@lru_cache(maxsize=1)
def trained() -> Chain:
    """The model; fitting it takes seconds and always gives the same weights."""
    pairs = [(leaf_blocks(page), labels) for page, labels in labelled_pages()]
    return fit([(blocks, labels) for blocks, labels in pairs if len(blocks) == len(labels)])


def main_text(page: str, model: Chain) -> str:
    blocks = leaf_blocks(page)
    return "\n".join(b.text for b, label in zip(blocks, model.decode(blocks)) if label)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", model: Chain | None = None) -> DataFrame:
    """``page_id``, ``url`` and the main ``text`` of every row, in one pass without a shuffle.

    A null or empty page has the empty text; a page of any length is read
    whole. The model is some kilobytes and travels with the kernel. Rows may
    repeat, ids and urls may be null; other columns are ignored, whatever their
    names. An empty table gives no rows.
    """
    ship_package(pages.sparkSession)
    model = model or trained()

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                some = batch.slice(at, 500)
                texts = [main_text(page, model) for page in some.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([some.column("page_id"), some.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    return rows.mapInArrow(kernel, "page_id long, url string, text string")
