"""Main text of web pages by scoring the tree of elements.

A page is read into a tree of elements and *blocks*: stretches of text without a block-level tag in between. Each
paragraph gives points (one, one for each comma, one for each hundred characters up to three) to its element, all of them to the
parent, half to the grandparent, and a third, a sixth and so on further up; elements start with points for their kind.
An element's points are discounted by its link density. The best container is kept with those of its siblings that
score at least a fifth of it or are plain paragraphs of text, and with the headings before it. Within what is kept, menus, headers, footers, sidebars,
notices, adverts, forms and reader comments are left out, told by tag, role, class and id, and so are lists of links.

Where all that has left out half of a page's text or more, the page is looked at again without names and with its forms: a form with little text for
each of its fields stays out, one that wraps a page doesn't; and a form or block with half of the text and a headline or ``main`` in it is not left out for its name.

Defined results: null and empty pages give an empty text; broken markup is read as browsers do where it matters
(unclosed paragraphs and list items end at the next one, stray end tags are ignored, an unfinished tag or comment
runs to the end); text of any length is kept whole; equal pages give equal texts. Other columns play no part.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TAG = re.compile(r"""<(?:(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<more>(?:[^>"']+|"[^"]*"|'[^']*')*+)>|(?P<rough>/?[a-zA-Z][^>]*>)|(?P<comment>!--)|(?P<other>[!?/][^>]*>))""")
ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden|style)(?![\w-])\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.IGNORECASE)

# HTML's elements by kind.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe noembed noframes xmp".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul video audio canvas object svg math".split())
LEFT_OUT = frozenset("head nav footer aside button select datalist dialog menu search fieldset label svg math canvas object audio video script style textarea title noscript template iframe noembed noframes".split())
CLOSED_BY = {"p": BLOCK - {"body", "html", "head", "option", "optgroup"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot", "thead"}, "td": {"td", "th", "tr", "tbody", "tfoot"}, "th": {"td", "th", "tr", "tbody", "tfoot"}, "option": {"option", "optgroup"}, "head": {"body"}}
#: What an implied end doesn't reach beyond.
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "p": {"td", "th", "table", "button", "object", "body", "div", "article", "section", "main", "li", "blockquote"}, "option": {"select"}}
KIND = {"article": 25.0, "main": 20.0, "section": 3.0, "div": 5.0, "pre": 3.0, "td": 3.0, "blockquote": 3.0, "ol": -3.0, "ul": -3.0, "dl": -3.0, "dd": -3.0, "dt": -3.0, "li": -3.0, "form": -3.0, "th": -5.0, "h1": -5.0, "h2": -5.0, "h3": -5.0}
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
# Words of class and id names. A name says what a block is with its last part: ``post-comments`` are comments, a
# ``notice-board`` is a board. Where the last part is only a wrapper, any other part says it.
BOILERPLATE = frozenset(
    "ad ads adsense adslot adunit banner banners sponsor sponsored promo promos promotion comment comments commentlist disqus respond replies reply sidebar rail widget widgets nav navbar navigation menu menus "
    "breadcrumb breadcrumbs pager pagination footer masthead header topbar toolbar cookie cookies cookiebar consent gdpr notice notices alert alerts popup modal overlay newsletter subscribe subscription signup login "
    "responses feedback social share sharing sharebar related recommended recommendations outbrain taboola paywall advert adverts advertisement advertisements advertising".split()
)
WRAPPERS = frozenset("content contents wrapper wrap container inner outer box area section block blocks list item items row col column body bar panel holder group form links link button buttons widget title top bottom left right main js posts articles stories news".split())
#: Parts that make a header one of an article, and first parts of names that speak of a layout.
ARTICLE = frozenset("article post entry content story".split())
LAYOUT = frozenset("with without has no not is".split())
FIELDS = frozenset("input select textarea button".split())
#: Characters that a form's text has for each of its fields if it wraps an article.
FORM_TEXT = 200
PART = re.compile(r"[A-Za-z][a-z]+|[A-Z]+(?![a-z])|[a-z]")


def boilerplate(names: str) -> bool:
    """Whether one of the names of a block says that it is no part of an article."""
    for name in names.split():
        parts = [x.lower() for x in PART.findall(name)]
        if parts and parts[0] in LAYOUT:
            continue
        while len(parts) > 1 and parts[-1] in WRAPPERS and parts[-1] not in BOILERPLATE:
            parts.pop()
        if parts and parts[-1] in BOILERPLATE and not (parts[-1] == "header" and ARTICLE & set(parts)):
            return True
        if parts and parts[-1] not in ARTICLE and any(x in ("sidebar", "advert", "advertisement", "comment", "comments", "cookie", "disqus") for x in parts):
            return True
    return False


class Element:
    __slots__ = ("characters", "depth", "fields", "headed", "linked", "links", "name", "named", "out", "parent", "points", "said")

    def __init__(self, name: str, parent: Element | None, said: dict[str, str], named: bool = True):
        self.name, self.parent, self.said, self.named = name, parent, said, named
        self.depth = parent.depth + 1 if parent else 0
        self.points: float | None = None
        self.characters = self.linked = self.links = self.fields = 0
        self.headed = False
        self.out = bool(parent and parent.out) or self._left_out()

    def _left_out(self) -> bool:
        if self.name in LEFT_OUT:
            return True
        if self.name in ("html", "body", "article", "main"):
            return False
        if self.name == "header" and not self.within("article") and not self.within("main") and not self._article_header():
            return True
        if not self.said:
            return False
        names = f"{self.said.get('class', '')} {self.said.get('id', '')}"
        hidden = "hidden" in self.said or self.said.get("aria-hidden") == "true" or "display:none" in self.said.get("style", "").replace(" ", "").lower()
        return hidden or self.said.get("role", "").lower() in ROLES or (self.named and (self.name in BLOCK or self.name in ("span", "a")) and boilerplate(names))

    def _article_header(self) -> bool:
        return any(ARTICLE & {x.lower() for x in PART.findall(name)} for name in f"{self.said.get('class', '')} {self.said.get('id', '')}".split())

    def within(self, name: str) -> bool:
        up = self.parent
        while up and up.name != name:
            up = up.parent
        return up is not None

    def density(self) -> float:
        return self.linked / self.characters if self.characters else 0.0


class Page:
    """The elements and blocks of a page; blocks come in page order as (element, text). Elements have the same numbers in every reading; ``spared``
    ones are not left out for their names, ``forms`` are those that stay (null: none)."""

    def __init__(self, source: str, named: bool = True, spared: frozenset[int] = frozenset(), forms: frozenset[int] | None = frozenset()):
        self.named, self.spared, self.forms, self.lost = named, spared, forms, 0
        self.blocks: list[tuple[Element, str]] = []
        self.elements: list[Element] = []
        self.parts: list[str] = []
        self.anchor_parts: list[str] = []
        self.at = self.root = Element("html", None, {})
        self.elements.append(self.root)
        self.inline: list[tuple[str, bool]] = []  # open inline elements, and whether each leaves its text out
        self.links = 0
        self._read(source)

    def _text(self, piece: str) -> None:
        if self.at.out:
            self.lost += len(piece)
        elif piece and not any(out for _, out in self.inline):
            self.parts.append(piece)
            if any(name == "a" for name, _ in self.inline):
                self.anchor_parts.append(piece)

    def _end_block(self) -> None:
        if self.parts:
            text = " ".join(html.unescape("".join(self.parts)).split())
            if text:
                linked = len(" ".join(html.unescape("".join(self.anchor_parts)).split()))
                self.blocks.append((self.at, text))
                up: Element | None = self.at
                while up:
                    up.characters += len(text)
                    up.linked += linked
                    up.links += self.links
                    up = up.parent
            self.parts.clear()
        self.anchor_parts.clear()
        self.links = 0

    def _open(self, name: str, more: str) -> None:
        said = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(more)} if more else {}
        if name not in BLOCK:
            if name == "br":
                self._text(" ")
            elif name not in VOID:
                probe = Element(name, self.at, said, self.named) if said else None
                self.inline.append((name, name in LEFT_OUT or bool(probe and probe.out)))
                self.links += name == "a"
            return
        self._end_block()
        self.inline.clear()
        for ends, by in CLOSED_BY.items():
            if name in by:
                up = self.at
                while up.parent and up.name != ends and up.name not in SCOPE.get(ends, ()):
                    up = up.parent
                if up.name == ends and up.parent:
                    self.at = up.parent
        if name in ("html", "hr") or (name == "body" and self.at.within("body")):
            return
        number = len(self.elements)
        self.at = Element(name, self.at, said, self.named and number not in self.spared)
        if name == "form" and self.forms is not None and number not in self.forms:
            self.at.out = True
        self.elements.append(self.at)
        if name in ("h1", "main"):
            self._mark("headed", True)

    def _mark(self, what: str, value: bool | int) -> None:
        up: Element | None = self.at
        while up:
            setattr(up, what, value if what == "headed" else getattr(up, what) + value)
            up = up.parent

    def _close(self, name: str) -> None:
        if name not in BLOCK:
            for i in range(len(self.inline) - 1, -1, -1):
                if self.inline[i][0] == name:
                    del self.inline[i:]
                    break
            return
        up: Element | None = self.at
        while up and up.name != name:
            up = up.parent
        if up and up.parent:
            self._end_block()
            self.inline.clear()
            self.at = up.parent

    def _read(self, source: str) -> None:
        at = 0
        lower = None
        while m := TAG.search(source, at):
            self._text(source[at : m.start()])
            at = m.end()
            if m["comment"]:
                end = source.find("-->", m.start() + 2)
                at = len(source) if end < 0 else end + 3
            elif m["rough"] or m["name"]:
                own = m["rough"] or ""
                name = (m["name"] or re.match(r"/?([^\s/>]*)", own)[1]).lower()
                if m["end"] or own.startswith("/"):
                    self._close(name)
                elif name in RAW:
                    if name in FIELDS:
                        self._mark("fields", 1)
                    lower = lower or source.lower()
                    end = lower.find("</" + name, at) if len(lower) == len(source) else source.find("</" + name, at)
                    stop = source.find(">", end) if end >= 0 else -1
                    at = len(source) if stop < 0 else stop + 1
                else:
                    self._open(name, m["more"] or own)
                    if name in FIELDS and not re.search(r"type\s*=\s*[\"']?hidden", m["more"] or own, re.IGNORECASE):
                        self._mark("fields", 1)
        rest = source[at:]
        broken = re.search(r"<(?:[a-zA-Z/!?])", rest)
        self._text(rest[: broken.start()] if broken else rest)
        self._end_block()

    def score(self) -> None:
        for element, text in self.blocks:
            if len(text) < 25 or element.name in HEADINGS:
                continue
            points = 1 + text.count(",") + text.count("，") + text.count("、") + min(len(text) / 100, 3)
            # Text right inside a container is a paragraph of it; else its element is one, and the parent contains it.
            up = element if element.name in ("div", "article", "main", "section", "td", "body", "blockquote") else element.parent
            level = 0
            while up:
                if up.points is None:
                    up.points = KIND.get(up.name, 0.0)
                up.points += points / (1 if level == 0 else 2 if level == 1 else 3 * level)
                up, level = up.parent, level + 1

    def best(self) -> Element | None:
        scored = [e for e in self.elements if e.points is not None and not e.out and e.name != "html"]
        if scored:
            return max(scored, key=lambda e: (e.points * (1 - e.density()), -e.depth))
        for name in ("article", "main", "body"):
            for e in self.elements:
                if e.name == name and e.characters:
                    return e
        return self.root if self.root.characters else None

    def kept(self) -> list[str]:
        self.score()
        top = self.best()
        if not top:
            return []
        limit = max(10.0, 0.2 * (top.points or 0) * (1 - top.density()))
        keep = {id(top)}
        for e in self.elements:
            if e.parent is top.parent and e is not top and not e.out and e.characters:
                if e.points is not None and e.points * (1 - e.density()) >= limit:
                    keep.add(id(e))
                elif e.name == "p" and (e.characters > 80 and e.density() < 0.25 or e.characters and not e.linked and any(b is e and re.search(r"\.(\s|$)", t) for b, t in self.blocks)):
                    keep.add(id(e))
        # The headline may stand before the container: headings beside it or beside what it stands in.
        above, at = set(), top
        while at:
            above.add(id(at))
            at = at.parent
        before = self.elements[: self.elements.index(top)]
        host = lambda e: e.parent.parent if e.parent.name in ("header", "hgroup") and e.parent.parent else e.parent
        keep |= {id(e) for e in before if e.name in HEADINGS and not e.out and e.parent and id(host(e)) in above and (e.name == "h1" or host(e) is top.parent)}
        chosen = []
        for element, text in self.blocks:
            up: Element | None = element
            inside = False
            while up and not inside:
                if up.name in ("ul", "ol", "dl", "table", "div", "section") and up is not top and up.links > 1 and up.density() > 0.8:
                    break  # a list of links
                inside = id(up) in keep
                up = up.parent
            if inside:
                chosen.append(text)
        return chosen


def again(source: str) -> Page:
    """A page read once more where names and forms have left out half of its text or more."""
    plain = Page(source, named=False, forms=None)
    numbered = list(enumerate(plain.elements))
    spared = frozenset(i for i, e in numbered if e.headed and not e.out and 2 * e.characters >= plain.root.characters)
    forms = frozenset(i for i, e in numbered if e.name == "form" and (i in spared or e.characters >= FORM_TEXT * e.fields))
    return Page(source, True, spared, forms)


def main_text(source: str) -> str:
    """The kept blocks in page order, joined by line breaks. If names leave out all there is, they don't count."""
    page = Page(source)
    if page.lost and page.lost >= page.root.characters:
        page = again(source)
    return "\n".join(page.kept() or Page(source, named=False).kept())


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every row of ``pages`` (page_id, url, html)."""

    def run(batches):
        for batch in batches:
            column = batch.column("html")
            for i in range(0, len(column), 256):
                part = batch.slice(i, 256)
                texts = [main_text(x) if x else "" for x in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kinds = dict(pages.dtypes)
    return pages.select("page_id", "url", F.col("html").cast("string")).mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
