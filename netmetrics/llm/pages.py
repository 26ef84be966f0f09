"""Small helpers of the page extraction: HTML as a tree of blocks, and labelled pages to learn from.

A tree holds the block elements of a page and, as leaves, the runs of text between their bounds. Inline mark-up joins its
block; scripts, styles and what else is never shown as text is passed over.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

import numpy as np

#: Fixed by the HTML standard: elements whose content is not text of the page, that have no content, that are blocks, and
#: that end an open paragraph or an open element of their own kind.
HIDDEN = "script style noscript template svg math iframe object canvas audio video title textarea select option datalist".split()
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = set(
    "html head body main article section nav header footer aside div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption "
    "form fieldset legend label button blockquote pre figure figcaption address details summary dialog hgroup search center ins menu dir hr".split()
)
ENDS_ITSELF = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
#: Elements that an end tag or a new item does not reach across.
WALLS = set("ul ol dl table article section main body html".split())
#: Deeper elements count as of this depth, so that a page has at most so many levels.
MOST_DEPTH = 512

TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({'|'.join(HIDDEN)})\b[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^<>\"'])*)>|<(/?)([a-zA-Z][^\s/>]*)([^<>]*)>|<[!?][^>]*>",
    re.S | re.I,
)
NAMED = re.compile(r"\b(class|id|role|data-main)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


@dataclass
class Tree:
    """parent, tag, names (words of class, id and role), depth of each node; text of leaves (None for elements), linked letters."""

    parent: list[int] = field(default_factory=list)
    tag: list[str] = field(default_factory=list)
    names: list[tuple] = field(default_factory=list)
    depth: list[int] = field(default_factory=list)
    text: list[str | None] = field(default_factory=list)
    linked: list[int] = field(default_factory=list)
    label: list[int] = field(default_factory=list)  # what an attribute data-main says, of labelled pages; inherited

    def add(self, parent: int, tag: str, names: tuple, text: str | None, linked: int, label: int | None) -> int:
        self.parent.append(parent)
        self.tag.append(tag)
        self.names.append(names)
        self.depth.append(self.depth[parent] + 1 if parent >= 0 else 0)
        self.text.append(text)
        self.linked.append(linked)
        self.label.append(label if label is not None else self.label[parent] if parent >= 0 else 0)
        return len(self.tag) - 1


def parsed(page: str) -> Tree:
    """The tree of a page; leaves in page order, their white space (of any kind) as one space."""
    t = Tree()
    t.add(-1, "#root", (), None, 0, None)
    stack, run, linked, in_link, at = [0], [], 0, 0, 0

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(run).split())
        run.clear()
        if text:
            t.add(stack[-1], "#text", (), text, min(linked, len(text)), None)
        linked = 0

    def closed(tags: set[str], tag: str) -> None:
        """End the nearest open element of these tags, if no wall lies before it."""
        for k in range(len(stack) - 1, 0, -1):
            own = t.tag[stack[k]]
            if own in tags:
                del stack[k:]
                return
            if own in WALLS and tag not in WALLS:
                return

    def words(raw: str) -> None:
        nonlocal linked
        if raw:
            raw = html.unescape(raw) if "&" in raw else raw
            run.append(raw)
            if in_link:
                linked += len(raw.strip())

    for m in TOKEN.finditer(page):
        words(page[at : m.start()])
        at = m.end()
        tag, end, attributes = (m[3], m[2], m[4]) if m[3] else (m[6], m[5], m[7])
        if not tag:
            continue
        tag = tag.lower()
        if tag == "a":
            in_link = 0 if end else 1
        elif tag == "br":
            run.append(" ")
        elif tag in BLOCKS:
            flush()
            if end:
                closed({tag}, tag)
            else:
                if t.tag[stack[-1]] == "p":
                    stack.pop()
                if tag in ENDS_ITSELF:
                    closed(ENDS_ITSELF[tag], tag)
                if tag in VOID:
                    continue
                names, label = (), None
                if "=" in attributes:
                    for key, *value in NAMED.findall(attributes):
                        value = "".join(value)
                        if key.lower() == "data-main":
                            label = int(value)
                        else:
                            names += tuple(x.lower() for x in NAME.findall(value))
                node = t.add(stack[-1], tag, names, None, 0, label)
                if t.depth[node] < MOST_DEPTH:
                    stack.append(node)
    words(page[at:])
    flush()
    return t


#: What landmarks of pages are commonly called.
CONTENT_NAMES = "content main article post entry story body text page-content main-content post-content entry-content article-body story-body".split()
KINDS = {
    "menu": (("nav", "ul", "div"), "nav menu navbar navigation main-menu breadcrumb breadcrumbs toc topnav pagination tabs skip".split()),
    "header": (("header", "div"), "header masthead top site-header page-header logo branding topbar".split()),
    "footer": (("footer", "div"), "footer bottom site-footer page-footer copyright legal colophon".split()),
    "sidebar": (("aside", "div", "section"), "sidebar side widget related related-posts recommended trending popular rail more-stories".split()),
    "notice": (("div", "section", "dialog", "aside"), "notice cookie cookies consent banner cookie-banner alert popup modal gdpr newsletter subscribe paywall overlay message".split()),
    "advert": (("div", "aside", "ins", "section"), "ad ads advert advertisement sponsored promo promotion ad-slot adsbygoogle sponsor".split()),
    "form": (("form", "div"), "search login signup subscribe contact form search-form".split()),
    "comments": (("section", "div", "ol"), "comments comment comment-list reader-comments disqus replies discussion respond responses".split()),
    "share": (("div", "ul"), "share social sharing social-links tags share-buttons follow".split()),
}
BOILERPLATE_NAMES = {x for _, names in KINDS.values() for n in names for x in n.split("-")} - {"main", "top", "side", "page", "post", "message", "text", "bottom", "list", "more", "stories", "site", "form", "tabs", "slot", "reader", "links", "buttons", "posts", "follow", "tags"}


def declared(t: Tree) -> bool:
    """Label the tree of a page that has article or main by its landmarks; False, and no labels, if it has none."""
    if not {"article", "main"} & set(t.tag):
        return False
    for k in range(1, len(t.tag)):
        inside = t.label[t.parent[k]]
        if t.tag[k] in ("article", "main"):
            t.label[k] = 1
        elif t.tag[k] in ("nav", "aside", "footer", "form", "button") or (t.tag[k] == "header" and not inside) or BOILERPLATE_NAMES & set(t.names[k]):
            t.label[k] = 0
        else:
            t.label[k] = inside
    return True


def blocks_of(t: Tree) -> list[tuple[str, str]]:
    """(tag, text) of the leaves labelled as content."""
    return [(t.tag[t.parent[k]], t.text[k]) for k in range(len(t.tag)) if t.text[k] is not None and t.label[k]]


def restyled(rng: np.random.Generator, content: list[tuple[str, str]], pool: list[str]) -> str:
    """A labelled page (attribute data-main) with this content, other landmarks around and in it, in a layout drawn by rng.

    pool: sentences of other pages for comments, adverts and notices, so that words alone tell nothing.
    """
    pick = lambda x: x[int(rng.integers(len(x)))]
    esc = lambda x: html.escape(x, quote=False)
    short = lambda: " ".join(pick(pool).split()[: int(rng.integers(1, 5))])

    def attribute(names: list[str]) -> str:
        return f' {pick(["class", "class", "id"])}="{pick(names)}{pick(["", "", " clearfix", " box-2"])}"'

    def heading() -> str:
        return "<{0}>{1}</{0}>".format(pick(["h2", "h3", "h4"]), esc(short()))

    def unit(kind: str) -> str:
        tags, names = KINDS[kind]
        tag = pick(tags)
        style = attribute(names) if tag not in ("nav", "header", "footer", "aside", "form") or rng.random() < 0.5 else ""
        links = "".join(f'<li><a href="/{k}">{esc(short())}</a></li>' for k in range(int(rng.integers(2, 9))))
        para = lambda: f"<p>{esc(pick(pool))}</p>"
        if kind == "menu" or kind == "share":
            inner = links if tag == "ul" else f"<ul>{links}</ul>" if rng.random() < 0.6 else " | ".join(f'<a href="#">{esc(short())}</a>' for _ in range(4))
        elif kind == "header":
            title = pick(["h1", "div", "p"])
            inner = f'<{title}><a href="/">{esc(short())}</a></{title}>' + pick(["", f"<p>{esc(short())}</p>", f"<ul>{links}</ul>"])
        elif kind == "footer":
            inner = pick([f"&copy; {esc(short())}. {esc(pick(pool))}", para() + f"<ul>{links}</ul>", f"<p>&copy; 2024 {esc(short())}</p>"])
        elif kind == "sidebar":
            inner = heading() + pick([f"<ul>{links}</ul>", para(), para() + para()])
        elif kind == "form":
            inner = f'<label>{esc(short())}</label><input name="q"><p>{esc(short())}</p><button>{esc(short())}</button>'
        elif kind == "comments":
            item = pick(["div", "li", "p"])
            inner = heading() + "".join(f"<{item}>{pick(['', f'<b>{esc(short())}</b> '])}{esc(pick(pool))}</{item}>" for _ in range(int(rng.integers(1, 6))))
        else:
            inner = pick([esc(pick(pool)), para(), para() + f'<a href="/x">{esc(short())}</a>'])
        return f'<{tag}{style} data-main="0">{inner}</{tag}>'

    tag, named = pick([("article", 0), ("article", 0), ("main", 0), ("div", 1), ("div", 1), ("section", 1), ("div", 0), ("", 0)])
    mixed = rng.random() < 0.5

    def block(kind: str, text: str) -> str:
        """A block of the content: a heading as it is, a paragraph as one or, on mixed pages, as another element."""
        t, words = esc(text), text.split()
        if len(words) > 6 and rng.random() < 0.15:
            k = int(rng.integers(1, len(words) - 3))
            t = f'{esc(" ".join(words[:k]))} <a href="/x">{esc(" ".join(words[k : k + 2]))}</a> {esc(" ".join(words[k + 2 :]))}'
        if kind not in ("p", "article", "main", "body", "html"):
            return f"<{kind}>{t}</{kind}>"
        style = rng.random() if mixed else 0.0
        if style < 0.55:
            return f"<p>{t}" + pick(["</p>", "", "<br>"])
        if style < 0.65:
            return f"<div>{t}</div>"
        if style < 0.8:
            items = [*(x for x in text.split(". ") if x), *([short()] if rng.random() < 0.3 else [])]
            return "<{0}>{1}</{0}>".format(pick(["ul", "ol"]), "".join(f"<li>{esc(x)}</li>" for x in items))
        if style < 0.88:
            return f"<blockquote>{t}</blockquote>"
        if style < 0.93:
            return "<table>" + "".join(f"<tr><td>{esc(short())}</td><td>{esc(pick(pool)) if k else t}</td></tr>" for k in range(int(rng.integers(1, 3)))) + "</table>"
        if style < 0.97:
            return f"<{pick(['h2', 'h3'])}>{esc(short())}"
        return pick([f"<pre>{t}</pre>", f"<figure><figcaption>{t}</figcaption></figure>"])

    paragraphs = [block(*x) for x in content]
    paragraphs = [x + f"</{x[1:3]}>" if x.startswith(("<h2>", "<h3>")) and not x.endswith(">") else x for x in paragraphs]
    if paragraphs and paragraphs[0].startswith("<h") and rng.random() < 0.3:
        paragraphs[0] = f"<header>{paragraphs[0]}</header>"
    if not tag:  # straight in the page: each block says of itself that it is content
        paragraphs = [re.sub(r"^<(\w+)", r'<\1 data-main="1"', x) for x in paragraphs]
    inside = [unit(k) for k in ("advert", "share", "form", "notice", "comments", "sidebar", "menu") if rng.random() < 0.12]
    for x in inside:
        paragraphs.insert(int(rng.integers(0, len(paragraphs) + 1)), x)
    body = "".join(paragraphs) if not tag else f'<{tag}{attribute(CONTENT_NAMES) if named or rng.random() < 0.3 else ""} data-main="1">{"".join(paragraphs)}</{tag}>'
    if tag not in ("main", "") and rng.random() < 0.3:
        body = f'<main data-main="1">{body}</main>'
    before = [unit(k) for k in ("header", "menu", "notice", "advert", "form", "sidebar") if rng.random() < 0.45]
    after = [unit(k) for k in ("sidebar", "comments", "share", "advert", "footer", "notice", "menu") if rng.random() < 0.45]
    rng.shuffle(before)
    whole = "".join(before) + body + "".join(after)
    for _ in range(int(rng.integers(0, 3))):
        whole = f'<div{pick(["", attribute(["wrapper", "container", "row", "site", "layout", "outer", "col"])])}>{whole}</div>'
    return f"<html><head><title>{esc(short())}</title></head><body>{whole}</body></html>"
