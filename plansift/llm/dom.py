"""Pages as trees: a tolerant reader for HTML, and what each node looks like to the content model.

A page becomes a list of nodes in page order: block elements and text runs. A
run is the inline content of a block element between its child blocks; it is
what the contract calls a block of text. The reader takes one pass, keeps an
explicit stack (nesting may be of any depth), and closes what the page leaves
open: unclosed paragraphs and list items, stray end tags, pages that break off
inside a tag or a script.
"""

from __future__ import annotations

import html as references
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np

# Names of HTML elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript template iframe noframes noembed xmp svg math select object canvas video audio".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong "
    "sub sup time tt u var button picture map output progress meter".split())
TAGS = ("html", "body", "div", "section", "article", "main", "p", "h1", "h2", "h3", "ul", "ol", "li", "dl", "dt", "dd", "table", "tr", "td", "th",
        "nav", "aside", "footer", "header", "form", "fieldset", "blockquote", "pre", "figure", "figcaption", "address", "dialog", "details")
OTHER_TAG = len(TAGS)
TAG_CODE = {name: i for i, name in enumerate(TAGS)} | dict.fromkeys(("h4", "h5", "h6"), TAGS.index("h3"))
#: An opening tag ends open elements of these names, up to the nearest boundary.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "body": ({"head"}, set()),
}
ZONES = {"article": 1, "main": 1, "nav": 2, "aside": 3, "footer": 4, "header": 5, "form": 6, "dialog": 6}

# Words in class, id and role that tell the purpose of an element.
NAVIGATION = frozenset(
    "nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager paging toc toolbar skip tabs sitemap footer foot bottom colophon copyright "
    "legal imprint masthead topbar header head top branding logo search login signin register account lang language languages".split())
EXTRA = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adslot banner sponsor sponsored promo promotion promoted teaser sidebar side rail "
    "complementary widget widgets related recommended recommendations popular trending latest more readmore share sharing social follow newsletter "
    "subscribe subscription signup form cookie cookies consent gdpr privacy notice notices notification alert popup modal overlay dialog toast paywall "
    "poll survey tags taglist rating print hidden outbrain taboola".split())
COMMENT = frozenset("comment comments commentlist reply replies respond discussion discussions disqus feedback reviews reader readers thread guestbook".split())
CONTENT = frozenset(
    "article content main post entry story body text prose articlebody maincontent hentry copy document page blog news paragraph chapter rich".split())
HINTS = 6

TOKEN = re.compile(
    r"<!--(?:.*?-->|.*)|<[!?][^>]*+>?|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s\"'=<>/]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
NAME_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
LABEL = "data-label"
SENTENCE_END = re.compile(r"[.!?…。！？][\"'”’»)\]]*$")


@dataclass
class Page:
    """Nodes in page order; a text run has a text, an element has none."""

    parent: list[int] = field(default_factory=list)
    end: list[int] = field(default_factory=list)
    tag: list[int] = field(default_factory=list)
    hint: list[int] = field(default_factory=list)
    near: list[int] = field(default_factory=list)
    zone: list[int] = field(default_factory=list)
    text: list[str | None] = field(default_factory=list)
    linked: list[int] = field(default_factory=list)
    label: list[int] = field(default_factory=list)


def hint_of(attributes: str) -> tuple[int, int | None, bool]:
    """What class, id and role say (0 nothing, 1 navigation, 2 extra, 3 comment, 4 content, 5 content and another), the label, and whether it is hidden."""
    names, label, hidden = [], None, False
    for key, *values in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), "".join(values)
        if key in ("class", "id", "role", "itemprop"):
            names.append(value)
        elif key == LABEL:
            label = int(value == "content")
        elif key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I) or key == "aria-hidden" and value.lower() == "true":
            hidden = True
    words = {w.lower() for w in NAME_WORD.findall(" ".join(names))}
    words |= {"".join(NAME_WORD.findall(n)).lower() for name in names for n in name.split()}
    kinds = [bool(words & group) for group in (NAVIGATION, EXTRA, COMMENT)]
    other = next((k for k in (3, 2, 1) if kinds[k - 1]), 0)
    if words & CONTENT:
        return (other if other == 3 else 5 if other else 4), label, hidden
    return other, label, hidden or bool(re.search(r"(?:^|\s)hidden(?:\s|=|$)", attributes))


def read(source: str | None) -> Page:
    """The nodes of a page; scripts, styles, heads, comments and hidden elements leave nothing."""
    page = Page()
    #: Open elements: name, node (or the node it stands in, for inline ones), and whether it is a block.
    stack: list[tuple[str, int, bool]] = []
    #: Nodes of the open blocks alone, and how often each name is open, so that no step walks a deep stack in vain.
    blocks: list[int] = []
    open_names: Counter[str] = Counter()
    run: list[str] = []
    links = linked = 0

    def node(tag: int, hint: int, near: int, zone: int, text: str | None, label: int) -> int:
        page.parent.append(blocks[-1] if blocks else -1)
        for column, value in ((page.end, 0), (page.tag, tag), (page.hint, hint), (page.near, near), (page.zone, zone), (page.text, text), (page.linked, 0), (page.label, label)):
            column.append(value)
        return len(page.parent) - 1

    def flush() -> None:
        nonlocal linked
        if run:
            text = " ".join(references.unescape("".join(run)).split())
            run.clear()
            if text:
                top = blocks[-1]
                i = node(page.tag[top], 0, page.near[top], page.zone[top], text, page.label[top])
                page.linked[i], page.end[i] = min(linked, len(text)), i + 1
            linked = 0

    def push(name: str, n: int, block: bool) -> None:
        stack.append((name, n, block))
        open_names[name] += 1
        if block:
            blocks.append(n)

    def pop_to(depth: int) -> None:
        nonlocal links
        if any(block for _, _, block in stack[depth:]):
            flush()
        for name, n, block in reversed(stack[depth:]):
            open_names[name] -= 1
            if block:
                page.end[n] = len(page.parent)
                blocks.pop()
            elif name == "a":
                links -= 1
        del stack[depth:]

    def add(text: str) -> None:
        nonlocal linked
        run.append(text)
        if links:
            linked += len(text.strip())

    root = node(TAG_CODE["html"], 0, 0, 0, None, 0)
    push("html", root, True)
    source, at = source or "", 0
    skipped: re.Pattern | None = None
    while at < len(source):
        if skipped is not None:
            found = skipped.search(source, at)
            skipped = None
            if found is None:
                break
            at = found.end()
            continue
        found = TOKEN.search(source, at)
        if found is None:
            add(source[at:])
            break
        if found.start() > at:
            add(source[at : found.start()])
        at = found.end()
        closing, name, attributes = (found[1], found[2], found[3]) if found[2] else (found[4], found[5], found[6])
        if not name:
            continue
        name = name.lower()
        if closing:
            inline = name in INLINE
            for depth in range(len(stack) - 1, 0, -1) if open_names[name] else ():
                if stack[depth][0] == name:
                    pop_to(depth)
                    break
                if inline and stack[depth][2]:
                    break
            continue
        if name in VOID:
            # a line break is white space of its block; a rule ends the run
            flush() if name == "hr" else run.append(" ")
            continue
        hint, label, hidden = hint_of(attributes) if "=" in attributes or "hidden" in attributes else (0, None, False)
        if attributes.endswith("/") and name in ("svg", "path", "script"):
            continue
        if name in RAW or name == "head" or name == "button":
            skipped = re.compile(rf"</{re.escape(name)}(?:\s[^>]*)?>" + (r"|(?=<body[\s>])" if name == "head" else ""), re.I)
            run.append(" ")
            continue
        if name in INLINE:
            if name == "a":
                links += 1
            push(name, blocks[-1], False)
            continue
        if name in ("html", "body") and open_names[name]:
            continue
        closes, bounds = ENDS.get(name, (set(), set()))
        for depth in range(len(stack) - 1, 0, -1) if any(open_names[c] for c in closes) else ():
            if stack[depth][0] in bounds:
                break
            if stack[depth][0] in closes:
                last = depth
                while name == "tr" and last > 1 and stack[last - 1][0] in closes:
                    last -= 1
                pop_to(last)
                break
        # a paragraph holds no blocks
        for depth in range(len(stack) - 1, 0, -1) if open_names["p"] else ():
            if stack[depth][0] == "p":
                pop_to(depth)
                break
            if stack[depth][2]:
                break
        flush()
        top = blocks[-1]
        if name in ("html", "body"):
            hint = 0
        near = hint or page.near[top]
        zone = ZONES.get(name) or page.zone[top]
        n = node(TAG_CODE.get(name, OTHER_TAG), hint, near, zone, None, page.label[top] if label is None else label)
        push(name, n, True)
        if hidden:
            # its text is none of the page's
            at = _after(source, at, name)
            pop_to(len(stack) - 1)
    pop_to(0)
    return page


def _after(source: str, at: int, name: str) -> int:
    """Where the element opened just before ``at`` ends."""
    depth = 1
    for found in re.compile(rf"<(/?){re.escape(name)}(?=[\s>/])", re.I).finditer(source, at):
        depth += -1 if found[1] else 1
        if not depth:
            return found.start()
    return len(source)


# What the model sees of a node: one value of each of these groups.
GROUPS = {
    "kind": 2, "tag": 2 * (OTHER_TAG + 1), "hint": 2 * HINTS, "near": 2 * HINTS, "zone": 2 * 7, "zone_near": 7 * HINTS, "words": 2 * 8, "links": 2 * 5,
    "sentence": 2 * 4, "place": 2 * 4, "share": 2 * 5, "neighbours": 4,
    "around": 6 * 5,
}
OFFSETS = dict(zip(GROUPS, np.concatenate([[0], np.cumsum(list(GROUPS.values()))[:-1]]), strict=True))
N_FEATURES = sum(GROUPS.values())
#: Kinds of edges by what the child is: a run, a paragraph or heading, a list or table part, a landmark, another element.
EDGE_KINDS = 5
_EDGE_OF_TAG = np.full(OTHER_TAG + 1, 4)
for _name in ("p", "h1", "h2", "h3", "blockquote", "pre", "figure", "figcaption"):
    _EDGE_OF_TAG[TAG_CODE[_name]] = 1
for _name in ("ul", "ol", "li", "dl", "dt", "dd", "table", "tr", "td", "th"):
    _EDGE_OF_TAG[TAG_CODE[_name]] = 2
for _name in ("nav", "aside", "footer", "header", "form", "fieldset", "dialog", "address"):
    _EDGE_OF_TAG[TAG_CODE[_name]] = 3


@dataclass
class Forest:
    """Trees of several pages one after the other; parents are -1 at roots."""

    parent: np.ndarray
    depth: np.ndarray
    codes: np.ndarray
    edge: np.ndarray
    is_run: np.ndarray
    label: np.ndarray


def forest(pages: list[Page]) -> Forest:
    """Trees and features of pages, for all nodes at once."""
    sizes = np.array([len(p.parent) for p in pages])
    base = np.repeat(np.cumsum(sizes) - sizes, sizes)
    joined = lambda name: np.fromiter((v for p in pages for v in getattr(p, name)), np.int64, int(sizes.sum()))
    parent, end = joined("parent"), joined("end") + base
    parent = np.where(parent < 0, -1, parent + base)
    texts = [t for p in pages for t in p.text]
    is_run = np.fromiter((t is not None for t in texts), bool, len(texts))
    words = np.fromiter((t.count(" ") + 1 if t else 0 for t in texts), np.int64, len(texts))
    chars = np.fromiter((len(t) if t else 0 for t in texts), np.int64, len(texts))
    ended = np.fromiter((bool(t and SENTENCE_END.search(t[-8:])) for t in texts), np.int64, len(texts))
    commas = np.fromiter((bool(t and ("," in t or ". " in t)) for t in texts), np.int64, len(texts))
    tag, hint, near, zone, linked = (joined(c) for c in ("tag", "hint", "near", "zone", "linked"))

    start = np.arange(len(parent))
    below = lambda x: (s := np.concatenate([[0], np.cumsum(x)]))[end] - s[start]
    all_words, all_chars, all_linked, all_ended, all_runs = (below(x) for x in (words, chars, linked, ended, is_run))
    page_words = np.repeat(np.add.reduceat(words, np.cumsum(sizes) - sizes), sizes)
    before = np.concatenate([[0], np.cumsum(words)])[:-1]
    before = before - np.repeat(before[np.cumsum(sizes) - sizes], sizes)

    depth = np.zeros(len(parent), np.int64)
    for i in np.flatnonzero(parent >= 0).tolist():
        depth[i] = depth[parent[i]] + 1
    kind = is_run.astype(np.int64)
    density = all_linked / np.maximum(all_chars, 1)
    share = all_words / np.maximum(page_words, 1)
    size = np.where(is_run, np.digitize(words, [1, 2, 4, 8, 14, 25, 50]), np.digitize(all_words, [1, 4, 12, 30, 80, 200, 600]))
    sentence = np.where(is_run, 2 * ended + commas, np.digitize(all_ended / np.maximum(all_runs, 1), [0.01, 0.4, 0.8]))
    place = np.digitize((before + all_words / 2) / np.maximum(page_words, 1), [0.05, 0.5, 0.92])
    # a long run beside it speaks for a short one: headings, bylines, single words between paragraphs
    run_words = words[is_run]
    page_of = np.repeat(np.arange(len(sizes)), sizes)[is_run]
    long = np.concatenate([[False], run_words >= 14, [False]])
    same = np.concatenate([[False], page_of[1:] == page_of[:-1], [False]])
    beside = np.zeros(len(parent), np.int64)
    beside[is_run] = (long[:-2] & same[:-1]) * 1 + (long[2:] & same[1:]) * 2
    # the element around a run's own: how much of the page it holds, and how much of that are sentences
    over = np.maximum(parent, 0)
    over = np.maximum(parent[over], 0)
    sentences_over = np.digitize(all_ended[over] / np.maximum(all_runs[over], 1), [0.2, 0.5, 0.7, 0.9])
    around = np.where(is_run, 5 * (1 + np.digitize(share[over], [0.05, 0.2, 0.5, 0.8])) + sentences_over, 0)
    values = {
        "kind": kind, "tag": 2 * tag + kind, "hint": 2 * hint + kind, "near": 2 * near + kind, "zone": 2 * zone + kind, "zone_near": zone * HINTS + near,
        "words": 2 * size + kind, "links": 2 * np.digitize(density, [0.01, 0.3, 0.6, 0.95]) + kind, "sentence": 2 * sentence + kind, "place": 2 * place + kind,
        "share": 2 * np.digitize(share, [0.02, 0.1, 0.3, 0.7]) + kind, "neighbours": beside, "around": around,
    }
    codes = np.stack([values[name] + OFFSETS[name] for name in GROUPS], axis=1)
    return Forest(parent, depth, codes, np.where(is_run, 0, _EDGE_OF_TAG[tag]), is_run, joined("label"))
