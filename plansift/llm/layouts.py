"""Labelled pages for training: common page layouts with ``data-label`` marks.

A layout is drawn from the parts that pages are built of, in the markup styles
that are common: landmarks, named boxes, or plain boxes without any name. Parts
marked ``content`` are the article; all else is not. Words are random, because
the model must not learn a language.
"""

from __future__ import annotations

import random

LETTERS = "etaoinshrdlucmfwygpbvk"


class Layout:
    def __init__(self, seed: int) -> None:
        self.draw = random.Random(seed)
        self.style = self.draw.choice(("landmarks", "landmarks", "named", "named", "plain", "mixed"))

    def word(self) -> str:
        return "".join(self.draw.choice(LETTERS) for _ in range(self.draw.randint(2, 9)))

    def sentence(self, low: int = 3, high: int = 18, stop: str = ".") -> str:
        words = [self.word() for _ in range(self.draw.randint(low, high))]
        if len(words) > 6 and self.draw.random() < 0.5:
            words[len(words) // 2] += ","
        return " ".join(words).capitalize() + stop

    def text(self) -> str:
        """A paragraph: mostly several sentences, sometimes a word or two."""
        kind = self.draw.random()
        if kind < 0.12:
            return self.sentence(1, 2)
        return " ".join(self.sentence() for _ in range(self.draw.randint(1, 2) if kind < 0.3 else self.draw.randint(2, 9)))

    def title(self) -> str:
        return self.sentence(1, 9, self.draw.choice(("", "", ".")))

    def link(self, low: int = 1, high: int = 3) -> str:
        return f'<a href="/{self.word()}">{self.sentence(low, high, "")}</a>'

    def box(self, landmark: str, names: tuple[str, ...], inner: str, mark: str = "other") -> str:
        """``inner`` in an element of the page's style."""
        style = self.draw.choice(("landmarks", "named", "plain")) if self.style == "mixed" else self.style
        label = f'data-label="{mark}"'
        if style == "landmarks":
            named = f' class="{self.draw.choice(names)}"' if names and self.draw.random() < 0.3 else ""
            return f"<{landmark}{named} {label}>{inner}</{landmark}>"
        if style == "named" and names:
            return f'<div {self.draw.choice(("class", "id"))}="{self.draw.choice(names)}" {label}>{inner}</div>'
        shell = self.draw.choice(("", "", f' class="{self.draw.choice("xqzj")}{self.draw.randint(1, 99)}"'))
        return f"<div{shell} {label}>{inner}</div>"

    def links(self, low: int, high: int) -> str:
        rows = [self.link() for _ in range(self.draw.randint(low, high))]
        form = self.draw.choice(("list", "list", "row", "paragraphs"))
        if form == "list":
            return "<ul>" + "".join(f"<li>{x}</li>" for x in rows) + "</ul>"
        return " | ".join(rows) if form == "row" else "".join(f"<p>{x}</p>" for x in rows)

    def top(self) -> str:
        inner = self.draw.choice((f"<div>{self.link()}</div>", f"<h1>{self.link()}</h1>", f"<p>{self.sentence(2, 6, '')}</p>", f"<h2>{self.title()}</h2>"))
        return self.box("header", ("header", "site-header", "masthead", "topbar", "page-head"), inner + (self.menu() if self.draw.random() < 0.5 else ""))

    def menu(self) -> str:
        return self.box("nav", ("nav", "menu", "main-menu", "navbar", "navigation", "breadcrumbs"), self.links(2, 9))

    def notice(self) -> str:
        inner = self.draw.choice((f"<p>{self.sentence(6, 20)} {self.link()}</p>", f"{self.sentence(6, 20)} <button>{self.word()}</button>", f"<p>{self.text()}</p>"))
        return f'<div {self.draw.choice(("class", "id"))}="{self.draw.choice(("cookie-banner", "cookie-notice", "consent", "notice", "alert", "gdpr-popup", "modal"))}" data-label="other">{inner}</div>'

    def advert(self) -> str:
        inner = self.draw.choice((self.sentence(), self.text(), f"<p>{self.sentence()}</p>", f"<a href='/x'>{self.sentence()}</a>", f"<h3>{self.title()}</h3><p>{self.text()}</p>"))
        return f'<{(t := self.draw.choice(("div", "div", "aside", "section")))} class="{self.draw.choice(("ad", "ads", "advert", "advertisement", "ad-slot", "sponsored", "promo", "banner"))}" data-label="other">{inner}</{t}>'

    def side(self) -> str:
        inner = f"<h3>{self.title()}</h3>{self.links(2, 8)}"
        if self.draw.random() < 0.6:
            inner += f"<h3>{self.title()}</h3><p>{self.text()}</p>"
        return self.box("aside", ("sidebar", "side", "widget", "related", "rail", "recommended", "aside"), inner)

    def sign_up(self) -> str:
        inner = f"<p>{self.sentence(5, 20)}</p><label>{self.word()}</label><input name='q'><button>{self.word()}</button>"
        return f'<form action="/x" data-label="other">{inner}</form>' if self.draw.random() < 0.7 else self.box("form", ("newsletter", "subscribe", "signup"), inner)

    def comments(self) -> str:
        one = lambda: self.draw.choice((
            f'<div class="comment"><p>{self.word()}</p><p>{self.text()}</p></div>', f"<li><b>{self.word()}</b> {self.text()}</li>",
            f'<article class="comment"><header>{self.word()}</header><p>{self.text()}</p></article>', f"<div><p>{self.text()}</p></div>"))
        inner = f"<h3>{self.title()}</h3>" + "".join(one() for _ in range(self.draw.randint(1, 8)))
        name = self.draw.choice(("comments", "comment-list", "discussion", "replies", "reader-comments", "respond"))
        return f'<{(t := self.draw.choice(("section", "div", "div", "ol")))} {self.draw.choice(("class", "id"))}="{name}" data-label="other">{inner}</{t}>'

    def foot(self) -> str:
        inner = self.draw.choice(("", self.links(2, 6))) + self.draw.choice((f"&copy; {self.sentence(2, 12)}", f"<p>&copy; {self.sentence(2, 8, '')} &middot; {self.sentence()}</p>", f"<p>{self.text()}</p>"))
        return self.box("footer", ("footer", "site-footer", "foot", "page-bottom", "copyright"), inner)

    def part_of_article(self) -> str:
        kind = self.draw.random()
        if kind < 0.72:
            inner = self.text()
            if self.draw.random() < 0.25:
                inner = f"{self.link(1, 4)} {inner}"
            return self.draw.choice((f"<p>{inner}</p>", f"<p>{inner}</p>", f"<p>{inner}</p>", f"<p><b>{self.title()}</b><br><p>{inner}", f"<div>{inner}</div>", f"{inner}<br><br>"))
        if kind < 0.82:
            return f"<h{(k := self.draw.randint(2, 4))}>{self.title()}</h{k}>"
        if kind < 0.9:
            return "<ul>" + "".join(f"<li>{self.sentence(1, 14)}</li>" for _ in range(self.draw.randint(2, 6))) + "</ul>"
        if kind < 0.94:
            return f"<blockquote><p>{self.text()}</p></blockquote>"
        if kind < 0.97:
            return "<table>" + "".join(f"<tr><td>{self.word()}</td><td>{self.sentence(1, 5, '')}</td></tr>" for _ in range(self.draw.randint(2, 5))) + "</table>"
        return f"<figure><img src='x'><figcaption>{self.sentence(3, 12)}</figcaption></figure>"

    def article(self) -> str:
        length = self.draw.choice((1, 2, 3, 5, 8, 12, 20))
        parts = [self.part_of_article() for _ in range(length)]
        if self.draw.random() < 0.85:
            parts.insert(0, self.draw.choice((f"<h1>{self.title()}</h1>", f"<h1>{self.title()}</h1>", f"<h2>{self.title()}</h2>", f"<header><h1>{self.title()}</h1></header>")))
        for extra, chance in ((self.advert, 0.2), (self.side, 0.1), (self.sign_up, 0.1), (self.notice, 0.05)):
            if self.draw.random() < chance:
                parts.insert(self.draw.randint(1, len(parts)), extra())
        if self.draw.random() < 0.15:
            parts.append(self.box("nav", ("share", "social", "tags", "post-tags", "share-buttons"), self.links(2, 5)))
        if self.draw.random() < 0.2:
            parts.append(self.comments())
        inner = "".join(parts)
        if self.draw.random() < 0.2:
            inner = f"<div>{inner}</div>"
        return self.box(self.draw.choice(("article", "article", "main")), ("article", "content", "post", "entry-content", "article-body", "main-content", "story", "text"), inner, "content")

    def page(self) -> str:
        before = [part() for part, chance in ((self.top, 0.6), (self.menu, 0.7), (self.notice, 0.35), (self.advert, 0.4), (self.side, 0.2), (self.sign_up, 0.1)) if self.draw.random() < chance]
        after = [part() for part, chance in ((self.side, 0.4), (self.advert, 0.25), (self.comments, 0.4), (self.sign_up, 0.25), (self.foot, 0.85), (self.notice, 0.1)) if self.draw.random() < chance]
        inner = "".join(before) + self.article() + "".join(after)
        if self.draw.random() < 0.35:
            inner = f'<div class="{self.draw.choice(("wrapper", "container", "page", "site", "layout", "row"))}">{inner}</div>'
        return f"<!DOCTYPE html><html><head><title>{self.title()}</title></head><body data-label=\"other\">{inner}</body></html>"


def labelled_pages(n: int, seed: int = 11) -> list[str]:
    """``n`` layouts; the same for the same seed."""
    return [Layout(seed * 1_000_003 + k).page() for k in range(n)]
