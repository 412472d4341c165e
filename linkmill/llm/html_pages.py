"""Labelled pages: a seeded generator of web pages whose text blocks are known to be article text or not."""

from __future__ import annotations

import random

# Names that sites give to their page parts.
PARTS = {
    "menu": ("nav", "navigation", "menu", "navbar", "topnav", "main-menu", "breadcrumb", "breadcrumbs", "toc", "tabs", "pagination", "pager"),
    "header": ("header", "masthead", "site-header", "branding", "logo", "topbar", "banner", "tagline"),
    "footer": ("footer", "site-footer", "copyright", "legal", "colophon", "bottom", "imprint"),
    "sidebar": ("sidebar", "aside", "side", "rail", "widget", "related", "recommended", "popular", "trending", "more-stories"),
    "notice": ("cookie", "cookies", "consent", "notice", "gdpr", "alert", "popup", "modal", "newsletter", "subscribe", "signup", "disclaimer", "paywall"),
    "advert": ("ad", "ads", "advert", "advertisement", "sponsored", "sponsor", "promo", "adsbygoogle", "ad-slot", "promoted"),
    "form": ("form", "search", "login", "contact", "register", "search-box", "feedback"),
    "comments": ("comment", "comments", "discussion", "respond", "reply", "replies", "commentlist", "comment-body", "user-comments"),
    "share": ("share", "social", "sharing", "tags", "meta", "author-box", "follow"),
    "article": ("content", "main", "article", "post", "entry", "body", "story", "text", "article-body", "post-content", "entry-content", "page-content"),
}
TAGS = {"menu": "nav", "header": "header", "footer": "footer", "sidebar": "aside", "form": "form"}
SYLLABLES = "ba re ti on en la mu so che al ver dri que ing ost par le ño ü".split()


class Page:
    """Html, and its text blocks in order as (text, is article)."""

    def __init__(self, rng: random.Random):
        self.rng, self.html, self.blocks = rng, [], []

    def words(self, least: int, most: int, stop: bool) -> str:
        n = self.rng.randint(least, most)
        out = ["".join(self.rng.choices(SYLLABLES, k=self.rng.randint(1, 4))) for _ in range(n)]
        if self.rng.random() < 0.1:
            out = [w + self.rng.choice(("***", "$$$", "!!", "###")) for w in out]
        text = " ".join(out).capitalize()
        return text + "." if stop else text

    def block(self, tag: str, text: str, main: bool, link: bool = False) -> None:
        inner = f'<a href="/{len(self.html)}">{text}</a>' if link else text
        if main and self.rng.random() < 0.2:
            inner = f"<b>{inner}" + "</b>" * (self.rng.random() < 0.6) + "<br>" * (self.rng.random() < 0.5)
        close = f"</{tag}>" if tag != "p" or self.rng.random() < 0.8 else ""
        self.html.append(f"<{tag}>{inner}{close}")
        self.blocks.append((" ".join(text.split()), main))

    def part(self, kind: str, plain: bool) -> tuple[str, str]:
        tag = TAGS.get(kind, "section" if self.rng.random() < 0.3 else "div")
        tag = "div" if plain or (tag != "form" and self.rng.random() < 0.35) else tag
        name = f' {self.rng.choice(("class", "class", "id"))}="{self.rng.choice(PARTS[kind])}"' if tag in ("div", "section") or self.rng.random() < 0.4 else ""
        return f"<{tag}{name}>", f"</{tag}>"

    def boilerplate(self, kind: str, plain: bool) -> None:
        rng = self.rng
        begin, end = self.part(kind, plain)
        self.html.append(begin)
        if kind in ("menu", "share") or (kind in ("sidebar", "footer") and rng.random() < 0.5):
            self.html.append("<ul>")
            for _ in range(rng.randint(2, 8)):
                self.block("li", self.words(1, 4, False), False, link=True)
            self.html.append("</ul>")
        if kind == "form":
            for _ in range(rng.randint(1, 3)):
                self.block(rng.choice(("label", "p", "div", "button", "option")), self.words(1, 5, False), False)
        if kind in ("advert", "notice", "comments", "header", "footer", "sidebar"):
            for _ in range(rng.randint(1, 5) if kind == "comments" else rng.randint(1, 2)):
                if kind == "footer" and rng.random() < 0.7:
                    self.block(rng.choice(("p", "div")), "© " + self.words(1, 12, rng.random() < 0.5), False)
                elif rng.random() < 0.3 and kind != "header":
                    self.html.append(self.words(2, 40, True))  # text right in the part
                    self.blocks.append((" ".join(self.html[-1].split()), False))
                    self.html.append("<hr>")
                else:
                    self.block(rng.choice(("p", "p", "div", "h3")), self.words(2, 40 if kind != "header" else 6, rng.random() < 0.8), False, rng.random() < 0.15)
        self.html.append(end)

    def article(self, plain: bool) -> None:
        rng = self.rng
        tag = "div" if plain else rng.choice(("article", "article", "main", "div", "section"))
        name = f' class="{rng.choice(PARTS["article"])}"' if tag in ("div", "section") or rng.random() < 0.4 else ""
        outer = rng.random() < 0.3
        self.html.append(("<main>" if outer else "") + f"<{tag}{name}>")
        if rng.random() < 0.85:
            self.block(rng.choice(("h1", "h1", "h2")), self.words(2, 12, rng.random() < 0.2), True)
        for _ in range(rng.randint(1, 14)):
            roll = rng.random()
            if roll < 0.06:
                self.boilerplate(rng.choice(("advert", "share", "form", "notice", "sidebar")), plain)
            elif roll < 0.12:
                self.block("h2", self.words(1, 8, False), True)
            elif roll < 0.18:
                self.html.append("<ul>")
                for _ in range(rng.randint(2, 4)):
                    self.block("li", self.words(2, 20, rng.random() < 0.5), True)
                self.html.append("</ul>")
            elif roll < 0.22:
                self.block("blockquote", self.words(5, 40, True), True)
            else:
                self.block("p", self.words(*rng.choice(((1, 4), (5, 30), (20, 120))), rng.random() < 0.9), True)
        if rng.random() < 0.3:
            self.boilerplate("comments", plain)
        self.html.append(f"</{tag}>" + "</main>" * outer)


def labelled_pages(n: int = 500, seed: int = 5) -> list[tuple[str, list[tuple[str, bool]]]]:
    """``n`` pages as (html, [(block text, is article)])."""
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        page, plain = Page(rng), rng.random() < 0.25
        page.html.append("<!DOCTYPE html><html><head><title>x</title><style>p{}</style></head><body>")
        for kind, share in (("header", 0.5), ("menu", 0.8), ("notice", 0.35), ("advert", 0.4), ("form", 0.2)):
            if rng.random() < share:
                page.boilerplate(kind, plain)
        page.article(plain)
        for kind, share in (("share", 0.2), ("comments", 0.3), ("sidebar", 0.4), ("advert", 0.2), ("form", 0.2), ("footer", 0.85), ("notice", 0.15)):
            if rng.random() < share:
                page.boilerplate(kind, plain)
        page.html.append("</body></html>" * (rng.random() < 0.9))
        out.append(("".join(page.html), page.blocks))
    return out
