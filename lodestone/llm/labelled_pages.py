"""Labelled pages to train the extractor on: generated from templates that cover common page layouts.

A page is a list of (html, [labels of the leaf blocks in it]) parts; labels are 1 for main text and 0 for all else."""

from __future__ import annotations

import random

_SYLLABLES = "ba co de fi gu ha in ka lo mer na or pre qui ra sta tion un ver wes yo ze".split()
_BODY = ("content", "post-body", "entry-content", "article-body", "story", "main-text", "")


class PageMaker:
    def __init__(self, seed: int) -> None:
        self.r = random.Random(seed)

    def word(self) -> str:
        return "".join(self.r.choice(_SYLLABLES) for _ in range(self.r.randint(1, 4)))

    def phrase(self, low: int, high: int) -> str:
        return " ".join(self.word() for _ in range(self.r.randint(low, high)))

    def sentence(self) -> str:
        s = self.phrase(1, 18)
        return s[0].upper() + s[1:] + self.r.choice("....!?")

    def prose(self, low: int = 1, high: int = 9) -> str:
        parts = [self.sentence() for _ in range(self.r.randint(low, high))]
        if self.r.random() < 0.2:
            k = self.r.randrange(len(parts))
            parts[k] = f'<a href="/{self.word()}">{parts[k]}</a>'
        if self.r.random() < 0.2:
            k = self.r.randrange(len(parts))
            parts[k] = f"<b>{parts[k]}</b>"
        return " ".join(parts)

    def shout(self) -> str:
        return " ".join(self.word().upper() + "!!" for _ in range(self.r.randint(2, 40)))

    def links(self, n: int, wrap: str = "li") -> str:
        return "".join(f'<{wrap}><a href="/{self.word()}">{self.phrase(1, 2)}</a></{wrap}>' for _ in range(n))

    def menu(self) -> tuple[str, list[int]]:
        n = self.r.randint(2, 8)
        shape = self.r.randrange(4)
        if shape == 0:
            return f"<nav><ul>{self.links(n)}</ul></nav>", [0] * n
        if shape == 1:
            return f'<div class="{self.r.choice(("menu", "navbar", "nav-main", "breadcrumbs"))}"><ul>{self.links(n)}</ul></div>', [0] * n
        if shape == 2:
            return f"<nav>{self.links(n, 'div')}</nav>", [0] * n
        return f'<ul id="{self.r.choice(("menu", "navigation", "topnav"))}">{self.links(n)}</ul>', [0] * n

    def top(self) -> tuple[str, list[int]]:
        if self.r.random() < 0.5:
            return f"<header><h1>{self.phrase(1, 3)}</h1><p>{self.phrase(2, 8)}</p></header>", [0, 0]
        return f'<div class="{self.r.choice(("header", "site-header", "masthead", "banner"))}">{self.phrase(1, 6)}</div>', [0]

    def bottom(self) -> tuple[str, list[int]]:
        text = f"&copy; {self.r.choice(('2020', '2024', self.word() + '.example.com'))} &middot; {self.prose(1, 3)}"
        if self.r.random() < 0.7:
            return f"<footer>{text}</footer>", [0]
        return f'<div class="{self.r.choice(("footer", "site-footer", "copyright"))}"><p>{text}</p></div>', [0]

    def advert(self) -> tuple[str, list[int]]:
        return f'<div class="{self.r.choice(("ad", "ads", "advert", "ad-slot", "sponsored", "promo"))}">{self.prose(1, 4)}</div>', [0]

    def notice(self) -> tuple[str, list[int]]:
        body = f"{self.prose(1, 3)}"
        kind = self.r.choice(("cookie-notice", "consent", "notice", "alert", "newsletter", "popup", "subscribe"))
        if self.r.random() < 0.5:
            return f'<div class="{kind}"><p>{body}</p><button>{self.phrase(1, 2)}</button></div>', [0, 0]
        return f'<div id="{kind}">{body}</div>', [0]

    def side(self) -> tuple[str, list[int]]:
        n = self.r.randint(1, 5)
        head = f"<h3>{self.phrase(1, 3)}</h3>"
        if self.r.random() < 0.6:
            return f"<aside>{head}<ul>{self.links(n)}</ul><p>{self.prose(1, 2)}</p></aside>", [0] * (n + 2)
        return f'<div class="{self.r.choice(("sidebar", "related", "widget", "recommended"))}">{head}<ul>{self.links(n)}</ul></div>', [0] * (n + 1)

    def form(self) -> tuple[str, list[int]]:
        return f'<form action="/{self.word()}"><label>{self.phrase(1, 3)}</label><input name="q"><p>{self.prose(1, 2)}</p><button>{self.phrase(1, 2)}</button></form>', [0] * 3

    def comments(self) -> tuple[str, list[int]]:
        n = self.r.randint(1, 5)
        each = [f'<div class="comment"><p>{self.prose(1, 5)}</p></div>' for _ in range(n)]
        wrap = self.r.choice(("div", "section"))
        return f'<{wrap} {self.r.choice(("class", "id"))}="{self.r.choice(("comments", "comment-list", "replies", "discussion"))}"><h2>{self.phrase(1, 2)}</h2>{"".join(each)}</{wrap}>', [0] * (n + 1)

    def article(self) -> tuple[str, list[int]]:
        parts, labels = [f"<h1>{self.phrase(1, 10)}</h1>"] * (self.r.random() < 0.85), []
        labels += [1] * len(parts)
        for _ in range(self.r.choice((1, 2, 3, 4, 6, 9, 14))):
            shape = self.r.random()
            if shape < 0.62:
                parts.append(f"<p>{self.prose()}" + "</p>" * (self.r.random() < 0.8))
                labels.append(1)
            elif shape < 0.70:
                parts.append(f"<p>{self.shout()}</p>")
                labels.append(1)
            elif shape < 0.76:
                parts.append(f"<h2>{self.phrase(1, 6)}</h2>")
                labels.append(1)
            elif shape < 0.81:
                n = self.r.randint(1, 4)
                parts.append("<ul>" + "".join(f"<li>{self.phrase(2, 12)}</li>" for _ in range(n)) + "</ul>")
                labels += [1] * n
            elif shape < 0.85:
                parts.append(f"<blockquote><p>{self.prose(1, 3)}</p></blockquote>")
                labels.append(1)
            elif shape < 0.88:
                parts.append(f"<pre>{self.phrase(2, 12)}</pre>")
                labels.append(1)
            elif shape < 0.91:
                parts.append(f"<table><tr><td>{self.phrase(1, 3)}</td><td>{self.phrase(1, 3)}</td></tr></table>")
                labels += [1, 1]
            elif shape < 0.94:
                parts.append(f"<p><b>{self.prose(1, 3)}<br>")
                labels.append(1)
            else:
                html, own = self.r.choice((self.advert, self.notice, self.side, self.form))()
                parts.append(html)
                labels += own
        body = "".join(parts)
        shape = self.r.random()
        if shape < 0.6:
            return f"<article>{body}</article>", labels
        if shape < 0.75:
            return f"<main>{body}</main>", labels
        return f'<div class="{self.r.choice(_BODY)}">{body}</div>', labels

    def page(self) -> tuple[str, list[int]]:
        before = self.r.sample((self.menu, self.top, self.advert, self.notice, self.side, self.form), self.r.randint(0, 4))
        after = self.r.sample((self.menu, self.advert, self.notice, self.side, self.form, self.comments), self.r.randint(0, 3))
        parts = [make() for make in (*before, self.article, *after)]
        if self.r.random() < 0.85:
            parts.append(self.bottom())
        html = "".join(h for h, _ in parts)
        return f"<!DOCTYPE html><html><head><title>{self.phrase(1, 5)}</title><style>p{{}}</style></head><body>{html}</body></html>", [y for _, own in parts for y in own]


def labelled_pages(n: int = 400, seed: int = 11) -> list[tuple[str, list[int]]]:
    maker = PageMaker(seed)
    return [maker.page() for _ in range(n)]
