"""Labelled pages to train extraction on: varied layouts around invented text.

Content texts begin with SIGN. Layouts differ in their use of semantic elements,
of class and id names, of tables, and in what stands around and inside the article.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

SIGN = "\ue000"

# Usual class and id words of page parts.
NAMES = {
    "content": "content post article-body entry-content story post-content main-text article entry body-text page-content text story-body",
    "nav": "nav menu navbar navigation topnav breadcrumb breadcrumbs main-menu site-nav links toc pagination pager tabs",
    "header": "header site-header masthead top banner-top branding logo page-header topbar",
    "footer": "footer site-footer bottom copyright colophon legal foot page-footer",
    "side": "sidebar side aside related widget popular recommended trending more-stories archive tags share social author-box",
    "ad": "ad ads advert advertisement sponsored promo banner sponsor adsbox commercial",
    "notice": "notice cookie cookie-notice consent alert gdpr newsletter popup modal disclaimer message subscribe paywall",
    "form": "form search search-form login signup subscribe-form contact",
    "comments": "comments comment comment-list replies reply discussion disqus responses reader-comments",
}
SYLLABLES = "the an er in re th on ti en es st nd ou ha ing ea or wh tion ble le de la qu é è aux ment der ung sch ü ge lich ción os ar mente ñ ka mi to no".split()
BOILER = ("Home", "About us", "Contact", "Privacy policy", "Terms of use", "Login", "Register", "Sign in", "Search", "Read more", "Next", "Previous", "Share", "Menu", "News", "Sports", "Archive", "Help", "Shop")
NOTICES = ("We use cookies to improve your visit. By continuing you agree.", "Subscribe to our newsletter for weekly updates.", "Please enable notifications.", "This site is best viewed with a recent browser.", "Advertisement", "Sponsored content", "You have read all free articles this month.")


class Page:
    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.semantic = self.r.random() < 0.6
        self.classy = self.r.random() < 0.75

    def words(self, low: int, high: int) -> str:
        r = self.r
        out = ["".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 4))) for _ in range(r.randint(low, high))]
        for i in range(0, len(out), r.randint(4, 12)):
            out[i] = out[i].capitalize()
            if i and r.random() < 0.8:
                out[i - 1] += r.choice(".,;.&.")
        return " ".join(out).replace("&", "&amp;") + r.choice(["", ".", ".", "!"])

    def mark(self, kind: str) -> str:
        r = self.r
        if not self.classy or r.random() < 0.2:
            return ""
        name = r.choice(NAMES[kind].split())
        return r.choice([f' class="{name}"', f' id="{name}"', f' class="{name} x{r.randint(1, 9)}"', f" class='{name}'", f' class="c-{name}"', f' class="{name}__inner"'])

    def element(self, kind: str, tags: str, inner: str, plain: str = "div") -> str:
        tag = self.r.choice(tags.split()) if self.semantic else plain
        return f"<{tag}{self.mark(kind)}>{inner}</{tag}>"

    def links(self, low: int, high: int) -> str:
        r = self.r
        label = lambda: r.choice(BOILER) if r.random() < 0.5 else self.words(1, 3)
        items = [f'<a href="/{i}">{label()}</a>' for i in range(r.randint(low, high))]
        style = r.random()
        if style < 0.6:
            return "<ul>" + "".join(f"<li>{i}</li>" if r.random() < 0.9 else f"<li>{i}" for i in items) + "</ul>"
        return r.choice([" | ", " ", " &middot; "]).join(items) if style < 0.85 else "".join(f"<div>{i}</div>" for i in items)

    def nav(self) -> str:
        return self.element("nav", "nav nav nav div", self.links(3, 9))

    def header(self) -> str:
        r = self.r
        inner = r.choice([f"<a href='/'>{self.words(1, 3)}</a>", f"<h1>{self.words(1, 3)}</h1>", f"<h2>{self.words(1, 4)}</h2><p>{self.words(3, 8)}</p>", f"<div>{self.words(1, 4)}</div>"])
        return self.element("header", "header header div", inner + (self.nav() if r.random() < 0.4 else ""))

    def footer(self) -> str:
        r = self.r
        inner = [f"<p>&copy; {r.randint(1999, 2026)} {self.words(1, 6)}</p>", f"&copy; site{r.randint(1, 99)}.example.com &middot; {self.words(3, 12)}", f"<p>{self.words(3, 20)}</p>", self.links(2, 6)]
        return self.element("footer", "footer footer footer div", "".join(r.sample(inner, r.randint(1, 3))))

    def side(self) -> str:
        r = self.r
        inner = f"<h3>{self.words(1, 3)}</h3>" + r.choice([self.links(3, 7), f"<p>{self.words(5, 40)}</p>", "".join(f"<p><a href='#'>{self.words(4, 10)}</a></p>" for _ in range(3)), f"<ul><li>{self.words(3, 9)}<li>{self.words(3, 9)}</ul>"])
        return self.element("side", "aside aside aside div", inner)

    def ad(self) -> str:
        r = self.r
        name = r.choice(NAMES["ad"].split())
        inner = r.choice([self.words(3, 25), f"<a href='#'>{self.words(3, 12)}</a>", f"<p>{self.words(4, 25)}</p>", f"<span>{r.choice(NOTICES)}</span>"])
        return r.choice([f'<div class="{name}">{inner}</div>', f'<div id="{name}-{r.randint(1, 9)}">{inner}</div>', f'<section class="{name}">{inner}</section>', f'<aside class="{name}">{inner}</aside>', f'<p class="{name}">{self.words(3, 20)}</p>'])

    def notice(self) -> str:
        r = self.r
        name, text = r.choice(NAMES["notice"].split()), r.choice(NOTICES) if r.random() < 0.4 else self.words(5, 40)
        return r.choice([f'<div class="{name}">{text}</div>', f'<div class="{name}"><p>{text}</p><button>OK</button></div>', f'<section id="{name}"><p>{text}</p></section>', f'<p class="{name}">{text}</p>', f'<div role="alert"><p>{text}</p></div>', f'<div role="dialog" class="{name}"><p>{text}</p></div>'])

    def form(self) -> str:
        r = self.r
        inner = f"<label>{self.words(1, 3)}</label><input name=q>" + r.choice(["<button>Go</button>", f"<p>{self.words(3, 15)}</p><input type=submit>", f"<select><option>{self.words(1, 2)}<option>{self.words(1, 2)}</select>", f"<fieldset><legend>{self.words(1, 3)}</legend>{self.words(2, 8)}</fieldset>"])
        return f"<form{self.mark('form')}>{inner}</form>"

    def comments(self) -> str:
        r = self.r
        name = r.choice(NAMES["comments"].split())
        one = lambda: r.choice([f'<div class="comment"><b>{self.words(1, 2)}</b><p>{self.words(4, 60)}</p></div>', f"<li><p>{self.words(4, 60)}</p></li>", f'<div class="reply"><p>{self.words(4, 60)}</p></div>', f"<article><p>{self.words(4, 60)}</p></article>", f'<article class="comment"><header>{self.words(1, 2)}</header><p>{self.words(4, 60)}</p></article>'])
        inner = (f"<h3>{r.choice(['Comments', 'Responses', self.words(1, 3)])}</h3>" if r.random() < 0.7 else "") + "".join(one() for _ in range(r.randint(1, 6)))
        return f"<{r.choice(['div', 'section', 'section', 'aside', 'ol'])} {r.choice(['class', 'id'])}=\"{name}\">{inner}</{'div'}>" if r.random() < 0.1 else (lambda t: f'<{t} {r.choice(["class", "id"])}="{name}">{inner}</{t}>')(r.choice(["div", "section", "section", "ul"]))

    def paragraph(self) -> str:
        r = self.r
        text = SIGN + self.words(1, 12 if r.random() < 0.25 else 120)
        kind = r.random()
        if kind < 0.5:
            return f"<p>{text}</p>" if r.random() < 0.8 else f"<p>{text}"
        if kind < 0.6:
            return f"<p><b>{text}<br>"
        if kind < 0.68:
            return f"<p>{text} <a href='/x'>{self.words(1, 4)}</a> {self.words(1, 20)}</p>"
        if kind < 0.76:
            return f"<h{(k := r.randint(2, 4))}>{SIGN}{self.words(1, 8)}</h{k}>"
        if kind < 0.82:
            return f"<blockquote>{text}</blockquote>" if r.random() < 0.5 else f"<blockquote><p>{text}</p></blockquote>"
        if kind < 0.9:
            tag = r.choice(["ul", "ol"])
            return f"<{tag}>" + "".join(f"<li>{SIGN}{self.words(1, 25)}" + r.choice(["</li>", ""]) for _ in range(r.randint(2, 6))) + f"</{tag}>"
        if kind < 0.94:
            return "<table>" + "".join("<tr>" + "".join(f"<td>{SIGN}{self.words(1, 8)}</td>" for _ in range(3)) + "</tr>" for _ in range(r.randint(1, 4))) + "</table>"
        return f"<div>{text}</div>" if kind < 0.97 else f"<pre>{text}</pre>"

    def article(self) -> str:
        r = self.r
        parts = [self.paragraph() for _ in range(r.choice([1, 2, 5, 10, 20, 40]))]
        title = f"<h1>{SIGN}{self.words(2, 10)}</h1>" if r.random() < 0.8 else ""
        for insert, chance in ((self.ad, 0.35), (self.notice, 0.2), (self.form, 0.12), (self.side, 0.15), (self.nav, 0.1)):
            if r.random() < chance:
                parts.insert(r.randint(0, len(parts)), insert())
        if r.random() < 0.2:
            parts.append(self.comments())
        inner = title + "".join(parts)
        if self.semantic and r.random() < 0.85:
            body = f"<article{self.mark('content') if r.random() < 0.5 else ''}>{inner}</article>"
            return f"<main>{body}</main>" if r.random() < 0.35 else body
        if self.semantic:
            return f"<main{self.mark('content')}>{inner}</main>"
        name = r.choice(NAMES["content"].split())
        return f'<div {r.choice(["class", "id"])}="{name}">{inner}</div>' if r.random() < 0.9 else f"<div>{inner}</div>"

    def html(self) -> str:
        r = self.r
        before = [f() for f, p in ((self.header, 0.5), (self.nav, 0.8), (self.notice, 0.3), (self.form, 0.25), (self.ad, 0.5), (self.side, 0.2)) if r.random() < p]
        after = [f() for f, p in ((self.ad, 0.3), (self.side, 0.45), (self.comments, 0.4), (self.form, 0.2), (self.notice, 0.2), (self.nav, 0.15)) if r.random() < p]
        r.shuffle(before)
        r.shuffle(after)
        middle = self.article()
        if r.random() < 0.15:
            middle = f"<table><tr><td>{''.join(before[-1:])}</td><td>{middle}</td></tr></table>"
        body = "".join(before) + "<!-- x -->" + middle + "".join(after) + (self.footer() if r.random() < 0.85 else "")
        if r.random() < 0.3:
            body = f'<div {r.choice(["class", "id"])}="{r.choice(["wrapper", "container", "page", "layout", "row", "site"])}">{body}</div>'
        return f"<!DOCTYPE html><html><head><title>{self.words(2, 8)}</title><script>var a = '<p>';</script></head><body>{body}</body></html>"


def pages(n: int, seed: int = 0) -> Iterator[str]:
    for i in range(n):
        yield Page(seed * 1_000_003 + i).html()
