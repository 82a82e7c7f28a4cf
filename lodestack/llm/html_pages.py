"""Labelled pages for training the tree model: invented layouts in which each content block starts with MARK."""

from __future__ import annotations

import random

MARK = ""

_LETTERS = ("a e i o u", "b c d f g l m n p r s t v")


class _Page:
    def __init__(self, r: random.Random) -> None:
        self.r = r
        self.bare = r.random() < 0.2  # neither semantic tags nor names
        self.semantic = not self.bare and r.random() < 0.6
        self.joint = r.choice([" "] * 8 + [" | ", "!! ", " – ", " / "])  # how the article's words are joined

    def word(self) -> str:
        v, c = (x.split() for x in _LETTERS)
        w = "".join(self.r.choice(c) + self.r.choice(v) for _ in range(self.r.randint(1, 4)))
        return w + self.r.choice(["", "", "s", "n", "é"])

    def words(self, low: int, high: int) -> str:
        return " ".join(self.word() for _ in range(self.r.randint(low, high)))

    def prose(self, low: int = 1, high: int = 6) -> str:
        return " ".join(self.words(3, 18).capitalize() + self.r.choice(".....!?") for _ in range(self.r.randint(low, high)))

    def box(self, tag: str, names: str, inner: str) -> str:
        """An element of one of the given class names, or a plain div."""
        t = tag if self.semantic and self.r.random() < 0.8 else "div"
        if self.bare:
            return f"<div>{inner}</div>"
        n = self.r.choice(names.split())
        attr = self.r.choice([f' class="{n}"', f' id="{n}"', f' class="{n} {self.word()}"', "" if t != "div" else f' class="{n}"'])
        return f"<{t}{attr}>{inner}</{t}>"

    def links(self, low: int = 3, high: int = 9, joined: str | None = None) -> str:
        items = [f'<a href="/{self.word()}">{self.words(1, 3)}</a>' for _ in range(self.r.randint(low, high))]
        if joined is None and self.r.random() < 0.75:
            return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>"
        return (joined or self.r.choice([" | ", " ", " &middot; "])).join(items)

    # boilerplate
    def nav(self) -> str:
        return self.box("nav", "nav navbar menu topnav navigation main-menu breadcrumb breadcrumbs", self.links())

    def header(self) -> str:
        inner = self.r.choice([f"<h1>{self.words(1, 3)}</h1>", f"<div>{self.words(1, 3)}</div>", f"<p>{self.words(2, 6)}</p>"])
        return self.box("header", "header masthead site-header top banner branding", inner + self.r.choice(["", self.links(2, 4), f"<p>{self.prose(1, 1)}</p>"]))

    def footer(self) -> str:
        inner = self.r.choice([f"&copy; {self.word()}.example.com &middot; {self.prose(1, 2)}", f"<p>Copyright {self.words(2, 5)}</p>{self.links(2, 5)}", f"<p>&copy; 2020 {self.word()} | {self.words(2, 6)}</p><p>{self.prose(1, 2)}</p>"])
        return self.box("footer", "footer site-footer bottom colophon copyright legal", inner)

    def aside(self) -> str:
        inner = f"<h3>{self.words(1, 3)}</h3>" + self.r.choice([self.links(), f"<p>{self.prose(1, 2)}</p>", f"<p>{self.prose(1, 2)}</p>{self.links(2, 4)}"])
        return self.box("aside", "sidebar aside widget rail related related-posts recommended popular trending side more-stories", inner)

    def advert(self) -> str:
        return self.box("div", "ad ads advert advertisement sponsor sponsored promo banner-ad adsense", self.r.choice([self.prose(1, 2), f"<p>{self.prose(1, 1)}</p>", f'<a href="/x">{self.words(2, 8)}</a>', f"<p>{self.prose(1, 2)}</p><a>{self.words(1, 3)}</a>"]))

    def notice(self) -> str:
        inner = self.r.choice([self.prose(1, 2), f"<p>{self.prose(1, 3)}</p>"]) + self.r.choice(["", f"<button>{self.words(1, 2)}</button>", f'<a href="/c">{self.words(1, 2)}</a>'])
        return self.box("div", "cookie cookies cookie-banner consent gdpr notice notification alert popup modal overlay privacy-notice paywall", inner)

    def form(self) -> str:
        inner = f"<label>{self.words(1, 3)}</label><input name=q><textarea>{self.word()}</textarea><select><option>{self.word()}</option></select><button>{self.word()}</button>"
        inner = self.r.choice(["", f"<p>{self.prose(1, 1)}</p>", f"<h3>{self.words(2, 4)}</h3>"]) + inner
        f = f"<form action=/s>{inner}</form>"
        return f if self.r.random() < 0.6 else self.box("div", "newsletter subscribe signup search login contact-form", f)

    def comments(self) -> str:
        one = lambda: self.box("div", "comment comment-body reply response", self.r.choice([f"<p>{self.prose(1, 3)}</p>", f"<cite>{self.word()}</cite><p>{self.prose(1, 4)}</p>", f"<b>{self.word()}</b>: {self.prose(1, 3)}"]))
        inner = self.r.choice(["", f"<h2>{self.words(1, 2)}</h2>", f"<h3>{self.word()}</h3>"]) + "".join(one() for _ in range(self.r.randint(1, 5)))
        if self.semantic and self.r.random() < 0.2:
            inner = inner.replace("<div", "<article").replace("</div", "</article")
        return self.box("section", "comments comment-list commentlist discussion responses disqus replies", inner)

    def share(self) -> str:
        return self.box("div", "share social share-buttons social-links tags byline-links pagination pager", self.links(2, 5))

    # content
    def inline(self, text: str) -> str:
        w = text.split(" ")
        if self.joint != " ":
            return self.joint.join(w)
        for _ in range(self.r.choice([0, 0, 0, 1, 2])):
            k = self.r.randrange(len(w))
            t = self.r.choice(["a", "b", "em", "strong", "i", "code", "span"])
            w[k] = f"<{t}{' href=/y' if t == 'a' else ''}>{w[k]}</{t}>"
        return " ".join(w)

    def block(self) -> str:
        kind = self.r.choices(["p", "h", "list", "quote", "pre", "table", "figure", "loose", "open"], [60, 8, 5, 3, 2, 2, 2, 3, 6])[0]
        text = lambda lo=1, hi=6: MARK + self.inline(self.prose(lo, hi))
        if kind == "h":
            return f"<h{(k := self.r.choice('234'))}>{MARK}{self.words(1, 8)}</h{k}>"
        if kind == "list":
            t = self.r.choice(["ul", "ol"])
            return f"<{t}>" + "".join(f"<li>{MARK}{self.inline(self.words(2, 14))}{self.r.choice(['', '.'])}</li>" for _ in range(self.r.randint(2, 5))) + f"</{t}>"
        if kind == "quote":
            return f"<blockquote>{text(1, 2)}</blockquote>" if self.r.random() < 0.5 else f"<blockquote><p>{text(1, 2)}</p></blockquote>"
        if kind == "pre":
            return f"<pre>{text(1, 2)}</pre>"
        if kind == "table":
            return "<table>" + "".join("<tr>" + "".join(f"<td>{MARK}{self.words(1, 4)}</td>" for _ in range(2)) + "</tr>" for _ in range(self.r.randint(1, 4))) + "</table>"
        if kind == "figure":
            return f"<figure><img src=x><figcaption>{MARK}{self.words(3, 12)}</figcaption></figure>"
        if kind == "loose":
            return f"<div>{text()}</div>"
        if kind == "open":
            return f"<p><b>{text()}<br>"
        return f"<p>{text(1, self.r.choice([1, 2, 6, 9]))}</p>"

    def article(self, title: str) -> str:
        head = self.r.choice(["", f"<h1>{MARK}{title}</h1>", f"<h1>{MARK}{title}</h1>", f"<h2>{MARK}{title}</h2>"])
        if self.semantic and head and self.r.random() < 0.2:
            head = f"<header>{head}</header>"
        n = self.r.choice([0, 1, 1, 2, 3, 5, 8, 14])
        blocks = [self.block() for _ in range(n)]
        if not head and not blocks:
            blocks = [self.block()]
        for kind, chance in ((self.advert, 0.15), (self.share, 0.1), (self.aside, 0.05), (self.form, 0.04)):
            if self.r.random() < chance and not self.bare:
                blocks.insert(self.r.randint(0, len(blocks)), kind())
        inner = head + "".join(blocks)
        if self.bare:
            return f"<div>{inner}</div>"
        tag = "article" if self.r.random() < 0.6 else self.r.choice(["main", "section", "div"])
        names = "post article entry content story article-body entry-content post-content main-content text body-text page-content"
        attr = "" if tag in ("article", "main") and self.r.random() < 0.6 else f' class="{self.r.choice(names.split())}"'
        out = f"<{tag}{attr}>{inner}</{tag}>"
        return f"<main>{out}</main>" if self.semantic and tag != "main" and self.r.random() < 0.2 else out

    def page(self) -> str:
        title = self.words(2, 10).capitalize()
        before = [k() for k, c in ((self.notice, 0.25), (self.header, 0.5), (self.nav, 0.7), (self.advert, 0.4), (self.form, 0.1), (self.aside, 0.1)) if self.r.random() < c]
        after = [k() for k, c in ((self.share, 0.2), (self.comments, 0.35), (self.aside, 0.35), (self.form, 0.2), (self.advert, 0.25), (self.nav, 0.1), (self.footer, 0.75), (self.notice, 0.1)) if self.r.random() < c]
        if self.bare:  # without any name, prose of others can't be told from the article's
            before, after = [self.nav()], [self.footer()] if self.r.random() < 0.8 else []
        if self.r.random() < 0.3:
            self.r.shuffle(before)
        body = "".join(before) + self.article(title) + "".join(after)
        for _ in range(self.r.choice([0, 0, 1, 2])):
            body = f"<div{self.r.choice(['', ' id=wrapper', ' class=container', ' class=page'])}>{body}</div>"
        junk = self.r.choice(["", f"<!-- {self.word()} -->", f'<script>var t="</p>";{self.word()}(3);</script>', "<style>p{margin:0}</style>"])
        return f'<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>{title}</title>{junk}</head><body>{body}{junk}</body></html>'


def labelled_pages(n: int, seed: int) -> list[str]:
    r = random.Random(seed)
    return [_Page(r).page() for _ in range(n)]
