"""Seeded generator of web pages with known article text, for the block labeller's training and
tests. Layouts vary; words are random syllables, some of them common, so no topic is learned."""

from __future__ import annotations

import html
import random
from collections.abc import Iterator

#: Class and id words of the parts of pages.
MAIN = ["content", "main", "post", "entry", "article", "story", "body", "text", "page-content", "post-content", "entry-content", "article-body", "story-text", ""]
WRAP = ["wrapper", "container", "page", "site", "layout", "row", "inner", "outer", "grid", "column", ""]
PARTS = {
    "nav": (["nav", "div", "ul"], ["menu", "navbar", "navigation", "nav-links", "breadcrumb", "breadcrumbs", "topnav", "tabs", "toc"]),
    "header": (["header", "div"], ["header", "site-header", "masthead", "branding", "topbar", "banner-top", "logo"]),
    "footer": (["footer", "div"], ["footer", "site-footer", "copyright", "bottom", "colophon", "legal"]),
    "sidebar": (["aside", "div"], ["sidebar", "side", "widget", "related", "recommended", "popular", "more-stories", "tags", "archive"]),
    "ad": (["div", "section", "aside"], ["ad", "ads", "advert", "advertisement", "sponsored", "promo", "banner", "promotion", "sponsor"]),
    "notice": (["div", "section", "dialog"], ["cookie", "cookie-notice", "consent", "gdpr", "notice", "alert", "modal", "popup", "newsletter", "subscribe", "paywall", "privacy"]),
    "form": (["form"], ["search", "login", "signup", "newsletter-form", "contact-form", "comment-form", ""]),
    "comments": (["section", "div", "ol", "ul"], ["comments", "comment-list", "commentlist", "responses", "replies", "discussion", "disqus", "user-comments"]),
    "share": (["div", "ul"], ["share", "social", "sharing", "social-links", "byline", "meta", "author-box", "post-meta"]),
}
SYLLABLES = "an ar be bo ca ch ci co da de di do el en er es et ie in ing io ka la le li lo ly ma me mi mo na ne ni no ol on or ou pa pe qu ra re ri ro sa se si so st ta te th ti to tr un ur ve vi zu ä é ñ ß ó ü".split()


class _Page:
    def __init__(self, rng: random.Random):
        self.r = rng
        self.texts: set[str] = set()
        self.common = [self.word() for _ in range(40)]

    def word(self) -> str:
        return "".join(self.r.choices(SYLLABLES, k=self.r.randint(1, 5)))

    def words(self, low: int, high: int) -> list[str]:
        out = [self.r.choice(self.common) if self.r.random() < 0.4 else self.word() for _ in range(self.r.randint(low, high))]
        style = self.r.random()
        if style < 0.05:
            out = [w.upper() + "!!" for w in out]
        elif style < 0.10:
            out = [w + self.r.choice(["%%%", "&&&", "***", "$$$"]) for w in out]
        elif style < 0.15:
            out = [w for x in out for w in (x, "|")]
        elif style < 0.20:
            out = [w for x in out for w in [x] * self.r.randint(3, 30)]
        return out

    def sentence(self, low: int = 4, high: int = 24) -> str:
        return " ".join(self.words(low, high)).capitalize() + self.r.choice([".", ".", ".", ".", "!", "?", ""])

    def prose(self) -> str:
        kind = self.r.random()
        if kind < 0.15:
            return self.sentence(1, 4)
        return " ".join(self.sentence() for _ in range(self.r.choice([1, 1, 2, 3, 5, 9])))

    def show(self, text: str) -> str:
        """The text as markup: escaped, at times with inline tags."""
        out = html.escape(text, quote=self.r.random() < 0.5)
        words = out.split(" ")
        if len(words) > 6 and self.r.random() < 0.3:
            i = self.r.randrange(len(words) - 2)
            tag = self.r.choice(["b", "i", "em", "strong", "span", 'a href="/x"'])
            words[i] = f"<{tag}>{words[i]}"
            words[i + 1] += f"</{tag.split()[0]}>"
        return self.r.choice([" ", " ", " ", "\n "]).join(words)

    def attr(self, names: list[str]) -> str:
        name = self.r.choice(names)
        return f' {self.r.choice(["class", "class", "id"])}="{name}"' if name and self.r.random() < 0.9 else ""

    def wrap(self, body: str, depth: int) -> str:
        for _ in range(self.r.randint(0, depth)):
            body = f"<div{self.attr(WRAP)}>{body}</div>"
        return body

    def paragraph(self, tag: str = "p") -> str:
        text = self.prose()
        self.texts.add(" ".join(text.split()))
        if tag == "p" and self.r.random() < 0.1:
            return f"<p><b>{html.escape(text)}<br>"
        return f"<{tag}>{self.show(text)}</{tag}>" if tag != "p" or self.r.random() < 0.8 else f"<p>{self.show(text)}"

    def article(self) -> str:
        out = []
        title = " ".join(self.words(2, 12))
        if self.r.random() < 0.9:
            self.texts.add(title)
            head = f"<h1>{html.escape(title)}</h1>"
            out.append(f"<header>{head}</header>" if self.r.random() < 0.1 else head)
        for _ in range(self.r.choice([0, 1, 1, 2, 3, 4, 6, 8, 12, 20])):
            kind = self.r.random()
            if kind < 0.78:
                out.append(self.paragraph())
            elif kind < 0.84:
                out.append(self.paragraph(self.r.choice(["h2", "h3"])))
            elif kind < 0.88:
                items = "".join(self.paragraph("li") for _ in range(self.r.randint(2, 5)))
                out.append(f"<ul>{items}</ul>" if self.r.random() < 0.6 else f"<ol>{items}</ol>")
            elif kind < 0.91:
                out.append(f"<blockquote>{self.paragraph()}</p></blockquote>")
            elif kind < 0.93:
                rows = "".join(f"<tr>{self.paragraph('td')}{self.paragraph('td')}</tr>" for _ in range(self.r.randint(1, 3)))
                out.append(f"<table>{rows}</table>")
            elif kind < 0.96:
                out.append(self.part("ad"))
            else:
                out.append(self.part(self.r.choice(["share", "notice", "form", "sidebar"])))
        if self.r.random() < 0.15:
            out.append(self.part("comments"))
        if self.r.random() < 0.15:
            out.append(self.part("share"))
        body = "".join(out)
        kind = self.r.random()
        if kind < 0.5:
            return f"<article{self.attr(MAIN) if self.r.random() < 0.5 else ''}>{body}</article>"
        if kind < 0.7:
            return f"<main{self.attr(MAIN)}>{self.wrap(body, 1)}</main>"
        return f"<div {self.r.choice(['class', 'id'])}=\"{self.r.choice(MAIN[:-1])}\">{self.wrap(body, 1)}</div>"

    def items(self, low: int, high: int, link: bool) -> str:
        texts = [" ".join(self.words(1, 3)) for _ in range(self.r.randint(low, high))]
        each = [f'<a href="/{self.word()}">{html.escape(t)}</a>' if link else html.escape(t) for t in texts]
        return "".join(f"<li>{e}</li>" for e in each)

    def part(self, kind: str) -> str:
        tags, names = PARTS[kind]
        tag = self.r.choice(tags)
        marked = tag not in ("div", "section", "ul", "ol", "dialog") and self.r.random() < 0.5
        attr = "" if marked else f' {self.r.choice(["class", "class", "id"])}="{self.r.choice(names)}"' if names[-1] or self.r.random() < 0.7 else ""
        text = html.escape(self.prose() if self.r.random() < 0.6 else self.sentence(1, 8))
        inner = {
            "nav": lambda: self.items(2, 10, True) if tag == "ul" else f"<ul>{self.items(2, 10, True)}</ul>",
            "header": lambda: self.r.choice([f"<a href='/'>{text}</a>", f"<p>{text}</p>", f"<h2>{text}</h2>", text]),
            "footer": lambda: self.r.choice([f"&copy; {text}", f"<p>&copy; {text}</p><ul>{self.items(2, 5, True)}</ul>", f"{text} &middot; {html.escape(self.sentence())}"]),
            "sidebar": lambda: f"<h3>{text}</h3><ul>{self.items(2, 8, self.r.random() < 0.8)}</ul>" if self.r.random() < 0.6 else f"<p>{text}</p>",
            "ad": lambda: self.r.choice([text, f"<p>{text}</p>", f"<a href='/ad'>{text}</a>"]),
            "notice": lambda: self.r.choice([text, f"<p>{text}</p><button>OK</button>", f"<p>{text} <a href='/p'>{self.word()}</a></p>"]),
            "form": lambda: f"<label>{text}</label><input name=q><button>{self.word()}</button>",
            "comments": lambda: f"<h3>{self.sentence(1, 3)}</h3>" * (tag not in ("ol", "ul"))
            + "".join(self.r.choice(["<li>{}</li>", "<li><p>{}</p></li>"] if tag in ("ol", "ul") else ["<p>{}</p>", '<div class="comment"><b>x</b><p>{}</p></div>', "<div>{}</div>"]).format(html.escape(self.prose())) for _ in range(self.r.randint(1, 6))),
            "share": lambda: f"{self.items(2, 4, True)}" if tag == "ul" else f"<span>{text}</span>",
        }[kind]()
        return f"<{tag}{attr}>{inner}</{tag}>"

    def page(self) -> str:
        before = [self.part(k) for k in ("notice", "header", "nav", "ad", "form", "sidebar") if self.r.random() < (0.75 if k == "nav" else 0.35)]
        after = [self.part(k) for k in ("comments", "sidebar", "ad", "share", "notice", "footer") if self.r.random() < (0.8 if k == "footer" else 0.3)]
        if self.r.random() < 0.3:
            self.r.shuffle(before)
        middle = self.wrap(self.article(), 2)
        head = f'<!DOCTYPE html><html><head><meta charset="utf-8"><title>{self.sentence(2, 8)}</title><style>p{{margin:0}}</style><script>var t="</p>";</script></head><body>'
        out = head + "".join(before) + "<!-- x -->" + middle + "".join(after) + "</body></html>"
        return out[: self.r.randint(len(out) * 3 // 4, len(out))] if self.r.random() < 0.05 else out


def generate(n: int, seed: int) -> Iterator[tuple[str, set[str]]]:
    """n pages, each with the texts of its article's blocks."""
    rng = random.Random(seed)
    for _ in range(n):
        p = _Page(rng)
        out = p.page()
        yield out, p.texts
