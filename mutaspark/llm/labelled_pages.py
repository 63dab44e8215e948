"""Labelled pages to train HTML extraction on: pages of common layouts, made from a seed, and which of their blocks are the article."""

from __future__ import annotations

import random

# Names that page authors give to parts, for training only.
ARTICLE = ["article", "post", "entry", "content", "story", "main", "article-body", "post-content", "entry-content", "main-content", "page-content", "text", "body-text", "prose", "markdown-body", "story-body"]
NOT_ARTICLE = {
    "menu": ["nav", "menu", "navbar", "navigation", "main-menu", "topnav", "breadcrumb", "breadcrumbs", "site-nav", "pagination", "toc"],
    "header": ["header", "masthead", "site-header", "page-header", "logo", "branding", "top-bar", "hero-banner"],
    "footer": ["footer", "site-footer", "page-footer", "copyright", "colophon", "bottom", "legal"],
    "sidebar": ["sidebar", "side", "widget", "rail", "related", "recommended", "popular", "more-stories", "tags", "share", "social", "author-box"],
    "notice": ["notice", "cookie", "cookie-banner", "consent", "alert", "gdpr", "banner", "popup", "modal", "newsletter", "paywall", "message"],
    "advert": ["ad", "ads", "advert", "advertisement", "sponsor", "sponsored", "promo", "ad-slot", "banner-ad", "adsbygoogle"],
    "form": ["form", "search", "search-form", "login", "subscribe", "signup", "contact-form"],
    "comments": ["comments", "comment", "comment-list", "comment-body", "disqus_thread", "responses", "replies", "discussion"],
}
STOCK = {
    "menu": ["Home", "About", "Contact", "Products", "News", "Sign in", "Next", "Previous"],
    "header": ["The Daily", "Welcome to our site", "Company blog"],
    "footer": ["&copy; 2024 Example. All rights reserved.", "Privacy policy", "Terms of use &middot; Imprint"],
    "sidebar": ["Related articles", "Share this", "Most read", "Tags"],
    "notice": ["We use cookies to improve your experience.", "Subscribe to our newsletter.", "This site uses cookies. Accept all"],
    "advert": ["Advertisement", "Sponsored", "Buy now and save 50%", "Limited offer"],
    "form": ["Search", "Your e-mail", "Submit", "Password"],
    "comments": ["Great post, thanks!", "I disagree with this.", "Reply", "3 comments"],
}


class Maker:
    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.blocks: list[tuple[str, bool]] = []

    def word(self) -> str:
        return "".join(self.r.choice(["ba", "te", "ri", "no", "lu", "es", "an", "th", "or", "mi", "ka", "un", "ge", "so"]) for _ in range(self.r.randint(1, 4)))

    def words(self, low: int, high: int) -> str:
        out = " ".join(self.word() for _ in range(self.r.randint(low, high)))
        return out[0].upper() + out[1:] + self.r.choice([".", ".", ".", "", "?"])

    def prose(self, low: int = 1, high: int = 60) -> str:
        out = self.words(low, high)
        if self.r.random() < 0.25:
            out = out.replace(" ", f' <a href="/x">{self.word()}</a> ', 1)
        if self.r.random() < 0.2:
            out = f"<b>{out}" + ("</b>" if self.r.random() < 0.7 else "<br>")
        return out

    def named(self, tag: str, names: list[str], inner: str, always: bool = False) -> str:
        if not always and self.r.random() < 0.2:
            return f"<{tag}>{inner}</{tag}>"
        return f'<{tag} {self.r.choice(["class", "class", "id"])}="{self.r.choice(names)}">{inner}</{tag}>'

    def block(self, tag: str, text: str, content: bool) -> str:
        """One text block, marked so that its label is found again in the parsed page."""
        self.blocks.append((text, content))
        return f"<{tag} data-block={len(self.blocks) - 1}>{text}</{tag}>" if self.r.random() < 0.9 or tag != "p" else f"<{tag} data-block={len(self.blocks) - 1}>{text}"

    def junk(self, kind: str) -> str:
        r, texts = self.r, STOCK[kind]
        pick = lambda: r.choice(texts) if r.random() < 0.5 else self.words(1, 14)
        tag = {"menu": "nav", "header": "header", "footer": "footer", "sidebar": "aside", "form": "form"}.get(kind, "div")
        own = tag if tag != "div" and r.random() < 0.6 else r.choice(["div", "div", "section", "ul" if kind == "menu" else "div"])
        if kind == "menu" or (kind in ("sidebar", "footer") and r.random() < 0.5):
            inner = "".join(self.block("li", f'<a href="/{k}">{pick()}</a>', False) for k in range(r.randint(2, 8)))
            inner = inner if own == "ul" else f"<ul>{inner}</ul>"
        elif kind == "form":
            inner = "".join(self.block(r.choice(["label", "div", "p"]), pick(), False) + "<input name=q>" for _ in range(r.randint(1, 3))) + "<button>Go</button>"
        elif kind == "comments":
            rows = [self.named("div", NOT_ARTICLE["comments"], self.block("p", self.prose(2, 40) if r.random() < 0.7 else pick(), False), True) for _ in range(r.randint(1, 5))]
            inner = "".join(rows) if r.random() < 0.6 else "<ol>" + "".join(f"<li>{x}</li>" for x in rows) + "</ol>"
        else:
            inner = "".join(self.block(r.choice(["p", "div", "span" if own != "ul" else "li"]) if own != "p" else "span", pick() if r.random() < 0.7 else self.prose(3, 25), False) for _ in range(r.randint(1, 3)))
        if kind in ("sidebar", "comments", "notice", "footer") and own != "ul" and r.random() < 0.35:
            inner = self.block(r.choice(["h2", "h3", "h4"]), pick(), False) + inner
        return self.named(own, NOT_ARTICLE[kind], inner, own not in ("nav", "header", "footer", "aside", "form"))

    def article(self) -> str:
        r, parts = self.r, []
        longest = r.choice([6, 20, 90, 90])
        if r.random() < 0.9:
            parts.append(self.block("h1", self.words(2, 12), True))
        for _ in range(r.randint(1, 12)):
            x = r.random()
            if x < 0.72:  # short paragraphs now and then, and in some articles nothing else
                parts.append(self.block("p", self.prose(1, longest), True))
            elif x < 0.8:
                parts.append(self.block(r.choice(["h2", "h3"]), self.words(1, 8), True))
            elif x < 0.86:
                parts.append("<ul>" + "".join(self.block("li", self.words(2, 20), True) for _ in range(r.randint(2, 5))) + "</ul>")
            elif x < 0.9:
                parts.append("<blockquote>" + self.block("p", self.prose(5, 40), True) + "</blockquote>")
            elif x < 0.93:
                parts.append("<table>" + "".join("<tr>" + self.block("td", self.words(1, 4), True) + self.block("td", self.words(1, 4), True) + "</tr>" for _ in range(2)) + "</table>")
            elif x < 0.95:
                parts.append(self.block("pre", self.words(4, 20), True))
            else:
                parts.append(self.junk(r.choice(["advert", "notice", "sidebar"])))
        if len(parts) > 1 and r.random() < 0.25:  # the title in a header of its own, the rest in an element
            parts = [self.named("header", ARTICLE, parts[0]), self.named("div", ARTICLE, "".join(parts[1:]), True)]
        if r.random() < 0.15:
            parts.append(self.junk("comments"))
        return "".join(parts)

    def page(self) -> str:
        r = self.r
        some = lambda kind, p: self.junk(kind) if r.random() < p else ""
        top = some("notice", 0.3) + some("header", 0.5) + some("menu", 0.85) + some("advert", 0.5)
        wrap = r.random()
        if wrap < 0.08:  # nothing around it
            body = self.article()
        elif wrap < 0.54:
            body = f"<article>{self.article()}</article>" if r.random() < 0.6 else self.named("article", ARTICLE, self.article())
        else:
            body = self.named(r.choice(["div", "div", "main", "section"]), ARTICLE, self.article(), r.random() < 0.9)
        if r.random() < 0.4:
            body = self.named(r.choice(["div", "main"]), ["wrapper", "container", "page", "layout", "row", "col"], body + some("comments", 0.35) + some("sidebar", 0.5), True)
        rest = some("sidebar", 0.4) + some("comments", 0.35) + some("form", 0.4) + some("advert", 0.2) + some("footer", 0.85)
        end = "</body></html>" if r.random() < 0.9 else ""
        return f"<!DOCTYPE html><html><head><title>{self.words(2, 8)}</title><style>p{{}}</style></head><body>{top}{body}{rest}{end}"


def labelled_pages(count: int, seed: int = 11) -> list[tuple[str, list[bool]]]:
    """(html, labels): each block's opening tag carries data-block, its place in labels."""
    out = []
    for k in range(count):
        maker = Maker(seed * 100_003 + k)
        html = maker.page()
        out.append((html, [content for _, content in maker.blocks]))
    return out
