"""Labelled training pages: blocks of given pages laid out anew, each part marked as main text or not."""

from __future__ import annotations

import html
import random

#: Words by which sites call their parts.
PARTS = {
    "main": "content main-content article-body post entry-content story post-body text page-content article blog-post body".split(),
    "menu": "menu nav navbar navigation breadcrumbs topnav main-menu pagination links toc".split(),
    "header": "header masthead site-header top branding logo page-header".split(),
    "footer": "footer site-footer bottom copyright colophon legal imprint".split(),
    "side": "sidebar widget side rail related recommended popular tags share social teaser more-stories".split(),
    "notice": "cookie notice consent gdpr alert popup modal cookie-notice paywall warning message overlay".split(),
    "advert": "ad ads advert advertisement sponsored promo banner-ad sponsor commercial".split(),
    "form": "newsletter subscribe search login signup contact-form feedback".split(),
    "comments": "comments comment comment-list discussion replies reader-comments disqus responses user-comment reactions".split(),
}
TAGS = {"main": ["article", "main", "section"], "menu": ["nav"], "header": ["header"], "footer": ["footer"], "side": ["aside"], "notice": ["dialog", "section"], "advert": ["aside"], "form": ["form"], "comments": ["section", "aside"]}
TITLES = {
    "menu": "Menu|Home|Contents".split("|"), "side": "Related|Popular|Share|More stories|Tags".split("|"), "notice": "Cookies|Notice|We use cookies.".split("|"), "advert": "Advertisement|Sponsored|Anzeige".split("|"),
    "form": "Search|Subscribe|Sign up|Log in".split("|"), "comments": "Comments|Discussion|Replies|Leave a comment".split("|"),
}
#: Used where a table has no page to draw text from.
FILLER = [
    "The morning was clear, and the road led down to the river.", "Nobody had expected the bridge to be open so early in the year.",
    "A small market stood at the corner, with bread, fruit and flowers.", "They walked on until the houses ended and the fields began.",
]


class Layout:
    def __init__(self, rng: random.Random, prose: list[str], short: list[str]):
        self.rng, self.prose, self.short = rng, prose or FILLER, short or [w for t in FILLER for w in t.split()]

    def text(self, pool: list[str]) -> str:
        return html.escape(self.rng.choice(pool), quote=False)

    def odd(self, text: str) -> str:
        """Now and then a text without punctuation, or one word again and again: the shape of a text alone decides nothing."""
        chance = self.rng.random()
        if chance < 0.08:
            return " ".join(w.strip(".,;:!?") for w in text.split(" "))
        return " ".join([text.split(" ")[0]] * self.rng.randint(3, 200)) if chance < 0.16 else text

    def sentences(self) -> str:
        text = self.odd(self.rng.choice(self.prose))
        words = text.split()
        n = self.rng.choice([4, 8, 15, 30, 60, len(words)])
        return html.escape(" ".join(words[:n]), quote=False)

    def box(self, part: str, inner: str, mark: int) -> str:
        """An element for a part: named by its tag, its class or id, or, seldom, by nothing."""
        rng = self.rng
        tag = rng.choice(TAGS[part]) if rng.random() < 0.5 else "div"
        named = tag in ("div", "section", "aside", "dialog") and rng.random() < 0.92 or rng.random() < 0.5
        if part == "advert" and not named or part == "comments" and not named:
            named = True
        names = f' {rng.choice(["class", "class", "id"])}="{" ".join(rng.sample(PARTS[part], rng.choice([1, 1, 2])))}"' if named else ""
        return f'<{tag}{names} data-mark="{mark}">{inner}</{tag}>'

    def titled(self, part: str) -> str:
        if part not in TITLES or self.rng.random() < 0.5:
            return ""
        tag = self.rng.choice(["h2", "h3", "h4", "p", "div"])
        return f"<{tag}>{self.rng.choice(TITLES[part])}</{tag}>"

    def links(self) -> str:
        n = self.rng.randint(2, 8)
        each = [f'<a href="/{i}">{self.text(self.short)}</a>' for i in range(n)]
        return self.rng.choice([lambda: "<ul>" + "".join(f"<li>{a}</li>" for a in each) + "</ul>", lambda: " | ".join(each), lambda: "".join(f"<div>{a}</div>" for a in each)])()

    def paragraphs(self, most: int) -> str:
        tag = self.rng.choice(["p", "p", "div", "span"])
        return "".join(f"<{tag}>{self.sentences()}</{tag}>" for _ in range(self.rng.randint(1, most)))

    def part(self, part: str) -> str:
        rng = self.rng
        inner = {
            "menu": self.links, "header": lambda: rng.choice([self.links, lambda: f"<h1>{self.text(self.short)}</h1>", lambda: self.paragraphs(1)])(),
            "footer": lambda: rng.choice([f"<p>&copy; {self.sentences()}</p>", f"&copy; {self.text(self.short)} &middot; {self.sentences()}", self.links() + f"<p>{self.sentences()}</p>"]),
            "side": lambda: rng.choice([self.links, lambda: self.paragraphs(3)])(), "notice": lambda: rng.choice([self.sentences(), self.paragraphs(2)]),
            "advert": lambda: rng.choice([self.sentences(), self.paragraphs(2), f'<a href="/x">{self.sentences()}</a>']),
            "form": lambda: f"<label>{self.text(self.short)}</label> <input name=q> " + rng.choice(["", self.paragraphs(1)]) + f"<button>{self.text(self.short)}</button>",
            "comments": self.comments,
        }[part]()
        title = self.titled(part)
        box = self.box(part, title + inner, 0)
        return f"<form data-mark=\"0\">{box}</form>" if part == "form" and not box.startswith("<form") else box

    def comments(self) -> str:
        rng, out = self.rng, []
        kind = rng.choice(["div", "li", "article", "p"])
        name = rng.choice(["", ' class="comment"', ' class="comment-body"', ' class="reply"', ' class="user-comment"'])
        for _ in range(rng.randint(1, 6)):
            said = self.sentences()
            by = rng.choice(["", f"<b>{self.text(self.short)}</b>: ", f'<div class="author">{self.text(self.short)}</div>']) if kind != "p" else ""
            out.append(f"<{kind}{name}>{by}{said if kind == 'p' or rng.random() < 0.5 else f'<p>{said}</p>'}</{kind}>")
        return f"<ol>{''.join(out)}</ol>" if kind == "li" else "".join(out)

    def main(self, blocks: list[str]) -> str:
        rng, out = self.rng, []
        for i, block in enumerate(blocks):
            text = html.escape(self.odd(block), quote=False)
            words = text.split(" ")
            kind = "h1" if i == 0 and rng.random() < 0.7 else rng.choice(["p"] * 12 + ["h2", "blockquote", "ul", "table", "figure", "pre", "div"])
            if kind == "h2":
                text = " ".join(words[:8])
            if len(words) > 6 and rng.random() < 0.2:
                words[3] = f'<a href="/r">{words[3]}</a>' if "&" not in words[3] else words[3]
                text = " ".join(words) if kind == "p" else text
            if kind == "ul":
                text = "".join(f"<li>{' '.join(words[j:j + 12])}</li>" for j in range(0, min(len(words), 60), 12))
            elif kind == "table":
                text = "".join(f"<tr><td>{' '.join(words[j:j + 3])}</td><td>{' '.join(words[j + 3:j + 6])}</td></tr>" for j in range(0, min(len(words), 24), 6))
            elif kind == "figure":
                text = f"<img src=x><figcaption>{' '.join(words[:12])}</figcaption>"
            closing = "" if kind == "p" and rng.random() < 0.1 else f"</{kind}>"
            out.append(f"<{kind}>{text}{closing}")
            if rng.random() < 0.04:
                out.append(self.part(rng.choice(["advert", "side", "notice", "form"])))
        inner = "".join(out)
        for _ in range(rng.choice([0, 0, 0, 1, 2])):
            inner = f"<div>{inner}</div>"
        if rng.random() < 0.12:
            inner += self.part("comments")
        return self.box("main", inner, 1)

    def page(self, blocks: list[str]) -> str:
        rng = self.rng
        above = [p for p in ("notice", "header", "menu", "advert", "form", "side", "menu") if rng.random() < 0.45]
        below = [p for p in ("advert", "comments", "side", "form", "notice", "comments", "footer") if rng.random() < 0.45]
        if rng.random() < 0.1:  # nothing but the text
            above, below = [], []
        rng.shuffle(above)
        rng.shuffle(below)
        body = "".join(map(self.part, above)) + self.main(blocks) + "".join(map(self.part, below))
        if rng.random() < 0.4:
            body = f'<div {rng.choice(["", "id=page", "class=wrapper", "class=container"])}>{body}</div>'
        if rng.random() < 0.03:
            body = f"<form id=aspnet>{body}</form>"
        return f"<html><head><title>{self.text(self.short)}</title></head><body>{body}</body></html>"
