"""Labelled pages for the training of main-text extraction.

The texts of a bounded sample of real pages are set into page layouts of many kinds, with menus,
headers, notices, adverts, sidebars, forms, comments and footers around and inside the article. What
is the article is known, as it is put there; its elements are marked with ``data-gold``, which no
feature sees. In some pages names are left out or say nothing, so that tags and texts must tell.
"""

from __future__ import annotations

import random
from collections.abc import Callable

# Names that pages give to their parts, and phrases that stand there.
NAMES = {
    "article": "content main main-content post post-content post-body entry entry-content article article-body article-content story story-body text body page-content single prose markdown rich-text mw-parser-output blog-post news-item article__body".split(),
    "menu": "menu nav navbar navigation top-nav main-menu site-navigation breadcrumb breadcrumbs topbar menu-bar nav-links pagination toc mobile-menu skip-links".split(),
    "header": "header site-header page-header masthead top banner-top branding logo-bar".split(),
    "notice": "notice cookie cookie-banner cookie-notice consent gdpr alert message info-box warning popup modal overlay newsletter newsletter-signup paywall announcement flash toast disclaimer".split(),
    "advert": "ad ads advert adverts advertisement ad-slot ad-container adsbygoogle banner-ad sponsored sponsor promo promotion promoted commercial adbox dfp".split(),
    "sidebar": "sidebar side side-bar rail right-rail left-col widget widgets related related-posts recommended popular trending more-stories tags teaser aside read-more most-read see-also".split(),
    "form": "form search search-form contact-form login signup subscribe subscribe-form poll feedback registration".split(),
    "comments": "comments comment comment-list reader-comments user-comments disqus responses replies discussion respond comment-thread comments-area feedback-list".split(),
    "footer": "footer site-footer page-footer bottom colophon copyright legal foot credits sitemap".split(),
    "share": "share sharing social social-links share-buttons follow".split(),
}
PHRASES = {
    "menu": ["Home", "About", "Contact", "News", "Products", "Blog", "Login", "Sitemap", "Next", "Previous", "Start", "Inicio", "Accueil", "Kontakt"],
    "notice": ["We use cookies to improve your experience. Accept all", "This site uses cookies.", "Please enable JavaScript.", "Subscribe to read on.", "You have 2 free articles left this month.", "Wir verwenden Cookies.", "Este sitio utiliza cookies.", "Ce site utilise des cookies."],
    "advert": ["Advertisement", "Sponsored", "Buy now and save 50 %!", "Click here for our best offers", "Anzeige", "Publicidad", "Publicité", "Limited offer, order today"],
    "form": ["Search", "Your name", "E-mail", "Send", "Sign up", "Password", "Submit", "Leave a reply"],
    "comments": ["Comments", "3 comments", "Leave a comment", "Reply", "Log in to reply", "Great post, thanks!", "Kommentare", "Comentarios", "Commentaires"],
    "footer": ["All rights reserved.", "Terms of use", "Privacy policy", "Imprint", "Contact us", "Alle Rechte vorbehalten."],
    "share": ["Share", "Tweet", "Follow us", "Print", "E-mail this"],
    "sidebar": ["Related articles", "Most read", "Tags", "Archive", "You may also like", "Popular posts"],
}


class Writer:
    """One page; ``kind`` of names: full, plain (semantic tags only), or mute (names that say nothing)."""

    def __init__(self, rng: random.Random, paragraphs: list[str], shorts: list[str]):
        self.rng, self.paragraphs, self.shorts = rng, paragraphs, shorts
        self.names = rng.choices(("full", "plain", "mute"), (6, 2, 2))[0]
        self.tags = self.names == "plain" or rng.random() < 0.5  # semantic tags

    def paragraph(self) -> str:
        return self.rng.choice(self.paragraphs)

    def short(self, part: str = "menu", own: float = 0.5) -> str:
        return self.rng.choice(PHRASES[part]) if self.rng.random() < own else self.rng.choice(self.shorts)

    def named(self, part: str) -> str:
        rng = self.rng
        if self.names == "plain":
            return ""
        if self.names == "mute":
            return rng.choice(("", f' class="css-{rng.randrange(1 << 20):x}"', f' id="b{rng.randrange(99)}"'))
        name = rng.choice(NAMES[part])
        if rng.random() < 0.3:
            name = rng.choice((name.replace("-", "_"), f"{name} col-{rng.randrange(12)}", f"x-{name}", name.title().replace("-", ""), f"{name}-wrapper", f"{name}-inner"))
        return f' {rng.choice(("class", "class", "id"))}="{name}"'

    def element(self, part: str, inner: str, tag: str = "div") -> str:
        if part == "advert" and self.names != "full":
            inner = f"<p>{self.rng.choice(PHRASES['advert'])}</p>{inner}" if self.rng.random() < 0.5 else f"<p>{self.rng.choice(PHRASES['advert'])}</p>"
        tag = tag if self.tags or tag == "form" else self.rng.choice(("div", "div", "section"))
        return f"<{tag}{self.named(part)}>{inner}</{tag}>"

    def links(self, part: str, n: int) -> str:
        rng = self.rng
        items = [f'<a href="/{i}">{self.short(part)}</a>' for i in range(n)]
        style = rng.randrange(4)
        if style == 0:
            return " | ".join(items)
        if style == 1:
            return "".join(f"<div>{i}</div>" for i in items)
        return "<ul>" + "".join(f"<li>{i}</li>" if rng.random() < 0.9 else f"<li>{i}" for i in items) + "</ul>"

    def menu(self) -> str:
        return self.element("menu", self.links("menu", self.rng.randrange(2, 10)), "nav")

    def header(self) -> str:
        rng = self.rng
        title = rng.choice((f"<h1>{self.short()}</h1>", f"<div{self.named('header')}>{self.short()}</div>", f'<a href="/">{self.short()}</a>'))
        return self.element("header", title + (f"<p>{self.short() if rng.random() < 0.5 else self.paragraph()}</p>" if rng.random() < 0.5 else "") + (self.menu() if rng.random() < 0.5 else ""), "header")

    def notice(self) -> str:
        text = self.short("notice", 1) if self.names == "mute" or self.rng.random() < 0.4 else self.paragraph()
        return self.element("notice", self.rng.choice((text, f"<p>{text}</p>", f"<p>{text}</p><button>OK</button>")), self.rng.choice(("div", "aside", "dialog")))

    def advert(self) -> str:
        text = self.short("advert", 1) if self.rng.random() < 0.3 else self.paragraph()
        return self.element("advert", self.rng.choice((text, f"<p>{text}</p>", f'<a href="http://x">{text}</a>')), self.rng.choice(("div", "aside")))

    def share(self) -> str:
        return self.element("share", self.links("share", self.rng.randrange(2, 5)))

    def sidebar(self) -> str:
        rng = self.rng
        body = self.links("sidebar", rng.randrange(2, 7)) if self.names == "mute" or rng.random() < 0.6 else "".join(f"<p>{self.paragraph()}</p>" for _ in range(rng.randrange(1, 4)))
        return self.element("sidebar", (f"<h3>{self.short('sidebar')}</h3>" if rng.random() < 0.6 else "") + body, "aside")

    def form(self) -> str:
        fields = [f"<label>{self.short('form')}</label><input type=text name=q>", f"<p>{self.short('form')}</p>", f"<button>{self.short('form')}</button>", "<textarea>x y</textarea>", f"<select><option>{self.short()}</option><option>{self.short()}</select>"]
        text = f"<p>{self.paragraph()}</p>" if self.rng.random() < 0.3 else ""
        return self.element("form", text + "".join(self.rng.sample(fields, self.rng.randrange(2, 5))), "form")

    def comments(self) -> str:
        rng = self.rng
        tag = rng.choice(("div", "li", "article", "section")) if self.names == "full" else "div"
        body = ""
        for _ in range(rng.randrange(1, 5)):
            who = rng.choice((f"<span>{self.short()}</span>", f"<h4>{self.short()}</h4>", f"<b>{self.short()}</b>", ""))
            said = self.paragraph() if self.names == "full" else self.short("comments", 1)
            body += f"<{tag}{self.named('comments') if self.names == 'full' and rng.random() < 0.7 else ''}>{who}<p>{said}</p>" + (f'<a href="#r">{self.short("comments")}</a>' if rng.random() < 0.4 else "") + f"</{tag}>"
        if self.names != "full":
            body = f"<h3>{rng.choice(PHRASES['comments'][:3])}</h3>{body}"
            return f"<div>{body}</div>"
        return self.element("comments", (f"<h3>{self.short('comments')}</h3>" if rng.random() < 0.7 else "") + body, "section")

    def footer(self) -> str:
        rng = self.rng
        parts = [f"&copy; {rng.randrange(1990, 2030)} {self.short()}", f"<p>{self.short('footer')}</p>", f"&copy; {self.short()} &middot; {self.paragraph()}", self.links("footer", rng.randrange(2, 6))]
        if self.names != "mute":
            parts.append(f"<p>{self.paragraph()}</p>")
        return self.element("footer", "".join(rng.sample(parts, rng.randrange(1, 4))), "footer")

    def inline(self, text: str) -> str:
        rng = self.rng
        words = text.split(" ")
        if len(words) > 3 and rng.random() < 0.4:
            a = rng.randrange(len(words) - 2)
            b = min(len(words), a + rng.randrange(1, 6))
            tag = rng.choice(("b", "i", "em", "strong", "span", "code", "a"))
            words[a] = f'<{tag} href="/x">' + words[a] if tag == "a" else f"<{tag}>{words[a]}"
            words[b - 1] += f"</{tag}>"
        return " ".join(words)

    def content(self) -> list[str]:
        """Elements of an article, each marked."""
        rng = self.rng
        text = lambda: self.inline(self.paragraph() if rng.random() < 0.8 else self.short(own=0))
        level = rng.choice((1, 1, 1, 2))
        out = [f"<h{level} data-gold>{self.short(own=0) if rng.random() < 0.4 else self.paragraph()[:80]}</h{level}>"] if rng.random() < 0.85 else []
        for _ in range(rng.choice((1, 2, 3, 5, 8, 12, 20))):
            kind = rng.choices(("p", "open", "bold", "h2", "list", "quote", "pre", "table", "figure", "lines", "div"), (60, 5, 6, 6, 4, 3, 2, 2, 2, 3, 5))[0]
            if kind == "p":
                out.append(f"<p data-gold>{text()}</p>")
            elif kind == "open":
                out.append(f"<p data-gold>{text()}")
            elif kind == "bold":
                out.append(f"<p data-gold><b>{text()}<br>")
            elif kind == "h2":
                out.append(f"<h2 data-gold>{self.short(own=0)}</h2>")
            elif kind == "list":
                out.append("<ul data-gold>" + "".join(f"<li>{text()}</li>" for _ in range(rng.randrange(2, 6))) + "</ul>")
            elif kind == "quote":
                out.append(f"<blockquote data-gold><p>{text()}</p></blockquote>")
            elif kind == "pre":
                out.append(f"<pre data-gold>{self.paragraph()}</pre>")
            elif kind == "table":
                out.append("<table data-gold>" + "".join(f"<tr><td>{self.short(own=0)}</td><td>{self.short(own=0)}</td></tr>" for _ in range(rng.randrange(1, 4))) + "</table>")
            elif kind == "figure":
                out.append(f'<figure data-gold><img src="x.png"><figcaption>{text()}</figcaption></figure>')
            elif kind == "lines":
                out.append(f"<div data-gold>{text()}<br><br>{text()}</div>")
            else:
                out.append(f"<div data-gold>{text()}</div>")
        return out

    def article(self) -> str:
        rng = self.rng
        body = self.content()
        between = [self.advert, self.share, self.sidebar, self.form, self.notice, self.menu]
        for _ in range(rng.choices((0, 1, 2), (5, 4, 2))[0]):
            body.insert(rng.randrange(len(body) + 1), "</p>" + rng.choice(between)())
        if rng.random() < 0.15:
            body.append("</p>" + self.comments())
        inner = "".join(body)
        if self.names == "full" and rng.random() < 0.5 or self.names == "mute":
            inner = f"<div{self.named('article')}>{inner}</div>"
        tag = rng.choice(("article", "article", "main", "main", "section")) if self.tags else rng.choice(("div", "div", "td"))
        if tag == "td":
            return f"<table><tr><td{self.named('article')}>{inner}</td></tr></table>"
        return f"<{tag}{self.named('article')}>{inner}</{tag}>"

    def page(self) -> str:
        rng = self.rng
        maybe: Callable[[float, Callable[[], str]], list[str]] = lambda share, make: [make()] if rng.random() < share else []
        top = maybe(0.6, self.header) + maybe(0.7, self.menu) + maybe(0.3, self.notice) + maybe(0.4, self.advert) + maybe(0.15, self.form)
        rng.shuffle(top)
        beside = maybe(0.4, self.sidebar) + maybe(0.1, self.advert)
        left = rng.random() < 0.4
        middle = (beside if left else []) + [self.article()] + ([] if left else beside)
        below = maybe(0.3, self.comments) + maybe(0.2, self.sidebar) + maybe(0.2, self.advert) + maybe(0.15, self.form) + maybe(0.1, self.share)
        rng.shuffle(below)
        body = "".join(middle)
        if rng.random() < 0.5:
            body = f'<div class="{rng.choice(("container", "wrapper", "row", "page", "layout", "grid"))}">{body}</div>'
        body = "".join(top) + body + "".join(below + maybe(0.85, self.footer))
        if rng.random() < 0.3:
            body = f'<div id="{rng.choice(("page", "wrap", "container", "root", "app"))}">{body}</div>'
        return f'<!DOCTYPE html><html><head><title>{self.short()}</title><style>p{{margin:0}}</style></head><body><script>var a="<p>";</script>{body}</body></html>'


def labelled_pages(paragraphs: list[str], shorts: list[str], n: int, seed: int = 13) -> list[str]:
    """``n`` pages whose article is marked, of the texts given (HTML-escaped; a few words stand in for none)."""
    rng = random.Random(seed)
    paragraphs, shorts = paragraphs or ["A sentence of a few words, as many texts have one."], shorts or ["A few words"]
    return [Writer(rng, paragraphs, shorts).page() for _ in range(n)]
