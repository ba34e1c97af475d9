"""Labelled pages for the text extractor: layouts drawn at random, in which every block is known to be article or not."""

from __future__ import annotations

import random
from html import escape

#: Names that sites give to their parts, by what the part is.
NAMES = {
    "wrap": "wrapper page container site layout outer inner grid row root main-wrapper site-container wrap app holder",
    "main": "content main main-content primary content-area site-content page-content col-main body-content center",
    "article": "article post entry story article-body entry-content post-content story-body article-content text hentry single blog-post news-item content-body",
    "title": "title headline entry-title post-title article-title page-title",
    "lead": "lead intro standfirst summary deck subtitle",
    "nav": "nav menu navbar navigation main-nav breadcrumb breadcrumbs topnav submenu tabs pagination pager nav-links toc-nav site-nav mobile-menu skip-links",
    "header": "header site-header masthead top topbar branding logo page-header banner-top head-bar",
    "footer": "footer site-footer bottom colophon foot copyright legal page-footer footer-links credits",
    "aside": "sidebar side aside widget widget-area related recommended secondary right-col rail popular trending most-read more-stories tags tag-cloud author-box about-author teaser promo-box",
    "notice": "notice cookie cookie-banner consent gdpr alert warning popup modal overlay newsletter subscribe paywall message banner disclaimer announcement info-bar",
    "ad": "ad ads advert advertisement sponsor sponsored promo ad-slot google-ad banner-ad adbox commercial dfp",
    "form": "form search search-form login signup subscribe-form contact-form comment-form respond newsletter-form",
    "share": "share social sharing share-buttons social-links follow print-tools toolbar",
    "comments": "comments comment comment-list commentlist responses discussion disqus reader-comments user-comments replies thread comment-body comment-content",
}
NAMES = {k: v.split() for k, v in NAMES.items()}
TAGS = {
    "nav": ["nav", "nav", "div", "ul", "div"], "header": ["header", "header", "div", "table"], "footer": ["footer", "footer", "div"], "aside": ["aside", "aside", "div", "section", "div"],
    "notice": ["div", "div", "section", "aside", "p", "dialog"], "ad": ["div", "div", "aside", "section", "p"], "form": ["form"], "share": ["div", "ul", "p"], "comments": ["section", "div", "div", "ol", "aside"],
}
_SYLLABLES = "an ar be con da de el en er es fa ga he in is ka le li lo ma mi na ne no on or pa que ra re ri ro sa se si so ta te ti to tra u ve vi za ß é ción über tion ing ed".split()
_COMMON = "the of and to in a is that for it on with as was at by le la de et les des un der die und das el que y en".split()
_HAN = "的一是不了人我在有他这为之大来以个中上们到说国和地也子时道出而要于就下得可你年生自会那后能对着事其里所去行过家十用发天如然作方成者多日都三小军二无同么经法当起与好看学进种将还分此心前面又定见只主没公从"


class Writer:
    """One page: its HTML in pieces, and for each block of text whether it belongs to the article."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.html: list[str] = []
        self.truth: list[tuple[str, bool]] = []
        self.han = self.r.random() < 0.06
        self.bare = self.r.choice([0.0, 0.1, 0.1, 0.3, 0.6])  # share of parts without a name
        self.plain = self.r.choice([0.0, 0.0, 0.3, 1.0])  # share of parts without a telling tag
        self.rich = self.r.random() < 0.5
        self.junk = self.r.choice([""] * 12 + [" |", "***", "%"])  # what stands between words of odd texts

    def chance(self, p: float) -> bool:
        return self.r.random() < p

    def words(self, n: int) -> str:
        r = self.r
        if self.han:
            return "".join(r.choices(_HAN, k=max(1, 2 * n)))
        out = [r.choice(_COMMON) if r.random() < 0.4 else "".join(r.choices(_SYLLABLES, k=r.randint(1, 4))) for _ in range(max(1, n))]
        return " ".join(out)

    def sentences(self, n: int) -> str:
        """About ``n`` words of prose."""
        out = []
        while n > 0:
            k = min(n, self.r.choice([1, 3, 6, 9, 12, 20]))
            s = self.words(k)
            if k > 6 and self.chance(0.5) and not self.han:
                s = s.replace(" ", ", ", 1)
            out.append(s[:1].upper() + s[1:] + ("。" if self.han else self.r.choice(["." * 1, ".", ".", ".", "!", "?", "."])))
            n -= k
        text = (" " if not self.han else "").join(out)
        return text.replace(" ", f"{self.junk} ") if self.junk else text

    def attributes(self, role: str, more: str = "") -> str:
        if self.chance(self.bare):
            return more
        names = self.r.sample(NAMES[role], self.r.choice([1, 1, 2]))
        form = self.r.choice(["{}", "{}", "{}-{n}", "js-{}", "{}_box", "{}Block", "c-{}", "x{n} {}"])
        names = [form.format(x, n=self.r.randint(1, 99)) for x in names]
        if self.chance(0.2):
            names = [x.replace("-", "_") for x in names]
        if self.chance(0.3):
            return f' id="{names[0]}"' + (f' class="{names[-1]}"' if len(names) > 1 else "") + more
        return f' class="{" ".join(names)}"' + more

    def open(self, tag: str, role: str | None = None, more: str = "") -> None:
        self.html.append(f"<{tag}{self.attributes(role, more) if role else more}>")

    def close(self, tag: str) -> None:
        self.html.append(f"</{tag}>")

    def block(self, text: str, good: bool, tag: str | None = None, role: str | None = None, ends: bool = True, linked: float = 0.0) -> None:
        """A block of text in ``tag``; ``linked``: share of it within a link."""
        body = escape(text, quote=False)
        if linked >= 1:
            body = f'<a href="/{self.r.randint(1, 999)}">{body}</a>'
        elif (linked > 0 or self.chance(0.15 if good else 0.05)) and " " in body:
            a, _, b = body.partition(" ")
            c, d, e = b.partition(" ")
            body = f'{a} <a href="#">{c}</a>{d}{e}' if self.chance(0.7) else f"{a} <b>{c}</b>{d}{e}"
        if tag:
            self.html.append(f"<{tag}{self.attributes(role) if role else ''}>")
        self.html.append(body)
        if tag and ends:
            self.html.append(f"</{tag}>")
        self.truth.append((" ".join(text.split()), good))

    def part(self, role: str) -> str:
        return "div" if self.chance(self.plain) and role != "form" else self.r.choice(TAGS[role])

    def links(self, n: int, good: bool = False, words: int = 2, role: str | None = None) -> None:
        """A list of links."""
        kind = self.r.choice(["ul", "ul", "div", "p", "span"])
        if kind == "ul":
            self.open("ul", role)
        for _ in range(n):
            self.block(self.words(self.r.randint(1, words)), good, "li" if kind == "ul" else "div" if kind != "p" else "p", linked=self.r.choice([1, 1, 1, 0.1]))
        if kind == "ul":
            self.close("ul")

    def bad(self, role: str) -> None:
        """A part that is no article."""
        r, tag = self.r, self.part(role)
        if tag == "p" or role == "ad" and self.chance(0.5):
            bare, self.bare = self.bare, 0.0 if tag == "p" else self.bare  # a nameless paragraph is told by nothing
            self.block(self.sentences(r.choice([2, 5, 9, 15, 25])), False, "p" if tag == "p" else "div", role, linked=r.choice([0, 0, 1]))
            self.bare = bare
            return
        more = ' role="complementary"' if role == "aside" and self.chance(0.1) else ' style="display:none"' if role == "notice" and self.chance(0.15) else ""
        self.open(tag, role, more)
        if tag == "table":
            self.html.append("<tr><td>")
        for _ in range(r.choice([0, 0, 0, 1, 2]) if not role == "share" else 0):
            self.open("div")
        deep = 0
        while self.html[-1 - deep] == "<div>":
            deep += 1
        if role in ("nav", "share", "header", "footer"):
            if role == "header" and self.chance(0.7):
                self.block(self.words(r.randint(1, 4)), False, r.choice(["h1", "div", "p", "h2", "a"]), linked=r.choice([0, 1]))
            if tag in ("ul", "ol"):
                for _ in range(r.randint(3, 9)):
                    self.block(self.words(r.randint(1, 2)), False, "li", linked=1)
            elif role != "footer" or self.chance(0.6):
                self.links(r.randint(2, 10))
            if role == "header" and self.chance(0.4):
                self.bad("nav")
            if role == "footer":
                self.block(r.choice(["© ", "Copyright ", ""]) + self.words(2) + r.choice([" · ", " | ", " "]) + self.sentences(r.choice([2, 5, 9, 14])), False, r.choice([None, "p", "p", "div", "small"]))
        elif role == "form":
            for _ in range(r.randint(1, 4)):
                self.block(self.words(r.randint(1, 4)), False, r.choice(["div", "p", "legend"]))
                self.html.append('<input type="text" name="q">')
            self.html.append("<button>Send</button><select><option>x</option></select><textarea>y</textarea>")
        elif role == "comments":
            if self.chance(0.8):
                self.block(self.words(r.randint(1, 3)), False, r.choice(["h2", "h3", "h4", "div"]))
            own = "li" if tag == "ol" else r.choice(["div", "div", "article", "p"]) if self.bare < 0.3 and not self.plain else r.choice(["div", "p"])
            for _ in range(r.randint(1, 6)):
                if own == "p":
                    self.block(self.sentences(r.choice([3, 8, 20, 40])), False, "p", "comments" if self.chance(0.3) else None)
                    continue
                self.open(own, "comments" if self.chance(0.7) else None)
                if self.chance(0.7):
                    self.block(self.words(r.randint(1, 4)), False, r.choice(["div", "p", "cite", "span"]))
                    self.html.append("<br>" if self.html[-1].endswith(("</cite>", "</span>")) else "")
                    if self.html[-1] == "<br>":
                        text = self.sentences(r.choice([3, 8, 20]))
                        self.truth[-1] = (f"{self.truth[-1][0]} {text}", False)
                        self.html.append(text)
                for _ in range(r.choice([1, 1, 2])):
                    self.block(self.sentences(r.choice([3, 8, 20, 40, 80])), False, r.choice(["p", "p", "div"]))
                self.close(own)
            if self.chance(0.3):
                self.bad("form")
        else:
            if self.chance(0.6):
                self.block(self.words(r.randint(1, 4)), False, r.choice(["h2", "h3", "h4", "p", "div"]))
            if role == "aside" and self.chance(0.6):
                self.links(r.randint(2, 8), words=9)
            else:
                for _ in range(r.choice([1, 1, 2, 3])):
                    self.block(self.sentences(r.choice([3, 8, 15, 30, 60])), False, r.choice(["p", "p", "div", None]) if tag not in ("ul", "ol") else "li", linked=r.choice([0, 0, 0, 1]))
                    self.html.append("<hr>")
            if role == "notice" and self.chance(0.4):
                self.html.append("<button>OK</button>")
        for _ in range(deep):
            self.close("div")
        if tag == "table":
            self.html.append("</td></tr>")
        self.close(tag)

    def within(self, role: str) -> None:
        """A part amid the article that is none of it: never without a name, as nothing else could tell it."""
        bare, self.bare = self.bare, 0.0
        self.bad(role)
        self.bare = bare

    def prose(self, n: int) -> None:
        """``n`` parts of the article, among them some that don't belong to it."""
        r = self.r
        tag, ends = r.choice([("p", True)] * 6 + [("p", False), ("div", True)])
        size = r.choice([6, 20, 40, 90])
        for k in range(n):
            x = r.random()
            if x < 0.78 or not self.rich:
                words = max(1, int(r.expovariate(1 / size))) if not self.chance(0.18) else r.randint(1, 3)
                if not ends and self.chance(0.3):
                    first, second = self.sentences(words), self.sentences(words)
                    self.html.append(f"<{tag}><b>{escape(first, quote=False)}<br>")
                    self.truth.append((" ".join(first.split()), True))
                    self.block(second, True, tag, ends=ends)
                else:
                    self.block(self.sentences(words), True, tag, ends=ends)
            elif x < 0.84:
                self.block(self.words(r.randint(1, 7)), True, r.choice(["h2", "h3", "h4"]))
            elif x < 0.88:
                self.open(kind := r.choice(["ul", "ol"]))
                for _ in range(r.randint(2, 6)):
                    self.block(self.sentences(r.choice([2, 6, 12])), True, "li")
                self.close(kind)
            elif x < 0.91:
                self.open("blockquote")
                self.block(self.sentences(r.choice([8, 20])), True, r.choice(["p", None]))
                self.close("blockquote")
            elif x < 0.93:
                self.html.append("<figure><img src=x>")
                self.block(self.sentences(r.choice([4, 10])), True, "figcaption")
                self.close("figure")
            elif x < 0.95:
                self.html.append("<table>")
                for _ in range(r.randint(2, 4)):
                    self.html.append("<tr>")
                    for _ in range(r.randint(2, 3)):
                        self.block(self.words(r.randint(1, 3)), True, "td")
                    self.html.append("</tr>")
                self.html.append("</table>")
            elif k:
                if not ends:
                    self.html.append("</p>")
                self.within(r.choice(["ad", "ad", "aside", "share", "form", "notice", "nav"]))

    def page(self) -> Writer:
        r = self.r
        self.html.append("<!DOCTYPE html><html><head><meta charset=utf-8><title>t</title><style>p{}</style></head><body>")
        wraps = r.choice([0, 0, 1, 2])
        whole_form = self.chance(0.04)
        if whole_form:
            self.html.append('<form id="aspnetForm" method="post" action="/">')
        for _ in range(wraps):
            self.open("div", "wrap")
        for role, p in (("notice", 0.25), ("header", 0.6), ("nav", 0.6), ("form", 0.12), ("ad", 0.4), ("notice", 0.1)):
            if self.chance(p):
                self.bad(role)
        before = self.chance(0.25)
        if before:
            self.bad("aside")
        outer = r.choice([None, "main", "div", "section", "table"]) if not self.chance(self.plain) else r.choice([None, "div"])
        if outer == "table":
            self.html.append("<table><tr>")
            if self.chance(0.5):
                self.html.append("<td>")
                self.bad("nav")
                self.html.append("</td>")
            self.html.append("<td>")
        elif outer:
            self.open(outer, "main")
            if self.chance(0.2):
                self.bad(r.choice(["nav", "ad", "share"]))
        inner = r.choice(["article", "article", "div", "section", None] if outer else ["article", "article", "article", "div"])
        inner = "div" if inner and self.chance(self.plain) else inner
        if inner:
            self.open(inner, "article" if self.chance(0.6) else None)
        if self.chance(0.85):
            head = self.chance(0.2)
            if head:
                self.open("header", "title" if self.chance(0.5) else None)
            self.block(self.words(r.randint(2, 12)), True, r.choice(["h1", "h1", "h1", "h2"]), "title" if self.chance(0.3) else None)
            if head:
                self.close("header")
            if self.chance(0.15):
                self.block(self.sentences(r.choice([8, 15])), True, r.choice(["p", "div"]), "lead")
        body = self.chance(0.25)
        if body:
            self.open("div", "article" if self.chance(0.8) else None)
        self.prose(r.choice([1, 2, 3, 6, 10, 20, 40]))
        if body:
            self.close("div")
        for role, p in (("share", 0.2), ("aside", 0.1), ("form", 0.06), ("comments", 0.12)):
            if self.chance(p):
                self.within(role)
        if inner:
            self.close(inner)
        for role, p in (("aside", 0.15), ("comments", 0.3), ("ad", 0.12)):
            if self.chance(p):
                self.bad(role)
        if outer == "table":
            self.html.append("</td></tr></table>")
        elif outer:
            self.close(outer)
        for role, p in (("aside", 0.3), ("comments", 0.1), ("ad", 0.15), ("form", 0.05), ("notice", 0.1), ("nav", 0.15), ("footer", 0.85), ("notice", 0.12)):
            if self.chance(p):
                self.bad(role)
        for _ in range(wraps):
            self.close("div")
        if whole_form:
            self.close("form")
        if self.chance(0.9):
            self.html.append("</body></html>")
        return self


def labelled_page(seed: int) -> tuple[str, list[tuple[str, bool]]]:
    """HTML of a page, and its blocks in page order: text, and whether it is article."""
    w = Writer(seed).page()
    return "".join(w.html), w.truth
