"""Main text of web pages by scoring the tree of their elements."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Elements by what they do to text.
VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
RAW = frozenset("script style textarea title noframes xmp iframe".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s "
    "samp small span strike strong sub sup td th time tt u var".split()
)
FURNITURE = frozenset(
    "aside audio button canvas datalist dialog footer head iframe map menu meter nav noscript "
    "object progress script select style svg template textarea title video".split()
)
ROLES = frozenset(
    "alert alertdialog banner complementary contentinfo dialog menu menubar navigation search "
    "toolbar".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# Words that class and id attributes of pages commonly have for furniture.
BAD_WORDS = frozenset(
    "ad ads adsense advert adverts advertisement advertising alert alerts banner banners breadcrumb "
    "breadcrumbs captcha comment comments commentlist consent cookie cookies disqus "
    "dropdown footer footnav gdpr login masthead menu menus modal nav navbar navigation newsletter "
    "notice notices notification outbrain paging pager pagination paywall popup promo promos "
    "promotion recommended related replies reply respond share sharing sidebar signup "
    "skip social sponsor sponsored sponsors submenu subscribe subscription taboola toolbar topbar "
    "widget widgets".split()
)
GOOD_WORDS = frozenset("article body content entry main page post story text".split())
# Of the bad words, those that only readers' comments bear, and those that paragraphs bear as well.
READERS_WORDS = frozenset("comment commentlist comments disqus replies reply respond".split())
WEAK_WORDS = frozenset("comment recommended related reply respond share sharing skip social".split())
PROSE = frozenset("p pre blockquote".split()) | HEADINGS
# Start tags that end an open element: the element ended, up to which enclosing elements.
ENDED_BY = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "option": (frozenset(["option"]), frozenset(["select", "datalist"])),
}

# A quote opens a value only as its first character, and only if it is closed somewhere; any other
# quote is a character of a name or of an unquoted value, and the next '>' ends the tag.
ONE_ATTRIBUTE = (
    r"(?:=[^\s/>=]*+|[^\s/>=]++)"
    r"(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>]++)?+)?+"
)
MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)"
    rf"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<rest>(?:[\s/]++|{ONE_ATTRIBUTE})*+)(?:>|\Z)"
    r"|<[!?/][^>]*+(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(
    r"(?i)(?<![^\s\"'/])(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>\"']+))?"
)
WORD = re.compile(r"[a-z]+")
QUALIFIED = re.compile(r"\b(?:has|have|with|without|no|is)[-_][a-z]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
HIDDEN_STYLE = re.compile(r"(?i)display\s*:\s*none|visibility\s*:\s*hidden")

SHORT = 25
LEVELS = 5
SIBLING_SHARE = 0.2
LINK_LIST = 0.8
LEAST_LINKS = 3
DOUBT = 0.1
LEAST_DOUBTED = 140
WEAK_LINKS = 0.25
SENTENCE_END = re.compile(r"[.!?\u2026\u3002\u0964\u06d4\u061f\uff01\uff1f][\"')\]\u201d\u2019\u00bb]*\Z")


class Page:
    """The element tree of one page in parallel lists, and its blocks of text in page order."""

    def __init__(self, html: str):
        self.tag = [""]
        self.parent = [-1]
        self.out = [False]
        # Whether an element is in doubt by its name, whether its words alone do not condemn prose, and
        # whether it claims to be the article all the same.
        self.doubted = [False]
        self.weak = [False]
        self.claims = [False]
        self.weight = [0.0]
        self.blocks: list[tuple[int, str, int]] = []
        self.links = [0]
        self._stack = [0]
        self._open: dict[str, int] = {}
        self._parts: list[str] = []
        self._linked: list[str] = []
        self._read(html)

    def _read(self, html: str) -> None:
        at, n = 0, len(html)
        while at < n:
            found = MARKUP.search(html, at)
            if found is None:
                self._text(html[at:])
                break
            if found.start() > at:
                self._text(html[at : found.start()])
            at = found.end()
            name = found["name"]
            if name is None:
                continue
            name = name.lower()
            if found["end"]:
                self._close(name)
                continue
            self._start(name, found["rest"])
            if name in RAW:
                stop = re.compile(f"(?i)</{name}(?=[\\s/>])").search(html, at)
                at = n if stop is None else stop.start()
        self._flush()

    def _text(self, raw: str) -> None:
        if self.out[self._stack[-1]]:
            return
        text = unescape(raw) if "&" in raw else raw
        self._parts.append(text)
        if self._open.get("a"):
            self._linked.append(text)

    def _flush(self) -> None:
        """The inline text so far becomes a block of the innermost block element."""
        if self._parts:
            text = " ".join("".join(self._parts).split())
            if text:
                node = self._stack[-1]
                while self.tag[node] in INLINE:
                    node = self.parent[node]
                linked = len(" ".join("".join(self._linked).split())) if self._linked else 0
                self.blocks.append((node, text, linked))
            self._parts = []
        self._linked = []

    def _start(self, name: str, rest: str) -> None:
        if name == "br":
            self._text(" ")
            return
        inline = name in INLINE
        if not inline:
            if name != "hr" or not self.out[self._stack[-1]]:
                self._flush()
            if self._open.get("p"):
                self._end_within("p", "button td th caption object".split())
        elif name in ("td", "th"):
            self._text(" ")
        if name in ENDED_BY:
            ended, within = ENDED_BY[name]
            for other in ended:
                if self._open.get(other):
                    self._end_within(other, within)
        if name in VOID:
            return
        above = self._stack[-1]
        words: set[str] = set()
        claims = False
        out = self.out[above] or name in FURNITURE or (name == "label" and self._open.get("form"))
        doubted = name == "form"
        if not out and ("=" in rest or "hidden" in rest):
            words, claims, out, form = self._described(rest)
            doubted = doubted or form
        bad = words & BAD_WORDS if name not in ("html", "body", "main") else frozenset()
        if bad:
            doubted = True
            # Inline text cannot be taken out of its block later on.
            out = out or name in INLINE
            out = out or (name not in PROSE and bad & READERS_WORDS and not claims)
        if name == "header" and not out:
            # The header of an article is part of it, that of a page is not.
            out = not self._open.get("article")
        node = len(self.tag)
        self.tag.append(name)
        self.parent.append(above)
        self.out.append(bool(out))
        self.doubted.append(doubted)
        self.weak.append(name in PROSE and bad <= WEAK_WORDS)
        self.claims.append(name == "article" or claims)
        self.weight.append(25.0 if words & GOOD_WORDS else 0.0)
        self.links.append(0)
        if name == "a":
            self.links[above] += 1
        if rest.endswith("/") and name in ("path", "rect", "circle"):
            return
        self._stack.append(node)
        self._open[name] = self._open.get(name, 0) + 1

    def _described(self, rest: str) -> tuple[set[str], bool, bool, bool]:
        """Words of class and id, whether a name among them has good words and no bad ones, whether the
        attributes put the element aside, and whether they make a form of it."""
        words: set[str] = set()
        claims = bad = form = False
        for key, value in ATTRIBUTE.findall(rest):
            key, value = key.lower(), value.strip("\"'")
            if key in ("class", "id"):
                for one in CAMEL.sub("-", value).lower().split():
                    named = set(WORD.findall(QUALIFIED.sub(" ", one)))
                    words |= named
                    claims = claims or bool(named & GOOD_WORDS and not named & BAD_WORDS)
            elif key == "role":
                bad = bad or value.lower() in ROLES
                form = form or value.lower() == "form"
            elif key == "style":
                bad = bad or bool(HIDDEN_STYLE.search(value))
            else:
                bad = bad or key == "hidden" or value.lower() == "true"
        return words, claims, bad, form

    def _pop(self) -> str:
        name = self.tag[self._stack.pop()]
        self._open[name] -= 1
        return name

    def _end_within(self, name: str, limits) -> None:
        """End the innermost open ``name`` unless one of ``limits`` was opened inside it."""
        for depth in range(len(self._stack) - 1, 0, -1):
            tag = self.tag[self._stack[depth]]
            if tag == name:
                self._flush()
                while len(self._stack) > depth:
                    self._pop()
                return
            if tag in limits:
                return

    def _close(self, name: str) -> None:
        if not self._open.get(name):
            if name in ("p", "br"):
                self._text(" ")
            return
        if name in INLINE and name not in ("td", "th"):
            for depth in range(len(self._stack) - 1, 0, -1):
                tag = self.tag[self._stack[depth]]
                if tag == name:
                    break
                if tag not in INLINE:
                    return
            while self._pop() != name:
                pass
            return
        if name in ("td", "th"):
            self._text(" ")
        else:
            self._flush()
        while self._pop() != name:
            pass

    def main_text(self) -> str:
        """Blocks of the best container and of those beside it, joined by an empty line."""
        kept = self._kept_nodes()
        return "\n\n".join(text for node, text, _ in self.blocks if kept[node])

    def _kept_nodes(self) -> list[bool]:
        n = len(self.tag)
        kept = [False] * n
        if not self.blocks:
            return kept
        length, linked, links = [0] * n, [0] * n, list(self.links)
        score = list(self.weight)
        scored = [False] * n
        for node, text, in_links in self.blocks:
            length[node] += len(text)
            linked[node] += in_links
            points = (len(text) >= SHORT) + text.count(",") + min(len(text) / 100, 3.0)
            points *= 1 - in_links / max(1, len(text))
            # A paragraph passes its points on; text straight in a container counts for it. Nothing
            # passes out of an element in doubt.
            holder = node
            if self._is_paragraph(node):
                if self.doubted[node]:
                    continue
                holder = self.parent[node]
            for level in range(LEVELS):
                if holder <= 0 and level:
                    break
                share = 1.0 if level == 0 else 0.5 if level == 1 else 1 / (level * 3)
                score[max(holder, 0)] += points * share
                scored[max(holder, 0)] = True
                if self.doubted[max(holder, 0)]:
                    break
                holder = self.parent[holder] if holder > 0 else -1
        for node in range(n - 1, 0, -1):
            above = self.parent[node]
            links[above] += links[node]
            if not self.doubted[node]:
                length[above] += length[node]
                linked[above] += linked[node]
        density = [linked[i] / length[i] if length[i] else 0.0 for i in range(n)]
        trust = self._trust(length, linked)
        final = [
            score[i] * (1 - density[i]) * trust[i] if scored[i] and not self.out[i] else 0.0
            for i in range(n)
        ]
        best = max(range(n), key=lambda i: (final[i], -i))
        around = {best}
        at = best
        while at > 0:
            at = self.parent[at]
            around.add(at)
        best = self._promoted(best)
        kept[best] = True
        self._keep_siblings(best, final, length, density, kept)
        whole_sentence = self._whole_sentences(density)
        for node in range(1, n):
            above = self.parent[node]
            menu = (
                self.tag[node] in ("ul", "ol", "div", "section", "table")
                and links[node] >= LEAST_LINKS
                and density[node] > LINK_LIST
            )
            inherits = kept[above] and (above != 0 or best == 0)
            aside = self.doubted[node] and node not in around and not whole_sentence[node]
            kept[node] = (kept[node] or inherits) and not (self.out[node] or menu or aside)
        return kept

    def _trust(self, length: list[int], linked: list[int]) -> list[float]:
        """What the score of each element counts for: less with each element in doubt around it, and
        nothing if the innermost of these neither claims to be the article nor holds much text."""
        trust = [1.0] * len(self.tag)
        for node in range(1, len(self.tag)):
            above = trust[self.parent[node]] or DOUBT
            if not self.doubted[node]:
                trust[node] = trust[self.parent[node]]
            elif self.claims[node] or length[node] - linked[node] >= LEAST_DOUBTED:
                trust[node] = above * DOUBT
            else:
                trust[node] = 0.0
        return trust

    def _whole_sentences(self, density: list[float]) -> list[bool]:
        """Prose in doubt by a weak word alone that reads like a part of the article."""
        found = [False] * len(self.tag)
        for node, text, _ in self.blocks:
            if self.doubted[node] and self.weak[node] and density[node] < WEAK_LINKS:
                found[node] = len(text) >= SHORT and bool(SENTENCE_END.search(text))
        return found

    def _is_paragraph(self, node: int) -> bool:
        return self.tag[node] in HEADINGS or self.tag[node] in (
            "p", "pre", "blockquote", "li", "dd", "dt", "td", "figcaption", "tr", "address"
        )

    def _promoted(self, node: int) -> int:
        """The enclosing article, or else the enclosing main element, if there is one."""
        found, at = -1, node
        while at > 0:
            if self.tag[at] == "article":
                return at
            if self.tag[at] == "main":
                found = at
            at = self.parent[at]
        return node if found < 0 else found

    def _keep_siblings(self, best, final, length, density, kept) -> None:
        if best == 0:
            return
        above = self.parent[best]
        least = max(10.0, final[best] * SIBLING_SHARE)
        heading = -1
        for node in range(above + 1, len(self.tag)):
            if self.parent[node] != above or self.out[node] or self.doubted[node] or node == best:
                continue
            if node < best:
                heading = node if self.tag[node] == "h1" else -1
            if final[node] >= least or (
                self.tag[node] == "p" and length[node] > 80 and density[node] < 0.25
            ):
                kept[node] = True
        if heading >= 0:
            kept[heading] = True


def main_text(html: str | None) -> str:
    """The article of a page, blocks joined by an empty line; empty if there is none."""
    return Page(html).main_text() if html else ""


def extract(pages: DataFrame, html: str = "html", text: str = "text") -> DataFrame:
    """All rows and columns of ``pages`` with the main text in column ``text`` (replaced if there).

    Menus, headers, footers, asides, scripts, styles, hidden elements and lists of reader comments are
    put aside. Each block of the rest gives points for its length and commas, less its share of
    links, to the elements around it; the best element (or the article around it) is kept with
    siblings that score near it. Forms, and elements that class or id names as furniture, are in
    doubt: no points pass out of them, scores inside count for a tenth, and they go unless the best
    element lies in them. A paragraph in doubt by a weak word only stays if it is a sentence of the
    article. Null and empty html give an empty text; ties go to the outer, earlier element; repeated
    rows give the same; an empty table gives no rows. Work is linear in the page.
    """

    def texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([main_text(h) for h in batch], dtype=object)

    return pages.withColumn(text, F.pandas_udf(texts, "string")(F.col(html)))
