import random
import time

import pytest

from panelcast.llm.html import BAD_WORDS, READERS_WORDS, extract, main_text

PARA = "A sentence that is long enough, with commas, to count as part of an article."

CASES = [
    ("", ""),
    ("just text,  no\n tags", "just text, no tags"),
    ("<nav><a href=x>Home</a></nav><footer>2020</footer>", ""),
    (f"<article><h1>T &amp; U</h1><p>{PARA}<p><b>Un<br>closed</article>", f"T & U\n\n{PARA}\n\nUn closed"),
    (f"<p>{PARA}</p><script>var t='</p><p>no';</script><style>p{{}}</style>", PARA),
    (f"<article><p>{PARA}</p><!-- <p>no</p> --><p>x&nbsp;&#233;&lt;b&gt;</p><p", f"{PARA}\n\nx é<b>"),
    (
        f"<header>Site</header><main><h2>A</h2><p>{PARA}</p><aside>no</aside>"
        f"<div class='cookie-notice'>no</div><form>no</form></main>",
        f"A\n\n{PARA}",
    ),
    (
        f"<body class='has-sidebar'><div id=sidebar><p>{PARA}</p></div><div class=content><h1>T</h1>"
        f"<p>{PARA}</p><ul><li>one<li>two</ul><div class='share-buttons'>no</div></div>"
        f"<section id='comments'><p>{PARA}</p></section></body>",
        f"T\n\n{PARA}\n\none\n\ntwo",
    ),
    (
        f"<div><p>{PARA}</p><ul><li><a href=1>a</a><li><a href=2>b</a><li><a href=3>c</a></ul></div>",
        PARA,
    ),
    (f"<div hidden><p>{PARA}</p></div><div><p>{PARA}</p></div><p style='display: none'>x</p>", PARA),
    (f"<article><header><h1>T</h1></header><p title='a > b'>{PARA}</p></article>", f"T\n\n{PARA}"),
]


@pytest.mark.parametrize("html, text", CASES)
def test_cases(html, text):
    assert main_text(html) == text


DOUBTED = [
    (f"<article class='related-article post'><p>{PARA}</p></article>", PARA),
    (f"<div class='main ads-enabled'><p>{PARA}</p></div>", PARA),
    (f"<form id=aspnetForm><div><h1>T</h1><p>{PARA}</p><p>{PARA}</p></div></form>", f"T\n\n{PARA}\n\n{PARA}"),
    (f"<form><div class='main ads-enabled'><p>{PARA}</p></div><input></form>", PARA),
    (
        f"<article><p>{PARA}</p><p class=comment>{PARA}</p><p class=share-price>The share price fell by "
        f"3 percent.</p><p class=share>Share</p><p class='related'><a href=1>{PARA}</a></p></article>",
        f"{PARA}\n\n{PARA}\n\nThe share price fell by 3 percent.",
    ),
    (
        f"<article class='related-article post'><p>{PARA}</p></article><p>Copyright 2020, X.</p>"
        f"<div class=cookie-notice><p>{PARA}</p></div>",
        PARA,
    ),
    # Furniture alone is no article, and an article in no doubt goes before much else.
    ("<div class=cookie-notice>We use cookies, as all do.</div>", ""),
    ("<div class=page-footer><p>Copyright 2020, all rights reserved by X.</p></div>", ""),
    ("<form><p>Please enter your name, and press the button.</p><label>Name<input></label></form>", ""),
    (
        f"<div><p>{PARA}</p><p class=notice>{PARA}</p></div><div class=sidebar>{f'<p>{PARA}</p>' * 5}</div>"
        f"<div id=comments>{f'<p>{PARA}</p>' * 50}</div><form><p>{PARA}</p><p>{PARA}</p></form>",
        PARA,
    ),
]


@pytest.mark.parametrize("html, text", DOUBTED)
def test_elements_in_doubt(html, text):
    assert main_text(html) == text


def grown(rng, depth=0):
    """A random tree of ``(tag, class, children)`` with paragraphs as leaves."""
    names = ["", "", "", "content", "sidebar", "widget", "post related", "promo", "main-menu"]
    if depth == 4 or rng.random() < 0.45:
        words = rng.choice(["Short", "Some words, in a row, and more", PARA, f"{PARA} {PARA} {PARA}"])
        if rng.random() < 0.2:
            return ("link", "", words)
        return ("p", rng.choice(["", "", "", "share", "notice"]), words)
    tag = rng.choice(["div", "div", "div", "section", "form"])
    return (tag, rng.choice(names), [grown(rng, depth + 1) for _ in range(rng.randint(1, 4))])


def written(node):
    tag, name, inside = node
    if tag == "link":
        return f"<p><a href=x>{inside}</a></p>"
    body = inside if isinstance(inside, str) else "".join(map(written, inside))
    return f"<{tag} class='{name}'>{body}</{tag}>"


def plainly(root):
    """The kept text by the definition: every element sums over all paragraphs below it anew."""
    good = {"content", "post", "main"}

    def doubted(node):
        return node[0] == "form" or bool(set(node[1].replace("-", " ").split()) & BAD_WORDS)

    def paragraphs(node, levels=0, free=True):
        """(levels up to the node, whether its points reach it, paragraph) below a node."""
        if isinstance(node[2], str):
            yield levels, free and not doubted(node), node
        else:
            for child in node[2]:
                crossing = not isinstance(child[2], str) and doubted(child)
                yield from paragraphs(child, levels + 1, free and not crossing)

    def sums(node):
        """Characters and linked ones, without elements in doubt inside."""
        found = [p for _, free, p in paragraphs(node) if free]
        return sum(len(p[2]) for p in found), sum(len(p[2]) for p in found if p[0] == "link")

    def final(node, trust):
        score = 25.0 if set(node[1].replace("-", " ").split()) & good else 0.0
        reached = False
        for levels, free, p in paragraphs(node):
            if free and 1 <= levels <= 5:
                share = 1.0 if levels == 1 else 0.5 if levels == 2 else 1 / (3 * (levels - 1))
                points = (len(p[2]) >= 25) + p[2].count(",") + min(len(p[2]) / 100, 3)
                score += share * (0 if p[0] == "link" else points)
                reached = True
        length, linked = sums(node)
        return score * (1 - (linked / length if length else 0)) * trust if reached else 0.0

    def trusts(node, trust, path, found):
        if isinstance(node[2], str):
            return
        if doubted(node):
            length, linked = sums(node)
            claims = any(set(c.split("-")) & good and not set(c.split("-")) & BAD_WORDS for c in node[1].split())
            trust = (trust or 0.1) * 0.1 if claims or length - linked >= 140 else 0.0
        found.append((final(node, trust), path + [node]))
        for child in node[2]:
            trusts(child, trust, path + [node], found)

    candidates = []
    trusts(root, 1.0, [], candidates)
    best = max(value for value, _ in candidates)
    path = next(path for value, path in candidates if value == best)

    def n_links(node):
        return sum(p[0] == "link" for _, _, p in paragraphs(node))

    def kept(node, out):
        if doubted(node) and not any(node is other for other in path):
            weak = node[0] == "p" and node[1] == "share" and len(node[2]) >= 25 and node[2][-1] == "."
            if not weak:
                return
        if isinstance(node[2], str):
            out.append(node[2])
            return
        length, linked = sums(node)
        menu = node[0] in ("div", "section") and n_links(node) >= 3
        if menu and length and linked / length > 0.8:
            return
        for child in node[2]:
            kept(child, out)

    chosen = []
    if len(path) == 1:
        kept(path[-1], chosen)
        return "\n\n".join(chosen)
    least = max(10.0, best * 0.2)
    for node in path[-2][2]:
        if node is path[-1]:
            kept(node, chosen)
        elif not doubted(node):
            if isinstance(node[2], str):
                if node[0] == "p" and len(node[2]) > 80:
                    chosen.append(node[2])
            elif next(v for v, p in candidates if p[-1] is node) >= least:
                kept(node, chosen)
    return "\n\n".join(chosen)


def test_scores_as_the_definition_says():
    assert not READERS_WORDS & {"sidebar", "widget", "related", "promo", "menu", "share", "notice"}
    rng = random.Random(7)
    filled = 0
    for _ in range(1500):
        inside = [grown(rng) for _ in range(rng.randint(1, 4))]
        page = written(("body", "", inside))
        text = plainly(("body", "", inside))
        assert main_text(page) == text, page
        filled += bool(text)
    assert filled > 1000


STRAY_QUOTES = [
    (
        '<p><a href="/x"">link</a> First text.</p><p class="y">Second text.</p><p class="z">Third.</p>',
        "link First text.\n\nSecond text.\n\nThird.",
    ),
    ("<p title=it's>Body text, don't stop.</p>", "Body text, don't stop."),
    ('<p "x>One.</p><p title="a > b">Two.</p>', "One.\n\nTwo."),
    ('<p data-q=a="b>One.</p><p title = \'a > "b\'>Two.</p>', "One.\n\nTwo."),
    ('<p title=">One, never closed.</p>', "One, never closed."),
    ("<p ='x>One.</p ' ><p title=>Don't.</p>", "One.\n\nDon't."),
]


@pytest.mark.parametrize("html, text", STRAY_QUOTES)
def test_stray_quotes_swallow_no_text(html, text):
    assert main_text(f"<article>{html}</article>") == text


@pytest.mark.parametrize("part", ["<a =\"", "<a x='", "= ", "<a x = ", "<p x=\"' "])
def test_hostile_attributes_take_linear_time(part):
    start = time.process_time()
    main_text("<p " + part * 40_000)
    assert time.process_time() - start < 10


@pytest.mark.parametrize(
    "html",
    [
        "<div>" * 60_000 + "x",
        "<b>" * 60_000 + "x</i>" * 20_000,
        "<" * 200_000,
        "<p " * 60_000,
        "</x>" * 60_000,
        '<a "' * 40_000,
        "<p><b>" * 20_000 + "y",
    ],
)
def test_hostile_pages_take_linear_time(html):
    start = time.process_time()
    main_text(html)
    assert time.process_time() - start < 10


def test_edges(spark):
    rows = [(i, h, "old", 1) for i, (h, _) in enumerate(CASES + CASES)] + [(None, None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, html string, text string, out int")
    done = extract(pages)
    assert done.columns == pages.columns
    found = sorted((r["html"] or "", r["text"]) for r in done.collect())
    assert found == sorted([*CASES, *CASES, ("", "")])
    assert extract(pages.limit(0)).count() == 0
