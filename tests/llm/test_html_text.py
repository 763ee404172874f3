"""Main text of pages."""

from __future__ import annotations

import math
import random
import time

import pytest

from barloom.llm import html_text as H
from barloom.llm.html_text import main_text

ARTICLE = "<article><h1>A title</h1><p>First &amp; long enough paragraph, with <b>bold</b> words&nbsp;in it.<br>Next line.</p><p>Sh is.</p><ul><li>one</li><li>two</li></ul></article>"
TEXT = "A title First & long enough paragraph, with bold words in it. Next line. Sh is. one two"


@pytest.mark.parametrize(
    "page",
    [
        ARTICLE,
        f"<html><head><title>T</title><style>p{{}}</style><script>var t='<p>x</p>';</script></head><body><nav><ul><li><a>Menu</a></ul></nav>{ARTICLE}<footer>(c)</footer></body></html>",
        f"<body><header>Site</header><div class='cookie-notice'>We use cookies on this site, please agree to them all.</div>{ARTICLE}<aside>More to read here</aside>",
        f"<body><div id=top_menu>Home</div><div class='ad'>Buy this now, it is very cheap and good for you, really.{ARTICLE}</div>",
        f"<body>{ARTICLE}<section class=comments><article class=comment><p>Nice text, I liked it very much indeed, thank you.</p></article></section></body>",
        f"<main>{ARTICLE}<form><label>Mail</label><input name=q><button>Go</button></form></main>",
        ARTICLE.replace("article", "div"),
        f"<body><div class=sidebarLeft>Links and more</div><div class=content>{ARTICLE[9:-10]}</div><div role=contentinfo>Imprint</div></body>",
        ARTICLE.replace("</p>", ""),
        ARTICLE + "<footer>cut o",
        f"<body><div hidden>Not seen</div><div style='display: none'>Nor this</div>{ARTICLE}",
        ARTICLE.replace("<p>Sh", "<!-- a comment --><p><span class=ad>Advert</span>Sh"),
    ],
)
def test_article_without_its_surroundings(page):
    assert H.main_text(page) == TEXT


@pytest.mark.parametrize("page", [None, "", " \n", "<nav>Menu</nav>", "<script>x</script>", "<html><body></body></html>"])
def test_pages_without_text(page):
    assert H.main_text(page) == ""


LONG, SHORT = " ".join(["Many words of one long paragraph."] * 24), " ".join(["And some few more of another."] * 4)


@pytest.mark.parametrize("n", [1, 12])
@pytest.mark.parametrize(
    "page",
    [
        "<body><div id=content><div>{a}</div><div>{b}</div></div></body>",
        "<body><div id=content><div>{b}</div><div>{a}</div></div></body>",
        "<body><div><section>{a}</section><section>{b}</section></div></body>",
        "<body><section>{a}</section><section>{b}</section></body>",
        "<table><tr><td>{a}</td><td>{b}</td></tr></table>",
        "<body><table><tbody><tr><td>{a}</td></tr><tr><td>{b}</td></tr></tbody></table></body>",
        "<body><nav><a href=/>Home</a></nav><div><center>{a}</center><div>{b}</div></div><footer>(c)</footer></body>",
        "<body><ul><li><a href=/>Home</a></li><li><a href=/b>About</a></li></ul><div><div>{a}</div><div>{b}</div></div></body>",
    ],
)
def test_uneven_blocks_without_article(page, n):
    a, b = f"<p>{LONG}</p>" * n, f"<p>{SHORT}</p>"
    text = [LONG] * n + [SHORT]
    if page.index("{b}") < page.index("{a}"):
        text = [SHORT] + [LONG] * n
    assert H.main_text(page.format(a=a, b=b)) == " ".join(text)


@pytest.mark.parametrize("name", ["content with-sidebar", "no-sidebar", "page header-fixed", "container related-on", "post comments-open", "hasSidebar", "notice"])
def test_wrappers_whose_names_have_boilerplate_words(name):
    text = f"{LONG} {SHORT}"
    blocks = f"<h2>A title</h2><p>{LONG}</p><p>{SHORT}</p>"
    for kind in ("class", "id"):
        for page in (
            "<body><div {k}='{n}'>{b}</div></body>",
            "<body><header>Site</header><div {k}='{n}'><div {k}='{n}'>{b}</div><div class=sidebar>Links and more</div></div><footer>(c)</footer></body>",
            "<body><ul class=menu><li><a href=/>Home</a></ul><div {k}='{n}'>{b}<div class=comments><p>Nice text, I liked it.</p></div></div></body>",
        ):
            assert H.main_text(page.format(k=kind, n=name, b=blocks)) == f"A title {text}"


@pytest.mark.parametrize("name", ["with-sidebar", "row no-header"])
def test_several_wrappers_with_modifiers(name):
    rows = "".join(f"<div class='{name}'><p>{LONG}</p></div>" for _ in range(3))
    assert H.main_text(f"<body>{rows}</body>") == " ".join([LONG] * 3)


@pytest.mark.parametrize("name", ["sidebar", "cookie-notice", "comment-list", "related", "site-header"])
def test_names_of_containers_that_hold_less_text(name):
    other = f"<div class='{name}'><p>{SHORT}</p></div>"
    assert H.main_text(f"<body><div>{ARTICLE[9:-10]}<p>{LONG}</p></div>{other}</body>") == f"{TEXT} {LONG}"
    longer = f"<div class='{name}'><p>{LONG}</p><p>{LONG}</p></div>"
    assert H.main_text(f"<body>{ARTICLE}{longer}</body>") == TEXT


def test_comments_longer_than_the_text():
    assert H.main_text(f"<body><div><p>{SHORT}</p></div><div class='comments-area'><p>{LONG}</p><p>{LONG}</p></div></body>") == SHORT


def test_other_forms():
    assert H.main_text("just  plain\n text &lt;3") == "just plain text <3"
    assert H.main_text("<p>a<p>b") == "a b"
    long = "<article>" + "".join(f"<p>Paragraph {i} has some words.</p>" for i in range(5000)) + "</article>"
    assert len(H.main_text(long).split("Paragraph")) == 5001
    assert H.main_text("<div>" * 3000 + "deep" + "</div>" * 3000) == "deep"


def test_frame(spark):
    rows = [(1, "u", ARTICLE), (1, "u", ARTICLE), (2, None, None), (None, "v", "<p>x")]
    df = spark.createDataFrame([(*r, "extra", 4) for r in rows], "page_id bigint, url string, html string, text string, n_chars int")
    got = sorted((tuple(r) for r in H.extract(df).collect()), key=str)
    assert got == sorted([(1, "u", TEXT, len(TEXT))] * 2 + [(2, None, "", 0), (None, "v", "x", 1)], key=str)
    assert H.extract(df.limit(0)).collect() == []


@pytest.mark.parametrize(
    "opened",
    ["<p>", "<div>", "<li>", "<section><p>", "<b>", "<tr><td>"],
)
def test_pages_of_elements_that_never_end_take_time_by_their_length(opened):
    pieces = [f"some words of part {i}" for i in range(20_000)]
    start = time.monotonic()
    text = main_text("<body>" + "".join(opened + p + " " for p in pieces) + "</i></u>" * 20_000)
    assert time.monotonic() - start < 20
    assert text == " ".join(pieces)


def test_elements_without_end_tags_end_where_the_next_begins():
    page = "<main><p class=ad>Buy this now, it is cheap today<p>{0}<p>{1}<ul><li class=share>Tell your friends<li>{2}</ul></main>"
    parts = [" ".join(f"w{n}{i}" for i in range(30)) for n in "abc"]
    assert main_text(page.format(*parts)) == " ".join(parts)


def _generated(rng):
    """A random page of closed elements, and its lines: text, tags, containers from the outermost in."""
    html, lines, names, seen = [], [], [], [0]

    def element(name, path, fill):
        number = len(names)
        names.append(name)
        seen[0] += 1
        html.append(f"<{name}>")
        fill([*path, number])
        html.append(f"</{name}>")
        seen[0] += 1

    def leaf(path):
        words = [f"w{rng.randrange(999)}" for _ in range(rng.choice([1, 2, 5, 40, 90]))]
        bold = rng.random() < 0.3
        html.append(f"<b>{words[0]}</b> " + " ".join(words[1:]) if bold else " ".join(words))
        names.extend(["b"] * bold)
        lines.append((" ".join(words), seen[0] + 2 * bold + 1, path))
        seen[0] = -1  # its end tag is counted with the line

    def inner(depth):
        def fill(path):
            for _ in range(rng.randrange(1, 5)):
                if depth == 0 or rng.random() < 0.4:
                    element("p", path, leaf)
                else:
                    element(rng.choice(["div", "section", "blockquote", "article"]), path, inner(depth - 1))

        return fill

    element("div", [], inner(4))
    return "".join(html), lines, names


def _plain_main_text(lines, names):
    """Ratio, smoothing, threshold and region by their definitions, over lists of containers."""
    ratios = [len(text) / max(1, tags) for text, tags, _ in lines]
    reach = min(len(lines) - 1, 5)
    smooth = []
    for i in range(len(lines)):
        near = [(math.exp(-0.5 * ((i - j) / 1.5) ** 2), ratios[j]) for j in range(max(0, i - reach), min(len(lines), i + reach + 1))]
        smooth.append(sum(w * r for w, r in near) / sum(w for w, _ in near))
    mean = sum(smooth) / len(smooth)
    limit = min(0.5 * math.sqrt(sum((x - mean) ** 2 for x in smooth) / len(smooth)), max(smooth))
    core = [line for line, x in zip(lines, smooth) if x >= limit - 1e-9]
    total = sum(len(text) for text, _, _ in core)
    holding = [e for e in range(len(names)) if sum(len(t) for t, _, path in core if e in path) >= 0.8 * total]
    deepest = max(holding)
    path = next(p for _, _, p in lines if deepest in p)
    articles = [e for e in path[: path.index(deepest) + 1] if names[e] == "article"]
    shared = [e for e in core[0][2] if all(e in p for _, _, p in core) and names[e] in ("div", "section")]
    region = articles[0] if articles else shared[-1]
    return " ".join(text for text, _, p in lines if region in p)


def test_region_equals_the_plain_definition_on_generated_pages():
    rng = random.Random(3)
    articles = 0
    for _ in range(300):
        html, lines, names = _generated(rng)
        assert main_text(html) == _plain_main_text(lines, names)
        articles += "article" in names
    assert 0 < articles < 300
