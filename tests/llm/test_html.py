import html
import random
import re
import time

from quillgrid.llm.html import HINTS, extract, main_text

LONG = "Some words, with commas, that make up a paragraph of the article which goes on for a while, as such paragraphs do."


def plain_article(page):
    """Straight cut for the sample's one layout."""
    body = re.search(r"<article>(.*?)(?:</article>|$)", page, re.S)[1]
    body = re.sub(r"<[^>]*$", "", body)
    blocks = re.split(r"</?(?:p|h1|div|article)\b[^>]*>", body)
    clean = [" ".join(html.unescape(re.sub(r"<br\s*/?>", " ", b).replace("<b>", "").replace("</b>", "")).split()) for b in blocks]
    return "\n".join(b for b in clean if b)


def test_sample_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    want = {r.page_id: (r.url, plain_article(r.html)) for r in pages.collect()}
    got = extract(pages).collect()
    assert len(got) == len(want)
    for r in got:
        assert (r.url, r.text) == want[r.page_id]
        assert r.n_chars == len(r.text)


def test_boilerplate_goes():
    page = f"""<html><head><title>T</title><style>p{{}}</style></head><body class="has-sidebar"><header><h1>Site</h1></header>
    <nav><a href=/>Home</a></nav><div id="cookie-notice"><p>{LONG} cookies</p></div>
    <div class=layout><div class="post"><h1>Ti&amp;tle&nbsp;x</h1><p>{LONG}<br>more <a href=#>link</a>ed</p><div class="ad-slot"><p>{LONG} buy</p></div>
    <script>document.write("<p>no</p>")</script><p>Short.</p><blockquote>{LONG} quoted</blockquote><form><p>{LONG} form</p><input></form></div>
    <aside><p>{LONG} aside</p></aside></div><section class="comments"><p>{LONG} comment one</p><p>{LONG} comment two, three, four</p></section>
    <footer>{LONG} foot</footer></body></html>"""
    assert main_text(page) == f"Ti&tle x\n{LONG} more linked\nShort.\n{LONG} quoted"


def test_sections_of_an_article_stay():
    page = f"<body><div class=menu><a>x</a></div><article><header><h1>Head</h1></header><section><p>{LONG}</p></section><section><h2>Two</h2><p>Short, too.</p></section><ul><li>one<li>two</ul><article class=comment><p>{LONG} {LONG}</p></article></article><div>{LONG} outside</div></body>"
    assert main_text(page) == f"Head\n{LONG}\nTwo\nShort, too.\none\ntwo"


def test_edges(spark):
    assert main_text("plain words") == "plain words"
    assert main_text("<p>a &lt; b < c &#8364; &bogus; &amp") == "a < b < c € &bogus; &"
    assert main_text("<div>" * 50000 + LONG) == LONG
    assert main_text("<p>" + "x, " * 500000).startswith("x, x,")
    assert main_text("<article><p>one<p") == "one"
    assert main_text("<article><p title=\"it's>a</p><p>b</p></article>") != ""
    df = spark.createDataFrame([(1, None, None, "t"), (2, "u", "", "t"), (2, "u", "", "t"), (None, "v", "<p>x</p>", None)], "page_id long, url string, html string, text string")
    assert sorted((r.page_id or 0, r.url or "", r.text, r.n_chars) for r in extract(df).collect()) == [(0, "v", "x", 1), (1, "", "", 0), (2, "u", "", 0), (2, "u", "", 0)]
    assert extract(df.limit(0)).count() == 0


def test_siblings_and_short_blocks_of_a_container_stay():
    page = f"<body><div class=c><div class=a><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p></div><ul><li>short one</li><li>two</li></ul><div><p>Tiny end.</p></div></div><div>Imprint</div></body>"
    assert main_text(page) == f"{LONG}\n{LONG}\n{LONG}\nshort one\ntwo\nTiny end."


def test_scores_decide_inside_main():
    menu = "<ul>" + "".join(f"<li><a href=/{k}>Other story number {k}</a></li>" for k in range(9)) + "</ul>"
    cards = "<div>" + "".join(f"<div><a href=/{k}>One more story, number {k}</a> <i>{k} May</i></div>" for k in range(4)) + "</div>"
    page = f"<body><main><div>{menu}</div><div><div><h2>Head</h2><p>{LONG}</p></div><p>Short.</p></div><div><p>{LONG}</p><table><tr><td>a<td>b</table></div>{cards}</main></body>"
    assert main_text(page) == f"Head\n{LONG}\nShort.\n{LONG}\na\nb"


def generated(r):
    """A page in a random layout without article or main elements, and the blocks of its text."""
    blocks: list[str] = []

    def sentence(k):
        return ", ".join(" ".join("".join(r.choices("abcdefgh", k=r.randrange(2, 9))) for _ in range(r.randrange(3, 9))) for _ in range(k)) + "."

    def part():
        kind = r.randrange(6)
        if kind < 3:
            t = sentence(r.randrange(4, 9))
            blocks.append(t)
            return f"<p>{t}</p>"
        if kind == 3:
            t = sentence(1)
            blocks.append(t)
            return f"<h{r.randrange(2, 5)}>{t}</h3>"
        if kind == 4:
            own = [sentence(1) for _ in range(r.randrange(1, 4))]
            blocks.extend(own)
            return "<ul>" + "".join(f"<li>{t}" for t in own) + "</ul>"
        t = sentence(3)
        blocks.append(t)
        return f"<blockquote>{t}</blockquote>"

    junk = [
        lambda: f"<nav>{sentence(5)}</nav>",
        lambda: f"<div class='site-footer footer'><p>{sentence(9)}</p></div>",
        lambda: f"<aside><p>{sentence(9)}</p></aside>",
        lambda: f"<div id=cookie-banner>{sentence(4)}</div>",
        lambda: "<ul>" + "".join(f"<li><a href=/{k}>{sentence(1)}</a></li>" for k in range(5)) + "</ul>",
        lambda: f"<form><p>{sentence(5)}</p></form>",
        lambda: f"<section class=comments><p>{sentence(9)}</p></section>",
        lambda: f"<script>{sentence(5)}</script>",
    ]
    inner = ""
    for _ in range(r.randrange(1, 4)):
        inner += "<div>" + "".join(part() + (r.choice(junk)() if r.random() < 0.15 else "") for _ in range(r.randrange(2, 6))) + f"<p>{(t := sentence(8))}</p></div>"
        blocks.append(t)
    for _ in range(r.randrange(4)):
        inner = f"<div class=w{r.randrange(9)}>{inner}</div>"
    before, after = ("".join(r.choice(junk)() for _ in range(r.randrange(3))) for _ in range(2))
    return f"<html><head><title>{sentence(1)}</title></head><body>{before}<div id=page>{inner}</div>{after}</body></html>", blocks


def test_generated_layouts():
    r = random.Random(8)
    for _ in range(300):
        page, blocks = generated(r)
        assert main_text(page).split("\n") == blocks


def test_linear_in_depth_and_length():
    n, began = 100_000, time.time()
    assert main_text("<div>" * n + "<header>" * n + "</section>" * n + "</header>" * n + LONG) == LONG
    assert main_text("<li><ul>" + "<div>" * n + "<li>x" * n).count("x") == n
    assert main_text("<div>" * n + f"<p>{LONG}" * 3) == "\n".join([LONG] * 3)
    main_text("<p title=it's>x" * n)
    main_text("<body>" * n + "<a href='" * n)
    assert time.time() - began < 30


def test_names_with_boilerplate_words_do_not_lose_articles():
    two, more = f"<p>{LONG}</p><p>{LONG} b</p>", f"{LONG}\n{LONG} b"
    assert main_text(f'<body><div class="elementor-widget elementor-widget-text-editor">{two}</div><div>Imprint</div></body>') == more
    assert main_text(f"<body id=page-with-sidebar-menu><div id=page-with-sidebar-menu>{two}</div></body>") == more
    assert main_text(f"<body><div><div class=social-sciences>{two}</div><p>{LONG} c</p></div></body>") == f"{more}\n{LONG} c"
    assert main_text(f"<body><main><div class=promotion-theory>{two}</div><div class=related-work><p>{LONG} c</p><p>{LONG} d</p></div></main></body>") == f"{more}\n{LONG} c\n{LONG} d"
    # short, link-dense or far from the text, such names still say what they say
    links = " ".join(f"<a href=/{k}>{LONG} {k}</a>" for k in range(4))
    page = f"<body><div class=post>{two}<div class=related-posts><p>{links}</p></div><div class=share-bar>{LONG}</div></div><div class=site-footer>{LONG} {LONG}</div></body>"
    assert main_text(page) == more


def test_generated_layouts_with_any_names():
    r = random.Random(9)
    names = sorted(HINTS)
    for _ in range(200):
        page, blocks = generated(r)
        page = re.sub(r"class=w\d", lambda _: f"class='{r.choice(names)}-{r.choice('abcdefgh')}x'", page)
        assert main_text(page).split("\n") == blocks


def test_quoted_values_of_any_length():
    assert main_text(f'<article><p data-x="{"y" * 90_000} > SECRET tail">{LONG}</p></article>') == LONG
    assert main_text(f"<article><p title=it's>{LONG}</p><p title='a > b' data-y=\"c > d\">x</p></article>") == f"{LONG}\nx"
    n, began = 100_000, time.time()
    main_text("<p a=\">x" * n + "'")
    main_text("<p a='>x\"" * n)
    assert time.time() - began < 20


def test_formulas_stay():
    assert main_text(f"<article><p>{LONG} <math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>tex</annotation></math> end<object>plain</object></p></article>") == f"{LONG} x=1 endplain"
