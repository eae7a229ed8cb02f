"""Main text: templates with the parts that must go, broken markup, and the vote of a host."""

from tillscope.llm import htmltext
from tillscope.llm.htmltext import Page


def text(html, *paths):
    return Page(html).text(list(paths))


PARAGRAPHS = [f"Paragraph {i} has enough plain words in it to count as the text of an article." for i in range(4)]
ARTICLE = "".join(f"<p>{p}</p>" for p in PARAGRAPHS)
WANT = "\n\n".join(PARAGRAPHS)


def test_parts_that_go():
    parts = [
        "<nav><ul><li><a href=/>Home</a></ul></nav>",
        '<div class="menu-main"><a>Menu</a></div>',
        "<header><h2>Site</h2></header>",
        '<aside>Side</aside><div id="sidebar">Side</div>',
        '<div class="cookie-notice">We use cookies</div><div class="ad">Buy</div>',
        "<form><label>Name</label><input><textarea>x</textarea><select><option>1</select></form>",
        "<script>var a='</p>';</script><style>p{}</style><noscript>no</noscript><!-- <p>hidden</p> -->",
        '<article class="comment"><p>First reader writes a lot of words about the text above it</p></article><div class="commentbox">Me</div>',
        '<p class="advertisement-3">Buy</p><div class="sidebar2">Side</div><div id="newsletterSignup">Mail</div>',
        '<section class="comments"><p>Reader says hello to everyone here today</p></section><div id="comment-list">Me too</div>',
        '<div hidden>h</div><div style="display: none">n</div><div role="navigation">r</div>',
        "<footer>&copy; 2024</footer>",
    ]
    for part in parts:
        page = f"<html><head><title>t</title></head><body>{part}<article>{ARTICLE}</article></body></html>"
        assert text(page) == WANT, part
        inside = f"<html><body><div class='post'>{ARTICLE}{part}</div></body></html>"
        assert text(inside) == WANT, part


def test_blocks_and_references():
    page = "<body><article><h1>Title &amp; more</h1><p>One&nbsp;two\n  three<br>four<b>five</b></p>loose text<ul><li>a<li>b</ul><p>last<div>inner</div>tail</article></body>"
    assert text(page) == "Title & more\n\nOne two three fourfive\n\nloose text\n\na\n\nb\n\nlast\n\ninner\n\ntail"


def test_broken_markup():
    assert text("") == "" and text("plain words only") == "plain words only"
    assert text("<p>a < b and c<p>next <b>bold") == "a < b and c\n\nnext bold"
    assert text("<article><p>cut off <a href='x") == "cut off <a href='x"
    assert text("<script>never closed <p>x</p>") == "" and text("<!-- never closed <p>x</p>") == ""


def test_host_vote_wins_over_a_page_of_its_own(spark):
    template = "<body><div class='lead-{0}'>{1}</div><div class='more'>{2}</div></body>"
    rows = [(i, f"http://News.example/{i}", template.format(i, ARTICLE, "<p>short</p>")) for i in range(9)]
    rows.append((9, "http://news.example/9", template.format(9, "<p>Little.</p>", f"<p>{PARAGRAPHS[0] * 9}</p>")))  # alone it would pick the other part
    rows.append((10, "http://other.example/", template.format(9, "<p>Little.</p>", f"<p>{PARAGRAPHS[0] * 9}</p>")))
    got = {r["page_id"]: r["text"] for r in htmltext.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == WANT for i in range(9)) and got[9] == "Little." and got[10] == PARAGRAPHS[0] * 9


def test_forms_and_wrappers_around_the_article():
    small = "<div class='sidebar'><p>Side words</p></div><form><label>Mail</label><p>Join us</p></form><nav><p>Home</p></nav>"
    for wrapper in ("form id='aspnetForm'", "div class='content-with-sidebar'", "div class='sidebar-right'", "div id='menu-open'"):
        tag = wrapper.split()[0]
        for body in (f"<div>{ARTICLE}</div>", f"<article>{ARTICLE}</article>", f"<main>{ARTICLE}</main>"):
            assert text(f"<body><{wrapper}>{body}{small}</{tag}></body>") == WANT, (wrapper, body)
            assert text(f"<body><form><{wrapper}>{small}{body}</{tag}></form></body>") == WANT, (wrapper, body)
    comments = f"<div class='comments'><article><p>{PARAGRAPHS[0] * 5}</p></article></div>"
    assert text(f"<body><article>{ARTICLE}</article>{comments}</body>") == WANT
    assert text(f"<body><form hidden>{ARTICLE}</form><p>Seen.</p></body>") == "Seen."


def test_a_minority_layout_keeps_its_article(spark):
    common, other = "<body><div class='lead'>{0}</div></body>", "<body><div class='lead'><p>Little.</p></div><div class='story'>{0}</div></body>"
    rows = [(i, f"http://news.example/{i}", common.format(ARTICLE)) for i in range(9)] + [(9, "http://news.example/9", other.format(ARTICLE))]
    rows += [(10 + i, None, common.format(ARTICLE)) for i in range(9)] + [(19, "odd", f"<body><div class='story'>{ARTICLE}</div><div class='lead'><p>Not a small part, but no article either.</p></div></body>")]
    got = {r["page_id"]: r["text"] for r in htmltext.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: WANT for i in range(20)}


def test_test_pages(spark, folder):
    """The test pages keep their article in one element, so their text can be cut out plainly."""
    import html
    import re

    rows = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    for r in htmltext.op2_host_path_text(spark, folder).collect():
        body = rows[r["page_id"]].partition("<article>")[2].rpartition("</article>")[0]
        blocks = [" ".join(html.unescape(re.sub(r"</?b>", "", b).replace("<br>", " ")).split()) for b in re.split(r"</?(?:h1|p)>", body)]
        assert r["text"] == "\n\n".join(b for b in blocks if b) and r["n_chars"] == len(r["text"])


def test_articles_in_parts_are_whole():
    parts = "".join(f"<section>{ARTICLE}</section>" for _ in range(3))
    want = "\n\n".join([WANT] * 3)
    for page in (f"<body><div class='a'><div class='b'>{parts}</div></div></body>", f"<body><article><div>{ARTICLE}</div>{ARTICLE * 2}</article></body>"):
        assert text(page) == want
    uneven = f"<body><main><div class='one'>{ARTICLE * 5}</div><div class='two'><p>Short ending.</p></div></main><div>other</div></body>"
    assert text(uneven) == "\n\n".join([WANT] * 5 + ["Short ending."])
    assert htmltext.Page(uneven).best().path == ">body>main"


def test_hostile_markup_takes_linear_time():
    import time

    for unit in ("<a ", '<a "', "<!", "<a '\"", '<a ">" ', "<a b='>", "</", "<!--", "<a =\"<a>'"):
        times = []
        for size in (100_000, 400_000):
            page = (unit * (size // len(unit) + 1))[:size]
            for tail in ("", ">", "<p>end</p>"):
                began = time.monotonic()
                list(htmltext.events(page + tail))
                times.append(time.monotonic() - began)
        assert max(times) < 2.0, (unit, times)


def test_tags_end_where_they_should():
    assert list(htmltext.events('<p class="a>b">x</p>')) == [("open", "p", ' class="a>b"'), ("text", "", "x"), ("close", "p", "")]
    assert list(htmltext.events("<p title='it>s' it's>x")) == [("open", "p", " title='it>s' it's"), ("text", "", "x")]
    assert list(htmltext.events("a < b <i>c</i> <d")) == [("text", "", "a < b "), ("open", "i", ""), ("text", "", "c"), ("close", "i", ""), ("text", "", " <d")]
    assert list(htmltext.events("<!doctype html><!-- <p> --><?x y?>z<!-- end")) == [("text", "", "z")]
