import random
import re
import time
from html import unescape

from findery.llm import html
from findery.session import table

SIDE = ('<html><head><title>T</title><script>if (a<b) x("</p>");</script></head><body class="has-sidebar">'
        "<header><h1>Site</h1></header><nav><a href=x>Home</a> <a>About us</a></nav>"
        '<div class="cookie-notice">We use cookies &amp; more, accept them all now please</div>'
        "<{0}><h2>Big &eacute;vent</h2><p>This is the <a href='q'>first</a> paragraph of\n the article text.</p>"
        '<div class="advert">Buy now cheap stuff today only</div><p>Second&nbsp;para.<br>More</p>'
        "<ul><li>One item</li><li>Two</li></ul><p>End.</p></{0}><aside>Related links</aside><form><label>Name</label></form>"
        '<section id="comments"><p>I like this article very much, says a reader.</p></section>'
        "<footer>(c) 2020 all rights reserved</footer></body></html>")
WANTED = "Big évent\nThis is the first paragraph of the article text.\nSecond para. More\nOne item\nTwo\nEnd."


def test_articles_come_out_whole(spark, sf01):
    pages = table(spark, sf01, "pages")
    got = {r["page_id"]: r for r in html.extract(pages).collect()}
    assert len(got) == pages.count()
    for page in pages.collect():
        inside = re.search(r"<article>(.*?)</article>", page["html"], re.S)[1]
        inside = re.sub(r"<br>", " ", re.sub(r"</?b>", "", inside))
        blocks = (" ".join(unescape(b).split()) for b in re.split(r"</?(?:p|h1)>", inside))
        text = "\n".join(b for b in blocks if b)
        assert got[page["page_id"]]["text"] == text
        assert got[page["page_id"]]["n_chars"] == len(text) and got[page["page_id"]]["url"] == page["url"]


def test_other_layouts(spark, sf01):
    scores = html.fit(table(spark, sf01, "pages"))
    for tag in ("article", "main", "div"):
        assert html.main_text(SIDE.format(tag), scores) == WANTED
        assert html.main_text(SIDE.format(tag), {}) == WANTED


def test_broken_and_empty_pages(spark):
    rows = [(1, "u", None, "x"), (2, None, "", "x"), (3, "u", "<p>a<p>b<script>never closed", "x"),
            (4, "u", "no markup &lt;at all", "x"), (5, "u", "<!-- open", "x"), (5, "u", "<!-- open", "x"),
            (6, "u", "<p>" + "word " * 200_000, "x"), (7, "u", "<b>a < b</i></p> c", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted((r["page_id"], r["text"]) for r in html.extract(pages).collect())
    assert got[:2] == [(1, ""), (2, "")] and got[2] == (3, "a\nb") and got[3] == (4, "no markup <at all")
    assert got[4:6] == [(5, ""), (5, "")] and len(got[6][1]) == 200_000 * 5 - 1 and got[7] == (7, "a < b\nc")
    assert html.extract(pages.where("page_id < 0")).count() == 0


def test_anchors_and_parts_of_names_stay_in_an_article(spark, sf01):
    page = ('<body><nav class="nav">Home</nav><article><h2 id="search-algorithms">Search algorithms</h2><p>They look for a '
            'word in a text.</p><h2 id="how-to-share-files">How to share files</h2><p id="notice">Send them.</p>'
            '<section id="related-work"><p>Others did so before.</p></section><div class="content-widget"><p>A table.</p>'
            '</div><div class="social-share">Share this</div><div class="promo box">Buy now</div><p>The end of it.</p>'
            '</article><div class="related-posts">More to read</div></body>')
    want = ("Search algorithms\nThey look for a word in a text.\nHow to share files\nSend them.\n"
            "Others did so before.\nA table.\nThe end of it.")
    for scores in ({}, html.fit(table(spark, sf01, "pages"))):
        assert html.main_text(page, scores) == want
        assert html.main_text(page.replace("article", "main"), scores) == want


def test_wrappers_that_mention_furniture(spark, sf01):
    body = "<nav>Home</nav><p>" + "The text of a page goes on. " * 12 + "</p><div class='comments'><p>So true, says a reader.</p></div>"
    want = ("The text of a page goes on. " * 12).strip()
    for scores in ({}, html.fit(table(spark, sf01, "pages"))):
        for wrapper in ('<div id="wrapper" class="sidebar-right">', '<div class="layout right-sidebar">', "<div>"):
            assert html.main_text(f"<body>{wrapper}{body}</div></body>", scores) == want


def test_parts_of_an_article_that_are_furniture():
    page = ('<article><p>One two three four five.</p><div class="ad-slot">Buy it</div><p>Six seven eight nine.</p>'
            '<div class="comment-list"><p>Nice one</p></div><div class="comments-area">Me too</div>'
            '<div id="comments-section">And me</div><p>Ten.</p></article>')
    assert html.main_text(page, {}) == "One two three four five.\nSix seven eight nine.\nTen."


def test_marks_in_attributes_and_open_paragraphs():
    assert html.main_text('<p title="a<b">First of all</p><p data-x=\'c>d\'>Second one</p>', {}) == "First of all\nSecond one"
    page = '<p>Before it all</p><p class="advert">Buy <b>now<h2>Real heading</h2><p>The text below the heading.</p>'
    assert html.main_text(page, {}) == "Before it all\nReal heading\nThe text below the heading."
    assert html.main_text("<ul><li>one<p>two</p><li>three</ul>", {}) == "one\ntwo\nthree"


def test_tags_that_never_end_take_no_square_time():
    start = time.time()
    for unit in ("<script", '<a "', "<a '<", '<a x="', "<!--", "<p", "<b x='y<z' "):
        html.main_text(unit * 20_000, {})
    assert time.time() - start < 40


def best_stretch(values):
    """By all pairs of ends."""
    return max([0.0] + [sum(values[a:b]) for a in range(len(values)) for b in range(a + 1, len(values) + 1)])


def test_stretch_equals_all_pairs():
    draw = random.Random(3)
    for _ in range(200):
        parts, values = [], []
        for n in range(draw.randrange(1, 9)):
            tag = draw.choice(["p", "div", "b", "li"])
            words = draw.randrange(4)
            parts.append(f"<{tag}>" + " ".join(f"w{n}x{k}" for k in range(words)) + f"</{tag}>")
        page = "".join(parts)
        scores = {key: draw.choice([-1.0, -0.4, 0.3, 1.0]) for key, *_ in html.Walk(page)}
        tokens = [(key, w, t) for key, w, t, _ in html.Walk(page) if w]
        values = [scores[key] * (w if w > 0 else 1) for key, w, _ in tokens]
        chosen = "".join(html.main_text(page, scores).split())  # inline tags join words
        total = best_stretch(values)
        stretches = [(a, b) for a in range(len(values)) for b in range(a, len(values) + 1) if abs(sum(values[a:b]) - total) < 1e-9]
        texts = ["".join("".join(t for _, w, t in tokens[a:b] if w > 0).split()) for a, b in stretches]
        assert chosen in texts or (not chosen and total == 0.0)
