import html
import re

import pytest

from colloquy.llm import html_extract

PAGES = [
    ("", ""), ("plain words", "plain words"), ("<p>one<p>two &amp; three", "one\ntwo & three"),
    ("<body><nav><a href=x>Home</a></nav><article><h1>Title</h1><p>A  short\n text</p></article><footer>(c) me</footer>",
     "Title\nA short text"),
    ("<article><p>first <b>bold<p>second</article><div class='ad'>buy this now please, a very long advert text</div>",
     "first bold\nsecond"),
    ("<main><div class='sidebar'><p>other things to read here</p></div><div><h2>Head</h2><p>body text of the page here</p>"
     "</div></main>", "Head\nbody text of the page here"),
    ("<article><p>text&nbsp;with&#x20;marks &lt;b&gt;</p><form><input value=q><button>Send</button></form></article>",
     "text with marks <b>"),
    ("<article><p>story text of some length</p></article><section id=comments><article class='comment'><p>"
     + "reader says a lot " * 30 + "</p></article></section>", "story text of some length"),
    ("<div id=top><a href=a>one</a> <a href=b>two</a> <a href=c>three</a></div><div id=text><p>" + "long words here " * 20
     + "</p><p>more of them</p></div><div><a href=d>four</a></div>",
     ("long words here " * 20).strip() + "\nmore of them"),
    ("<div class='cookie-notice'><p>We use cookies to make this site better for all of you, do accept them</p></div>"
     "<div><p>Short page.</p></div>", "Short page."),
    ("<article><ul><li>one<li>two</ul><table><tr><td>a<td>b</table></article>", "one\ntwo\na\nb"),
    ("<script>var x = '<p>no</p>';</script><style>p{}</style><p>yes</p><!-- <p>no</p> -->", "yes"),
    ("<article><p>cut off in a ta", "cut off in a ta"), ("<article><p>cut off</p></art", "cut off"),
    ("<nav>only a menu</nav>", ""),
]


@pytest.mark.parametrize("page, text", PAGES)
def test_pages(page, text):
    assert html_extract.main_text(page) == text


def paragraphs(words, n):
    return "".join(f"<p>{words} {k}</p>" for k in range(n))


LONG, BRIEF = "long words that tell the story at some length, sentence after sentence", "a few words of it"


def test_story_beside_article_teasers():
    story = "<h1>Story</h1>" + paragraphs(LONG, 5)
    teaser = "<article class=card><h3>Other</h3><p>read that one</p></article>"
    text = html_extract.main_text(f"<body>{teaser}<div id=story>{story}</div>{teaser * 3}</body>")
    assert text.split("\n") == ["Story", *(f"{LONG} {k}" for k in range(5))]
    assert html_extract.main_text(f"<body><main>{teaser}</main><div>{story}</div></body>") == text


@pytest.mark.parametrize("first, second", [(LONG, LONG), (LONG, BRIEF), (BRIEF, LONG)])
@pytest.mark.parametrize("tag", ["article", "section", "div class=part"])
def test_story_in_several_parts(first, second, tag):
    end = tag.split()[0]
    page = f"<body><{tag}>{paragraphs(first, 6)}</{end}><ul><li><a href=x>more</a></ul><{tag}>{paragraphs(second, 9)}</{end}></body>"
    assert html_extract.main_text(page).split("\n") == [*(f"{first} {k}" for k in range(6)), *(f"{second} {k}" for k in range(9))]


def test_article_of_many_inline_elements_stays_whole():
    busy = " ".join(f"<b>bold{k}</b> word" for k in range(60))
    page = f"<body><article><p>{busy}</p><p>end</p></article><div>some other words of this site</div></body>"
    assert {"end", re.sub("<.*?>", "", busy)} <= set(html_extract.main_text(page).split("\n"))


NAMED = ("<h2 id='related-work'>Related work</h2><section id='discussion'><p>one thought of it</p><p>and one more</p></section>"
         "<p class='share-price'>The price rose</p><h2 id='search-engines'>Search engines</h2><div class='notice'><p>mind this</p></div>"
         "<pre><span class='comment'># a</span>\nx = 1 <span class='comment'># b</span></pre>")
NAMED_TEXT = ["Related work", "one thought of it", "and one more", "The price rose", "Search engines", "mind this", "# a x = 1 # b"]


@pytest.mark.parametrize("page", ["<body><article>{}</article></body>", "<body><div>{}</div><ul><li><a href=x>more</a></ul></body>",
                                  "<body><main><div>{}</div></main></body>"])
def test_words_of_attributes_alone_drop_nothing_inside(page):
    assert html_extract.main_text(page.format(paragraphs(LONG, 4) + NAMED)).split("\n")[4:] == NAMED_TEXT


SURELY = ["<div class='advertisement'><p>{}</p></div>", "<div class='ad-slot adsbygoogle'>{}</div>", "<div class='sponsored'><p>{}</p></div>",
          "<div class='newsletter'><h3>Letter</h3><p>{}</p></div>", "<div id='cookie-consent'><p>{}</p></div>",
          "<div class='sidebar'><h4>Side</h4><p>{}</p></div>", "<div class='breadcrumbs'><span>{}</span></div>",
          "<div class='footer'><p>{}</p></div>", "<div role='navigation'><ul><li>{}</li></ul></div>",
          "<div class='comment'><p>{}</p></div>", "<section id='comments'><div class='reader'><p>{}</p></div></section>"]


@pytest.mark.parametrize("page", ["<body><article>{}</article></body>", "<body><div id=story>{}</div><ul><li><a href=x>more</a></ul></body>"])
@pytest.mark.parametrize("furniture", SURELY)
def test_sure_furniture_inside_is_dropped(page, furniture):
    part = furniture.format("some words that are no part of the story at all")
    story = paragraphs(LONG, 3) + part + paragraphs(BRIEF, 2)
    assert html_extract.main_text(page.format(story)).split("\n") == [
        *(f"{LONG} {k}" for k in range(3)), *(f"{BRIEF} {k}" for k in range(2))]


def test_marked_parts_that_are_the_article():
    """Over half of an article, and a header with its heading, are no furniture."""
    page = f"<body><article><div class='entry-header'><h1>Title</h1></div><div class='widget'>{paragraphs(LONG, 4)}</div><p>end</p></article></body>"
    assert html_extract.main_text(page).split("\n") == ["Title", *(f"{LONG} {k}" for k in range(4)), "end"]


def test_equal_sums_go_to_the_first():
    page = "<body><table><tr><td><div><p>{0}</p><p>{0}</p></div></td></tr></table><div><p>{1}</p><p>{1}</p></div></body>"
    one, two = "some words of one", "other words for 2"
    assert len(one) == len(two)
    tree = html_extract.TreeBuilder()
    tree.feed(f"<body><div><p>{one}</p></div><div><p>{two}</p></div></body>")
    tree.close()
    order = html_extract.measure(html_extract.without_furniture(tree.root))
    sums = [at.total for at in order if at.tag == "div"]
    assert sums[0] == sums[1] and html_extract.main_text(page.format(one, two)).startswith(one)


def test_links_and_threads_inside_are_dropped():
    links = "<a href=x>Send</a> <a href=y>Post</a>"
    extra = (f"<div class='share'>{links}</div><div class='related'><p>See <a href=z>quite another story of ours</a></p></div>"
             "<section id='comments'><div class='comment'><p>reader one</p></div><div class='comment'><p>reader two</p></div></section>"
             "<article class='comment'><p>reader three</p></article>")
    assert html_extract.main_text(f"<body><article>{paragraphs(LONG, 4)}{extra}<p>end</p></article></body>").split("\n") == [
        *(f"{LONG} {k}" for k in range(4)), "end"]


def test_sections_beside_the_heart():
    page = (f"<body><main><div><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p></div><section id=discussion><p>{LONG}</p></section>"
            f"<div class=sidebar><p>other things</p></div></main><p>{BRIEF}</p></body>")
    assert html_extract.main_text(page) == "\n".join([LONG] * 4)


def test_text_outside_the_body():
    assert html_extract.main_text(f"<body><p>x</p></body><div>{paragraphs(LONG, 4)}</div>").count(LONG) == 4


def test_deep_nesting():
    assert html_extract.main_text("<div>" * 5000 + "deep" + "</div>" * 5000) == "deep"


def test_articles_of_the_given_pages(spark, sf_dir):
    for r in html_extract.extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet")).join(
            spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html"), "page_id").collect():
        article = re.search(r"<article>(.*?)(</article>|$)", r.html, re.S).group(1)
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>?", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        assert r.text == "\n".join(b for b in blocks if b)
        assert r.n_chars == len(r.text)


@pytest.mark.parametrize("extra", [False, True])
def test_odd_rows(spark, extra):
    rows = [(1, "u", None), (None, None, "<p>x</p>"), (2, "u", ""), (3, "v", "<p>" + "y" * 100000), (3, "v", "<p>twice"), (3, "v", "<p>twice")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    if extra:
        pages = pages.selectExpr("*", "'t' AS text", "1 AS n_chars", "'h' AS _html")
    got = sorted((tuple(r) for r in html_extract.extract_pages(pages).collect()), key=str)
    want = [(1, "u", "", 0), (None, None, "x", 1), (2, "u", "", 0), (3, "v", "y" * 100000, 100000), (3, "v", "twice", 5), (3, "v", "twice", 5)]
    assert got == sorted(want, key=str)
    assert html_extract.extract_pages(pages.limit(0)).count() == 0
