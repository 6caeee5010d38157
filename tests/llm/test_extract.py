import html
import re

from pyspark.sql import functions as F

from wearlens.llm import extract
from wearlens.llm.catalog import QUERIES

from . import helpers

PAGE = (
    "<html><head><title>T</title><style>p{}</style></head><body><header><a href=/>Home</a></header><nav><ul><li>One</li><li>Two</li></ul></nav>"
    "<div class='cookie-notice'>We use cookies</div><article><h1>Title &amp; more</h1><p>First <b>bold</b>\n text.<p>Second&nbsp;one<script>var a='</p>';</script>"
    "<aside>Related</aside><div class=comments><p>Nice!</p></div></article><form>Name <input></form><footer>&copy; site</footer></body></html>"
)


def test_a_page():
    assert extract.main_text(PAGE, None, None)[0] == "Title & more\nFirst bold text.\nSecond one"


def test_pages_without_article():
    page = "<body><div id=menu>Menu</div><div><div class=x><p>" + "Long text. " * 20 + "<p>More text here</div></div><div id=footer>End</div>"
    assert extract.main_text(page, None, None)[0] == ("Long text. " * 20).strip() + "\nMore text here"
    assert [extract.main_text(x, None, None)[0] for x in ("", "<", "no tags", "<p", "</div></p>", "<!-- a")] == ["", "<", "no tags", "<p", "", ""]


def test_folding_and_alignment():
    a = extract.folded("ul li # /li li # /li li # /li /ul p # /p".split())
    assert extract.written_as(a) == "ul ( li # /li )+ /ul p # /p"
    b = extract.folded("ul li # /li /ul div # /div p # /p".split())
    both = extract.aligned(a, b)
    assert extract.written_as(both) == "ul ( li # /li )+ /ul ( div # /div )? p # /p"
    assert extract.describes(both, a) and extract.describes(both, b)
    assert not extract.describes(both, extract.folded("table tr # /tr /table".split()))
    assert extract.parsed(extract.written_as(both)) == both


def test_odd_rows(spark):
    rows = [(1, "http://a/x", PAGE), (2, "http://a/y", PAGE.replace("<aside>Related</aside>", "")), (3, None, PAGE), (4, "http://b/", None), (5, "junk", ""), (None, "http://a/z", PAGE), (1, "http://a/x", PAGE)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("host", F.lit(3)).withColumn("text", F.lit("x")).withColumn("path", F.lit(1))
    found = extract.extracted(pages).collect()
    assert len(found) == len(rows)
    assert all(r.text == ("" if r.page_id in (4, 5) else "Title & more\nFirst bold text.\nSecond one") for r in found)
    assert extract.extracted(pages.limit(0)).count() == 0


def test_many_streams_of_one_host_merge_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(extract, "FAN", 4)
    rows = [(i, "http://a/", "<body>" + "".join(f"<{t}>x</{t}>" for k, t in enumerate(("div", "section", "table", "ul", "form")) if i >> k & 1) + f"<article><p>text {i}</article>") for i in range(32)]
    pages = spark.createDataFrame(rows, "page_id bigint, host string, html string")
    found = extract.wrappers(pages).collect()
    assert len(found) == 1 and found[0].path == "body/article"


def test_query(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{helpers.SF}/pages.parquet").collect()}
    rows = QUERIES["op7_html_extraction"](spark, helpers.SF).collect()
    assert len(rows) == len(pages)
    for r in rows:
        body = re.search(r"<article>(.*?)(?:</article>|$)", pages[r.page_id] or "", re.DOTALL)
        blocks = re.split(r"</?(?:p|h1)>", body[1].replace("<br>", " ")) if body else []
        texts = [re.sub(r"\s+", " ", html.unescape(re.sub(r"</?b>", "", b))).strip() for b in blocks]
        assert r.text == "\n".join(t for t in texts if t) and r.n_chars == len(r.text)


def test_text_that_is_the_same_on_all_pages_is_no_main_text(spark):
    """Unlisted elements without cue words: only the texts tell a menu and a notice from the story."""
    def page(i):
        story = "".join(f"<p>Story {i} line {k} " + "word " * 10 + "</p>" for k in range(2 + i % 3))
        return (
            "<html><body class='comments sidebar'><div class='sidebar-layout'><div><p>Home of things</p><p>Shop</p></div>"
            f"<div class=x1><p>Always the same notice, in a long sentence that goes on.</p></div><div class=x2><h1>Head {i}</h1>{story}<p>Read more here</p></div>"
            "<div>All rights with us</div></div></body></html>"
        )

    pages = spark.createDataFrame([(i, f"http://a/{i}", page(i)) for i in range(12)], "page_id bigint, url string, html string")
    for r in extract.extracted(pages).collect():
        lines = r.text.split("\n")
        assert r.described and lines[0] == f"Head {r.page_id}" and len(lines) == 4 + r.page_id % 3
        assert all(x.startswith(f"Story {r.page_id} ") for x in lines[1:-1]) and lines[-1] == "Read more here"  # inside the story's element


def test_repeated_headings_and_lists_of_an_article_stay(spark):
    def page(i):
        story = "".join(f"<p>Story {i} line {k} " + "word " * 10 + "</p>" for k in range(1 + i % 3))
        return (
            "<html><body><nav><ul><li>Home</li></ul></nav><div><p>The same words on every page</p></div>"
            f"<article><h1>Head {i}</h1><h2>Background</h2>{story}<h2>What we know</h2><ul><li>It was reported</li></ul><p>End of story</p></article>"
            "<footer><p>All rights</p></footer></body></html>"
        )

    pages = spark.createDataFrame([(i, f"http://a/{i}", page(i)) for i in range(12)], "page_id bigint, url string, html string")
    for r in extract.extracted(pages).collect():
        story = [f"Story {r.page_id} line {k} " + " ".join(["word"] * 10) for k in range(1 + r.page_id % 3)]
        assert r.text.split("\n") == [f"Head {r.page_id}", "Background", *story, "What we know", "It was reported", "End of story"]


def test_slots_of_a_wrapper():
    wrapper = extract.parsed("ul ( li # /li )+ /ul ( div # /div )? p # /p")
    found = extract.Matcher(wrapper)
    assert found.slots("ul li # /li li # /li /ul p # /p".split()) == [2, 2, 9]
    assert found.slots("ul li # /li /ul div # /div p # /p".split()) == [2, 6, 9]
    assert found.slots("table # /table".split()) is None and found.slots([]) is None
