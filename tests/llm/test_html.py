import html
import re

import duckdb

import __spark_entry__ as driver
from tasteloom.llm import wrappers
from tasteloom.llm.html import parse, plain

FOLDER = "/root/testdata/sf0.01"


def article(page):
    """Main text of the given tables' pages, whose content is an article element."""
    inside = re.search(r"<article>(.*?)(</article>|\Z)", page, re.S)
    body = re.sub(r"<[^>]*\Z", "", re.sub(r"<(br|/?b)>", " ", inside[1] if inside else ""))
    return "\n\n".join(b for b in (re.sub(r"\s+", " ", html.unescape(x)).strip() for x in re.split(r"<[^>]*>", body)) if b)


def test_query(spark):
    rows = driver.queries()["op8_html_extraction"](spark, FOLDER).collect()
    pages = duckdb.connect().execute(f"select page_id, url, html from '{FOLDER}/pages.parquet'").fetchall()
    assert {(r.page_id, r.url, r.text, r.n_chars) for r in rows} == {(i, u, article(h), len(article(h))) for i, u, h in pages}
    assert len(rows) == len(pages)


def extract(spark, rows, **more):
    pages = spark.createDataFrame([(k, u, h, "z", "z") for k, (u, h) in enumerate(rows)],
                                  "page_id long, url string, html string, host string, rule string")
    return {r.page_id: r.text for r in wrappers.extract_main_text(pages).collect()}


SHELL = """<!DOCTYPE html><html><head><title>T{n}</title><script>if (a<b) {{ "</p>" }}</script></head><body>
<div class="top-menu"><ul><li><a href=x>Home</a><li>News {n}</ul></div>
<div id=wrap>Hello reader of our site
{body}
<div>Imprint and terms of use</div></div>
<div class="comments"><p>first! {n}</p></div><footer>&copy; {n}</footer>"""


def test_template_texts_of_a_host_are_dropped(spark):
    bodies = ["<p>One &amp; only\n  text &eacute; &#x41;</p><p>second <b>bold</b>text", "<p>Quite another story</p>",
              "<h2>Head</h2><p>third page<br>goes on</p><table><tr><td>cell<td>more</table>", "<p>fourth</p><aside>no</aside><p>end</p>"]
    rows = [(f"https://user@Site.example:80/{n}", SHELL.format(n=n, body=b)) for n, b in enumerate(bodies)]
    got = extract(spark, rows)
    assert got == {0: "One & only text é A\n\nsecond boldtext", 1: "Quite another story",
                   2: "Head\n\nthird page goes on\n\ncell\n\nmore", 3: "fourth\n\nend"}


def test_texts_of_every_page_are_dropped_of_any_length_and_inside_content(spark):
    notice = "All rights reserved by the publisher of this site. " * 4
    pages = [f"<article><p>Story {n}</p><div>Read our newsletter</div></article><div>{notice}</div>" for n in range(3)]
    mixed = [f"<article><p>Own {n}</p></article><div>{notice}</div>" for n in range(2)] + [f"<div><p>No article</p></div><div>{notice}</div>"]
    plain_ = [f"<p>Text {n}</p><div>{notice}</div>" for n in range(3)]
    copies = ["<article><p>One story</p></article>"] * 4 + ["<p>twice</p>"] * 4
    rows = [("http://a.example", h) for h in pages] + [("http://m.example", h) for h in mixed] + [
        ("http://p.example", h) for h in plain_] + [(f"http://{'c' if k < 4 else 'd'}.example", h) for k, h in enumerate(copies)]
    assert list(extract(spark, rows).values()) == [
        "Story 0", "Story 1", "Story 2", "Own 0", "Own 1", "No article", "Text 0", "Text 1", "Text 2",
        *["One story"] * 4, *["twice"] * 4]


def test_near_copies_on_one_host_keep_their_texts(spark):
    page = "<article><h1>One title</h1><p>The same first paragraph.</p><p>Version {n}</p></article><div>Imprint</div>"
    bare = "<h1>Title</h1><p>First</p><p>Second</p><p>Version {n}</p>"
    rows = [("http://a.example", page.format(n=n)) for n in range(4)] + [("http://b.example", bare.format(n=n)) for n in range(3)]
    assert list(extract(spark, rows).values()) == [f"One title\n\nThe same first paragraph.\n\nVersion {n}" for n in range(4)] + [
        f"Title\n\nFirst\n\nSecond\n\nVersion {n}" for n in range(3)]


def test_the_wrapper_tells_template_from_content_by_place(spark):
    """The same text is template where every page has it, and content elsewhere: behind an optional group, in a
    repeated one, or where pages have it in different places."""
    shell = "<div class=top>Contact us</div>{b}<h5>Imprint</h5>"
    bodies = ["<h2>One</h2><p>first</p><p>Contact us</p>", "<blockquote>Imprint</blockquote><h2>Two</h2><p>second</p>", "<h2>Three</h2><ul><li>a<li>Contact us</ul>"]
    moved = ["<h2>Found here</h2><p>x1</p>", "<p>x2</p><h3>Found here</h3>", "<ul><li>x3<li>Found here</ul>"]
    series = ["<h2>Head</h2><p>a</p>", "<h2>Head</h2><p>b</p><p>c</p>", "<p>d</p>"]
    rows = [("http://a.example", shell.format(b=b)) for b in bodies] + [("http://b.example", b) for b in moved] + [
        ("http://c.example", b) for b in series]
    assert list(extract(spark, rows).values()) == [
        "One\n\nfirst\n\nContact us", "Imprint\n\nTwo\n\nsecond", "Three\n\na\n\nContact us",
        "Found here\n\nx1", "x2\n\nFound here", "x3\n\nFound here", "Head\n\na", "Head\n\nb\n\nc", "d"]


def test_pages_are_read_along_the_wrapper():
    wrapper = wrappers.numbered(wrappers.rule(["#root", "1", [["p", "?", [["#", "1", []]]], ["h2", "?", [["#", "1", []]]],
                                                               ["p", "+", [["#", "1", []]]]]])["wrapper"])
    places = [[p for _, p, _ in wrappers.placed_texts(h, wrapper)[0]] for h in (
        "<p>x", "<p>x<h2>y</h2><p>z<p>z", "<h2>y</h2><p>z", "<p>x<div>other</div>")]
    assert places == [[7], [3, 5, 7, 7], [5, 7], [7, 0]]


def test_semantic_elements_and_lonely_pages(spark):
    rows = [("http://a.example/1", "<main><nav>x</nav><p>kept</main><p>not kept"),
            ("http://b.example/1", "<div class='post-content'><p>by class</div><div class=sidebar>no</div>out"),
            ("http://c.example/1", "<p>plain page</p><form>login</form>"),
            ("http://d.example/1", "<article><header><h1>Own head</h1></header>text<div class='share'>no</div></article><header>no"),
            ("http://d.example/2", "no article here"), (None, "<article>nameless"), ("", None), ("nonsense", ""),
            ("http://e.example", "<article>cut <b>in a ta<sp"), ("http://e.example", "<article><!-- never <p> closed"),
            ("http://e.example", "a < b &lt; c &unknown; &amp;amp; <p><p></p> x > y")]
    assert extract(spark, rows) == {
        0: "kept", 1: "by class", 2: "plain page", 3: "Own head\n\ntext", 4: "no article here", 5: "nameless", 6: "", 7: "",
        8: "cut in a ta", 9: "", 10: "a < b < c &unknown; &amp;\n\nx > y"}


def test_very_long_and_deep_pages(spark):
    deep = "<div>" * 300 + "bottom" + "</div>" * 300
    wide = "<article>" + "<p>word</p>" * 20_000 + "</article>"
    got = extract(spark, [("http://x.example", deep), ("http://y.example", wide), ("http://z.example", "<" * 5000 + "a")])
    assert got[0] == "bottom" and got[1] == "\n\n".join(["word"] * 20_000) and set(got[2]) == {"<"}


def test_empty_table(spark):
    assert wrappers.extract_main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_many_shapes_are_merged_in_groups(spark):
    """More shapes of one host than a group holds: the wrapper still covers all of them."""
    rows = [("http://big.example", "<div>same line</div>" + "".join(f"<{t}>{n}{t}</{t}>" for k, t in enumerate(("p", "ul", "h2", "h3", "dl", "pre", "h4", "ol"))
                                                                     if n >> k & 1) + f"<p>tail {n}") for n in range(200)]
    pages = spark.createDataFrame([(k, u, h) for k, (u, h) in enumerate(rows)], "page_id long, url string, html string")
    found = wrappers.infer_wrappers(pages).collect()
    assert [(r.host, r.n) for r in found] == [("big.example", 200)]
    got = extract(spark, rows)
    assert got[0] == "tail 0" and got[3] == "3p\n\n3ul\n\ntail 3" and not any("same line" in t for t in got.values())


def node(text):
    return wrappers.shape(parse(text))[2]


def test_alignment_makes_slots_options_and_repeats():
    a, b = node("<h2>x</h2><p>same</p>"), node("<h2>y</h2><div>z</div><p>same</p><p>q</p>")
    found = wrappers.aligned(a, b)
    assert [(n[0], n[1]) for n in found] == [("h2", "1"), ("div", "?"), ("p", "+")]
    assert found[0][2] == [["#", "1", []]]
    assert wrappers.aligned(found, a) == wrappers.aligned(found, found) or wrappers.aligned(found, a)[1][1] == "?"
    assert [(n[0], n[1]) for n in wrappers.fold(node("<ul><li>a<li>b<li>c</ul>")[0][2])] == [("li", "+")]


def test_plain_text():
    assert plain(" a\n\tb&nbsp;c &amp;lt; ") == "a b c &lt;"
