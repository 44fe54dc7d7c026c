import pytest

from stemma.sources import html_tree as H

PAGE = """<title>T &amp; U</title><script>var a = "<h1>no</h1>"</script><h2 class=x>Head <i>line</i></h2><p>one<p>two<br>three
<div><a href="/x?a=1&amp;b=2">go</a><a name=here>anchor</a><img src="i.png" alt="a cat"></div><pre><code class="hl language-py">x = 1
 y = 2</code></pre>use <code>f()</code><math><mi>z</mi></math><ul><li>1<li>2<ul><li>3</ul></ul>
<table><caption>Cap
 tion</caption><thead><tr><th rowspan=2>a<th colspan=2>b</thead><tr><td>c<td>d|e<tr><td>f<td rowspan=0>g<td><table><tr><td>in</table><tr><td>h</table>"""


@pytest.fixture(scope="module")
def tree(spark):
    rows = [(1, PAGE, "x"), (2, None, "y"), (3, "", "y"), (4, "</div>plain <b>text", "z"), (5, "<tr><td>loose", "z"), (6, "<table><tr><td rowspan=3 colspan=oops>a<td>b</table>", "z")]
    return H.trees(spark.createDataFrame(rows, "page_id long, html string, text string"))


def test_objects(tree):
    got = [tuple(r) for r in H.objects(tree).where("page_id = 1").orderBy("node").select("kind", "level", "text", "target", "language", "caption").collect()]
    assert [g for g in got if g[0] not in ("item", "table")] == [
        ("heading", 2, "Head line", None, None, None), ("paragraph", None, "one", None, None, None), ("paragraph", None, "two three", None, None, None),
        ("link", None, "go", "/x?a=1&b=2", None, None), ("image", None, "a cat", "i.png", None, None),
        ("code", None, "x = 1\n y = 2", None, "py", None), ("code", None, "f()", None, None, None), ("formula", None, "z", None, None, None),
    ]
    assert [g[2] for g in got if g[0] == "item"] == ["1", "2 3", "3"]
    assert [g[5] for g in got if g[0] == "table"] == ["Cap tion", None]


def test_grid(tree):
    cells = H.cells(tree)
    outer = cells.where("page_id = 1").agg({"table": "min"}).first()[0]
    grid = {(r["row"], r["col"]): r["text"] for r in H.grid(cells.where(f"page_id = 1 AND table = {outer}")).collect()}
    assert grid == {(0, 0): "a", (0, 1): "b", (0, 2): "b", (1, 0): "a", (1, 1): "c", (1, 2): "d|e", (2, 0): "f", (2, 1): "g", (2, 2): "in", (3, 0): "h", (3, 1): "g"}
    assert {r["text"] for r in cells.where("page_id = 1 AND header").collect()} == {"a", "b"}
    assert [tuple(r) for r in cells.where("page_id = 6").select("row", "col", "rowspan", "colspan", "text").orderBy("col").collect()] == [(0, 0, 1, 1, "a"), (0, 1, 1, 1, "b")]
    assert cells.where("page_id IN (2, 3, 4, 5)").count() == 0
    md = H.markdown(cells, "page_id").where(f"page_id = 1 AND table = {outer}").first()
    assert (md["rows"], md["columns"]) == (4, 3)
    assert md["markdown"].split("\n") == ["| a | b | b |", "| --- | --- | --- |", "| a | c | d\\|e |", "| f | g | in |", "| h | g |  |"]


def test_odd_pages(tree):
    n = {r["page_id"]: r["n"] for r in tree.selectExpr("page_id", "size(elements) AS n").collect()}
    assert n[2] == n[3] == 0 and n[4] == 1
    assert H.elements(tree).where("page_id = 4").select("tag", "parent").collect() == [("b", None)]


def test_long_page_in_proportion():
    import time

    t = time.time()
    e = H.parse("<p>a b" * 100_000 + "<div>" * 3_000 + "x")
    assert len(e) == 103_000 and time.time() - t < 20


def test_pages_are_parsed_once_and_given_out_in_small_batches(spark, monkeypatch):
    """A page is parsed once however its elements are used, and a batch holds few elements."""
    monkeypatch.setattr(H, "BATCH_ELEMENTS", 30)
    seen = spark.sparkContext.accumulator(0)
    parse = H.parse

    def counted(html):
        seen.add(1)
        return parse(html)

    monkeypatch.setattr(H, "parse", counted)
    pages = spark.createDataFrame([(i, None if i == 7 else f"<p class=c{i}>" * (i % 5) + "<h1>x</h1>") for i in range(100)], "page long, html string")
    got = H.objects(H.trees(pages)).groupBy("page", "kind").count().collect()
    assert seen.value == 100
    want = {(i, "heading"): 1 for i in range(100) if i != 7} | {(i, "paragraph"): i % 5 for i in range(100) if i != 7 and i % 5}
    assert {(r.page, r.kind): r["count"] for r in got} == want


def general(html):
    to = H._Builder()
    reader = H._Reader(to)
    reader.feed(html)
    reader.close()
    return [e[:14] for e in to.finish()]


def test_plain_pages_are_cut_at_once_as_the_general_reader_would(monkeypatch):
    import random

    tags = "table tr td th caption p div ul li b a img br h1 pre code".split()
    odd = ["<!-- <p> -->", "<script>a<b</script>", "< ", '<a title="x>y">', '<a b= "c>', "</ p>", "<p/>", "<b", "<title>t</title>", "<a\rb>", "<td rowspan=2>", "<TD COLSPAN='3'>", "<a href=x b>", "&lt", "1 > 0", "&eacute;"]
    rng, plain = random.Random(1), 0
    for k in range(3000):
        parts = [rng.choice([f"<{rng.choice(tags)}>", f"</{rng.choice(tags)}>", "a b", "|", rng.choice(odd[-6:] if k % 2 else odd)]) for _ in range(rng.randrange(1, 20))]
        page = "".join(parts)
        plain += H._read_plain(page) is not None
        assert [e[:14] for e in H.parse(page)] == general(page)
    assert plain > 1500
    page = "<table><caption>Items</caption><tr><th>a<th>b<tr><td colspan='2'>1 &amp; 2</table>"
    want = general(page)
    H.parse(page)

    def never(*_):
        raise AssertionError("a page of known plain tags goes through the general reader")

    monkeypatch.setattr(H.HTMLParser, "goahead", never)
    assert [e[:14] for e in H.parse(page)] == want
