import numpy as np
from corpora import say
from pyspark.sql import functions as F

from stemma.llm import html_blocks as hb

BODY = "<p>{}</p>"


def page(rng, kind):
    """A page in one of several layouts, and its main text."""
    head = "<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var a='</p><p>no';</script></head><body>"
    menu = "<ul><li><a href=/a>the in</a></li><li><a href=/b>of to</a></li><li><a href=/c>by at</a></li></ul>"
    paras = [say(rng, "en", int(rng.integers(25, 60))).capitalize() + "." for _ in range(int(rng.integers(2, 6)))]
    title = say(rng, "en", 5).capitalize()
    inside = f"<h1>{title}</h1>" + "".join(f"<p>{p}</p>" for p in paras)
    foot = "&copy; all of it"
    note = "We use cookies on this site."
    if kind == "article":
        html = f"{head}<nav>{menu}</nav><div class='ad'>{note}</div><article>{inside}</article><footer>{foot}</footer></body></html>"
    elif kind == "main":
        html = f"{head}<header>{menu}</header><main>{inside}</main><aside class=sidebar><p>{note}</p></aside><footer>{foot}"
    else:
        html = (
            f"{head}<div id=nav>{menu}</div><div class=cookie-notice>{note}</div><div class='post-content'>{inside}</div>"
            f"<section class=comments><p>{say(rng, 'en', 9)}</p><p>{say(rng, 'en', 12)}</p></section><form><p>{say(rng, 'en', 3)}</p><input><button>go</button></form><div id=footer>{foot}</div></body>"
        )
    return html, "\n".join([title, *paras])


def test_parse_blocks():
    html = "<body><!-- <p>x</p> --><p class='a b'>one &amp; <b>two</b><br>three\n four<p id=q>five <a href='x>y'>link</a> &am<script>if(a<b)</script><div>six &lt;&bogus; 1 < 2</div>tail</body>"
    got = [(b.path, b.text) for b in hb.parse(html)]
    assert [t for _, t in got] == ["one & two three four", "five link &am", "six <&bogus; 1 < 2", "tail"]
    assert [b.text for b in hb.parse("<p><a title='never closed>text</a> more</p><p id=\"x>y\">z</p>")] == ["text more", "z"]
    assert got[0][0][-1] == "p.a.b" and got[1][0][-1] == "p.q"
    assert abs(hb.parse("<p>ab <a>cd</a></p>")[0].linked - 0.4) < 1e-9
    assert hb.parse(None) == [] and hb.parse("") == [] and hb.parse("<p>\n \t</p>") == []
    assert [b.text for b in hb.parse("a<unclosed")] == ["a"] and [b.text for b in hb.parse("<script>never closed <p>x</p>")] == []


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    m = hb.Labeller(1)
    m.p = {k: v.astype(float) for k, v in m.p.items()}
    x = rng.normal(size=(2, 4, hb.DIMS))
    mask = np.array([[1, 1, 1, 1], [1, 1, 0, 0]], float)
    y, used = rng.integers(0, 2, (2, 4)).astype(float), mask.copy()

    def loss():
        p = m.forward(x, mask)[0]
        return -((y * np.log(p) + (1 - y) * np.log(1 - p)) * used).sum() / used.sum()

    grad = m.step(x, mask, y, used)
    for k, v in m.p.items():
        at = tuple(int(rng.integers(s)) for s in v.shape)
        keep, e = v[at], 1e-4
        v[at] = keep + e
        up = loss()
        v[at] = keep - e
        down = loss()
        v[at] = keep
        assert abs((up - down) / (2 * e) - grad[k][at]) < 2e-3 * max(1, abs(grad[k][at])), k


def test_layouts_and_odd_pages(spark):
    rng = np.random.default_rng(7)
    kinds = ["article", "main", "plain"]
    pages = [page(rng, kinds[i % 3]) for i in range(150)]
    odd = [(900, None), (901, ""), (902, "<script>x</script>"), (903, pages[0][0]), (903, pages[0][0]), (904, "<article>" + "<p>the of and to in is.</p>" * 4000 + "</article>")]
    rows = [(i, "u", h, "old") for i, (h, _) in enumerate(pages)] + [(i, "u", h, "old") for i, h in odd]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    out = hb.extract(df, hb.fit(df)).collect()
    got = {r.page_id: r for r in out}
    right = sum(got[i].text == want for i, (_, want) in enumerate(pages))
    assert right >= 0.97 * len(pages), right
    assert all(r.n_chars == len(r.text) for r in out) and len(out) == len(rows)
    assert got[900].text == got[901].text == got[902].text == "" and got[903].text == pages[0][1] and got[904].text.count("\n") == 3999
    assert hb.extract(df.limit(0), hb.fit(df.limit(0))).count() == 0 and set(df.columns) - {"html"} <= set(out[0].asDict())


def test_unseen_layout_is_labelled_from_its_context(spark):
    """Fitted on one layout only, the network still reads pages in other clothes."""
    rng = np.random.default_rng(8)
    model = hb.fit_labeller([page(rng, "article")[0] for _ in range(150)])
    tests = [page(rng, "plain") for _ in range(60)]
    share = []
    for (_, want), p, blocks in zip(tests, model.label([hb.parse(h) for h, _ in tests]), [hb.parse(h) for h, _ in tests]):
        main = set(want.split("\n"))
        share += [(q >= 0.5) == (b.text in main) for b, q in zip(blocks, p)]
    assert np.mean(share) > 0.95


def test_words_after_the_twelfth_tell():
    """Blocks of equal length that begin with the same twelve words and have the same path."""
    rng = np.random.default_rng(9)
    start = say(rng, "en", 12)
    notice = "cookies partners settings privacy accept consent manage choices".split()

    def blocks(n):
        kinds = [int(rng.random() < 0.6) for _ in range(n)]
        return kinds, [f"{start} {say(rng, 'en', 12) if k else ' '.join(rng.choice(notice, 12))}." for k in kinds]

    pages = []
    for _ in range(120):
        kinds, texts = blocks(8)
        pages.append("<body>" + "".join(f"<article><p>{t}</p></article>" if k else f"<div class=notice><p>{t}</p></div>" for k, t in zip(kinds, texts)) + "</body>")
    model = hb.fit_labeller(pages)
    right = []
    for _ in range(40):
        kinds, texts = blocks(8)
        p = model.label([hb.parse("<body>" + "".join(f"<div><p>{t}</p></div>" for t in texts) + "</body>")])[0]
        right += [(q >= 0.5) == k for q, k in zip(p, kinds)]
    assert np.mean(right) > 0.95, np.mean(right)
    a, b = hb.vectors([hb.Block(("p",), f"{start} one", 0.0), hb.Block(("p",), f"{start} two", 0.0)])[:, hb.PATH_DIMS : hb.PATH_DIMS + hb.WORD_DIMS]
    assert (a != b).any()


def test_roles_far_above_a_block_tell():
    """Comments in nested lists and articles inside many wrappers, with like texts."""
    rng = np.random.default_rng(10)
    deep = lambda n, inner: "<ol><li>" * n + inner + "</li></ol>" * n
    wrapped = lambda n, inner: "".join(f"<div class={w}>" for w in (["row", "col", "box", "grid", "inner"] * n)[:n]) + inner + "</div>" * n

    def made():
        say_p = lambda: f"<p>{say(rng, 'en', 20)}.</p>"
        parts = [(1, f"<article>{wrapped(int(rng.integers(6, 14)), say_p() + say_p())}</article>"), (0, f"<section class=comments>{deep(int(rng.integers(4, 9)), say_p())}</section>")]
        parts += [(0, f"<div class=sidebar>{wrapped(int(rng.integers(6, 14)), say_p())}</div>")]
        parts = [parts[i] for i in rng.permutation(3)]
        return "<body>" + "".join(h for _, h in parts) + "</body>", [k for k, h in parts for _ in range(h.count("<p>"))]

    model = hb.fit_labeller([made()[0] for _ in range(150)])
    right = []
    for _ in range(60):
        html, kinds = made()
        right += [(q >= 0.5) == k for q, k in zip(model.label([hb.parse(html)])[0], kinds)]
    assert np.mean(right) > 0.95, np.mean(right)
    tail = ("ol", "li") * 4
    assert (hb._path_vector(("body", "section.comments", *tail)) != hb._path_vector(("body", "article", *tail))).any()
