import json

import pytest

from quadrangle.llm import html_text as H

PAGE_SCHEMA = "page_id long, url string, html string"


def page(title, paras, extra="", inside="", close="</article>"):
    body = "".join(f"<p>{p}</p>" for p in paras)
    return (f"<!DOCTYPE html><html><head><title>{title}</title><style>p{{}}</style><script>var t=\"</p><p>no\";</script></head><body>"
            f"<header><a href='/'>Site</a></header><nav><ul><li>Home</li><li>News</li></ul></nav>{extra}"
            f"<article><h1>{title}</h1>{body}{inside}{close}<div class=\"comments\"><p>First!</p></div><footer>&copy; site</footer></body></html>")


@pytest.fixture
def table(spark):
    return lambda rows: spark.createDataFrame(rows, PAGE_SCHEMA)


def texts(df):
    return {r.page_id: (r.text, r.n_chars) for r in H.html_text(df).collect()}


def test_boilerplate_goes_and_the_article_stays(table):
    rows = [
        (1, "https://a.example/1", page("One &amp; only", ["first  <b>bold</b>\n para", "AT&amp;T &eacute; &#233; &lt;b&gt;"])),
        (2, "https://a.example/2", page("Two", ["x"] * 5, extra="<div class='ad'>Buy</div><div id='cookie-notice'><p>Cookies</p></div>")),
        (3, "https://a.example/3", page("Three", [], inside="<aside><p>see also</p></aside><form><p>mail</p></form><p>end<br>here")),
        (4, "https://a.example/4", page("Four", ["last <i>one"], close="")),
        (5, "https://b.example/", "<html><body><div class='sidebar'><p>side</p></div><div class=content><p>main text</p><p>more</p></div><script>bad</script></body></html>"),
        (6, "https://b.example/x", "<html><body><div class=content><p>other</p><div class='share-buttons'><p>share</p></div></div></body>"),
    ]
    got = texts(table(rows))
    assert got[1][0] == "One & only\n\nfirst bold para\n\nAT&T é é <b>"
    assert got[2][0] == "Two" + "\n\nx" * 5
    assert got[3][0] == "Three\n\nend here"
    assert got[4][0].startswith("Four\n\nlast one")
    assert got[5][0] == "main text\n\nmore" and got[6][0] == "other"
    assert all(n == len(t) for t, n in got.values())


def test_odd_pages(table, spark):
    rows = [(1, None, None), (2, "no host", ""), (3, "http://h.example", "plain words  only"), (None, "http://h.example", "<p>a</p><p>"), (5, "http://H.example/x", "<script>"),
            (5, "http://H.example/x", "<script>"), (6, "http://h.example", "<p>" + "long " * 100_000 + "</p>"), (7, "http://h.example", "1 < 2 &am <p attr='>'>x</p> <!-- c"), (8, "http://z.example", "<nav>menu</nav>")]
    from pyspark.sql import functions as F

    for df in (table(rows), table(rows).withColumn("host", F.lit("x")).withColumn("paths", F.lit("y")).withColumn("text", F.lit("z"))):
        got = {}
        for r in H.html_text(df).collect():
            got.setdefault(r.page_id, []).append(r.text)
        assert got[1] == [""] and got[2] == [""] and got[3] == ["plain words only"] and got[None] == ["a"]
        assert got[5] == ["", ""] and got[6] == [" ".join(["long"] * 100_000)] and got[7] == ["1 < 2 &am\n\nx"] and got[8] == [""]
    assert H.html_text(table([])).collect() == []


def test_joined_wrappers_equal_sent_ones(table, monkeypatch):
    rows = [(i, f"http://h{i % 3}.example/{i}", page(f"T{i}", ["p"] * (i % 4))) for i in range(12)]
    sent = texts(table(rows))
    monkeypatch.setattr(H, "SENT_BYTES", -1)
    assert texts(table(rows)) == sent


def test_repeats_fold_and_shapes_merge():
    assert H.fold(["#", "h2", "p", "h2", "p", "h2", "p", "li"]) == ["#", ["+", ["h2", "p"]], "li"]
    assert H.fold(["li", "li", "li"]) == [["+", ["li"]]]
    a = H.fold(H.tree(["nav", "li", "li", "/nav", "article", "p", "/article"]))
    b = H.fold(H.tree(["nav", "li", "/nav", "div.ad", "#", "/div", "article", "p", "p", "/article"]))
    w = H.merge(a, b)
    assert w == [["<", "nav", [["+", ["li"]]]], ["?", [["<", "div.ad", ["#"]]]], ["<", "article", [["+", ["p"]]]]]
    assert H.merge(w, a) == w and H.merge(w, b) == w
    assert json.loads(json.dumps(w)) == w
    assert H.main_paths(w) == ["article"]
    # containers of one token repeat whatever is in them
    assert H.fold(H.tree(["div.x", "p", "/div", "div.x", "p", "li", "/div"])) == [["+", [["<", "div.x", ["p", ["?", ["li"]]]]]]]


def test_templates_of_one_host_each_keep_their_text(table):
    """A host (or the pages without one) whose pages are of several templates."""
    kinds = ["<article><h1>T{i}</h1><p>a{i}</p></article>", "<div class=content><h1>T{i}</h1><p>a{i}</p></div>", "<h1>T{i}</h1><p>a{i}</p>", "<main><h1>T{i}</h1><p>a{i}</p></main>",
             "<div class='content-side sidebar'><article><h1>T{i}</h1><p>a{i}</p></article></div>", "<form id=form1><article><h1>T{i}</h1><p>a{i}</p></article></form>"]
    rows = []
    for i in range(36):
        body = kinds[i % 6].format(i=i)
        rows.append((i, ("http://m.example/x", None, "no host")[i // 12], f"<body><nav><p>menu</p></nav>{body}<div class=comments><article><p>c</p></article></div><footer>f</footer></body>"))
    got = texts(table(rows))
    # the brute-force result: what was planted
    assert {i: t for i, (t, _) in got.items()} == {i: f"T{i}\n\na{i}" for i in range(36)}


def test_malformed_pages_keep_the_rest():
    """Each opened element without its end tag, alone and before a whole one."""
    article = "<article><p>one</p><p>two</p></article>"
    for tag in ("button", "select", "object", "noscript", "template", "iframe", "title", "textarea"):
        for page in (f"<div><{tag}>x</div>{article}", f"<{tag}>x{article}", f"<div><{tag}>x</div>{article}<div><{tag}>y</{tag}></div>"):
            kept = [t for k, t in H.tokens(page) if k == "p"]
            assert kept == ["one", "two"], page
        assert H.tokens(f"<p>a <{tag}><b>x</b></{tag}>b") == [("p", "a b")]
    assert H.tokens("<object><object>x</object>y</object><p>a")[-1] == ("p", "a")
    for page in ("<p><a title=Bob's>one</a></p><p>it's <b id=x>two</b></p>", "<p><a title=5\" x>one</a></p><p>say \"<b>two</b></p>", "<p class=a' >one</p><p>'two</p>"):
        assert [" ".join(t.split()).strip("'\"") for _, t in H.tokens(page)][0] == "one" and "two" in H.tokens(page)[-1][1], page
    assert H.tokens("<p x = 'a>b' y=\">\">t</p>") == [("p", "t")]


def test_constant_slots_go_and_varying_ones_stay(table, monkeypatch):
    """Boilerplate in containers of no telling name; copies of an article."""
    line, rows, want = "Subscribe to us", [], {}
    for i in range(24):
        own = f"title {i}\n\nfirst {i} of the host\n\nsecond {i}"
        parts = own.split("\n\n")
        body = f"<div class=x7><p>{line}</p></div><h1>{parts[0]}</h1><p>{parts[1]}</p><p>{line}</p><p>{parts[2]}</p>"
        rows.append((i, f"http://s{i % 2}.example/{i}", f"<body>{'<article>' + body + '</article>' if i % 4 < 2 else body}</body>"))
        want[i] = own
    for i in range(100, 140):  # copies and near copies are no template
        rows.append((i, "http://c.example/", f"<article><h1>t</h1><p>the long paragraph of all of them</p><p>another one</p><p>{'x' if i % 2 else i}</p></article>"))
        want[i] = f"t\n\nthe long paragraph of all of them\n\nanother one\n\n{'x' if i % 2 else i}"
    got = texts(table(rows))
    assert {i: t for i, (t, _) in got.items()} == want
    monkeypatch.setattr(H, "SENT_BYTES", -1)
    assert texts(table(rows)) == got
