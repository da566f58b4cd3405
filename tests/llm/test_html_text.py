import pytest

from attestry.llm import html_text as H

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="has-sidebar">
<header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a></li></ul></nav><div class="cookie-notice">We use cookies</div>
%s
<aside>More</aside><section id="comments"><p>First!</p></section><form><p>Name</p><input></form><script>var a="</p>";</script><footer>&copy; x</footer></body></html>"""


@pytest.mark.parametrize("page, text", [
    (None, ""), ("", ""), ("<p>", ""), ("plain  words", "plain words"), ("a < b", "a < b"), ("<p>one<p>two", "one\ntwo"), ("<div>a<br>b</div>", "a\nb"),
    ("<p>a&nbsp;&amp;\n <b>b</b>c</p>", "a & bc"), ("<ul><li>x<li>y</ul>", "x\ny"), ("<p title='a>b'>t</p>", "t"), ("<p>cut off <b", "cut off"), ("<p>cut &am", "cut &am"),
    ("<!-- <p>no</p> --><p>yes</p>", "yes"), ("<p hidden>no</p><p>yes</p>", "yes"), ("<p style='display: none'>no</p><p>yes</p>", "yes"), ("<script>x</script>", ""), ("<script>never closed <p>x", ""),
    (PAGE % "<article><h1>Title</h1><p>Body &eacute;.</p><div class='ad'>Buy</div><p>End<br></article>", "Title\nBody é.\nEnd"),
    (PAGE % "<main><p>Short</p></main>", "Short"),
    (PAGE % "<div><p>No article but a long enough paragraph of text here.</p><p>And another one that belongs to it.</p></div>", "No article but a long enough paragraph of text here.\nAnd another one that belongs to it."),
    (PAGE % "<article><h1>A</h1><p><b>bold<br><p>next</p></article>", "A\nbold\nnext"),
    (PAGE % "<article class='post'><p>Text</p><div class='comments'><article><p>Reader</p></article></div></article>", "Text"),
    (PAGE % "<article></article>", ""),
])
def test_main_text(page, text):
    assert H.main_text(page) == text


def test_links_weigh_little():
    links = "<div>" + "".join(f"<a href=/{i}>link number {i} of a long list of links</a> " for i in range(30)) + "</div>"
    body = "<div>" + "".join(f"<p>Sentence {i} of a real paragraph, which goes on for some while without any link.</p>" for i in range(8)) + "</div>"
    text = H.main_text(f"<body>{links}{body}</body>")
    assert text.startswith("Sentence 0") and "link number" not in text and text.count("\n") == 7


def test_deep_and_long_pages():
    assert H.main_text("<div>" * 5_000 + "x" + "</div>" * 5_000) == "x"
    assert len(H.main_text("<p>" + "word " * 200_000 + "</p>")) == 999_999


def test_query(spark):
    rows = [(1, "u", "<p>a</p>", "c"), (1, "u", "<p>a</p>", "c"), (2, None, None, "c")]
    got = H.extracted(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert sorted(map(tuple, got), key=repr) == [(1, "u", "a", 1), (1, "u", "a", 1), (2, None, "", 0)]
    assert H.extracted(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_articles_of_the_sample_are_whole(spark, sample):
    """Pages are made of documents; every page's text has to be one, title apart."""
    docs = {" ".join(r["text"].split()) for r in spark.read.parquet(f"{sample}/documents.parquet").collect()}
    for r in H.op3(spark, sample).collect():
        body = r["text"].partition("\n")[2]
        assert {" ".join(r["text"].split()), " ".join(body.split())} & docs, r["page_id"]


def paragraphs(name, n=8):
    return "".join(f"<p>{name} {i} is a real paragraph, which goes on for some while without any link.</p>" for i in range(n))


TEASER = "<article><h2>Card</h2><p>Teaser.</p></article>"


@pytest.mark.parametrize("page, inside, outside", [
    (f"{TEASER}<div id='content'>{paragraphs('Body')}</div>", ["Body 0", "Body 7"], ["Teaser"]),
    (f"<main><article>{paragraphs('First')}</article><article>{paragraphs('Second', 6)}</article></main>", ["First 0", "First 7", "Second 0", "Second 5"], []),
    (f"<div class='with-sidebar'><article>{paragraphs('Body')}</article><div class='sidebar'><p>Rail</p></div></div>", ["Body 0", "Body 7"], ["Rail"]),
    (f"<main><div class='layout no-ads'><article>{paragraphs('Body')}</article></div></main>", ["Body 0", "Body 7"], []),
    (f"<div class='page-header-fixed'>{paragraphs('Body')}</div>{TEASER}", ["Body 0", "Body 7"], []),
    (f"<article class='comments-open'>{paragraphs('Body')}</article>", ["Body 0", "Body 7"], []),
    (f"<article>{paragraphs('Body', 3)}</article><div class='comments'>{paragraphs('Reader', 20)}</div>", ["Body 2"], ["Reader"]),
    (f"<main>{paragraphs('Body')}<div class='related'>{TEASER}</div></main>", ["Body 7"], ["Teaser"]),
])
def test_density_decides_over_the_whole_body(page, inside, outside):
    text = H.main_text(PAGE % page)
    assert all(x in text for x in inside) and not any(x in text for x in [*outside, "cookies", "Home"])


@pytest.mark.parametrize("page, text", [
    ("<article><p>Before text here.</p><svg/><p>After more text here.</p></article>", "Before text here.\nAfter more text here."),
    ("<article><p>Before text here.</p><math/><p>After more text here.</p></article>", "Before text here.\nAfter more text here."),
    ("<article><p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn></math> be so.</p><svg><title>t</title><path d=x><p>After the drawing.</p></article>", "Let x=1 be so.\nAfter the drawing."),
    ("<article><h1 class='entry-header'>Title here</h1><p>A paragraph of the text.</p></article>", "Title here\nA paragraph of the text."),
    ("<article><div class='content header-note'><p>A note on the text.</p></div><p>A paragraph of the text.</p></article>", "A note on the text.\nA paragraph of the text."),
    ("<article><div class='share-price-table'>12.50 today</div><p>A paragraph of the text.</p></article>", "12.50 today\nA paragraph of the text."),
    ("<article><section class='related'><p>Related work is this.</p></section><p>A paragraph of the text.</p></article>", "Related work is this.\nA paragraph of the text."),
    ("<article><p>A paragraph of the text.</p><ul class='related'><li><a href=a>one</a><li><a href=b>two</a></ul></article>", "A paragraph of the text."),
    ("<article><p>A paragraph of the text.</p><section class='user-feedback'><p>Nice read!</p></section></article>", "A paragraph of the text."),
    ("<article><p>A paragraph of the text.</p><div class='ad-slot ad-300x250'>Buy now</div></article>", "A paragraph of the text."),
    ("<p>x &<i>gt;</i> y &amp;gt; z</p>", "x &gt; y &gt; z"),
    ("<p>one<a href=x>two<p>three</p>", "onetwo\nthree"),
    ("<table><tr><td>a<td>b<tr><td>c</table>", "a\nb\nc"),
    ("<body><form id='whole'><article><p>A paragraph of the text.</p></article><label>Name</label></form></body>", "A paragraph of the text."),
])
def test_probes(page, text):
    assert H.main_text(page) == text


def test_time_is_linear_in_depth():
    import time

    for page in ("<article>" * 30_000 + "x y" + "</article>" * 30_000, "<b>" * 30_000 + "<h1></h1>" * 30_000 + "</i>" * 30_000 + "x y", "<div><a href=x>" * 30_000 + "x y", "<table><tr><td><li>" * 30_000 + "x y"):
        began = time.perf_counter()
        assert H.main_text(page) in ("x y", "")
        assert time.perf_counter() - began < 6


def plain_density(root):
    """Densities by counting each subtree anew, from the formula; and the main nodes that follow from them."""
    import math

    def walk(n):
        yield n
        for x in n.items:
            if not isinstance(x, str):
                yield from walk(x)

    def chars(n, link=None):
        inside = link if link is not None else True
        out = 0
        for x in n.items:
            if isinstance(x, str):
                out += len("".join(x.split())) if inside else 0
            else:
                out += chars(x, None if link is None else link or x.tag == "a")
        return out

    body = next((x for x in walk(root) if x.tag == "body"), root)
    one = lambda v: v or 1

    def density(n):
        c, lc = chars(n), chars(n, n.tag == "a")
        if not c:
            return 0.0
        t, lt = one(sum(1 for _ in walk(n)) - 1), one(sum(x.tag == "a" for x in walk(n)) - (n.tag == "a"))
        x = c / one(c - lc) * one(lc) + chars(body, body.tag == "a") / one(chars(body)) * c + math.e
        return c / t * math.log(c / one(lc) * t / lt, math.log(x))

    if not chars(body):
        return []
    value = {x: max(density(x), sum(density(k) for k in x.items if not isinstance(k, str))) for x in walk(body)}
    best = max(walk(body), key=value.get)
    path = [best]
    while path[-1] is not body:
        path.append(path[-1].parent)
    least = min(density(x) for x in path[:-1] or path)
    found = [x for x in walk(body) if x is not body and chars(x) and density(x) >= least - 1e-9]
    above = lambda x: [] if x.parent is None else [x.parent, *above(x.parent)]
    tops = [x for x in found if not set(above(x)) & set(found)]
    return [body] if best is body or not tops else tops


def test_density_is_the_formula():
    import random

    rng = random.Random(4)

    def block(depth):
        if depth == 0 or rng.random() < 0.3:
            return " ".join("w" * rng.randint(1, 9) for _ in range(rng.randint(1, 25)))
        tag = rng.choice(("div", "p", "section", "article", "span", "b", "a href=x", "ul", "li", "td"))
        return f"<{tag}>" + "".join(block(depth - 1) for _ in range(rng.randint(1, 4))) + f"</{tag.split()[0]}>"

    for _ in range(300):
        root = H.parse("<body>" + "".join(block(4) for _ in range(rng.randint(1, 4))) + "</body>")
        H.prune(root)
        assert H.main_nodes(root) == plain_density(root)
