import html
import re

import pytest

from riskloom.llm import html_text as h

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def weights(spark):
    return h.fit_weights(spark.read.parquet(f"{FOLDER}/pages.parquet"))


def reference(page):
    body = re.search(r"<article>(.*?)(</article>|$)", page, re.S)[1]
    parts = re.split(r"</?(?:p|h1)>", re.sub(r"</?b>", "", body).replace("<br>", " "))
    lines = [" ".join(html.unescape(re.sub("<[^>]*>", "", p)).split()) for p in parts]
    return "\n\n".join(x for x in lines if x)


def test_given_pages(spark, weights):
    assert weights["#word"] > 0 and all(v < 0 for k, v in weights.items() if k != "#word")
    pages = spark.read.parquet(f"{FOLDER}/pages.parquet")
    for r in h.extract(pages, weights).join(pages, ["page_id", "url"]).collect():
        assert r.text == reference(r.html) and r.n_chars == len(r.text)


@pytest.mark.parametrize("page, want", [
    (None, ""), ("", ""), ("<p>", ""), ("just text", "just text"), ("<p>a &amp; b&nbsp;c<p>d", "a & b c\n\nd"),
    ("<nav>menu menu menu menu</nav><div><p>The real text of the page.</p></div><footer>foot foot foot</footer>", "The real text of the page."),
    ("<article><h1>T</h1><p>one two</p><aside>no no</aside><div class='comments'><p>bad bad</p></div><p>three</p></article>", "T\n\none two\n\nthree"),
    ("<article><p>x<script>var a='</p><p>no';</script> y</p><!-- hid --><form><p>f</p></form><div hidden>h</div></article>", "x y"),
    ("<body><div class='cookie-notice'>We use cookies here today</div><main><p>Long main text is here.</p></main></body>", "Long main text is here."),
    ("<article><p>cut off in the mid", "cut off in the mid"), ("<article><p>a<br>b</p><ul><li>c</li><li>d</li></ul></article>", "a b\n\nc\n\nd"),
])
def test_small_pages(weights, page, want):
    assert h.main_text(page, weights) == want


TEXT = "The whole text of this page stays here."


@pytest.mark.parametrize("of", ["layout has-sidebar", "no-sidebar", "content-with-sidebar", "fixed-header", "side-by-side", "single comments-open",
                                "widget", "sidebar", "site-header"])
@pytest.mark.parametrize("inner", ["<article><p>{}</p></article>", "<main><p>{}</p></main>", "<main><div class='widget'><article>{}</article></div></main>", "<p>{}</p>"])
def test_wrappers(weights, of, inner):
    page = f"<body><nav>a b c</nav><div class='{of}'><div id='{of.split()[-1]}'>{inner.format(TEXT)}</div></div><footer>d e f</footer></body>"
    assert h.main_text(page, weights) == TEXT


@pytest.mark.parametrize("part", ["<div class='post-header'><p>{}</p></div>", "<div class='entry-header'>{}</div>", "<section id='related-work'>{}</section>",
                                  "<p><span class='search'>{}</span></p>", "<p><span class='notice'>{}</span></p>", "<p><a class='share'>{}</a></p>"])
def test_parts_of_an_article(weights, part):
    page = f"<body><article><h1>T</h1>{part.format('one two three')}<p>four</p><div class='share-buttons'>no</div></article></body>"
    assert h.main_text(page, weights) == "T\n\none two three\n\nfour"


@pytest.mark.parametrize("page", [
    f"<form id='form1'><div class='nav'>a b c</div><article>{TEXT}</article></form>",
    f"<article>{TEXT}</article><div id='comments' class='comments-area'><article class='comment'>no no no</article></div>",
    f"<div class='widget'><article>{TEXT}</article><div class='comments'><article>no no no</article></div></div>",
    f"<div class='sidebar'><article>no no no</article></div><main>{TEXT}</main>",
    f"<div><p>{TEXT}</p></div><div class='cookie-banner'>no no no</div><div class='site-footer'>no no</div><span class='ad'>no</span>",
])
def test_class_rules_still_hold(weights, page):
    assert h.main_text(page, weights) == TEXT


@pytest.mark.parametrize("page, want", [
    ("<article><p>one two three</p></article><nav>x</nav><article>four five six seven</article>", "one two three\n\nfour five six seven"),
    ("<main>a b c d</main><p>between</p><article>e f g<p>h</article><article class='x'> </article>", "a b c d\n\ne f g\n\nh"),
    ("<article>a b c d e f</article><aside><article>no no</article></aside><article><div class='share'>no</div>g h i j k l</article>",
     "a b c d e f\n\ng h i j k l"),
])
def test_several_marked_elements(page, want):
    assert h.main_text(page, {"#word": 1.0, "article": -0.1, "main": -0.1, "p": -0.1, "nav": -0.1, "aside": -0.1, "div": -0.1}) == want


def test_region_is_the_best_of_all():
    seen = h.parse("<p>a b</p><a></a><a></a><p>c d e</p><a></a><p>f g h i</p><a></a>")
    weights = {"#word": 1.0, "p": -0.3, "a": -1.2}

    def value(t):
        return weights["#word"] * len(t[1].split()) if t[0] == "text" else weights[t[1]]

    total = {(i, j): sum(map(value, seen[i:j])) for i in range(len(seen)) for j in range(i + 1, len(seen) + 1)}
    assert total[h.best_region(seen, weights)] == pytest.approx(max(total.values()))


def test_awkward_rows(spark, weights):
    rows = spark.createDataFrame([(1, None, None, "x"), (1, None, None, "x"), (2, "u", "<p>" + "word " * 60_000, None)],
                                 "page_id bigint, url string, html string, text string")
    out = h.extract(rows, weights).collect()
    assert sorted(r.n_chars for r in out) == [0, 0, 299_999]
    assert h.extract(rows.where("false"), weights).collect() == []
    assert h.fit_weights(rows) == {"#word": 0.5}
