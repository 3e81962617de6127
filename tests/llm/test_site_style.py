"""Main text of pages: markup that is easily lost, names and trees as one score, and a count of what the trees decide."""

import pytest
from pyspark.sql import functions as F

from marlstone.llm import site_style
from marlstone.llm.common import stored


def text_of(source):
    return site_style.main_text(site_style.Page(source), frozenset())


@pytest.mark.parametrize(
    "odd",
    [
        "<svg/>", "<svg viewBox='0 0 1 1' />", "<svg><title>t</title><path d='M0'/></svg>", "<iframe src='x'/>", "<iframe src='x'></iframe>", "<video controls/>", "<audio src=a />",
        "<script>if (a < b) { x('</p>') }</script>", "<STYLE>p{}</STYLE >", "<!-- <p>no</p> -->", "<![CDATA[ no ]]>", "<object data='a'/>", "<canvas></canvas>", "<template><p>no</p></template>",
    ],
)
def test_raw_elements_take_nothing_else(odd):
    assert text_of(f"<article><p>before</p>{odd}<p>after</p></article>") == "before\nafter"


@pytest.mark.parametrize("name", ["video-player", "object-fit", "svg-icon", "select-box", "script-note", "style-guide", "title-bar"])
def test_custom_elements_are_read(name):
    assert text_of(f"<article><p>before</p><{name} a='b'><p>inner</p></{name}><p>after</p></article>") == "before\ninner\nafter"


@pytest.mark.parametrize("name", ["svg", "iframe", "video", "object", "select", "noscript", "textarea", "title"])
def test_a_missing_end_tag_loses_nothing(name):
    assert text_of(f"<article><p>before</p><{name} a='b'><p>after</p></article><p>end</p>") == "before\nafter\nend"


def test_text_inside_sentences_stays():
    assert text_of("<p>so <math><mi>x</mi> = <mn>2</mn></math> holds, <label>as said</label>, <svg/>here</p>") == "so x = 2 holds, as said, here"


def test_a_headline_above_the_article_stays():
    assert text_of("<body><h1 class=big>Head</h1><article><p>Own words</p></article></body>") == "Head\nOwn words"


def test_long_pages():
    page = "<body>" + "<div class='a1'><p>word &amp; word</p>" * 20_000 + "</body>"
    assert text_of(page).count("word & word") == 20_000
    assert text_of("<" * 100_000 + "a") == "<" * 100_000 + "a"


def extracted(spark, rows, **more):
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS low", "2 AS deal", "3 AS score")
    return {r["page_id"]: r["text"] for r in site_style.extracted(df, stored, **more).collect()}


WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()


def own(k, n=12):
    return " ".join(WORDS[(k * 7 + j * j) % 10] + str(k) for j in range(n))


#: name of the frame's element, name of the content's element, whether an article holds the content
NAMED = [("div class=ad", "div class=text", True), ("div class=q", "div class=z", False), ("section class=content", "div class=promo-text", False), ("div", "div class='related-work'", True)]


@pytest.mark.parametrize(("frame", "content", "article"), NAMED)
@pytest.mark.parametrize("n", [5, 7, 20, 60])
def test_precision_and_recall_of_blocks(spark, frame, content, article, n):
    """Labelled pages with right, missing and misleading names: a frame that all pages share, and content of each page's own."""
    rows, labels = [], {}
    for k in range(n):
        inner = f"<{content}><h2>Summary</h2><p>{own(k)}</p><p>{own(k + 1000)}</p></{content.split()[0]}>"
        inner = f"<article>{inner}</article>" if article else inner
        rows.append((k, f"http://h{k % 2}.org/{k}", f"<body><{frame}><p>Same words on all pages</p></{frame.split()[0]}>{inner}</body>"))
        labels[k] = {own(k), own(k + 1000), "Summary"}
    got = {k: set(t.split("\n")) for k, t in extracted(spark, rows).items()}
    hits = sum(len(got[k] & labels[k]) for k in labels)
    assert hits == sum(map(len, labels.values()))  # recall 1: no content is lost, with any names
    precision = hits / sum(map(len, got.values()))
    assert precision == 1 if n >= 20 or "ad" in frame else precision >= 0.75


def test_importance_follows_the_number_of_pages(spark):
    """No number of pages at which a frame that all share suddenly goes: its score falls with each page."""
    scores = []
    for n in range(2, 12):
        rows = [(k, "http://h.org", f"<body><div class=x>Same words</div><div class=y>{own(k)}</div></body>") for k in range(n)]
        df = spark.createDataFrame(rows, "page_id long, url string, html string")
        found = site_style.expected(site_style.importance(site_style.nodes(site_style.style_counts(df)))).where("path LIKE '%div.x'").first()
        scores.append(found["score"])
    assert scores == sorted(scores, reverse=True) and len(set(scores)) == len(scores)


def test_small_hosts_and_a_hinted_text_of_its_own(spark):
    """A hinted element whose text is each page's own stays once enough pages show that; of few pages names decide."""
    def page(k):
        return f"<body><div class=related><p>{own(k)}</p></div><div class=body><p>{own(k + 500)} {own(k + 800)}</p></div></body>"

    many = extracted(spark, [(k, f"http://h{k % 3}.org", page(k)) for k in range(200)])
    assert all(own(k) in t for k, t in many.items())
    few = extracted(spark, [(k, "http://h.org", page(k)) for k in range(3)])
    assert not any(own(k) in t for k, t in few.items())


def test_a_page_without_anything_else_keeps_what_repeats(spark):
    rows = [(k, "http://h.org", "<body><div><p>Moved.</p></div></body>") for k in range(30)]
    assert set(extracted(spark, rows).values()) == {"Moved."}


def test_long_lists_of_low_paths_are_joined(spark):
    rows = [(k, f"http://h{k % 2}.org", f"<body><div class=x><p>Same words on all pages</p></div><div class=y><p>{own(k)}</p></div></body>") for k in range(40)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    low = stored(site_style.low_branches(site_style.importance(site_style.nodes(site_style.style_counts(pages)))), "low")
    texts = [{(r["page_id"], r["text"]) for r in site_style.with_low_paths(pages, low, size).collect()} for size in (1 << 20, 0)]
    assert texts[0] == texts[1] == {(k, own(k)) for k in range(40)}


def test_trees_decide_on_the_test_data(spark):
    """With the trees switched off, adverts stay on nearly all pages, as their name only hints; with them, they go, and nothing of an article does."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url", "html")
    on, off = (site_style.extracted(pages, stored, measured=m).select("page_id", F.col("text").alias(n)) for m, n in ((True, "with_trees"), (False, "without")))
    rows = pages.join(on, "page_id").join(off, "page_id").collect()
    assert sum(r["with_trees"] != r["without"] for r in rows) > 0.95 * len(rows)
    for r in rows:
        article = r["html"].partition("<article>")[2].partition("</article>")[0]
        assert r["with_trees"] == text_of(f"<article>{article}</article>")
