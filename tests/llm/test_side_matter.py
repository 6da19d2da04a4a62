"""Operator 10: what names and tags may take from a page."""

import pytest

from palimpsest.llm import html_extraction

TEXT = "The main text of this page is by far its longest part. "


def texts(source):
    blocks = html_extraction.parse(source)[0]
    return [b.text for b, side in zip(blocks, html_extraction.sided(blocks), strict=True) if not side]


@pytest.mark.parametrize(
    "opened",
    ['<body class="has-sidebar has-header">', '<div class="content no-comments">', '<main class="with-sidebar">', '<article class="post legal">', '<div id="search-page">'],
)
def test_names_do_not_empty_a_page(opened):
    source = f"{opened}<p>{TEXT * 4}</p><div class='sidebar'><p>Links</p></div><div class='cookie-notice'>Cookies</div>"
    assert texts(source) == [(TEXT * 4).strip()]


def test_articles_with_the_smaller_part_hide_nothing():
    cards = "".join(f"<article class='card'><p>Card {k}</p></article>" for k in range(3))
    assert (TEXT * 4).strip() in texts(f"<body><div class='text'><p>{TEXT * 4}</p></div>{cards}")


def test_tree_counts_from_two_pages_and_sees_all_blocks(spark):
    menu = "".join(f"<div class='menu m{chr(97 + k)}'>Entry {k}</div>" for k in range(12))
    page = "<body><div class='wrap'>{0}<div class='text'><p>Unique {1} words</p></div><div class='x'><p>Read our magazine every week</p></div></div>"
    rows = [(k, f"https://d.example.org/{k}", page.format(menu, k)) for k in range(2)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.page_id: r.text for r in html_extraction.extract(pages).collect()} == {k: f"Unique {k} words" for k in range(2)}
    paths = [r.path for r in html_extraction.importance(html_extraction.parsed(pages)).collect()]
    assert any("menu" in path for path in paths)


def extracted(spark, *sources, host="v.example.org", **options):
    pages = spark.createDataFrame([(k, f"https://{host}/{k}", source) for k, source in enumerate(sources)], "page_id long, url string, html string")
    return [r.text for r in sorted(html_extraction.extract(pages, **options).collect())]


PARAGRAPHS = [f"Paragraph {w} of a text that two pages of one host have alike, word for word." for w in ("one", "two", "three", "four")]
BODY = "".join(f"<p>{p}</p>" for p in PARAGRAPHS)


@pytest.mark.parametrize(
    "page",
    [
        "<body><article><h1>{0}</h1>" + BODY + "</article></body>", "<body><h1>{0}</h1><div class='text'>" + BODY + "</div></body>", "<body><main><header><h1>{0}</h1></header><div>" + BODY + "</div></main><footer>f</footer></body>",
        "<body><div class='text'><h1>{0}</h1>" + BODY + "</div><div class='print'><p>Print this page</p></div></body>",
    ],
)
def test_versions_of_a_page_keep_their_text(spark, page):
    for text, title in zip(extracted(spark, page.format("Title A"), page.format("Title B")), ("Title A", "Title B"), strict=True):
        assert text.split("\n\n")[:5] == [title, *PARAGRAPHS]


@pytest.mark.parametrize("part", ["<section id='discussion'><h2>Discussion</h2><p>{0}</p></section>", "<h2 id='feedback'>Feedback</h2><p>{0}</p>", "<p id='negative-feedback'>{0}</p>", "<div class='legal'><p>{0}</p></div>"])
def test_names_of_chapters_are_no_side_matter(spark, part):
    for opened in ("<article>{}</article>", "<main>{}</main>"):
        page = "<body>" + opened.format(f"<h1>Paper</h1>{BODY}{part.format('Chapter text. ' * 9)}") + "<div class='comments'><p>First!</p></div></body>"
        for pages in ([page], [page.replace("Paper", f"Paper {k}").replace("Chapter", f"Chapter {k}") for k in range(4)]):
            for text in extracted(spark, *pages):
                assert "Chapter" in text and PARAGRAPHS[3] in text and "First!" not in text and ("Feedback" in text) == ("Feedback" in part)


def test_reader_comments_go_in_an_article_too(spark):
    side = "<section class='reader-comments'><p>Nice {0}</p></section><div class='ad-slot-1'><p>Buy {0} now</p></div><div id='comments'><p>So true, {0}</p></div>"
    sources = [f"<body><article><h1>Title {k}</h1>{BODY}<p>Own text {k}.</p>{side.format(f'number {k}')}</article></body>" for k in range(5)]
    for k, text in enumerate(extracted(spark, *sources)):
        assert text.split("\n\n") == [f"Title {k}", *PARAGRAPHS, f"Own text {k}."]
