"""Pages whose names, roles and nesting mislead: what is kept and what is not."""

import time

import pytest

from qaspark.llm.html_extract import extract_pages, main_text, minimum_cut

T = " ".join(f"word{i}" for i in range(22)) + "."
HEAD = f"<h1>Head</h1><p>{T}</p>"
WHOLE = f"Head\n\n{T}"


@pytest.mark.parametrize("start", ['<article class="post review">', '<article id="ad-free-post">', '<main class="page-with-sidebar">', '<div class="legal-story">', '<div role="main" class="search">', '<div role="article">'])
def test_an_article_keeps_its_role_whatever_it_is_called(start):
    end = f"</{start[1:].split()[0]}>"
    assert main_text(start + HEAD + end) == WHOLE
    assert main_text(f'<nav><p>{T} {T}</p></nav>{start}{HEAD}{end}<div class="ad"><p>Buy {T}</p></div>') == WHOLE


def test_headers_of_articles_and_of_pages():
    assert main_text(f"<header><h1>Site</h1></header><article><header class='entry-header'><h1>Head</h1></header><p>{T}</p><footer>By</footer></article>") == WHOLE
    assert main_text(f"<article><div class='post-header'><h1>Head</h1></div><p>{T}</p></article>") == WHOLE


@pytest.mark.parametrize("inner", ['<div role="complementary"><p>{}</p></div>', '<section role="navigation"><p>{}</p></section>', '<div class="comments"><article class="comment"><p>{}</p></article></div>', "<aside><p>{}</p></aside>", '<div class="share"><p>{}</p></div>'])
def test_boilerplate_inside_an_article(inner):
    assert main_text(f"<article>{HEAD}{inner.format('Not this ' * 9)}</article>") == WHOLE


def test_an_article_stands_above_main():
    assert main_text(f"<main><p>teaser {T}</p><article>{HEAD}</article><p>{T}</p></main>") == WHOLE
    assert main_text(f"<main><h1>Head</h1><article><p>{T}</p></article></main>") == WHOLE
    assert main_text(f"<main>{HEAD}</main><div><p>{T} outside</p></div>").startswith(WHOLE)


def test_short_blocks_among_kept_ones_stay():
    assert main_text(f"<div><h1>Head</h1><p>Short one.</p><p>{T} {T} {T}</p><p>End.</p></div>") == f"Head\n\nShort one.\n\n{T} {T} {T}\n\nEnd."
    lines = [f"Yes {i}." for i in range(60)]
    assert main_text("<div>" + "".join(f"<p>{x}</p>" for x in lines) + "</div>") == "\n\n".join(lines)


def test_buttons_and_hidden_text():
    assert main_text(f"<article><p>{T}<button>Share</button> more</p><p hidden>Kept</p><p style='display:none'>Kept too</p></article>") == f"{T} more\n\nKept\n\nKept too"
    assert main_text(f"<article><p>Start <button>Share<p>{T}</article>") == f"Start\n\n{T}"


def test_repeated_pages_and_ties(spark):
    rows = [(1, "u", f"<article>{HEAD}</article>")] * 2 + [(2, None, None), (None, "v", "")]
    got = extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in got) == [(0, "", 0), (1, WHOLE, len(WHOLE)), (1, WHOLE, len(WHOLE)), (2, "", 0)]
    assert minimum_cut([0.0], []) == [False] and minimum_cut([0.0, 0.0], [(0, 1, 1.0)]) == [False, False]


@pytest.mark.parametrize("page", ["<div>" * 10_000 + T, "<b>" * 10_000 + "</i>" * 10_000 + T, "<i><p>" + "<b>" * 10_000 + "</i>" * 10_000 + T, "<div>x<p>" * 10_000, '<div class="ad">' * 10_000 + "<h1>a</h1>x", "<p>y " * 10_000, "<" * 10_000])
def test_hostile_nesting_takes_linear_time(page):
    start = time.process_time()
    main_text(page)
    assert time.process_time() - start < 4
