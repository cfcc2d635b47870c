"""Class words on wrappers don't delete the article; on blocks beside or in it they still do."""

from __future__ import annotations

import pytest

from quarry.llm import html_extract

TEXT = "Long text here, and more of it. " * 12
ARTICLE = "".join(f"<p>{i} {TEXT}</p>" for i in range(4))
WANT = "\n".join(f"{i} {TEXT}".strip() for i in range(4))


@pytest.mark.parametrize("wrapper", ['class="has-sidebar"', "class=no-comments", 'class="content-with-menu"', 'id="side-content"', 'class="page header"', 'role="search"'])
@pytest.mark.parametrize("tag", ["article", "main", "div"])
def test_wrapper_with_a_class_word_keeps_its_article(wrapper, tag):
    assert html_extract.extract(f'<body><div class="ad">Buy</div><div {wrapper}><div {wrapper}><{tag}>{ARTICLE}</{tag}></div></div></body>') == WANT
    assert html_extract.extract(f"<body><main><div {wrapper}>{ARTICLE}</div></main></body>") == WANT


def test_small_article_is_kept_beside_long_comments():
    comments = f'<div class="comments"><article>{ARTICLE}</article></div>'
    assert html_extract.extract(f'<body><div class="has-sidebar"><main><p>{TEXT}</p></main></div>{comments}</body>').startswith(TEXT.strip())
    assert html_extract.extract(f'<div id="side"><article><p>{TEXT}</p></article></div><div class="share">{"word " * 20}</div>') == TEXT.strip()


def test_class_words_still_mark_boilerplate():
    inner = f'<div class="comments"><article><p>{TEXT}</p></article></div>'
    assert html_extract.extract(f'<body><article>{ARTICLE}{inner}</article><div class="sidebar"><p>{TEXT}</p></div></body>') == WANT
    assert html_extract.extract(f'<body><div>{ARTICLE}<div class="related-posts"><p>{TEXT}</p></div></div></body>') == WANT


def test_article_in_a_marked_wrapper_of_a_main_is_kept():
    page = f'<main><p>{TEXT}{TEXT}</p><div id="side-content"><article><p>{TEXT}</p></article></div></main>'
    assert TEXT.strip() in html_extract.extract(page).split("\n")
