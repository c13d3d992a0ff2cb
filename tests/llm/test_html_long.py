"""Pages that are very long or never close what they open, and names of what isn't article text."""

import time

import pytest

from skyframe.llm.html_extract import blocks

PIECES = ["<a ", "<div>x ", "</b> ", "<script ", "<!", '<a "', "<p><button><div>", "<li>", "<div class='", "</p> ", "<!--", "<style>", "&amp", "<b x=\"'>"]


@pytest.mark.parametrize("piece", PIECES)
def test_a_megabyte_takes_one_pass(piece):
    start = time.perf_counter()
    blocks("<article>" + piece * (1_000_000 // len(piece)))
    assert time.perf_counter() - start < 20  # a quadratic scan takes hours


def test_deep_stacks_and_end_tags_without_a_start():
    start = time.perf_counter()
    assert len(blocks("<article>" + "<div>x " * 100_000 + "</b> " * 100_000)) == 100_000
    blocks("<article><button>" + "<div>" * 100_000 + "</p>" * 100_000 + "</button>")
    assert time.perf_counter() - start < 20


def test_a_stray_mark_ends_at_the_next():
    assert blocks("<article><p>a <b one</p><p>two</p></article>")[-1] == ("main", "two")
    assert blocks("<article><p title='a > b'>x</p></article>") == [("main", "x")]


@pytest.mark.parametrize("name", ["user-comments", "reader-comments", "comment-body", "comments-1", "ad-slot-1", "cookie-message", "site-notice", "commentsSection"])
def test_names_of_what_is_no_article_text(name):
    assert blocks(f"<article><p>kept</p><div class='{name}'><p>said by a reader</p></div></article>") == [("main", "kept"), ("chrome", "said by a reader")]


def test_paid_paragraphs_and_running_text():
    assert blocks("<article><p class='advertisement'>buy</p><p class='commentary'>kept</p><div class='chapter-2'>kept too</div></article>") == [("chrome", "buy"), ("main", "kept"), ("main", "kept too")]
