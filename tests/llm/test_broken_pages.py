import time

import pytest

from flowlens.llm.pages import best_container, blocks_of, main_text, path_of

MB = 1 << 20


@pytest.mark.parametrize("html", [
    "<a" * (MB // 2), "<b x='" * (MB // 6), "<b x='" * (MB // 6) + ">", "<" * MB, "<!--" * (MB // 4), "<a '>" * (MB // 5),
    "<div>" * (MB // 20) + "x", "<div>x" * (MB // 24), "<div>" * (MB // 40) + "</x>" * (MB // 32), "<b>" * (MB // 24) + "<hr>" * (MB // 32),
], ids=["tags", "quotes", "one end", "signs", "comments", "odd quotes", "deep", "deep texts", "other ends", "inline"])
def test_broken_and_deep_pages_take_linear_time(html):
    start = time.process_time()
    main_text(html)
    assert time.process_time() - start < 10


def test_paths_are_spelled_and_found():
    html = "<body><div class='b2 a1'><p>one</p><b>two</b></div><div class='c'><p>three</p></div></body>"
    best = best_container(blocks_of(html))
    assert path_of(best) == ">body>div.a b"
    assert main_text(html, ">body>div.a b") == "one two" and main_text(html, ">body>div.c>p") == "three"


def test_open_comments_and_tags():
    assert main_text("<p>a</p><!-- b <p>c</p>") == "a" and main_text("<p>a</p> b <!-- c") == "a b"
    assert main_text("<p>a</p><!--> b --> c") == "a b --> c"
