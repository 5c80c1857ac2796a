"""HTML that is broken, hostile or longer in lower case: no text is lost, time stays in proportion."""

import time

import pytest

from motionloom.llm.html_text import main_text

BROKEN = ['<a"', "<a ", "<!", "<a '\">", '<a "> "', '<a b="', "</", "<", "<?", "<!--", "<script>", "<td>", "<li><ul><b>", "<p><li><b><b>", "&#9999", "<a href='x>y' ", "<a class=\"", "class='"]


def article(text, more=""):
    return f"<html><body><nav>menu</nav><article><p>first {text}</p>{more}<p>second para.</p><p>third one.</p></article></body></html>"


def test_letters_that_grow_in_lower_case():
    for letter in ("İ", "i", "ẞ", "K"):
        for raw in ("<script>var a = '<p>';</script>", "<STYLE>p {}</STYLE >", "<textarea>x</textarea>", "<script>a</scripted></script\n>"):
            assert main_text(article(letter * 200, raw)) == f"first {letter * 200} second para. third one."


@pytest.mark.parametrize("piece", BROKEN)
def test_time_grows_with_the_page(piece):
    page = "<html><body><article><p>" + piece * (1_000_000 // len(piece)) + "</p></article>'"
    began = time.perf_counter()
    main_text(page)
    assert time.perf_counter() - began < 20


def test_time_of_deep_and_wide_pages():
    began = time.perf_counter()
    for head, row in (("<p><li>", "<div></div>"), ("<li><ul>", "<li></li>"), ("<table><tr>", "<td></td>"), ("<p>", "<p>")):
        main_text(head + "<b>" * 50_000 + row * 50_000)
    assert time.perf_counter() - began < 60


def test_quotes_in_tags():
    assert main_text(article('<a href="a>b" title=\'"\'>link</a> end')) == "first link end second para. third one."
    assert main_text(article('<a href="open>link</a> end')).startswith("first")
    assert main_text(article("x < y and 3<4 >")) == "first x < y and 3<4 > second para. third one."
    assert main_text("<p>one <b>two") == "one two" and main_text("a < b") == "a < b" and main_text("words <p") == "words <p"


def test_references_of_any_length():
    assert main_text(article("a&#" + "9" * 100_000 + ";b &#0000000000065; &#x41;")) == "first a�b A A second para. third one."
