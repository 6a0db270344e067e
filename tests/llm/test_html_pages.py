"""Pages without the article as the only cue, comments in article elements, and very long pages."""

import time

import pytest

from fleetsight.llm import html_text

STORY = "<h1>Harbour</h1><p>" + "The harbour was quiet that morning and the boats lay still. " * 6 + "</p><p>" + (
    "Nobody had expected the ferry to return before noon. " * 5) + "</p>"
WANT = "Harbour " + " ".join(("The harbour was quiet that morning and the boats lay still. " * 6).split()) + " " + " ".join(
    ("Nobody had expected the ferry to return before noon. " * 5).split())
REPLY = "<section id=comments><ol class=comment-list><li class=comment><article class=comment-body><p>" + (
    "I saw it too, and my aunt says it is always so. " * 3) + "</p></article></li></ol></section>"


@pytest.mark.parametrize("page", [
    "<html><body><div id=content>{s}</div>{c}</body></html>",
    "<html><body><main><article>{s}{c}</article></main></body></html>",
    "<html><body><main><article>{s}</article>{c}</main></body></html>",
    "<html><body><article>{s}<p class='advert'>Buy now, pay later!</p></article></body></html>",
    "<html><body><div class='content-sidebar-wrap'><main>{s}</main></div></body></html>",
])
def test_comments_and_adverts_stay_out(page):
    assert html_text.main_text(page.format(s=STORY, c=REPLY)) == WANT


def test_more_comments_than_article():
    page = "<body><div id=content>" + STORY + "</div>" + "<section id=comments>" + REPLY * 20 + "</section></body>"
    assert html_text.main_text(page) == WANT


def test_ratio_decides_without_an_article_element():
    """Lines of many tags and few characters before and after the text are left out by the threshold alone."""
    links = "<div>" + "".join(f"<a href=#><b>{w}</b></a> " for w in ("one", "two", "six", "ten")) + "</div>"
    page = "<html><body><table><tr><td>" + links * 8 + "</td></tr></table><div>" + STORY.replace("<h1>Harbour</h1>", "") + (
        "</div><table><tr><td>" + links * 8 + "</td></tr></table></body></html>")
    assert html_text.main_text(page) == WANT.removeprefix("Harbour ")


@pytest.mark.parametrize("part", ["<div class=ad>", "<div>", "<b>", "<ul class=menu><li>x", "<div class=ad></section>"])
def test_time_grows_with_the_page(part):
    start = time.time()
    html_text.main_text("<body>" + STORY + part * 100_000)
    assert time.time() - start < 20


def test_repeated_rows_and_clashing_columns(spark):
    rows = [(1, "u", "<p>" + "A fine day it was. " * 9 + "</p>", "x", 5)] * 2
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars long")
    got = html_text.extract(frame).collect()
    assert len(got) == 2 and got[0] == got[1] and got[0]["n_chars"] == len(got[0]["text"]) > 100
