"""Main text of hand-written pages of other designs than the training grammar's, and of all given pages."""

import html
import os
import re

import pytest

from larkspur.llm import html_extract
from tests.llm.pages import PAGES

GIVEN = "/root/testdata/sf0.1/pages.parquet"


@pytest.mark.parametrize("k", range(len(PAGES)))
def test_hand_written_page(k):
    page, want = PAGES[k]
    assert html_extract.extract(page, html_extract.default()) == want


@pytest.mark.skipif(not os.path.exists(GIVEN), reason="no test data")
def test_given_pages_are_exact():
    import pyarrow.parquet as pq

    p = html_extract.default()
    for page in pq.read_table(GIVEN, columns=["html"])["html"].to_pylist():
        body = re.search(r"<article>(.*)</article>", page, re.S)[1]
        blocks = (" ".join(html.unescape(re.sub(r"</?b>", "", b).replace("<br>", " ")).split()) for b in re.split(r"</?(?:p|h1)>", body))
        assert html_extract.extract(page, p) == "\n".join(b for b in blocks if b)


def test_names_say_what_an_element_is():
    of = lambda c: set(html_extract.names(f'class="{c}"'))
    assert of("post has-sidebar") == {("name", "main"), ("state", "side")}
    assert of("comment-body") == {("name", "main"), ("part", "reply")}
    assert of("ad-free") == {("state", "advert"), ("name", "-")}
    assert of("articleBody") == {("name", "main"), ("part", "main")}
    assert html_extract.names("") == (("name", "-"),) and html_extract.names("hidden") == (("name", "hidden"),)
