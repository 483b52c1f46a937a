"""Derivatives of whole pages against an HTML parser, and odd or very long markup."""

import html
import time
from html.parser import HTMLParser

import pytest

from chatloom.llm import warc

BLOCKS = set("p div br li ul ol tr table h1 h2 h3 h4 h5 h6 article section nav header footer blockquote pre title body head html main aside form dd dt dl hr".split())
SKIPPED = {"script", "style", "template", "noscript"}


class Visible(HTMLParser):
    """Text outside skipped elements and the title; block tags end lines."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts, self.links, self.title, self.inside = [], [], None, []

    def handle_starttag(self, tag, attrs):
        if tag in SKIPPED or tag == "title":
            self.inside.append(tag)
        if tag in BLOCKS and not self.inside:
            self.parts.append("\n")
        if tag == "a" and not self.inside:
            self.links += [v for k, v in attrs if k == "href"][:1]

    def handle_endtag(self, tag):
        if self.inside and self.inside[-1] == tag:
            self.inside.pop()
        if tag in BLOCKS and not self.inside:
            self.parts.append("\n")

    def handle_data(self, data):
        if self.inside == ["title"] and self.title is None:
            self.title = data
        elif not self.inside:
            self.parts.append(data)


def parsed(markup):
    p = Visible()
    p.feed(markup)
    p.close()
    lines = (" ".join(x.split()) for x in "".join(p.parts).split("\n"))
    return [x for x in lines if x], p.links, p.title


def test_pages_as_an_html_parser_reads_them(spark, sf_small):
    pages = spark.read.parquet(f"{sf_small}/pages.parquet").collect()
    assert len(pages) > 30
    for page in pages:
        text, links, title = parsed(page.html)
        assert [" ".join(x.split()) for x in warc.plain_text(page.html).split("\n") if x.split()] == text
        assert warc.links_of(page.html) == links
        got = warc.split_title(page.html)[0]
        assert (html.unescape(got) if got is not None else None) == title


@pytest.mark.parametrize("piece", ["<title>", "<a ", '<a href="', "<", "<p ", "<!--", "<a <a ", "<script>", "&amp;", "<a href='x' ", "</title"])
def test_very_long_unclosed_markup_takes_linear_time(piece):
    source = {"record_id": "r", "target_uri": "u", "date": "d", "http_status": "s", "payload_digest": "", "http_headers": [], "payload": (piece * 50_000 + ">").encode()}
    began = time.process_time()
    metadata, conversion = warc.derive(source)
    assert time.process_time() - began < 3 and conversion["warc_type"] == "conversion" and metadata["warc_type"] == "metadata"


def test_titles_and_links():
    assert warc.split_title("a<title>x</title>b<TITLE k=1>y</title >c<title>open") == ("x", "abc<title>open")
    assert warc.split_title("<title>") == (None, "<title>") and warc.split_title("") == (None, "")
    markup = """<a href="a>b&amp;c">1</a><A class=x HREF='d e'>2</a><a href=f>3</a><a name=n>4</a><abbr href="no"><a href=>5</a><a data-x=1 href = "g">"""
    assert warc.links_of(markup) == ["a>b&c", "d e", "f", "g"]
