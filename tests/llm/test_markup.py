"""Page markup read in one pass: as plain patterns read it, and in bounded time on hostile pages."""

import html
import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from faregrid.llm import language

HIDDEN = re.compile(r"<(script|style)\b.*?(?:</\1\s*>|\Z)|<!--.*?(?:-->|\Z)|<[^>]*>", re.DOTALL | re.IGNORECASE)
DECLARED = (
    re.compile(r"<html\b[^>]*?\slang\s*=\s*[\"']?\s*([a-zA-Z]{2,3})(?![a-zA-Z])", re.IGNORECASE),
    re.compile(r"<meta\b[^>]*content-language[^>]*content\s*=\s*[\"']?\s*([a-zA-Z]{2,3})(?![a-zA-Z])", re.IGNORECASE),
)
WORDS = ["<html", "<HTML ", "<meta ", " lang", "lang=", "=", "'", '"', " ", "en", "deu", "fren", ">", "<", "</script", "<script", "</Script >", "<style>",
         "</style>", "<!--", "-->", "content-language", "content", "content=", "&amp;", "x", "\n", "/", "<b>", "--", "!"]


@given(st.lists(st.sampled_from(WORDS), max_size=25).map("".join))
@settings(max_examples=3000, deadline=None)
def test_equals_the_patterns(page):
    assert language.visible(page) == html.unescape(HIDDEN.sub(" ", page))
    assert language.declared(page) == next((m[1].lower() for p in DECLARED if (m := p.search(page))), None)


HOSTILE = ["<meta content-language", "<html ", "<html lang", "<", "<!--", "<script", "</script ", "<html lang=" + " " * 500, "<meta content-language content=" + " " * 90,
           "<meta content-language content=xxxx", " lang = ' ", "<style></style", "&", "<script></script>"]


@pytest.mark.parametrize("piece", HOSTILE)
def test_a_megabyte_is_read_at_once(piece):
    for page in (piece * (1_000_000 // len(piece)), "<html lang=" + piece * (1_000_000 // len(piece)), "<html lang=" + " " * 1_000_000, "<meta content-language" + piece * 20_000):
        start = time.process_time()
        language.visible(page), language.declared(page)
        assert time.process_time() - start < 5
