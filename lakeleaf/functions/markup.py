"""HTML as a flat stream of events, for whatever reads pages."""

from __future__ import annotations

import re
from collections.abc import Callable
from html.parser import HTMLParser

#: Kinds of events: a tag begins (name, attributes), a tag ends (name, whether at once), text.
OPEN, CLOSE, TEXT = "open", "close", "text"
#: Marked sections that may be skipped: those that end with two brackets, and conditional ones.
_SECTION = re.compile(r"<!\[(?:(?:temp|cdata|ignore|include|rcdata)(?![-.\w]).*?\]\s*\]|(?:if|else|endif)(?![-.\w]).*?\])\s*>", re.I | re.S | re.A)
#: One of those that isn't closed, or whose name isn't complete.
_UNCLOSED = re.compile(r"<!\[(?:(?:temp|cdata|ignore|include|rcdata|if|else|endif)(?![-.\w])|(?:[a-z][-.\w]*\s*)?\Z)", re.I | re.A)


class MalformedMarkup(ValueError):
    """A marked section of an unknown kind."""


class _Events(HTMLParser):
    def __init__(self, sink: Callable[[str, str, object], None], strict: bool):
        super().__init__(convert_charrefs=True)
        self.sink, self.strict = sink, strict

    def handle_starttag(self, tag, attrs):
        self.sink(OPEN, tag, attrs)

    def handle_startendtag(self, tag, attrs):
        self.sink(OPEN, tag, attrs)
        self.sink(CLOSE, tag, True)

    def handle_endtag(self, tag):
        self.sink(CLOSE, tag, False)

    def handle_data(self, data):
        self.sink(TEXT, data, None)

    def parse_html_declaration(self, i):
        if self.rawdata[i : i + 3] != "<![":
            return super().parse_html_declaration(i)
        whole = _SECTION.match(self.rawdata, i)
        if whole:
            return whole.end()
        if _UNCLOSED.match(self.rawdata, i):
            return -1
        if self.strict:
            raise MalformedMarkup
        return self.parse_bogus_comment(i)  # up to the next bracket, as browsers do


def read(html: str, sink: Callable[[str, str, object], None], strict: bool = False, finish: bool = True) -> None:
    """Calls ``sink`` with every event in order. ``strict``: marked sections must be of a known kind; ``finish``: what is left open at the end counts too."""
    events = _Events(sink, strict)
    events.feed(html)
    if finish:
        events.close()
