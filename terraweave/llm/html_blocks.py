"""Text blocks of a page and what its markup says about them."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

MAIN, OPEN, CHROME = "main", "open", "chrome"

# Element names of HTML and words that pages use to name their parts.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CHROME_TAGS = frozenset("nav footer aside form button select textarea input label fieldset dialog menu iframe object "
                        "canvas audio video map head title".split())
CHROME_WORDS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie "
                         "cookies consent notice notices alert popup modal overlay sidebar aside menu nav navbar navigation "
                         "breadcrumb breadcrumbs toc footer header masthead toolbar share sharing social related "
                         "recommended newsletter subscribe signup login search pagination pager comment comments disqus "
                         "respond replies reply".split())
CHROME_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar "
                         "toolbar".split())
BLOCK_TAGS = frozenset("html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr "
                       "td th caption blockquote pre figure figcaption header footer nav aside form fieldset address "
                       "details summary hr center head title menu dialog".split())
ENDS_P = BLOCK_TAGS - {"html", "body", "td", "th", "tr", "thead", "tbody", "tfoot", "caption", "head", "title"}

RAW_TAGS = frozenset("script style noscript template svg math".split())  # fixed value: elements without text of their own
NAME = re.compile(r"[a-zA-Z][^\s/>]*")
UP_TO_MARK = re.compile(r"[^>=]*")
SPACE = re.compile(r"\s*")
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)


def _is_chrome(tag: str, attributes: str, in_main: bool) -> bool:
    if tag in CHROME_TAGS or (tag == "header" and not in_main):
        return True
    if not attributes or tag in ("html", "body", "main", "article"):
        return False
    for name, *values in ATTRIBUTE.findall(attributes):
        value = "".join(values).lower()
        name = name.lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            return True
        if name == "role" and value in CHROME_ROLES:
            return True
        if name in ("class", "id") and not CHROME_WORDS.isdisjoint(re.split(r"[\s_-]+", value)):
            return True
    return False


def tags(page: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """(start, end, name, closes, attributes) of all markup in order; name is empty for comments and dropped elements.

    A tag ends at the first ``>`` outside quotes, and quotes count behind ``=`` only. A quote that is never closed is an
    ordinary character, a tag that never ends is text. Every character is walked over a bounded number of times.
    """
    size, at, open_quotes = len(page), 0, set()
    while (start := page.find("<", at)) >= 0:
        at = start + 1
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            at = size if end < 0 else end + 3
            yield start, at, "", False, ""
            continue
        closes = page.startswith("/", at)
        name = NAME.match(page, at + closes)
        if not name:
            if page[at:at + 1] in ("!", "?", "/"):
                end = page.find(">", at)
                if end < 0:
                    return
                at = end + 1
                yield start, at, "", False, ""
            continue
        end = UP_TO_MARK.match(page, name.end()).end()
        while page.startswith("=", end):
            end = SPACE.match(page, end + 1).end()
            quote = page[end:end + 1]
            if quote in ("'", '"') and quote not in open_quotes:
                close = page.find(quote, end + 1)
                if close < 0:
                    open_quotes.add(quote)
                else:
                    end = close + 1
            end = UP_TO_MARK.match(page, end).end()
        if end == size:
            return
        tag, attributes, at = name.group().lower(), page[name.end():end], end + 1
        if tag in RAW_TAGS and not closes:
            close = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = close.end() if close else size
            tag = ""
        yield start, at, tag, closes, attributes


def blocks(page: str) -> list[tuple[str, str]]:
    """(kind, text) of every block with text, in page order.

    kind is MAIN inside an article or main element, CHROME inside menus, adverts and the like, else OPEN. White space,
    line breaks included, becomes one space.
    """
    found: list[tuple[str, str]] = []
    pieces: list[str] = []
    stack: list[tuple[str, int, int]] = []  # tag, main and chrome depth outside it
    main = chrome = at = 0

    def flush() -> None:
        if pieces:
            text = " ".join("".join(pieces).split())
            pieces.clear()
            if text:
                found.append((CHROME if chrome else MAIN if main else OPEN, text))

    for start, end, tag, closes, attributes in tags(page):
        if start > at:
            raw = page[at:start]
            pieces.append(html.unescape(raw) if "&" in raw else raw)
        at = end
        if not tag:
            continue
        if tag == "br":
            pieces.append(" ")
            continue
        closes_p = not closes and tag in ENDS_P
        if tag in BLOCK_TAGS or tag in CHROME_TAGS:
            flush()
        if closes_p and stack:  # an open paragraph ends, with what is open in it
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == "p":
                    _, main, chrome = stack[i]
                    del stack[i:]
                    break
                if stack[i][0] in BLOCK_TAGS:
                    break
        if closes:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    flush() if (stack[i][1], stack[i][2]) != (main, chrome) else None
                    _, main, chrome = stack[i]
                    del stack[i:]
                    break
            continue
        if tag in VOID:
            continue
        dropped = _is_chrome(tag, attributes, bool(main))
        if dropped and tag not in BLOCK_TAGS and tag not in CHROME_TAGS:
            flush()
        stack.append((tag, main, chrome))
        chrome += dropped
        if not dropped and (tag in ("article", "main") or re.search(r"\brole\s*=\s*[\"']?main\b", attributes, re.I)):
            main += 1
    raw = page[at:]
    if raw:
        pieces.append(html.unescape(raw))
    flush()
    return found
