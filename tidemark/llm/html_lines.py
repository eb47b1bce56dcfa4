"""Text lines of an HTML page: one pass over tags, each character read once.

Tags are read as the HTML standard reads them: an attribute value without quotes ends at white space or ``>``, a
quote that never closes takes the rest of the page, ``<`` without a letter after it is text, and what a
start tag closes by implication (a paragraph, a list item, the head) is closed.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

# HTML elements and classes whose text is none of an article's. A class counts as a whole token of the
# class list or the role, so that "ad-hoc" is no "ad". Ids are anchors of headings and sections too, so they count for div elements only, whole.
RAW = {"script", "style", "noscript", "iframe", "textarea", "title", "xmp"}
DROPPED = {"template", "svg", "math", "object", "canvas", "audio", "video"}
OUTSIDE = {"head", "nav", "footer", "aside", "menu", "dialog", "button", "select", "fieldset"}
CONTENT = {"article", "main"}
NESTING = OUTSIDE | DROPPED | CONTENT | {"form", "header", "html", "body", "div", "section", "ul", "ol", "dl", "table", "tbody", "thead", "tr", "td", "th", "blockquote", "figure", "details", "center"}
BLOCKS = NESTING - DROPPED | {"p", "br", "hr", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "pre", "address", "caption", "figcaption", "summary", "option", "legend", "label", "input"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
IN_HEAD = {"base", "basefont", "bgsound", "link", "meta", "noframes", "template", "head", "html"} | RAW
ENDS_PARAGRAPH = BLOCKS - {"br", "input", "label", "option", "legend", "button", "select", "caption", "td", "th", "tr", "tbody", "thead"}
#: Elements that one of the same group closes.
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}}
NOISE = frozenset(
    "ad ads advert adverts advertisement advertisements advertising sponsor sponsored ad-slot ad-container ad-banner banner-ad nav navbar navigation menu breadcrumb breadcrumbs topbar masthead site-header page-header"
    " footer site-footer page-footer sidebar side-bar notice notices cookie cookies cookie-notice cookie-banner cookie-consent consent gdpr comment comments comment-list comments-area disqus"
    " banner contentinfo complementary search dialog alert".split()
)

DIVISIONS = frozenset("comments sidebar footer header nav navigation menu".split())

_NAME = re.compile(r"[^\s/>]*")
_GAP = re.compile(r"[\s/]*")
_ATTRIBUTE = re.compile(r"[^\s/>][^\s/>=]*")
_EQUALS = re.compile(r"\s*=\s*")
_COMMENT_END = re.compile("--!?>")
_BARE = re.compile(r"[^\s>]*")
_ENDS = {name: re.compile(rf"</{name}(?=[\s/>])", re.IGNORECASE) for name in RAW}


def _attributes(page: str, at: int) -> tuple[list[tuple[str, str]], int]:
    """Attributes of the tag whose name ends there, and the place after the tag; the end of the page if it isn't closed."""
    found, size = [], len(page)
    while True:
        at = _GAP.match(page, at).end()
        if at >= size:
            return found, size
        if page[at] == ">":
            return found, at + 1
        m = _ATTRIBUTE.match(page, at)
        at = m.end()
        value = ""
        if e := _EQUALS.match(page, at):
            at = e.end()
            quote = page[at : at + 1]
            if quote in ("'", '"'):
                end = page.find(quote, at + 1)
                if end < 0:
                    return found, size
                value, at = page[at + 1 : end], end + 1
            else:
                b = _BARE.match(page, at)
                value, at = b[0], b.end()
        found.append((m[0].lower(), value))


def tokens(page: str) -> Iterator[tuple[str, str, bool, list[tuple[str, str]], bool]]:
    """Texts and tags in page order: (text before the tag, name, whether it closes, attributes, whether it ends in a slash).
    Comments and declarations have no name; neither has the end of the page. What is in scripts, styles and the like is skipped."""
    at, start, size = 0, 0, len(page)
    while True:
        at = page.find("<", at)
        if at < 0:
            yield page[start:], "", False, [], False
            return
        closing = page.startswith("/", at + 1)
        first = page[at + 1 + closing : at + 2 + closing]
        if first.isascii() and first.isalpha():
            text = page[start:at]
            m = _NAME.match(page, at + 1 + closing)
            name = m[0].lower()
            attributes, at = _attributes(page, m.end())
            if at >= size and not page.endswith(">"):
                name, attributes = "", []  # a tag that the page ends in is none
            slash = page[at - 2 : at] == "/>"
            if name in RAW:
                if not closing:
                    end = _ENDS[name].search(page, at)
                    at = _attributes(page, end.end())[1] if end else size
                name = ""
            yield text, name, closing, attributes, slash
            start = at
        elif page.startswith("<!--", at):
            end = _COMMENT_END.search(page, at + 2)  # "<!-->" is a whole comment
            yield page[start:at], "", False, [], False
            at = start = end.end() if end else size
        elif first in ("!", "?") or (closing and first):
            end = page.find(">", at + 1)
            yield page[start:at], "", False, [], False
            at = start = end + 1 if end >= 0 else size
        else:
            at += 1


def is_noise(element: str, attributes: list[tuple[str, str]]) -> bool:
    for name, value in attributes:
        if name in ("class", "role"):
            if not NOISE.isdisjoint(value.lower().split()):
                return True
        elif name == "id" and element == "div":
            if value.lower() in DIVISIONS:
                return True
        elif name == "hidden" or (name == "style" and "display:none" in value.lower().replace(" ", "")):
            return True
    return False


def page_lines(page: str) -> tuple[list[str], list[bool]]:
    """The page's lines outside of what is never article text, and whether each is in an article or main element."""
    lines, inside, held = [], [], []
    stack: list[tuple[str, int, bool]] = []  # element, noise (1: only for a form, which may hold the article; 2: for another reason), content
    opened: Counter = Counter()  # elements of the stack
    noise, content = 0, False

    def end_line() -> None:
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            held.clear()
            if text:
                lines.append(text)
                inside.append(content)

    def close(name: str) -> None:
        nonlocal noise, content
        while True:
            gone = stack.pop()[0]
            opened[gone] -= 1
            if gone == name:
                break
        noise, content = stack[-1][1:] if stack else (0, False)

    for text, name, closing, attributes, slash in tokens(page):
        if opened["head"] and ((name and name not in IN_HEAD and not closing) or (text.strip() and stack[-1][0] == "head")):
            close("head")
        if text and not noise:
            held.append(text)
        if not name:
            continue
        if name in BLOCKS:
            end_line()
        if closing:
            if opened[name]:
                close(name)
            continue
        if name in ENDS_PARAGRAPH and opened["p"]:
            close("p")
        if name in SIBLINGS and stack and stack[-1][0] in SIBLINGS[name]:
            close(stack[-1][0])
        if name in VOID or (slash and name in ("svg", "math")):
            continue
        named = bool(attributes) and name not in ("html", "body") and is_noise(name, attributes)
        if name in NESTING or named or noise:  # within noise all, so that inner elements do not close outer ones
            bad = 2 if named or name in OUTSIDE or name in DROPPED or (name == "header" and not content) else int(name == "form")
            before = 0 if noise == 1 and name in CONTENT else noise
            stack.append((name, max(before, bad), content or name in CONTENT))
            opened[name] += 1
            noise, content = stack[-1][1:]
    end_line()
    return lines, inside
