"""The page parser against one built on the standard library's, and on malformed pages."""

import random
import time
from html.parser import HTMLParser

import pytest

from tidemark.llm.html_lines import page_lines

DROP = {"head", "nav", "footer", "aside", "menu", "form", "button", "script", "style", "title"}
CLASSES = {"ad", "comments", "sidebar", "cookie-notice"}
BREAKS = {"p", "div", "section", "article", "main", "h1", "h2", "ul", "li", "br", "body", "html", "blockquote", "header", *DROP} - {"script", "style", "title"}


class Plain(HTMLParser):
    """Blocks of a page, for documents whose elements other than p, li and br are closed."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open, self.blocks, self.held = [], [], ""

    def flush(self):
        text, self.held = " ".join(self.held.split()), ""
        if text:
            self.blocks.append(text)

    def handle_starttag(self, tag, attrs):
        if tag in BREAKS:
            self.flush()
            for closed in ("p", "li"):
                if (closed == "p" and tag != "br") or tag == "li":
                    places = [i for i, (t, _) in enumerate(self.open) if t == closed]
                    if places and (closed == "p" or self.open[-1][0] == "li"):
                        del self.open[places[-1] :]
        if tag in ("br", "meta", "img"):
            return
        words = set((dict(attrs).get("class") or "").split())
        within = any(t in ("article", "main") for t, _ in self.open)
        self.open.append((tag, tag in DROP or bool(words & CLASSES) or (tag == "header" and not within)))

    def handle_endtag(self, tag):
        if tag in BREAKS:
            self.flush()
        if any(t == tag for t, _ in self.open):
            while self.open.pop()[0] != tag:
                pass

    def handle_data(self, data):
        if not any(bad for _, bad in self.open):
            self.held += data


def plain_lines(page: str) -> list[str]:
    parser = Plain()
    parser.feed(page)
    parser.close()
    parser.flush()
    return parser.blocks


def test_given_pages(spark, tables):
    pages = [r.html for r in spark.read.parquet(f"{tables}/pages.parquet").select("html").collect()]
    for page in pages:
        for p in (page, page.replace("article>", "div>"), page.replace("<p>", "<p class='share' title=it's>"), page.replace("<p>", "<section id='related-work'><p>").replace("</p>", "</p></section>")):
            assert page_lines(p or "")[0] == plain_lines(p or "")


@pytest.mark.parametrize("seed", range(40))
def test_random_pages(seed):
    r = random.Random(seed)

    def body(depth: int) -> str:
        out = ""
        for k in range(r.randint(1, 4)):
            words = f"t{r.randint(0, 999)} &amp; <b>x</b>{r.choice(['', ' &lt;', '<!-- <p> -->', ' 1 < 2', '<br>z'])}"
            kind = r.choice(["p", "p", "li", "div", "section", "article", "nav", "aside", "header", "footer", "h2"])
            cls = r.choice(["", "", ' class="ad"', " class='share x'", " class=ad-hoc", ' id="comments-related"', ' class="big comments"', ' data-x="a>b" title=it\'s'])
            if kind in ("p", "li"):
                out += f"<{kind}{cls}>{words}" + r.choice([f"</{kind}>", f"</{kind}>", ""])
            else:
                out += f"<{kind}{cls}>{body(depth - 1) if depth else words}</{kind}>"
        return out

    page = f"<!DOCTYPE html><html><head><title>a<b</title><script>var t='</p><div>';</script></head><body>{body(3)}</body></html>"
    assert page_lines(page)[0] == plain_lines(page)


@pytest.mark.parametrize(
    ("page", "lines"),
    [
        ('<article><h1>T</h1><p class="share">x</p><p>Real one</p><p>Real two</p></article>', ["T", "x", "Real one", "Real two"]),
        ('<article><h1>T</h1><p class="ad">x<p>Real one</p><div>Real two</div></article>', ["T", "Real one", "Real two"]),
        ('<article><section id="related-work">a</section><div class="ad-hoc">b</div></article>', ["a", "b"]),
        ("<article><p title=it's>one</p><p>two</p><p>don't</p></article>", ["one", "two", "don't"]),
        ("<head><meta charset=x>body without a body tag<p>more", ["body without a body tag", "more"]),
        ("<form action=/><div>menu</div><main><p>text</p></main><p>send</form>after", ["text", "after"]),
        ('<p>kept</p><a href="never closed>lost', ["kept"]),
        ("<p>kept</p><script>never closed", ["kept"]),
        ("a < b <3 </ c>d<svg/>e<svg><text>f</svg>g", ["a < b <3 de" + "g"]),
        ("<table><tr><td class=ad>x<td>y<tr><td>z</table>", ["y", "z"]),
        ("<!-->a<!--->b<!-- x --!>c", ["abc"]),
        ("</p></div></article>text</body></html> more", ["text", "more"]),
    ],
)
def test_malformed_pages(page, lines):
    assert page_lines(page)[0] == lines


@pytest.mark.parametrize("piece", ["<a b='c' ", '<p a="', "<div>", "<script>", "<!--", "<", "<span class=ad></em>", "<p class=ad>x", "<a ", "<svg>", "</x ", "<li class=ad><em>"])
def test_time_is_linear(piece):
    took = []
    for n in (20_000, 80_000):
        began = time.perf_counter()
        page_lines(piece * n)
        took.append(time.perf_counter() - began)
    assert took[1] < 10 * took[0] + 0.5
