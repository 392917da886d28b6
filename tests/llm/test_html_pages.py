"""Main texts of whole pages against a parser of the standard library, and what the host's wrapper decides."""

import collections
import re
from html.parser import HTMLParser

import pytest

from tidemark.llm import html_extract
from tidemark.llm.common import table

GONE = {"nav", "header", "footer", "aside", "form", "script", "style", "noscript", "select", "button", "textarea"}
BLOCKS = {"p", "div", "article", "h1", "h2", "h3", "h4", "ul", "ol", "li", "table", "tr", "td", "th", "blockquote", "section", "pre", "dl", "dt", "dd", "figure", "figcaption", "hr", "nav", "footer", "header", "aside", "form"}


class Article(HTMLParser):
    """Blocks of the article element without what is no article text."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.gone, self.blocks = 0, 0, [[]]

    def aside(self, tag, attrs):
        words = re.split(r"[^a-z0-9]+", " ".join(v or "" for k, v in attrs if k in ("class", "id")).lower())
        return tag in GONE or bool({"ad", "ads", "comment", "comments", "share", "related", "promo", "cookie", "notice", "sidebar", "newsletter"} & set(words))

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS:
            self.blocks.append([])
        elif tag == "br":
            self.blocks[-1].append(" ")
        if tag == "article" and not self.aside(tag, attrs):
            self.inside += 1
        elif self.gone and tag in BLOCKS | GONE and tag not in ("p", "li", "hr") or not self.gone and self.inside and self.aside(tag, attrs):
            self.gone += 1

    def handle_endtag(self, tag):
        if tag in BLOCKS:
            self.blocks.append([])
        if self.gone:
            self.gone -= tag in BLOCKS | GONE and tag not in ("p", "li", "hr")
        elif tag == "article":
            self.inside -= 1

    def handle_data(self, data):
        if self.inside and not self.gone:
            self.blocks[-1].append(data)


def by_parser(page):
    parser = Article()
    parser.feed(page or "")
    parser.close()
    return "\n\n".join(t for t in (" ".join("".join(b).split()) for b in parser.blocks) if t)


def renamed(page):
    """The same page without elements or classes that tell what they are."""
    for k, tag in enumerate(("article", "main", "nav", "header", "footer", "aside")):
        page = re.sub(rf"<{tag}\b[^>]*>", f'<div class="k{k}">', page).replace(f"</{tag}>", "</div>")
    return page.replace('class="ad"', 'class="k9"')


@pytest.fixture(scope="module")
def pages(spark, sf_dir):
    return table(spark, sf_dir, "pages", "page_id", "url", "html")


def texts(spark, rows):
    return {r["page_id"]: r["text"] for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


def test_pages_equal_a_parser(spark, sf_dir, pages):
    rows = pages.collect()
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in html_extract.op5_html_text(spark, sf_dir).collect()}
    assert len(got) == len({r["page_id"] for r in rows}) and all(len(t) == n for t, n in got.values())
    differ = [r["page_id"] for r in rows if got[r["page_id"]][0] != by_parser(r["html"])]
    assert not differ


def test_the_wrapper_decides_without_telling_names(spark, pages):
    hosts = collections.Counter(re.sub(r"^\w+://([^/:?#]*).*", r"\1", r["url"] or "") for r in pages.collect())
    rows = [r for r in pages.collect() if hosts[re.sub(r"^\w+://([^/:?#]*).*", r"\1", r["url"] or "")] >= 4]
    got = texts(spark, [(r["page_id"], r["url"], renamed(r["html"] or "")) for r in rows])
    same = sum(got[r["page_id"]] == by_parser(r["html"]) for r in rows)
    alone = sum(html_extract.main_text(renamed(r["html"] or "")) == by_parser(r["html"]) for r in rows)
    assert same >= 0.95 * len(rows) and alone < 0.2 * len(rows)


@pytest.mark.parametrize("n", [1, 2, 3, 12])
def test_shared_headings_stay_whatever_the_number_of_pages(spark, n):
    page = lambda k: f"<body><nav><a>Home</a></nav><article><h2>Background</h2><p>Tale {k} of a kind. {'word ' * k}</p><h2>Methods</h2><p>Way {k}</p></article><footer>end</footer></body>"
    for hide in (False, True):
        got = texts(spark, [(k, "http://a.b/c", renamed(page(k)) if hide and n > 2 else page(k)) for k in range(n)])
        for k in range(n):
            assert got[k] == "\n\n".join(["Background", f"Tale {k} of a kind. {'word ' * k}".strip(), "Methods", f"Way {k}"])
