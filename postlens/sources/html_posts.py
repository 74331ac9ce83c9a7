"""Per-page helper for A10: find the posts of one crawled HTML page with the standard library's
``html.parser``.  Returns raw strings only; numbers are parsed afterwards by Spark expressions.

A page is read into a light element tree.  Post containers are elements marked
``data-testid="tweet"``; a page without them is treated as an article page, where each
``<article>`` is one post whose id is the last path part of the page URL.
"""

from __future__ import annotations

from html.parser import HTMLParser
from urllib.parse import urlsplit

_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param",
         "source", "track", "wbr"}
_RAW_TEXT = {"script", "style", "template"}


class _Node:
    """No link to its parent: without cycles a page's tree goes as soon as the page is done."""

    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag, attrs):
        self.tag, self.attrs, self.children = tag, dict(attrs), []

    def iter(self):
        stack = [self]
        while stack:
            n = stack.pop()
            if isinstance(n, _Node):
                yield n
                stack.extend(reversed(n.children))

    def text(self) -> str:
        out, stack = [], [self]
        while stack:
            n = stack.pop()
            if isinstance(n, str):
                out.append(n)
            elif n.tag not in _RAW_TEXT:
                stack.extend(reversed(n.children))
        return "".join(out)

    def find(self, pred):
        return next((n for n in self.iter() if n is not self and pred(n)), None)


class _TreeBuilder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = _Node("#root", {})
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        node = _Node(tag, attrs)
        self.open[-1].children.append(node)
        if tag not in _VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.open[-1].children.append(_Node(tag, attrs))

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag == tag:
                del self.open[k:]
                break

    def handle_data(self, data):
        self.open[-1].children.append(data)


def _testid(value):
    return lambda n: n.attrs.get("data-testid") == value


def _page_key(url: str) -> str:
    """Host and path of a page, without query and fragment: pages of different sites never merge."""
    parts = urlsplit(url)
    return f"{parts.netloc.lower()}{parts.path.rstrip('/')}"


def extract_from_html(url: str, html: str):
    """Rows (id, author, time, content, replies, retweets, likes) of one page."""
    b = _TreeBuilder()
    b.feed(html)
    b.close()
    root = b.root
    tweets = [n for n in root.iter() if n.attrs.get("data-testid") == "tweet"]
    rows = []
    if tweets:
        for t in tweets:
            if t.find(_testid("promotedTweet")):
                continue
            link = None
            for a in t.iter():
                if a.tag == "a" and "/status/" in a.attrs.get("href", "") and a.find(lambda n: n.tag == "time"):
                    link = a
                    break
            post_id = link.attrs["href"].split("/")[-1] if link is not None else ""
            if not post_id:
                continue
            name = t.find(_testid("User-Name"))
            tm = t.find(lambda n: n.tag == "time" and "datetime" in n.attrs)
            body = t.find(_testid("tweetText"))
            eng = {k: t.find(_testid(k)) for k in ("reply", "retweet", "like")}
            rows.append((post_id, (name.text() if name else "") or "Unknown Author",
                         (tm.attrs["datetime"] if tm else "") or "DATEUNDEFINED",
                         body.text() if body else "",
                         *[eng[k].text() if eng[k] is not None else None for k in ("reply", "retweet", "like")]))
        return rows
    articles = [n for n in root.iter() if n.tag == "article"]
    key = _page_key(url)
    for i, art in enumerate(articles):
        if art.attrs.get("class") == "ad" or art.find(lambda n: n.attrs.get("class") == "ad"):
            continue
        tm = art.find(lambda n: n.tag == "time" and "datetime" in n.attrs)
        author = root.find(lambda n: n.tag == "meta" and n.attrs.get("name") == "author")
        post_id = key if len(articles) == 1 else f"{key}-{i}"
        rows.append((post_id, (author.attrs.get("content") if author else "") or "Unknown Author",
                     (tm.attrs["datetime"] if tm else "") or "DATEUNDEFINED",
                     art.text().strip(), None, None, None))
    return rows
