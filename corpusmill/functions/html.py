"""HTML to Markdown with the standard library's parser, page by page (no state is shared between pages)."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements whose text is not shown.  ``head`` is none of them: its end tag may be left out.
_SKIP = {"script", "style", "title", "noscript", "template"}
_BLOCK = {"p", "div", "section", "article", "nav", "footer", "header", "ul", "ol", "table", "tr", "blockquote", "main"}


class _Writer(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.skip, self.links, self.lists = [], 0, [], []

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag in _SKIP:
            self.skip += 1
        elif tag in ("b", "strong"):
            self.out.append("**")
        elif tag in ("i", "em"):
            self.out.append("_")
        elif tag == "a":
            self.links.append(a.get("href"))
            self.out.append("[")
        elif tag == "img":
            self.out.append(f"![{a.get('alt') or ''}]({a.get('src') or ''})")
        elif tag == "br":
            self.out.append("  \n")
        elif tag == "li":
            number = self.lists[-1] if self.lists else None
            self.out.append("\n  * " if number is None else f"\n  {number}. ")
            if number is not None:
                self.lists[-1] += 1
        elif len(tag) == 2 and tag[0] == "h" and tag[1].isdigit():
            self.out.append("\n\n" + "#" * int(tag[1]) + " ")
        elif tag in _BLOCK:
            if tag in ("ul", "ol"):
                self.lists.append(None if tag == "ul" else 1)
            self.out.append("\n\n")

    def handle_endtag(self, tag):
        if tag in _SKIP:
            self.skip = max(0, self.skip - 1)
        elif tag in ("b", "strong"):
            self.out.append("**")
        elif tag in ("i", "em"):
            self.out.append("_")
        elif tag == "a" and self.links:
            self.out.append(f"]({self.links.pop() or ''})")
        elif tag in _BLOCK or tag[:1] == "h":
            if tag in ("ul", "ol") and self.lists:
                self.lists.pop()
            self.out.append("\n\n")

    def handle_data(self, data):
        if not self.skip:
            self.out.append(re.sub(r"\s+", " ", data))


def markdown_of(html: str | None) -> str:
    w = _Writer()
    w.feed(html or "")
    w.close()
    lines = [line.rstrip(" ") for line in "".join(w.out).split("\n")]
    kept = [x for i, x in enumerate(lines) if x or (i and lines[i - 1])]
    return "\n".join(kept).strip()


def _convert(batches):
    for pdf in batches:
        pdf["markdown"] = pd.Series([markdown_of(h) for h in pdf["html"]], dtype="object")
        yield pdf.drop(columns="html")


def to_markdown(pages: DataFrame, key: str) -> DataFrame:
    """(key, markdown); pages without text are dropped."""
    rows = pages.select(key, "html")
    kind = rows.schema[key].dataType.simpleString()
    return rows.mapInPandas(_convert, f"`{key}` {kind}, markdown string").where(F.trim("markdown") != "")
