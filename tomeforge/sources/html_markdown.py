"""HTML pages as Markdown, with what couldn't be taken along."""

from __future__ import annotations

import posixpath
import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

DROPPED = ("script", "style", "noscript", "template", "head")
BLOCKS = ("p", "div", "section", "article", "ul", "ol", "li", "table", "nav", "footer", "header", "br", "blockquote", "main")


class _Markdown(HTMLParser):
    def __init__(self, known: set[str] | None):
        super().__init__(convert_charrefs=True)
        self.out, self.dropped, self.known, self.links = [], 0, known, []
        self.media, self.warnings, self.row, self.rows = [], [], None, []

    def handle_starttag(self, tag, attrs):
        held = dict(attrs)
        if tag in DROPPED:
            self.dropped += 1
        elif self.dropped:
            return
        elif re.fullmatch("h[1-6]", tag):
            self.out.append("\n\n" + "#" * int(tag[1]) + " ")
        elif tag == "img":
            self._image(held.get("src") or "", held.get("alt") or "")
        elif tag == "a":
            self.links.append(held.get("href") or "")
            self.out.append("[")
        elif tag == "tr":
            self.row = []
        elif tag in ("td", "th") and self.row is not None:
            self.row.append(len(self.out))
        elif tag == "li":
            self.out.append("\n- ")
        elif tag in BLOCKS:
            self.out.append("\n\n" if tag != "br" else "\n")

    def _image(self, target: str, alt: str) -> None:
        if re.match(r"(?:https?:)?//|data:", target):
            self.warnings.append("remote-image-not-fetched")
        elif posixpath.normpath(target).startswith(("..", "/")) or self.known is not None and target not in self.known:
            self.warnings.append("missing-local-image")
        else:
            self.media.append(target)
            self.out.append(f"![{alt}](../images/{posixpath.basename(target)})")

    def handle_endtag(self, tag):
        if tag in DROPPED:
            self.dropped = max(0, self.dropped - 1)
        elif self.dropped:
            return
        elif tag == "a" and self.links:
            target = self.links.pop()
            self.out.append(f"]({target})")
        elif tag == "tr" and self.row is not None:
            cells = [" ".join("".join(self.out[a:b]).split()) for a, b in zip(self.row, [*self.row[1:], len(self.out)], strict=False)]
            if self.row:
                del self.out[self.row[0] :]
                self.rows.append(cells)
                self.out.append(("\n" if len(self.rows) > 1 else "\n\n") + "| " + " | ".join(cells) + " |" + ("\n|" + " --- |" * len(cells) if len(self.rows) == 1 else ""))
            self.row = None
        elif tag == "table":
            self.rows = []
            self.out.append("\n\n")
        elif re.fullmatch("h[1-6]", tag) or tag in BLOCKS:
            self.out.append("\n\n")

    def handle_data(self, data):
        if not self.dropped:
            self.out.append(re.sub(r"\s+", " ", data))


def to_markdown(html: str | None, known: set[str] | None = None) -> dict:
    """Markdown, taken media and warnings of one page; nothing is fetched."""
    parser = _Markdown(known)
    parser.feed(html or "")
    parser.close()
    text = re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]*\n[ \t]*", "\n", "".join(parser.out))).strip()
    return {"markdown": text, "media": parser.media, "warnings": sorted(set(parser.warnings))}


@pandas_udf(T.StructType([T.StructField("markdown", T.StringType()), *(T.StructField(c, T.ArrayType(T.StringType())) for c in ("media", "warnings"))]))
def markdown_of(html: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([to_markdown(x) for x in html], columns=["markdown", "media", "warnings"])


def converted(pages: DataFrame, key: str, html: str) -> DataFrame:
    return pages.select(key, markdown_of(F.col(html)).alias("m")).select(key, "m.markdown", "m.media", "m.warnings")
