"""Where a page's body is: containers are matched by depth, so nested blocks of the same name don't end one early."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

from tarnfold.functions.html_walk import VOID
from tarnfold.functions.slices import each, slices

#: Left out where the whole body is taken.
_FRAME = {"script", "style", "noscript", "nav", "header", "footer"}
#: Containers whose class says content, but of something else.
_OTHER = re.compile(r"\b(?:ad|sidebar|comment|footer|related)\b", re.I)
_EXACT = ("article-content", "post-content")


class _Containers(HTMLParser):
    """Places of elements that may hold the body: (rank, order, start, end, characters of text)."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.html, self.lines = html, [0]
        for m in re.finditer("\n", html):
            self.lines.append(m.end())
        self.open: list[tuple[str, list[int], int, int]] = []  # name, ranks, start of its content, text before it
        self.count: Counter[str] = Counter()  # of open elements, so a stray end tag costs nothing
        self.found: list[tuple[int, int, int, int, int]] = []
        self.frame: list[tuple[int, int]] = []
        self.text = 0
        self.feed(html)
        self.close()
        while self.open:
            self._end(len(html), len(html))

    def _place(self) -> int:
        line, column = self.getpos()
        return self.lines[line - 1] + column

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in VOID:
            return
        words = next((v or "" for k, v in attrs if k == "class"), "")
        ranks = [i for i, name in enumerate(_EXACT) if name in words.split()]
        ranks += [2] if tag == "article" else []
        ranks += [3] if "content" in words and not _OTHER.search(words) else []
        ranks += [4] if tag == "body" else []
        self.open.append((tag, ranks, self._place() + len(self.get_starttag_text() or ""), self.text))
        self.count[tag] += 1

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        """As in HTML, a slash closes nothing but void elements."""
        self.handle_starttag(tag, attrs)

    def _end(self, at: int, after: int) -> str:
        tag, ranks, start, before = self.open.pop()
        self.count[tag] -= 1
        for rank in ranks:
            self.found.append((rank, start, start, at, self.text - before))
        if tag in _FRAME:
            self.frame.append((self.html.rfind("<", 0, start), after))
        return tag

    def handle_endtag(self, tag: str) -> None:
        if self.count[tag]:
            at = self._place()
            stop = self.html.find(">", at) + 1 or len(self.html)
            while self._end(at, stop if self.open[-1][0] == tag else at) != tag:
                pass

    def handle_data(self, data: str) -> None:
        self.text += len(data.strip())


def body_of(html: str | None) -> str:
    """The content of the first element of class article-content, else post-content, else article, that holds text; else of the
    longest one whose class says content; else of the body without scripts and page frames; else the whole."""
    if not html:
        return ""
    page = _Containers(html)
    for rank in range(4):
        held = [c for c in page.found if c[0] == rank]
        # the first two kinds and articles: only the first of the page counts, and only if it holds text
        best = max(held, key=lambda c: (c[4], -c[1]), default=None) if rank == 3 else min(held, key=lambda c: c[1], default=None)
        if best and (best[4] or rank == 3):
            return html[best[2] : best[3]]
    start, end = next(((c[2], c[3]) for c in page.found if c[0] == 4), (0, len(html)))
    out, at = [], start
    for a, b in sorted(page.frame):
        if a >= at and b <= end:
            out.append(html[at:a])
            at = b
    return "".join([*out, html[at:end]])


def pick_body(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """key and body of each page, in one pass without shuffle; a null page has an empty body."""
    kind = dict(pages.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                yield pa.RecordBatch.from_arrays([part.column(0), each(part.column(1), body_of, pa.string())], [key, "body"])

    return pages.select(key, html).mapInArrow(run, f"{key} {kind}, body string")
