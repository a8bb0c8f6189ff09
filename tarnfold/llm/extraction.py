"""Main text of web pages: a suffix array over each host's token streams removes what repeats across its pages, and article markup breaks ties.

A page is parsed once, into its article's text and the words of every other block. Those words, of every page of a host, form
the host's token stream: each task sorts the suffixes of its part, finds the longest common prefixes of neighbours, and
groups suffixes whose common prefix is `run` tokens or more; the groups' heads and the pages that hold them, of all tasks, meet by (host, head). A head on two
different pages lies in a long repeated substring, and places of consecutive heads make up the whole of it; words that repeated substrings cover are
removed and the unique runs between them are kept; a few words that a repeated substring takes from the edge of a block stay with the block.

Markup breaks ties. Repeats can't tell two things: adverts and menus that differ on each page aren't repeated, and
passages that two articles share are. So where a page has an article (or main) element that holds a fair share of its words, its text is the
article's, and unique runs beside it go; where it has none, unique runs in blocks that are marked as boilerplate go and all others are the text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnfold.llm.common import salted_join, slices, stored

#: Elements whose content is no text of the page.
SILENT = {"script", "style", "noscript", "template", "iframe", "svg", "annotation", "annotation-xml", "textarea", "title", "head", "object", "canvas", "audio", "video", "select", "option", "datalist"}
#: Of these, elements whose content holds no tags: all up to their end tag is text.
RAW = {"script", "style", "noscript", "iframe", "textarea", "title"}
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>]|$)[^>]*(?:>|$)", re.I) for name in RAW}
#: What may open within a head; anything else begins the body, as the head's tags may be left out.
HEAD = RAW - {"iframe", "textarea"} | {"html", "head", "base", "basefont", "bgsound", "link", "meta", "template"}
#: Elements that hold no article text.
BOILERPLATE = {"nav", "footer", "aside", "form", "button", "menu", "dialog", "fieldset"}
#: Void elements open nothing.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Elements that stand within a line: they part no words.
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp",
    "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr",
    "math", "mfrac", "mi", "mn", "mo", "mover", "mroot", "mrow", "ms", "mspace", "msqrt", "mstyle", "msub", "msubsup", "msup", "mtext", "munder", "munderover", "semantics",
}
#: Elements whose end tags are often left out; their scope is never asked for.
LOOSE = {"p", "li", "dt", "dd", "tr", "td", "th", "thead", "tbody", "tfoot", "caption", "colgroup", "html", "body"}
#: Whole words of a class or id that mark boilerplate. Sure ones count behind any word, general ones behind a word of place only; before a word of place both do.
_SURE = r"(?:adsense|adverts?|advertisements?|sponsor(?:ed|s)?|sidebar|side-?nav|nav|navbar|navigation|breadcrumbs?|footer|cookies?|consent|gdpr|popup|modal|newsletter|widgets?|toolbar|pagination|pager|login|signup|skip-?link)"
_GENERAL = r"(?:ads?|promos?|promotion|banner|menu|notices?|alerts?|overlay|subscribe|subscription|share|sharing|social|related|recommended|recommendations)"
_REPLIES = r"(?:comments?|comment-?list|disqus|respond|repl(?:y|ies))"
_BEFORE = r"(?:site|page|top|bottom|main|left|right|side|global|sticky|cookies?|legal|privacy|social|share|user|mobile|primary|secondary|header|footer|nav|post|article|entry|story|google|text|video|display|inline|native|reader)"
_AFTER = (
    r"(?:slot|box|bar|block|unit|area|list|section|banner|notice|container|wrapper|wrap|inner|panel|widget|links?|buttons?|icons?|posts?|articles?|stories|items?|content|form|signup|popup|modal|"
    r"message|dialog|overlay|consent|nav|menu|thread|respond|reply|replies|feed|module|sidebar|holder|label|disclaimer|zone|frame|top|bottom|left|right|header|footer|body|title|toggle|trail|\d+)"
)
_NEGATED = re.compile(r"(?:^|[-_])(?:has|with|without|no)[-_]", re.I)
MARKED = re.compile(rf"^(?:(?:.*[-_])?{_SURE}|(?:{_BEFORE}[-_])*{_GENERAL}|(?:.*[-_])?(?:{_SURE}|{_GENERAL})(?:[-_]{_AFTER})+)$", re.I)
REPLIES = re.compile(rf"^(?:.*[-_])?{_REPLIES}(?:[-_]{_AFTER})*$", re.I)
#: May hold readers' comments, or be a section of an article: the former only beside articles and around some.
PERHAPS_REPLIES = re.compile(r"^(?:.*[-_])?(?:discussion|responses|reactions)$", re.I)
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "form", "menu", "menubar", "toolbar"}
#: Between blocks; white space like any other once words are told apart.
_BREAK = "\x1e"
#: A quote begins a quoted value only behind an equals sign.
_TOKEN = re.compile(r"""<!--.*?(?:-->|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*(?:"[^"]*"|'[^']*')|[^>])*+)(?:>|$)|[^<]+|<""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
#: An article with less than this share of a page's unmarked words is a teaser, not the page's text.
FAIR = 1 / 3
#: A marked element without an article that holds more words than all unmarked ones, so many at least and not most of them in links, is a wrapper around the page's text.
WRAPPER_WORDS = 40
#: Elements whose mark only an article inside can lift, and those of running text, which have marks by class alone.
FIXED = {"footer", "aside", "header", "menu", "dialog", "button"}
RUNNING = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "td", "th", "blockquote", "pre"}


def _marked(name: str, attributes: str) -> str:
    """How an element is marked: hidden, replies, perhaps (replies), fixed, soft or not at all."""
    kind = "fixed" if name in FIXED - {"header"} else "soft" if name in BOILERPLATE else ""
    if not attributes.strip() or name in {"html", "body", "main"}:
        return kind
    found = {k.lower(): a or b or c or "" for k, a, b, c in _ATTRIBUTE.findall(attributes)}
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", found.get("style", ""), re.I):
        return "hidden"
    names = [x for x in (found.get("class", "") + " " + found.get("id", "")).split() if not _NEGATED.search(x)]
    if any(REPLIES.match(x) for x in names):
        return "replies"
    if kind or any(MARKED.match(x) for x in names) or (name not in RUNNING and found.get("role", "").lower() in ROLES):
        return kind or "soft"
    return "perhaps" if any(PERHAPS_REPLIES.match(x) for x in names) else ""


class _Blocks:
    """The blocks of a page, its marked elements and its holders (article and main elements), each with the one around it; those around come first."""

    def __init__(self):
        self.words: list[list[str]] = []
        self.links: list[int] = []  # words of each block inside links
        self.of: list[tuple[int, int]] = []  # the innermost mark and holder of each block, -1 for none
        self.marks: list[tuple[int, str, int]] = []  # the mark around, kind, the holder around
        self.holders: list[tuple[int, str, int]] = []  # the holder around, name, the innermost mark, its own too

    def levels(self, lifted: set[int]) -> tuple[list[bool], list[int]]:
        """For each mark whether what is inside is out of the question (hidden, replies), and how many other marks stand around; the last entries are for no mark."""
        around = {self.marks[m][0] for _, _, m in self.holders if m >= 0} | {m for _, _, m in self.holders}
        for i in range(len(self.marks) - 1, -1, -1):  # marks with a holder inside
            if i in around and self.marks[i][0] >= 0:
                around.add(self.marks[i][0])
        out, soft = [False] * (len(self.marks) + 1), [0] * (len(self.marks) + 1)
        for i, (up, kind, holder) in enumerate(self.marks):
            gone = kind in ("hidden", "replies") or (kind == "perhaps" and holder < 0 and i in around)
            out[i] = out[up] or (gone and i not in lifted)
            soft[i] = soft[up] + (kind in ("soft", "fixed") and i not in lifted)
        return out, soft

    def own_words(self, out: list[bool], soft: list[int]) -> tuple[int, list[int], list[int], list[int]]:
        """Unmarked words of the page; words of each holder that no mark inside it takes; words and words in links of each mark, without those of marks inside."""
        open_, held, own, linked = 0, [0] * len(self.holders), [0] * len(self.marks), [0] * len(self.marks)
        for words, links, (mark, holder) in zip(self.words, self.links, self.of, strict=True):
            if out[mark]:
                continue
            open_ += len(words) * (soft[mark] == 0)
            if mark >= 0:
                own[mark] += len(words)
                linked[mark] += links
            if holder >= 0 and soft[mark] == soft[self.holders[holder][2]]:
                held[holder] += len(words)
        for i in range(len(self.holders) - 1, -1, -1):
            up, _, mark = self.holders[i]
            if up >= 0 and not out[mark] and soft[mark] == soft[self.holders[up][2]]:
                held[up] += held[i]
        return open_, held, own, linked

    def path(self, mark: int) -> set[int]:
        out = set()
        while mark >= 0:
            out.add(mark)
            mark = self.marks[mark][0]
        return out

    def lifted(self) -> set[int]:
        """Marks that remove nothing, as they stand around the page's text: its longest article or main element, or most of its words."""
        lifted: set[int] = set()
        out, soft = self.levels(lifted)
        if all(out[mark] for mark, _ in self.of):  # nothing but what may be replies
            lifted |= {i for i, m in enumerate(self.marks) if m[1] == "perhaps"}
            out, soft = self.levels(lifted)
        open_, held, own, linked = self.own_words(out, soft)
        fair = False
        for name in ("article", "main"):
            free, marked = (max((i for i, (_, n, m) in enumerate(self.holders) if n == name and not out[m] and (soft[m] > 0) == side), key=held.__getitem__, default=None) for side in (False, True))
            most = held[marked] if marked is not None else 0
            if most > open_ and not (free is not None and held[free] >= FAIR * most):
                lifted |= {i for i in self.path(self.holders[marked][2]) if self.marks[i][1] in ("soft", "fixed")}
                fair = True
            fair |= free is not None and held[free] >= FAIR * open_
        if not fair:
            wraps = [i for i, (_, kind, _) in enumerate(self.marks) if kind == "soft" and not out[i] and own[i] >= WRAPPER_WORDS and own[i] > open_ and 2 * linked[i] <= own[i]]
            if wraps:
                around = self.path(max(wraps, key=own.__getitem__))
                if not any(self.marks[i][1] == "fixed" for i in around):
                    lifted |= around
        return lifted

    def parts(self) -> tuple[str | None, list[list[str]], list[bool]]:
        out, soft = self.levels(self.lifted())
        marked = [out[mark] or soft[mark] > 0 for mark, _ in self.of]
        open_words = sum(len(words) for words, gone in zip(self.words, marked, strict=True) if not gone)
        for name in ("article", "main"):
            outermost: list[int] = []  # for each holder, the outermost unmarked one of this name around or at it
            for i, (up, n, mark) in enumerate(self.holders):
                above = outermost[up] if up >= 0 else -1
                outermost.append(above if above >= 0 or n != name or out[mark] or soft[mark] else i)
            inside = [not gone and holder >= 0 and outermost[holder] >= 0 for (_, holder), gone in zip(self.of, marked, strict=True)]
            size = dict.fromkeys(outermost, 0)
            for words, (_, holder), held in zip(self.words, self.of, inside, strict=True):
                if held:
                    size[outermost[holder]] += len(words)
            size.pop(-1, None)
            most = max(size.values(), default=-1)
            if most >= FAIR * (open_words - sum(size.values()) + most):
                rest = [(words, gone) for words, gone, held in zip(self.words, marked, inside, strict=True) if not held]
                return " ".join(w for words, held in zip(self.words, inside, strict=True) if held for w in words), [w for w, _ in rest], [gone for _, gone in rest]
        return None, self.words, marked


def page_parts(html: str | None) -> tuple[str | None, list[list[str]], list[bool]]:
    """(text of the articles, words of each block outside them, whether each such block is marked as boilerplate). The first is None if no article or main element has a fair share of the page's words: then all blocks are outside.

    A mark (an element's name, class, id or role) removes nothing if it stands around the page's longest article or around most of its words; hidden elements and readers' comments go in any case.
    """
    blocks = _Blocks()
    now: list[str] = []
    stack: list[tuple[str, int, int]] = []  # name, the innermost mark and holder before it
    open_: dict[str, int] = {}  # how many elements of a name are open
    mark, holder, link, linked = -1, -1, False, 0
    silent, back = "", ""  # the element that is passed over, and the head around it
    page, at = html or "", 0

    def close() -> None:
        nonlocal linked
        words = unescape("".join(now)).split()
        if words:
            blocks.words.append(words)
            blocks.links.append(linked)
            blocks.of.append((mark, holder))
        now.clear()
        linked = 0

    while at < len(page):
        m = _TOKEN.match(page, at)
        at = m.end()
        name = m[2]
        if silent == "head" and (name.lower() not in (HEAD if not m[1] else HEAD - {"html"}) if name else m[0].strip() and m[0][:2] not in ("<!", "<?")):
            silent = ""
        if name is not None and not m[1] and name.lower() in RAW and not m[3].rstrip().endswith("/"):
            end = _RAW_END[name.lower()].search(page, at)
            at = end.end() if end else len(page)
            if silent:
                continue
        if name is None:
            if not silent and (m[0][0] != "<" or len(m[0]) == 1):
                now.append(m[0])
                linked += len(m[0].split()) if link else 0
            continue
        name = name.lower()
        if silent:
            if m[1] and name == silent:
                silent, back = back, ""
            elif silent == "head" and name == "template" and not m[1]:
                silent, back = name, silent
            continue
        if name == "a":
            link = not m[1]
        if name not in INLINE:
            close()
        if m[1]:
            if open_.get(name):
                while True:
                    top, mark, holder = stack.pop()
                    open_[top] -= 1
                    if top == name:
                        break
        elif name in SILENT:
            if name not in RAW and not m[3].rstrip().endswith("/"):
                silent = name
        elif name not in VOID and name not in INLINE and not (name in LOOSE and not m[3].strip()) and not m[3].rstrip().endswith("/"):
            kind = _marked(name, m[3]) or ("fixed" if name == "header" and holder < 0 else "")
            stack.append((name, mark, holder))
            open_[name] = open_.get(name, 0) + 1
            if kind:
                blocks.marks.append((mark, kind, holder))
                mark = len(blocks.marks) - 1
            if name in {"article", "main"}:
                blocks.holders.append((holder, name, mark))
                holder = len(blocks.holders) - 1
    close()
    return blocks.parts()


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


def token_hashes(words: list[str]) -> np.ndarray:
    from xxhash import xxh64_intdigest

    return np.array([xxh64_intdigest(w.encode()) for w in words], np.uint64)


def head_hashes(tokens: np.ndarray, run: int) -> np.ndarray:
    """A hash of the `run` tokens from each place on, by doubling; a power of two. Fewer tokens have none."""
    out, width = tokens, 1
    while width < run and len(out) > width:
        a, b = out[:-width], out[width:]
        out = (a * np.uint64(0x9E3779B97F4A7C15)) ^ ((b << np.uint64(31)) | (b >> np.uint64(33))) * np.uint64(0xC2B2AE3D27D4EB4F)
        out = out ^ (out >> np.uint64(29))
        width *= 2
    return out.view(np.int64) if width >= run else np.empty(0, np.int64)


def suffix_array(stream: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the stream in order of their suffixes, by prefix doubling until all differ, and for each the longest common prefix with the one before it, in tokens."""
    n = len(stream)
    rank = np.unique(stream, return_inverse=True)[1].astype(np.int32)
    levels, width = [rank], 1
    order = np.argsort(rank, kind="stable")
    while n and rank[order[-1]] < n - 1 and width < n:
        after = np.full(n, -1, np.int32)
        after[:-width] = rank[width:]
        order = np.lexsort((after, rank))
        step = np.ones(n, np.int32)
        step[1:] = (rank[order][1:] != rank[order][:-1]) | (after[order][1:] != after[order][:-1])
        rank = np.empty_like(rank)
        rank[order] = np.cumsum(step, dtype=np.int32) - 1
        levels.append(rank)
        width *= 2
    common = np.zeros(n, np.int64)
    a, b = order[:-1], order[1:]
    for level in range(len(levels) - 1, -1, -1):
        i, j = a + common[1:], b + common[1:]
        fits = np.maximum(i, j) + (1 << level) <= n
        same = np.zeros(len(a), bool)
        same[fits] = levels[level][i[fits]] == levels[level][j[fits]]
        common[1:] += same * (1 << level)
    return order, common


def covered_words(blocks: np.ndarray, at: list[int], run: int) -> np.ndarray:
    """Which words repeated heads cover; blocks: the block of each word, at: where heads begin. Less than `run` words at a block's edge that a repeated substring takes from its neighbour don't count, unless they are the whole block."""
    edge = np.zeros(len(blocks) + 1, np.int64)
    np.add.at(edge, np.array(at, np.int64), 1)
    np.add.at(edge, np.array(at, np.int64) + run, -1)
    covered = np.cumsum(edge)[:-1] > 0
    if not len(blocks):
        return covered
    cut = np.flatnonzero(np.concatenate(([True], (blocks[1:] != blocks[:-1]) | (covered[1:] != covered[:-1]), [True])))
    out = covered.copy()
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        whole = (a == 0 or blocks[a - 1] != blocks[a]) and (b == len(blocks) or blocks[b] != blocks[a])
        if covered[a] and b - a < run and not whole:
            out[a:b] = False
    return out


def stream_heads(pages: list[tuple[int, np.ndarray]], run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct heads of a stream of pages (content hash, tokens): head hash, least and greatest content hash of the pages that hold it, places. Suffixes with `run` tokens in common stand together in the suffix array."""
    parts, heads, owner = [], [], []
    for n, (page, tokens) in enumerate(pages):
        own = head_hashes(tokens, run)
        if len(own):
            parts.append(np.concatenate((tokens, [np.uint64(n)])))  # the number parts pages; no head reaches over it
            heads.append(np.concatenate((own, np.zeros(len(tokens) + 1 - len(own), np.int64))))
            mark = np.zeros(len(tokens) + 1, bool)
            mark[: len(own)] = True
            owner.append((np.full(len(tokens) + 1, page, np.int64), mark))
    if not parts:
        return (np.empty(0, np.int64),) * 4
    stream, head = np.concatenate(parts), np.concatenate(heads)
    page, whole = np.concatenate([o for o, _ in owner]), np.concatenate([m for _, m in owner])
    order, common = suffix_array(stream)
    group = np.cumsum(common < run)[whole[order]]
    order = order[whole[order]]
    starts = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    return head[order][starts], np.minimum.reduceat(page[order], starts), np.maximum.reduceat(page[order], starts), np.diff(np.append(starts, len(order)))


def main_text(pages: DataFrame, run: int = 8, stream_tokens: int = 1 << 20, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars (code points), n_repeated (words removed as repeated on the host), longest_repeat (the longest run of them) for each row. The last two are null
    where an article's markup settles the text: its words beside the article are still evidence for the host's other pages, but the text itself needn't be shuffled.

    Character references are decoded, white space is one space, blocks follow in page order. A null page and one without
    text have an empty text; null or broken URLs are one host; pages of equal content count as one page, so copies keep
    their text; repeated rows keep a row each; an empty table gives no rows; other columns are ignored.
    run: tokens of the shortest substring that counts as repeated, a power of two. stream_tokens bounds what a task sorts at once.
    """
    from xxhash import xxh64_intdigest

    signed = lambda x: xxh64_intdigest(x) - (1 << 63)
    blank = {
        "site": pa.int64(), "head": pa.int64(), "least": pa.int64(), "most": pa.int64(), "n": pa.int64(),
        "page_id": pa.int64(), "url": pa.string(), "article": pa.string(), "words": pa.list_(pa.string()), "blocks": pa.list_(pa.int32()), "marked": pa.list_(pa.bool_()),
    }
    kinds = "site long, head long, least long, most long, n long, page_id long, url string, article string, words array<string>, blocks array<int>, marked array<boolean>"

    def rows(**columns) -> pa.RecordBatch:
        n = len(next(iter(columns.values())))
        return pa.RecordBatch.from_arrays([pa.array(columns[k], t) if k in columns else pa.nulls(n, t) for k, t in blank.items()], list(blank))

    def flush(streams: dict[int, list]) -> Iterator[pa.RecordBatch]:
        for site, held in streams.items():
            head, least, most, n = stream_heads(held, run)
            if len(head):
                yield rows(site=[site] * len(head), head=head, least=least, most=most, n=n)

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        streams: dict[int, list] = {}
        n = 0
        for batch in (part for whole in batches for part in slices(whole)):
            out: dict[str, list] = {k: [] for k in ("site", "page_id", "url", "article", "words", "blocks", "marked")}
            for page, url, html in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                article, outside, marked = page_parts(html)
                words, site = [w for block in outside for w in block], signed(host_of(url).encode())
                open_ = article is None  # an article's text is settled: it moves no further
                for k, v in zip(out, (site, page, url, article, words if open_ else None, list(map(len, outside)) if open_ else None, marked if open_ else None), strict=True):
                    out[k].append(v)
                if len(words) >= run:
                    streams.setdefault(site, []).append((signed(" ".join(words).encode()), token_hashes(words)))
                    n += len(words)
                if n >= stream_tokens:
                    yield from flush(streams)
                    streams, n = {}, 0
            yield rows(**out)
        yield from flush(streams)

    plain = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    found = stored(plain.mapInArrow(parsed, kinds).withColumn("row", F.monotonically_increasing_id()), "streams")  # numbers stay as they are once written
    heads = found.filter("head is not null")
    repeated = heads.groupBy("site", "head").agg(F.min("least").alias("least"), F.max("most").alias("most"), F.sum("n").alias("n")).filter("least != most").select("site", "head", "n")

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole)):
            for row, site, words in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                own = head_hashes(token_hashes(words), run)
                for i in range(0, len(own), 1 << 16):
                    part = own[i : i + (1 << 16)]
                    yield pa.RecordBatch.from_pydict({"row": [row] * len(part), "site": [site] * len(part), "head": part, "at": pa.array(np.arange(i, i + len(part)), pa.int32())})

    left = found.filter("words is not null")
    long = left.filter(F.size("words") >= run).select("row", "site", "words").mapInArrow(windows, "row long, site long, head long, at int")
    total = heads.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    met = salted_join(long, repeated, ["site", "head"], F.col("row"), total).groupBy("row").agg(F.collect_list("at").alias("at"))

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole)):
            texts, n, longest = [], [], []
            for words, sizes, marked, at in zip(*(batch.column(c).to_pylist() for c in ("words", "blocks", "marked", "at")), strict=True):
                blocks = np.repeat(np.arange(len(sizes)), sizes)
                covered = covered_words(blocks, at or [], run)
                texts.append(" ".join(w for w, gone in zip(words, (covered | np.array(marked, bool)[blocks]).tolist(), strict=True) if not gone))
                n.append(int(covered.sum()))
                edges = np.flatnonzero(np.diff(np.concatenate(([0], covered.view(np.int8), [0]))))
                longest.append(int((edges[1::2] - edges[::2]).max(initial=0)))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(n, pa.int64()), pa.array(longest, pa.int64())], ["page_id", "url", "text", "n_repeated", "longest_repeat"])

    opened = left.join(met, "row", "left").select("page_id", "url", "words", "blocks", "marked", "at").mapInArrow(kept, "page_id long, url string, text string, n_repeated long, longest_repeat long")
    closed = found.filter("article is not null").select("page_id", "url", F.col("article").alias("text"), *(F.lit(None).cast("long").alias(c) for c in ("n_repeated", "longest_repeat")))
    return closed.unionByName(opened).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"), "n_repeated", "longest_repeat")
