"""String, HTML and Markdown expressions. What needs the structure of a page is in operators.html_job."""

from __future__ import annotations

import re
import unicodedata
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnfold.functions import html_walk
from tarnfold.functions.slices import each

#: Characters that no file name or link may hold, and invisible ones.
ILLEGAL = r'[\\/:*?"<>|#／＼：＜＞｜＂？＃＊]'
CONTROL = "[\\x00-\\x1f\\x7f-\u009f\u200b-\u200f\u2028-\u202e\u2060-\u2064\ufeff]"
RESERVED = r"(?i)^(con|prn|aux|nul|com[1-9]|lpt[1-9])(\.|$)"
#: Entities that are decoded, & last so that nothing is decoded twice.
ENTITIES = (("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"))
#: What redaction replaces, in this order.
REDACTIONS = (
    (r"-----BEGIN [A-Z ]*(?:PRIVATE KEY|CERTIFICATE)-----[\s\S]*?-----END [A-Z ]*(?:PRIVATE KEY|CERTIFICATE)-----", "[REDACTED_KEY]"),
    (r"""(?i)(\b(?:set-)?cookie['"]?\s*[:=]\s*['"]?)([^\n\r]+)""", "$1[REDACTED]"),
    (r"""(?i)(\bauthorization['"]?\s*[:=]\s*['"]?)([^\n\r]+)""", "$1[REDACTED]"),
    (r"""(?i)(\b[\w-]*token['"]?\s*[:=]\s*['"]?)([^\n\r]+)""", "$1[REDACTED]"),
    (r"""(?i)(\b[\w-]*(?:pass(?:word|wd|phrase)?|secret|api[_-]?key|apikey)['"]?\s*[:=]\s*['"]?)([^\n\r]+)""", "$1[REDACTED]"),
    (r"(?i)(--(?:token|pass(?:word|wd)?|secret|api[_-]?key)\s+)(\S+)", "$1[REDACTED]"),
    (r"""(?i)(/user/token/)[^/?\s"']+""", "$1<redacted>"),
    (r"(?i)(验证码|verification code|otp)(\s*[:=]?\s*)(\d{4,8})", "$1$2[REDACTED]"),
    (r"[\w.+-]+@[\w-]+\.[\w.-]+", "[REDACTED_EMAIL]"),
)
#: The same, each beginning where a match can begin or at its anchor word, so that no run of characters is read over and over.
ANCHORED = (
    REDACTIONS[0], *((p.replace(r"\b", "(?<![A-Za-z0-9_])"), to) for p, to in REDACTIONS[1:3]),  # letters beyond ASCII bound words, too
    (r"""(?i)(token['"]?\s*+[:=]\s*['"]?)([^\n\r]+)""", "$1[REDACTED]"),
    (r"""(?i)((?:pass(?:word|wd|phrase)?|secret|api[_-]?key|apikey)['"]?\s*+[:=]\s*['"]?)([^\n\r]+)""", "$1[REDACTED]"),
    *REDACTIONS[5:7],
    (r"(?i)(验证码|verification code|otp)(\s*+[:=]?\s*+)(\d{4,8})", "$1$2[REDACTED]"),
    (r"(?:\G|(?<![\w.+-]))[\w.+-]++@[\w-]++\.[\w.-]+", "[REDACTED_EMAIL]"),
)
#: All up to the last end of a key: no key begins behind it.
LAST_KEY = r"(?s)^(.*-----END [A-Z ]*(?:PRIVATE KEY|CERTIFICATE)-----)"
#: What a text must hold, in lower case, for any of these patterns to match: most texts skip them all.
NEEDED = ("-----begin", "cookie", "authorization", "token", "pass", "secret", "apikey", "api_key", "api-key", "--", "验证码", "verification code", "otp", "@")
#: A phone number between characters that aren't digits; neighbours share one, so this runs twice.
PHONE = r"(^|[^0-9])(?:\+?86[- ]?)?1[3-9][0-9]{9}($|[^0-9])"


@F.arrow_udf(T.StringType())
def nfc(texts: pa.Array) -> pa.Array:
    """Unicode NFC, for which Spark has no function; apply it to texts beyond ASCII only."""
    return each(texts, lambda x: None if x is None else unicodedata.normalize("NFC", x), pa.string())


def composed(c: Column) -> Column:
    """c in NFC; ASCII texts, the most, don't leave the JVM: Spark runs a Python function for every row, so it is given nulls for them."""
    beyond = c.rlike(r"[^\x00-\x7f]")
    return F.when(beyond, nfc(F.when(beyond, c))).otherwise(c)


def safe_filename(c: Column, most: int = 100) -> Column:
    """A file name: illegal characters to -, invisible and trailing ones out, cut by code points, reserved names marked, never empty. c is in NFC."""
    clean = F.regexp_replace(F.regexp_replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&quot;"), F.lit('"')), ILLEGAL, "-"), CONTROL, "")
    end = lambda x: F.regexp_replace(x, r"[\s.]+$", "")
    cut = end(F.substring(end(clean), 1, most))
    named = F.when(cut.rlike(RESERVED), F.concat(F.lit("_"), cut)).otherwise(cut)
    return F.when(named == "", "_").otherwise(named)


def safe_segment(c: Column) -> Column:
    return F.regexp_replace(c, r"[\\/]", "-")


def note_path(title: Column, instance: Column, folder: Column, short_id: Column | None, subdir: str = "Imports", segments: Column | None = None, flat: bool = False, most: int = 100) -> Column:
    """subdir/instance/(segments or folder of the kind)/title-id.md; flat is the name alone."""
    suffix = F.lit("") if short_id is None else F.concat(F.lit("-"), safe_filename(short_id, 32))
    room = most if short_id is None else most - 11
    body = F.regexp_replace(F.concat(safe_filename(title, room), suffix), r"[\[\]]", "")
    name = F.concat(F.when(body == "", "_").otherwise(body), F.lit(".md"))
    if flat:
        return name
    middle = folder if segments is None else F.when(F.size(segments) > 0, F.array_join(F.transform(segments, lambda s: safe_segment(safe_filename(s, 80))), "/")).otherwise(folder)
    return F.array_join(F.filter(F.array(F.lit(subdir), safe_segment(instance), middle, name), lambda x: x.isNotNull() & (x != "")), "/")


def asset_path(name: Column, instance: Column, item: Column, subdir: str = "Attachments", flat: bool = False) -> Column:
    clean = F.regexp_replace(safe_filename(name, 200), r"[\[\]#^]", "")
    safe = F.when(clean == "", "asset").otherwise(clean)
    parts = [F.lit(subdir), safe] if flat else [F.lit(subdir), safe_segment(instance), item, safe]
    return F.array_join(F.filter(F.array(*parts), lambda x: x.isNotNull() & (x != "")), "/")


def decode_entities(c: Column) -> Column:
    return reduce(lambda x, e: F.replace(x, F.lit(e[0]), F.lit(e[1])), ENTITIES, c)


def plain_text(html: Column) -> Column:
    """Tags to spaces, white space folded."""
    return F.trim(F.regexp_replace(F.regexp_replace(html, r"<[^>]*>", " "), r"\s+", " "))


@F.arrow_udf(T.StringType())
def _sanitized(html: pa.Array) -> pa.Array:
    return each(html, html_walk.sanitized, pa.string())


def sanitize_html(html: Column) -> Column:
    """HTML of an allow-list of tags and attributes with safe addresses, every element closed; see html_walk.sanitized."""
    return _sanitized(html)


def extract_images(html: Column, base: Column) -> Column:
    """Absolute image addresses in order, each once: data-original, data-src, src, or the first of srcset, whichever an image has first in this order."""
    from tarnfold.functions.urls import resolve_url

    tags = F.regexp_extract_all(html, F.lit(r"(?i)<img\b[^>]*>"), F.lit(0))
    value = lambda t, a: F.regexp_extract(t, rf"""(?i)\s{a}\s*=\s*["']([^"']+)["']""", 1)
    first = lambda t: F.coalesce(*(F.nullif(F.trim(value(t, a)), F.lit("")) for a in ("data-original", "data-src", "src")), F.nullif(F.regexp_extract(value(t, "srcset"), r"^\s*(\S+?)(?:[\s,]|$)", 1), F.lit("")))
    found = F.filter(F.transform(tags, first), lambda x: x.isNotNull() & ~x.rlike("(?i)^(data|javascript|vbscript):"))
    return F.array_distinct(F.transform(found, lambda x: resolve_url(base, x)))


def _texts(*names: str) -> pa.DataType:
    return pa.list_(pa.struct([(n, pa.string()) for n in names]))


_LINK = T.ArrayType(T.StructType([T.StructField("href", T.StringType()), T.StructField("text", T.StringType())]))


@F.arrow_udf(_LINK)
def _links(html: pa.Array) -> pa.Array:
    return each(html, lambda h: [{"href": href, "text": said} for href, said in html_walk.links_of(h)], _texts("href", "text"))


def extract_links(html: Column) -> Column:
    """Array of (href, text) of anchors in order; see html_walk.links_of. Null HTML has none."""
    return _links(html)


_ENTRY = T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in html_walk.ENTRY_FIELDS]))


@F.arrow_udf(_ENTRY)
def list_entries(html: pa.Array) -> pa.Array:
    """Array of the list entries of a page with their fields; see html_walk.entries_of. Null HTML has none."""
    return each(html, html_walk.entries_of, _texts(*html_walk.ENTRY_FIELDS))


def page_metadata(html: Column) -> Column:
    """Struct (title, author, published, image, description): JSON-LD first, then Open Graph, then meta tags; the first value wins.

    JSON-LD nodes are the blocks, the elements of blocks that are arrays, and those of @graph, of any number and order; in a graph articles
    are read before other nodes. Broken blocks are passed over.
    """
    blocks = F.regexp_extract_all(html, F.lit(r"""(?is)<script\b[^>]*type=["']application/ld\+json["'][^>]*>(.*?)</script>"""), F.lit(1))
    listed = lambda json: F.from_json(json, "array<string>")
    article = lambda n: F.coalesce(F.get_json_object(n, "$['@type']").rlike(r'Article(?:"|$)'), F.lit(False))

    def nodes(block: Column) -> Column:
        whole = F.to_json(F.try_parse_json(block))
        graph = listed(F.get_json_object(whole, "$['@graph']"))
        sorted_ = F.concat(F.filter(graph, article), F.filter(graph, lambda n: ~article(n)))
        return F.when(whole.isNull(), F.array().cast("array<string>")).when(whole.startswith("["), listed(whole)).when(F.get_json_object(whole, "$['@graph']").startswith("["), sorted_).otherwise(F.array(whole))

    every = F.flatten(F.transform(blocks, nodes))
    get = lambda n, *paths: F.coalesce(*(F.nullif(F.get_json_object(n, f"$.{p}"), F.lit("")) for p in paths))
    plain = lambda v: F.when(~v.rlike(r"^\s*[\[{]"), v)
    ld = lambda *paths: F.get(F.filter(F.transform(every, lambda n: plain(get(n, *paths))), lambda x: x.isNotNull()), 0)
    meta = lambda kind, name: F.nullif(F.regexp_extract(html, rf"""(?is)<meta\b[^>]*{kind}=["']{name}["'][^>]*content=["']([^"']*)["']""", 1), F.lit(""))
    return F.struct(
        F.coalesce(ld("headline", "name"), meta("property", "og:title"), meta("name", "title")).alias("title"), F.coalesce(ld("author.name", "author[0].name", "author"), meta("property", "article:author"), meta("name", "author")).alias("author"),
        F.coalesce(ld("datePublished"), meta("property", "article:published_time")).alias("published"), F.coalesce(ld("image.url", "image[0]", "image"), meta("property", "og:image")).alias("image"), F.coalesce(ld("description"), meta("property", "og:description"), meta("name", "description")).alias("description"),
    )


def page_title(html: Column, url: Column) -> Column:
    """Headline or og:title, the first h1 of the body, <title>, or the URL's title."""
    from tarnfold.functions.urls import title_from_url

    tag = lambda t: F.nullif(plain_text(F.regexp_extract(html, rf"(?is)<{t}\b[^>]*>(.*?)</{t}>", 1)), F.lit(""))
    return F.coalesce(page_metadata(html)["title"], tag("h1"), tag("title"), title_from_url(url))


def post_clean(md: Column) -> Column:
    """Markdown without leftover tags, dangerous links, control characters and runs of blank lines; fenced code is left alone."""
    parts = F.split(md, "```", -1)

    def clean(t: Column) -> Column:
        t = F.regexp_replace(t, "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]", "")
        t = F.regexp_replace(t, r"</?[A-Za-z][^<>]*>", "")
        t = F.regexp_replace(t, r"(?i)\[([^\]]*)\]\(\s*(?:javascript|vbscript|data):[^)]*\)", "$1")
        return F.regexp_replace(t, r"\n{3,}", "\n\n")

    return F.array_join(F.transform(parts, lambda p, i: F.when(i % 2 == 0, clean(p)).otherwise(p)), "```")


def link_target(path: Column) -> Column:
    """A path as the destination of a Markdown link: in angle brackets where it holds white space or brackets, with <, > and line ends encoded."""
    safe = F.regexp_replace(F.replace(F.replace(path, F.lit("<"), F.lit("%3C")), F.lit(">"), F.lit("%3E")), "[\r\n]+", "%0A")
    return F.when(safe.rlike(r"[\s()]"), F.concat(F.lit("<"), safe, F.lit(">"))).otherwise(safe)


def file_link(path: Column, style: str = "wiki") -> Column:
    """A link to a file of the library, as a wiki link or as a Markdown link named after the file."""
    if style == "wiki":
        return F.concat(F.lit("[["), path, F.lit("]]"))
    name = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"([\\\[\]])", r"\\$1")
    return F.concat(F.lit("["), name, F.lit("]("), link_target(path), F.lit(")"))


def render_note(source: Column, body: Column, author: Column, published: Column, url: Column, attachments: Column, style: str = "wiki") -> Column:
    """Info block, body, and the list of attachments; lines without a value are left out. style: of links to files, wiki or markdown."""
    line = lambda label, value: F.when(value.isNotNull(), F.concat(F.lit(f"> - {label}"), value))
    head = F.array(F.lit("> [!info] Source"), line("Source: ", source), line("Author: ", author), line("Published: ", published), F.when(url.isNotNull(), F.concat(F.lit("> - [Original](<"), url, F.lit(">)"))))
    files = F.when(F.size(attachments) > 0, F.concat(F.array(F.lit("## Attachments"), F.lit("")), F.transform(attachments, lambda a: F.concat(F.lit("- "), file_link(a, style))), F.array(F.lit("")))).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.filter(F.concat(head, F.array(F.lit(""), F.coalesce(body, F.lit("")), F.lit("")), files), lambda x: x.isNotNull()), "\n")


def front_matter(fields: list[tuple[str, Column]], tags: Column | None = None) -> Column:
    """Fields in their order as quoted scalars between --- lines; nulls are left out; tags as a flow list after the first two."""
    quoted = lambda v: F.concat(F.lit('"'), F.replace(F.replace(v, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    lines = [F.when(v.isNotNull(), F.concat(F.lit(f"{k}: "), quoted(F.regexp_replace(v.cast("string"), "[\r\n]+", " ")))) for k, v in fields]
    if tags is not None:
        lines.insert(2, F.when(F.size(tags) > 0, F.concat(F.lit("tags: ["), F.array_join(F.transform(tags, quoted), ", "), F.lit("]"))))
    return F.concat(F.lit("---\n"), F.array_join(F.filter(F.array(*lines), lambda x: x.isNotNull()), "\n"), F.lit("\n---\n"))


def redact(c: Column, home: str | None = None) -> Column:
    """c without keys, cookies, tokens, passwords, codes, addresses and phone numbers, and without the home folder. Work is in proportion to the text."""
    may = reduce(Column.__or__, [F.contains(F.lower(c), F.lit(w)) for w in NEEDED])
    ended = F.regexp_extract(c, LAST_KEY, 1)
    keyless = F.when(F.contains(c, F.lit("-----BEGIN")), F.concat(F.regexp_replace(ended, *ANCHORED[0]), F.substring(c, F.char_length(ended) + 1, F.lit((1 << 31) - 1)))).otherwise(c)
    out = F.when(may, reduce(lambda x, r: F.regexp_replace(x, r[0], r[1]), ANCHORED[1:], keyless)).otherwise(c)
    phones = reduce(lambda x, _: F.regexp_replace(x, PHONE, "$1[REDACTED_PHONE]$2"), range(2), out)
    out = F.when(c.rlike("1[3-9][0-9]{9}"), phones).otherwise(out)
    if home and home != "/":
        out = F.regexp_replace(out, "(?i)" + "[\\\\/]".join(re.escape(p) for p in home.replace("\\", "/").split("/")), "[HOME]")
    return out


def csv_guard(c: Column) -> Column:
    """A leading ' before text that a spreadsheet would run as a formula; plain numbers are left alone."""
    number = c.rlike(r"^\s*[+-]?([0-9]+(\.[0-9]+)?|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$")
    return F.when(c.rlike(r"^\s*[=+\-@\t\r\n]") & ~number, F.concat(F.lit("'"), c)).otherwise(c)
