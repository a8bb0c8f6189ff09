"""URL expressions. Hosts, tracking keys and paths are parameters; parts are taken by one pattern, so any engine with regular expressions gives the same."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PARTS = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$"
#: Query keys that only track; keys that start with utm_ do, too.
TRACKING = ("from", "source", "log_from", "wid", "share_token", "appshare", "ref")
#: Words for a content kind in hints.
KIND_HINTS = {
    "article": ("article", "文章", "普通文章"), "short-post": ("short-post", "微头条", "短文本"), "gallery": ("gallery", "图集"), "question-answer": ("question-answer", "问答", "wenda"),
    "video": ("video", "视频"), "note": ("note", "笔记"), "external-link": ("external-link", "外部链接"),
}
#: Path patterns for a content kind, tried in order on the lower-cased path.
KIND_PATHS = (("article", "/(article|a|group)/"), ("question-answer", "/wenda/"), ("video", "/video/"), ("short-post", "/w/[0-9]+"))


def part(url: Column, n: int) -> Column:
    """1 scheme, 2 host with port, 3 path, 4 query with ?, 5 fragment with #."""
    return F.regexp_extract(url, PARTS, n)


def host(url: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(part(url, 2), r"^.*@", ""), r":\d*$", ""))


def on_hosts(url: Column, hosts: tuple[str, ...]) -> Column:
    """The host is one of these or a subdomain of one; look-alikes that merely end alike aren't."""
    h = F.concat(F.lit("."), host(url))
    out = F.lit(False)
    for x in hosts:
        out = out | h.endswith("." + x)
    return out


def canonical_url(url: Column, hosts: tuple[str, ...], tracking: tuple[str, ...] = TRACKING) -> Column:
    """On these hosts and by http or https: no fragment, no tracking keys, parameters sorted by key. Any other text is left alone."""
    name = lambda p: F.lower(F.split_part(p, F.lit("="), F.lit(1)))
    params = F.filter(F.split(F.regexp_replace(part(url, 4), "^[?]", ""), "&"), lambda p: (p != "") & ~name(p).startswith("utm_") & ~name(p).isin(*tracking))
    keyed = F.transform(params, lambda p, i: F.struct(F.split_part(p, F.lit("="), F.lit(1)).alias("k"), i.alias("i"), p.alias("p")))
    query = F.array_join(F.transform(F.array_sort(keyed), lambda x: x["p"]), "&")
    path = F.when(part(url, 3) == "", "/").otherwise(part(url, 3))
    out = F.concat(F.lower(part(url, 1)), F.lit("://"), F.lower(part(url, 2)), path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.when(F.lower(part(url, 1)).isin("http", "https") & on_hosts(url, hosts), out).otherwise(url)


def content_id(url: Column, hosts: tuple[str, ...], path: str) -> Column:
    """Group 1 of the path pattern on these hosts, else null."""
    found = F.regexp_extract(part(url, 3), path, 1)
    return F.when(on_hosts(url, hosts) & (found != ""), found)


def dedup_key(url: Column, page_id: Column, hosts: tuple[str, ...], path: str) -> Column:
    return F.coalesce(content_id(url, hosts, path), page_id, canonical_url(url, hosts))


def content_kind(url: Column, hint: Column) -> Column:
    h, p = F.lower(F.trim(hint)), F.lower(part(url, 3))
    out = F.when(F.lit(False), "")
    for kind, words in KIND_HINTS.items():
        out = out.when(h.isin(*words), kind)
    for kind, pattern in KIND_PATHS:
        out = out.when(p.rlike(pattern), kind)
    return out.otherwise("unknown")


def repair_list_url(raw: Column) -> Column:
    """The first non-empty line without zero-width characters, with a scheme if it looks like a host, and & for a second ? in its query."""
    lines = F.filter(F.transform(F.split(F.coalesce(raw, F.lit("")), "\r?\n"), lambda x: F.trim(x)), lambda x: x != "")
    clean = F.regexp_replace(F.coalesce(F.get(lines, 0), F.lit("")), "[\u200b\u200c\u200d\ufeff]", "")
    bare = ~clean.rlike("(?i)^https?://") & clean.rlike(r"(?i)^(www\.|[a-z0-9-]+(\.[a-z0-9-]+)+)([:/?#]|$)")
    full = F.when(bare, F.concat(F.lit("https://"), clean)).otherwise(clean)
    before, query, after = F.regexp_extract(full, r"^([^?#]*)(\?[^#]*)?(#.*)?$", 1), F.regexp_extract(full, r"^([^?#]*)(\?[^#]*)?(#.*)?$", 2), F.regexp_extract(full, r"^([^?#]*)(\?[^#]*)?(#.*)?$", 3)
    return F.when(full.rlike("(?i)^https?://"), F.concat(before, F.when(query != "", F.concat(F.lit("?"), F.replace(F.regexp_replace(query, "^[?]", ""), F.lit("?"), F.lit("&")))).otherwise(""), after)).otherwise(full)


def resolve_url(base: Column, href: Column) -> Column:
    """href against base: absolute, //host, /path, ?query, #fragment, or relative with dot segments."""
    origin = F.concat(part(base, 1), F.lit("://"), part(base, 2))
    folder = F.regexp_replace(F.when(part(base, 3) == "", "/").otherwise(part(base, 3)), "[^/]*$", "")
    path, rest = F.regexp_extract(href, r"^([^?#]*)(.*)$", 1), F.regexp_extract(href, r"^([^?#]*)(.*)$", 2)
    whole = F.when(path.startswith("/"), path).otherwise(F.concat(folder, path))
    step = lambda a, x: F.when(x == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).when(x.isin("", "."), a).otherwise(F.array_append(a, x))
    kept = F.aggregate(F.split(whole, "/"), F.array().cast("array<string>"), step)
    ends = F.when(whole.rlike(r"(/|/\.|/\.\.)$") & (F.size(kept) > 0), "/").otherwise("")
    return (
        F.when(href.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), href).when(href.startswith("//"), F.concat(part(base, 1), F.lit(":"), href)).when(path != "", F.concat(origin, F.lit("/"), F.array_join(kept, "/"), ends, rest))
        .when(href.startswith("?"), F.concat(origin, part(base, 3), href)).when(href.startswith("#"), F.concat(origin, part(base, 3), part(base, 4), href)).otherwise(base)
    )


def needs_redirect(url: Column, hosts: tuple[str, ...], path: str = "^/is/([^/?#]+)") -> Column:
    """A share link of these hosts whose token isn't a number."""
    token = F.regexp_extract(part(url, 3), path, 1)
    return F.coalesce(on_hosts(url, hosts) & F.lower(part(url, 1)).isin("http", "https") & (token != "") & ~token.rlike("^[0-9]+$"), F.lit(False))


def asset_key(url: Column, cdn: str = r"/(?:tos-|img/|large/)([^?#]+)") -> Column:
    """The content path of a CDN address, else the address before its query."""
    found = F.regexp_extract(url, cdn, 1)
    return F.when(found != "", found).otherwise(F.split_part(url, F.lit("?"), F.lit(1)))


def title_from_url(url: Column) -> Column:
    """The first two parts of the path, decoded, else the host."""
    parts = F.slice(F.filter(F.split(part(url, 3), "/"), lambda x: x != ""), 1, 2)
    decoded = F.transform(parts, lambda x: F.coalesce(F.try_url_decode(x), x))
    return F.when(F.size(parts) > 0, F.array_join(decoded, " ")).otherwise(host(url))
