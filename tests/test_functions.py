from __future__ import annotations

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from tarnfold.functions import arrays, identity, text, times, urls

HOSTS = ("example.com",)


def one(spark, value, make, kind: str = "string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(make(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize(
    ("url", "expected"),
    [
        ("https://www.example.com/a?b=2&a=1&utm_id=9&From=x#top", "https://www.example.com/a?a=1&b=2"),
        ("HTTP://EXAMPLE.com", "http://example.com/"),
        ("https://evilexample.com/a?utm_source=1#x", "https://evilexample.com/a?utm_source=1#x"),
        ("ftp://example.com/a#x", "ftp://example.com/a#x"),
        ("not a url", "not a url"),
        (None, None),
        ("https://example.com/p?a=2&a=1", "https://example.com/p?a=2&a=1"),
    ],
)
def test_canonical_url(spark, url, expected):
    assert one(spark, url, lambda c: urls.canonical_url(c, HOSTS)) == expected


@pytest.mark.parametrize(
    ("href", "expected"),
    [("/x/../y", "https://h.com/y"), ("z", "https://h.com/a/z"), ("../z/", "https://h.com/z/"), ("//o.com/p", "https://o.com/p"), ("?q=1", "https://h.com/a/b?q=1"), ("#f", "https://h.com/a/b?k=v#f"), ("mailto:x@y", "mailto:x@y"), ("", "https://h.com/a/b?k=v"), ("../../../z", "https://h.com/z")],
)
def test_resolve_url(spark, href, expected):
    assert one(spark, href, lambda c: urls.resolve_url(F.lit("https://h.com/a/b?k=v"), c)) == expected


@pytest.mark.parametrize(
    ("name", "expected"),
    [("CON", "_CON"), ("a/b\\c:d", "a-b-c-d"), ("x. . ", "x"), ("", "_"), (None, "_"), ("tab\there", "tabhere"), ("#tag", "-tag"), ("lpt1.txt", "_lpt1.txt"), ("a\u200bb", "ab"), ("😀" * 5, "😀" * 4)],
)
def test_safe_filename(spark, name, expected):
    assert one(spark, name, lambda c: text.safe_filename(c, 4 if name and name[0] == "😀" else 100)) == expected


def test_nfc_composes_only_beyond_ascii(spark):
    assert one(spark, "e\u0301", text.composed) == "\u00e9"
    assert one(spark, "plain", text.composed) == "plain"


@pytest.mark.parametrize(
    ("line", "expected"),
    [
        ("Set-Cookie: a=b; c=d", "Set-Cookie: [REDACTED]"),
        ('{"authorization": "Bearer x"}', '{"authorization": "[REDACTED]'),
        ("db_password = hunter2 and more", "db_password = [REDACTED]"),
        ("run --token abc next", "run --token [REDACTED] next"),
        ("mail me@example.com now", "mail [REDACTED_EMAIL] now"),
        ("call 13812345678,13912345678", "call [REDACTED_PHONE],[REDACTED_PHONE]"),
        ("id 9138123456789", "id 9138123456789"),
        ("-----BEGIN RSA PRIVATE KEY-----\nAAA\n-----END RSA PRIVATE KEY-----", "[REDACTED_KEY]"),
        ("otp: 123456", "otp: [REDACTED]"),
        (None, None),
    ],
)
def test_redact(spark, line, expected):
    assert one(spark, line, text.redact) == expected


def test_redact_home(spark):
    assert one(spark, "in C:\\Users\\me\\x", lambda c: text.redact(c, "c:/users/me")) == "in [HOME]\\x"


@pytest.mark.parametrize(("cell", "expected"), [("=1+1", "'=1+1"), (" -5", " -5"), ("-x", "'-x"), ("+1.5e3", "+1.5e3"), ("@a", "'@a"), ("plain", "plain"), ("", ""), (None, None)])
def test_csv_guard(spark, cell, expected):
    assert one(spark, cell, text.csv_guard) == expected


@pytest.mark.parametrize(
    ("html", "gone"),
    [("<p>a</p><script>x()</script>", "script"), ('<a href="javascript:x">t</a>', "javascript"), ('<p onclick="x">t</p>', "onclick"), ("<iframe src=x></iframe>", "iframe"), ('<img src=" data:text/html,x">', "data:")],
)
def test_sanitize_html(spark, html, gone):
    assert gone not in one(spark, html, text.sanitize_html)


def test_post_clean_keeps_code(spark):
    md = "a <b>x</b>\n\n\n\n[y](javascript:z)\n```\n<b>\n\n\n\n</b>\n```"
    assert one(spark, md, text.post_clean) == "a x\n\ny\n```\n<b>\n\n\n\n</b>\n```"


def test_entities_decode_once(spark):
    assert one(spark, "&amp;quot; &lt; &quot;&#39;&nbsp;", text.decode_entities) == "&quot; &lt; \"' "


def test_page_metadata(spark):
    html = '<meta property="og:title" content="og"><script type="application/ld+json">[{"headline":"ld","author":[{"name":"who"}],"datePublished":"2024-01-02"}]</script>'
    r = one(spark, html, text.page_metadata)
    assert (r["title"], r["author"], r["published"]) == ("ld", "who", "2024-01-02")
    assert one(spark, "<p>none</p>", text.page_metadata)["title"] is None


@pytest.mark.parametrize(("hexed", "mime"), [("FFD8FF00", "image/jpeg"), ("52494646AABBCCDD57454250", "image/webp"), ("52494646AABBCCDD41564920", None), ("", None)])
def test_sniff_mime(spark, hexed, mime):
    assert one(spark, hexed, lambda c: arrays.sniff_mime(F.unhex(c))) == mime


@pytest.mark.parametrize(("raw", "error"), [("QUJD", None), ("QUI=", None), (" Q U\nJD", None), ("QUJ", "bad_length"), ("Q!JD", "illegal_characters"), ("", "empty"), (None, "empty")])
def test_decode_base64(spark, raw, error):
    assert one(spark, raw, arrays.decode_base64)["error"] == error


@pytest.mark.parametrize(("raw", "iso"), [("20240102T030405Z", "2024-01-02T03:04:05Z"), ("20241301T000000Z", None), ("x", None), (None, None)])
def test_export_time(spark, raw, iso):
    assert one(spark, raw, times.export_time) == iso


@pytest.mark.parametrize(("n", "shown"), [(0, "0 B"), (1023, "1023 B"), (1280, "1.3 KB"), (5 * 1024**2, "5.0 MB"), (3 * 1024**3, "3.0 GB")])
def test_human_bytes(spark, n, shown):
    assert one(spark, n, times.human_bytes, "long") == shown


@pytest.mark.parametrize(("name", "place"), [("Stack@@@Book", ("Stack", "Book")), ("@@@Book", (None, "@@@Book")), ("Plain", (None, "Plain")), ("a@@@b@@@c", ("a", "b@@@c"))])
def test_split_stack(spark, name, place):
    assert tuple(one(spark, name, lambda c: arrays.split_stack(c, "@@@"))) == place


def test_fingerprint_errors(spark):
    row = spark.createDataFrame([(" ", "a\0b")], "e string, n string")
    made = row.select(identity.fingerprint_error(title=F.col("e")).alias("a"), identity.fingerprint_error(title=F.col("n")).alias("b"), identity.fingerprint_error(raw=F.col("n")).alias("c")).first()
    assert tuple(made) == ("all_empty", "nul_in_field", None)


def test_config_hash_ignores_key_order(spark):
    assert one(spark, '{"a":1,"b":{"c":2,"d":3}}', identity.config_hash) == one(spark, '{"b":{"d":3,"c":2},"a":1}', identity.config_hash)
    assert one(spark, "{broken", identity.config_hash) is None


PIECES = ["token", "=", ":", " ", "\n", "-", "a", "a-", "password", "pass", "secret", "api-key", "apikey", "@", "b.c", "+", "x", "'", '"', "otp", "1234", "cookie", "set-", "--token ", "-----BEGIN RSA PRIVATE KEY-----", "-----END RSA PRIVATE KEY-----", "-----BEGIN CERTIFICATE-----", "-----END CERTIFICATE-----", "authorization", "\u00e9", "_", "db_", "/user/token/", "\u9a8c\u8bc1\u7801", "?", "   "]


def test_redact_gives_what_its_plain_patterns_give(spark):
    rng = random.Random(1)
    rows = ["".join(rng.choices(PIECES, k=rng.randrange(1, 30))) for _ in range(5000)]

    def plain(t):
        for pattern, to in text.REDACTIONS:
            t = re.sub(pattern, re.sub(r"\$(\d)", r"\\\1", to), t, flags=re.ASCII)
        return t

    got = {r["c"]: r["r"] for r in spark.createDataFrame([(t,) for t in rows], "c string").select("c", text.redact(F.col("c")).alias("r")).collect()}
    assert got == {t: plain(t) for t in rows}


@pytest.mark.parametrize("part", ["a-", "otp ", " ", "-----BEGIN PRIVATE KEY-----", "a@", "a.", "pass", "token ", "-----BEGIN A"])
def test_redaction_is_linear(spark, part):
    run = "token otp" + part * (5_000_000 // len(part)) + "token@"
    began = time.perf_counter()
    assert spark.createDataFrame([(run,)], "c string").select(F.length(text.redact(F.col("c")))).first()[0] > 0
    assert time.perf_counter() - began < 60


def test_metadata_of_graphs_and_arrays(spark):
    def meta(*blocks):
        html = "".join(f'<script type="application/ld+json">{b}</script>' for b in blocks)
        return one(spark, html, lambda c: text.page_metadata(c))

    other = ",".join('{"@type":"WebPage","headline":"page %d","author":"site"}' % i for i in range(4))
    fifth = meta('{"@graph":[%s,{"@type":["Thing","NewsArticle"],"headline":"fifth","author":[{"name":"me"}],"image":["i.png","j.png"]}]}' % other)
    assert (fifth["title"], fifth["author"], fifth["image"]) == ("fifth", "me", "i.png")
    third = meta("{broken", '[{"x":1},{"y":2},{"headline":"third","datePublished":"2024"}]', '{"headline":"late","description":"d"}')
    assert (third["title"], third["published"], third["description"]) == ("third", "2024", "d")
    assert meta('{"@graph":[]}')["title"] is None and meta('{"name":"n","author":{"name":"a"},"image":{"url":"u"}}')["image"] == "u"


def test_python_gets_bounded_parts():
    import pyarrow as pa

    from tarnfold.functions.slices import each, slices

    texts = pa.array(["x" * 100_000, None] * 3000)
    parts = list(slices(pa.RecordBatch.from_arrays([texts], ["t"])))
    assert sum(p.num_rows for p in parts) == 6000 and max(p.num_rows for p in parts) <= 1024 and max(p.nbytes for p in parts) <= 8 << 20
    assert each(texts, lambda t: t and t[:2], pa.string()).to_pylist() == ["xx", None] * 3000
    assert each(texts.slice(0, 0), str, pa.string()).to_pylist() == []


def test_ascii_texts_are_not_composed_in_python(spark):
    def refuse(texts):
        return texts.to_pylist() and __import__("pyarrow").array([None if t is None else "beyond" if not t.isascii() else 1 // 0 for t in texts.to_pylist()])

    own, text.nfc = text.nfc, F.arrow_udf(refuse, "string")
    try:
        rows = spark.createDataFrame([("a",), ("e\u0301",), (None,)], "t string").select(text.composed(F.col("t")).alias("t"))
        assert [r["t"] for r in rows.collect()] == ["a", "beyond", None]
    finally:
        text.nfc = own


def test_html_job_carries_columns_exactly(spark):
    from tarnfold.operators.html_body import pick_body
    from tarnfold.operators.html_job import html_job

    pages = spark.createDataFrame([(1, (1 << 53) + 1, "<p>a</p>"), (2, None, None)], "k long, at long, html string").coalesce(1)
    assert [tuple(r) for r in html_job(pages, "k", carry=["at"]).select("k", "at", "markdown").collect()] == [(1, (1 << 53) + 1, "a"), (2, None, "")]
    assert [tuple(r) for r in pick_body(pages.select("at", "html"), "at").collect()] == [((1 << 53) + 1, "<p>a</p>"), (None, "")]
