"""Extraction, packing, quality, tokens, neighbours, SimHash and the pipeline: brute force, round trips, held-out accuracy."""

from __future__ import annotations

import bisect
import random
import re
import types

import numpy as np
import pyarrow as pa
import pytest
from oracle import SF
from pyspark.sql import functions as F

from tarnfold.llm import common, components, extraction, neighbours, packing, quality, queries, simhash, tokens

JSON = tokens.vocabulary("byte_bpe_50k.json")
LIBRARY = tokens.library(JSON)


def run(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids

DOCS = "doc_id long, text string, fp string, piece string, score string, node string"


def docs(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash", "clash", "clash") for r in rows], DOCS)


EDGES = [(1, "a b c d e f g"), (1, "a b c d e f g"), (2, None), (3, ""), (None, "no id"), (4, "word " * 30000), (5, "<|endoftext|> inside"), (6, "\n\n  ")]


# --- extraction


def markup_text(html):
    """What markup alone gives where nothing repeats."""
    article, outside, marked = extraction.page_parts(html)
    return " ".join(w for block, m in zip(outside, marked, strict=True) if not m for w in block) if article is None else article


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<nav>menu</nav><article><h1>T</h1><p>a&amp;b<b>c</b>\n d</p><aside>x</aside></article><footer>f</footer>", "T a&bc d"),
        ("<article><p>one<p>two<div class='ad'>buy</div><section id=comments><p>hi</p></section><p>three</article>", "one two three"),
        ('<script>if (a < b) "</p>"</script><style>p{}</style><article>x<script>y</script><br>z</article>', "x z"),
        ("<main><header>H</header><p>body</p></main>", "H body"),
        ('<body><header>H</header><div class="with-sidebar"><p>kept</p></div><div class="cookie-notice">no</div></body>', "kept"),
        ('<article><p>kept</p><div class="ad-slot">no</div><ul class="share-buttons"><li>no</ul><DIV ID="comments-area"><article class="comment">no</article></DIV><p title="a > b">end</p></article>', "kept end"),
        ("<article>a &lt;b&gt; &#233;&nbsp;c</article>", "a <b> é c"),
        ("<article><p>unclosed <b>bold", "unclosed bold"),
        (None, ""), ("", ""), ("plain text", "plain text"), ("<article></article><p>outside</p>", "outside"),
        ("<article><p title=it's>hello <b>world</b> it's nice</p><p class='a>b'>quoted</p><p title=\"open>rest</p></article>", "hello world it's nice quoted rest"),
        ("<div><article class=card><p>teaser card</p></article></div><div><p>the main text of this page is long</p><p>and has more words than the card</p></div>", "teaser card the main text of this page is long and has more words than the card"),
        ("<article>so <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></math> holds</article>", "so x=2 holds"),
    ],
)
def test_page_parts(html, text):
    assert markup_text(html) == text


STORY = " ".join(f"word{i}" for i in range(60))
OTHER = " ".join(f"more{i}" for i in range(60))


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (f'<div class="page-with-sidebar"><article>{STORY}</article></div>', STORY),
        (f'<body><form id="aspnetForm"><nav>menu</nav><article>{STORY}</article></form></body>', STORY),
        (f'<body><form id="aspnetForm"><div>{STORY}</div></form><p>foot</p></body>', f"{STORY} foot"),
        (f'<div id="content-no-nav"><article>{STORY}</article></div>', STORY),
        (f'<div class="sidebar-layout ads"><header>H</header><article>{STORY}</article></div>', STORY),
        (f'<article class="cookies-recipe">{STORY}</article>', STORY),
        (f'<article class="ad">{STORY}</article><div class="ad">buy</div>', STORY),
        (f'<article><div class="social-studies">{STORY}</div></article>', STORY),
        (f'<article><p role="alert">{STORY}</p><div role="alert">no</div></article>', STORY),
        (f'<article>{STORY}<div class="related-work">a</div><p class="notice-period">b</p><p class="share-price">c</p><p class="market-share">d</p></article>', f"{STORY} a b c d"),
        (f"<nav><a>Home</a><article>{STORY}</article>", STORY),
        (f"<footer><main>{STORY}</main>", STORY),
        (f'<nav><a href="/">Home</a><p>{STORY}</p>', f"Home {STORY}"),
        (f'<article>{STORY}</article><div class="reader-responses"><article>{OTHER}</article><article>{OTHER}</article></div>', STORY),
        (f'<article>{STORY}</article><div class="discussion"><article>{OTHER} x</article></div>', STORY),
        (f'<article>{STORY}<section id="discussion"><p>section</p></section></article>', f"{STORY} section"),
        (f'<div class="discussion"><article>{STORY}</article></div>', STORY),
        (f'<article>{STORY}</article><section id="comments"><article>{OTHER} {OTHER}</article></section>', STORY),
        ("".join(f"<article>teaser {i} a b c d</article>" for i in range(9)) + f"<div>{STORY}</div>", " ".join(f"teaser {i} a b c d" for i in range(9)) + f" {STORY}"),
        (f'<div>{STORY}</div><aside><article>{STORY[:200]}</article></aside>', STORY),
        (f'<div class="menu"><a>{STORY}</a> <a>{OTHER}</a></div><p>short</p>', "short"),
        ("<nav><a>Home</a></nav><article></article><footer>all rights reserved</footer>", ""),
        (f'<article>{STORY}</article><div class="related-posts"><article>teaser</article></div><div class="cookie-notice">ok</div><div class="newsletter-signup">x</div>', STORY),
        (f'<article>{STORY}</article><div hidden><article>{OTHER} {OTHER}</article></div>', STORY),
    ],
)
def test_marks_around_the_text_remove_nothing(html, text):
    assert markup_text(html) == text


def test_hostile_pages_take_work_in_proportion():
    import time

    for part in ("<div>x</p>", "<div class=ad><p>x", "<article>x</div>", "<div class=discussion><article>x"):
        begin = time.monotonic()
        extraction.page_parts(part * 40_000)
        assert time.monotonic() - begin < 20


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<article>a<script>for(var i=0;i<n;i++){f(i)}</script>b</article><script>x</script>", "a b"),
        ("<head><title>a<b</title><script>if(i<n){s='it'}</SCRIPT ></head><body><article>kept</article></body>", "kept"),
        ("<script>s = \"don't\"; i<n</script><style>a<b{}</style><article>kept</article>", "kept"),
        ("<html><head><title>T</title><meta charset=utf-8><body><article>kept</article>", "kept"),
        ("<head><title>T</title><article>kept</article>", "kept"),
        ("<head><title>T</title>plain <p>text", "plain text"),
        ("<head><!-- c --><template><div>no</div></template><link href=x></head><p>kept", "kept"),
        ("<article>a<textarea><b</textarea>b<iframe><p</iframe>c</article>", "a b c"),
        ("<article>kept</article><script>i<n", "kept"),
    ],
)
def test_raw_text_and_open_heads(html, text):
    assert markup_text(html) == text


def test_suffix_array_against_sorting():
    rnd = np.random.default_rng(1)
    for stream in (rnd.integers(0, 3, 300), np.zeros(90, int), np.arange(40), np.array([], int), np.array([5]), np.tile(np.arange(7), 20)):
        stream = stream.astype(np.uint64)
        order, common = extraction.suffix_array(stream)
        suffixes = [stream[i:].tolist() for i in order.tolist()]
        assert suffixes == sorted(stream[i:].tolist() for i in range(len(stream)))
        for k in range(1, len(suffixes)):
            a, b = suffixes[k - 1], suffixes[k]
            assert common[k] == next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


def test_stream_heads_against_brute_force():
    rnd = random.Random(2)
    pages = [(i * 11, [f"w{rnd.randint(0, 3)}" for _ in range(rnd.randint(0, 60))]) for i in range(12)]
    hashed = [(p, extraction.token_hashes(w)) for p, w in pages]
    head, least, most, n = extraction.stream_heads(hashed, 4)
    want = {}
    for p, w in hashed:
        for h in extraction.head_hashes(w, 4).tolist():
            a, b, k = want.get(h, (p, p, 0))
            want[h] = (min(a, p), max(b, p), k + 1)
    assert {h: x for h, *x in zip(head.tolist(), zip(least.tolist(), most.tolist(), n.tolist(), strict=True), strict=True)} == {h: [x] for h, x in want.items()}


PAGES = "page_id long, url string, html string"


def test_host_boilerplate_is_removed(spark):
    top, end = "Home News Sport all the latest from around the world", "All rights reserved by the owners of this site since the year one"
    rows = [(i, f"http://h.example/{i}", f"<body><div>{top}</div><p>story {i} is told {i} here</p><div>{end}</div></body>") for i in range(5)]
    rows += [(6, "http://h.example/6", f"<body><div>{top}</div><article><p>an article of its own</p><p>{end}</p></article><div>{end}</div></body>")]
    rows += [(9, "http://other.example/", rows[0][2]), (9, "http://other.example/", rows[0][2]), (10, None, None), (None, "broken [", "<p>x</p>")]
    out = extraction.main_text(spark.createDataFrame(rows, PAGES).withColumn("text", F.lit("clash"))).collect()
    assert len(out) == len(rows)
    by = {r["page_id"]: r for r in out}
    assert all(by[i]["text"] == f"story {i} is told {i} here" and by[i]["n_repeated"] == len(f"{top} {end}".split()) and by[i]["longest_repeat"] == len(end.split()) for i in range(5))
    assert by[6]["text"] == f"an article of its own {end}" and by[6]["n_repeated"] is None  # the article's own words stay
    assert by[9]["text"].startswith("Home") and by[10]["text"] == "" and by[None]["n_chars"] == 1
    assert extraction.main_text(spark.createDataFrame([], PAGES)).count() == 0


def test_pages_without_markup_keep_what_is_unique(spark):
    """The given pages with every tag a plain div and one site frame: what is left is the articles and each page's own menu and advert."""
    frame = "this frame of the site stands on each and every page of it"
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    bare = lambda h: re.sub(r"</?(?:article|nav|footer|h1|ul|li|p)\b[^>]*>", "<div>", re.sub(r"<div[^>]*>|</div>", "<div>", h))
    rows = [(r["page_id"], "http://one.example/", bare(r["html"]).replace("</head><body>", f"</head><body><div>{frame}</div>")) for r in pages]
    got = {r["page_id"]: r for r in extraction.main_text(spark.createDataFrame(rows, PAGES)).collect()}
    whole = {r["page_id"]: r["text"] for r in queries.op3_extraction(spark, SF).collect()}
    assert all(frame not in r["text"] and r["n_repeated"] >= len(frame.split()) for r in got.values())
    whole_kept = [set(whole[i].split()) <= set(r["text"].split()) for i, r in got.items()]
    assert sum(whole_kept) >= 20  # the others are near copies of each other, or share passages
    assert all(kept or r["n_repeated"] > len(frame.split()) for kept, r in zip(whole_kept, got.values(), strict=True))


def test_hot_heads_are_dealt_out(spark, monkeypatch):
    join = extraction.salted_join
    monkeypatch.setattr(extraction, "salted_join", lambda *args, **more: join(*args, **more, least=3))
    rows = [(i, "http://h.example/", f"<p>the very same words of the site on all of its pages</p><p>own {i}</p>") for i in range(60)]
    got = extraction.main_text(spark.createDataFrame(rows, PAGES), stream_tokens=50).collect()
    assert all(r["text"] == f"own {r['page_id']}" and r["n_repeated"] == 12 for r in got) and len(got) == 60


def test_extraction_of_the_table(spark):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = {r["page_id"]: r["text"] for r in queries.op3_extraction(spark, SF).collect()}
    import html

    want = {p: " ".join(html.unescape(re.sub("<[^>]+>", " ", re.sub("</?b>", "", re.search("(?s)<article>(.*?)</article>", h)[1]))).split()) for p, h in pages.items()}
    assert got == want


# --- tokens and packing


def test_remembered_words_give_the_ids_of_whole_texts():
    encode = tokens.word_encoder(JSON)
    texts = [f"a{chr(c)}b {chr(c)} 1{chr(c)}\n {chr(c)}" for c in [*range(0, 0x3000, 3), *range(0x3000, 0x20000, 97), 0x10FFFF] if not 0xD800 <= c < 0xE000]
    assert [e.tolist() for e in encode(texts)] == [run(t) for t in texts]
    assert [e.tolist() for e in encode([None, "", "<|endoftext|>", "x<|endoftext|><|endoftext|> y", "x" * 100 + " x"])] == [run(t) for t in ("", "", "<|endoftext|>", "x<|endoftext|><|endoftext|> y", "x" * 100 + " x")]


def test_memory_of_words_is_bounded(monkeypatch):
    monkeypatch.setattr(tokens, "_MEMORY", 50)
    encode = tokens.word_encoder.__wrapped__(JSON)
    texts = [" ".join(f"w{i % 70} common" for i in range(k, k + 60)) for k in range(0, 200, 20)]
    for t in (texts[:3], texts[3:], texts):
        assert [e.tolist() for e in encode(t)] == [run(x) for x in t]


def test_fields_parted_by_arrow_give_the_ids_of_whole_texts():
    spaces = [chr(c) for c in range(0x3001) if chr(c).isspace()] + ["\u180e", "\u200b", "\0", "\x01"]
    rnd, some = random.Random(2), ["a", "B", "é", "×", "中", "\n", " ", "  ", "\t", ".", "'s", "'", "9", "<|endoftext|>", "the ", " \n", "\x01", "\u3000"]
    texts = [f"a{x}b{y}c {x}d{y} e" for x in spaces for y in spaces] + ["".join(rnd.choice(some) for _ in range(rnd.randint(0, 60))) for _ in range(3000)]
    assert [e.tolist() for e in tokens.word_encoder(JSON)(texts)] == [run(t) for t in texts]


def test_new_words_go_to_the_library_by_lines(monkeypatch):
    sent, tokenizer = [], tokens.library(JSON)

    class Spy:
        def __getattr__(self, name):
            return getattr(tokenizer, name)

        def encode_batch_fast(self, texts, **options):
            sent.extend(texts)
            return tokenizer.encode_batch_fast(texts, **options)

    monkeypatch.setattr(tokens, "library", lambda path: Spy())
    encode = tokens.word_encoder.__wrapped__(JSON)
    text = " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(600))
    assert [e.tolist() for e in encode([text, text])] == [run(text)] * 2
    assert 0 < len(sent) < 10
    sent.clear()
    encode([text])
    assert not sent


def test_counts_of_short_texts_come_from_remembered_words(monkeypatch):
    monkeypatch.setattr(tokens, "map_columns", lambda df, columns, schema, function: function)
    asked, encode = [], tokens.word_encoder(JSON)
    monkeypatch.setattr(tokens, "word_encoder", lambda path: lambda texts: asked.extend(texts) or encode(texts))
    texts = [None, "", "a b", "words of many lengths, " * 900]
    got = tokens.count_tokens(None, JSON, chunk=1000)({"doc_id": [1, 2, 3, 4], "text": texts})
    assert got["n_tokens"].to_pylist() == [len(run(t or "")) for t in texts]
    assert asked == ["", "", "a b"]


def test_pieces_with_ids_are_numbered_where_they_are_made(spark):
    pieces = packing.token_pieces(docs(spark, EDGES), JSON, 64, with_ids=True)
    numbered = [(r["part"], r["length"], r["own"]) for r in pieces.collect()]
    assert sorted(numbered) == sorted((p, n, k) for p, n in {x[:2] for x in numbered} for k in range(sum(x[:2] == (p, n) for x in numbered)))
    assert pieces._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1


def test_spliced_chunks_equal_whole_texts():
    rnd = random.Random(1)
    for _ in range(120):
        t = "".join(rnd.choice(["a", "b ", "  ", "\n", "<|endoftext|>", "é", "中", "😀", "'s", "123", "!!", "   x", "the ", "a" * rnd.randint(1, 80), " " * rnd.randint(1, 90)]) for _ in range(rnd.randint(1, 300)))
        assert tokens.spliced_ids(LIBRARY, t, rnd.choice([64, 100, 150]), rnd.choice([4, 16, 32])).tolist() == run(t)


@pytest.mark.parametrize("text", [" " * 2_000_000, "a" * 2_000_000, "\n" * 2_000_000, "x" + " " * 1_100_000 + "y " * 1000, (" " * 60_000 + "x") * 20])
def test_long_runs_take_work_in_proportion(text):
    import time

    began = time.process_time()
    want = run(text)
    whole = time.process_time() - began
    assert tokens.spliced_ids(LIBRARY, text).tolist() == want
    assert time.process_time() - began - whole < 12 * whole + 1
    assert tokens.word_encoder(JSON)([text])[0].tolist() == want


def test_counts(spark):
    rows = [*EDGES, (7, " " * 1_100_000), (8, "words of many lengths, " * 900)]
    got = tokens.count_tokens(docs(spark, rows), JSON, chunk=1000).collect()
    assert len(got) == len(rows)
    for r, (i, t) in zip(sorted(got, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0)), sorted(rows, key=lambda x: (x[0] is None, x[0] or 0)), strict=True):
        n = len(run(t or ""))
        assert (r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"], r["spliced"]) == (i, len((t or "").encode()), n, n > 1024, len(t or "") > 1000)
    assert tokens.count_tokens(docs(spark, []), JSON).count() == 0


def test_count_query_splices_real_rows(spark):
    d = "/root/testdata/sf0.01"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    got = queries.op7_tokens(spark, d).collect()
    assert sum(r["spliced"] for r in got) > 10
    assert {r["doc_id"]: r["n_tokens"] for r in got} == {i: len(run(t or "")) for i, t in texts.items()}


def test_packing_takes_long_runs_of_white_space(spark):
    packed = packing.pack_documents(docs(spark, [(1, " " * 1_100_000), (2, "x")]), JSON).collect()
    assert sum(r["length"] for r in packed if r["doc_id"] == 1) == len(run(" " * 1_100_000)) + 1


def test_plan_is_best_fit_decreasing():
    rnd = random.Random(5)
    for _ in range(150):
        cap = rnd.choice([10, 30, 100])
        lengths = [rnd.randint(1, cap) for _ in range(rnd.randint(0, 200))]
        rooms: list[int] = []
        for n in sorted(lengths, reverse=True):
            i = bisect.bisect_left(rooms, n)
            bisect.insort(rooms, (rooms.pop(i) if i < len(rooms) else cap) - n)
        histogram = {n: lengths.count(n) for n in set(lengths)}
        plan = packing.plan_bins(histogram, cap)
        bins: dict[int, list] = {}
        for n, count in histogram.items():
            own = plan[plan[:, 0] == n]
            for x in range(count):
                row = own[np.searchsorted(own[:, 1], x, "right") - 1]
                bins.setdefault(int(row[2] + (x - row[1]) // row[3]), []).append((int(row[4] + (x - row[1]) % row[3] * n), n))
        left = []
        for placed in bins.values():
            at = 0
            for offset, n in sorted(placed):
                assert offset == at
                at += n
            left.append(cap - at)
        assert sorted(left) == sorted(rooms)


def test_packing_round_trip(spark):
    packed = packing.pack_documents(docs(spark, EDGES), JSON, 64, with_ids=True)
    unpacked = lambda r: np.frombuffer(r["ids"], f"<u{packing.id_bytes(JSON)}").tolist()
    rows = [r.asDict() | {"ids": unpacked(r)} for r in packed.collect()]
    whole = sorted(sum(([*run(t or ""), 0] for _, t in EDGES), []))
    assert sorted(sum((r["ids"] for r in rows), [])) == whole
    held = {r["sequence_id"]: unpacked(r) for r in packing.sequences(packed).collect()}
    assert all(len(ids) <= 64 for ids in held.values()) and all(held[r["sequence_id"]][r["offset"] : r["offset"] + r["length"]] == r["ids"] for r in rows)
    long = sorted((r for r in rows if r["doc_id"] == 4), key=lambda r: r["piece"])
    assert [r["piece"] for r in long] == list(range(len(long))) and all(r["length"] == 64 for r in long[1:])
    assert sum((r["ids"] for r in long), []) == [*run(EDGES[5][1]), 0]
    assert packing.pack_documents(docs(spark, []), JSON).count() == 0


# --- quality


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    scored = queries.op6_quality(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").filter("held_out")
    r = scored.agg(F.avg((F.col("predicted") == F.col("quality")).cast("int")).alias("acc"), F.count("*").alias("n")).first()
    assert r["n"] > 500 and r["acc"] > 0.98


def test_places_are_found_without_python(spark):
    d = spark.createDataFrame([(k, "word " * (k % 7)) for k in range(60)], "doc_id long, text string")
    for with_ids in (True, False):
        packed = packing.pack_documents(d, JSON, capacity=16, with_ids=with_ids)
        assert "MapInArrow" not in packed._jdf.queryExecution().executedPlan().toString()
        held = packed.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("upto"), F.count_distinct("offset").alias("k"), F.count("*").alias("m")).collect()
        assert all(r["n"] == r["upto"] <= 16 and r["k"] == r["m"] for r in held) and sum(r["m"] for r in held) == packed.count() >= 60


@pytest.mark.parametrize("numbers", [1 << 22, 0])
def test_ids_stay_where_they_are_for_many_tasks(spark, numbers):
    d = spark.range(3000).repartition(700).selectExpr("id as doc_id", "repeat('word ', cast(id % 90 as int)) as text")
    pieces = packing.token_pieces(d, JSON, 2048, with_ids=True)
    packed = packing.pack_with_ids(pieces, 2048, numbers)
    plan = packed._jdf.queryExecution().optimizedPlan().toString()
    assert ("begins" in plan and plan.count("strategy=broadcast") == 2) == (numbers > 0)
    rows = packed.collect()
    assert len(rows) == 3000
    held = {}
    for r in rows:
        held.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert all(offset == sum(n for _, n in sorted(h)[:k]) for h in held.values() for k, (offset, _) in enumerate(sorted(h))) and max(sum(n for _, n in h) for h in held.values()) <= 2048


def test_what_is_stored_goes_to_python_in_small_batches(spark):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"size": [b.nbytes]})

    wide = spark.range(0, 3000, 1, 1).select(F.repeat(F.lit("x"), 10_000).alias("t"))
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    found = [r["size"] for r in common.stored(wide.mapInArrow(sizes, "size long"), "sizes").collect()]
    assert sum(found) > 30_000_000 and max(found) < 9_000_000 and spark.conf.get(name) == before


def test_workers_give_memory_back_at_the_end_of_a_task(monkeypatch):
    told = []
    monkeypatch.setattr(common.pa, "default_memory_pool", lambda: types.SimpleNamespace(release_unused=lambda: told.append("released")))
    assert list(common.given_back(lambda batches: (told.append(b) or b for b in batches))(iter("ab"))) == ["a", "b"] and told == ["a", "b", "released"]


def test_words_take_part_in_scores():
    """Texts of one shape, told apart by their words alone."""
    rnd = random.Random(3)
    good, bad = ([f"{a}{chr(97 + i)}{chr(97 + j)}" for i in range(9) for j in range(9)] for a in ("ka", "zo"))
    made = lambda words: " ".join(rnd.choices(words, k=120))
    texts = [made(good if i % 2 else bad) for i in range(200)]
    model = quality.fit(np.stack([quality.term_counts(t) for t in texts]), np.array([i % 2 for i in range(200)]), 64)
    told = quality.vote(model, np.stack([quality.term_counts(made(good)), quality.term_counts(made(bad))]), 10, 8.0)
    assert told[0] > 0.8 and told[1] < 0.2


def test_repeated_ids_train_one_model(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 40)], "doc_id long, quality int")
    rows = [(i, f"{'text' if i % 2 else 'JUNK !!'} number {i} " * 5) for i in range(1, 40)] + [(i, f"zz another text of the id {i}") for i in range(1, 40)]
    models = [quality.train(docs(spark, r).repartition(5), labels) for r in (rows, rows[::-1])]
    assert (models[0].vectors == models[1].vectors).all() and (models[0].labels == models[1].labels).all()


def test_quality_edges(spark):
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (4, 1), (None, 1), (7, None)], "doc_id long, quality int")
    table = docs(spark, EDGES)
    got = quality.score(table, quality.train(table, labels)).collect()
    assert len(got) == len(EDGES) and all(0 <= r["score"] <= 1 for r in got)
    assert all(r["score"] == 0 for r in got if r["doc_id"] in (2, 3, 6)) and all((r["held_out"] is None) == (r["doc_id"] is None) for r in got)
    none = quality.score(table, quality.train(table, labels.limit(0))).collect()
    assert all(r["score"] == 0 for r in none)
    assert quality.score(docs(spark, []), quality.train(table, labels)).count() == 0
    assert quality.keep_good(table, labels).columns == table.columns


def test_votes_against_brute_force():
    rnd = np.random.default_rng(4)
    model = quality.Model(np.ones(quality.TERMS, np.float32), np.eye(quality.TERMS, 16, dtype=np.float32), np.empty(0), np.empty(0))
    sample, rows = rnd.random((70, quality.TERMS), dtype=np.float32), rnd.random((9, quality.TERMS), dtype=np.float32)
    model.vectors, model.labels = model.project(sample), rnd.integers(0, 2, 70).astype(np.float32)
    got = quality.vote(model, rows, 5, 8.0, block=16)
    near = model.project(rows) @ model.vectors.T
    for i in range(9):
        top = np.argsort(-near[i])[:5]
        w = np.maximum(near[i][top], 0).astype(np.float64) ** 8
        assert abs(got[i] - (w * model.labels[top]).sum() / w.sum()) < 1e-9


# --- neighbours


def test_recall_and_exact_scores(spark):
    d = "/root/testdata/sf0.1"
    table = spark.read.parquet(f"{d}/embeddings.parquet").collect()
    ids, x = np.array([r["vec_id"] for r in table]), np.array([r["embedding"] for r in table], np.float64)
    got: dict[int, list] = {}
    for r in queries.op8_neighbours(spark, d).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    hits = 0
    for q, found in got.items():
        far = np.sqrt(((x - x[ids == q][0]) ** 2).sum(axis=1))
        order = np.lexsort((ids, np.where(ids == q, np.inf, far)))[:10]
        found.sort()
        assert [f[0] for f in found] == list(range(1, 11)) and all(s == far[ids == v][0] for _, v, s in found)
        hits += len(set(ids[order].tolist()) & {v for _, v, _ in found})
    assert len(got) == (ids % 100 == 0).sum() and hits >= 0.9 * 10 * len(got)


def test_neighbour_edges(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [None, 1.0]), (7, [3.0, 4.0]), (8, []), (9, [1.0]), (100, [3.0, 0.0]), (200, None), (None, [1.0, 1.0])]
    out = neighbours.search(spark.createDataFrame([(*r, "clash") for r in rows], "vec_id long, embedding array<float>, list string")).collect()
    got = {q: [(r["rank"], r["vec_id"], r["score"]) for r in sorted(out, key=lambda r: r["rank"]) if r["query_id"] == q] for q in (0, 100)}
    assert got[0] == [(1, 1, 0.0), (2, 2, 0.0), (3, 100, 2.0), (4, 7, float(np.sqrt(20.0)))]
    assert [v for _, v, _ in got[100]] == [0, 1, 2, 7] and len(out) == 8
    assert neighbours.search(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_queries_in_short_lists_get_all_neighbours(spark):
    rnd = np.random.default_rng(3)
    made = [(rnd.standard_normal(8).tolist(), 100) for _ in range(30)] + [((50 * rnd.standard_normal(8)).tolist(), 3) for _ in range(5)]
    rows, far = [], []
    for n, (v, copies) in enumerate(made):
        rows += [(100 * (n + 1) + i, v) for i in range(copies)]
        far += [100 * (n + 1)] if copies == 3 else []
    rows += [(far[0], made[30][0])] * 12  # a repeated id is no candidate of its own
    out = neighbours.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), rows_a_list=80).collect()
    got = {q: {r["rank"] for r in out if r["query_id"] == q} for q in (100 * (n + 1) for n in range(35))}
    assert all(ranks == set(range(1, 11)) for ranks in got.values())


def test_split_lists_give_the_same(spark):
    rnd = np.random.default_rng(0)
    rows = [(i, rnd.standard_normal(8).tolist()) for i in range(400)] + [(1000 + i, [1.0] * 8) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    made = [sorted(map(tuple, neighbours.search(df, every=50, rows_a_list=100, recall=1.0, group_rows=g, group_queries=p, slack=8.0).collect())) for g, p in ((20_000, 5_000), (37, 2))]
    assert made[0] == made[1] and len(made[0]) == 140  # 8 random and 6 of the copies


# --- SimHash


def brute_links(values: list[int], radius: int) -> set[tuple[int, int]]:
    return {(i, j) for i in range(len(values)) for j in range(i + 1, len(values)) if (values[i] ^ values[j]).bit_count() <= radius}


def test_bit_planes_against_brute_force():
    rnd = random.Random(6)
    values = [rnd.getrandbits(64) for _ in range(60)]
    values += [v ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(0, 6))) for v in values] + [0, 0, 2**64 - 1]
    for radius in (0, 1, 3, 4, 5, 7, 12):
        for starts in ([0], [0, 10, 75, 76]):
            first = np.array([max(s for s in starts if s <= i) for i in range(len(values))])
            got = set()
            for i, j in simhash.linked_pairs([np.array(values, np.uint64)], first, radius, step=17):
                got |= set(zip(i.tolist(), j.tolist(), strict=True))
            assert got == {(i, j) for i, j in brute_links(values, radius) if first[i] == first[j]}


def roots(n: int, links) -> list[int]:
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in links:
        a, b = find(i), find(j)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


@pytest.mark.parametrize("tile", [8192, 9])
def test_fingerprint_links_lose_none(spark, tile):
    rnd = random.Random(7)
    values = [rnd.getrandbits(64) for _ in range(150)]
    for _ in range(3):
        values += [v ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(1, 5))) for v in rnd.sample(values, 60)]
    values = sorted({v - (1 << 64) if v >> 63 else v for v in values})
    fps = spark.createDataFrame([(v, v) for v in values], "node long, fp long")
    edges = [(values.index(r["a"]), values.index(r["b"])) for r in simhash.fingerprint_links(fps, 4, tile).collect()]
    want = brute_links([v & (2**64 - 1) for v in values], 4)
    assert roots(len(values), edges) == roots(len(values), want)
    assert all((min(e), max(e)) in want for e in edges if tile > 1000) or roots(len(values), edges) == roots(len(values), want)


def test_components_against_union_find(spark):
    rnd = random.Random(8)
    links = [(rnd.randint(0, 300), rnd.randint(0, 300)) for _ in range(180)] + [(i, i + 1) for i in range(400, 460)] + [(7, 7), (5, None)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = roots(500, [(a, b) for a, b in links if b is not None])
    touched = {x for a, b in links if b is not None and a != b for x in (a, b)}
    assert got == {x: want[x] for x in touched}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_fingerprint(text):
    from xxhash import xxh64_intdigest

    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] if len(words) >= 4 else [" ".join(words)] if words else []
    hashes = [xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_query_against_brute_force(spark):
    table = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    table.sort()
    values = [brute_fingerprint(t) for _, t in table]
    want = roots(len(table), brute_links(values, 4))
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.op10_simhash(spark, SF).collect()}
    assert got == {d: (f"{values[i]:016x}", table[want[i]][0]) for i, (d, _) in enumerate(table)}


def test_simhash_edges(spark):
    got = simhash.near_duplicates(docs(spark, EDGES)).collect()
    assert len(got) == len(EDGES)
    assert {r["component_id"] for r in got if r["doc_id"] in (2, 3, 6)} == {2} and all(r["fp"] == 0 for r in got if r["doc_id"] in (2, 3, 6))
    assert [r["component_id"] for r in got if r["doc_id"] is None] == [None]
    assert simhash.near_duplicates(docs(spark, [])).count() == 0


def test_similar_documents_are_found(spark):
    rnd = random.Random(9)
    texts = [[f"w{rnd.randint(0, 50000)}" for _ in range(300)] for _ in range(60)]
    near = [t[:100] + ["changed"] + t[101:] for t in texts[:30]]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts + near)]
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs(spark, rows), width=5, similarity=0.8).collect()}
    assert got == {i: i - 60 if i >= 60 else i for i in range(90)}
    kept = simhash.keep_one(docs(spark, rows))
    assert sorted(r["doc_id"] for r in kept.collect()) == list(range(60)) and kept.columns == docs(spark, []).columns


def test_likeness_decides_and_tables_miss_few(spark):
    rnd = random.Random(4)
    word = lambda: f"w{rnd.randint(0, 10**9)}"
    rows, want = [], {}
    for i in range(300):
        text = [word() for _ in range(254)]
        near = i % 3  # one in three falls short of 0.8: 40 changed shingles of 250 are 0.72, 25 are 0.82
        copy = list(text)
        for at in range(5, 5 + 10 * (5 if near else 8), 10):
            copy[at] = word()
        rows += [(i, " ".join(text)), (1000 + i, " ".join(copy))]
        want[1000 + i] = i if near else 1000 + i
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs(spark, rows), width=5, similarity=0.8).collect()}
    assert all(got[i] == i for i in range(300)) and all(got[i] == i for i, w in want.items() if w == i)
    assert sum(got[i] != w for i, w in want.items()) <= 5  # of 200 pairs


def test_likeness_of_repetitive_texts(spark):
    rows = [(1, "buy it now and save " * 50), (2, "buy it now and save " * 20), (3, "buy it now and save " * 20 + " ".join(f"w{i}" for i in range(9))), (4, None), (5, " ")]
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs(spark, rows), width=5, similarity=0.8).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 4}


@pytest.mark.parametrize("n", [1000, 256_000, 15_000_000, 1_000_000_000])
def test_tables_miss_the_same_at_every_size(n):
    radius, key_bits, tables = simhash.table_plan(n)
    rnd = np.random.default_rng(n)
    differing = rnd.binomial(128, np.arccos(2 * 0.8 / 1.8) / np.pi, 200_000)
    apart = np.array([1 - np.prod((128 - d - np.arange(key_bits)) / (128 - np.arange(key_bits))) if d <= 128 - key_bits else 1.0 for d in range(129)])
    assert np.where(differing > radius, 1.0, apart[differing] ** tables).mean() < 0.0115


@pytest.mark.parametrize("set_tile", [3, 2048])
def test_tiled_groups_link_by_likeness(spark, set_tile):
    rnd = random.Random(1)
    base = [f"w{rnd.randint(0, 10**9)}" for _ in range(100)]
    texts = [" ".join(base[:i] + [f"x{i}"] + base[i + 1 :]) for i in range(0, 100, 4)] + [f"other {i} text of words here" for i in range(20)]
    rows = docs(spark, list(enumerate(texts))).selectExpr("doc_id", "doc_id as at", "text")
    nodes = simhash.set_prints(rows, 5).withColumn("node", F.col("at") * 3 + 1)
    links = simhash.similar_links(rows, nodes, 45, 5, set_tile=set_tile)
    of = {r["at"]: r["node"] for r in nodes.collect()}
    where = {v: k for k, v in of.items()}
    edges = {tuple(sorted((where[r["a"]], where[r["b"]]))) for r in links.collect()}
    assert roots(45, edges) == [0] * 25 + list(range(25, 45))


def test_repeated_ids_keep_one_of_each_group(spark):
    rnd = random.Random(2)
    a, b = ([f"w{rnd.randint(0, 10**9)}" for _ in range(200)] for _ in range(2))
    near = lambda t: " ".join(t[:50] + ["changed"] + t[51:])
    rows = [(1, " ".join(a)), (5, near(a)), (5, " ".join(b)), (9, near(b)), (None, near(b))]
    kept = simhash.keep_one(docs(spark, rows))
    assert sorted(((r["doc_id"] or 0, r["text"]) for r in kept.collect())) == [(0, near(b)), (1, " ".join(a)), (5, " ".join(b))] and kept.columns == docs(spark, []).columns


@pytest.mark.parametrize("few", [200_000, 0])
def test_texts_that_stay_are_not_shuffled(spark, monkeypatch, few):
    rnd = random.Random(7)
    texts = [[f"w{rnd.randint(0, 50000)}" for _ in range(60)] for _ in range(400)]
    rows = docs(spark, [(i, " ".join(t)) for i, t in enumerate(texts + texts[:20])] + [(None, None), (None, " ".join(texts[0])), (900, None), (901, None)])
    monkeypatch.setattr(simhash, "similar_links", lambda *a, f=simhash.similar_links, **b: f(*a, **b, few=few))
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    try:
        kept = simhash.keep_one(rows, few=few)
        found = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect())
        plan = kept._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set(name, before)
    assert found == [*((False, i) for i in range(400)), (False, 900), (True, 0), (True, 0)] and kept.columns == rows.columns
    assert ("Union" in plan and "bitmap_construct_agg" in plan) if few == 0 else ("Union" not in plan and "strategy=broadcast" in plan)


@pytest.mark.parametrize(("n", "most", "others"), [(300, 1 << 29, 0.06), (2000, 1 << 15, 0.12), (1, 1 << 29, 0.1), (0, 1 << 29, 0.0)])
def test_flags_hold_all_keys_and_few_others(spark, n, most, others):
    d = spark.range(20_000).select("id", F.xxhash64("id").alias("at"))
    got = common.flagged(d, F.col("at"), common.stored(d.filter(F.col("id") < n).select("at"), "keys"), "maybe", most)
    flags = {r["id"]: r["maybe"] for r in got.collect()}
    assert got.columns == ["id", "at", "maybe"] and len(flags) == 20_000 and all(flags[i] for i in range(n))
    assert sum(flags.values()) - n <= others * 20_000


def test_tables_do_not_outgrow_the_input():
    assert [simhash.table_plan(n)[2] for n in (1000, 200_000, 5_000_000)] == [61, 61, 61] and simhash.table_plan(13_000_000)[2] < 2 * 61


def test_stars_with_hot_centres(spark, monkeypatch):
    join = simhash.salted_join
    for where in (simhash, components):
        monkeypatch.setattr(where, "salted_join", lambda *args, **more: join(*args, **more, least=7))
    links = [(0, i) for i in range(1, 200)] + [(i, 500 + i) for i in range(1, 50)] + [(900, 901)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in [*range(200), *range(501, 550)]}, 900: 900, 901: 900}
    same = simhash.near_duplicates(docs(spark, [(i, "the same few words in a row") for i in range(100)] + [(None, None), (200, "")])).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["component_id"]) for r in same) == [*((False, i, 0) for i in range(100)), (False, 200, 200), (True, 0, 200)]


# --- pipeline


def test_pipeline_deletes_what_it_stored(spark):
    import os

    import corpus_pipeline as pipeline
    from tarnfold.checkpoints import shared_dir

    folder = shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    out = pipeline.run(spark, SF)
    assert out.count() > 0 and len(set(os.listdir(folder)) - before) == 1


def test_pipeline_stages(spark):
    import corpus_pipeline as pipeline

    out = spark.read.parquet(f"{SF}/documents.parquet")
    seen = []
    for name, stage in pipeline.STAGES:
        before, out = out, stage(spark, out, SF)
        seen.append((name, before, out))
        if name != pipeline.STAGES[-1][0]:
            assert out.columns == before.columns
    (_, raw, good), (_, _, single), (_, _, clean), (_, _, mixed), (_, _, packed) = seen
    ids = lambda df: sorted(r["doc_id"] for r in df.select("doc_id").collect())
    model = quality.train(raw, spark.read.parquet(f"{SF}/labels.parquet"))
    assert ids(good) == ids(quality.score(raw, model).filter("predicted = 1"))
    classes = simhash.near_duplicates(good, width=5, similarity=0.8)
    assert ids(single) == sorted(r["component_id"] for r in classes.select("component_id").distinct().collect())
    texts = {r["doc_id"]: r["text"] for r in single.collect()}
    assert ids(clean) == ids(single)
    live = {r["doc_id"] for r in __import__("tarnfold.llm.secrets", fromlist=["x"]).secret_report(single).filter("n_live > 0").collect()}
    assert {r["doc_id"] for r in clean.collect() if r["text"] != texts[r["doc_id"]]} == live
    whole = {}
    for r in mixed.collect():
        whole[r["doc_id"]] = whole.get(r["doc_id"], []) + [*run(r["text"] or ""), 0]
    total = sum(map(len, whole.values()))
    assert packed.agg(F.sum("length")).first()[0] == total
    held = {}
    for r in packing.sequences(packed).collect():
        held[r["sequence_id"]] = np.frombuffer(r["ids"], f"<u{packing.id_bytes(JSON)}").tolist()
    again = {}
    for r in sorted(packed.collect(), key=lambda r: (r["doc_id"], r["sequence_id"], r["offset"])):
        part = held[r["sequence_id"]][r["offset"] : r["offset"] + r["length"]]
        assert part == np.frombuffer(r["ids"], f"<u{packing.id_bytes(JSON)}").tolist()
        again[r["doc_id"]] = again.get(r["doc_id"], []) + part
    assert {d: sorted(x) for d, x in again.items()} == {d: sorted(x) for d, x in whole.items()}
    sizes = packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.max("n"), F.count("*")).first()
    assert sizes[0] <= 2048 and sizes[1] <= total / 2048 * 1.05 + 1


def test_pipeline_takes_edge_cases(spark):
    import corpus_pipeline as pipeline

    schema = "doc_id long, text string, lang string, source string, n_chars long, extra string"
    rows = [(i, t, None if k % 2 else "en", None if k % 3 else "s", None, "clash") for k, (i, t) in enumerate(EDGES)] + [(50, "token=" + "a1b2" * 6 + " and more plain words of the text", "en", "s", 1, "clash")]
    for table in (rows, []):
        out = spark.createDataFrame(table, schema)
        for name, stage in pipeline.STAGES:
            before, out = out, stage(spark, out, SF)
            if name != pipeline.STAGES[-1][0]:
                assert out.columns == before.columns
            out.collect()
    # stages by themselves on all rows
    every = spark.createDataFrame(rows, schema)
    masked = {r["doc_id"]: r for r in pipeline.secret_scan(spark, every, SF).collect()}
    assert masked[50]["text"].startswith("[SECRET] and") and masked[50]["n_chars"] == len(masked[50]["text"]) and masked[2]["n_chars"] is None
    one = pipeline.near_duplicates(spark, every, SF).collect()
    assert sorted(r["doc_id"] for r in one if r["doc_id"] in (2, 3, 6)) == [2]
    assert pipeline.mix_sources(spark, every, SF).count() <= 2 * len(rows)
