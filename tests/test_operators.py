from __future__ import annotations

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tarnfold.operators import adapters, aggregates, filters, guards, joins, windows
from tarnfold.operators.html_body import body_of
from tarnfold.operators.html_job import enml_to_html, html_job, rewrite_wikilinks, to_markdown


@pytest.mark.parametrize(
    ("policy", "exists", "modified", "meta", "observed", "expected", "action"),
    [
        ("preserve", False, False, False, None, None, "write_canonical"), ("preserve", True, False, False, "a", "a", "write_canonical"), ("preserve", True, False, False, "a", "b", "mark_conflict"),
        ("replace", True, False, False, "a", "b", "forced_overwrite"), ("write-new", True, True, False, None, None, "write_new_variant"), ("metadata-only", True, False, False, "a", "a", "update_metadata_only"),
        ("metadata-only", True, True, False, None, None, "mark_conflict"), ("replace", True, False, True, "a", "a", "update_metadata_only"), ("preservee", True, False, False, "a", "a", "unknown_policy"), ("replace", True, True, False, "a", "a", "write_canonical"),
    ],
)
def test_overwrite_table(spark, policy, exists, modified, meta, observed, expected, action):
    row = spark.createDataFrame([(policy, exists, modified, meta, observed, expected)], "p string, e boolean, m boolean, d boolean, o string, x string")
    assert row.select(joins.overwrite_action(*(F.col(c) for c in "pemdox")).alias("a")).first()["a"] == action


def test_assign_paths_is_free_of_clashes(spark):
    rows = [("k1", "a.md"), ("k2", "a.md"), ("k3", "a.md"), ("k4", "a-2.md"), ("k5", "b"), ("k1", "a.md")]
    out = {r["stable_key"]: r["free_path"] for r in windows.assign_paths(spark.createDataFrame(rows, "stable_key string, path string")).collect()}
    assert len(set(out.values())) == 5
    assert out["k1"] == "a.md" and out["k4"] == "a-2.md" and out["k5"] == "b"
    again = {r["stable_key"]: r["free_path"] for r in windows.assign_paths(spark.createDataFrame(rows[::-1], "stable_key string, path string")).collect()}
    assert again == out


@pytest.mark.parametrize("block", [4096, 3])
def test_assign_paths_against_one_key_after_another(spark, block):
    rng = random.Random(3)
    names = ["a.md", "a-2.md", "a-3.md", "a-7.md", "a-2-2.md", "b", "b-2", "c.d/x", "c.d/x-3", "-2.md", ".md", "a-02.md", "a-1.md", "q\n.md", "q\n-2.md"]
    rows = [(f"{rng.randrange(1 << 40):010x}", rng.choice(names)) for _ in range(250)] + [(f"{i:010x}", f"a-{i}.md") for i in range(20, 40)]
    paths, want = {p for _, p in rows}, {}
    for p in paths:
        name, dot, ext = p.rpartition(".") if "." in p.rpartition("/")[2] else (p, "", "")
        n = 1
        for i, k in enumerate(sorted({k for k, q in rows if q == p})):
            while i and f"{name}-{(n := n + 1)}{dot}{ext}" in paths:
                pass
            want[k, p] = f"{name}-{n}{dot}{ext}" if i else p
    got = windows.assign_paths(spark.createDataFrame(rows + rows[:9], "stable_key string, path string"), block=block).collect()
    assert len(got) == len(want) == len(set(want.values())) and {(r["stable_key"], r["path"]): r["free_path"] for r in got} == want
    assert windows.assign_paths(spark.createDataFrame([], "stable_key string, path string")).count() == 0


def test_first_observation_ignores_arrival_order(spark):
    rows = [(1, 5, "x"), (1, 5, "a"), (1, 7, "0"), (2, 1, "z")]
    made = [sorted(map(tuple, windows.first_observation(spark.createDataFrame(r, "k int, p int, v string"), ["k"], ["p"]).collect())) for r in (rows, rows[::-1])]
    assert made[0] == made[1] == [(1, 5, "a"), (2, 1, "z")]


def test_stop_point_with_cap(spark):
    rows = [("s", r, f"k{r}") for r in range(4)] + [("s", r, "k0") for r in range(4, 12)]
    df = spark.createDataFrame(rows, "source_id string, round long, key string")
    assert tuple(windows.stop_point(df).first()) == ("s", 8, "no_new_items", 4)
    assert tuple(windows.stop_point(df, cap=2).first()) == ("s", 1, "item_cap", 2)
    assert tuple(windows.stop_point(df, patience=50).first()) == ("s", 11, "end_of_list", 4)


def test_cleanup_summary_refuses_unknown_status(spark):
    with pytest.raises(Exception, match="in no bucket"):
        aggregates.cleanup_summary(spark.createDataFrame([("surprise",)], "cleanup_status string")).collect()


def test_reconcile_job_without_items(spark):
    items = spark.createDataFrame([(1, "verified")], "job_id long, state string")
    jobs = spark.createDataFrame([(1, 1, 1, 0, 0, 0, 0, 0), (2, 0, 0, 0, 0, 0, 0, 0)], "job_id long, scan_count long, verified_count long, degraded_count long, failed_count long, conflict_count long, skipped_count long, recoverable_count long")
    out = aggregates.reconcile(aggregates.failed_count(aggregates.state_counts(items, ["job_id"])), jobs)
    assert all(r["ok"] for r in out.collect())


def test_candidates_excluded_and_capped_add_up(spark):
    scope = spark.range(100).withColumn("status", F.lit("verified"))
    done = spark.range(0, 100, 4)
    left = joins.cleanup_candidates(scope, done, 30)
    assert left.count() == 30 and left.join(done, "id").count() == 0


def test_commit_is_idempotent(spark):
    items = spark.createDataFrame([(1, "full", "queued"), (2, "degraded", "queued")], "id int, quality string, status string")
    results = spark.createDataFrame([(1, None, "verified")], "id int, quality string, status string")
    once = joins.commit_results(items, results, "id", ["quality", "status"])
    assert sorted(map(tuple, joins.commit_results(once, results, "id", ["quality", "status"]).collect())) == sorted(map(tuple, once.collect())) == [(1, "full", "verified"), (2, "degraded", "queued")]


def test_special_pages(spark):
    rows = [('<div class="error-404">', "deleted"), ('<div class="login-wall">', "login_required"), ('<div id="captcha">', "challenge"), ('<article >x</article><div class="error-404">', None), (None, None)]
    out = filters.special_page(spark.createDataFrame(rows, "html string, want string")).collect()
    assert [r["special"] for r in out] == [r["want"] for r in out]


def test_vocabulary_violations_shows_ten(spark):
    df = spark.range(50).withColumn("s", F.lit("odd"))
    assert guards.vocabulary_violations(df, {"s": ("ok",)}).count() == 10


def test_plan_hash_ignores_order(spark):
    rows = [(1, i) for i in range(100)]
    made = {aggregates.plan_hash(spark.createDataFrame(r, "j int, i int").repartition(7), ["j", "i"], ["j"]).first()["plan_hash"] for r in (rows, rows[::-1])}
    assert len(made) == 1


def test_plan_hash_is_a_tree_of_the_rows_alone(spark):
    def tree(rows, prefix=""):
        held = {h: n for h, n in rows.items() if h.startswith(prefix)}
        if len(held) <= 4:
            return hashlib.sha256("".join(sorted(f"{h}:{n}" for h, n in held.items())).encode()).hexdigest()
        children = [prefix + digit for digit in "0123456789abcdef" if any(h.startswith(prefix + digit) for h in held)]
        return hashlib.sha256("".join(p + tree(held, p) for p in children).encode()).hexdigest()

    rows = [("a", i % 150) for i in range(700)] + [("b", 1)] * 300 + [("c", 7)] + [(None, i) for i in range(5)]
    got = {r["j"]: (r["plan_hash"], r["n_rows"]) for r in aggregates.plan_hash(spark.createDataFrame(rows, "j string, i int"), ["i"], ["j"], leaf=4).collect()}
    want = {}
    for g in ("a", "b", "c", None):
        counts = Counter(hashlib.sha256(str(i).encode()).hexdigest() for j, i in rows if j == g)
        want[g] = (tree(counts), sum(counts.values()))
    assert got == want
    alone = aggregates.plan_hash(spark.createDataFrame([r for r in rows if r[0] == "c"], "j string, i int"), ["i"], ["j"], leaf=4).first()
    assert (alone["plan_hash"], alone["n_rows"]) == want["c"]  # other groups don't matter
    assert aggregates.plan_hash(spark.createDataFrame([], "j string, i int"), ["i"], ["j"]).count() == 0


def test_scan_state_of_any_batches_is_the_stop_point(spark, tmp_path):
    from tarnfold.streaming import streams

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rng = random.Random(2)
    schema = "source_id string, round long, key string"
    rows = [(s, i // 6, rng.choice([f"k{rng.randrange(8)}", f"n{i}" if i < 60 else "k0", None])) for s in ("one", "two") for i in range(120)]
    rng.shuffle(rows)
    for part in range(3):
        spark.createDataFrame(rows[part::3], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    streams.stream_scan_state(stream, str(tmp_path / "rounds"), str(tmp_path / "cp"), shards=3).awaitTermination()
    whole = spark.createDataFrame(rows, schema)
    for options in ({}, {"patience": 3}, {"cap": 20}, {"patience": 2, "cap": 9}, {"patience": 99}):
        told = {r["source_id"]: (r["stop_round"], r["reason"]) for r in streams.read_scan_state(spark, str(tmp_path / "rounds"), **options).collect()}
        assert told == {r["source_id"]: (r["stop_round"], r["reason"]) for r in windows.stop_point(whole.withColumn("key", F.coalesce("key", F.lit("null"))), **options).collect()}
    counts = {r["source_id"]: (r["observations"], r["unique_items"], r["rounds"]) for r in streams.read_scan_state(spark, str(tmp_path / "rounds")).collect()}
    assert counts == {s: (120, len({k for x, _, k in rows if x == s}), 20) for s in ("one", "two")}


@pytest.mark.parametrize(
    ("html", "markdown"),
    [
        ("<h2>T</h2><p>a <b>b</b> <i>c</i></p>", "## T\n\na **b** *c*"), ("<ul><li>x<li>y</ul>", "- x\n- y"), ('<a href="https://e.com">t</a>', "[t](https://e.com)"), ('<a href="javascript:x">t</a>', "t"),
        ("<script>x</script>y", "y"), ("<pre><code>a  b</code></pre>", "```\na  b\n```"), ("<p>open <b>never closed", "open **never closed**"), ('<img data-src="/i.png" alt="k">', "![k](/i.png)"),
    ],
)
def test_markdown(html, markdown):
    assert to_markdown(html)["markdown"] == markdown


@pytest.mark.parametrize(
    ("html", "body"),
    [
        ('<div class="article-content"><div>in</div><p>after<div>deep<div>er</div></div>end</div>tail', "<div>in</div><p>after<div>deep<div>er</div></div>end"),
        ('<div class="post-content">post</div><article>art</article>', "post"), ('<div class="article-content"> </div><div class="post-content">post</div>', "post"),
        ("<article>a<article>b</article>c</article><p>d", "a<article>b</article>c"), ("<article></article><div class='the-content'>x</div>", "x"),
        ('<div class="ad content">an advert that is very long</div><div class="main-content">short</div><div class="content">rather longer</div>', "rather longer"),
        ("<body><nav>n</nav><p>one</p><header>h<div>h</div></header><p>two<script>if (a<b) c</script></body>", "<p>one</p><p>two"), ("no tags", "no tags"), (None, ""),
        ('<div class="article-content"><embed src="x"><br>text<p>never closed', '<embed src="x"><br>text<p>never closed'),
    ],
)
def test_body_of(html, body):
    assert body_of(html) == body


@pytest.mark.parametrize(
    ("html", "markdown", "degradations"),
    [
        ('<p>a</p><embed src="x"><p>kept</p>', "a\n\nkept", "unresolved-embedded-content"), ("<div><form><p>held</div><p>kept</p>", "held\n\nkept", ""), ("<p>a</p><form><p>the rest", "a\n\nthe rest", ""), ("<p>a</p><object><p>the rest", "a", "unsupported-structure,unresolved-embedded-content"),
        ("<p>a</p><nav>menu</nav></nav></aside><p>b</p>", "a\n\nmenu\n\nb", ""), ("<p>a<iframe src=x>old browsers</iframe>b</p>", "ab", "unresolved-embedded-content"), ("<p>a<svg><g></svg>b", "ab", ""), ("a<script>never closed", "a", "unsupported-structure"),
    ],
)
def test_nothing_is_lost_as_full(html, markdown, degradations):
    told = to_markdown(html)
    assert (told["markdown"], told["degradations"], told["quality"]) == (markdown, degradations, "degraded" if degradations else "full")


@pytest.mark.parametrize(("keys", "ladder", "lengths"), [(["abcdefgh11", "abcdefgh22"], (4, 8, 10), [4, 8]), (["abcd000000", "abcd000011", "abcd000022", "abcd111111"], (4, 8, 10), [4, 8, 8, 8]), (["abcdefgh11", "abcdefgh12", "abcdefgh13"], (4, 8, 10), [4, 8, 10])])
def test_prefix_length_is_what_is_left(spark, keys, ladder, lengths):
    taken, want = set(), []
    for k in keys:  # one item after another
        n = next((n for n in ladder if k[:n] not in taken), len(k))
        taken.add(k[:n])
        want.append(n)
    out = windows.prefix_length(spark.createDataFrame([(k,) for k in keys], "k string"), "k", [], ladder)
    got = {r["k"]: r["length"] for r in out.collect()}
    assert [got[k] for k in keys] == want
    assert want[:2] == lengths[:2]


def test_migration_ends_in_a_final_state(spark, tmp_path):
    from tarnfold.operators import migration
    from tarnfold.sources.readers import read_notes

    pages = [("web", 1, "https://example.com/en/1?utm_source=x", "<article><h1>One</h1><p>text</p></article>"), ("web", 2, "https://example.com/en/1", "<article><h1>Again</h1></article>"), ("web", 3, "https://example.com/en/3", ""), ("web", 4, "https://example.com/en/4", "<article><h1>One</h1><p>other</p></article>")]
    source = migration.PageSource(spark.createDataFrame(pages, "source_instance_id string, source_position long, original_url string, html string"), ("example.com",))
    assert isinstance(source, adapters.Source) and adapters.contract_violations(source, spark) == []
    target = migration.NoteFolder(str(tmp_path / "notes"))
    assert isinstance(target, adapters.Target)
    states, report = migration.migrate(spark, source, target)
    rows = states.collect()
    assert sorted(r["state"] for r in rows) == ["degraded", "verified", "verified"] and len({r["relative_path"] for r in rows}) == 3
    assert report.first()["reason"] == "ok" and report.first()["final_items"] == 3
    text = {r["relative_path"]: r["text"] for r in read_notes(spark, str(tmp_path / "notes")).collect()}
    assert any("# One" in t and "text" in t for t in text.values()) and any(p.endswith("One-2.md") for p in text)
    assert any(p.startswith("index/web-") for p in text)

    class Lossy(migration.NoteFolder):
        def write(self, plan):
            super().write(plan.filter("quality = 'full'"))
            return plan.select("stable_key", "relative_path", F.sha2("text", 256).alias("expected"))

    states, report = migration.migrate(spark, source, Lossy(str(tmp_path / "lossy")))
    assert sorted(r["state"] for r in states.collect()) == ["conflict", "verified", "verified"] and report.first()["ok"]
    none = migration.PageSource(spark.createDataFrame([], "source_instance_id string, source_position long, original_url string, html string"), ())
    states, report = migration.migrate(spark, none, migration.NoteFolder(str(tmp_path / "none")))
    assert states.count() == 0 and [r["final_items"] for r in report.collect()] == [0]


def test_shards_that_clean_to_one_name_are_refused(spark):
    from tarnfold.operators import migration

    assert {r["shard_file"] for r in migration.index_names(spark.createDataFrame([("a",), ("b",)], "shard string")).collect()} == {"a.md", "b.md"}
    with pytest.raises(Exception, match="want the index file"):
        migration.index_names(spark.createDataFrame([("a:b",), ("a?b",)], "shard string")).collect()


def test_markdown_links_to_files(spark):
    from tarnfold.functions import text

    df = spark.createDataFrame([("a/b c(1).png",), ("a/x[1].png",)], "p string")
    assert [r[0] for r in df.select(text.file_link(F.col("p"), "markdown")).collect()] == ["[b c(1).png](<a/b c(1).png>)", "[x\\[1\\].png](a/x[1].png)"]


def test_picks_are_the_same_in_any_order(spark):
    from tarnfold.operators import sets

    links, notes = spark.createDataFrame([("g",)], "to_guid string"), [("g", "z"), ("g", "a")]
    for rows in (notes, notes[::-1]):
        assert joins.resolve_links(links, spark.createDataFrame(rows, "guid string, title string")).first()["target_title"] == "a"
        assert sets.union_observations(spark.createDataFrame(rows, "k string, v string"), spark.createDataFrame(rows, "k string, v string"), key=["k"]).first()["v"] == "a"


def test_empty_page_degrades(spark):
    rows = html_job(spark.createDataFrame([(1, None), (2, "<p>x</p>")], "id long, html string"), "id").collect()
    assert {r["id"]: (r["quality"], r["degradations"]) for r in rows} == {1: ("degraded", "body-missing"), 2: ("full", "")}


def test_enml(spark):
    body = '<en-note><en-todo checked="true"/>done<br/><en-todo/>open<br/><en-media hash="AA" type="image/png"/><en-media hash="bb" type="application/pdf"/><en-media hash="cc"/><en-crypt>zzz</en-crypt></en-note>'
    df = spark.createDataFrame([(1, body, {"aa": "a.png", "bb": "b.pdf"})], "note_id long, html string, names map<string,string>")
    r = enml_to_html(df).first()
    assert "- [x] done" in r["markdown"] and "- [ ] open" in r["markdown"] and "![[a.png]]" in r["markdown"] and "[[b.pdf]]" in r["markdown"] and "zzz" not in r["markdown"]
    assert (r["n_todo"], r["n_media"], r["n_missing"], r["n_encrypted"]) == (2, 2, 1, 1)
    assert r["degradations"] == "asset-incomplete,unresolved-embedded-content"


def test_rewrite_wikilinks(spark):
    g, h = "0" * 8 + "-0000-0000-0000-" + "0" * 12, "1" * 8 + "-0000-0000-0000-" + "0" * 12
    notes = spark.createDataFrame([(1, f"a [x](note:{g}) b [y](note:{h}) c"), (2, "plain")], "note_id int, markdown string")
    targets = spark.createDataFrame([(g, "File X")], "guid string, file string")
    assert {r["note_id"]: r["markdown"] for r in rewrite_wikilinks(notes, targets).collect()} == {1: f"a [[File X|x]] b [y](note:{h}) c", 2: "plain"}


def test_source_contract(spark):
    class Good:
        def scan(self, spark):
            return spark.createDataFrame([("k1",), ("k2",)], "stable_key string")

        def extract(self, items):
            return items.withColumn("quality", F.lit("full")).withColumn("degradations", F.array().cast("array<struct<code:string,stage:string,message:string>>"))

    class Bad(Good):
        def scan(self, spark):
            return spark.createDataFrame([("k1",), ("k1",), (None,)], "stable_key string")

        def extract(self, items):
            return super().extract(items).withColumn("quality", F.lit("fine"))

    assert isinstance(Good(), adapters.Source)
    assert adapters.contract_violations(Good(), spark) == []
    assert {"null_key", "repeated_key", "quality"} <= set(adapters.contract_violations(Bad(), spark))


@pytest.mark.parametrize("stretch", [1, 10_000])
def test_asset_names_number_nulls_and_stretches_alike(spark, stretch):
    rows = [(1, "A.png", "x", None), (1, "a.png", "y", 2), (1, "a.PNG", "z", 1), (1, "a.png", "y", 0), (None, "a.png", "q", 3), (None, None, "r", 3)]
    named = windows.asset_names(spark.createDataFrame(rows, "note_id long, file_name string, sha256 string, position long"), stretch).collect()
    assert {r["sha256"]: r["name"] for r in named} == {"x": "A.png", "y": "a-2.png", "z": "a-3.PNG", "q": "a.png", "r": None}


def test_plan_hash_moves_rows_twice_whatever_its_depth(spark):
    rows = spark.range(2000).selectExpr("id % 1 as j", "id as i")
    plan = aggregates.plan_hash(rows, ["i"], ["j"], leaf=1)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 + aggregates._STEM  # four levels: one of them, and any below, needs none


def test_rewritten_notes_carry_columns(spark):
    guid = "0" * 8 + "-0000-4000-8000-" + "1" * 12
    notes = spark.createDataFrame([(1, f"a [x](note:{guid}) b [y](note:{guid})", ["q"], None), (2, "", [], "t")], "note_id int, markdown string, codes array<string>, title string")
    out = rewrite_wikilinks(notes, spark.createDataFrame([(guid, "f")], "guid string, file string"), ["codes", "title"]).collect()
    assert sorted((r["note_id"], r["markdown"], r["codes"], r["title"]) for r in out) == [(1, "a [[f|x]] b [[f|y]]", ["q"], None), (2, "", [], "t")]


def test_scan_state_asks_for_pages_not_for_keys():
    import pandas as pd

    from tarnfold.streaming.streams import _PAGES, _FirstRounds

    class Pages(dict):
        asked = 0
        getMapState = lambda self, *_: self  # noqa: E731, N815

        def containsKey(self, key):  # noqa: N802
            self.asked += 1
            return key in self

        getValue, updateValue = dict.get, dict.__setitem__  # noqa: N815

    pages, state = Pages(), _FirstRounds()
    state.init(pages)
    batch = lambda r: pd.DataFrame({"round": [r] * 20_001, "key": [*map(str, range(20_000)), None]})
    told = [next(state.handleInputRows(("s", 0), iter([batch(r)]), None)).set_index("round")["new"].to_dict() for r in (5, 7, 3)]
    assert told == [{5: 20_001}, {7: 0}, {3: 20_001, 5: -20_001}] and pages.asked <= 3 * _PAGES
