"""Line deduplication, centroid clustering, phrase mining: brute force on small tables."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from oracle import SF, both
from pyspark.sql import functions as F

from tarnfold.llm import centroids, lines, phrases, queries

SPACE = " \t\n\x0b\x0c\r"


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


# --- lines

DOCS = "doc_id long, text string, doc string, row string, keep string, n_lines string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "clash", "clash", "clash", "clash") for i, t in rows], DOCS)


def kept_lines(rows):
    """(id, lines, dropped, text) of each row, sorted."""
    last = float("inf")
    first = {}
    for i, text in rows:
        for line in (text or "").split("\n"):
            key = lowered(line.strip(SPACE))
            if len(key) >= 10:
                first[key] = min(first.get(key, last), last if i is None else i)
    out = []
    for i, text in rows:
        whole = (text or "").split("\n")
        keys = [lowered(x.strip(SPACE)) for x in whole]
        stay = [x for x, k in zip(whole, keys, strict=True) if len(k) < 10 or first[k] == (last if i is None else i)]
        out.append((i, len(whole), len(whole) - len(stay), "\n".join(stay)))
    return sorted(out, key=repr)


def deduped(spark, rows, **options):
    bitmaps = lines.keep_bitmaps(docs(spark, rows), **options)
    out = lines.apply_bitmaps(docs(spark, rows), bitmaps)
    assert out.columns == ["doc_id", "text", "doc", "row", "keep", "n_lines", "n_dropped", "kept"]
    return sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept"]) for r in out.collect()), key=repr), bitmaps


EDGES = [
    (3, "A shared line of words\nown three\n  a SHARED line of words\t\nA shared line of words"), (1, "a shared line of words\r\nown one is long enough\nown one is long enough"), (2, None), (5, ""), (7, "\n\n\n"), (None, "a shared line of words\nnull's own long line"),
    (None, "null's own long line"), (3, "own three\na shared line of words"), (4, "É shared line of words\né shared line of words"), (6, "é shared line of words\nÉ shared line of words"), (8, "short\nshort"), (9, "short"), (9, "nine chars\n123456789\n1234567890"), (10, "123456789\n1234567890\x0b"), (1, "a shared line of words"),
]


def test_lines_against_brute_force(spark):
    assert deduped(spark, EDGES)[0] == kept_lines(EDGES)


def test_lines_of_hot_keys_and_long_documents(spark):
    rng = random.Random(5)
    rows = [(rng.randrange(300), "\n".join(rng.choice(["the line that everyone has", f"line number {rng.randrange(200)}", "x", "   "]) for _ in range(rng.choice([1, 5, 130, 700])))) for _ in range(200)]
    rows += [(50, "the line that everyone has\n" * 5000)] + [(77, "one row copied often")] * 50
    want = kept_lines(rows)
    got, bitmaps = deduped(spark, rows, share=1, rows_a_slice=64)
    assert got == want
    assert deduped(spark, rows, share=1, rows_a_slice=1 << 40)[0] == want  # without slices
    words = [w["word"] for r in bitmaps.collect() for w in r["keep"]]
    assert max(words) >= 10 and sum(bin(w["bits"] & (1 << 64) - 1).count("0") - 1 for r in bitmaps.collect() for w in r["keep"]) >= 0


def test_lines_bitmaps_tell_what_stays(spark):
    bitmaps = {r["doc"]: (r["n_dropped"], [(w["word"], w["bits"]) for w in r["keep"]]) for r in lines.keep_bitmaps(docs(spark, [(1, "a line of text"), (2, "x\n" * 70 + "a line of text\nA LINE OF TEXT\ny")])).collect()}
    assert bitmaps == {2: (2, [(1, ~(1 << 6 | 1 << 7))])}


def test_lines_empty_table_and_plan(spark):
    none = spark.createDataFrame([], DOCS)
    assert lines.dedup_lines(none).count() == 0 and lines.keep_bitmaps(none).count() == 0
    ranged = spark.range(10).select(F.col("id").alias("h1"), F.col("id").alias("h2"), (F.col("id") % 3).alias("slice"), F.col("id").alias("doc")).repartitionByRange("h1", "h2", "slice")
    from pyspark.sql import Window as W

    plan = ranged.withColumn("f", F.first("doc").over(W.partitionBy("h1", "h2", "slice").orderBy("doc")))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "rangepartitioning" in plan  # the window stands on the ranges


# --- centroids


def clustered(vectors, clusters=8, rounds=10, scale=1024, dimension=64, seed=3):
    """(id, cluster, distance) of usable vectors and the centroids, in Python's integers."""
    fine = [(i, [(Fraction(x) * scale).__floor__() for x in v]) for i, v in vectors if v is not None and len(v) == dimension and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted(fine, key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    at = [v for _, v in order[:clusters]]

    def nearest(v):
        return min(range(len(at)), key=lambda c: (sum((a - b) ** 2 for a, b in zip(v, at[c], strict=True)), c))

    for _ in range(rounds):
        own = [nearest(v) for _, v in fine]
        at = [[sum(x) // len(x) for x in zip(*m, strict=True)] if (m := [v for (_, v), o in zip(fine, own, strict=True) if o == c]) else old for c, old in enumerate(at)]
    return sorted(((i, c := nearest(v), sum((a - b) ** 2 for a, b in zip(v, at[c], strict=True))) for i, v in fine), key=repr), at


VECTORS = "vec_id long, embedding array<double>, cluster string, v string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "clash", "clash") for i, v in rows], VECTORS)


def test_centroids_against_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = [(i, (rng.normal(size=64) * (1 + i % 3)).tolist()) for i in range(150)]
    rows += [(200, None), (201, []), (202, [1.0] * 63), (203, [1.0] * 65), (204, [None] + [1.0] * 63), (205, [float("nan")] + [1.0] * 63), (206, [float("inf")] + [1.0] * 63), (None, [-0.3] * 64), (5, rows[5][1]), (207, rows[7][1]), (208, [0.0] * 64)]
    got, at = centroids.cluster(vectors(spark, rows), rows_a_block=16)
    want, want_at = clustered(rows)
    assert sorted(map(tuple, got.collect()), key=repr) == want and at == want_at


def test_centroids_of_wide_values(spark):
    rng = random.Random(4)
    rows = [(i, [rng.choice([1e300, -1e305, 3.7e17, -2.5, 2.0**27, 1e-300]) * rng.random() for _ in range(64)]) for i in range(30)]
    got, at = centroids.cluster(vectors(spark, rows), clusters=3, rounds=3, rows_a_block=7)
    want, want_at = clustered(rows, 3, 3)
    assert at == want_at and sorted(map(tuple, got.collect()), key=repr) == [(i, c, d if d < 1 << 63 else None) for i, c, d in want]
    report = centroids.cluster_report(vectors(spark, rows), clusters=3, rounds=3).first()
    assert report["inertia"] is None and report["centroid_sha256"] == hashlib.sha256(",".join(map(str, at[report["cluster"]])).encode()).hexdigest()
    middle = [(i, [float(rng.choice([-1, 1])) * 2.0**18 * rng.random() for _ in range(64)]) for i in range(20)]
    got, at = centroids.cluster(vectors(spark, middle), clusters=4)
    assert (sorted(map(tuple, got.collect()), key=repr), at) == clustered(middle, 4)


def test_centroids_of_few_and_none(spark):
    assert centroids.cluster_report(vectors(spark, [])).count() == 0 and centroids.cluster_report(vectors(spark, [(1, None)])).count() == 0
    two = [(1, [1.0] * 64), (1, [1.0] * 64), (2, [2.0] * 64)]
    assert sorted(map(tuple, centroids.cluster(vectors(spark, two))[0].collect())) == clustered(two)[0]


def test_limbs_and_tables():
    for x in (0, -1, 1 << 31, -(1 << 31), 1 << 200, -(1 << 200) - 5, 12345678901234567890):
        assert sum(limb << 32 * i for i, limb in enumerate(centroids.limbs(x))) == x and all(-(1 << 31) <= limb < 1 << 32 for limb in centroids.limbs(x))
    (table,) = centroids.tables([np.array([-2, 0, 5])], np.array([[1], [4]]))
    assert table.tolist() == [[9, 36], [1, 16], [16, 1]]


# --- phrases


def mined(rows, least=30, longest=4, top=2000):
    words, counts = Counter(), {}
    for lang, text in rows:
        lang = "und" if lang is None else lang
        f = counts.setdefault(lang, Counter())
        for piece in re.split("[.,;:!?\x0a-\x0d]", lowered(text or "")):
            w = [x for x in re.split("[ \t]+", piece) if x]
            words[lang] += len(w)
            for k in range(1, longest + 1):
                f.update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, f in counts.items():
        held = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        scored = []
        for p, a in held.items():
            if any(len(q) > len(p) and 100 * b >= 80 * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in held.items()):
                continue
            score, cut = min((2000000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), " ".join(p), a, f[p[:cut]], f[p[cut:]], words[lang], score))
        out += [(lang, rank, *row[3:]) for rank, row in enumerate(sorted(scored)[:top], 1)]
    return sorted(out, key=repr)


def corpus(rng, n):
    vocabulary = ["New", "york", "city", "the", "of", "é", "ÉA", "a'b", "x", "in", "on", "at"]
    return [(rng.choice(["en", "de", None, "und", ""]), " ".join(rng.choice(vocabulary) + rng.choice(["", "", "", ",", ".", "\t", "\n", " new york City"]) for _ in range(rng.choice([0, 3, 40, 200])))) for _ in range(n)]


def phrase_rows(spark, rows, **options):
    df = spark.createDataFrame([(la, t, "clash", "clash") for la, t in rows], "lang string, text string, phrase string, f string")
    return sorted((tuple(r) for r in phrases.collocations(df, **options).collect()), key=repr)


@pytest.mark.parametrize("options", [{}, {"share": 2, "segment": 50}, {"least": 5, "share": 1}, {"top": 3}, {"longest": 2}, {"longest": 3, "least": 8, "segment": 200}])
def test_phrases_against_brute_force(spark, options):
    rows = corpus(random.Random(len(options)), 120) + [("en", None), ("en", ""), (None, "..,,"), ("fr", "a " * 100), ("long", "a b c d e " * 3000 + "q" * 5000)]
    assert phrase_rows(spark, rows, **options) == mined(rows, options.get("least", 30), options.get("longest", 4), options.get("top", 2000))


def test_phrases_that_the_sample_missed_are_found(spark):
    """A sample without any row proposes nothing: passes go on until all phrases are counted."""
    rows = [("en", "one two three four five")] * 40 + [("en", "six seven eight")] * 29
    df = spark.createDataFrame(rows, "lang string, text string").coalesce(1)
    found, passes = phrases.frequent(df, share=1 << 40)
    got = {r["phrase"]: r["f"] for r in found.filter("k > 1").collect()}
    want = ["one two", "two three", "three four", "four five", "one two three", "two three four", "three four five", "one two three four", "two three four five"]
    assert got == dict.fromkeys(want, 40) and passes >= 3
    everything, once = phrases.frequent(df, share=1)
    assert {r["phrase"]: r["f"] for r in everything.filter("k > 1").collect()} == got and once == 1
    crowded, _ = phrases.frequent(df, share=1, filter_bits=64)  # a filter that says yes to everything costs rows, not results
    assert {r["phrase"]: r["f"] for r in crowded.filter("k > 1 and f >= 30").collect()} == got


def test_phrases_empty(spark):
    assert phrase_rows(spark, []) == [] and phrase_rows(spark, [("en", None)]) == []


def test_segments_cut_at_ends_of_pieces_only():
    text = b"a b. c d e f g h i j, k"
    assert list(phrases.segments([text, b"l m"], 6)) == [b"a b. c d e f g h i j,", b" k\nl m"]
    assert b"".join(phrases.segments([text], 1)) == text


@pytest.mark.parametrize("name", ["op11_lines", "op12_centroids", "op13_phrases"])
def test_query_on_more_rows_equals_sql(spark, name):
    ours, theirs = both(spark, queries.QUERIES[name], queries.ORACLE_SQL[name], SF.replace("sf0.001", "sf0.01"))
    assert ours == theirs and ours
