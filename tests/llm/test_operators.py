"""Each operator against a brute-force version, with nulls, empties, ties, repeats and clashing columns."""

import collections
import hashlib
import itertools
import math
import os
import random
import struct
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from oracle import assert_same, connect
from pyspark.sql import functions as F

from plinth.llm import batches, jaccard, licenses, lmscore, mixing, naming, pieces, queries, topk, toxicity, urls, warc
from plinth.llm.gru import Network, Spelling
from plinth.llm.scratch import Scratch, steady
from plinth.llm.words import words_of
from plinth.plans.shared import folders, shared_dir

DOCS = "doc_id long, text string, key string, n long, node long, row long"
ODD = [(1, None), (2, ""), (3, "a b c"), (4, "A B C"), (5, "one"), (6, "x " * 5000), (7, "x " * 5000), (7, "x " * 5000), (None, "a b c"), (None, None), (8, "é" * 9000), (9, "é" * 9000 + "e")]


def frame(spark, rows):
    """The rows with columns whose names the operators use themselves."""
    return spark.createDataFrame([(k, t, "k", 1, 2, 3) for k, t in rows], DOCS)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(7)
    words = ["w%d" % i for i in range(400)]
    rows = list(ODD)
    for i in range(40):
        base = [rng.choice(words) for _ in range(rng.choice([5, 12, 40, 120]))]
        for j in range(rng.choice([1, 1, 6])):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 6])):
                w[rng.randrange(len(w))] = rng.choice(words)
            rows.append((100 + 10 * i + j, " ".join(w)))
    return rows


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_sql(spark, sf_dir, name):
    assert_same(queries.QUERIES[name](spark, sf_dir), connect(sf_dir), queries.ORACLES[name])


@pytest.mark.parametrize("table,run", [("documents", lambda d: lmscore.score_documents(d)), ("documents", lambda d: licenses.scan_licenses(d)), ("documents", lambda d: naming.exact_duplicates(d)), ("documents", lambda d: jaccard.join_groups(d)), ("documents", lambda d: mixing.mix(d)), ("documents", lambda d: toxicity.score_documents(d, None)), ("documents", lambda d: pieces.encode(d, queries.PIECE_MODEL)), ("pages", lambda d: urls.judge_urls(d)), ("pages", lambda d: warc.archive_pages(d)), ("embeddings", lambda d: topk.top_k(d))])
def test_empty_tables(spark, sf_dir, table, run):
    assert run(spark.read.parquet(f"{sf_dir}/{table}.parquet").limit(0)).count() == 0


def test_lm_scores(spark, corpus):
    got = collections.Counter((r["doc_id"], r["n_words"], round(r["log10_prob"], 6)) for r in lmscore.score_documents(frame(spark, corpus), chunk=700).collect())
    counts = collections.Counter()
    texts = [(k, words_of(t)) for k, t in corpus]
    for _, w in texts:
        counts.update(tuple(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1))
    total = sum(c for g, c in counts.items() if len(g) == 1)

    def score(w, i, n):
        g = tuple(w[i - n + 1 : i + 1])
        if n == 1:
            return math.log10(counts[g] / total)
        return math.log10(counts[g] / counts[g[:-1]]) if counts[g] >= 2 else math.log10(0.4) + score(w, i, n - 1)

    assert got == collections.Counter((k, len(w), round(sum(score(w, i, min(3, i + 1)) for i in range(len(w))), 6)) for k, w in texts)


def test_license_words_and_places(spark):
    texts = ["The MIT License; mit license", "cc-by CC BY", "ÉMIT license", "gnu general public license x apache  license", "spdx-License-Identifier: (MIT OR GPL-2.0-only) AND Apache-2.0 WITH LLVM-exception */", None, "", "mit\nlicense " * 20_000]
    got = {r["doc_id"]: r for r in licenses.scan_licenses(frame(spark, list(enumerate(texts)))).collect()}
    pattern = licenses.re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    for i, t in enumerate(texts):
        w = pattern.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        at = [(s, label) for p, label in licenses.BASE.items() for s in range(len(w)) if w[s : s + len(p.split())] == p.split()]
        r = got[i]
        assert (r["n_words"], r["n_base"], r["base_labels"]) == (len(w), len(at), ",".join(sorted({x for _, x in at})))
        assert (r["first_word"], r["last_word"]) == ((min(at)[0], max(at)[0]) if at else (None, None))
        assert 0 <= r["score"] <= 1 and set(r["base_labels"].split(",")) <= set(r["labels"].split(",")) | {""}
    assert got[4]["expressions"][0]["accepted"] and got[4]["expressions"][0]["exceptions"] == ["llvm-exception"]


@pytest.mark.parametrize("text,want", [("MIT", True), ("GPL-3.0", False), ("GPL-3.0 OR MIT AND ISC", True), ("(GPL-3.0 OR MIT) AND GPL-2.0", False), ("MIT AND (", True), ("AND MIT", None), ("", None), ("MIT WITH x-exception OR y", True)])
def test_license_expressions(text, want):
    assert licenses.evaluate(text).accepted is want


def test_license_tags_on_one_line(spark):
    texts = ["SPDX-License-Identifier: MIT */ code /* SPDX-License-Identifier: Apache-2.0 */", "spdx-license-identifier:spdx-license-identifier: isc\nSPDX-License-Identifier: GPL-2.0-only OR MIT SPDX-License-Identifier : Zlib", "x; " * 20_000 + "SPDX-License-Identifier: MIT; " * 500]
    got = [r for r in licenses.scan_licenses(frame(spark, list(enumerate(texts)))).orderBy("doc_id").collect()]
    assert [[tuple(e["identifiers"]) for e in r["expressions"]] for r in got] == [[("mit",), ("apache-2.0",)], [(), ("isc",), ("gpl-2.0-only", "mit"), ("zlib",)], [("mit",)] * 500]
    assert [r["labels"] for r in got] == ["apache-2.0,mit", "gpl-2.0-only,isc,mit,zlib", "mit"]
    assert [r["score"] for r in got[:2]] == [1 - 0.5**4, 1 - 0.5**6]


def test_url_verdicts(spark):
    cases = {None: ("", "", None, "allow"), "no scheme": ("", "", None, "allow"), "http://A.Example.ORG/es/x?y": ("a.example.org", "/es/x", "example.org/es/", "block"), "x://example.org/en/123#f": ("example.org", "/en/123", "example.org/en/1", "block"), "http://notexample.org/es/": ("notexample.org", "/es/", "org/", "allow"), "http://b.com/de/": ("b.com", "/de/", "com/de/", "block"), "http://b.com?/de/": ("b.com", "", None, "allow"), "http://b.net/casino/1": ("b.net", "/casino/1", None, "block"), "http://b.net/a\nb": ("b.net", "/a\nb", None, "allow")}
    pages = spark.createDataFrame([(i, u, "x", "y", "z") for i, u in enumerate(cases)], "page_id long, url string, host string, rule string, key string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge_urls(pages).collect()}
    assert got == dict(enumerate(cases.values()))


def test_url_index_misses_nothing(spark):
    """Through the index the same rules fit as without it."""
    rules = urls.rules()
    pages = spark.createDataFrame([(i, f"http://{h}/{p}") for i, (h, p) in enumerate((h, p) for h in ("example.org", "x.example.com", "org") for p in ("es/", "en/1", "fr/a", "de/", "casino/", "login", "a?phpsessid=1"))], "page_id long, url string")
    for r in urls.judge_urls(pages).join(pages, "page_id").collect():
        whole = r["url"].split("://")[1]
        fits = [x for x in rules if licenses.re.search(x.pattern, r["host"] + r["path"] if x.domain else whole)]
        best = max((x for x in fits if x.domain), key=lambda x: len(x.name), default=None)
        assert r["rule"] == (best.name if best else None)
        assert r["verdict"] == (best.verdict if best else "block" if fits else "allow")


@pytest.mark.parametrize("block", [7, 4096])
def test_exact_duplicates(spark, corpus, block):
    got = naming.exact_duplicates(frame(spark, corpus), block=block).collect()
    groups = collections.defaultdict(list)
    for k, t in corpus:
        groups[t or ""].append(k)
    want = collections.Counter((k, max((x for x in g if x is not None), default=None), len(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for k in g)
    assert collections.Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == want
    kept = [r for r in got if r["kept"]]
    assert len(kept) == len(groups) and all(r["doc_id"] == r["keep_id"] for r in kept)


def test_input_that_may_change_its_order_is_kept(spark, corpus, tmp_path):
    rows = frame(spark, corpus)
    rows.write.parquet(f"{tmp_path}/rows")
    files = spark.read.parquet(f"{tmp_path}/rows").where("n = 1").select("doc_id", "text")
    scratch = Scratch(spark, "steady")
    assert steady(files, scratch) is files
    for moved in (files.repartition(3), files.orderBy("text"), files.limit(9), files.sample(0.5), files.join(files.select("doc_id").distinct(), "doc_id")):
        assert all("/input/" in f for f in steady(moved, scratch).inputFiles())
    as_rows = lambda df: collections.Counter(map(tuple, df.collect()))
    moved = rows.repartition(5, "text")
    assert as_rows(naming.exact_duplicates(moved, block=7)) == as_rows(naming.exact_duplicates(rows, block=7))
    rounded = lambda df: as_rows(lmscore.score_documents(df).select("doc_id", "n_words", F.round("log10_prob", 6)))
    assert rounded(moved) == rounded(rows)


def test_hot_blocks_have_one_name(spark):
    rows = [(i, "hot" * 100) for i in range(3000)] + [(5000 + i, f"cold {i}") for i in range(50)]
    got = naming.exact_duplicates(frame(spark, rows), block=64).groupBy("group_size").count().collect()
    assert {r["group_size"]: r["count"] for r in got} == {3000: 3000, 1: 50}


def test_warc_round_trip(spark):
    long = "é" * 700
    pages = [(1, "http://a/\r\nX: y", long), (2, None, long), (3, "u", long), (3, "u", long), (4, "u", "short"), (5, "u", "short"), (6, "u", None), (None, "v", "z" * 1000)]
    df = spark.createDataFrame([(*p, "a", 1) for p in pages], "page_id long, url string, html string, digest string, offset long")
    got = warc.archive_pages(df).collect()
    assert sorted((r["page_id"] or 0, r["record_type"], r["refers_to"]) for r in got) == [(0, "response", None), (1, "revisit", 3), (2, "revisit", 3), (3, "response", None), (3, "response", None), (4, "response", None), (5, "response", None), (6, "response", None)]
    text = {p[0]: ((p[2] or "").encode(), p[1]) for p in pages}
    for r in got:
        assert (r["payload_bytes"], r["payload_digest"], r["url"]) == (len(text[r["page_id"]][0]), hashlib.sha1(text[r["page_id"]][0]).hexdigest(), text[r["page_id"]][1])


def test_ranges_coalesce():
    assert list(warc.coalesced([("a", 0, 5), ("a", 7, 5), ("a", 100, 5), ("b", 105, 5)], gap=10, most=50)) == [("a", 0, 12, [(0, 5), (7, 5)]), ("a", 100, 5, [(0, 5)]), ("b", 105, 5, [(0, 5)])]


def links_by_hand(rows, n, num, den):
    sets = []
    for _, t in rows:
        w = words_of(t)
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    top = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and den * both >= num * (len(sets[i]) + len(sets[j]) - both):
                a, b = top[i], top[j]
                top = [b if x == a else x for x in top]
    least = {c: min((rows[i][0] for i in range(len(rows)) if top[i] == c and rows[i][0] is not None), default=None) for c in top}
    return collections.Counter((rows[i][0], len(sets[i]), least[top[i]]) for i in range(len(rows)))


@pytest.mark.parametrize("n,num,den,small", [(3, 90, 100, False), (5, 80, 100, False), (3, 90, 100, True), (2, 60, 100, True)])
def test_jaccard_join(spark, corpus, monkeypatch, n, num, den, small):
    if small:  # reach the classes of pairs, the blocks and the last round on few rows
        for k, v in {"RARE": 2, "SMALL": 3, "ROUNDS": 1, "BLOCK_TOKENS": 500}.items():
            monkeypatch.setattr(jaccard, k, v)
    got = jaccard.join_groups(frame(spark, corpus), shingle=n, num=num, den=den).collect()
    assert collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == links_by_hand(corpus, n, num, den)


def test_jaccard_join_clears_its_disk(spark, sf_dir):
    """Shuffle files go with the step that wrote them, long tables when no later step reads them; the caller's setting stays."""

    def shuffled():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n")
        return {f: os.path.getsize(f) for f in files if f.endswith(".data") and os.path.exists(f)}

    def tables():
        return {f"{d}/{x}" for d in folders(spark, shared_dir(spark)) if d.startswith("jaccard-") for x in folders(spark, f"{shared_dir(spark)}/{d}")}

    clear = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    old, kept, setting = shuffled(), tables(), spark.conf.get(clear)
    got = jaccard.join_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    for _ in range(50):  # files are deleted in the background
        left = sum(n for f, n in shuffled().items() if f not in old)
        if left < 20_000:
            break
        time.sleep(0.1)
    assert left < 20_000, left  # of counts alone
    assert not {t.partition("/")[2] for t in tables() - kept} & {"documents", "nodes", "sets", "shared", "shared2", "signatures", "survivors"}
    assert spark.conf.get(clear) == setting
    assert got.count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()


def test_top_k(spark):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.standard_normal(8) * 3).round(1).tolist()) for i in range(300)]
    rows += [(320, rows[5][1]), (320, rows[5][1]), (None, rows[0][1]), (341, None), (342, [None] * 8), (343, [float("nan")] * 8), (344, [float("inf")] + [0.0] * 7), (360, [1.0, 2.0]), (361, [])]
    df = spark.createDataFrame([(k, v, 1, 1) for k, v in rows], "vec_id long, embedding array<float>, rank int, score long")
    got = sorted(tuple(r) for r in topk.top_k(df, k=7).collect())
    good = [(k, topk.whole([np.float32(v).tolist()])[0]) for k, v in rows if k is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for i, (q, x) in enumerate(good):
        if q % 20 == 0:
            best = sorted((-int(x @ y), k) for k, y in good if k != q and len(y) == len(x))[:7]
            want += [(q, n + 1, k, -s) for n, (s, k) in enumerate(best)]
    assert got == sorted(want)


def test_top_k_of_large_components(spark):
    rng = np.random.default_rng(4)
    rows = [(i, (rng.standard_normal(4) * 3).tolist()) for i in range(400)]
    rows += [(400 + i, (rng.standard_normal(4).clip(-2, 2) * 10.0 ** rng.integers(5, 8)).tolist()) for i in range(60)] + [(500, [33_554_432.0, 0.0, 0.0, -33_554_432.0]), (501, [0.0, 4e7, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    whole = {k: [math.floor(64 * x) for x in v] for k, v in rows}
    want = []
    for k in [k for k in whole if k % 20 == 0]:
        best = sorted((-sum(a * b for a, b in zip(whole[k], w, strict=True)), j) for j, w in whole.items() if j != k)[:20]
        want += [(k, n + 1, j, -s) for n, (s, j) in enumerate(best)]
    assert sorted(tuple(r) for r in topk.top_k(df).collect()) == sorted(want)


@pytest.mark.parametrize("x", [1e9, 1e18])
def test_top_k_without_a_long_score(spark, x):
    df = spark.createDataFrame([(20, [x]), (21, [x])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="is no long"):
        topk.top_k(df).collect()


def test_bounds_eliminate_most_candidates(spark, sf_dir):
    """On the given vectors under a third of the scores is computed, and no bound is under its score."""
    x = topk.whole([r["embedding"] for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").where("embedding IS NOT NULL").collect()])
    table = topk.Table(topk.choose_pivots(x, topk.PIVOTS))
    places, ids = table.places(x), np.arange(len(x))
    best = topk.Best(ids[:50], x[:50], places[:50], 20)
    best.meet(ids, x, places)
    assert best.evaluated < best.met / 3
    sizes = np.sqrt((x**2).sum(1))
    assert (places[:50] @ places.T + topk.SLACK * sizes[:50, None] * sizes + 0.5 >= x[:50] @ x.T).all()


def test_pivots_that_depend_on_each_other():
    x = np.array([[3, 0, 0], [6, 0, 0], [0, 0, 0], [1, 2, 2], [-5, 4, 4]], np.int64)
    table = topk.Table(x)
    assert len(table.axes) == 2
    at = table.places(x)
    assert (at @ at.T + 1e-3 >= x @ x.T).all() and np.allclose((at[:, :-1] ** 2).sum(1), (x**2).sum(1))


@pytest.mark.parametrize("blocks", [(1, 1, 8), (6, 16, 6), (500, 9000, 100)])
def test_tiles_use_the_machine(blocks):
    across, down = topk.tiles(*blocks)
    assert 1 <= across <= blocks[0] and 1 <= down <= blocks[1] and across * down >= min(2 * blocks[2], blocks[0] * blocks[1])


@pytest.mark.parametrize("run", [lambda d: lmscore.score_documents(d), lambda d: jaccard.join_groups(d), lambda d: warc.archive_pages(d, "doc_id", "text", "text"), lambda d: topk.top_k(d, key="doc_id", vector="v")])
def test_text_ids_are_refused(spark, run):
    df = spark.createDataFrame([("a", "x", [1.0])], "doc_id string, text string, v array<double>")
    with pytest.raises(TypeError, match="whole-number column"):
        run(df)


@pytest.mark.parametrize("rows", [[(None, "mit license"), (1, "mit license"), (1, "mit license"), (1, None)]])
def test_null_and_repeated_keys(spark, rows):
    """Operators that look at rows one by one give each row its own result."""
    df = frame(spark, rows).withColumn("source", F.lit(None).cast("string"))
    want = collections.Counter(k for k, _ in rows)
    for out in (licenses.scan_licenses(df), pieces.encode(df, queries.PIECE_MODEL), mixing.mix(df), toxicity.score_documents(df, None), toxicity.score_documents(df, toxicity.train(["bad word", "good day"] * 2, [1, 0] * 2, epochs=1))):
        assert collections.Counter(r["doc_id"] for r in out.collect()) == want
    pages = spark.createDataFrame([(k, f"http://a.example.org/es/{'x' * 50_000}", "h") for k, _ in rows], "page_id long, url string, path string")
    got = urls.judge_urls(pages).collect()
    assert collections.Counter(r["page_id"] for r in got) == want and {r["verdict"] for r in got} == {"block"}


def test_fit_without_two_labels(spark):
    df = frame(spark, [(i, "some words") for i in range(30)])
    for labels in ([], [(i, 0) for i in range(30)], [(i, 1) for i in range(30)], [(i, None) for i in range(30)]):
        assert toxicity.fit(df, spark.createDataFrame(labels, "doc_id long, toxic int")) is None


def test_training_rows_are_bounded_by_keys(spark):
    """A labelled id that repeats comes to the driver once."""
    df = frame(spark, [(2, f"text {i}") for i in range(3000)] + [(3, "x")])
    seen = []
    original = toxicity.train
    try:
        toxicity.train = lambda texts, labels: seen.append(len(texts))
        toxicity.fit(df, spark.createDataFrame([(2, 1), (3, 0)], "doc_id long, toxic int"))
    finally:
        toxicity.train = original
    assert seen == [sum(zlib.crc32(k) % 3 != 1 for k in (b"2", b"3"))]


def test_long_texts_are_scored_whole(spark):
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(200)]
    texts = [" ".join(rng.choice(words) for _ in range(60)) for _ in range(120)]
    net = toxicity.train([t + (" zorg zorged zorging" if i % 2 else "") for i, t in enumerate(texts)], [i % 2 for i in range(120)])
    long = " ".join(rng.choice(words) for _ in range(60_000))
    got = [r["score"] for r in toxicity.score_documents(frame(spark, [(1, long), (2, long + " zorg zorged zorging " + texts[0])]), net).orderBy("doc_id").collect()]
    assert got[0] < 0.7 <= got[1]


def test_slices_by_bytes():
    b = pa.RecordBatch.from_pydict({"t": ["a" * 10, None, "b" * 300, "", "c" * 10, "d"]})
    cut = list(batches.bounded(iter([b, b.slice(0, 0)]), 0, most=25, rows=2))
    assert [x.num_rows for x in cut] == [2, 1, 2, 1] and pa.Table.from_batches(cut).to_pydict() == b.to_pydict()


def test_buckets_have_no_ceiling():
    sizes = [0, 10**6, 10**9, 10**12, 10**14]
    counts = [lmscore.bucket_count(s) for s in sizes]
    assert counts == sorted(counts) and all(s / n <= lmscore.LARGE_BUCKET for s, n in zip(sizes, counts, strict=True))


def best_flow(patterns, quotas, most):
    """The most words, and the least cost of them, by trying all whole-number flows."""
    arcs = [(p, s) for p in patterns for s in p]
    best = (0, 0)
    for flow in itertools.product(*(range(most * patterns[p] + 1) for p, _ in arcs)):
        given, got = collections.Counter(), collections.Counter()
        for (p, s), n in zip(arcs, flow, strict=True):
            given[p] += n
            got[s] += n
        if all(given[p] <= most * n for p, n in patterns.items()) and all(got[s] <= q for s, q in quotas.items()):
            cost = sum(max(0, given[p] - k * patterns[p]) if k else 0 for p in patterns for k in range(1, most))
            best = max(best, (sum(flow), -cost))
    return best[0], -best[1]


@pytest.mark.parametrize("patterns,quotas", [({("a",): 2, ("a", "b"): 1, ("b",): 1}, {"a": 4, "b": 3}), ({("a", "b"): 2, ("b", "c"): 1}, {"a": 1, "b": 3, "c": 2}), ({("a", "b", "c"): 1, ("c",): 2}, {"a": 1, "b": 1, "c": 3}), ({("a",): 1, ("b",): 3}, {"a": 3, "b": 2})])
def test_flow_over_overlapping_patterns(patterns, quotas):
    given = mixing.route(patterns, quotas)
    cost = sum(max(0, n - patterns[p]) for p, n in given.items())
    assert (sum(given.values()), cost) == best_flow(patterns, quotas, 2)


def test_overlapping_sources(spark):
    """Documents that belong to several sources serve whichever lacks words; repeats come only once nothing new is left."""
    rows = [(i, "w " * 10, ["a"]) for i in range(10)] + [(20 + i, "w " * 10, ["b", "a", "a"]) for i in range(10)] + [(40 + i, "w " * 10, ["b"]) for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source array<string>")
    got = {r["doc_id"]: r for r in mixing.mix(df, weights=(1,), share=0.6).collect()}
    assert {r["copies"] for r in got.values()} <= {0, 1} and sum(r["taken"] for r in got.values()) == pytest.approx(0.6 * (200 + 150), abs=30)
    twice = {r["doc_id"]: r["copies"] for r in mixing.mix(df, weights=(1,), share=1.5).collect()}
    assert max(twice.values()) == 2 and min(twice.values()) >= 1


def test_given_documents_come_near_their_targets(spark, sf_dir):
    """Each source misses its target by less than any document that could still be taken."""
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source").collect()
    source, by = {r["doc_id"]: r["source"] for r in rows}, collections.defaultdict(list)
    for r in mixing.mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).collect():
        by[source[r["doc_id"]]].append(r)
    for s, mine in by.items():
        missing = mine[0]["target"] - sum(r["taken"] for r in mine)
        least = min(r["copies"] for r in mine if r["size"])
        assert -1 < missing <= min(r["size"] for r in mine if r["size"] and r["copies"] == least) + 1, s


def test_targets_and_flow():
    assert mixing.targets({"a": 100, "b": 100, None: 100}) == pytest.approx({"a": 200.0, "b": 83.333333, None: 166.666667})
    assert mixing.targets({"a": 0}) == {"a": 0.0}
    given = mixing.route({("a",): 10, ("a", "b"): 10, ("b",): 10}, {"a": 25, "b": 5})
    assert sum(given.values()) == 30 and given["b",] <= 5 and given["a",] <= 20


def test_mixture(spark):
    rows = [(i, "w " * (1 + i * 37 % 50), f"s{i % 4}" if i % 5 else None) for i in range(900)] + [(1000, None, "s0"), (1001, "", "s1")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, size long")
    got = {r["doc_id"]: r for r in mixing.mix(df).collect()}
    assert {k: r["taken"] for k, r in got.items()} == {r["doc_id"]: r["taken"] for r in mixing.mix(df).collect()}
    sizes, taken = collections.Counter(), collections.Counter()
    for k, t, s in rows:
        n = len((t or "").split())
        assert got[k]["size"] == n and 0 <= got[k]["taken"] <= 2 * n
        sizes[s] += n
        taken[s] += got[k]["taken"]
    want = mixing.targets(sizes)
    for k, _, s in rows:
        assert got[k]["source_size"] == sizes[s] and got[k]["target"] == pytest.approx(want[s])
    assert {s: taken[s] for s in want} == pytest.approx(want, abs=10)
    assert mixing.copies(df).count() == sum(r["copies"] for r in got.values())


def test_mixture_fills_what_a_long_document_leaves(spark):
    """One source whose order often stops at a very long document, one of equal rows, and one where no document fits."""
    sizes = {"a": 40_000, "b": 90, "c": 300}
    rows = [(i, "w " * 100, "a") for i in range(200)] + [(200, "w " * 20_000, "a")] + [(7, "w w w", "b")] * 30 + [(300 + i, "w " * 100, "c") for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4).cache()
    for seed in range(3):
        got = mixing.mix(df, weights=(1,), share=0.5, seed=seed).collect()
        given = mixing.route({(s,): n for s, n in sizes.items()}, mixing.targets(sizes, (1,), 0.5))
        for s, size in sizes.items():
            mine = [r for r in got if r["source_size"] == size]
            missing = given[(s,)] - sum(r["taken"] for r in mine)
            least = min(r["copies"] for r in mine)
            assert 0 <= missing < min(r["size"] for r in mine if r["copies"] == least), (seed, s, missing)
        assert mixing.copies(df, weights=(1,), share=0.5, seed=seed).count() == sum(r["copies"] for r in got)


def test_fill_takes_sizes_from_the_largest():
    assert mixing.fill(10, {4: 1, 3: 5, 1: 1}) == [(4, 4, None), (3, 3, 2)]
    assert mixing.fill(100, {9: 2, 8: 1, 7: 20, 4: 1, 3: 1}) == [(8, 9, None), (7, 7, 10), (4, 4, None)]
    rng = random.Random(5)
    for _ in range(300):
        sizes = {rng.randint(1, 60): rng.randint(1, 9) for _ in range(rng.randint(1, 15))}
        room = rng.randint(1, 300)
        spans = mixing.fill(room, sizes)
        taken = {s: next((n or sizes[s] for lo, hi, n in spans if lo <= s <= hi), 0) for s in sizes}
        left = room - sum(s * n for s, n in taken.items())
        assert left >= 0 and all(s > left for s in sizes if taken[s] < sizes[s])


def test_network_gradients():
    net = Network(3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    spelling, ids, mask, y = Spelling([b"abc", b"de", b"fghij", b"k"]), np.array([[0, 1], [2, 3], [1, 0]]), np.array([[1, 1], [1, 1], [1, 0.0]]), np.array([1.0, 0.0])
    _, grads = net.gradients(spelling, ids, mask, y)
    for k, p in net.p.items():
        flat, g = p.reshape(-1), np.asarray(grads[k]).reshape(-1)
        i = int(np.abs(g).argmax())
        old = flat[i]
        ends = []
        for d in (1e-4, -1e-4):
            flat[i] = old + d
            ends.append(net.gradients(spelling, ids, mask, y)[0])
        flat[i] = old
        assert g[i] == pytest.approx((ends[0] - ends[1]) / 2e-4, rel=2e-2, abs=1e-4), k


def test_windows_cover():
    for n in (0, 1, 48, 49, 80, 81, 1000):
        starts = toxicity.window_starts(n)
        assert starts[0] == 0 and starts[-1] + toxicity.WIDTH >= n and all(b - a <= toxicity.STRIDE for a, b in zip(starts, starts[1:], strict=False))


def test_toxicity_learns_and_keeps_labels_apart(spark):
    rng = random.Random(2)
    clean = ["".join(rng.choice("abcdefgh") for _ in range(rng.choice([2, 4, 7]))) for _ in range(300)]
    rows, labels = [], []
    for i in range(600):
        w = [rng.choice(clean) for _ in range(rng.choice([10, 60, 200]))]
        bad = i % 3 == 0
        if bad:
            for _ in range(3):
                w[rng.randrange(len(w))] = "zorg" + rng.choice(["", "ed", "ing", "s"])
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    df = frame(spark, [*rows, (9000, None), (9001, "..."), (None, "x")])
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    net = toxicity.fit(df, known)
    got = {r["doc_id"]: r for r in toxicity.score_documents(df, net).collect()}
    held = [i for i, _ in rows if got[i]["held_out"]]
    assert 150 < len(held) < 250
    assert sum(got[i]["predicted"] == labels[i][1] for i in held) >= 0.95 * len(held)
    assert got[9000]["score"] == got[9001]["score"] == 0.0
    assert {r["doc_id"] for r in toxicity.clean_documents(df, net).collect()} == {k for k, r in got.items() if not r["predicted"]}
    other = known.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert {r["doc_id"]: r["score"] for r in toxicity.score_documents(df, toxicity.fit(df, other)).collect()} == {k: r["score"] for k, r in got.items()}


def test_pieces_equal_the_library(spark, sf_dir):
    sentencepiece = pytest.importorskip("sentencepiece")
    library = sentencepiece.SentencePieceProcessor(model_file=queries.PIECE_MODEL)
    texts = [r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()] + ["", " ", "a  b\n\t", "日本語😀\x00", "aaaaaaaaaaaaaaaaaaa", "<s> <unk> <0x0A>", None, "ab " * 20_000]
    df = frame(spark, list(enumerate(texts)))
    encoded = pieces.encode(df, queries.PIECE_MODEL)
    for r in encoded.collect():
        t = texts[r["doc_id"]]
        assert r["ids"] == (None if t is None else library.encode(t))
        assert r["round_trip"] is (None if t is None else True)
    back = {r["doc_id"]: r["text"] for r in pieces.decode(encoded, queries.PIECE_MODEL).collect()}
    assert back == dict(enumerate(texts))


def varint(n):
    return bytes([n & 127 | 128]) + varint(n >> 7) if n > 127 else bytes([n])


def field(k, v):
    """A protocol buffer field."""
    if isinstance(v, float):
        return varint(k << 3 | 5) + struct.pack("<f", v)
    return varint(k << 3) + varint(v) if isinstance(v, int) else varint(k << 3 | 2) + varint(len(v)) + v


def hand_made(rng, kind, fallback, prefix, squeeze, escape):
    """A small model: single characters, and pieces that join two before them (in a BPE model scored in that order)."""
    mark = "▁" if escape else " "
    pieces_ = [*"abcdef", mark]
    while len(pieces_) < 60:
        w = rng.choice(pieces_) + rng.choice(pieces_)
        if len(w) < 7 and mark not in w[1:] and w not in pieces_:
            pieces_.append(w)
    scores = [-float(i) for i in range(len(pieces_))] if kind == pieces.BPE else [-rng.uniform(1, 9) * len(w) ** 0.5 for w in pieces_]
    all_ = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), *((f"<0x{i:02X}>", 0.0, 6) for i in range(256 * fallback)), *((w, s, 1) for w, s in zip(pieces_, scores, strict=True))]
    data = b"".join(field(1, field(1, p.encode()) + field(2, s) + field(3, t)) for p, s, t in all_)
    return data + field(2, field(3, kind) + field(35, fallback) + field(4, len(all_))) + field(3, field(1, b"identity") + field(3, prefix) + field(4, squeeze) + field(5, escape))


@pytest.mark.parametrize("kind", [pieces.UNIGRAM, pieces.BPE])
@pytest.mark.parametrize("fallback", [0, 1])
@pytest.mark.parametrize("prefix,squeeze,escape", [(1, 0, 1), (1, 1, 1), (0, 1, 1), (0, 0, 1), (1, 0, 0)])
def test_hand_made_models_equal_the_library(kind, fallback, prefix, squeeze, escape):
    """Unigram and BPE run through the same search. Of paths of equal weight the library's 32-bit sums may choose another one."""
    sentencepiece = pytest.importorskip("sentencepiece")
    rng = random.Random(kind * 10 + fallback)
    model = hand_made(rng, kind, fallback, prefix, squeeze, escape)
    library, machine = sentencepiece.SentencePieceProcessor(model_proto=model), pieces.Transducer(model)
    texts = ["".join(rng.choice("aabbccddeeff   xé▁") for _ in range(rng.randrange(0, 18))) for _ in range(800)]
    machine.compose({s for t in texts for s in machine.stretches(t)})
    for t in texts:
        got, want = machine.encode(t), library.encode(t)
        if kind == pieces.BPE:
            assert got == want, t
        else:
            weight = lambda ids: sum(machine.fallback if machine.kinds[i] == pieces.UNKNOWN else machine.weights[i] for i in ids)
            assert got == want or weight(got) == pytest.approx(weight(want), abs=1e-4), t
        assert machine.returns(t, machine.stretches(t)) == (machine.decode(got) == t), t


def test_machines_by_hand():
    n = pieces.Normaliser({3: 1, 4: 1, 5: 1})
    assert n.compose("  a  b ") == "▁a▁b" and n.compose(" b", pieces.BODY) == "▁b" and n.compose("   ") == ""
    assert pieces.Normaliser({3: 1, 4: 0, 5: 1}).compose("a  b") == "▁a▁▁b"
    lexicon = pieces.Lexicon({"ab": 5, "b": 6, "cb": 7})
    arcs, piece = lexicon.root[0]["b"]
    assert piece == 6 and arcs["a"][1] == 5 and arcs["c"][1] == 7 and lexicon.states == 4
    bad = b"".join(field(1, field(1, p.encode()) + field(2, s) + field(3, t)) for p, s, t in [("<unk>", 0.0, 2), ("a", -9.0, 1), ("aa", -5.0, 1), ("aaa", -1.0, 1)])
    with pytest.raises(ValueError, match="before its parts"):
        pieces.Transducer(bad + field(2, field(3, pieces.BPE)) + field(3, field(5, 1)))
    with pytest.raises(ValueError, match="character map"):
        pieces.Transducer(bad + field(3, field(2, b"x")))


def test_evidence_finds_what_marks_toxic_texts():
    seen = np.array([20, 3, 1, 0, 0]), np.array([0, 20, 2, 90, 0])
    z = toxicity.evidence(*(x.astype(float) for x in seen), 30, 200)
    assert z[0] > 5 and z[3] < -2.5 and z[1] == z[2] == z[4] == 0


def test_few_toxic_rows_are_enough(spark):
    """Thirty toxic rows whose word occurs in no other row, in texts that share nothing else."""
    rng = random.Random(4)
    make = lambda i: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(rng.choice([30, 90])))
    texts = [make(i) for i in range(300)]
    labels = [int(i % 10 == 0) for i in range(300)]
    texts = [t + " qwzrk" if y else t for t, y in zip(texts, labels, strict=True)]
    net = toxicity.train(texts, labels)
    fresh = [make(i) for i in range(60)]
    scores = toxicity.score_texts(net, [*fresh, *(t + " qwzrk" for t in fresh)])
    assert (scores[:60] < 0.7).mean() > 0.95 and (scores[60:] >= 0.7).mean() > 0.95
