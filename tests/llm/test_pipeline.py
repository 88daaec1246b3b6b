"""The stages' decisions take effect, each on all that its predecessor kept."""

import collections
import hashlib
import itertools

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from plinth.llm import jaccard, mixing, naming, pieces, queries, toxicity


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    at, out = tmp_path_factory.mktemp("stages"), []
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, f) in enumerate(corpus_pipeline.STAGES):
        f(spark, docs, sf_dir).write.parquet(f"{at}/{i}")
        out.append((docs, docs := spark.read.parquet(f"{at}/{i}")))
    return out


def test_columns(stages):
    assert all(a.columns == b.columns and a.dtypes == b.dtypes for a, b in stages[:-1])


def ids(df):
    return sorted(r["doc_id"] for r in df.select("doc_id").collect())


def test_decisions(spark, sf_dir, stages):
    (a, b), (_, c), (_, d), (_, e), (_, f) = stages
    net = toxicity.fit(a, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    assert ids(b) == ids(toxicity.score_documents(a, net).where("predicted = 0"))
    assert ids(c) == ids(naming.exact_duplicates(b).where("kept"))
    assert ids(d) == ids(jaccard.join_groups(c, shingle=5, num=80).where("doc_id = component_id"))
    taken = {r["doc_id"]: r["copies"] for r in mixing.mix(d).collect()}
    assert ids(e) == sorted(k for k, n in taken.items() for _ in range(n))
    assert ids(f) == ids(e) and f.where("not round_trip").count() == 0


def test_op10_returns_the_ids(spark, sf_dir):
    encoded = queries.op10_sentencepiece(spark, sf_dir)
    assert encoded.where("ids IS NULL OR size(ids) <> n_pieces").count() == 0
    back = {r["doc_id"]: r["text"] for r in pieces.decode(encoded, queries.PIECE_MODEL).collect()}
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert back.keys() == texts.keys() and all(back[r["doc_id"]] == texts[r["doc_id"]] for r in encoded.where("round_trip").collect())


def near(a, b):
    x, y = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (a.split(), b.split()))
    return bool(x and y) and len(x & y) >= 0.8 * len(x | y)


def last_of_each(rows):
    """Of rows (id, text) those that exact dedup keeps: by dicts."""
    best = {}
    for k, t in rows:
        if (t or "") not in best or best[t or ""] is None or k is not None and k > best[t or ""]:
            best[t or ""] = k
    return {(k, t) for t, k in best.items()}


def first_of_each(rows):
    """Of rows (id, text) those that near dedup keeps: by all pairs."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, hashlib.sha256(r[1].encode()).hexdigest()))
    up = list(range(len(rows)))
    for i, j in itertools.combinations(range(len(rows)), 2):
        if near(rows[i][1], rows[j][1]):
            a, b = sorted((up[i], up[j]))
            up = [a if x == b else x for x in up]
    return {r for i, r in enumerate(rows) if up[i] == i}


def written(start, change=None):
    w = [f"w{start + i}" for i in range(40)]
    return " ".join(w if change is None else [*w[:change], f"x{change}", *w[change + 1 :]])


PLAIN = [(i, written(100 * (i % 12), None if i % 3 else 39)) for i in range(36)] + [(90, "short text"), (91, "short text"), (92, ""), (93, None), (94, "short text too")]
#: An id with clean texts, a copy and near copies; near copies under one id; equal texts under ids that repeat; no ids.
ODD = [(1, written(0)), (1, written(500)), (0, written(0, 39)), (5, written(900)), (5, written(900, 0)), (5, written(900)), (7, "one text"), (6, "one text"), (6, "two texts"), (8, "two texts"), (None, "one text"), (None, written(500, 39)), (None, written(1500)), (None, written(1500, 39)), (None, "alone"), (None, "alone"), (None, ""), (3, None)]


@pytest.mark.parametrize("rows", [PLAIN, ODD, PLAIN + ODD], ids=["plain", "odd", "both"])
def test_dedup_stages_against_brute_force(spark, sf_dir, tmp_path, rows):
    docs = spark.createDataFrame([(k, t, "s") for k, t in rows], "doc_id long, text string, source string").repartition(3)
    docs.write.parquet(f"{tmp_path}/in")
    kept = corpus_pipeline.drop_copies(spark, spark.read.parquet(f"{tmp_path}/in"), sf_dir)
    kept.write.parquet(f"{tmp_path}/kept")
    kept = spark.read.parquet(f"{tmp_path}/kept")
    want = last_of_each(rows)
    got = [(r["doc_id"], r["text"] or "") for r in kept.collect()]
    assert kept.columns == docs.columns and len(got) == len(want) and set(got) == want
    got = [(r["doc_id"], r["text"] or "") for r in corpus_pipeline.drop_near_copies(spark, kept, sf_dir).collect()]
    want = first_of_each(want)
    assert len(got) == len(want) and set(got) == want


def test_mixing_and_encoding_stages_against_independent_versions(spark, sf_dir, tmp_path):
    sentencepiece = pytest.importorskip("sentencepiece")
    rows = [(i, written(50 * i), "a" if i % 3 else "b") for i in range(24)] + [(60 + i, "one two three", "c") for i in range(10)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3).write.parquet(f"{tmp_path}/in")
    corpus_pipeline.mix_sources(spark, spark.read.parquet(f"{tmp_path}/in"), sf_dir).write.parquet(f"{tmp_path}/mixed")
    mixed = spark.read.parquet(f"{tmp_path}/mixed")
    got = collections.Counter((r["doc_id"], r["text"], r["source"]) for r in mixed.collect())
    assert set(got) <= set(rows) and max(got.values()) <= 2
    sizes = {s: sum(len(t.split()) for _, t, x in rows if x == s) for s in "abc"}
    words = {s: sum(n * len(t.split()) for (_, t, x), n in got.items() if x == s) for s in "abc"}
    # weights 3, 1, 2 of 1.5 x all words; c is full at twice its size, and a and b share the rest 3 to 1
    rest = 1.5 * sum(sizes.values()) - 2 * sizes["c"]
    want = {"a": rest * 3 / 4, "b": rest / 4, "c": 2 * sizes["c"]}
    assert want["a"] <= 2 * sizes["a"] and want["b"] <= 2 * sizes["b"]
    assert all(0 <= round(want[s]) - words[s] < 40 for s in want)
    library = sentencepiece.SentencePieceProcessor(model_file=queries.PIECE_MODEL)
    encoded = collections.Counter((r["doc_id"], tuple(r["ids"])) for r in corpus_pipeline.encode(spark, mixed, sf_dir).collect())
    assert encoded == collections.Counter({(k, tuple(library.encode(t))): n for (k, t, _), n in got.items()})


def test_toxicity_stage_drops_by_each_score(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    net = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows = docs.select("doc_id", "text").collect()
    want = sorted(r["doc_id"] for r in rows if toxicity.score_texts(net, [r["text"]])[0] < toxicity.THRESHOLD)
    assert ids(corpus_pipeline.drop_toxic(spark, docs, sf_dir)) == want


CLASHING = ["key", "n", "row", "_row", "_digest", "_dropped0", "level", "name", "_key", "_size", "_place", "_pattern", "_copies", "_nth", "fp", "node", "sig", "score", "predicted", "kept", "row_id", "_part", "_local", "_id", "size", "target", "_p", "rest"]


@pytest.mark.parametrize("rows", [[], ODD, [(1, None), (1, None), (None, None)], [(None, "one"), (None, "one"), (2, ""), (3, "one")]], ids=["empty", "odd", "no text", "ties"])
def test_every_stage_on_odd_tables(spark, sf_dir, tmp_path, rows):
    """Empty tables, nulls in every column, ties, repeated rows and extra columns with the names that operators use."""
    docs = spark.createDataFrame([(k, t, None if i % 3 else "s", None) for i, (k, t) in enumerate(rows)], "doc_id long, text string, source string, lang string")
    docs = docs.withColumns({c: F.lit(f"own {c}") for c in CLASHING})
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{tmp_path}/{i}")
        out = spark.read.parquet(f"{tmp_path}/{i}")
        if name == "encoding":
            assert collections.Counter(r["doc_id"] for r in out.collect()) == collections.Counter(r["doc_id"] for r in docs.collect())
            break
        assert out.columns == docs.columns
        assert out.where(" OR ".join(f"`{c}` <> 'own {c}'" for c in CLASHING)).count() == 0
        if name == "toxicity":
            assert out.count() == len(rows)
        docs = out
    assert docs.select("text").na.fill("").distinct().count() <= len({t or "" for _, t in rows})


def test_whole_pipeline_against_the_stages_by_hand(spark, tmp_path):
    """run() on a corpus whose decisions can be told beforehand: what is toxic, equal or near goes; all else is encoded as often as the mixture takes it."""
    import random

    sentencepiece = pytest.importorskip("sentencepiece")
    rng = random.Random(6)
    plain = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    texts = {i: plain(40) for i in range(400)}
    labels = [(i, int(i % 8 == 0)) for i in range(400)]
    for i, y in labels:
        if y:
            texts[i] += " qwzrk qwzrks"
    rows = [*texts.items(), (500, texts[1]), (501, texts[3]), (502, texts[5] + " more"), (503, None), (504, "")]
    spark.createDataFrame([(k, t, "ab"[k % 2]) for k, t in rows], "doc_id long, text string, source string").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = collections.Counter((r["doc_id"], tuple(r["ids"] or [])) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    want = {k: t or "" for k, t in rows if "qwzrk" not in (t or "")}
    want = {k: want[k] for k in {t: k for k, t in sorted(want.items())}.values()}  # the largest id of equal texts
    want = {k: t for k, t in want.items() if k != 502}  # near 5, whose id is smaller
    library = sentencepiece.SentencePieceProcessor(model_file=queries.PIECE_MODEL)
    # the two sources weigh 3 and 1 and stop at twice their size
    sizes = {s: sum(len(t.split()) for k, t in want.items() if "ab"[k % 2] == s) for s in "ab"}
    goal = mixing.targets(sizes)
    assert set(got) <= {(k, tuple(library.encode(t))) for k, t in want.items()} and max(got.values()) <= 2
    for s in "ab":
        assert 0 <= goal[s] - sum(n * len(want[k].split()) for (k, _), n in got.items() if "ab"[k % 2] == s) <= 41


def test_mixing_takes_no_python_rows(spark, stages, monkeypatch):
    """A list sent as an RDD takes workers of another kind, which stay in memory beside those of the encoding."""
    want = sorted(map(repr, stages[3][1].select("doc_id").collect()))
    monkeypatch.setattr(type(spark.sparkContext), "parallelize", None)
    assert sorted(map(repr, mixing.copies(stages[3][0]).select("doc_id").collect())) == want


def test_encoding_remembers_within_its_bounds(spark, stages):
    """Workers stay within the stage's bounds, and ids don't depend on them."""
    bounds = corpus_pipeline.ENCODING
    assert bounds["memory"] <= 60_000 and bounds["arcs"] <= 120_000
    with open(queries.PIECE_MODEL, "rb") as f:
        model = f.read()
    small, whole = pieces.Transducer(model, 50, 20), pieces.Transducer(model)
    for text in [r["text"] for r in stages[4][0].select("text").limit(60).collect()]:
        assert small.encode(text or "") == whole.encode(text or "")
        assert len(small._memory) < 50 and len(small._apart) <= 20
    plain = pieces.encode(stages[4][0], queries.PIECE_MODEL)
    tight = pieces.encode(stages[4][0], queries.PIECE_MODEL, memory=50, arcs=20, most=3000)
    assert sorted(map(repr, tight.collect())) == sorted(map(repr, plain.collect()))
