"""Toxicity: a bidirectional gated recurrent network scores all overlapping windows of every text.

Training runs on the driver in numpy, on labelled rows whose
crc32(doc_id as text) mod 3 is not 1, at most MOST_POSITIVE toxic and
MOST_NEGATIVE other ones (those of smallest hash; all other steps cover all
rows). A label holds for a whole text, of which one passage may be the reason,
so windows are chosen by the network itself as it learns: of a toxic text the
highest-scored window trains as toxic, of another text the highest-scored and
a random one as clean. Labels, language, source and id are no inputs.

With few toxic rows a network learns those rows by heart. So its embeddings
begin with the evidence of the training rows: the first dimension of a word or
character n-gram is the signed root of the likelihood ratio of its presence in
toxic and other texts, where that exceeds what chance gives the strongest of
all of them. The random part of the embeddings is smaller the more that counts,
and the evidence fades as FEW / toxic rows, squared, so that with many rows the
network learns freely.

A text's score is that of its highest window. Null texts and texts without
words score 0; without labels of both kinds every score is 0. Rows are scored
one by one. Other columns are not carried. Null keys count as not held out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from plinth.llm.batches import bounded, through
from plinth.llm.gru import NGRAM_ROWS, WORD_ROWS, Adam, Network, Spelling, sigmoid, words_of

WIDTH, STRIDE = 48, 32
MOST_POSITIVE, MOST_NEGATIVE = 1200, 2400
EPOCHS, BATCH, THRESHOLD = 14, 64, 0.7
#: Few labelled rows are passed over more often, up to so many texts in all.
LEAST_SEEN = 24_000
WINDOWS = 2048
#: Toxic rows at which evidence and random start weigh alike.
FEW = 100


def window_starts(n: int) -> list[int]:
    """Overlapping windows that cover n words; the last one ends with the text."""
    if n <= WIDTH:
        return [0]
    return [*range(0, n - WIDTH, STRIDE), n - WIDTH]


def held_out(key) -> F.Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def windows_of(numbered: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(W, WIDTH) word numbers plus 1 (0: padding), the length of each, and the text each belongs to. Texts without words have none."""
    rows, owners = [], []
    for i, x in enumerate(numbered):
        if len(x):
            padded = x if len(x) >= WIDTH else np.concatenate([x, np.full(WIDTH - len(x), -1, x.dtype)])
            at = np.array(window_starts(len(x)))
            rows.append(padded[at[:, None] + np.arange(WIDTH)])
            owners += [i] * len(at)
    w = np.concatenate(rows) + 1 if rows else np.zeros((0, WIDTH), np.int64)
    return w, (w > 0).sum(1), np.array(owners, np.int64)


def number(texts: list) -> tuple[list[bytes], list[np.ndarray]]:
    ids: dict[bytes, int] = {}
    out = [np.fromiter([ids.setdefault(w, len(ids)) for w in words_of(t)], np.int64) for t in texts]
    return list(ids), out


def score_windows(network: Network, gates: np.ndarray, windows: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Probability of each window; those of like length run together."""
    out = np.zeros(len(windows), np.float32)
    order = np.argsort(lengths, kind="stable")
    for at in range(0, len(order), WINDOWS):
        part = order[at : at + WINDOWS]
        ids = np.ascontiguousarray(windows[part, : lengths[part[-1]]].T)
        out[part] = sigmoid(network.run(gates[ids], (ids > 0).astype(np.float32)))
    return out


def score_texts(network: Network, texts: list) -> np.ndarray:
    words, numbered = number(texts)
    windows, lengths, owners = windows_of(numbered)
    out = np.zeros(len(texts), np.float64)
    if len(windows):
        np.maximum.at(out, owners, score_windows(network, network.gates(words), windows, lengths))
    return out


def evidence(toxic: np.ndarray, other: np.ndarray, n_toxic: int, n_other: int) -> np.ndarray:
    """For each row of an embedding the signed root of its likelihood ratio, from the texts of both kinds that have it; 0 under the level that the strongest of as many rows reaches by chance."""
    n = toxic + other
    expected = n * n_toxic / (n_toxic + n_other)
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = 2 * (np.where(toxic > 0, toxic * np.log(toxic / expected), 0) + np.where(other > 0, other * np.log(other / (n - expected)), 0))
    z = np.sqrt(np.maximum(np.nan_to_num(ratio), 0)) * np.sign(toxic - expected)
    level = np.sqrt(2 * np.log(max(2, np.count_nonzero(n))))
    return np.where(np.abs(z) >= level, z, 0)


def informed(network: Network, spelling: Spelling, numbered: list[np.ndarray], labels: list[int]) -> None:
    """Starts the embeddings from the evidence of the training texts."""
    seen = {"words": np.zeros((2, WORD_ROWS)), "ngrams": np.zeros((2, NGRAM_ROWS))}
    for x, y in zip(numbered, labels, strict=True):
        distinct = np.unique(x)
        if len(distinct):
            seen["words"][y, np.unique(spelling.rows[distinct])] += 1
            seen["ngrams"][y, np.unique(spelling.part(distinct)[0])] += 1
    n = np.bincount(labels, minlength=2)
    weight = 1 / (1 + (n[1] / FEW) ** 2)
    for name, (other, toxic) in seen.items():
        network.p[name] *= np.float32(1 - 0.7 * weight)
        network.p[name][:, 0] += (weight / 4 * evidence(toxic, other, n[1], n[0])).astype(np.float32)


def train(texts: list[str], labels: list[int], epochs: int = EPOCHS, seed: int = 1) -> Network | None:
    """None unless there are texts of both labels."""
    if len(set(labels)) < 2:
        return None
    epochs = max(epochs, min(6 * epochs, LEAST_SEEN // len(labels)))
    rng, network = np.random.default_rng(seed), Network(seed)
    words, numbered = number(texts)
    windows, lengths, owners = windows_of(numbered)
    spelling, y = Spelling(words), np.array(labels, np.float32)[owners]
    informed(network, spelling, numbered, labels)
    per = np.bincount(owners, minlength=len(texts))
    bounds = np.concatenate([[0], np.cumsum(per)])
    adam = Adam(network)
    clean = np.flatnonzero((np.array(labels) == 0) & (per > 0))
    toxic = np.flatnonzero((np.array(labels) == 1) & (per > 0))
    short = toxic[per[toxic] <= 3] if (per[toxic] <= 3).sum() >= 20 else toxic
    for epoch in range(epochs):
        anyone = bounds[clean] + (rng.random(len(clean)) * per[clean]).astype(np.int64)
        if epoch < epochs // 5:  # short texts first: each of their windows is likely to be the reason
            picked = np.concatenate([*(np.arange(bounds[i], bounds[i + 1]) for i in short), anyone])
        else:
            scores = score_windows(network, network.gates(words), windows, lengths)
            top = lambda of: np.array([bounds[i] + scores[bounds[i] : bounds[i + 1]].argmax() for i in of], np.int64)
            picked = np.concatenate([top(toxic), top(clean), anyone])
        adam.rate = 0.01 if epoch < epochs * 2 // 3 else 0.003
        rng.shuffle(picked)
        for at in range(0, len(picked), BATCH):
            part = picked[at : at + BATCH]
            part = part[np.argsort(lengths[part], kind="stable")]
            ids = windows[part, : lengths[part].max()].T
            _, grads = network.gradients(spelling, np.maximum(ids - 1, 0), (ids > 0).astype(np.float32), y[part])
            adam.step(grads)
    return network


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Network | None:
    """The network of the labelled rows that are not held out."""
    known = labels.select(F.col(f"`{key}`").alias("key"), F.col(f"`{label}`").alias("y")).where(~held_out(F.col("key")) & F.col("y").isin(0, 1) & F.col("key").isNotNull())
    known = known.groupBy("key").agg(F.max("y").alias("y"))
    some = [known.where(F.col("y") == v).orderBy(F.xxhash64("key"), "key").limit(n) for v, n in ((1, MOST_POSITIVE), (0, MOST_NEGATIVE))]
    chosen = some[0].unionByName(some[1])  # at most MOST_POSITIVE + MOST_NEGATIVE rows
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")).join(F.broadcast(chosen), "key")
    rows = rows.groupBy("key", "y").agg(F.min("text").alias("text"))  # one text of each key, however often it repeats
    found = sorted({(r["key"], r["y"], r["text"]) for r in rows.collect() if r["text"]})
    return train([t for _, _, t in found], [y for _, y, _ in found])


def score_documents(docs: DataFrame, network: Network | None, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """key, held_out, score, predicted of every row."""
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    parameters = network.p if network else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = None
        if parameters:
            net = Network.__new__(Network)
            net.p = parameters
        for part in bounded(batches, 1):
            scores = score_texts(net, part.column("text").to_pylist()) if net else np.zeros(part.num_rows)
            yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(scores)], names=["key", "score"])

    kind = dict(rows.dtypes)["key"]
    scored = through(rows, run, f"key {kind}, score double")
    return scored.select(F.col("key").alias(key), held_out(F.col("key")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def clean_documents(docs: DataFrame, network: Network | None, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows below the threshold, with all their columns, in one pass and without a join."""
    at = docs.columns.index(text)
    parameters = network.p if network else None
    if parameters is None:
        return docs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Network.__new__(Network)
        net.p = parameters
        for part in bounded(batches, at):
            yield part.filter(pa.array(score_texts(net, part.column(at).to_pylist()) < threshold))

    return through(docs, run, docs.schema)
