"""Quality classifier: random-indexing word vectors, pooled, under a small two-layer network.

Every word (a run of letters and digits, or a run of marks) has a
fixed sparse random index vector, found from its hash. Its context vector is
the sum of the index vectors of its neighbours over the whole corpus. A
document is the mean and the spread of its words' context vectors and how much
neighbouring words agree. A two-layer numpy network turns that into a logit,
and one temperature, fitted on rows the network has not learned from, turns the
logit into a probability.

Words share ``BUCKETS`` context vectors by hash, so the model's size does not
depend on the corpus. The network learns from ``TRAIN_ROWS`` labelled documents
at most, chosen by a hash of the id; the context vectors come from all rows.

Rows: null and empty texts have no words and get the score of a zero vector;
repeated rows are scored each by itself; other columns are ignored; an empty
table gives an empty result; without labels of both kinds every score is the
share of label 1 (0.5 without labels).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tasador.llm.splits import bounded_sample, held_out
from tasador.llm.words import token_hashes

BUCKETS = 8192
WIDTH = 64
NONZERO = 4
HIDDEN = 32
TRAIN_ROWS = 20_000
ACCEPT = 0.3
FEATURES = 2 * WIDTH + 3
BATCH_TOKENS = 400_000

_seeds = np.random.default_rng(7)
_PLACES = _seeds.integers(0, WIDTH, (BUCKETS, NONZERO))
_SIGNS = _seeds.choice(np.array([-1.0, 1.0], np.float32), (BUCKETS, NONZERO))


def word_buckets(text: str | None) -> np.ndarray:
    """The bucket of every word of a text, in order."""
    return (token_hashes(text) % np.uint64(BUCKETS)).astype(np.int64) if text else np.empty(0, np.int64)


def _neighbour_sums(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sums of the index vectors of ``right`` by ``left``, flat."""
    sums = np.zeros(BUCKETS * WIDTH)
    for k in range(NONZERO):
        sums += np.bincount(left * WIDTH + _PLACES[right, k], _SIGNS[right, k], BUCKETS * WIDTH)
    return sums


def context_vectors(texts: DataFrame) -> np.ndarray:
    """Unit context vectors of all buckets, from every row of ``texts`` (column ``_text``).

    Each task adds up its own rows; the sums of all tasks are added per bucket.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums, held, waiting = np.zeros(BUCKETS * WIDTH), [], 0

        def flush() -> None:
            nonlocal waiting
            if held:
                left = np.concatenate([w[:-1] for w in held])
                right = np.concatenate([w[1:] for w in held])
                sums[:] += _neighbour_sums(left, right) + _neighbour_sums(right, left)
                held.clear()
                waiting = 0

        for batch in batches:
            for text in batch["_text"]:
                words = word_buckets(text)
                for at in range(0, len(words) - 1, BATCH_TOKENS):
                    held.append(words[at : at + BATCH_TOKENS + 1])
                    waiting += len(held[-1])
                    if waiting >= BATCH_TOKENS:
                        flush()
        flush()
        table = sums.reshape(BUCKETS, WIDTH)
        used = np.flatnonzero(table.any(axis=1))
        if len(used):
            columns = {f"v{i}": table[used, i] for i in range(WIDTH)}
            yield pd.DataFrame({"bucket": used.astype(np.int32), **columns})

    fields = ", ".join(f"v{i} double" for i in range(WIDTH))
    summed = (
        texts.select("_text")
        .mapInPandas(run, f"bucket int, {fields}")
        .groupBy("bucket")
        .agg(*[F.sum(f"v{i}").alias(f"v{i}") for i in range(WIDTH)])
        .toPandas()  # at most BUCKETS rows
    )
    table = np.zeros((BUCKETS, WIDTH))
    table[summed["bucket"].to_numpy(int)] = summed[[f"v{i}" for i in range(WIDTH)]].to_numpy()
    return (table / np.maximum(np.linalg.norm(table, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def pooled(text: str | None, vectors: np.ndarray) -> np.ndarray:
    """Mean and spread of the words' vectors, length, variety and agreement of neighbours."""
    words = word_buckets(text)
    out = np.zeros(FEATURES, np.float32)
    if not len(words):
        return out
    distinct, counts = np.unique(words, return_counts=True)
    weights = (counts / len(words)).astype(np.float32)
    rows = vectors[distinct]
    mean = weights @ rows
    out[:WIDTH] = mean
    out[WIDTH : 2 * WIDTH] = np.sqrt(np.maximum(weights @ rows**2 - mean**2, 0))
    out[-3] = np.log1p(len(words)) / 8
    out[-2] = len(distinct) / len(words) ** 0.8
    if len(words) > 1:
        out[-1] = np.mean(words[1:] == words[:-1])
    return out


def _pool_all(texts: pd.Series, vectors: np.ndarray) -> np.ndarray:
    return np.stack([pooled(t, vectors) for t in texts]) if len(texts) else np.zeros((0, FEATURES), np.float32)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Network:
    """Two layers over scaled features; ``temperature`` divides the logit."""

    mean: np.ndarray
    scale: np.ndarray
    weights: list[np.ndarray]
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.weights
        return np.tanh((x - self.mean) / self.scale @ w1 + b1) @ w2 + b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.logits(x) / self.temperature)


def fit_network(x: np.ndarray, y: np.ndarray, epochs: int = 40, batch: int = 128, seed: int = 3) -> Network:
    """Adam on the cross entropy of four fifths of the rows; the temperature from the rest."""
    rng = np.random.default_rng(seed)
    if len(set(y.tolist())) < 2:
        share = float(np.clip(y.mean(), 1e-6, 1 - 1e-6)) if len(y) else 0.5
        zero = [np.zeros((FEATURES, 1)), np.zeros(1), np.zeros(1), np.log(share / (1 - share))]
        return Network(np.zeros(FEATURES), np.ones(FEATURES), zero)
    order = rng.permutation(len(y))
    rest, learn = order[: len(y) // 5], order[len(y) // 5 :]
    mean, scale = x[learn].mean(0), x[learn].std(0) + 1e-3
    z, t = (x[learn] - mean) / scale, y[learn].astype(float)
    weights = [rng.normal(0, FEATURES**-0.5, (FEATURES, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(())]
    first, second, step = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
    for _ in range(epochs):
        for at in np.array_split(rng.permutation(len(t)), max(1, len(t) // batch)):
            hidden = np.tanh(z[at] @ weights[0] + weights[1])
            error = (_sigmoid(hidden @ weights[2] + weights[3]) - t[at]) / len(at)
            back = np.outer(error, weights[2]) * (1 - hidden**2)
            slopes = [z[at].T @ back + 1e-4 * weights[0], back.sum(0), hidden.T @ error, error.sum()]
            step += 1
            for i, g in enumerate(slopes):
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.999 * second[i] + 0.001 * g**2
                weights[i] = weights[i] - 3e-3 * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    net = Network(mean, scale, weights)
    if len(rest):
        logits, truth = net.logits(x[rest]), y[rest]
        grid = np.exp(np.linspace(np.log(0.5), np.log(16), 60))
        loss = [np.mean(np.logaddexp(0, np.where(truth == 1, -logits, logits) / g)) for g in grid]
        net.temperature = float(grid[int(np.argmin(loss))])
    return net


def train(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> tuple[np.ndarray, Network]:
    """Context vectors of all documents and the network learned from labelled, not held-out ones."""
    texts = docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").alias("_text"))
    vectors = context_vectors(texts)
    marks = (
        labels.where(F.col("quality").isNotNull() & ~held_out("doc_id"))
        .groupBy(F.col("doc_id").cast("long").alias("_id"))
        .agg(F.max("quality").cast("int").alias("_label"))
    )
    marks = bounded_sample(marks, "_id", train_rows)
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = _pool_all(batch["_text"], shared.value)
            yield pd.DataFrame({"_id": batch["_id"], "_label": batch["_label"], "x": list(x)})

    # broadcast: train_rows bounds it; a text repeated under one id counts once
    rows = (
        texts.join(F.broadcast(marks), "_id")
        .mapInPandas(run, "_id long, _label int, x array<float>")
        .dropDuplicates(["_id"])
        .toPandas()
        .sort_values("_id")
    )
    x = np.stack(rows["x"].to_list()).astype(np.float64) if len(rows) else np.zeros((0, FEATURES))
    return vectors, fit_network(x, rows["_label"].to_numpy(int))


def score_column(docs: DataFrame, vectors: np.ndarray, net: Network, text_col: str = "text"):
    """A column with the probability of label 1 for each text."""
    shared = docs.sparkSession.sparkContext.broadcast((vectors, net))

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        table, network = shared.value
        return pd.Series(network.score(_pool_all(texts, table).astype(np.float64)), dtype=float)

    return score(F.col(text_col))


def score_documents(docs: DataFrame, labels: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    vectors, net = train(docs, labels)
    scored = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        held_out("doc_id").alias("held_out"),
        score_column(docs, vectors, net).alias("score"),
    )
    return scored.withColumn("predicted", (F.col("score") >= accept).cast("int"))


def accepted(docs: DataFrame, labels: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """The documents, all columns, whose score reaches ``accept``."""
    vectors, net = train(docs, labels)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    packed = docs.select(row.alias("_row"), score_column(docs, vectors, net).alias("_score"))
    return packed.where(F.col("_score") >= accept).select("_row.*")
