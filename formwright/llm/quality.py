"""A byte-level convolutional network for document quality, trained and applied in numpy.

Learned filters look at `WIDTH` consecutive bytes. A document is read whole, in overlapping chunks; a chunk's
feature is each filter's greatest response in it. The document's features are the mean and the greatest of
its chunks', and a logistic unit combines them into one probability.

A filter's response is a sum of table entries, one for each byte of its window, so the first layer is a
lookup. As pooling passes on one position a chunk and filter, training updates only the entries it used.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formwright.llm.common import give_back, labelled_sample, map_rows, text_bytes

FILTERS = 16
WIDTH = 5
CHUNK = 512
#: Bytes a chunk shares with the next.
OVERLAP = 64
#: The network is fitted on so many labelled rows at most, the first by hash of their id ...
TRAIN_ROWS = 8000
#: ... and on so many chunks of each, evenly over the whole text.
TRAIN_CHUNKS = 4
EPOCHS = 8
#: Bytes of a text at a time.
BLOCK_CHUNKS = 64
THRESHOLD = 0.7


@dataclass
class Network:
    table: np.ndarray  # (WIDTH, 256, FILTERS)
    bias: np.ndarray  # (FILTERS,)
    weights: np.ndarray  # (2 * FILTERS,)
    offset: float

    def responses(self, data: np.ndarray) -> np.ndarray:
        """(n - WIDTH + 1, FILTERS) for the bytes given."""
        n = len(data) - WIDTH + 1
        out = self.table[0].take(data[:n], axis=0)
        for j in range(1, WIDTH):
            out += self.table[j].take(data[j : n + j], axis=0)
        return out

    def features(self, text: bytes) -> np.ndarray:
        """The mean and the greatest of all chunks' features; a text without bytes has zeros."""
        if not text:
            return np.zeros(2 * FILTERS, np.float64)
        data = np.frombuffer(text.ljust(WIDTH, b"\0"), np.uint8)
        total, top, count = np.zeros(FILTERS), np.zeros(FILTERS), 0
        starts = chunk_starts(len(data))
        for i in range(0, len(starts), BLOCK_CHUNKS):
            part = starts[i : i + BLOCK_CHUNKS]
            first, end = part[0], min(part[-1] + CHUNK, len(data))
            out = self.responses(data[first:end])
            ends = np.minimum(part + CHUNK - WIDTH + 1, len(data) - WIDTH + 1) - first
            pooled = chunk_max(out, part - first, ends)
            pooled = np.maximum(pooled + self.bias, 0)
            total += pooled.sum(0)
            top = np.maximum(top, pooled.max(0))
            count += len(part)
        return np.concatenate([total / count, top])

    def score(self, text: bytes) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.features(text) @ self.weights + self.offset, -30, 30))))


def chunk_starts(n: int) -> np.ndarray:
    """Where the chunks of `n` bytes begin: every byte is in one, each shares `OVERLAP` bytes with the next."""
    step = CHUNK - OVERLAP
    return np.arange(0, max(n - OVERLAP, 1), step)


def chunk_max(out: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    # Between the chunks' ends and the next starts reduceat yields rows of no use.
    ends = np.minimum(ends, len(out))
    bounds = np.stack([starts, ends], axis=1).ravel()
    if bounds[-1] >= len(out):
        bounds = bounds[:-1]
    return np.maximum.reduceat(out, bounds, axis=0)[::2]


def fit(samples: list[tuple[list[bytes], int]], epochs: int = EPOCHS, seed: int = 7) -> Network:
    """Trains on (chunks, label) by Adam on the log loss; the classes weigh alike in the gradient's scale.

    Without samples of both classes the network answers with their share (0.5 if there are none).
    """
    rng = np.random.default_rng(seed)
    embed = rng.normal(0, 1, (256, 8)).astype(np.float32)
    # Bytes of a kind start alike: letters, capitals, digits, signs, the upper half.
    kind = np.zeros(256, int)
    for number, low, high in ((1, 97, 122), (2, 65, 90), (3, 48, 57), (4, 128, 255), (5, 32, 32)):
        kind[low : high + 1] = number
    embed += 2 * rng.normal(0, 1, (6, 8)).astype(np.float32)[kind]
    table = np.einsum("be,wef->wbf", embed, rng.normal(0, 0.12, (WIDTH, 8, FILTERS))).astype(np.float32)
    params = {"table": table, "bias": np.zeros(FILTERS), "weights": rng.normal(0, 0.1, 2 * FILTERS)}
    labels = np.array([label for _, label in samples], float)
    share = labels.mean() if len(labels) else 0.5
    prior = np.log((share + 1e-3) / (1 - share + 1e-3))
    params["offset"] = np.array([prior])
    net = Network(params["table"], params["bias"], params["weights"], float(prior))
    if not len(labels) or not 0 < share < 1:
        net.weights[:] = 0
        return net
    moments = {k: (np.zeros_like(v, float), np.zeros_like(v, float)) for k, v in params.items()}
    step, size = 0, 32
    steps = epochs * -(-len(samples) // size)
    for _ in range(epochs):
        order = rng.permutation(len(samples))
        for i in range(0, len(order), size):
            picked = order[i : i + size]
            grads = _gradient(net, [samples[k] for k in picked])
            step += 1
            rate = 0.01 * (1 - 0.9 * step / steps)
            for name, grad in grads.items():
                first, second = moments[name]
                first += 0.1 * (grad - first)
                second += 0.01 * (grad * grad - second)
                update = rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-6)
                params[name] -= update.astype(params[name].dtype)
            net.offset = float(params["offset"][0])
    return net


def _gradient(net: Network, batch: list[tuple[list[bytes], int]]) -> dict[str, np.ndarray]:
    chunks = [np.frombuffer(c.ljust(WIDTH, b"\0"), np.uint8) for cs, _ in batch for c in cs]
    owner = np.repeat(np.arange(len(batch)), [len(cs) for cs, _ in batch])
    counts = np.bincount(owner, minlength=len(batch))
    starts = np.cumsum([0, *map(len, chunks)])
    flat = np.concatenate(chunks)
    out = net.responses(flat)
    at = np.stack([out[s : s + len(c) - WIDTH + 1].argmax(0) + s for s, c in zip(starts, chunks)])
    pooled = np.maximum(np.take_along_axis(out, at, 0) + net.bias, 0)
    mean, top = np.zeros((len(batch), FILTERS)), np.zeros((len(batch), FILTERS))
    np.add.at(mean, owner, pooled)
    mean /= np.maximum(counts, 1)[:, None]
    np.maximum.at(top, owner, pooled)
    features = np.concatenate([mean, top], axis=1)
    truth = np.array([label for _, label in batch], float)
    guess = 1 / (1 + np.exp(-np.clip(features @ net.weights + net.offset, -30, 30)))
    error = (guess - truth) / len(batch)
    back = error[:, None] * net.weights[None, :]
    grad = back[owner, :FILTERS] / counts[owner][:, None] + back[owner, FILTERS:] * (pooled == top[owner])
    grad *= pooled > 0
    table = np.zeros(net.table.shape)
    columns = np.broadcast_to(np.arange(FILTERS), at.shape)
    for j in range(WIDTH):
        np.add.at(table[j], (flat[at + j], columns), grad)
    return {
        "table": table,
        "bias": grad.sum(0),
        "weights": features.T @ error + 1e-4 * net.weights,
        "offset": np.array([error.sum()]),
    }


def sample_chunks(text: bytes, most: int = TRAIN_CHUNKS) -> list[bytes]:
    """At most `most` chunks of a text, evenly over all of them."""
    starts = chunk_starts(len(text))
    picked = np.unique(np.linspace(0, len(starts) - 1, min(most, len(starts))).round().astype(int))
    return [text[s : s + CHUNK] for s in starts[picked]]


def train(
    docs: DataFrame, labels: DataFrame, label: str, usable: Column, doc_id: str = "doc_id", text: str = "text"
) -> Network:
    """Fits a network on at most `TRAIN_ROWS` documents whose ids in `labels` meet `usable`."""
    picked = labelled_sample(docs, labels, label, usable, TRAIN_ROWS, doc_id, text)

    def rows(columns):
        chunks = [sample_chunks(t) for t in columns["text"]]
        return {"rank": columns["rank"], "label": columns["label"], "chunks": chunks}

    chunked = map_rows(picked, rows, "rank long, label int, chunks array<binary>")
    found = chunked.orderBy("rank", "label", "chunks").limit(TRAIN_ROWS).toArrow().to_pylist()
    return fit([(r["chunks"], r["label"]) for r in found])


def scores(docs: DataFrame, net: Network, keep: list[str], text: str = "text") -> DataFrame:
    """The columns `keep` (bigints) of `docs` and `score`, from 0 to 1, of each whole text.

    Null and empty texts have the score of a document without features.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def rows(columns):
        return {"score": [shared.value.score(t) for t in columns.pop("text")], **columns}

    schema = ", ".join(f"{c} long" for c in keep) + ", score double"
    return map_rows(docs.select(*keep, text_bytes(text).alias("text")), rows, schema)


def accepted(docs: DataFrame, net: Network, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs` whose text scores at least `threshold`, in one pass and without a shuffle.

    Null and empty texts score as in `scores`; repeated rows stay or go together; an empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def score(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in series:
            yield pd.Series([shared.value.score(t) for t in texts], dtype=float)
            give_back()

    return docs.where(F.pandas_udf(score, "double")(text_bytes(text)) >= threshold)
