"""Quality: a byte-level convolutional network in numpy.

A text is cut into overlapping chunks of bytes that cover all of it. Learned byte embeddings and filters run over each
chunk; each filter's largest response in a chunk is kept. A text's features are the largest and the mean of these over its
chunks, combined by one logistic unit into one probability, the chance that label is 1.

Defined results: a null or empty text is one chunk of padding; repeated rows get equal scores; without training rows of
both labels every score is the share of label 1 (0.5 without any); an empty table gives no rows. Only key, text and labels
are read, so extra columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._labels import held_out, training_sample
from ._text import repeat_ranges, slices

CHUNK, WIDTH, STRIDE, DIM, FILTERS = 256, 8, 2, 8, 24
STEP = CHUNK - WIDTH + STRIDE  # neighbours share WIDTH - STRIDE bytes, so that no window is missed
WINDOWS = (CHUNK - WIDTH) // STRIDE + 1


def chunks_of(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(chunks, CHUNK) bytes, zero-padded, and n + 1 offsets of the texts in the chunks."""
    lengths = np.diff(at)
    counts = np.maximum(1, -(-np.maximum(lengths - (WIDTH - STRIDE), 1) // STEP))
    starts = repeat_ranges(np.zeros(len(counts), np.int64), counts) * STEP
    owner = np.repeat(np.arange(len(counts)), counts)
    left = lengths[owner] - starts
    padded = np.concatenate([raw, np.zeros(CHUNK, np.uint8)])
    out = np.lib.stride_tricks.sliding_window_view(padded, CHUNK)[at[owner] + starts].copy() if len(owner) else np.zeros((0, CHUNK), np.uint8)
    short = np.flatnonzero(left < CHUNK)
    out[short] = np.where(np.arange(CHUNK) < left[short, None], out[short], 0)
    return out, np.concatenate([[0], np.cumsum(counts)])


def windows_of(chunks: np.ndarray, net: dict) -> np.ndarray:
    """(chunks * WINDOWS, WIDTH * DIM) embedded windows."""
    embedded = net["embed"][chunks].reshape(len(chunks), CHUNK * DIM)
    view = np.lib.stride_tricks.sliding_window_view(embedded, WIDTH * DIM, axis=1)[:, :: STRIDE * DIM]
    return view.reshape(-1, WIDTH * DIM)


def pooled(chunks: np.ndarray, net: dict, block: int = 256) -> np.ndarray:
    """(chunks, FILTERS): each filter's largest rectified response."""
    out = np.empty((len(chunks), FILTERS), np.float32)
    for i in range(0, len(chunks), block):
        part = chunks[i : i + block]
        out[i : i + block] = (windows_of(part, net) @ net["filters"]).reshape(len(part), WINDOWS, FILTERS).max(axis=1)
    return np.maximum(out + net["shift"], 0)


def combine(pool: np.ndarray, ends: np.ndarray, net: dict) -> np.ndarray:
    top = np.maximum.reduceat(pool, ends[:-1])
    mean = np.add.reduceat(pool, ends[:-1]) / np.diff(ends)[:, None]
    return np.hstack([top, mean]) @ net["out"] + net["bias"]


def fit(rows: list[tuple], epochs: int = 8, seed: int = 3, batch: int = 32, rate: float = 0.01) -> dict:
    rng = np.random.default_rng(seed)
    f32 = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
    net = {"embed": f32(256, DIM, scale=0.5), "filters": f32(WIDTH * DIM, FILTERS, scale=0.15), "shift": np.zeros(FILTERS, np.float32), "out": f32(2 * FILTERS, scale=0.1), "bias": np.zeros(1, np.float32)}
    y = np.array([r[2] for r in rows], np.float32)
    if not len(y) or y.min() == y.max():
        p = min(max(y.mean() if len(y) else 0.5, 0.01), 0.99)
        net["out"][:] = 0
        net["bias"][:] = np.log(p / (1 - p))
        return net
    raws = [np.frombuffer(r[1].encode("utf-8", "replace"), np.uint8) for r in rows]
    cut = [chunks_of(x, np.array([0, len(x)]))[0] for x in raws]
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.items()}
    t, steps = 0, epochs * -(-len(y) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for i in range(0, len(y), batch):
            t += 1
            pick = order[i : i + batch]
            counts = np.array([len(cut[k]) for k in pick])
            ends = np.concatenate([[0], np.cumsum(counts)])
            part = np.concatenate([cut[k] for k in pick])
            # forward in blocks, keeping only where each filter peaked
            best, where = np.empty((len(part), FILTERS), np.float32), np.empty((len(part), FILTERS), np.int64)
            for j in range(0, len(part), 256):
                got = (windows_of(part[j : j + 256], net) @ net["filters"]).reshape(-1, WINDOWS, FILTERS)
                where[j : j + 256] = got.argmax(axis=1)
                best[j : j + 256] = np.take_along_axis(got, where[j : j + 256][:, None], axis=1)[:, 0]
            pool = np.maximum(best + net["shift"], 0)
            top = np.maximum.reduceat(pool, ends[:-1])
            features = np.hstack([top, np.add.reduceat(pool, ends[:-1]) / counts[:, None]])
            z = features @ net["out"] + net["bias"]
            g = (1 / (1 + np.exp(-z)) - y[pick]) / len(pick)
            grads = {"out": features.T @ g, "bias": g.sum(keepdims=True)}
            back = np.outer(g, net["out"]).astype(np.float32)
            owner = np.repeat(np.arange(len(pick)), counts)
            d = back[owner, FILTERS:] / counts[owner, None] + np.where(pool == top[owner], back[owner, :FILTERS], 0)
            d *= pool > 0
            grads["shift"] = d.sum(axis=0)
            at_byte = where[..., None] * STRIDE + np.arange(WIDTH)  # chunks, filters, width
            bytes_at = part[np.arange(len(part))[:, None, None], at_byte]
            embedded = net["embed"][bytes_at]  # chunks, filters, width, dim
            grads["filters"] = np.einsum("cf,cfx->xf", d, embedded.reshape(len(part), FILTERS, -1), optimize=True)
            into = (d[..., None] * net["filters"].T[None]).reshape(-1, DIM)
            grads["embed"] = np.stack([np.bincount(bytes_at.ravel(), into[:, k], 256) for k in range(DIM)], axis=1)
            now = rate * min(1.0, 2 * (1 - t / (steps + 1)))
            for k, v in net.items():
                m, s = moments[k]
                gk = grads[k].astype(np.float32)
                m += 0.1 * (gk - m)
                s += 0.01 * (gk * gk - s)
                v -= (now * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.99**t)) + 1e-8)).astype(np.float32)
    return net


def _scorer(shared, carried: tuple[str, ...] = ("key",)):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for batch, raw, at in slices(batches, "text"):
            chunks, ends = chunks_of(raw, at)
            z = combine(pooled(chunks, net), ends, net).astype(np.float64)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in carried], pa.array(1 / (1 + np.exp(-np.clip(z, -500, 500))))], names=[*carried, "score"])

    return score


def score_quality(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", threshold: float = 0.7, max_train_rows: int = 2000, seed: int = 5) -> DataFrame:
    """(key, held_out, score, predicted) of every whole text. The network is fitted on at most max_train_rows labelled rows outside the held-out split and broadcast (under 50 kB)."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(training_sample(docs, labels, label, key, text, max_train_rows, seed)))
    scored = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(_scorer(shared), f"key {docs.schema[key].dataType.simpleString()}, score double")
    return scored.select(F.col("key").alias(key), held_out(F.col("key")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_quality(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", threshold: float = 0.7, max_train_rows: int = 2000, seed: int = 5) -> DataFrame:
    """The rows of docs whose text scores at least threshold, unchanged: scored and filtered where they are read."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(training_sample(docs, labels, label, key, text, max_train_rows, seed)))
    names = [f"c{i}" for i in range(len(docs.columns))]  # clashing column names are safe
    given = docs.toDF(*names)
    scored = given.withColumn("text", F.col(names[docs.columns.index(text)]).cast("string"))
    schema = ", ".join([*(f"{n} {given.schema[n].dataType.simpleString()}" for n in names), "score double"])
    return scored.mapInArrow(_scorer(shared, tuple(names)), schema).where(F.col("score") >= threshold).select(*names).toDF(*docs.columns)
