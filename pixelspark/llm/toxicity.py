"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Features are the distinct 3-, 4- and 5-grams of code points of the lower-cased text, hashed to 2**22 places. The log-count
ratio of a feature is the log of its smoothed document rate in toxic against other training texts; a logistic
regression is fitted on the presence of features times their ratios. Ratios that are small against their standard error are
set to zero, which leaves a sparse table: scoring a text is one table look-up per n-gram.

Defined results: a null or empty text has no features and gets the score of the bias alone; repeated rows get equal
scores; without training rows of both labels every score is the share of label 1 (0.5 without any); an empty table gives
no rows. Only key, text and labels are read, so extra columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._labels import held_out, training_sample
from ._text import as_bytes, slices

SIZES = (3, 4, 5)
BITS = 22
FACTORS = np.array([2654435761, 2246822519, 3266489917, 668265263, 374761393], dtype=np.uint32)


def code_points(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    points = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32)
    lead = np.zeros(len(raw) + 1, np.int64)
    np.cumsum((raw & 0xC0) != 0x80, out=lead[1:])
    return points, lead[at]


def gram_ids(points: np.ndarray, at: np.ndarray) -> Iterator[np.ndarray]:
    """For each n-gram size the place of the n-gram that starts at each code point; 0 where none fits in the text."""
    n = len(points)
    total = points * FACTORS[0]
    for size in range(2, max(SIZES) + 1):
        if n < size:
            return
        total = total[: n - size + 1] + points[size - 1 :] * FACTORS[size - 1]
        if size in SIZES:
            x = (total ^ (total >> np.uint32(15))) * np.uint32(2246822519 + 2 * size)
            out = np.zeros(n, np.uint32)
            out[: n - size + 1] = ((x ^ (x >> np.uint32(13))) * np.uint32(3266489917)) >> np.uint32(32 - BITS)
            for j in range(1, size):  # those that would run into the next text
                edge = at[1:] - j
                out[edge[edge >= 0]] = 0
            yield out


def fit(rows: list[tuple], smoothing: float = 0.5, min_docs: int = 3, min_z: float = 2.0, l2: float = 1e-3, rounds: int = 150) -> tuple[np.ndarray, float]:
    """Weights by place (ratio times coefficient, float32) and bias."""
    y = np.array([r[2] for r in rows], dtype=np.float64)
    table = np.zeros(1 << BITS, np.float32)
    if not len(y) or y.min() == y.max():
        p = min(max(y.mean() if len(y) else 0.5, 0.01), 0.99)
        return table, float(np.log(p / (1 - p)))
    seen = np.zeros(1 << BITS, bool)
    ids: list[np.ndarray] = []
    for _, text, _ in rows:
        points, ends = code_points(*as_bytes(pc.utf8_lower(pa.array([text], pa.large_string()))))  # as the scorer does it
        found = np.concatenate([np.zeros(0, np.uint32), *gram_ids(points, ends)])
        seen[found] = True
        seen[0] = False
        mine = found[seen[found]]
        mine = np.unique(mine)
        seen[mine] = False
        ids.append(mine)
    flat, lengths = np.concatenate(ids), np.array([len(x) for x in ids])
    toxic = np.repeat(y == 1, lengths)
    p = np.bincount(flat[toxic], minlength=1 << BITS).astype(np.float64)
    q = np.bincount(flat[~toxic], minlength=1 << BITS).astype(np.float64)
    ratio = np.log((p + smoothing) / (y.sum() + 2 * smoothing)) - np.log((q + smoothing) / ((1 - y).sum() + 2 * smoothing))
    sure = np.abs(ratio) >= min_z * np.sqrt(1 / (p + smoothing) + 1 / (q + smoothing))
    ratio[(p + q < min_docs) | ~sure] = 0
    keep = ratio[flat] != 0
    owner = np.repeat(np.arange(len(y)), lengths)[keep]
    places, column = np.unique(flat[keep], return_inverse=True)
    value = ratio[places][column]
    w, b = np.zeros(len(places)), float(np.log(y.mean() / (1 - y.mean())))
    mw, vw, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, rounds + 1):  # full-batch Adam
        z = np.bincount(owner, w[column] * value, len(y)) + b
        g = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) / len(y)
        gw, gb = np.bincount(column, g[owner] * value, len(places)) + l2 * w / len(y), g.sum()
        mw, vw, mb, vb = 0.9 * mw + 0.1 * gw, 0.99 * vw + 0.01 * gw * gw, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        rate = 0.06 * min(1.0, 2 * (1 - t / (rounds + 1)))
        w -= rate * (mw / (1 - 0.9**t)) / (np.sqrt(vw / (1 - 0.99**t)) + 1e-9)
        b -= rate * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.99**t)) + 1e-9)
    table[places] = w * ratio[places]
    table[0] = 0
    return table, b


def _scorer(shared, carried: tuple[str, ...] = ("key",)):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, bias = shared.value
        useful = table != 0
        for batch, raw, at in slices(batches, "text"):
            lower = pc.utf8_lower(pa.LargeStringArray.from_buffers(len(at) - 1, pa.py_buffer(np.ascontiguousarray(at)), pa.py_buffer(np.ascontiguousarray(raw))))
            points, ends = code_points(*as_bytes(lower))
            spots, places = [], []
            for ids in gram_ids(points, ends):
                hit = np.flatnonzero(useful[ids])
                spots.append(hit)
                places.append(ids[hit])
            z = np.full(len(at) - 1, bias)
            if spots:
                owner = np.searchsorted(ends, np.concatenate(spots), "right") - 1
                pair = np.unique((owner.astype(np.int64) << BITS) | np.concatenate(places).astype(np.int64))
                z += np.bincount(pair >> BITS, table[pair & ((1 << BITS) - 1)], len(z))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in carried], pa.array(1 / (1 + np.exp(-np.clip(z, -500, 500))))], names=[*carried, "score"])

    return score


def score_toxicity(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", threshold: float = 0.3, max_train_rows: int = 6000, seed: int = 5) -> DataFrame:
    """(key, held_out, score, predicted) of every whole text. The model is fitted on at most max_train_rows labelled rows outside the held-out split and broadcast (16 MB)."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(fit(training_sample(docs, labels, label, key, text, max_train_rows, seed)))
    scored = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(_scorer(shared), f"key {docs.schema[key].dataType.simpleString()}, score double")
    return scored.select(F.col("key").alias(key), held_out(F.col("key")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
