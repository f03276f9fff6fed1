"""Labelled rows for the classifiers: the split by key and the bounded training sample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(key: Column) -> Column:
    """True for the rows no label is learnt from: crc32 of the key as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_sample(docs: DataFrame, labels: DataFrame, label: str, key: str, text: str, max_rows: int, seed: int, max_text_bytes: int = 64 << 10) -> list[tuple]:
    """At most max_rows labelled training rows (key, text, label), by hash of the key; whole texts, of max_text_bytes at most, so that the sample is bounded in bytes.

    Rows without key, label or text are not learnt from; a key with several labels counts once per label row.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull() & ~held_out(F.col(key))).select(F.col(key).alias("label_key"), F.col(label).cast("int").alias("y"))
    n = known.count()
    bucket = F.pmod(F.xxhash64(F.lit(seed), F.col("label_key").cast("string")), F.lit(1 << 30))
    chosen = known.where(bucket < int((1 << 30) * min(1.0, max_rows / max(n, 1))))
    chosen = chosen.orderBy(bucket, "label_key", "y").limit(max_rows)
    texts = docs.select(F.col(key).alias("text_key"), F.col(text).cast("string").alias("t")).where("t is not null").where(F.octet_length("t") <= max_text_bytes)
    rows = texts.join(F.broadcast(chosen), F.col("text_key") == F.col("label_key")).select("label_key", "t", "y").toArrow()
    return sorted(zip(rows["label_key"].to_pylist(), rows["t"].to_pylist(), rows["y"].to_pylist()))
