"""Mixing sources to target weights by Poisson replication, with DataFrame functions only.

Every document is copied k times, k being Poisson distributed with its source's mean repetition rate
weight * target_rows / rows of the source. k inverts the cumulative distribution at a uniform number hashed from the
row's key and a seed, so a lost task repeats the same copies. The distribution starts at exp(-rate), which a double holds
only to a rate of about 708: above DRAW_RATE, k is the sum of equal independent draws of a rate up to DRAW_RATE, each at
its own hashed number. The copies are then shuffled globally.

Defined results: a null source is a source of its own; a null key hashes as the empty text; sources with weight zero or
absent from a given weight table give no rows; repeated keys get the same count each; an empty table gives no rows.
Extra columns are carried along; the added columns are `copy_no`, `n_copies` and `shuffle_key`, replacing columns of
those names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelspark.session import written

DRAW_RATE = 700


def hash_uniform(seed: int | Column, *parts: Column) -> Column:
    """A number in (0, 1): 52 bits of the MD5 of the parts, plus one half."""
    key = F.md5(F.concat_ws(":", seed if isinstance(seed, Column) else F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))
    return (F.conv(F.substring(key, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def poisson_cdf(rate: Column) -> Column:
    """P(k <= 0), P(k <= 1), ... as far as a double tells them from 1; empty for a rate of 0. Rates up to DRAW_RATE only."""
    top = F.ceil(rate + 12 * F.sqrt(rate) + 16).cast("int")
    step = F.aggregate(
        F.sequence(F.lit(1), top),
        F.struct(F.exp(-rate).alias("p"), F.array(F.exp(-rate)).alias("cdf")),
        lambda s, k: F.struct((s["p"] * rate / k).alias("p"), F.concat(s["cdf"], F.array(F.element_at(s["cdf"], -1) + s["p"] * rate / k)).alias("cdf")),
        lambda s: s["cdf"],
    )
    return F.when(rate > 0, step).otherwise(F.array().cast("array<double>"))


def poisson_count(seed: int, key: Column, cdf: Column, draws: Column, u: Column) -> Column:
    """The sum of `draws` Poisson counts with this distribution; the first draw, at u, hashes the seed and key alone."""

    def below(u: Column) -> Column:
        return F.size(F.filter(cdf, lambda c: c < u)).cast("long")

    def more(s: Column, i: Column) -> Column:
        return s + below(hash_uniform(F.concat(F.lit(f"{seed}+"), i.cast("string")), key))

    rest = F.aggregate(F.sequence(F.lit(2).cast("long"), draws), F.lit(0).cast("long"), more)
    return below(u) + F.when(draws > 1, rest).otherwise(F.lit(0).cast("long"))


def source_rates(docs: DataFrame, source: str, weights: dict[str | None, float] | None, temperature: float, epochs: float) -> DataFrame:
    """(mix_source, rate): mean copies of each document. Without weights, a source's weight is its row count to a power."""
    sizes = written(docs.groupBy(F.col(source).alias("mix_source")).agg(F.count("*").alias("n")), "mix-sizes")  # one row per source
    all_n = sizes.agg(F.sum("n")).first()[0] or 0
    if weights is None:
        sizes = sizes.withColumn("w", F.pow(F.col("n").cast("double"), F.lit(temperature)))
    else:
        given = docs.sparkSession.createDataFrame([(k, float(w)) for k, w in weights.items()] or [(None, 0.0)], "given string, w double")
        sizes = sizes.join(given, F.col("mix_source").cast("string").eqNullSafe(F.col("given"))).select("mix_source", "n", "w")
    all_w = sizes.agg(F.sum("w")).first()[0]
    return sizes.select("mix_source", (F.col("w") / F.lit(all_w) * F.lit(all_n) * epochs / F.col("n") if all_w else F.lit(0.0)).alias("rate"))


def shuffled(copies: DataFrame, order: str) -> DataFrame:
    """Range partitions of a hexadecimal hash, sorted inside. The hash is even, so its leading digits give the partition and no sample of the rows is taken first."""
    n = int(copies.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = F.conv(F.substring(order, 1, 8), 16, 10).cast("long") * n
    return copies.repartitionById(n, F.shiftrightunsigned(place, 32).cast("int")).sortWithinPartitions(order)


def mix_sources(docs: DataFrame, key: str = "doc_id", source: str = "source", weights: dict[str | None, float] | None = None, temperature: float = 0.5, epochs: float = 1.0, seed: int = 7) -> DataFrame:
    """docs replicated to the target weights, in a global pseudo-random order (range partitions of shuffle_key, sorted inside)."""
    docs = docs.drop("copy_no", "n_copies", "shuffle_key")
    names = docs.columns
    given = docs.toDF(*[f"c{i}" for i in range(len(names))])  # columns of any name are carried along
    key, source = (F.col(f"c{names.index(c)}") for c in (key, source))
    rates = source_rates(given.select(source.alias("source")), "source", weights, temperature, epochs).where("rate > 0").withColumn("draws", F.ceil(F.col("rate") / DRAW_RATE))
    rates = rates.select("mix_source", "draws", poisson_cdf(F.col("rate") / F.col("draws")).alias("cdf"))
    rates = written(rates, "mix-rates")  # a written table: the planner broadcasts it only if it is small
    counted = given.join(rates, source.eqNullSafe(rates["mix_source"])).withColumn("u", hash_uniform(seed, key))
    counted = counted.withColumn("n_copies", poisson_count(seed, key, F.col("cdf"), F.col("draws"), F.col("u"))).where("n_copies > 0").drop("cdf", "draws", "u", "mix_source")
    copies = counted.withColumn("copy_no", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_copies"))))
    copies = copies.withColumn("shuffle_key", F.md5(F.concat_ws(":", F.lit(f"order{seed}"), F.coalesce(key.cast("string"), F.lit("")), F.col("copy_no").cast("string"))))
    return shuffled(copies, "shuffle_key").toDF(*names, "n_copies", "copy_no", "shuffle_key")
