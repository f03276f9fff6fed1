"""Fan-out and gathering: a branching run is a hierarchical key `run_id ARRAY<BIGINT>`, whose first element is the run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelspark.session import written


def assign_runs(df: DataFrame, order: list[str], stream: str | None = None) -> DataFrame:
    """run_id [run] numbered from 0 in order, per stream where one is given.

    Rows are sorted in range partitions, written once so that the ranges stand still; a row's number is its place in its
    partition plus the rows before that: of its stream, or of all. No task holds more than a partition.
    """
    keys = ([stream] if stream else []) + order
    placed = written(df.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()), "runs")
    group = [stream] if stream else []
    sizes = placed.groupBy(*group, "_part").agg(F.count("*").alias("_size"))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    starts = sizes.select(*[F.col(c).alias(f"_{c}") for c in group], F.col("_part").alias("_at"), F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    same = F.col("_part") == F.col("_at")
    for c in group:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    joined = placed.join(starts, same).withColumn("_place", F.row_number().over(Window.partitionBy(*group, "_part").orderBy(*order)))
    return joined.select(*df.columns, F.array((F.col("_start") + F.col("_place") - 1).cast("bigint")).alias("run_id"))


def prefix(depth: int, run_id: str = "run_id") -> Column:
    return F.slice(run_id, 1, depth)


def broadcast_vec(df: DataFrame, values: str, elem: str = "elem") -> DataFrame:
    """One row per list element, its index appended to run_id; the list column goes."""
    rest = [c for c in df.columns if c not in ("run_id", values)]
    out = df.select("run_id", *rest, F.posexplode(values).alias("branch", elem))
    return out.select(F.concat("run_id", F.array(F.col("branch").cast("bigint"))).alias("run_id"), *rest, elem)


def prefix_join(parent: DataFrame, child: DataFrame, depth: int) -> DataFrame:
    """Values of an input with depth levels, copied to every branch below: an equi-join on the common prefix."""
    p = parent.withColumnRenamed("run_id", "_prefix")
    return child.join(p, prefix(depth) == F.col("_prefix")).drop("_prefix")


def collect_vec(df: DataFrame, value: str, depth: int, ordered: bool = False) -> DataFrame:
    """(run_id prefix, values): all values below each prefix; ordered gives them in run id order."""
    if ordered:
        values = F.transform(F.array_sort(F.collect_list(F.struct("run_id", F.col(value).alias("v")))), lambda s: s["v"])
    else:
        values = F.collect_list(value)
    return df.groupBy(prefix(depth).alias("run_id")).agg(values.alias("values"))


def collect_by_reference(ref: DataFrame, df: DataFrame, value: str, depth: int, ordered: bool = True) -> DataFrame:
    """As collect_vec for the prefixes in ref (run_id of that depth); prefixes without values give an empty list."""
    got = collect_vec(df, value, depth, ordered)
    kind = dict(got.dtypes)["values"]
    return ref.select("run_id").distinct().join(got, "run_id", "left").select("run_id", F.coalesce("values", F.array().cast(kind)).alias("values"))


def select_last(df: DataFrame, value: str, depth: int) -> DataFrame:
    return df.groupBy(prefix(depth).alias("run_id")).agg(F.max_by(value, "run_id").alias("value"))


def select_first(df: DataFrame, value: str, depth: int) -> DataFrame:
    return df.groupBy(prefix(depth).alias("run_id")).agg(F.min_by(value, "run_id").alias("value"))


def multi_source(sources: list[DataFrame]) -> DataFrame:
    """Bag union of the sources of one input; the source's ordinal is one more branch level."""
    out = None
    for n, df in enumerate(sources):
        df = df.withColumn("run_id", F.concat("run_id", F.array(F.lit(n).cast("bigint"))))
        out = df if out is None else out.unionByName(df)
    return out


def branch_counter(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The n-th value sent on a channel gets branch n."""
    return df.withColumn("branch", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)


def unpack(df: DataFrame, struct: str, fields: dict[str, str], keep: list[str], allow_missing: bool = False) -> DataFrame:
    """Named fields of a struct column, fields {output: field}; a missing one is an analysis error, or null when allowed."""
    have = {f.name for f in df.schema[struct].dataType.fields}
    return df.select(*keep, *[(F.lit(None) if allow_missing and f not in have else F.col(f"{struct}.{f}")).alias(out) for out, f in fields.items()])


def contains(df: DataFrame, values: str, elem: str) -> DataFrame:
    return df.withColumn("found", F.array_contains(values, F.col(elem)))


def gather(df: DataFrame, depth: int, aggregates: list[Column]) -> DataFrame:
    """(run_id prefix, aggregates): what a gathering component sees of all values below each prefix; depth 1 gathers a whole run, a greater one the nearest branch."""
    return df.groupBy(prefix(depth).alias("run_id")).agg(*aggregates)


def minimal_depth(branches: list[list[str]]) -> int:
    """The shared depth at which inputs with these branch names (outermost first) meet: one for the run, and one for each leading name they have in common."""
    common = 1
    for names in zip(*branches):
        if len(set(names)) > 1:
            break
        common += 1
    return common


def order_by_run(df: DataFrame, depth: int, place: str = "place") -> DataFrame:
    """Values numbered from 1 in run id order below each prefix."""
    return df.withColumn(place, F.row_number().over(Window.partitionBy(prefix(depth)).orderBy("run_id")).cast("bigint"))


def order_statistic(df: DataFrame, keys: list[str], value: str, name: str = "middle") -> DataFrame:
    """(keys, name): the value at place n div 2 (from 0) of each group's n values in order."""
    w = Window.partitionBy(*keys).orderBy(value)
    placed = df.select(*keys, F.col(value).alias(name), F.row_number().over(w).alias("_place"), F.count("*").over(Window.partitionBy(*keys)).alias("_n"))
    return placed.where(F.col("_place") == F.expr("_n div 2 + 1")).drop("_place", "_n")
