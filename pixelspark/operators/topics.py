"""Topic tables (topic, ts_us, type, value)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .branching import assign_runs

#: Topic type of each Spark type, lists with [].
TOPIC_TYPES = {"boolean": "boolean", "tinyint": "int", "smallint": "int", "int": "int", "bigint": "int", "float": "float", "double": "double", "string": "string", "binary": "raw"}


def topic_type(spark_type: str) -> str:
    if spark_type.startswith("array<"):
        return topic_type(spark_type[6:-1]) + "[]"
    return TOPIC_TYPES[spark_type]


def wide_type(kind: str) -> str:
    """The widest Spark type of the topic type of a Spark type."""
    base = {"tinyint": "bigint", "smallint": "bigint", "int": "bigint"}
    return f"array<{wide_type(kind[6:-1])}>" if kind.startswith("array<") else base.get(kind, kind)


def widened(df: DataFrame, column: str) -> Column:
    """The column as the widest type of its topic type, as VARIANT."""
    return F.col(column).cast(wide_type(dict(df.dtypes)[column])).cast("variant")


def format_topic(prefix: Column, channel: Column, stream_id: Column, name: Column) -> Column:
    """A leading slash, one slash between prefix and channel; %i is the id, %N the name, %% a percent sign."""
    mark = F.lit("\x00")
    path = F.replace(prefix, F.lit("%%"), mark)
    path = F.replace(F.replace(path, F.lit("%i"), stream_id.cast("string")), F.lit("%N"), name)
    path = F.replace(path, mark, F.lit("%"))
    joined = F.concat(F.rtrim(path, F.lit("/")), F.lit("/"), F.ltrim(channel, F.lit("/")))
    return F.when(joined.startswith("/"), joined).otherwise(F.concat(F.lit("/"), joined))


#: Strftime codes that are one date pattern.
PATTERNS = {
    "%Y": "yyyy", "%y": "yy", "%m": "MM", "%d": "dd", "%j": "DDD", "%H": "HH", "%I": "hh", "%M": "mm", "%S": "ss", "%p": "a", "%b": "MMM", "%h": "MMM", "%B": "MMMM", "%a": "EEE", "%A": "EEEE",
    "%F": "yyyy-MM-dd", "%T": "HH:mm:ss", "%X": "HH:mm:ss", "%R": "HH:mm", "%D": "MM/dd/yy", "%x": "MM/dd/yy", "%v": "d-MMM-yyyy", "%r": "hh:mm:ss a", "%c": "EEE MMM d HH:mm:ss yyyy", "%z": "xx", "%Z": "xxx",
}


def strftime_codes(ts: Column) -> dict[str, Column]:
    """The value of each code at ts, in the session's time zone."""
    weekday = F.dayofweek(ts)
    spaced = lambda pattern: F.lpad(F.date_format(ts, pattern), 2, " ")
    more = {
        "%C": F.lpad(F.floor(F.year(ts) / 100).cast("string"), 2, "0"), "%e": spaced("d"), "%k": spaced("H"), "%l": spaced("h"), "%P": F.lower(F.date_format(ts, "a")),
        "%u": ((weekday + 5) % 7 + 1).cast("string"), "%w": (weekday - 1).cast("string"), "%V": F.lpad(F.weekofyear(ts).cast("string"), 2, "0"), "%G": F.extract(F.lit("YEAROFWEEK"), ts).cast("string"),
        "%f": F.concat(F.date_format(ts, "SSSSSS"), F.lit("000")), "%s": F.unix_seconds(ts).cast("string"), "%n": F.lit("\n"), "%t": F.lit("\t"),
    }
    return {code: F.date_format(ts, pattern) for code, pattern in PATTERNS.items()} | more


def format_path(template: str, ts: Column, stream_id: Column, name: Column) -> Column:
    """The strftime codes of ts, %i the id in 16 hex digits, %N the name, %% a percent sign. Other codes raise an error."""
    values = strftime_codes(ts) | {"%i": id_text(stream_id), "%N": name, "%%": F.lit("%")}
    parts = re.findall(r"%.?|[^%]+", template, re.DOTALL)
    if unknown := [p for p in parts if p[0] == "%" and p not in values]:
        raise ValueError(f"unknown code {unknown[0]}")
    return F.concat(*[values[p] if p[0] == "%" else F.lit(p) for p in parts]) if parts else F.lit("")


def stream_id(name: Column) -> Column:
    return F.xxhash64(name)


def id_text(value: Column) -> Column:
    return F.lpad(F.lower(F.hex(value)), 16, "0")


def _flat(df: DataFrame, column: str) -> tuple[Column, str]:
    """A channel's value and the Spark type it is published as: structs are lists of their numbers, decimals doubles, times microseconds."""
    kind = df.schema[column].dataType
    value = F.col(column)
    if kind.typeName() == "struct":
        return F.when(value.isNotNull(), F.array(*[F.col(f"{column}.{f.name}").cast("double") for f in kind.fields])), "array<double>"
    if kind.typeName() == "array" and kind.elementType.typeName() == "struct":
        parts = [f.name for f in kind.elementType.fields]
        return F.flatten(F.transform(value, lambda e: F.array(*[e[p].cast("double") for p in parts]))), "array<double>"
    if kind.typeName() == "array" and kind.elementType.typeName() == "array":
        return F.flatten(value), kind.elementType.simpleString()
    if kind.typeName() == "decimal":
        return value.cast("double"), "double"
    if kind.typeName().startswith("timestamp"):
        return F.unix_micros(value.cast("timestamp")), "bigint"
    return value, kind.simpleString()


def _messages(df: DataFrame, keys: list[str], channels: list[str], prefix: str, remap: dict[str, str] | None, typed: bool) -> DataFrame:
    cells = []
    for c in channels:
        value, kind = _flat(df, c)
        value = value.cast(wide_type(kind)).cast("variant") if typed else value.cast("string")
        cells.append(F.struct(F.lit((remap or {}).get(c, c)).alias("channel"), F.lit(topic_type(kind)).alias("type"), F.when(F.col(c).isNotNull(), value).alias("value")))
    rows = df.select(*keys, F.explode(F.array(*cells)).alias("m")).where("m.value is not null")
    return rows.select(format_topic(F.lit(prefix), F.col("m.channel"), F.col("stream_id"), F.col("stream")).alias("topic"), "ts_us", F.col("m.type").alias("type"), F.col("m.value").alias("value"))


def publish(df: DataFrame, keys: list[str], channels: list[str], prefix: str, remap: dict[str, str] | None = None) -> DataFrame:
    """Messages (topic, ts_us, type, value) of the channel columns: one row per value that is present; keys hold ts_us, stream and stream_id. Values are text."""
    return _messages(df, keys, channels, prefix, remap, False)


def publish_typed(df: DataFrame, keys: list[str], channels: list[str], prefix: str, remap: dict[str, str] | None = None) -> DataFrame:
    """As publish, with values of their own type as VARIANT: lists stay lists, vectors, points and matrices become lists of doubles."""
    return _messages(df, keys, channels, prefix, remap, True)


def sticky_types(messages: DataFrame) -> DataFrame:
    """Messages of the type their topic was first announced with: an aggregate per topic and a join, no ordered pass over a topic."""
    first = messages.groupBy("topic").agg(F.min_by("type", F.struct("ts_us", "type")).alias("first_type"))
    return messages.join(first, "topic").where("type = first_type").select(messages.columns)


def homogeneous_arrays(values: DataFrame, slot: list[str], order: str) -> DataFrame:
    """(slot, type, values): a slot keeps the type of its first element, of several at one place the least; elements of other types are left out."""
    first = values.groupBy(*slot).agg(F.min_by("type", F.struct(order, "type")).alias("first_type"))
    kept = values.join(first, slot).where("type = first_type")
    return kept.groupBy(*slot).agg(F.first("type").alias("type"), F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), "value"))), lambda s: s["value"]).alias("values"))


def latest(messages: DataFrame) -> DataFrame:
    """The last message of each topic."""
    return messages.groupBy("topic").agg(F.max("ts_us").alias("ts_us"), F.max_by("type", F.struct("ts_us", "value")).alias("type"), F.max_by("value", F.struct("ts_us", "value")).alias("value"))


REGISTRY_SCHEMA = "topic string, publish_id int, type string, first_us bigint"


def registry(messages: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(topic, publish_id, type, first_us) of the topics that are not known yet: ids go on from those given, dense in first-seen order.

    Only new topics are numbered: range partitions of them, each counted, so that no task orders all topics. Ids once given never
    change; a registry is the rows of all its batches.
    """
    first = messages.groupBy("topic").agg(F.min("ts_us").alias("first_us"), F.min_by("type", F.struct("ts_us", "type")).alias("type"))
    given = 0
    if known is not None:
        first = first.join(known.select("topic"), "topic", "left_anti")
        given = known.count()
    placed = assign_runs(first, ["first_us", "topic"])
    return placed.select("topic", (F.get("run_id", F.lit(0)) + given).cast("int").alias("publish_id"), "type", "first_us")


def announcements(topics: DataFrame) -> DataFrame:
    return topics.select("topic", F.to_json(F.struct(F.col("topic").alias("name"), F.col("publish_id").alias("pubuid"), "type")).alias("announce"))


def concat_lists(rows: DataFrame, keys: list[str], values: str, order: str) -> DataFrame:
    """Published lists of a slot appended in order."""
    lists = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(values).alias("v")))), lambda s: s["v"])
    return rows.groupBy(*keys).agg(F.flatten(lists).alias(values))
