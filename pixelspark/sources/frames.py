"""Sources and sinks of frames: packed frames, constant frames, image folders, cameras, exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pixelspark.functions.color import CHANNELS, channels
from pixelspark.operators.branching import assign_runs
from pixelspark.operators.pixels import PLACE, channel_columns, color_space, names


def read_images(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(origin, kind, frame_id, width, height, n_channels, data) of the PNG and JPEG files of a folder or list, known by their first bytes; frame_id is what write_png has left.

    Spark decodes them to BGR rows; `image_pixels` puts the channels in order. Other files have kind null and no pixels.
    """
    head = F.substring("content", 1, 8)
    kind = F.when(head == F.lit(bytes.fromhex("89504E470D0A1A0A")), "png").when(F.substring(head, 1, 2) == F.lit(bytes.fromhex("FFD8")), "jpeg")
    same = lambda c: F.regexp_replace(c, "^([a-z0-9]+):/+", "$1:/")  # noqa: E731  the two readers write the scheme's slashes differently
    sniffed = spark.read.format("binaryFile").load(path).select(F.col("path").alias("origin"), kind.alias("kind"), png_frame_id(F.col("content")).alias("frame_id"), same("path").alias("place"))
    decoded = spark.read.format("image").option("dropInvalid", True).load(path).select("image.*").withColumn("place", same("origin")).drop("origin")
    return sniffed.join(decoded, "place", "left").select("origin", "kind", "frame_id", "width", "height", F.col("nChannels").alias("n_channels"), "data")


def _hex(n: Column, digits: int) -> Column:
    return F.lpad(F.hex(n), digits, "0")


def _chunk(kind: str, body: Column) -> Column:
    """A PNG chunk in hexadecimal digits: length, type, body, checksum."""
    named = F.concat(F.lit(kind.encode().hex().upper()), body)
    return F.concat(_hex(F.length(body) / 2, 8), named, _hex(F.crc32(F.unhex(named)), 8))


def png_frames(rgb: DataFrame) -> DataFrame:
    """(frame_id, png): each whole rgb frame as an uncompressed PNG file. The checksum of its bytes comes from sums over its pixels."""
    total = F.col("c0") + F.col("c1") + F.col("c2")
    placed = F.col("c0") + 2 * F.col("c1") + 3 * F.col("c2") + 3 * F.col("x") * total  # by place after the row's filter byte
    code = F.concat(F.when(F.col("x") == 0, "00").otherwise(""), *[_hex(c, 2) for c in ("c0", "c1", "c2")])
    rows = rgb.groupBy("frame_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y", "x", code.alias("code")))), lambda s: s["code"]), "").alias("raw"), (F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"), F.sum(total).alias("s"), F.sum(F.col("y") * total).alias("sy"), F.sum(placed).alias("sx"))
    n = F.length("raw") / 2
    rows = rows.withColumn("n", n.cast("long")).withColumn("last", F.expr("cast((n - 1) div 65535 as int)"))
    # The deflate format's stored blocks (at most 65,535 bytes) and its checksum's modulus, the PNG signature and header.
    swapped = lambda v: F.concat(F.substring(_hex(v, 4), 3, 2), F.substring(_hex(v, 4), 1, 2))

    def block(k: Column) -> Column:
        part = F.substr("raw", k * 131070 + 1, F.lit(131070))
        size = (F.length(part) / 2).cast("int")
        return F.concat(F.when(k == F.col("last"), "01").otherwise("00"), swapped(size), swapped(65535 - size), part)

    sums = _hex((F.col("n") + F.col("n") * F.col("s") - (1 + 3 * F.col("w")) * F.col("sy") - F.col("sx")) % 65521, 4), _hex((1 + F.col("s")) % 65521, 4)
    body = F.concat(F.lit("7801"), F.array_join(F.transform(F.sequence(F.lit(0), F.col("last")), block), ""), *sums)
    head = F.concat(_hex(F.col("w"), 8), _hex(F.col("h"), 8), F.lit("0802000000"))
    return rows.select("frame_id", F.unhex(F.concat(F.lit("89504E470D0A1A0A"), _chunk("IHDR", head), _chunk("IDAT", body), _chunk("IEND", F.lit("")))).alias("png"))


def write_png(rgb: DataFrame, path: str, frames_per_folder: int = 10_000) -> None:
    """PNG files, one for each frame, in folders frames=<k> of frames_per_folder ids; a task writes many files. The frame's id is in the file's
    bytes after the image's end (where decoders do not look), as `frame_id=<id>`; `png_frame_id` reads it."""
    named = png_frames(rgb).select(F.concat("png", F.concat(F.lit("frame_id="), F.col("frame_id").cast("string")).cast("binary")).cast("string").alias("value"), F.expr(f"frame_id div {frames_per_folder}").alias("frames"))
    named.repartition("frames", F.pmod(F.xxhash64("value"), F.lit(8))).write.option("maxRecordsPerFile", 1).partitionBy("frames").text(path)


def png_frame_id(content: Column) -> Column:
    """The id that write_png has put after a PNG file's end, or null."""
    tail = F.decode(F.substring(content, -40, 40), "ISO-8859-1")
    return F.nullif(F.regexp_extract(tail, "frame_id=(-?[0-9]+)\\s*$", 1), F.lit("")).cast("bigint")


def byte_at(data: Column, i: Column) -> Column:
    return F.ascii(F.decode(F.substr(data, i + 1, F.lit(1)), "ISO-8859-1"))


def image_pixels(images: DataFrame, frame_id: Column) -> DataFrame:
    """Pixel relation (rgb or luma in c0..) of decoded images."""
    at = F.col("px") * F.col("n_channels")
    ch = [F.when(F.col("n_channels") == 1, byte_at(F.col("data"), at)).otherwise(byte_at(F.col("data"), at + (2 - k))) for k in range(3)]
    placed = images.where("data is not null").select(frame_id.alias("frame_id"), "width", "n_channels", "data", F.explode(F.expr("sequence(0, width * height - 1)")).alias("px"))
    return placed.select("frame_id", F.expr("cast(px div width as int)").alias("y"), F.expr("cast(px % width as int)").alias("x"), *[c.alias(f"c{k}") for k, c in enumerate(ch)])


def unpack_frames(frames: DataFrame, fmt: str) -> DataFrame:
    """Pixels of packed frames (frame_id, width, height, data) in row-major order; frames of another byte count are left out."""
    n = channels(fmt)
    good = frames.where((F.length("data") == F.col("width") * F.col("height") * n) & (F.length("data") > 0))
    placed = good.select("frame_id", "width", "data", F.explode(F.expr("sequence(0, width * height - 1)")).alias("px"))
    return placed.select("frame_id", F.expr("cast(px div width as int)").alias("y"), F.expr("cast(px % width as int)").alias("x"), *[byte_at(F.col("data"), F.col("px") * n + k).alias(f"c{k}") for k in range(n)])


def pack_frames(px: DataFrame) -> DataFrame:
    """Packed frames of a pixel relation; each frame is one group, as large as the frame."""
    have = channel_columns(px)
    code = F.concat(*[F.lpad(F.hex(c), 2, "0") for c in have])
    rows = px.groupBy("frame_id").agg(F.array_sort(F.collect_list(F.struct("y", "x", code.alias("code")))).alias("p"), (F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"))
    return rows.select("frame_id", "width", "height", F.unhex(F.array_join(F.transform("p", lambda s: s["code"]), "")).alias("data"))


def monochrome_frames(spark: SparkSession, width: int, height: int, fmt: str, color: list[int], n: int) -> DataFrame:
    """n constant frames; the colour must have the format's channels."""
    if len(color) != channels(fmt):
        raise ValueError("the colour's length is not the pixel size")
    grid = spark.range(n).select(F.col("id").alias("frame_id"), F.explode(F.sequence(F.lit(0), F.lit(height - 1))).alias("y")).select("*", F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("x"))
    return grid.select(*PLACE, *[F.lit(v).alias(c) for v, c in zip(color, names(len(color)))])


def zeroed_frames(spark: SparkSession, width: int, height: int, fmt: str, n: int) -> DataFrame:
    return monochrome_frames(spark, width, height, fmt, [0] * channels(fmt), n)


def painted(frames: DataFrame, width: int, height: int, color: list[Column]) -> DataFrame:
    """A constant frame for each row of frames, in the colour of its columns."""
    grid = frames.select("frame_id", *[c.cast("int").alias(f"c{i}") for i, c in enumerate(color)], F.explode(F.sequence(F.lit(0), F.lit(height - 1))).alias("y"))
    return grid.select("*", F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("x")).select(*PLACE, *names(len(color)))


def format_dim(spark: SparkSession) -> DataFrame:
    """(format, alias, channels, pretty): the named pixel formats."""
    # Names, aliases and display names of the formats.
    rows = [("luma", "gray", 1, "Luma"), ("rgb", "rgb24", 3, "RGB"), ("hsv", "hsv", 3, "HSV"), ("ycc", "ycbcr", 3, "YCbCr"), ("rgba", "rgba32", 4, "RGBA"), ("yuyv", "yuyv422", 4, "YUYV")]
    assert {r[0]: r[2] for r in rows} == CHANNELS
    return spark.createDataFrame(rows, "format string, alias string, channels int, pretty string")


def with_format(frames: DataFrame) -> DataFrame:
    """frames joined to their format's row; `?n` has n channels, other unknown formats have nulls."""
    anonymous = F.regexp_extract("format", r"^\?([0-9]+)$", 1)
    dim = F.broadcast(format_dim(frames.sparkSession))  # six rows
    n = F.when(anonymous != "", anonymous.cast("int"))
    return frames.join(dim, "format", "left").withColumn("channels", F.coalesce("channels", F.when(n.between(1, 200), n))).withColumn("pretty", F.coalesce("pretty", F.when(n.between(1, 200), F.col("format"))))


def camera_dim(cameras: DataFrame) -> DataFrame:
    """(stream, fov, width, height, min_gap_us): the frame size is the resize if given, else the native one."""
    return cameras.select("stream", "fov", F.coalesce("resize_width", "width").alias("width"), F.coalesce("resize_height", "height").alias("height"), F.when(F.col("max_fps") > 0, F.round(1e6 / F.col("max_fps")).cast("long")).alias("min_gap_us"))


def resize_to_camera(px: DataFrame, cameras: DataFrame) -> DataFrame:
    """Pixels (stream, frame_id, y, x, channels) in the size that their camera's row (camera_dim) names; of streams without a camera as they are.

    Nearest neighbour turned round, as `resize`: a source pixel gives its targets. The camera table has a row for each stream.
    """
    frame = Window.partitionBy("stream", "frame_id")
    known = px.join(cameras.select("stream", F.col("width").alias("_tw"), F.col("height").alias("_th")), "stream", "left")
    sized = known.withColumn("_w", F.max("x").over(frame) + 1).withColumn("_h", F.max("y").over(frame) + 1).withColumn("_tw", F.coalesce("_tw", "_w")).withColumn("_th", F.coalesce("_th", "_h"))
    up = lambda c, to, size: F.call_function("div", c * F.col(to) + F.col(size) - 1, F.col(size)).cast("int")
    for c, to, size in (("y", "_th", "_h"), ("x", "_tw", "_w")):
        low, high = up(F.col(c), to, size), up(F.col(c) + 1, to, size) - 1
        sized = sized.where(low <= high).withColumn(c, F.explode(F.sequence(low, high)))
    return sized.select("stream", *[F.col(c).cast("int").alias(c) if c in ("y", "x") else F.col(c) for c in PLACE], *channel_columns(px))


def frame_fields(frames: DataFrame, fmt: str) -> DataFrame:
    """(frame_id, width, height, pixels, raw_size, format) of packed frames."""
    return frames.select("frame_id", "width", "height", (F.col("width") * F.col("height")).cast("bigint").alias("pixels"), F.length("data").cast("bigint").alias("raw_size"), F.lit(fmt).alias("format"))


def select_streams(df: DataFrame, pattern: str) -> DataFrame:
    return df.where(F.col("stream").rlike(pattern))


#: The export layouts and the format each pixel format is written in.
EXPORT_LAYOUTS = {"luma": ("gray", "luma"), "ycc": ("yuv444p", "ycc"), "yuyv": ("yuyv422", "yuyv"), "rgba": ("rgba", "rgba"), "rgb": ("rgb24", "rgb"), "hsv": ("rgb24", "rgb")}


def export_frames(px: DataFrame, fmt: str) -> DataFrame:
    """(frame_id, width, height, data, layout): packed frames in the layout that encoders take."""
    layout, target = EXPORT_LAYOUTS.get(fmt, ("rgb24", "rgb"))
    return pack_frames(color_space(px, fmt, target)).withColumn("layout", F.lit(layout))


MANIFEST_SCHEMA = "stream string, hour string, part int, n_frames bigint, first_ts timestamp, last_ts timestamp"


def write_export(frames: DataFrame, path: str, frames_per_file: int = 4096, order: list[str] | None = None) -> DataFrame:
    """Writes frames (stream, ts, ...) as one ordered sequence of bounded files for each stream and hour, and returns its manifest.

    Frames are numbered inside (stream, hour) by range partitions and their counts, and every frames_per_file of them are a part: a
    file in the folder stream=/hour=/part=, sorted by time. A busy hour is thus many tasks' work, and parts read in order are the
    sequence. The manifest (MANIFEST_SCHEMA, a row for each part) is written beside the parts, in the folder _manifest.
    """
    spark, order = frames.sparkSession, order or ["ts", *[c for c in ("frame_id",) if c in frames.columns]]
    hours = frames.withColumn("hour", F.date_format("ts", "yyyy-MM-dd-HH"))
    numbered = assign_runs(hours.withColumn("_of", F.struct("stream", "hour")), order, "_of")
    parts = numbered.withColumn("part", F.expr(f"cast(run_id[0] div {frames_per_file} as int)")).drop("run_id", "_of")
    parts.repartition("stream", "hour", "part").sortWithinPartitions("stream", "hour", "part", *order).write.partitionBy("stream", "hour", "part").parquet(f"{path}/frames")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in frames.schema.fields if f.name != "stream")
    back = spark.read.schema(f"{kinds}, stream string, hour string, part int").parquet(f"{path}/frames")
    back.groupBy("stream", "hour", "part").agg(F.count("*").alias("n_frames"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")).select(*[F.col(c.split()[0]).cast(c.split()[1]) for c in MANIFEST_SCHEMA.split(", ")]).write.parquet(f"{path}/_manifest")
    return spark.read.schema(MANIFEST_SCHEMA).parquet(f"{path}/_manifest")


def read_export(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The frames of an export, with their stream, hour and part; schema is that of the other columns."""
    return spark.read.schema(f"{schema}, stream string, hour string, part int").parquet(f"{path}/frames")
