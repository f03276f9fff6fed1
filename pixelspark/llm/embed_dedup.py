"""Embedding near-duplicates by E8 lattice hashing.

Unit vectors are projected to eight dimensions by several seeded Gaussian matrices, scaled, shifted and decoded to the
nearest point of the E8 lattice; a cell of a table is a point of each of LATTICES such lattices. In each table a vector is
indexed in its own cell and probes those with a neighbouring point in one of its lattices; pairs that meet in any table, one of
them at home, are verified by their cosine in double precision. Vectors are compared only inside one label and dimension. Equal
vectors are one point with a multiplicity, so that groups of exact copies of any size cost nothing.

Cells that hold one point end before vectors move. The others are cut into pairs of tiles of bounded size, which are compared
as matrices; a pair counts in the first cell in which it meets, so only counts by point and a star of each connected part
leave a task, never pairs.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, and vectors with a null label,
link with nothing and are kept; equal vectors link; rows that repeat an id count as rows of that id and link as others
do; null ids keep a row that links by its vector; an empty table gives no rows. Vectors are scaled by a power of two first, so
that squares neither vanish nor overflow. Only the three named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelspark.session import discard, written

from ._graph import components
from ._text import U64, mix64, stream64

TABLES, LATTICES, PROBES, SCALE = 8, 2, 2, 2.0
TILE_POINTS, BUCKET_ROWS = 512, 4096
CELL_CODES = stream64(53, 8)
TABLE_CODES = stream64(59, 256)


def nearest_d8(x: np.ndarray) -> np.ndarray:
    """Nearest integer points with an even sum: round, and where the sum is odd re-round the worst coordinate."""
    r = np.rint(x)
    odd = np.flatnonzero(r.sum(axis=1).astype(np.int64) & 1)
    if len(odd):
        d = x[odd] - r[odd]
        k = np.abs(d).argmax(axis=1)
        r[odd, k] += np.where(d[np.arange(len(odd)), k] >= 0, 1.0, -1.0)
    return r


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """The nearest E8 point: the better of the nearest points of D8 and of D8 shifted by one half."""
    a, b = nearest_d8(x), nearest_d8(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(axis=1) <= ((x - b) ** 2).sum(axis=1))[:, None], a, b)


def cells(x: np.ndarray, probes: int) -> list[np.ndarray]:
    """The cell of each row, then its next cells: decoded from points pushed away from the cell's centre, nearest first."""
    home = nearest_e8(x)
    out = [home]
    if probes:
        off = x - home
        for k in range(probes):  # further along the offset, then along its largest coordinates
            step = off * (0.75 / np.maximum(np.sqrt((off**2).sum(axis=1, keepdims=True)), 1e-9)) if k == 0 else np.zeros_like(off)
            if k:
                rank = np.argsort(-np.abs(off), axis=1)[:, k - 1]
                at = np.arange(len(off))
                step[at, rank] = np.where(off[at, rank] >= 0, 0.6, -0.6)
            out.append(nearest_e8(x + step))
    return out


def cell_key(points: np.ndarray) -> np.ndarray:
    codes = (points * 2).astype(np.int64).view(U64)
    return mix64((codes * CELL_CODES).sum(axis=1, dtype=U64)).view(np.int64)


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows divided by the power of two at their largest component: exact, and safe to square."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])


POINT = "node bigint, point_a bigint, point_b bigint, label string, copies bigint, least_key bigint, vector array<double>, homes array<bigint>, probes array<bigint>"


def _hash(tables: int, lattices: int, probes: int, scale: float, seed: int):
    """Points get a number and their cells: homes, one per table, and probes, lattices * probes per table."""

    def keys_of(x: np.ndarray, group: np.ndarray, planes: list) -> tuple[np.ndarray, np.ndarray]:
        homes, others = [], []
        for t, table in enumerate(planes):
            decoded = [[cell_key(c).view(U64) for c in cells(x @ plane + shift, probes)] for plane, shift in table]

            def key(parts: list[np.ndarray]) -> np.ndarray:
                out = group ^ TABLE_CODES[t]
                for part in parts:
                    out = mix64(out * CELL_CODES[0] + part)
                return out.view(np.int64)

            own = [d[0] for d in decoded]
            homes.append(key(own))
            others += [key([*own[:k], near, *own[k + 1 :]]) for k in range(lattices) for near in decoded[k][1:]]
        return np.stack(homes, axis=1), np.stack(others, axis=1) if others else np.zeros((len(x), 0), np.int64)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, list] = {}
        number = TaskContext.get().partitionId() << 40
        for whole in batches:
            for start in range(0, whole.num_rows, 1024):
                batch = whole.slice(start, 1024)
                vectors = batch.column("vector")
                lengths = np.array([len(v) for v in vectors], np.int64)
                flat = vectors.flatten().to_numpy(zero_copy_only=False)
                ends = np.concatenate([[0], np.cumsum(lengths)])
                group = batch.column("group").to_numpy().view(U64)
                homes, others = np.zeros((len(group), tables), np.int64), np.zeros((len(group), tables * lattices * probes), np.int64)
                for dim in np.unique(lengths):
                    mine = np.flatnonzero(lengths == dim)
                    x = scaled(flat[ends[mine][:, None] + np.arange(dim)])
                    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
                    if dim not in planes:
                        rng = np.random.default_rng([seed, int(dim)])
                        planes[dim] = [[(rng.normal(size=(int(dim), 8)) / scale, rng.uniform(0, 1, 8)) for _ in range(lattices)] for _ in range(tables)]
                    homes[mine], others[mine] = keys_of(x, group[mine], planes[dim])
                lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(k) + 1, dtype=np.int32) * k.shape[1]), pa.array(k.ravel())) for k in (homes, others)]
                node = pa.array(number + np.arange(len(group)))
                number += len(group)
                yield pa.RecordBatch.from_arrays([node, *[batch.column(c) for c in ("point_a", "point_b", "label", "copies", "least_key", "vector")], *lists], names=[c.split()[0] for c in POINT.split(", ")])

    return rows


def stars(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For n places and edges (i, j) the smallest place connected with each."""
    least = np.arange(n)
    while True:
        new = least.copy()
        np.minimum.at(new, i, least[j])
        np.minimum.at(new, j, least[i])
        new = new[new]
        if (new == least).all():
            return least
        least = new


def _compare(least: float, tables: int):
    """Tiles of cells -> (u, others): the copies of others that u is linked with, and (u, v): u is connected with v."""

    def met_before(homes: np.ndarray, probes: np.ndarray, i: np.ndarray, j: np.ndarray, cell: int) -> np.ndarray:
        """Whether the pair also meets in an earlier table, or in this one in a cell of a smaller key."""
        out = np.zeros(len(i), bool)
        for a in range(0, len(i), 20_000):
            p, q = i[a : a + 20_000], j[a : a + 20_000]
            same = homes[p] == homes[q]
            into_q, into_p = ((homes[x][:, :, None] == probes[y]).any(axis=2) for x, y in ((p, q), (q, p)))
            met = same | into_q | into_p
            table = met.argmax(axis=1)  # the first in which they meet
            r = np.arange(len(p))
            here_p, here_q = homes[p, table], homes[q, table]
            both = into_q[r, table] & into_p[r, table] & ~same[r, table]
            where = np.where(same[r, table], here_p, np.where(both, np.minimum(here_p, here_q), np.where(into_q[r, table], here_p, here_q)))
            out[a : a + 20_000] = where != cell
        return out

    def rows(table: pa.Table) -> pa.Table:
        cell, tile_a, tile_b, side, home, node, copies = (table.column(c).to_numpy(zero_copy_only=False) for c in ("cell", "tile_a", "tile_b", "side", "home", "node", "copies"))
        label = table.column("label").combine_chunks().dictionary_encode().indices.to_numpy()
        vectors = table.column("vector").combine_chunks()
        ends, flat = vectors.offsets.to_numpy(), vectors.values.to_numpy(zero_copy_only=False)
        dims = np.diff(ends)
        homes = table.column("homes").combine_chunks().flatten().to_numpy().reshape(len(node), tables)
        probes = table.column("probes").combine_chunks().flatten().to_numpy().reshape(len(node), tables, -1)
        order = np.lexsort((dims, label, tile_b, tile_a, cell))
        keys = np.stack([cell, tile_a, tile_b, label, dims], axis=1)[order]
        cut = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1), [True]]))
        u, v, others = [], [], []
        for a, b in zip(cut[:-1], cut[1:]):
            mine = order[a:b]
            if len(mine) < 2 or not home[mine].any():
                continue
            x = scaled(flat[ends[mine][:, None] + np.arange(dims[mine[0]])])
            size = np.sqrt((x * x).sum(axis=1))
            first, second = np.flatnonzero(side[mine] == tile_a[mine[0]]), np.flatnonzero(side[mine] == tile_b[mine[0]])
            good = x[first] @ x[second].T >= least * (size[first][:, None] * size[second][None])
            good &= home[mine[first]][:, None] | home[mine[second]][None]
            if tile_a[mine[0]] == tile_b[mine[0]]:
                good = np.triu(good, 1)
            i, j = np.nonzero(good)
            if not len(i):
                continue
            i, j = first[i], second[j]
            star = stars(len(mine), i, j)
            ray = np.flatnonzero(star != np.arange(len(mine)))
            new = ~met_before(homes[mine], probes[mine], i, j, cell[mine[0]])
            found = np.zeros(len(mine), np.int64)
            np.add.at(found, i[new], copies[mine[j[new]]])
            np.add.at(found, j[new], copies[mine[i[new]]])
            some = np.flatnonzero(found)
            u += [node[mine[some]], node[mine[ray]]]
            v += [np.full(len(some), -1), node[mine[star[ray]]]]
            others += [found[some], np.zeros(len(ray), np.int64)]
        none = [np.zeros(0, np.int64)]
        v = np.concatenate(v or none)
        return pa.table({"u": pa.array(np.concatenate(u or none)), "v": pa.array(v, mask=v < 0), "others": pa.array(np.concatenate(others or none))})

    return rows


def links(points: DataFrame, least_cosine: float, tables: int) -> DataFrame:
    """Of written points: rows (u, null, others), whose sum over others is the copies u is linked with, and rows (u, v, 0) of connected points."""
    at_home = points.select("node", F.explode("homes").alias("cell")).withColumn("home", F.lit(True))
    probing = points.select("node", F.explode(F.array_distinct("probes")).alias("cell")).withColumn("home", F.lit(False))
    members = at_home.union(probing).groupBy("cell", "node").agg(F.bool_or("home").alias("home"))
    members = written(members, "cells")
    shared = members.groupBy("cell").agg(F.count("*").alias("n"), F.bool_or("home").alias("any_home")).where("n > 1 and any_home").select("cell", F.ceil(F.col("n") / TILE_POINTS).alias("n_tiles"))
    cut = members.join(shared, "cell").withColumn("side", F.pmod(F.xxhash64("node"), F.col("n_tiles"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_tiles") - 1)))
    cut = cut.select("cell", "node", "home", "side", F.least("side", "other").alias("tile_a"), F.greatest("side", "other").alias("tile_b"))
    cut = written(cut, "tiles")
    n_buckets = max(1, cut.count() // BUCKET_ROWS)  # many small cells share a call; a tile bounds what one cell adds
    cut = cut.withColumn("bucket", F.pmod(F.xxhash64("cell", "tile_a", "tile_b"), F.lit(n_buckets)))
    met = cut.join(points.select("node", "label", "copies", "vector", "homes", "probes").hint("merge"), "node")
    found = met.groupBy("bucket").applyInArrow(_compare(least_cosine, tables), "u bigint, v bigint, others bigint")
    found = written(found, "found")
    discard(members, cut)
    return found


def near_duplicates(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", least_cosine: float = 0.98, tables: int = TABLES, lattices: int = LATTICES, probes: int = PROBES, scale: float = SCALE, seed: int = 17) -> DataFrame:
    """(key, n_links, component_id, kept) of every row."""
    rows = vectors.select(F.col(key).cast("long").alias("key"), F.col(vector).cast("array<double>").alias("vector"), F.col(label).cast("string").alias("label"))
    good = F.col("label").isNotNull() & F.coalesce(F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0), F.lit(False))
    clean = F.transform("vector", lambda x: x + F.lit(0.0))
    rows = rows.select("key", "label", clean.alias("vector"), F.when(good, F.xxhash64("label", clean)).alias("point_a"), F.when(good, F.xxhash64(F.lit(1), "label", clean)).alias("point_b"))
    points = rows.where("point_a is not null").groupBy("point_a", "point_b").agg(F.min("key").alias("least_key"), F.count("*").alias("copies"), F.first("label").alias("label"), F.first("vector").alias("vector"))
    points = points.withColumn("group", F.xxhash64("label", F.size("vector")))
    points = written(points.mapInArrow(_hash(tables, lattices, probes, scale, seed), POINT), "points")
    found = links(points, least_cosine, tables)
    degree = found.groupBy("u").agg(F.sum("others").alias("others"))
    linked = components(found.where("v is not null").select("u", "v"))
    classes = points.select("node", "point_a", "point_b", "least_key", "copies").join(degree, F.col("node") == degree["u"], "left").drop("u")
    classes = classes.join(linked.withColumnRenamed("node", "of"), F.col("node") == F.col("of"), "left")
    classes = written(classes.select("point_a", "point_b", "least_key", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("class")), "classes")
    least = classes.groupBy("class").agg(F.min("least_key").alias("component_id"))
    by_point = written(classes.join(least, "class").select("point_a", "point_b", "n_links", "component_id"), "by-point")
    out = rows.select("key", "point_a", "point_b").join(by_point, ["point_a", "point_b"], "left")
    component = F.coalesce("component_id", "key")
    return out.select(F.col("key").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("key") == component, F.lit(True)).alias("kept"))
