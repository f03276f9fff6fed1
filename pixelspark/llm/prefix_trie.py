"""Prefix trie of conversations, with totals of each subtree by centroid decomposition.

Conversations are rebuilt first: the first h turns of the conversation at the id's hundred, then the conversation's own turns after
its first h. Turns are numbered in range partitions, so that a conversation of any length is many tasks' work, and each
prefix is named by four running sums over hashes of (place, role, text). Equal prefixes are one node; a node is called by its
smallest member and its depth, for that member's rows then lead from the node to each of its ancestors.

Subtree totals come from a centroid decomposition of the forest of parent edges. A node weighs as many rows as it has members,
and the weight of a whole subtree, the rows at or below it, is a plain sum over its members; so no rollup is needed to find
centroids. Each round takes the components of one round:
  the nodes that hold half of their component's weight form the path from its top to its centroid, the lightest of them;
  the centroid's total in the component, of itself and all below it, goes to every node of that path;
  the centroid leaves, each of its child subtrees becomes a component (a node below finds its new top in the rows of its member),
  and the rest stays one, its path lighter by the centroid's weight.
No part weighs over half, so rounds grow with the logarithm of the rows, however deep or wide the trie is. While components
weigh more than `max_local` a round is a few joins over all of them; smaller ones, each whole, go on inside tasks, many at a time.

Defined results: rows without a conversation id are left out; null role or text is the empty string; turns in order, null first,
those at one turn by a hash of role and text, repeated rows one after the other; an empty table has no nodes; only the named
columns are read. The digest of a node's members is the hash of one long string, which cannot be split: ids are joined in chunks
and run through it in order, with bounded memory.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelspark.session import discard, written

MAX_LOCAL = 4096
CHUNK_IDS = 1024
LANES = ("s0", "s1", "s2", "s3")
SCHEMA = "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string"


def _name(sums: list[Column], depth: Column) -> Column:
    return F.md5(F.concat_ws(",", *[s.cast("string") for s in sums], depth.cast("string")))


def numbered_turns(turns: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv, part, pos, code, n_chars, length): turns numbered from 1; code is a hash of role and text. Parts are ranges of (conv, turn, code)."""
    who, what = F.coalesce(F.col(role).cast("string"), F.lit("")), F.coalesce(F.col(text).cast("string"), F.lit(""))
    code = F.md5(F.concat(F.octet_length(who).cast("string"), F.lit(":"), who, what))
    slim = turns.where(F.col(conv).isNotNull()).select(F.col(conv).cast("bigint").alias("conv"), F.col(turn).alias("turn"), code.alias("code"), F.char_length(what).cast("bigint").alias("n_chars"))
    order = [F.asc_nulls_first("turn"), F.col("code")]
    placed = written(slim.repartitionByRange("conv", *order).withColumn("part", F.spark_partition_id()), "turns")
    sizes = placed.groupBy("conv", "part").agg(F.count("*").alias("size"))
    whole = Window.partitionBy("conv")  # a row for each part of a conversation
    spans = sizes.select("conv", "part", F.coalesce(F.sum("size").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("size").over(whole).alias("length"))
    place = F.row_number().over(Window.partitionBy("conv", "part").orderBy(*order))
    out = written(placed.join(spans, ["conv", "part"]).select("conv", "part", (F.col("before") + place).alias("pos"), "code", "n_chars", "length"), "numbered")
    discard(placed)
    return out


def rebuilt(numbered: DataFrame, step: int, heads: int) -> tuple[DataFrame, DataFrame]:
    """Each conversation (conv, h, k, total), and the turns (conv, part, d, code, n_chars, total) it consists of after its first h have become the k first of its hundred."""
    first = numbered.where((F.col("conv") % step == 0) & (F.col("pos") < heads)).groupBy(F.col("conv").alias("base")).agg(F.array_sort(F.collect_list(F.struct("pos", "code", "n_chars"))).alias("first"))
    h = (F.crc32(F.col("conv").cast("string").cast("binary")) % heads).cast("int")
    convs = numbered.groupBy("conv").agg(F.max("length").alias("length")).withColumn("h", h).withColumn("base", F.col("conv") - F.col("conv") % step)
    none = F.array().cast("array<struct<pos:bigint,code:string,n_chars:bigint>>")
    known = convs.join(first, "base", "left").withColumn("head", F.slice(F.coalesce("first", none), F.lit(1), F.col("h"))).withColumn("k", F.size("head").cast("bigint"))
    known = written(known.select("conv", "h", "k", "head", (F.col("k") + F.greatest(F.col("length") - F.col("h"), F.lit(0))).alias("total")), "conversations")
    taken = known.select("conv", F.lit(-1).alias("part"), "total", F.explode("head").alias("t")).select("conv", "part", F.col("t.pos").alias("d"), "t.code", "t.n_chars", "total")
    own = numbered.join(known.select("conv", "h", "k", "total"), "conv").where("pos > h").select("conv", "part", (F.col("pos") - F.col("h") + F.col("k")).alias("d"), "code", "n_chars", "total")
    return known.drop("head"), taken.unionByName(own)


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv, d, key, parent_key, n_chars, total): each turn with the name of the prefix that ends at it, and of the one before."""
    tag = F.md5(F.concat("code", F.lit(":"), F.col("d").cast("string")))
    lanes = [F.conv(F.substring(tag, 8 * i + 1, 8), 16, 10).cast("bigint").alias(s) for i, s in enumerate(LANES)]
    tagged = written(turns.select("conv", "part", "d", "n_chars", "total", *lanes), "tagged")
    sums = tagged.groupBy("conv", "part").agg(*[F.sum(s).alias(s) for s in LANES])
    before = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each part of a conversation
    carried = sums.select("conv", "part", *[F.coalesce(F.sum(s).over(before), F.lit(0)).alias(f"c_{s}") for s in LANES])
    within = Window.partitionBy("conv", "part").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    joined = tagged.join(carried, ["conv", "part"]).select("*", *[(F.col(f"c_{s}") + F.sum(s).over(within)).alias(f"t_{s}") for s in LANES])
    now, last = [F.col(f"t_{s}") for s in LANES], [F.col(f"t_{s}") - F.col(s) for s in LANES]
    out = written(joined.select("conv", "d", _name(now, F.col("d")).alias("key"), _name(last, F.col("d") - 1).alias("parent_key"), "n_chars", "total"), "prefixes")
    discard(tagged)
    return out


def trie_nodes(rows: DataFrame, known: DataFrame) -> DataFrame:
    """(conv, depth, key, parent, n_convs, n_children, leaves, saved, weight): the nodes, each called by its smallest member and depth."""
    nodes = rows.groupBy("d", "key").agg(F.min("conv").alias("conv"), F.count("*").alias("n_convs"), F.min("parent_key").alias("parent_key"), F.min("n_chars").alias("n_chars"), F.sum(F.col("total") - F.col("d") + 1).alias("weight"))
    root = known.agg(F.min("conv").alias("conv"), F.count("*").alias("n_convs"), F.sum(F.col("total") + 1).alias("weight")).where("conv is not null")
    zero = [F.lit(0)] * len(LANES)
    root = root.select(F.lit(0).cast("bigint").alias("d"), _name(zero, F.lit(0)).alias("key"), "conv", "n_convs", F.lit(None).cast("string").alias("parent_key"), F.lit(0).cast("bigint").alias("n_chars"), "weight")
    nodes = written(nodes.unionByName(root), "nodes")
    above = nodes.select(F.col("key").alias("parent_key"), F.col("conv").alias("parent"))
    fan = nodes.groupBy(F.col("parent_key").alias("key")).agg(F.count("*").alias("n_children"))
    tree = nodes.join(above, "parent_key", "left").join(fan, "key", "left")
    n_children = F.coalesce("n_children", F.lit(0)).cast("bigint")
    out = tree.select("conv", F.col("d").alias("depth"), "key", "parent", "n_convs", n_children.alias("n_children"), (n_children == 0).cast("bigint").alias("leaves"), ((F.col("n_convs") - 1) * F.col("n_chars")).alias("saved"), "weight")
    out = written(out, "tree")
    discard(nodes)
    return out


# centroid decomposition

STATE = ("conv", "depth", "parent", "top_conv", "top_depth", "whole", "rest", "leaves", "saved", "sum_leaves", "sum_saved")
TOP = ["top_conv", "top_depth"]
SALTS = 16


def _salt() -> Column:
    return F.pmod(F.xxhash64("conv", "depth"), F.lit(SALTS).cast("bigint"))


def _salted(of_components: DataFrame) -> DataFrame:
    """A row of each component for every salt: the nodes of one component are many tasks' work."""
    return of_components.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))


def _round(state: DataFrame, places: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One centroid of every component leaves: (nodes that remain, centroids with their totals, the written step both read)."""
    found = state.where("2 * rest >= whole").groupBy(*TOP).agg(F.min(F.struct("rest", "conv", "depth")).alias("c"))
    found = found.select(*TOP, F.col("c.conv").alias("c_conv"), F.col("c.depth").alias("c_depth"), F.col("c.rest").alias("c_rest"))
    joined = state.withColumn("salt", _salt()).join(_salted(found), [*TOP, "salt"])
    level = joined.where("depth <= c_depth").withColumn("under", F.lit(False)).withColumn("u", F.lit(None).cast("bigint"))
    at = places.select("conv", F.col("depth").alias("at"), F.col("node").alias("u"), F.col("parent").alias("u_parent"))
    lower = joined.where("depth > c_depth").withColumn("at", F.col("c_depth") + 1).join(at, ["conv", "at"])
    lower = lower.withColumn("under", F.col("u_parent") == F.col("c_conv")).drop("at", "u_parent")
    seen = written(level.unionByName(lower).withColumn("is_c", (F.col("conv") == F.col("c_conv")) & (F.col("depth") == F.col("c_depth"))), "round")
    totals = seen.where("under or is_c").groupBy(*TOP).agg(F.sum("leaves").alias("t_leaves"), F.sum("saved").alias("t_saved"))
    wholes = seen.where("under").groupBy("u", F.col("c_depth").alias("u_depth")).agg(F.max("rest").alias("u_whole"))
    on_path = 2 * F.col("rest") >= F.col("whole")
    stay = seen.where("not under").join(_salted(totals), [*TOP, "salt"])
    add = lambda s: F.col(f"sum_{s}") + F.when(on_path, F.col(f"t_{s}")).otherwise(0)
    stay = stay.select("is_c", "conv", "depth", "parent", *TOP, (F.col("whole") - F.col("c_rest")).alias("whole"), (F.col("rest") - F.when(on_path, F.col("c_rest")).otherwise(0)).alias("rest"), "leaves", "saved", add("leaves").alias("sum_leaves"), add("saved").alias("sum_saved"))
    gone = seen.where("under").withColumn("u_depth", F.col("c_depth")).join(_salted(wholes), ["u", "u_depth", "salt"])
    gone = gone.select("conv", "depth", "parent", F.col("u").alias("top_conv"), (F.col("u_depth") + 1).alias("top_depth"), F.col("u_whole").alias("whole"), "rest", "leaves", "saved", "sum_leaves", "sum_saved")
    return stay.where("not is_c").drop("is_c").unionByName(gone), stay.where("is_c").select("conv", "depth", "sum_leaves", "sum_saved"), seen


def decompose(parent: np.ndarray, depth: np.ndarray, top: np.ndarray, whole: np.ndarray, rest: np.ndarray, values: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """Subtree totals of whole components: parent and top as places in the arrays (a top is its own parent); whole, by place of the top, and rest are used up; values and sums have a row per column."""
    n = len(parent)
    jumps = [parent]
    for _ in range(int(max(1, depth.max() - depth.min())).bit_length() if n else 0):
        jumps.append(jumps[-1][jumps[-1]])
    left = np.arange(n)
    while len(left):
        comp = top[left]
        path = left[2 * rest[left] >= whole[comp]]
        order = np.lexsort((rest[path], top[path]))
        ordered = path[order]
        first = np.append(True, top[ordered[1:]] != top[ordered[:-1]])
        centroid = np.full(n, -1)
        centroid[top[ordered[first]]] = ordered[first]
        c = centroid[comp]
        steps = depth[left] - depth[c] - 1
        up = np.where(steps >= 0, left, -1)
        for k, jump in enumerate(jumps):
            go = (steps >= 0) & (steps >> k & 1 == 1)
            up[go] = jump[up[go]]
        under = (steps >= 0) & (parent[up] == c) & (up != c)
        inside = under | (left == c)
        total = np.zeros((len(values), n), values.dtype)
        for t, v in zip(total, values):
            np.add.at(t, comp[inside], v[left[inside]])
        sums[:, path] += total[:, top[path]]
        weight = rest[centroid[top[path]]].copy()
        tops = np.unique(comp)
        whole[tops] -= rest[centroid[tops]]
        rest[path] -= np.where(path == centroid[top[path]], 0, weight)
        whole[up[under]] = rest[up[under]]
        top[left[under]] = up[under]
        left = left[left != c]
    return sums


def _local(rows_at_once: int = 1 << 16):
    """Whole components, in order of their tops -> (conv, depth, sum_leaves, sum_saved)."""

    def solve(batch: pa.Table) -> pa.RecordBatch:
        col = {c: batch.column(c).to_numpy() for c in STATE if c != "parent"}
        parent = batch.column("parent").fill_null(0).to_numpy()
        ids, code = np.unique(np.concatenate([col["conv"], parent, col["top_conv"]]), return_inverse=True)
        n, span = len(parent), int(col["depth"].max()) + 2
        own, above, top = code[:n] * span + col["depth"], code[n : 2 * n] * span + col["depth"] - 1, code[2 * n :] * span + col["top_depth"]
        order = np.argsort(own)
        find = lambda want: order[np.minimum(np.searchsorted(own, want, sorter=order), n - 1)]
        top = find(top)
        is_top = top == np.arange(n)
        up = np.where(is_top, np.arange(n), find(above))
        whole = np.zeros(n, np.int64)
        whole[is_top] = col["whole"][is_top]
        sums = decompose(up, col["depth"], top, whole, col["rest"].copy(), np.stack([col["leaves"], col["saved"]]), np.stack([col["sum_leaves"], col["sum_saved"]]))
        return pa.RecordBatch.from_arrays([pa.array(col["conv"]), pa.array(col["depth"]), pa.array(sums[0]), pa.array(sums[1])], names=["conv", "depth", "sum_leaves", "sum_saved"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            if held.num_rows >= rows_at_once:
                conv, depth = held.column("top_conv").to_numpy(), held.column("top_depth").to_numpy()
                cut = np.flatnonzero((conv[1:] != conv[:-1]) | (depth[1:] != depth[:-1]))
                if len(cut):
                    k = int(cut[-1]) + 1  # the last component may go on
                    yield solve(held.slice(0, k).combine_chunks())
                    held = held.slice(k).combine_chunks()
        if held is not None and held.num_rows:
            yield solve(held.combine_chunks())

    return rows


def subtree_totals(tree: DataFrame, rows: DataFrame, max_local: int = MAX_LOCAL) -> DataFrame:
    """(conv, depth, sum_leaves, sum_saved) of every node's subtree, by centroid decomposition. The steps it reads stay written."""
    root = tree.where("depth = 0").select("conv", "weight").first()
    zero = F.lit(0).cast("bigint")
    state = tree.select("conv", "depth", "parent", F.lit(root["conv"]).cast("bigint").alias("top_conv"), zero.alias("top_depth"), F.lit(root["weight"]).cast("bigint").alias("whole"), F.col("weight").alias("rest"), "leaves", "saved", zero.alias("sum_leaves"), zero.alias("sum_saved"))
    small, done, places = [], [], None
    large = state if root["weight"] > max_local else None
    if large is None:
        small.append(state)
    while large is not None:
        if places is None:
            places = written(rows.select("conv", F.col("d").alias("depth"), "key").join(tree.select("key", F.col("conv").alias("node"), "parent"), "key").drop("key"), "places")
        left, centroids, seen = _round(large, places)
        left, gone = written(left, "components"), written(centroids, "centroids")
        discard(seen)
        done.append(gone)
        small.append(left.where(F.col("whole") <= max_local))
        large = left.where(F.col("whole") > max_local)
        large = None if large.isEmpty() else large
    pending = small[0]
    for s in small[1:]:
        pending = pending.unionByName(s)
    out = pending.repartition(*TOP).sortWithinPartitions(*TOP).select(*STATE).mapInArrow(_local(), "conv bigint, depth bigint, sum_leaves bigint, sum_saved bigint")
    for d in done:
        out = out.unionByName(d)
    return out


# members that end at a node


def _digests():
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest = None, None
        for batch in batches:
            out: list[tuple] = []
            for key, ids in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist()):
                if key != now:
                    if now is not None:
                        out.append((now, digest.hexdigest()))
                    now, digest = key, hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.string()) for i in range(2)], names=["key", "ends_sha256"])
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([digest.hexdigest()])], names=["key", "ends_sha256"])

    return rows


def end_digests(rows: DataFrame, known: DataFrame) -> DataFrame:
    """(key, ends_sha256) of the nodes at which conversations end: SHA-256 of their ids, ascending, joined by commas."""
    ends = rows.where("d = total").select("key", "conv").unionByName(known.where("total = 0").select(_name([F.lit(0)] * len(LANES), F.lit(0)).alias("key"), "conv"))
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv")), lambda c: c.cast("string")), ",")
    chunks = ends.groupBy("key", F.floor(F.col("conv") / CHUNK_IDS).alias("chunk")).agg(ids.alias("ids"))  # CHUNK_IDS ids at most
    return chunks.repartition("key").sortWithinPartitions("key", "chunk").select("key", "ids").mapInArrow(_digests(), "key string, ends_sha256 string")


def conversation_trie(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", step: int = 100, heads: int = 6, max_local: int = MAX_LOCAL) -> DataFrame:
    """One row per node of the trie of rebuilt conversations: see SCHEMA."""
    numbered = numbered_turns(turns, conv, turn, role, text)
    known, own = rebuilt(numbered, step, heads)
    rows = prefixes(own)
    discard(numbered)
    tree = trie_nodes(rows, known)
    if tree.isEmpty():
        return turns.sparkSession.createDataFrame([], SCHEMA)
    totals = subtree_totals(tree, rows, max_local)
    whole = tree.join(totals, ["conv", "depth"]).join(end_digests(rows, known), "key", "left")
    none = hashlib.sha256(b"").hexdigest()
    return whole.select(F.col("conv").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", F.col("sum_leaves").alias("n_leaves"), F.col("sum_saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))
