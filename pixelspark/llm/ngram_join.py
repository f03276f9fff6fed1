"""N-gram Jaccard join with a count-vector R-tree.

The set of a text is its distinct word shingles (64-bit hashes). Tokens are hashed into groups; a set is the point of its
group counts. Two sets with Jaccard similarity of at least t overlap in t/(1+t) of their summed sizes, and the overlap
is at most the sum over groups of the smaller count: this bound, for pairs of points and for pairs of tree nodes (by
their upper corners), prunes a descent of the tree against itself; what survives is verified on the whole sets.

Most points cannot have a partner at all, so three exact tests stand before the tree:
* support: with partners of at least t n tokens, a set of n must find n // 4 of its first n - ceil(t n) + n // 4 tokens in some
  other set. Tokens travel as six bytes (hash inside a bucket, place of the set in its batch) and only counts come back;
* full support: sets left are read again, and at least ceil(t n) of all their tokens must stand in another one of them;
* routing by single coordinates of the finest grouping (one group per token), rarest first by counts over all sets left: a pair
  meets at its first common token, at places i and j at most, and can share no more than n - i and m - j tokens. A set is
  sent to its n - ceil(t n) + 1 rarest tokens, each with the size of the largest partner its place there allows.

All links come out of trees. At every token one set is the pivot; the sets that meet a pivot, at whatever tokens, are packed into trees of
bounded size, and the pivot's point descends each of them: corners first, then points, then the sets. After that only tokens
where sets of different components could still be partners are open. Their sets are cut into tiles of bounded size; every pair of
tiles is joined by descending their trees at once, verified there, and gives the edges of a spanning forest. So no step holds
or makes all pairs of a group.

Nothing is dropped or capped: the result has exactly the components of all links. Sets are told apart by 128-bit
fingerprints; in the verification a token is its 64-bit hash.

Defined results: a null, empty or blank text has an empty set, size 0, and is its own component; fewer words than a
shingle make one shingle of the whole sequence; exact copies link; rows that repeat an id are rows of their own, each with
the component of its text; an empty table gives no rows. Only key and text are read, so extra columns cannot clash. Null keys
keep their row, with the component of their set's smallest key, and link others as any row does.
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
from ._text import LOWER, U64, mix64, slices, span_hashes, stream64, words

BATCH_TOKENS, BATCH_SETS, BATCH_ROWS = 1_000_000, 60_000, 200_000
BUCKET_TOKENS = 2_000_000
SHARD_TOKENS = 250_000
TILE_SETS, TILE_TOKENS = 256, 1_000_000
TREE_DIMS, FANOUT = 64, 8
CODES = stream64(29, 64)
SUPPORT = np.dtype([("hash", "<u4"), ("place", "<u2")])
SHARED = 0xFFFF  # the place of a token that several sets of its batch hold


def shingle_sets(raw: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of each text, and n + 1 offsets of the texts in them."""
    low = LOWER[raw]
    starts, ends, in_words = words(low, at)
    hashes = span_hashes(low, starts, ends)
    counts = np.diff(in_words)
    sizes = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    begin = np.concatenate([[0], np.cumsum(sizes)])
    out = np.zeros(begin[-1], U64)
    if len(hashes) >= width:
        rolled = np.zeros(len(hashes) - width + 1, U64)
        for j in range(width):
            rolled += hashes[j : len(hashes) - width + 1 + j] * CODES[j]
        rolled = mix64(rolled)
        inside = np.ones(len(rolled), bool)  # windows that do not run into the next text
        for j in range(1, width):
            edge = in_words[1:-1] - j
            inside[edge[(edge >= 0) & (edge < len(rolled))]] = False
        long = np.repeat(counts >= width, sizes)
        out[long] = rolled[inside]
    for i in np.flatnonzero((counts > 0) & (counts < width)):
        own = hashes[in_words[i] : in_words[i + 1]]
        out[begin[i]] = mix64((own * CODES[: len(own)]).sum(dtype=U64, keepdims=True) + CODES[32 + len(own)])[0]
    for i in np.flatnonzero(sizes > 1):
        out[begin[i] : begin[i + 1]].sort()
    new = np.ones(len(out), bool)
    new[1:] = out[1:] != out[:-1]
    new[begin[:-1][sizes > 0]] = True
    kept = np.concatenate([[0], np.cumsum(new)])
    return out[new], kept[begin]


def fingerprints(tokens: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Two 64-bit hashes per set, whatever the order of its tokens: (n, 2)."""
    sums = []
    for k in (40, 42):
        total = np.concatenate([np.zeros(1, U64), np.cumsum(mix64(tokens ^ CODES[k]))])
        sums.append(mix64(total[at[1:]] - total[at[:-1]] + np.diff(at).astype(U64) * CODES[k + 1]))
    return np.stack(sums, axis=1).view(np.int64)


def enough(overlap, n, m, percent: int):
    """overlap / (n + m - overlap) >= percent / 100, in integers."""
    return (100 + percent) * overlap >= percent * (n + m)


def loose(n: np.ndarray, percent: int) -> np.ndarray:
    """How many of n tokens a partner may lack: n - ceil(percent n / 100)."""
    return n - (percent * n + 99) // 100


def by_bucket(tokens: np.ndarray, n_buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(order by bucket, bucket of each run, run starts, run ends). A token's bucket and its hash there are independent bits."""
    bucket = (tokens & U64(0xFFFFF)) % U64(n_buckets)
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    edge = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.zeros(0, np.int64)
    return order, bucket[edge].astype(np.int64), edge, np.append(edge[1:], len(bucket)).astype(np.int64)


def hash_in_bucket(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> U64(20)).astype("<u4")


# support

ROUTED = "bucket bigint, batch bigint, kind int, data binary"
ENTRIES, COUNTS, ROWS = range(3)


def pack_rows(arrays: list[np.ndarray]) -> bytes:
    return np.array([len(a) for a in arrays], "<i8").tobytes() + b"".join(a.tobytes() for a in arrays)


ROW_TYPES = ("<i8", "<u1", "<i8", "<i8", "<u4", "<i8", "<i8", "<i8")  # key, key is valid, text id twice, place of the set; per set fingerprint twice, size


def unpack_rows(data: bytes) -> list[np.ndarray]:
    sizes, at, out = np.frombuffer(data, "<i8", len(ROW_TYPES)), 8 * len(ROW_TYPES), []
    for n, kind in zip(sizes, ROW_TYPES):
        out.append(np.frombuffer(data, kind, n, at))
        at += int(n) * np.dtype(kind).itemsize
    return out


def _route_support(width: int, percent: int, n_buckets: int):
    """Texts in batches: per batch and bucket the first tokens of its distinct sets, and one row (bucket < 0) of the batch's keys, texts and sets."""

    def flush(rows: list, sets: list[np.ndarray], sizes: list[int], tokens: list[np.ndarray]) -> pa.RecordBatch:
        marks, n = np.array(sets, np.int64).reshape(-1, 2), np.array(sizes, np.int64)
        with np.errstate(over="ignore"):
            batch = int(mix64((marks[:, 0].view(U64) * (np.arange(len(n), dtype=U64) * CODES[44] + CODES[45])).sum(keepdims=True) + U64(len(rows[0])))[0].astype(np.int64)) if len(n) else 0
        table = pack_rows([*[np.concatenate(c).astype(t) for c, t in zip(rows, ROW_TYPES)], np.ascontiguousarray(marks[:, 0]), np.ascontiguousarray(marks[:, 1]), n])
        out = [(-1 - (batch & 0xFFFFFFFF), ROWS, table)]
        if sum(map(len, tokens)):
            token, place = np.concatenate(tokens), np.repeat(np.arange(len(tokens)), [len(t) for t in tokens])
            order = np.argsort(token, kind="stable")
            token, place = token[order], place[order]
            first = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
            many = np.diff(np.append(first, len(token))) > 1
            shared = np.repeat(many, np.diff(np.append(first, len(token))))
            known = np.bincount(place[shared], minlength=len(n))
            known_at = np.flatnonzero(known)
            if len(known_at):  # sets of one batch support each other here and now; others learn it from one entry per token
                out.append((-1 - (batch & 0xFFFFFFFF), COUNTS, known_at.astype("<u2").tobytes() + known[known_at].astype("<u4").tobytes()))
            entries = np.empty(len(first), SUPPORT)
            entries["hash"], entries["place"] = hash_in_bucket(token[first]), np.where(many, SHARED, place[first])
            order, bucket, start, end = by_bucket(token[first], n_buckets)
            entries = entries[order]
            out += [(int(b), ENTRIES, entries[i:j].tobytes()) for b, i, j in zip(bucket, start, end)]
        columns = pa.array([x[0] for x in out], pa.int64()), pa.array([batch] * len(out), pa.int64()), pa.array([x[1] for x in out], pa.int32()), pa.array([x[2] for x in out], pa.binary())
        return pa.RecordBatch.from_arrays(list(columns), names=["bucket", "batch", "kind", "data"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[int, int], int] = {}
        held, sets, sizes, chosen, size, n_rows = [[] for _ in range(5)], [], [], [], 0, 0
        for batch, raw, at in slices(batches, "text"):
            tokens, ends = shingle_sets(raw, at, width)
            marks, n = fingerprints(tokens, ends), np.diff(ends)
            for i in range(len(n)):
                mark = (int(marks[i, 0]), int(marks[i, 1]))
                place = seen.get(mark)
                if place is None:
                    place = seen[mark] = len(sets)
                    sets.append(mark)
                    sizes.append(int(n[i]))
                    take = min(n[i], loose(n[i], percent) + max(1, n[i] // 4))
                    chosen.append(tokens[ends[i] : ends[i] + take])
                    size += take
                held[4].append(np.array([place]))
            key = batch.column("key")
            held[0].append(key.fill_null(0).to_numpy())
            held[1].append(key.is_valid().to_numpy(zero_copy_only=False))
            held[2].append(batch.column("text_a").to_numpy())
            held[3].append(batch.column("text_b").to_numpy())
            n_rows += len(n)
            if size > BATCH_TOKENS or len(sets) > BATCH_SETS - 10_000 or n_rows > BATCH_ROWS:
                yield flush(held, sets, sizes, chosen)
                seen, held, sets, sizes, chosen, size, n_rows = {}, [[] for _ in range(5)], [], [], [], 0, 0
        if n_rows:
            yield flush(held, sets, sizes, chosen)

    return rows


def _support(table: pa.Table) -> pa.Table:
    """A bucket's entries -> per batch how many tokens of each set another set holds too. Rows of batches pass."""
    buckets, batches = table.column("bucket").to_numpy(), table.column("batch").to_numpy()
    if buckets[0] < 0:
        return table.select(["batch", "kind", "data"])
    parts = [np.frombuffer(x.as_buffer(), SUPPORT) for x in table.column("data")]
    entries, of = np.concatenate(parts), np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    order = np.argsort(entries["hash"], kind="stable")
    hashes, place, of = entries["hash"][order], entries["place"][order], of[order]
    first = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
    size = np.diff(np.append(first, len(hashes)))
    held = (np.repeat(size, size) > 1) & (place != SHARED)
    out_batch, out_data = [], []
    pairs, counts = np.unique(of[held] * (1 << 16) + place[held], return_counts=True)
    of, place = pairs >> 16, pairs & 0xFFFF
    for k in np.unique(of):
        mine = slice(np.searchsorted(of, k), np.searchsorted(of, k, "right"))
        out_batch.append(batches[k])
        out_data.append(place[mine].astype("<u2").tobytes() + counts[mine].astype("<u4").tobytes())
    return pa.table({"batch": pa.array(out_batch, pa.int64()), "kind": pa.array([COUNTS] * len(out_batch), pa.int32()), "data": pa.array(out_data, pa.binary())})


SUPPORTED = "key bigint, text_a bigint, text_b bigint, set_a bigint, set_b bigint, n bigint, supported boolean"


def _gather(percent: int):
    """A batch's rows and the counts that came back -> its documents, each with its set and whether the set has support."""

    def rows(table: pa.Table) -> pa.Table:
        held: dict[int, list[bytes]] = {COUNTS: [], ROWS: []}
        for kind, x in zip(table.column("kind").to_pylist(), table.column("data")):
            held[kind].append(x.as_py())
        if not held[ROWS]:
            raise RuntimeError("a batch of texts came in two versions: its input is not deterministic")
        out = []
        for rows in map(unpack_rows, held[ROWS]):  # several, if batches hold the same sets
            key, valid, text_a, text_b, place, set_a, set_b, n = rows
            found = np.zeros(len(n), np.int64)
            for data in held[COUNTS]:
                k = len(data) // 6
                np.add.at(found, np.frombuffer(data, "<u2", k), np.frombuffer(data, "<u4", k, 2 * k))
            good = (found >= np.maximum(1, (percent * n + 99) // 100 // 4)) & (n > 0)
            out.append(pa.table({
                "key": pa.array(key, mask=valid == 0), "text_a": pa.array(text_a), "text_b": pa.array(text_b),
                "set_a": pa.array(set_a[place]), "set_b": pa.array(set_b[place]), "n": pa.array(n[place]), "supported": pa.array(good[place]),
            }))
        return pa.concat_tables(out)

    return rows


# full support and routing


def _first_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Equal texts of a batch once, so that no text comes from a task as often as it stands in the table."""
    for batch in batches:
        ids = np.stack([batch.column(c).to_numpy() for c in ("text_a", "text_b")], axis=1)
        _, first = np.unique(ids, axis=0, return_index=True)
        yield batch.take(pa.array(np.sort(first)))


SHARD = "shard bigint, sets binary, sizes binary, tokens binary"


def _shards(width: int):
    """Texts -> rows of several sets: their fingerprints, sizes and sorted tokens, numbered by task and place."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, size = TaskContext.get().partitionId() << 24, [], 0

        def row() -> pa.RecordBatch:
            sets, sizes, tokens = (np.concatenate([h[i] for h in held]) for i in range(3))
            return pa.RecordBatch.from_arrays([pa.array([number]), *[pa.array([np.ascontiguousarray(x).tobytes()], pa.binary()) for x in (sets, sizes, tokens)]], names=["shard", "sets", "sizes", "tokens"])

        for _, raw, at in slices(batches, "text", SHARD_TOKENS * 4):
            tokens, ends = shingle_sets(raw, at, width)
            held.append((fingerprints(tokens, ends), np.diff(ends), tokens))
            size += len(tokens)
            if size > SHARD_TOKENS:
                yield row()
                number, held, size = number + 1, [], 0
        if held:
            yield row()

    return rows


def _route_counts(n_buckets: int):
    """Per shard and bucket the distinct tokens and in how many of the shard's sets each stands."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, data in zip(batch.column("shard").to_pylist(), batch.column("tokens")):
                tokens, counts = np.unique(np.frombuffer(data.as_buffer(), U64), return_counts=True)
                order, bucket, start, end = by_bucket(tokens, n_buckets)
                hashes, counts = hash_in_bucket(tokens[order]), np.minimum(counts[order], 0xFFFF).astype("<u2")
                packed = [hashes[i:j].tobytes() + counts[i:j].tobytes() for i, j in zip(start, end)]
                yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array([shard] * len(packed), pa.int64()), pa.array(packed, pa.binary())], names=["bucket", "shard", "data"])

    return rows


def _levels(table: pa.Table) -> pa.Table:
    """A bucket's tokens -> for each shard a byte per token, in its order: 0 for tokens of one set, else by eighths of powers of two."""
    hashes, counts = [], []
    for x in table.column("data"):
        data = x.as_buffer()
        k = len(data) // 6
        hashes.append(np.frombuffer(data, "<u4", k))
        counts.append(np.frombuffer(data, "<u2", k, 4 * k))
    _, group = np.unique(np.concatenate(hashes), return_inverse=True)
    total = np.bincount(group, np.concatenate(counts))
    level = np.minimum(np.rint(8 * np.log2(total)), 255).astype(np.uint8)[group]
    ends = np.cumsum([len(h) for h in hashes])
    levels = [level[e - len(h) : e].tobytes() for h, e in zip(hashes, ends)]
    return pa.table({"shard": table.column("shard"), "bucket": table.column("bucket"), "levels": pa.array(levels, pa.binary())})


KEPT = "node bigint, set_a bigint, set_b bigint, n bigint, tokens binary, routes array<struct<token:bigint,reach:bigint>>"


def _routes(percent: int, n_buckets: int):
    """A shard and the levels of its tokens -> its sets with full support, each with its rarest tokens and the largest partner it may meet there."""

    def rows(shards: pa.Table, levels: pa.Table) -> pa.Table:
        out: list[list] = [[] for _ in range(7)]
        for shard, sets, sizes, data in zip(*(shards.column(c) for c in ("shard", "sets", "sizes", "tokens"))):
            sets, n, tokens = np.frombuffer(sets.as_buffer(), "<i8").reshape(-1, 2), np.frombuffer(sizes.as_buffer(), "<i8"), np.frombuffer(data.as_buffer(), U64)
            distinct, group = np.unique(tokens, return_inverse=True)
            order, bucket, start, end = by_bucket(distinct, n_buckets)
            level = np.zeros(len(distinct), np.uint8)
            answer = dict(zip(levels.column("bucket").to_pylist(), levels.column("levels")))
            for b, i, j in zip(bucket, start, end):
                level[order[i:j]] = np.frombuffer(answer[int(b)].as_buffer(), np.uint8)
            level = level[group]
            begin = np.concatenate([[0], np.cumsum(n)])
            owner = np.repeat(np.arange(len(n)), n)
            full = np.bincount(owner[level > 0], minlength=len(n)) >= n - loose(n, percent)
            for i in np.flatnonzero(full):
                own, at = tokens[begin[i] : begin[i + 1]], level[begin[i] : begin[i + 1]]
                first = np.argsort(at, kind="stable")[: loose(n[i], percent) + 1]  # tokens are sorted: the order is (level, token)
                rank = np.flatnonzero(at[first] > 0)
                reach = ((100 + percent) * (n[i] - rank) - percent * n[i]) // percent
                for column, value in zip(out, ((shard.as_py() << 20) + i, sets[i, 0], sets[i, 1], n[i], own.tobytes(), own[first[rank]].view(np.int64), reach)):
                    column.append(value)
        lengths = np.concatenate([[0], np.cumsum([len(x) for x in out[5]])]).astype(np.int32)
        flat = [pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64()) for x in out[5:]]
        routes = pa.ListArray.from_arrays(pa.array(lengths), pa.StructArray.from_arrays(flat, ["token", "reach"]))
        return pa.table([*[pa.array(x, pa.int64()) for x in out[:4]], pa.array(out[4], pa.binary()), routes], names=["node", "set_a", "set_b", "n", "tokens", "routes"])

    return rows


# the tree


def overlap(x: np.ndarray, y: np.ndarray) -> int:
    both = np.concatenate([x, y])
    both.sort(kind="stable")
    return int((both[1:] == both[:-1]).sum())


def count_vector(tokens: np.ndarray, groups: int) -> np.ndarray:
    """How many tokens fall into each group, the groups being a power of two."""
    return np.bincount((tokens & U64(groups - 1)).astype(np.int64), minlength=groups)


def overlap_bound(x: np.ndarray, y: np.ndarray) -> int:
    """The sum of coordinate minima in four groups or more to a token."""
    groups = 1 << max(6, int(4 * min(len(x), len(y)) - 1).bit_length())
    return int(np.minimum(count_vector(x, groups), count_vector(y, groups)).sum())


class CountTree:
    """An R-tree over count vectors, packed bottom up: nodes of FANOUT children, in the order of size and of the widest coordinates.

    Level 0 holds the points; each level above has the upper corners, and the least and largest sizes and reaches, of its children.
    """

    def __init__(self, n: np.ndarray, reach: np.ndarray, vectors: np.ndarray):
        wide = np.argsort(-vectors.var(axis=0))[:2] if len(n) else [0, 0]
        slabs = np.array_split(np.lexsort((vectors[:, wide[0]], n)), max(1, int(np.sqrt(len(n) / FANOUT))))
        self.order = np.concatenate([s[np.lexsort((vectors[s, wide[1]], vectors[s, wide[0]]))] for s in slabs])
        self.levels = [(vectors[self.order], n[self.order], n[self.order], reach[self.order])]
        while len(self.levels[-1][0]) > 1:
            top, least, most, far = self.levels[-1]
            cut = np.arange(0, len(top), FANOUT)
            self.levels.append((np.maximum.reduceat(top, cut), np.minimum.reduceat(least, cut), np.maximum.reduceat(most, cut), np.maximum.reduceat(far, cut)))


def tree_pairs(a: CountTree, b: CountTree, percent: int) -> Iterator[tuple[int, int]]:
    """Pairs of points (place in a, place in b) that the bounds leave, by descending both trees at once."""
    depth = max(len(a.levels), len(b.levels)) - 1
    x, y = np.zeros(1, np.int64), np.zeros(1, np.int64)
    while depth >= 0:
        la, lb = min(depth, len(a.levels) - 1), min(depth, len(b.levels) - 1)
        top_a, least_a, most_a, far_a = a.levels[la]
        top_b, least_b, most_b, far_b = b.levels[lb]
        keep = (least_a[x] <= far_b[y]) & (least_b[y] <= far_a[x])
        x, y = x[keep], y[keep]
        good = np.zeros(len(x), bool)
        for i in range(0, len(x), 4096):  # bounded memory, however many pairs are open
            s = slice(i, i + 4096)
            good[s] = enough(np.minimum(top_a[x[s]], top_b[y[s]]).sum(axis=1), least_a[x[s]], least_b[y[s]], percent)
        x, y = x[good], y[good]
        if depth == 0:
            break
        x, y = _children(x, y, la, lb, min(depth - 1, len(a.levels) - 1), min(depth - 1, len(b.levels) - 1), len(a.levels[max(la - 1, 0)][0]), len(b.levels[max(lb - 1, 0)][0]))
        depth -= 1
    yield from zip(a.order[x].tolist(), b.order[y].tolist())


def _children(x, y, la: int, lb: int, to_a: int, to_b: int, n_a: int, n_b: int) -> tuple[np.ndarray, np.ndarray]:
    fan_a, fan_b = (FANOUT if la > to_a else 1), (FANOUT if lb > to_b else 1)
    i, j = np.divmod(np.arange(fan_a * fan_b), fan_b)
    x, y = (x[:, None] * fan_a + i).ravel(), (y[:, None] * fan_b + j).ravel()
    there = (x < n_a) & (y < n_b)
    return x[there], y[there]


def _tile(percent: int):
    """The sets of two tiles of a token -> edges between components, verified, a spanning forest at most."""

    def rows(table: pa.Table) -> pa.Table:
        node, part, n, reach, side = (table.column(c).to_numpy() for c in ("node", "part", "n", "reach", "side"))
        tokens = [np.frombuffer(x.as_buffer(), U64) for x in table.column("tokens")]
        vectors = np.stack([count_vector(t, TREE_DIMS) for t in tokens])
        up: dict[int, int] = {}

        def root(p: int) -> int:
            while p in up:
                p = up[p]
            return p

        first, second = np.flatnonzero(side == side.min()), np.flatnonzero(side == side.max())
        trees = [CountTree(n[s], reach[s], vectors[s]) for s in (first, second)]
        u, v = [], []
        for i, j in tree_pairs(*trees, percent):
            p, q = first[i], second[j]
            if node[p] == node[q] or (a := root(int(part[p]))) == (b := root(int(part[q]))):
                continue
            if enough(overlap_bound(tokens[p], tokens[q]), n[p], n[q], percent) and enough(overlap(tokens[p], tokens[q]), n[p], n[q], percent):
                up[a] = b
                u.append(node[p])
                v.append(node[q])
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return rows


def star_leaves(stars: DataFrame) -> DataFrame:
    """(u, leaf, node, side) of stars (u, v, n): the sets v that meet a pivot u, in leaves of about TILE_SETS sets and TILE_TOKENS tokens, side 1; and the pivot in each leaf, side 0."""
    size = stars.groupBy("u").agg(F.greatest(F.ceil(F.count("*") / TILE_SETS), F.ceil(F.sum("n") / TILE_TOKENS)).cast("long").alias("n_leaves"))
    members = stars.join(size, "u").select("u", F.pmod(F.xxhash64("v"), F.col("n_leaves")).alias("leaf"), F.col("v").alias("node"), F.lit(1).alias("side"))
    pivots = size.select("u", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_leaves") - 1)).alias("leaf"), F.col("u").alias("node"), F.lit(0).alias("side"))
    return members.unionByName(pivots)


def _star(percent: int):
    """A pivot and the sets of one leaf -> the edges from the pivot that hold: its point descends the leaf's tree, and what is left is verified."""

    def rows(table: pa.Table) -> pa.Table:
        node, n, side = (table.column(c).to_numpy() for c in ("node", "n", "side"))
        tokens = [np.frombuffer(x.as_buffer(), U64) for x in table.column("tokens")]
        vectors = np.stack([count_vector(t, TREE_DIMS) for t in tokens])
        parts = [np.flatnonzero(side == k) for k in (0, 1)]
        if not all(map(len, parts)):
            return pa.table({"u": pa.array([], pa.int64()), "v": pa.array([], pa.int64())})
        trees = [CountTree(n[k], 100 * n[k] // percent, vectors[k]) for k in parts]
        u, v = [], []
        for i, j in tree_pairs(*trees, percent):
            p, q = parts[0][i], parts[1][j]
            if enough(overlap_bound(tokens[p], tokens[q]), n[p], n[q], percent) and enough(overlap(tokens[p], tokens[q]), n[p], n[q], percent):
                u.append(node[p])
                v.append(node[q])
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return rows


def open_entries(entries: DataFrame, linked: DataFrame) -> DataFrame:
    """(token, node, n, reach, part) of the entries that may have a partner of another component at their token.

    A token's extremes over components, and without the component that holds them, tell for each entry whether the others have a
    set small enough for its reach and a reach large enough for its size; groupings are partial sums, so no group is gathered.
    """
    parts = entries.join(linked.hint("merge"), entries["node"] == linked["node"], "left").select("token", entries["node"], "n", "reach", F.coalesce("component", entries["node"]).alias("part"))
    parts = written(parts, "parts")
    spread = parts.groupBy("token", "part").agg(F.min("n").alias("least"), F.max("reach").alias("far"))
    tops = spread.groupBy("token").agg(F.min(F.struct("least", "part")).alias("low"), F.max(F.struct("far", "part")).alias("high"), F.min("part").alias("p"), F.max("part").alias("q")).where("p <> q").select("token", "low", "high")
    others = spread.join(tops, "token").groupBy("token").agg(
        F.first("low").alias("low"), F.first("high").alias("high"),
        F.min(F.when(F.col("part") != F.col("low.part"), F.col("least"))).alias("low_other"), F.max(F.when(F.col("part") != F.col("high.part"), F.col("far"))).alias("high_other"),
    )
    smallest = F.when(F.col("part") != F.col("low.part"), F.col("low.least")).otherwise(F.col("low_other"))
    farthest = F.when(F.col("part") != F.col("high.part"), F.col("high.far")).otherwise(F.col("high_other"))
    return parts.join(others, "token").where((smallest <= F.col("reach")) & (farthest >= F.col("n"))).select("token", "node", "n", "reach", "part")


def tiles(entries: DataFrame) -> DataFrame:
    """Each token's entries in pairs of tiles (token, tile_a, tile_b), of about TILE_SETS sets and TILE_TOKENS tokens a tile."""
    size = entries.groupBy("token").agg(F.greatest(F.ceil(F.count("*") / TILE_SETS), F.ceil(F.sum("n") / TILE_TOKENS)).cast("long").alias("n_tiles"))
    own = F.pmod(F.xxhash64("node"), F.col("n_tiles"))
    cut = entries.join(size, "token").withColumn("side", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_tiles") - 1)))
    return cut.withColumn("tile_a", F.least("side", "other")).withColumn("tile_b", F.greatest("side", "other")).drop("other", "n_tiles")


def similar_texts(docs: DataFrame, key: str, text: str, width: int, percent: int) -> DataFrame:
    """(key, text_a, text_b, n, component) of every row: its id, the hashes of its text, the size of its set and its component's least id."""
    docs = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    docs = docs.select("key", "text", F.xxhash64("text").alias("text_a"), F.xxhash64(F.lit(1), "text").alias("text_b"))
    parallel = docs.sparkSession.sparkContext.defaultParallelism
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    n_buckets = min(1 << 20, max(parallel, int(size) // 14 // BUCKET_TOKENS))
    routed = docs.mapInArrow(_route_support(width, percent, n_buckets), ROUTED)
    answers = routed.groupBy("bucket").applyInArrow(_support, "batch bigint, kind int, data binary")
    rows = written(answers.groupBy("batch").applyInArrow(_gather(percent), SUPPORTED), "rows")

    chosen = rows.where("supported").groupBy("set_a", "set_b").agg(F.min(F.struct("text_a", "text_b")).alias("t")).select("t.text_a", "t.text_b")
    texts = docs.select("text_a", "text_b", "text").mapInArrow(_first_texts, "text_a bigint, text_b bigint, text string")
    texts = texts.join(chosen.hint("shuffle_hash"), ["text_a", "text_b"]).dropDuplicates(["text_a", "text_b"])
    shards = written(texts.select("text").mapInArrow(_shards(width), SHARD), "shards")
    n_tokens = shards.agg(F.coalesce(F.sum(F.octet_length("tokens")), F.lit(0)).alias("n")).first()["n"] // 8
    n_buckets = min(1 << 20, max(parallel, int(n_tokens) // BUCKET_TOKENS))
    levels = shards.select("shard", "tokens").mapInArrow(_route_counts(n_buckets), "bucket bigint, shard bigint, data binary").groupBy("bucket").applyInArrow(_levels, "shard bigint, bucket bigint, levels binary")
    kept = written(shards.groupBy("shard").cogroup(levels.groupBy("shard")).applyInArrow(_routes(percent, n_buckets), KEPT), "kept")
    discard(shards)

    entries = kept.select("node", "n", F.explode("routes").alias("r")).select("node", "n", "r.token", "r.reach")
    pivots = entries.groupBy("token").agg(F.min(F.struct("node", "n")).alias("p"), F.count("*").alias("k")).where("k > 1").select("token", F.col("p.node").alias("u"), F.col("p.n").alias("pivot_n"))
    fits = (F.col("node") != F.col("u")) & (100 * F.col("n") >= percent * F.col("pivot_n")) & (100 * F.col("pivot_n") >= percent * F.col("n"))
    stars = written(entries.join(pivots, "token").where(fits).select("u", F.col("node").alias("v"), "n").distinct(), "stars")
    sets = kept.select("node", "n", "tokens")
    met = star_leaves(stars).join(sets.hint("merge"), "node")
    links = written(met.groupBy("u", "leaf").applyInArrow(_star(percent), "u bigint, v bigint"), "links")
    linked = written(components(links), "components")

    left_open = written(open_entries(entries, linked), "open")
    met = tiles(left_open).join(kept.select("node", "tokens").hint("merge"), "node")
    more = written(met.groupBy("token", "tile_a", "tile_b").applyInArrow(_tile(percent), "u bigint, v bigint"), "more")
    linked = written(components(links.union(more)), "linked")

    classes = kept.select("node", "set_a", "set_b").join(linked, "node").select("set_a", "set_b", "component")
    of_set = rows.where("n > 0").groupBy("set_a", "set_b").agg(F.min("key").alias("least"))
    of_class = written(of_set.join(classes, ["set_a", "set_b"], "left"), "classes")
    least = of_class.where("component is not null").groupBy("component").agg(F.min("least").alias("class_least"))
    of_class = written(of_class.join(least, "component", "left").select("set_a", "set_b", F.coalesce("class_least", "least").alias("component")), "by-set")
    discard(kept, stars, links, more, left_open)
    out = rows.join(of_class.hint("merge"), ["set_a", "set_b"], "left")
    return out.select("key", "text_a", "text_b", "n", F.when(F.col("n") > 0, F.coalesce("component", "key")).otherwise(F.col("key")).alias("component"))


def similar_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 75) -> DataFrame:
    """(key, n_shingles, component_id) of every row: links are pairs of texts with 100 * intersection >= percent * union."""
    found = similar_texts(docs, key, text, width, percent)
    return found.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def first_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 75) -> DataFrame:
    """The rows of docs but those linked, directly or not, with a row of a smaller id. Rows without id or words stay, as do equal rows of one id."""
    gone = similar_texts(docs, key, text, width, percent).where("key <> component").select("key", "text_a", "text_b").distinct()
    names = docs.columns
    given = docs.toDF(*[f"c{i}" for i in range(len(names))])  # clashing column names are safe
    words = F.col(f"c{names.index(text)}").cast("string")
    given = given.withColumns({"key": F.col(f"c{names.index(key)}").cast("long"), "text_a": F.xxhash64(words), "text_b": F.xxhash64(F.lit(1), words)})
    return given.join(gone.hint("shuffle_hash"), ["key", "text_a", "text_b"], "left_anti").drop("key", "text_a", "text_b").toDF(*names)
