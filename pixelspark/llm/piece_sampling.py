"""SentencePiece encoding by sampling without replacement, and decoding.

The lattice of a text has a node at each character boundary and an edge for each vocabulary piece (or the byte pieces of a
character that has none). An edge's log-probability is alpha times its piece's score, normalised by backward sums, so a
path's probability is its share of all segmentations. k distinct segmentations are drawn by the Gumbel top-k trick as
an A* search: the root has a Gumbel value; of the edges at a node one inherits the value of its prefix, and the rest, as
one queue entry, get the largest of their Gumbel values, drawn below it. The entry with the greatest value is expanded next,
so segmentations come out in the order of their perturbed log-probabilities, without enumerating any other. The best entry
left after the k-th gives the threshold of the inclusion scores 1 - exp(-exp(log_prob - threshold)).

Pieces never reach over a cut (before the first of a run of blanks, around bytes that occur in no piece), so the lattice is a
chain of small ones; those of equal stretches of a batch are built once, in arrays over all of them. All draws are hashed
from the row's key, the seed, the sample and the byte position: a repeated task repeats its samples.

Defined results: a null or empty text has one empty segmentation (probability 1); a text with fewer than k segmentations
gives all of them, with inclusion 1; the meta symbol U+2581 reads as a blank, so decoding gives the text with blanks for it;
rows with equal key and text get equal samples; a null key seeds as the empty text; an empty table gives no rows. Only the
named columns are read; columns to carry are named by the caller.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import BYTE_CODE, STEP, STEP_INVERSE, U64, _power, mix64, repeat_ranges, slices, span_hashes, stream64

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
META = "▁"
DRAW = stream64(71, 8)
SLICE_BYTES = 1 << 20
FEW = 8  # stretches that are as well taken one by one
BLOCK = 1 << 16
TABLE_BITS = 20
CHAR_BYTES = np.array([1] * 128 + [0] * 64 + [2] * 32 + [3] * 16 + [4] * 8 + [1] * 8)


def spelling(raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Polynomial hashes of raw[start:start + size], without the final mixing: their high bits index tables."""
    with np.errstate(over="ignore"):
        total = np.zeros(len(raw) + 1, U64)
        np.cumsum(BYTE_CODE[raw] * _power("up", STEP, len(raw)), out=total[1:])
        return (total[starts + sizes] - total[starts]) * _power("down", STEP_INVERSE, len(raw) + 1)[starts]


def read_model(path: str) -> dict[str, np.ndarray]:
    """Arrays of a SentencePiece model, blanks for the meta symbol; bounded by the vocabulary's size."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    plain = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
    data = [b""] * n
    for i in plain:
        data[i] = model.id_to_piece(i).replace(META, " ").encode()
    byte_ids = np.zeros(256, np.int64)
    for i in range(n):
        if model.is_byte(i):
            value = int(model.id_to_piece(i)[3:-1], 16)
            byte_ids[value], data[i] = i, bytes([value])
    plain = [i for i in plain if data[i]]
    scores = np.array([model.get_score(i) for i in range(n)])
    flat = np.frombuffer(b"".join(data[i] for i in plain), np.uint8)
    lengths = np.array([len(data[i]) for i in plain])
    begins = np.cumsum(lengths) - lengths
    keys = spelling(flat, begins, lengths)
    order = np.argsort(keys)
    known = np.zeros(1 << TABLE_BITS, np.uint8)  # bit 0: may begin a piece, bit 1: may be one
    for size in range(1, int(lengths.max()) + 1):
        known[spelling(flat, begins[lengths >= size], np.full(int((lengths >= size).sum()), size)) >> U64(64 - TABLE_BITS)] |= 1
    known[keys >> U64(64 - TABLE_BITS)] |= 2
    if not (np.bincount((keys >> U64(64 - TABLE_BITS)).astype(np.int64)).max() <= 4):
        raise ValueError("too many pieces share a table place")
    first = np.searchsorted(keys[order] >> U64(64 - TABLE_BITS), np.arange(1 << TABLE_BITS)).astype(np.int32)
    cut = np.ones(256, bool)
    cut[flat] = False
    cut[128:] = False
    inner = [d for d in data if b" " in d.lstrip(b" ")]
    if inner:
        raise ValueError("pieces with inner blanks are not supported")
    usual = scores[plain]
    all_lengths = np.array([len(x) for x in data])
    return {"keys": keys[order], "ids": np.array(plain)[order], "scores": scores, "unknown": np.array(usual[usual > -1e8].min() - 10.0), "longest": np.array(lengths.max()), "known": known, "first": first, "cut": cut, "byte_ids": byte_ids,
            "bytes": np.frombuffer(b"".join(data), np.uint8), "byte_ends": np.cumsum(all_lengths), "byte_counts": all_lengths}


class Lattice:
    """The lattices of distinct stretches (flat bytes, lengths): edges sorted by start node with their conditional probabilities."""

    def __init__(self, flat: np.ndarray, lengths: np.ndarray, model: dict, alpha: float):
        n = len(flat)
        owner = np.repeat(np.arange(len(lengths)), lengths)
        ends = np.cumsum(lengths)
        left = ends[owner] - np.arange(n)
        self.base = ends - lengths + np.arange(len(lengths))  # first node of each stretch; a stretch of l bytes has l + 1 nodes
        with np.errstate(over="ignore"):
            total = np.zeros(n + 1, U64)
            np.cumsum(BYTE_CODE[flat] * _power("up", STEP, n), out=total[1:])
            down = _power("down", STEP_INVERSE, n + 1)
            at_char = np.flatnonzero(CHAR_BYTES[flat] > 0)
            begin, turn, room = total[at_char], down[at_char], left[at_char]
            starts, sizes, pieces = [], [], []
            for size in range(1, int(model["longest"]) + 1):  # positions stay while some piece may begin like this
                keys = (total[at_char + size] - begin) * turn
                known = model["known"][keys >> U64(64 - TABLE_BITS)]
                near = np.flatnonzero(known & 2)
                mine = keys[near]
                spot = model["first"][mine >> U64(64 - TABLE_BITS)]
                hit = model["keys"][spot] == mine
                for _ in range(3):  # a table place holds four pieces at most
                    miss = np.flatnonzero(~hit)
                    if not len(miss):
                        break
                    spot[miss] = np.minimum(spot[miss] + 1, len(model["keys"]) - 1)
                    hit[miss] = model["keys"][spot[miss]] == mine[miss]
                starts.append(at_char[near[hit]])
                sizes.append(size)
                pieces.append(model["ids"][spot[hit]])
                on = np.flatnonzero((known & 1).astype(bool) & (room > size))
                if not len(on):
                    break
                at_char, begin, turn, room = at_char[on], begin[on], turn[on], room[on]
        char = np.minimum(CHAR_BYTES[flat], left)
        alone = np.zeros(n, bool)  # characters that are pieces
        fanout = np.zeros(n, np.int64)
        for s, z in zip(starts, sizes):
            fanout[s] += 1
            if z <= 4:
                alone[s[char[s] == z]] = True
        other = np.flatnonzero((char > 0) & ~alone)
        fanout[other] += 1
        put = np.cumsum(fanout) - fanout
        n_edges = int(fanout.sum())
        size, self.piece = np.empty(n_edges, np.int64), np.empty(n_edges, np.int64)
        for s, z, ids in [*zip(starts, sizes, pieces), (other, char[other], -1)]:
            size[put[s]], self.piece[put[s]] = z, ids
            put[s] += 1
        start = np.repeat(np.arange(n), fanout)
        self.at = start  # byte of the flat stretch
        score = alpha * np.where(self.piece >= 0, model["scores"][self.piece], model["unknown"])
        self.size = size
        self.start = start + owner[start]
        self.end = self.start + size
        beta = np.zeros(n + len(lengths))
        left = left[start]
        far = int(left.max()) if len(left) else 0
        by_left = np.argsort(left.astype(np.uint16) if far < 1 << 16 else left, kind="stable")
        bounds = np.concatenate([[0], np.cumsum(np.bincount(left, minlength=far + 1)[1:])]).astype(np.int64)
        value_of, end_of, start_of = score[by_left], self.end[by_left], self.start[by_left]
        heads = np.flatnonzero(np.concatenate([[True], start_of[1:] != start_of[:-1]])) if len(start_of) else start_of
        fans = np.diff(np.append(heads, len(start_of)))
        at_heads = np.searchsorted(heads, bounds)
        few = min(far, int(np.partition(lengths, -FEW)[-FEW]) if len(lengths) >= FEW else 0)  # beyond this distance less than FEW stretches go on
        for k in range(few):  # nodes by their distance from the end: all edges lead to nodes already summed
            lo, hi, h, i = bounds[k], bounds[k + 1], at_heads[k], at_heads[k + 1]
            if lo == hi:
                continue
            value = value_of[lo:hi] + beta[end_of[lo:hi]]
            first, count = heads[h:i] - lo, fans[h:i]
            top = np.maximum.reduceat(value, first)
            value -= np.repeat(top, count)
            np.exp(value, out=value)
            beta[start_of[heads[h:i]]] = top + np.log(np.add.reduceat(value, first))
        for h in range(int(at_heads[few]) if far else 0, len(heads), BLOCK):  # a few long stretches: node by node, in plain numbers
            mine = heads[h : h + BLOCK]
            lo, hi = int(mine[0]), int(mine[-1] + fans[h + len(mine) - 1])
            values, on, summed = value_of[lo:hi].tolist(), end_of[lo:hi].tolist(), beta.item
            for node, a, b in zip(start_of[mine].tolist(), (mine - lo).tolist(), (mine - lo + fans[h : h + len(mine)]).tolist()):
                if b - a == 1:
                    beta[node] = values[a] + summed(on[a])
                    continue
                here = [v + summed(e) for v, e in zip(values[a:b], on[a:b])]
                high = max(here)
                beta[node] = high + math.log(sum([math.exp(v - high) for v in here]))
        self.log_p = np.minimum(score + beta[self.end] - beta[self.start], 0.0)
        self.p = np.exp(self.log_p)
        self.first = np.zeros(n + len(lengths) + 1, np.int64)
        if len(start):
            first = np.flatnonzero(np.concatenate([[True], self.start[1:] != self.start[:-1]]))
            count = np.diff(np.append(first, len(start)))
            self.first[self.start[first]] = first
            self.count = np.zeros(len(self.first), np.int64)
            self.count[self.start[first]] = count
            run = np.cumsum(self.p)
            self.upto = run - np.repeat(run[first] - self.p[first], count)
            self.upto[first + count - 1] = np.inf  # the last edge takes what rounding leaves
            with np.errstate(divide="ignore"):
                self.log_rest = np.log1p(-self.p)  # of the edge's siblings
            place = np.repeat(first, count)
            many = np.repeat(count, count)
            self.log_rest[many == 1] = -np.inf
            near_one = np.flatnonzero((self.p > 1 - 1e-8) & (many > 1))  # there 1 - p cancels: add up the siblings
            total = self.log_p[place[near_one] + (near_one - place[near_one] + 1) % many[near_one]]
            more = np.flatnonzero(many[near_one] > 2)
            r = 2
            while len(more):
                e = near_one[more]
                total[more] = np.logaddexp(total[more], self.log_p[place[e] + (e - place[e] + r) % many[e]])
                r += 1
                more = more[many[e] > r]
            self.log_rest[near_one] = total
        else:
            self.log_rest = np.zeros(0)

    def walk(self, node: np.ndarray, stop: np.ndarray, seed: np.ndarray, shift: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ancestral samples from node to stop for many stretches at once: (edges, their count for each stretch).

        A draw is hashed from seed and the byte position, node + shift.
        """
        live, node = np.flatnonzero(node < stop), node.copy()
        taken: list[tuple[np.ndarray, np.ndarray]] = []
        steps = np.zeros(len(node), np.int64)
        while len(live) >= FEW:
            now = node[live]
            u = uniform(seed[live], now + shift[live], 0)
            e = self.first[now]
            wrong = np.flatnonzero(u > self.upto[e])
            while len(wrong):
                e[wrong] += 1
                wrong = wrong[u[wrong] > self.upto[e[wrong]]]
            taken.append((live, e))
            steps[live] += 1
            node[live] = self.end[e]
            live = live[node[live] < stop[live]]
        tails = []
        for who in live.tolist():  # a few long stretches: one after the other, in plain numbers
            path: list[int] = []
            now, last = int(node[who]), int(stop[who])
            first, upto, end = self.first.item, self.upto.item, self.end.item
            while now < last:
                base, far = now, min(last, now + BLOCK)
                draws = uniform(np.broadcast_to(seed[who], far - base), np.arange(base, far) + shift[who], 0).tolist()
                while now < far:
                    u, e = draws[now - base], first(now)
                    while u > upto(e):
                        e += 1
                    path.append(e)
                    now = end(e)
            tails.append((who, int(steps[who]), path))
            steps[who] += len(path)
        begin = np.cumsum(steps) - steps
        out = np.empty(int(steps.sum()), np.int64)
        for t, (who, e) in enumerate(taken):
            out[begin[who] + t] = e
        for who, t, path in tails:
            out[begin[who] + t : begin[who] + t + len(path)] = path
        return out, steps


def uniform(seed: np.ndarray, position: np.ndarray, kind: int) -> np.ndarray:
    """Hashed numbers in (0, 1)."""
    return ((mix64(seed + (position + 1).astype(U64) * DRAW[1 + kind]) >> U64(11)).astype(np.float64) + 0.5) * 2.0**-53


def below(location: np.ndarray, top: np.ndarray, u: np.ndarray) -> np.ndarray:
    """A Gumbel value at a location, drawn below top; minus infinity where the location is."""
    with np.errstate(over="ignore", divide="ignore", invalid="ignore"):
        out = location - np.log(np.exp(location - top) - np.log(u))
    return np.where(np.isneginf(location), -np.inf, out)


def stretches(raw: np.ndarray, at: np.ndarray, model: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The texts with their leading blank, their offsets, the starts of the stretches between cuts, and the texts' offsets in those."""
    full = np.flatnonzero(np.diff(at) > 0)
    data = np.insert(raw, at[full], np.uint8(32))
    at = at + np.concatenate([[0], np.cumsum(np.diff(at) > 0)])
    begins = np.zeros(len(data) + 1, bool)
    if len(data):
        cut = model["cut"][data]
        blank = data == 32
        begins[:-1] = cut
        begins[1:-1] |= cut[:-1] | (blank[1:] & ~blank[:-1])
        begins[at] = True
    starts = np.flatnonzero(begins[:-1])
    return data, at, starts, np.searchsorted(starts, at)


def sample_texts(raw: np.ndarray, at: np.ndarray, seeds: np.ndarray, model: dict, k: int, alpha: float) -> tuple[list[tuple[int, int, float, float, float]], np.ndarray, np.ndarray]:
    """For each text and sample: text number, sample number, log-probability, perturbed value, inclusion score; all piece ids, and the samples' offsets in them."""
    data, at, starts, in_text = stretches(raw, at, model)
    n = len(at) - 1
    stops = np.append(starts[1:], len(data)) if len(starts) else starts
    _, first, same = np.unique(span_hashes(data, starts, stops), return_index=True, return_inverse=True)
    lengths = (stops - starts)[first]
    flat = data[repeat_ranges(starts[first], lengths)]
    lattice = Lattice(flat, lengths, model, alpha)
    text_of = np.repeat(np.arange(n), np.diff(in_text))
    begin = lattice.base[same] if len(starts) else starts
    end = begin + (stops - starts)
    shift = starts - at[text_of] - begin  # node + shift is the byte position in the text
    root = -np.log(-np.log(uniform(seeds, np.zeros(n, np.int64), 2)))

    # path: per text its edges, the stretch of each, its queue entries' values and the sample's numbers
    paths: list[list[dict | None]] = []
    edges, steps = lattice.walk(begin, end, seeds[text_of], shift)
    where = np.repeat(np.arange(len(starts)), steps)
    offsets = np.concatenate([[0], np.cumsum(steps)])[in_text]
    paths.append(_settle(lattice, edges, where, offsets, np.zeros(n, np.int64), None, root, seeds, shift, [None] * n, range(n)))
    for sample in range(1, k):
        new: list[dict | None] = [None] * n
        picks = []
        for d in range(n):
            best, by = -np.inf, None
            for path in paths:
                if path[d] is not None and path[d]["best"] > best:
                    best, by = path[d]["best"], path[d]
            if by is not None:
                picks.append((d, by, best))
        if not picks:
            break
        own = mix64(seeds + np.full(n, sample, U64) * DRAW[0])
        todo_node, todo_at, prefix, rest_log = [], [], [], []
        for d, by, best in picks:
            j = by["spot"]
            e, s = by["edges"][j], by["where"][j]
            node = lattice.start[e]
            out = (by["out"] if j == by["branch"] else ()) + (e,)
            options = np.arange(lattice.first[node], lattice.first[node] + lattice.count[node])
            left = lattice.log_p[options].copy()
            for o in out:
                left[options == o] = -np.inf
            weights = np.exp(left - left.max())
            run = np.cumsum(weights)
            u = uniform(own[d : d + 1], np.array([node + shift[s]]), 3)[0]
            pick = int(min(np.searchsorted(run, u * run[-1], "right"), np.flatnonzero(weights)[-1]))
            left[pick] = -np.inf
            rest_log.append(np.logaddexp.reduce(left))
            by["rest"][j] = -np.inf
            _refresh(by)
            todo_node.append(np.concatenate([[lattice.end[options[pick]]], begin[s + 1 : in_text[d + 1]]]))
            todo_at.append(np.arange(s, in_text[d + 1]))
            prefix.append((d, by, j, options[pick], best, out))
        seg = np.concatenate(todo_at)
        edges, steps = lattice.walk(np.concatenate(todo_node), end[seg], own[text_of[seg]], shift[seg])
        where = np.repeat(seg, steps)
        upto = np.concatenate([[0], np.cumsum(steps)])[np.concatenate([[0], np.cumsum([len(x) for x in todo_at])])]
        flat_edges, flat_where, sizes = [], [], []
        for i, (d, by, j, e, best, out) in enumerate(prefix):
            flat_edges += [by["edges"][:j], [e], edges[upto[i] : upto[i + 1]]]
            flat_where += [by["where"][: j + 1], where[upto[i] : upto[i + 1]]]
            sizes.append(j + 1 + upto[i + 1] - upto[i])
        who = [x[0] for x in prefix]
        made = _settle(lattice, np.concatenate(flat_edges).astype(np.int64), np.concatenate(flat_where), np.concatenate([[0], np.cumsum(sizes)]), np.array([x[2] for x in prefix]), np.array(rest_log), np.array([x[4] for x in prefix]), own[who], shift, [x[5] for x in prefix], who)
        for d, path in zip(who, made):
            new[d] = path
        paths.append(new)
    rows, taken = [], [np.zeros(0, np.int64)]
    for d in range(n):
        mine = [p[d] for p in paths if p[d] is not None]
        threshold = max(p["best"] for p in mine)
        for sample, p in enumerate(mine):
            inclusion = 1.0 if threshold == -np.inf else float(-np.expm1(-np.exp(min(p["log_prob"] - threshold, 700.0))))
            rows.append((d, sample + 1, p["log_prob"], p["value"], inclusion))
            taken.append(p["edges"])
    return rows, *_ids(lattice, np.concatenate(taken), np.cumsum([len(x) for x in taken]), flat, model)


def _settle(lattice, edges, where, offsets, branch, rest_log, values, seeds, shift, outs, who) -> list[dict]:
    """Queue entries of new paths (flat over texts): at each edge the value of the rest of its siblings, from the branch on."""
    counts = np.diff(offsets)
    owner = np.repeat(np.arange(len(counts)), counts)
    log_p = lattice.log_p[edges]
    run = np.concatenate([[0.0], np.cumsum(log_p)])
    before = run[:-1] - run[offsets[:-1]][owner]
    log_rest = lattice.log_rest[edges]
    if rest_log is not None:
        log_rest[offsets[:-1] + branch] = rest_log
    nodes = lattice.start[edges]
    rank = np.arange(len(edges)) - offsets[:-1][owner]
    open_ = np.flatnonzero((log_rest > -np.inf) & (rank >= branch[owner]))
    who_open = owner[open_]
    rest = np.full(len(edges), -np.inf)
    location = before[open_] + log_rest[open_]
    rest[open_] = below(location, values[who_open], uniform(seeds[who_open], nodes[open_] + shift[where[open_]], 1))
    out = []
    for i in range(len(counts)):
        a, b = offsets[i], offsets[i + 1]
        path = {"edges": edges[a:b], "where": where[a:b], "rest": rest[a:b], "branch": int(branch[i]), "out": outs[i] or (), "value": float(values[i]), "log_prob": float(run[b] - run[a])}
        _refresh(path)
        out.append(path)
    return out


def _refresh(path: dict) -> None:
    path["spot"] = int(path["rest"].argmax()) if len(path["rest"]) else 0
    path["best"] = float(path["rest"][path["spot"]]) if len(path["rest"]) else -np.inf


def _ids(lattice: Lattice, edges: np.ndarray, ends: np.ndarray, flat: np.ndarray, model: dict) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids of edges, byte pieces for characters without a piece, and the offsets that ends become."""
    ids = lattice.piece[edges]
    lone = np.flatnonzero(ids < 0)
    if not len(lone):
        return ids, ends
    counts = np.ones(len(ids), np.int64)
    counts[lone] = lattice.size[edges[lone]]
    out = np.repeat(ids, counts)
    out[out < 0] = model["byte_ids"][flat[repeat_ranges(lattice.at[edges[lone]], counts[lone])]]
    return out, np.concatenate([[0], np.cumsum(counts)])[ends]


def _encoder(shared, k: int, alpha: float, seed: int, carried: list[str]):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch, raw, at in slices(batches, "text", SLICE_BYTES):
            keys = batch.column("seed_key").cast(pa.large_string()).fill_null("")
            data = np.frombuffer("".join(keys.to_pylist()).encode() or b"\0", np.uint8)
            ends = np.cumsum([len(x.encode()) for x in keys.to_pylist()]).astype(np.int64)
            begins = np.concatenate([[0], ends[:-1]])
            seeds = mix64(span_hashes(data, begins, ends) + np.full(len(ends), seed, U64) * DRAW[7])
            found, ids, ends = sample_texts(raw, at, seeds, model, k, alpha)
            text, sample, log_prob, value, inclusion = zip(*found) if found else ([],) * 5
            counts = np.diff(ends)
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids.astype(np.int32)))
            kept = batch.select(carried).take(pa.array(text, pa.int64()))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(sample, pa.int32()), pa.array(counts), pa.array(log_prob, pa.float64()), pa.array(value, pa.float64()), pa.array(inclusion, pa.float64()), lists], names=[*carried, "sample_no", "n_pieces", "log_prob", "perturbed", "inclusion", "ids"])

    return rows


def encode_samples(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 2, alpha: float = 0.002, seed: int = 23, carry: tuple[str, ...] = (), model: str = MODEL) -> DataFrame:
    """(key, carried columns, sample_no, n_pieces, log_prob, perturbed, inclusion, ids): up to k distinct segmentations of each whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(read_model(model))
    carried = [key, *carry]
    given = docs.select(*carried, F.col(key).cast("string").alias("seed_key"), F.replace(F.col(text).cast("string"), F.lit(META), F.lit(" ")).alias("text")) if text not in carried else None
    if given is None:
        raise ValueError("the text is not carried; decode the ids")
    schema = ", ".join([*(f"`{c}` {given.schema[c].dataType.simpleString()}" for c in carried), "sample_no int, n_pieces bigint, log_prob double, perturbed double, inclusion double, ids array<int>"])
    return given.mapInArrow(_encoder(shared, k, alpha, seed, carried), schema)


def decode_bytes(ids: np.ndarray, ends: np.ndarray, model: dict) -> list[bytes]:
    """The texts of flat piece ids: the pieces' bytes without the leading blank."""
    counts = model["byte_counts"][ids]
    data = model["bytes"][repeat_ranges(model["byte_ends"][ids] - counts, counts)]
    total = np.concatenate([[0], np.cumsum(counts)])[np.concatenate([[0], ends])]
    raw = data.tobytes()
    return [raw[a + (raw[a : a + 1] == b" ") : b] for a, b in zip(total[:-1], total[1:])]


def _decoder(shared, keep_ids: bool):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for whole in batches:
            sizes = np.array([len(x) for x in whole.column("ids")], np.int64)
            start = 0
            while start < len(sizes):  # bounded steps, one list at least
                stop = max(start + 1, start + int(np.searchsorted(np.cumsum(sizes[start:]), 1 << 19, "right")))
                batch = whole.slice(start, stop - start)
                texts = decode_bytes(batch.column("ids").flatten().to_numpy(zero_copy_only=False), np.cumsum(sizes[start:stop]), model)
                columns = [n for n in batch.schema.names if n != "ids"]
                kept = [*columns, "ids"] if keep_ids else columns
                yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in kept], pa.array([t.decode("utf-8", "replace") for t in texts], pa.string())], names=[*kept, "decoded"])
                start = stop

    return rows


def decode_ids(encoded: DataFrame, model: str = MODEL, keep_ids: bool = True) -> DataFrame:
    """encoded (with a column ids, which stays if wanted) and the text that each row's ids stand for, as `decoded`. Null ids decode as none."""
    shared = encoded.sparkSession.sparkContext.broadcast(read_model(model))
    rest = [c for c in encoded.columns if c not in ("ids", "decoded")]
    given = encoded.select(*rest, F.coalesce(F.col("ids"), F.array().cast("array<int>")).alias("ids"))
    schema = ", ".join([*(f"`{c}` {given.schema[c].dataType.simpleString()}" for c in rest), *(["ids array<int>"] if keep_ids else []), "decoded string"])
    return given.mapInArrow(_decoder(shared, keep_ids), schema)
