"""Ranked lexical search: the documents that best match each item, found by scanning the texts with an automaton of the items' terms.

No index of the documents is made. All terms of the items form one Aho-Corasick automaton whose patterns carry a blank on either
side, so that only whole terms match; a pass over each text, with everything but term characters made blank, gives the terms'
counts in it, and an output of the automaton leads to the items that hold the term. What the pass finds is written, one row of
counts per document, for the statistics (documents, terms, document frequencies) come from all documents before the first
score does; scores are then computed from these rows, and a few of the best per task and item meet in a window.

The broadcast is bounded: items are dealt into blocks of at most about `block_bytes` of text, each with an automaton of its
own, and the documents are scanned once per block. (A single item over that size is a block by itself.)

Terms: maximal runs of 0-9, a-z and characters above 0x7F, of which only A-Z is lowered. Scores are whole numbers:
w * (10^9 tf div (1000 tf + 8 m)), summed over an item's distinct terms, with w = floor(1000 ln((2N + 2) / (2 df + 1))) and
m = 100 - b + b n N div L, b = 90.

Defined results: a null or termless text counts for nothing and is never found; a null or termless item, or one whose terms
stand nowhere, has no rows; rows with the same item id are one item with the terms of all of them, and a null item id is left
out; repeated documents each have a rank, ties go by id, null ids last; empty tables give no rows. Only the named columns are
read, so others cannot clash. Texts are scanned whole, one at a time where they are longer than a slice.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from pixelspark.session import discard, written

from ._text import LOWER, repeat_ranges, slices, words

BLOCK_BYTES = 4 << 20
SPLITS = 32
DOCS_AT_ONCE = 256
IS_GAP = np.ones(256, dtype=bool)
IS_GAP[48:58] = IS_GAP[65:91] = IS_GAP[97:123] = IS_GAP[128:] = False
BLANKED = np.where(IS_GAP, 32, LOWER).astype(np.uint8).tobytes()


def terms_of(text: str | None) -> list[str]:
    """The distinct terms of a text, as Latin-1 characters of their UTF-8 bytes, sorted."""
    return sorted(set((text or "").encode().translate(BLANKED).decode("latin-1").split(" ")) - {""})


def build(items: list[tuple[int, str]]) -> dict:
    """Automaton of the items' terms, and for each term the places of its items: an offset array and a list."""
    held: dict[str, set[int]] = {}
    ids = sorted({k for k, _ in items})
    place = {k: i for i, k in enumerate(ids)}
    for k, text in items:
        for term in terms_of(text):
            held.setdefault(term, set()).add(place[k])
    terms = sorted(held)
    automaton = None
    if terms:
        automaton = ahocorasick.Automaton()
        for t, term in enumerate(terms):
            automaton.add_word(f" {term} ", t)
        automaton.make_automaton()
    return {"automaton": automaton, "n_terms": len(terms), "ids": ids, "at": np.cumsum([0] + [len(held[t]) for t in terms]), "items": np.array([i for t in terms for i in sorted(held[t])], np.int64)}


def count_terms(raw: np.ndarray, at: np.ndarray, automaton, n_terms: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, term, count), sorted, of the terms of the automaton in the texts raw[at[i]:at[i + 1]]."""
    none = np.zeros(0, np.int64)
    if not n_terms or not len(raw):
        return none, none, none
    # A blank before each text: two texts never run into one term, and every term has its guards.
    spread = np.full(len(raw) + len(at), 32, np.uint8)
    spread[np.arange(len(raw)) + np.repeat(np.arange(1, len(at)), np.diff(at))] = raw
    text = spread.tobytes().translate(BLANKED).decode("latin-1")
    hits = np.fromiter(automaton.iter(text), dtype=[("end", np.int64), ("term", np.int64)])
    starts = at[:-1] + np.arange(len(at) - 1)  # the place of each text's first blank
    doc = np.searchsorted(starts, hits["end"] - 1, "right") - 1  # end is the closing blank, which may be the next text's
    keys, counts = np.unique(doc * n_terms + hits["term"], return_counts=True)
    return keys // n_terms, keys % n_terms, counts


def _scan(shared):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch, raw, at in slices(batches, "text"):
            _, _, in_terms = words(raw, at, IS_GAP)
            n = np.diff(in_terms)
            doc, term, tf = count_terms(raw, at, index["automaton"], index["n_terms"])
            keep = np.flatnonzero(n)
            edges = np.searchsorted(doc, np.append(keep, len(n))).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(edges), pa.array(x.astype(np.int32))) for x in (term, tf)]
            yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(keep)), pa.array(n[keep]), *lists], names=["key", "n", "terms", "tf"])

    return rows


def _score(shared, weights: np.ndarray, n_docs: int, n_all: int, b: int, top: int, kind: pa.DataType):
    """Count rows -> a task's best documents of each item. A score below what `top` documents of the task have already is left out at once."""

    def cut(found: list[tuple]) -> tuple:
        item, score = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
        key = pa.chunked_array([f[2] for f in found], kind).combine_chunks()
        by_key = pc.rank(key, "ascending", null_placement="at_end", tiebreaker="first").to_numpy()
        order = np.lexsort((by_key, -score, item))
        item = item[order]
        order = order[np.arange(len(item)) - np.searchsorted(item, item) < top]
        return np.concatenate([f[0] for f in found])[order], score[order], key.take(pa.array(order))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        n_items, at, items = len(index["ids"]), index["at"], index["items"]
        least, found, held = np.ones(n_items, np.int64), [], 0
        for batch in batches:
            for start in range(0, batch.num_rows, DOCS_AT_ONCE):
                part = batch.slice(start, DOCS_AT_ONCE)
                terms = part.column("terms")
                size = terms.value_lengths().to_numpy()
                term, tf = terms.flatten().to_numpy().astype(np.int64), part.column("tf").flatten().to_numpy().astype(np.int64)
                m = np.array([100 - b + b * x * n_docs // n_all for x in part.column("n").to_pylist()], np.int64)
                doc = np.repeat(np.arange(len(size)), size)
                worth = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[doc]))
                fan = np.diff(at)[term]
                total = np.zeros(len(size) * n_items, np.int64)
                np.add.at(total, np.repeat(doc * n_items, fan) + items[repeat_ranges(at[term], fan)], np.repeat(worth, fan))
                good = np.flatnonzero(total >= np.tile(least, len(size)))
                if len(good):
                    found.append((good % n_items, total[good], part.column("key").take(pa.array(good // n_items))))
                    held += len(good)
                if held > 1 << 17:
                    found = [cut(found)]
                    item, score, _ = found[0]
                    full = np.flatnonzero(np.arange(len(item)) - np.searchsorted(item, item) == top - 1)
                    least[item[full]] = score[full]  # ties with it are still let in: the key decides
                    held = 0
        if found:
            item, score, key = cut(found)
            yield pa.RecordBatch.from_arrays([pa.array(item), key, pa.array(score)], names=["place", "key", "score"])

    return rows


def _ranked(found: DataFrame, by: list[str | Column], top: int) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("key"))
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def search(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", top: int = 10, b: int = 90, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(item, rank, key, score): the top documents of each item with a score above 0, equal scores by ascending key."""
    spark = docs.sparkSession
    asked = items.select(F.col(item).alias("item"), F.col(item_text).cast("string").alias("text")).where("item is not null and text is not null")
    n_bytes = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = -(-2 * n_bytes // block_bytes) if n_bytes > block_bytes else 1
    texts = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind, item_kind = docs.schema[key].dataType, items.schema[item].dataType.simpleString()
    out = None
    for block in range(n_blocks):
        rows = asked.where(F.pmod(F.xxhash64("item"), F.lit(n_blocks)) == block).collect()  # about block_bytes at most
        index = build([tuple(r) for r in rows])
        shared = spark.sparkContext.broadcast(index)
        counted = written(texts.mapInArrow(_scan(shared), f"key {kind.simpleString()}, n bigint, terms array<int>, tf array<int>"), "terms")
        n_docs, n_all = counted.agg(F.count("*"), F.sum("n")).first()
        df = [0] * index["n_terms"]
        for r in counted.select(F.explode("terms").alias("t")).groupBy("t").count().toLocalIterator():  # a row per term of the block
            df[r["t"]] = r["count"]
        weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * x + 1))) for x in df], np.int64)
        best = counted.mapInArrow(_score(shared, weights, n_docs, n_all or 1, b, top, to_arrow_type(kind)), f"place bigint, key {kind.simpleString()}, score bigint")
        near = written(_ranked(best, ["place", F.pmod(F.xxhash64("key"), F.lit(SPLITS))], top).drop("rank"), "best")  # a task leaves top rows an item: two steps bound what meets
        discard(counted)
        ids = spark.createDataFrame(list(enumerate(index["ids"])), f"place bigint, item {item_kind}")  # the block's items
        ranked = _ranked(near, ["place"], top).join(F.broadcast(ids), "place").select(F.col("item").alias(item), "rank", F.col("key").alias(key), "score")
        out = ranked if out is None else out.unionByName(ranked)
    return out
