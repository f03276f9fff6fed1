"""op12 against a plain scorer, and its defined cases."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from pixelspark.llm import lexical_search as ls

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_search(docs, items, top=10, b=90):
    counts = [(k, Counter(TERM.findall((t or "").translate(UPPER)))) for k, t in docs]
    counts = [(k, c) for k, c in counts if c]
    n_all, length = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    asked = {}
    for k, t in items:
        if k is not None:
            asked.setdefault(k, set()).update(TERM.findall((t or "").translate(UPPER)))
    out = []
    for k, terms in asked.items():
        scores = []
        for place, (d, c) in enumerate(counts):
            m = 100 - b + b * sum(c.values()) * n_all // length
            s = sum(math.floor(1000 * math.log((2 * n_all + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 8 * m)) for t in terms if t in c)
            if s > 0:
                scores.append((-s, d is None, d or 0, place))
        for r, (s, none, d, _) in enumerate(sorted(scores)[:top]):
            out.append((k, r + 1, None if none else d, -s))
    return out


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("block_bytes", [ls.BLOCK_BYTES, 300])
def test_search_equals_a_plain_scorer(spark, block_bytes):
    rng = np.random.default_rng(4)
    vocabulary = ["Alpha", "beta", "b", "al", "alpha7", "ñandú", "Éa", "日本", "日", "x9"] + [f"w{i}" for i in range(30)]
    text = lambda n: "".join(rng.choice(vocabulary) + rng.choice([" ", "  ", "\n", ", ", "-", "_", "\x00"]) for _ in range(n))
    docs = [(i, text(int(rng.integers(0, 60)))) for i in range(120)] + [(500, None), (501, ""), (502, " .,_ "), (None, "alpha beta w1"), (7, "alpha beta w1"), (7, "alpha beta w1")]
    items = [(i, text(int(rng.integers(1, 9)))) for i in range(20)] + [(3, "w2 w2 w3"), (30, None), (31, ""), (32, "nowhere"), (None, "beta")]
    frame = spark.createDataFrame([(k, t, "clash", "clash") for k, t in docs], "doc_id long, text string, item_id string, score string").repartition(5)
    found = ls.search(frame, spark.createDataFrame(items, "item_id long, text string"), block_bytes=block_bytes)
    assert got(found) == sorted(plain_search(docs, items), key=str)


def test_search_of_whole_long_texts_and_ties(spark):
    long = "filler " * 300_000 + "needle"
    docs = [(2, long), (1, long), (3, "other words"), (9, "needless needles")]
    found = ls.search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(5, "NEEDLE")], "item_id long, text string"), top=1)
    assert [tuple(r)[:3] for r in found.collect()] == [(5, 1, 1)]


def test_search_of_text_keys_and_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id string, text string")
    some = spark.createDataFrame([("b", "one two"), ("a", "one two"), (None, "two")], "doc_id string, text string")
    items = spark.createDataFrame([("q", "two")], "item_id string, text string")
    assert ls.search(none, items).count() == 0
    assert ls.search(some, items.limit(0)).count() == 0
    assert [r["doc_id"] for r in ls.search(some, items).orderBy("rank").collect()] == [None, "a", "b"]


def test_hot_candidates_are_cut_exactly(spark, monkeypatch):
    """More candidates in a task than it holds at once."""
    monkeypatch.setattr(ls, "DOCS_AT_ONCE", 16)
    docs = [(i, " ".join(["a"] * (1 + i % 7) + ["b"] * (i % 5) + ["c"] * (i % 11))) for i in range(3000)]
    items = [(i, "a b c"[: 1 + 2 * (i % 3)]) for i in range(60)]
    found = ls.search(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1), spark.createDataFrame(items, "item_id long, text string"))
    assert got(found) == sorted(plain_search(docs, items), key=str)
