"""op11 against a plain trie, its decomposition against plain sums, and its defined cases."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest

from pixelspark.llm import prefix_trie as pt

SCHEMA = "conv_id long, turn long, role string, text string, depth string, key string"


def code(role, text):
    role, text = role or "", text or ""
    return hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()


def plain_trie(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, code(role, text), role or "", text or ""))
    own = {c: [(r, x) for _, _, _, r, x in sorted(v)] for c, v in convs.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        new = tuple(own.get(base, [])[:h] + turns[h:])
        for d in range(len(new) + 1):
            members[new[:d]].append(c)
        ends[new].append(c)
    children = defaultdict(int)
    for p in members:
        if p:
            children[p[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += children[p] == 0
            saved[p[:d]] += (len(m) - 1) * (len(p[-1][1]) if p else 0)
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p], hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()) for p, m in members.items())


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("max_local", [12, pt.MAX_LOCAL])
def test_trie_equals_a_plain_one(spark, few_partitions, max_local):
    rng = np.random.default_rng(max_local)
    rows = []
    for c in [*range(0, 40), *range(95, 110), *range(230, 260), -3, -250]:
        for turn in range(int(rng.integers(1, 9))):
            rows.append((c, turn, rng.choice(["user", "bot"]), f"é{rng.integers(0, 2)}"))
    rows += [(7, None, None, None), (7, None, "user", "first"), (8, 2, "a", "tie"), (8, 2, "b", "tie"), (None, 1, "user", "lost")] + [(9, 3, "user", "again")] * 3
    frame = spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA).repartition(4)
    assert rows_of(pt.conversation_trie(frame, max_local=max_local)) == plain_trie(rows)


def test_long_and_shared_conversations(spark, few_partitions):
    """A third of the rows in one conversation, and many equal ones."""
    rows = [(100, i, "user", f"t{i % 3}") for i in range(900)] + [(c, i, "user", f"s{i}") for c in range(300, 600) for i in range(3)] + [(c, 0, "user", "s0") for c in range(601, 640)]
    assert rows_of(pt.conversation_trie(spark.createDataFrame([(*r, "", "") for r in rows], SCHEMA), max_local=100)) == plain_trie(rows)


def test_one_turn_and_no_turns(spark, few_partitions):
    none = spark.createDataFrame([], SCHEMA)
    assert pt.conversation_trie(none).count() == 0 and pt.conversation_trie(none).columns == [c.split()[0] for c in pt.SCHEMA.split(", ")]
    rows = [(c, 0, "user", "x") for c in (1, 2, 5, 77)]  # conversations whose first h turns go and whose hundred is absent have no turn
    assert rows_of(pt.conversation_trie(spark.createDataFrame([(*r, "", "") for r in rows], SCHEMA))) == plain_trie(rows)


@pytest.mark.parametrize("shape", ["chain", "star", "random"])
def test_decomposition_equals_sums_from_below(shape):
    rng = np.random.default_rng(5)
    n = 3000
    parent = {"chain": np.maximum(np.arange(n) - 1, 0), "star": np.zeros(n, np.int64), "random": np.array([0] + [int(rng.integers(max(0, i - 40), i)) for i in range(1, n)])}[shape]
    depth, own, want = np.zeros(n, np.int64), rng.integers(1, 5, n), rng.integers(0, 9, (2, n))
    values = want.copy()
    weight = own.copy()
    for i in range(1, n):
        depth[i] = depth[parent[i]] + 1
    for i in range(n - 1, 0, -1):
        weight[parent[i]] += weight[i]
        want[:, parent[i]] += want[:, i]
    whole = np.zeros(n, np.int64)
    whole[0] = weight[0]
    got = pt.decompose(parent, depth, np.zeros(n, np.int64), whole, weight.copy(), values, np.zeros((2, n), np.int64))
    assert (got == want).all()
