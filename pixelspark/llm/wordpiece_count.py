"""Token counts with a linear longest-match automaton.

The vocabulary is a trie with two roots: word starts (tokens that begin with a blank) and continuations (the others). Each
node has a failure link and the number of tokens that following it pops off; greedy longest-match lengths of a word come
from one pass over its bytes, and no piece is ever built. Words are runs of bytes other than blanks 0x20, 0x09-0x0D; each is
matched as its bytes after one blank. All words of a batch step through the automaton together, each distinct word once.

A byte that no token covers counts as one unknown token (a vocabulary with all single bytes has none).

Defined results: a null, empty or blank text has 0 words and 0 tokens; repeated rows get equal counts; an empty table gives
no rows. Work is linear in the text. Only key and text are read, so extra columns cannot clash.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import slices, span_hashes, words

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def read_vocabulary(path: str) -> list[bytes]:
    """The tokens of a file of `base64 rank` lines; its size bounds what is broadcast."""
    with open(path, "rb") as f:
        return [base64.b64decode(line.split()[0]) for line in f if line.strip()]


def build_automaton(tokens: list[bytes]) -> dict[str, np.ndarray]:
    """Arrays of the automaton: keys (node * 256 + byte, sorted) to children, fail links, popped counts.

    Node 0 is the continuation root, node 1 the start root (after the blank).
    """
    children: list[dict[int, int]] = [{}, {}]
    is_token = [False, b" " in tokens]
    for token in tokens:
        at, rest = (1, token[1:]) if token[:1] == b" " else (0, token)
        if not rest:
            continue
        for c in rest:
            if c not in children[at]:
                children[at][c] = len(children)
                children.append({})
                is_token.append(False)
            at = children[at][c]
        is_token[at] = True
    for c in range(256):  # unknown bytes are pieces of their own
        if c not in children[0]:
            children[0][c] = len(children)
            children.append({})
            is_token.append(True)
        is_token[children[0][c]] = True
    fail, popped = [0] * len(children), [0] * len(children)
    popped[1] = 1 if is_token[1] else 0  # without the blank as a token, it costs nothing
    queue = [0, 1]
    for node in queue:
        for c, child in children[node].items():
            if is_token[child]:
                fail[child], popped[child] = 0, 1
            else:
                z, pops = (fail[node], popped[node]) if node != 0 else (0, 0)
                while c not in children[z]:
                    pops += popped[z]
                    z = fail[z]
                fail[child], popped[child] = children[z][c], pops
            queue.append(child)
    edges = sorted((node * 256 + c, child) for node, x in enumerate(children) for c, child in x.items())
    keys, values = map(np.array, zip(*edges))
    return {"keys": keys.astype(np.int64), "child": values.astype(np.int64), "fail": np.array(fail), "popped": np.array(popped)}


def piece_counts(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, automaton: dict[str, np.ndarray]) -> np.ndarray:
    """Greedy longest-match token count of each word raw[start:end]; all words advance together."""
    keys, child, fail, popped = (automaton[k] for k in ("keys", "child", "fail", "popped"))
    n = np.zeros(len(starts), np.int64)
    state, at = np.ones(len(starts), np.int64), starts.copy()
    live = np.flatnonzero(at < ends)
    while len(live):
        want = state[live] * 256 + raw[at[live]]
        spot = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
        hit = keys[spot] == want
        go, stay = live[hit], live[~hit]
        state[go] = child[spot[hit]]
        at[go] += 1
        n[stay] += popped[state[stay]]
        state[stay] = fail[state[stay]]
        live = live[at[live] < ends[live]]
    live = np.flatnonzero(state > 0)
    while len(live):
        n[live] += popped[state[live]]
        state[live] = fail[state[live]]
        live = live[state[live] > 0]
    return n


def _counter(shared):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = shared.value
        for batch, raw, at in slices(batches, "text"):
            starts, ends, in_words = words(raw, at)
            _, first, same = np.unique(span_hashes(raw, starts, ends), return_index=True, return_inverse=True)
            counts = piece_counts(raw, starts[first], ends[first], automaton)[same] if len(first) else np.zeros(0, np.int64)
            total = np.concatenate([[0], np.cumsum(counts)])
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(np.diff(in_words)), pa.array(total[in_words[1:]] - total[in_words[:-1]])], names=["key", "n_words", "n_tokens"])

    return rows


def count_tokens(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, n_words, n_tokens) of every whole text. The automaton is broadcast; its size is the vocabulary's."""
    shared = docs.sparkSession.sparkContext.broadcast(build_automaton(read_vocabulary(vocabulary)))
    schema = f"key {docs.schema[key].dataType.simpleString()}, n_words bigint, n_tokens bigint"
    return docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(_counter(shared), schema).withColumnRenamed("key", key)


