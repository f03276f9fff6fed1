"""Quality rules by repetition inside a text, found with suffix arrays.

The words of a text are the letters of a suffix array. It is built by prefix doubling for all texts of a slice together (a letter
is a word of one text, so nothing is shared between texts), sorting on only where neighbours still agree. Neighbours that
share `min_words` or more get their longest common prefix (LCP) from the ranks of the doubling steps. The LCP intervals of the
array are the repeated substrings; one is maximal if its occurrences cannot all be extended to the left either. A maximal
repeat covers its occurrences, and the union of all of them is, for each word, what the longest interval at it covers: an
interval that is not maximal lies inside one that starts a word earlier. So the union costs linear work even where the
intervals nest, and nothing is capped.

A text is kept unless it has too few words, repeats too many of its words in windows of `min_words` (the base rules), covers more
than `max_covered` of its words' characters by maximal repeats, or holds a repeat longer than `max_longest` words.

Words are runs of bytes other than blanks 0x20, 0x09-0x0D; lines are split at \n. Words, lines and prefixes are told apart by 64-bit
hashes and ranks.

Defined results: a null or empty text has no words and fails the base rules; repeated rows get equal results; an empty table gives
no rows; only key and text are read, so extra columns cannot clash. Texts are taken whole, one at a time where longer than a
slice; memory is about 100 bytes a word of the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import U64, mix64, slices, span_hashes, words

MIN_WORDS = 8
MIN_TEXT_WORDS = 20
MAX_REPEAT_PERCENT = 30
MAX_COVERED_PERCENT = 40
MAX_LONGEST = 50
IS_SYMBOL = np.zeros(256, dtype=bool)
IS_SYMBOL[list(b"#*$%&|<>")] = True


def _ranked(keys: np.ndarray) -> np.ndarray:
    """The place of each key's first equal in sorted order."""
    order = np.argsort(keys)
    ordered = keys[order]
    first = np.empty(len(keys), dtype=bool)
    first[:1] = True
    np.not_equal(ordered[1:], ordered[:-1], out=first[1:])
    out = np.empty(len(keys), np.int64)
    out[order] = np.maximum.accumulate(np.where(first, np.arange(len(keys)), 0))
    return out


def suffix_lcp(letters: np.ndarray, ends: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array and LCPs of the suffixes that share min_words letters with another; suffix i ends before ends[i].

    Returns (sa, lcp): suffixes in order, and the letters each shares with the one before it (0 where under min_words).
    Equal letters must stand for one word of one text.
    """
    n = len(letters)
    rank, k = _ranked(letters), 1
    levels = [(1, rank.astype(np.int32))]
    while 2 * k <= min_words:
        rank = _ranked(rank * (n + 1) + _following(rank, ends, k) + 1)
        k *= 2
        levels.append((k, rank.astype(np.int32)))
    size = np.bincount(rank, minlength=n)
    active = np.flatnonzero(size[rank] > 1)
    chosen = active
    while len(active):
        rank = rank.copy()
        pair = rank[active] * (n + 1) + _following(rank, ends, k, active) + 1
        order = np.argsort(pair)
        active, pair = active[order], pair[order]
        group = rank[active]
        new = np.append(True, pair[1:] != pair[:-1])
        at = np.arange(len(active))
        base = np.searchsorted(group, group)  # active suffixes stand in rank order, a whole group together
        rank[active] = group + np.maximum.accumulate(np.where(new, at, 0)) - base
        last = np.append(new[1:], True)
        k *= 2
        levels.append((k, rank.astype(np.int32)))
        active = active[~(new & last)]
    sa = chosen[np.argsort(rank[chosen])]
    lcp = np.zeros(len(sa), np.int64)
    if len(sa):
        a, b, shared = sa[:-1], sa[1:], np.zeros(len(sa) - 1, np.int64)
        for k, rank in reversed(levels):
            x, y = a + shared, b + shared
            inside = np.flatnonzero((x < ends[a]) & (y < ends[b]))
            shared[inside[rank[x[inside]] == rank[y[inside]]]] += k
        lcp[1:] = np.where(shared >= min_words, shared, 0)
    return sa, lcp


def _following(rank: np.ndarray, ends: np.ndarray, k: int, at: np.ndarray | None = None) -> np.ndarray:
    """The rank k letters on, -1 beyond the text's end."""
    at = np.arange(len(rank)) if at is None else at
    on = at + k
    inside = on < ends[at]
    return np.where(inside, rank[np.where(inside, on, 0)], -1)


def maximal_repeats(sa: np.ndarray, lcp: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, last, length) of the LCP intervals of sa that are maximal repeats; before[p] names the letter before suffix p (-1 - p at a text's start)."""
    change = np.append(0, np.cumsum(before[sa[1:]] != before[sa[:-1]]) if len(sa) else [])
    out, stack = [], []
    for i, length in enumerate([*lcp[1:].tolist(), 0] if len(sa) else [], 1):
        first = i - 1
        while stack and stack[-1][1] > length:
            first, shared = stack.pop()
            if change[i - 1] > change[first]:  # the occurrences differ in the letter before
                out.append((first, i - 1, shared))
        if length and (not stack or stack[-1][1] < length):
            stack.append((first, length))
    return tuple(np.array(x, np.int64) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 3


def measures(raw: np.ndarray, at: np.ndarray, min_words: int) -> dict[str, np.ndarray]:
    """Counts and repeats of each text raw[at[i]:at[i + 1]]."""
    n = len(at) - 1
    starts, ends, in_words = words(raw, at)
    points = np.append(0, np.cumsum((raw & 0xC0) != 0x80))
    chars = points[ends] - points[starts]
    doc = np.repeat(np.arange(n), np.diff(in_words))
    cuts = np.flatnonzero(raw == 10)
    line_from = np.unique(np.concatenate([at[:-1], cuts + 1]))
    line_from = line_from[line_from < len(raw)]
    line_doc = np.searchsorted(at, line_from, "right") - 1
    line_to = np.append(line_from[1:], len(raw))
    line_to = line_to - ((line_to > line_from) & (raw[line_to - 1] == 10)) if len(line_to) else line_to
    hashes = span_hashes(raw, np.concatenate([starts, line_from]), np.concatenate([ends, line_to]))
    of_doc = lambda h, d: mix64(h + (d.astype(U64) + U64(1)) * U64(0x9E3779B97F4A7C15))
    with np.errstate(over="ignore"):
        letters, lines = of_doc(hashes[: len(starts)], doc), of_doc(hashes[len(starts) :], line_doc)
    worded = np.searchsorted(starts, line_to) > np.searchsorted(starts, line_from)
    lines, line_doc = lines[worded], line_doc[worded]
    order = np.argsort(lines, kind="stable")
    twice = np.append(False, lines[order][1:] == lines[order][:-1])[: len(lines)]
    end_of = in_words[doc + 1]
    sa, lcp = suffix_lcp(letters, end_of, min_words)
    best = np.zeros(len(starts), np.int64)
    best[sa] = np.maximum(lcp, np.append(lcp[1:], 0)[: len(lcp)])
    held = np.flatnonzero(best)
    step = np.zeros(len(starts) + 1, np.int64)
    np.add.at(step, held, 1)
    np.add.at(step, held + best[held], -1)
    covered = np.cumsum(step[:-1]) > 0
    before = np.append(-1, letters[:-1].view(np.int64))[: len(starts)] if len(starts) else np.zeros(0, np.int64)
    before[in_words[:-1][np.diff(in_words) > 0]] = -1 - in_words[:-1][np.diff(in_words) > 0]
    first, last, length = maximal_repeats(sa, lcp, before)
    longest = np.zeros(n, np.int64)
    np.maximum.at(longest, doc[sa[first]], length)
    total = lambda values: np.diff(np.append(0, np.cumsum(values))[in_words])
    opens = covered & ~np.append(False, covered[:-1])[: len(covered)]
    opens[in_words[:-1][np.diff(in_words) > 0]] = covered[in_words[:-1][np.diff(in_words) > 0]]
    closes = covered & ~np.append(covered[1:], False)[: len(covered)]
    closes[in_words[1:][np.diff(in_words) > 0] - 1] = covered[in_words[1:][np.diff(in_words) > 0] - 1]
    opens, closes = np.flatnonzero(opens), np.flatnonzero(closes)
    home = points[at[doc[opens]]]
    return {
        "n_words": np.diff(in_words),
        "word_chars": total(chars),
        "n_symbols": np.diff(np.append(0, np.cumsum(IS_SYMBOL[raw]))[at]),
        "n_dup_lines": np.bincount(line_doc[order][twice], minlength=n),
        "n_repeat_words": total(covered),
        "covered_chars": total(np.where(covered, chars, 0)),
        "n_repeats": np.bincount(doc[sa[first]], minlength=n),
        "longest_repeat": longest,
        "spans": (np.searchsorted(doc[opens], np.arange(n + 1)), points[starts[opens]] - home, points[ends[closes]] - home),
    }


NUMBERS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_chars", "n_repeats", "longest_repeat")


def _measurer(min_words: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw, at in slices(batches, "text"):
            found = measures(raw, at, min_words)
            edges, begin, end = found["spans"]
            spans = pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.StructArray.from_arrays([pa.array(begin), pa.array(end)], ["start", "end"]))
            yield pa.RecordBatch.from_arrays([batch.column("key"), *[pa.array(found[c].astype(np.int64)) for c in NUMBERS], spans], names=["key", *NUMBERS, "spans"])

    return rows


def measure_repetition(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(key, counts, n_repeats, longest_repeat in words, spans) of every whole text; spans are the union of its maximal repeats, in code points, end exclusive."""
    schema = f"key {docs.schema[key].dataType.simpleString()}, " + ", ".join(f"{c} bigint" for c in NUMBERS) + ", spans array<struct<start:bigint,end:bigint>>"
    return docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(_measurer(min_words), schema).withColumnRenamed("key", key)


def repetition_rules(
    docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, min_text_words: int = MIN_TEXT_WORDS, max_repeat_percent: int = MAX_REPEAT_PERCENT, max_covered_percent: int = MAX_COVERED_PERCENT, max_longest: int = MAX_LONGEST
) -> DataFrame:
    """measure_repetition with base_failed and kept: false where the base rules fail, maximal repeats cover too much, or one is too long."""
    found = measure_repetition(docs, key, text, min_words)
    failed = (F.col("n_words") < min_text_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    varied = (100 * F.col("covered_chars") <= max_covered_percent * F.col("word_chars")) & (F.col("longest_repeat") <= max_longest)
    rest = [c for c in found.columns if c not in (key, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return found.select(key, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & varied).alias("kept"), *rest)
