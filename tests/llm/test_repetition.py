"""op13 against brute force on windows and pairs of places, and its defined cases."""

import re
from collections import Counter

import numpy as np
import pytest

from pixelspark.llm import repetition as rp

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text, k):
    """Counts, covered words, maximal repeats and the longest one, by comparing all pairs of places."""
    text = text or ""
    found = list(WORD.finditer(text))
    ws = [m[0] for m in found]
    n = len(ws)
    covered, maximal = set(), set()
    windows = Counter(tuple(ws[i : i + k]) for i in range(n - k + 1))
    for i in range(n - k + 1):
        if windows[tuple(ws[i : i + k])] > 1:
            covered.update(range(i, i + k))
    for i in range(n):
        for j in range(i + 1, n):
            if i and ws[i - 1] == ws[j - 1]:
                continue
            length = 0
            while j + length < n and ws[i + length] == ws[j + length]:
                length += 1
            if length >= k:
                maximal.add(tuple(ws[i : i + length]))
    lines = [x for x in text.split("\n") if WORD.search(x)]
    spans, run = [], None
    for i in sorted(covered):
        if run is not None and i == run + 1:
            spans[-1][1] = found[i].end()
        else:
            spans.append([found[i].start(), found[i].end()])
        run = i
    return {
        "n_words": n, "word_chars": sum(map(len, ws)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered),
        "covered_chars": sum(len(ws[i]) for i in covered), "n_repeats": len(maximal), "longest_repeat": max(map(len, maximal), default=0), "spans": [tuple(s) for s in spans],
    }


def random_text(rng, n, letters):
    out = [rng.choice(letters) for _ in range(n)]
    if n > 12 and rng.random() < 0.6:
        a, size, b = rng.integers(0, n // 2), rng.integers(2, n // 2), rng.integers(0, n)
        out[b:b] = out[a : a + size]
    return "".join(w + rng.choice([" ", " ", "\n", "\t ", "\r\n", "\n\n"]) for w in out)


@pytest.mark.parametrize("k", [1, 3, 8])
def test_measures_equal_brute_force(spark, k):
    rng = np.random.default_rng(k)
    texts = [random_text(rng, int(rng.integers(0, 90)), letters) for letters in (["a", "b"], ["ab", "é#", "<日本>", "c"], [f"w{i}" for i in range(25)]) for _ in range(30)]
    texts += [None, "", " \n\t", "one", "a " * 60, "a b " * 40, "\n" * 5 + "x y\nx y\nx y \n", "same line here\n" * 3, "ab cd ab cd"]
    docs = spark.createDataFrame([(i, t, "clash", 0) for i, t in enumerate(texts)], "doc_id long, text string, n_words string, spans int").repartition(3)
    got = {r["doc_id"]: r for r in rp.measure_repetition(docs, min_words=k).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        want = brute(t, k)
        row = got[i].asDict()
        row["spans"] = [tuple(s) for s in row["spans"]]
        assert {c: row[c] for c in want} == want, t


def test_long_nested_repeats_stay_linear():
    """One word 200,000 times: every interval nests in the next."""
    text = ("a " * 200_000).encode()
    found = rp.measures(np.frombuffer(text, np.uint8), np.array([0, len(text)]), 8)
    assert (found["n_repeat_words"][0], found["longest_repeat"][0], found["n_repeats"][0]) == (200_000, 199_999, 199_992)


def test_rules(spark):
    words = " ".join(f"v{i}" for i in range(400))
    passage = " ".join(f"p{i}" for i in range(51))
    texts = {1: words, 2: "too few words", 3: f"{passage} {words} {passage}", 4: " ".join(passage.split()[:50]) + f" {words} " + " ".join(passage.split()[:50]), 5: None, 6: f"{words} {words}", 7: "x" * 200 + " 1 2 3 4 5 6 7 " + words + " " + "x" * 200 + " 1 2 3 4 5 6 7"}
    frame = spark.createDataFrame([*texts.items(), (1, words), (None, words)], "doc_id long, text string")
    got = [(r["doc_id"], r["base_failed"], r["kept"]) for r in rp.repetition_rules(frame, max_covered_percent=20).collect()]
    assert sorted(got, key=str) == sorted([(1, False, True), (1, False, True), (None, False, True), (2, True, False), (3, False, False), (4, False, True), (5, True, False), (6, True, False), (7, False, False)], key=str)
    assert rp.repetition_rules(frame.limit(0)).count() == 0
    assert rp.repetition_rules(frame).columns[:8] == ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
