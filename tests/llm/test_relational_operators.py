"""op3, op7, op8, op9, op10 and the pipeline against SQL or brute force, plus the defined cases."""

import gzip
import hashlib
import math
import os
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pixelspark.llm import embed_dedup, image_copies, mixing, ngram_join, registry, warc
from pixelspark.llm._graph import components
from pixelspark.session import table


def plain(v):
    return repr(round(v, 9)) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "labels", "benchmark", "conversations"):
        con.sql(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    df = registry.QUERIES[name](spark, sf)
    rel = con.sql(registry.ORACLE_SQL[name])
    at = [rel.columns.index(c) for c in df.columns]
    assert len(rel.columns) == len(at)
    assert sorted(tuple(map(plain, r)) for r in df.collect()) == sorted(tuple(plain(r[i]) for i in at) for r in rel.fetchall())


def union_find(nodes, edges):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(400, 460)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    want = union_find({x for e in edges for x in e}, edges)
    assert all(got.get(n, n) == c for n, c in want.items())
    assert components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


# op3


def shingles(text):
    ws = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))
    return {tuple(ws[i : i + 5]) for i in range(len(ws) - 4)} if len(ws) >= 5 else {tuple(ws)} if ws else set()


def near_copies():
    """Families of near copies around the threshold, shared passages, exact copies, odd texts."""
    rng = np.random.default_rng(3)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [vocabulary[i] for i in rng.integers(0, 400, 60)]
    rows = [(0, None), (1, ""), (2, " \t "), (3, "One two"), (4, "one TWO"), (5, "one two three four"), (6, "a b c d e"), (7, "A B C D E")]
    for _ in range(8):
        base = [vocabulary[i] for i in rng.integers(0, 400, rng.integers(20, 150))]
        for _ in range(30):
            words = list(base)
            for _ in range(rng.integers(0, 6)):
                words[rng.integers(0, len(words))] = vocabulary[rng.integers(0, 400)]
            rows.append((len(rows), " ".join(words)))
    for _ in range(60):
        own = [vocabulary[i] for i in rng.integers(0, 400, rng.integers(5, 40))]
        rows.append((len(rows), " ".join(own + passage)))
    return rows


def test_ngram_join_equals_brute_force(spark):
    rows = near_copies()
    sets = {i: shingles(t) for i, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    want = union_find(sets, links)
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id bigint, text string, n int, set int")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.similar_documents(df).collect()}
    assert got == {i: (len(sets[i]), want[i]) for i in sets}


def one_far_pair():
    """A block of 42 sets that meet at one word only; the smallest and the largest are the only similar pair, too far apart for a near round."""

    def hashes(ws):
        text = " ".join(ws).encode()
        return [int(h) for h in ngram_join.shingle_sets(np.frombuffer(text, np.uint8), np.array([0, len(text)]), 1)[0]]

    passage = sorted((f"p{i}" for i in range(85)), key=lambda w: hashes([w])[0])
    texts = [passage, passage + [f"b{i}" for i in range(28)]]
    for j in range(40):
        gone = {(17 * j + j // 5 + i) % 84 for i in range(17)}
        texts.append([passage[0]] + [w for i, w in enumerate(passage[1:]) if i not in gone] + [f"o{j}x{i}" for i in range(22)])
    return [(i + 100, " ".join(t)) for i, t in enumerate(texts)]


def test_ngram_join_links_a_pair_far_apart_in_a_block(spark):
    rows = one_far_pair()
    sets = {i: set(t.split()) for i, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    assert links == [(100, 101)]
    got = ngram_join.similar_documents(spark.createDataFrame(rows, "doc_id bigint, text string"), width=1).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == union_find(sets, links)


def tree_cases():
    rng = np.random.default_rng(5)
    sets = []
    for _ in range(12):
        base = rng.integers(0, 1 << 62, rng.integers(30, 300)).astype(np.uint64)
        for _ in range(20):
            other = base.copy()
            hit = rng.random(len(base)) < rng.uniform(0, 0.2)
            other[hit] = rng.integers(0, 1 << 62, hit.sum()).astype(np.uint64)
            sets.append(np.unique(other))
    n = np.array([len(s) for s in sets])
    true = {(a, b) for a in range(len(sets)) for b in range(a + 1, len(sets)) if 175 * len(np.intersect1d(sets[a], sets[b])) >= 75 * (n[a] + n[b])}
    return sets, n, true


def test_tree_pairs_keeps_every_similar_pair():
    sets, n, true = tree_cases()
    vectors = np.stack([ngram_join.count_vector(s, ngram_join.TREE_DIMS) for s in sets])
    whole = ngram_join.CountTree(n, 2 * n, vectors)
    assert len(whole.levels) > 2
    got = {(a, b) for a, b in ngram_join.tree_pairs(whole, whole, 75) if a < b}
    assert true and true <= got and len(got) < len(sets) ** 2 / 6
    # trees of different depth
    few = np.arange(0, len(sets), 31)
    got = set(ngram_join.tree_pairs(ngram_join.CountTree(n[few], 2 * n[few], vectors[few]), whole, 75))
    assert {(i, b) for i, f in enumerate(few) for b in range(len(sets)) if (min(f, b), max(f, b)) in true or f == b} <= got
    assert all(ngram_join.overlap_bound(sets[a], sets[b]) >= ngram_join.overlap(sets[a], sets[b]) for a, b in got)


def test_ngram_join_cuts_large_blocks_into_tiles(spark, monkeypatch):
    """Many chains around one passage: every token is open after the pivots, and its sets fill many tiles."""
    rows = near_copies()
    sets = {i: shingles(t) for i, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    monkeypatch.setattr(ngram_join, "TILE_SETS", 5)
    monkeypatch.setattr(ngram_join, "open_entries", lambda entries, linked: entries.withColumn("part", F.col("node")).select("token", "node", "n", "reach", "part"))
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.similar_documents(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)).collect()}
    assert got == union_find(sets, links)


def test_all_links_of_the_given_table_come_out_of_trees(spark, sf, tmp_path, monkeypatch):
    """Every edge is a pair that a descent left: the points and pairs of the given table's trees are counted."""
    plain, seen = ngram_join._star, str(tmp_path / "seen")

    def counting(percent):
        inner = plain(percent)

        def rows(table):
            out = inner(table)
            with open(f"{seen}-{os.getpid()}", "a") as f:
                f.write(f"{table.num_rows} {out.num_rows}\n")
            return out

        return rows

    monkeypatch.setattr(ngram_join, "_star", counting)
    found = ngram_join.similar_documents(table(spark, sf, "documents"))
    linked = found.where("doc_id <> component_id").count()
    counts = [tuple(map(int, line.split())) for f in tmp_path.iterdir() for line in f.read_text().splitlines()]
    assert linked > 0 and sum(c[0] for c in counts) > 0 and sum(c[1] for c in counts) > 0


def test_ngram_join_defined_cases(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert ngram_join.similar_documents(empty).count() == 0
    blank = spark.createDataFrame([(5, None), (6, ""), (7, None)], "doc_id bigint, text string")
    assert sorted(map(tuple, ngram_join.similar_documents(blank).collect())) == [(5, 0, 5), (6, 0, 6), (7, 0, 7)]
    repeats = spark.createDataFrame([(5, "a b c d e f"), (5, "a b c d e f"), (None, "a b c d e f"), (9, "x " * 30000)], "doc_id bigint, text string")
    assert sorted((r[0] or 0, r[1], r[2]) for r in ngram_join.similar_documents(repeats).collect()) == [(0, 2, 5), (5, 2, 5), (5, 2, 5), (9, 5 - 4, 9)]


def test_ngram_join_links_null_and_repeated_keys(spark):
    base = [f"w{i}" for i in range(60)]
    near = [" ".join([f"{c}{i}" for i in range(3)] + [f"{c}{w}" for w in base]) for c in "ab"]
    other = [" ".join([f"{c}{i}" for i in range(9, 12)] + [f"{c}{w}" for w in base]) for c in "ab"]
    rows = [(7, near[0]), (None, other[0]), (20, near[1]), (20, "z y x w v u"), (20, "an unrelated text of some more words"), (30, other[1]), (5, "z y x w v u")]
    got = ngram_join.similar_documents(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    kept = ngram_join.first_of_each(spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id bigint, text string, key string, text_a int"))
    assert kept.columns == ["doc_id", "text", "key", "text_a"]
    assert sorted((r["doc_id"] or 0, r["text"][:4]) for r in kept.collect()) == [(0, other[0][:4]), (5, "z y "), (7, near[0][:4]), (20, "an u"), (20, near[1][:4])]
    assert sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"]) for r in got) == [(0, 59, 7), (5, 2, 5), (7, 59, 7), (20, 2, 5), (20, 3, 20), (20, 59, 20), (30, 59, 20)]


# op7


def test_lattice_decoder_is_nearest():
    rng = np.random.default_rng(1)
    x = rng.normal(0, 2, (300, 8))
    got = embed_dedup.nearest_e8(x)
    assert (((got * 2) % 1) == 0).all() and ((got.sum(axis=1) % 2) == 0).all()
    roots = [np.array(v) for v in np.unique(embed_dedup.nearest_e8(rng.normal(0, 0.9, (60_000, 8))), axis=0)]
    best = np.min([((x - got - r) ** 2).sum(axis=1) for r in roots], axis=0)
    assert (((x - got) ** 2).sum(axis=1) <= best + 1e-9).all()


def test_lattice_recall_and_precision(spark):
    rng = np.random.default_rng(8)
    rows = []
    for c in range(60):
        base = rng.normal(size=64)
        for _ in range(10):
            noise = rng.normal(size=64)
            v = base / np.linalg.norm(base) + rng.uniform(0, 0.24) * noise / np.linalg.norm(noise)
            rows.append((len(rows), [float(np.float32(a)) for a in v * rng.uniform(0.5, 3)], c % 3))
    x = np.array([r[1] for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([r[2] for r in rows])
    true = ((x @ x.T >= 0.98) & (label[:, None] == label[None]) & ~np.eye(len(x), dtype=bool)).sum(axis=1)
    got = {r["vec_id"]: r["n_links"] for r in embed_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")).collect()}
    assert all(got[i] <= true[i] for i in got)
    assert sum(got.values()) >= 0.97 * true.sum() > 100


def test_near_duplicates_defined_cases(spark):
    nan, v = float("nan"), [1.0, 2.0, 3.0]
    rows = [(1, v, 0), (2, v, 0), (2, v, 0), (3, [2.0, 4.0, 6.0], 0), (4, v, 1), (5, v, None), (6, None, 0), (7, [0.0, 0.0, 0.0], 0), (8, [1.0, nan, 0.0], 0), (9, [1.0, None, 0.0], 0), (10, [], 0), (11, [1.0, 2.0], 0), (12, [float("inf"), 1.0, 1.0], 0)]
    df = spark.createDataFrame([(*r, 7) for r in rows], "vec_id bigint, embedding array<double>, label int, point int")
    got = sorted(map(tuple, embed_dedup.near_duplicates(df).collect()))
    linked = {(1, 3, 1, True), (2, 3, 1, False), (3, 3, 1, False)}
    assert set(got[:4]) == linked and all(r[1:] == (0, r[0], True) for r in got[4:])
    assert embed_dedup.near_duplicates(df.limit(0)).count() == 0


def test_near_duplicates_tiny_and_huge_vectors(spark):
    eye = np.eye(3)
    rows = [(i, [float(c) * s for c in eye[i % 3]], 0) for i, s in enumerate([1e-200] * 3 + [1e200] * 3 + [5e-324] * 3)]
    got = sorted(map(tuple, embed_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")).collect()))
    assert got == [(i, 2, i % 3, i < 3) for i in range(9)]


def test_near_duplicates_counts_each_pair_once_over_tiles(spark, monkeypatch):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(3, 24))
    x = (base[rng.integers(0, 3, 150)] + rng.normal(size=(150, 24)) * 0.14).astype(np.float32)
    y = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    true = (y @ y.T >= 0.98) & ~np.eye(150, dtype=bool)
    monkeypatch.setattr(embed_dedup, "TILE_POINTS", 7)
    monkeypatch.setattr(embed_dedup, "BUCKET_ROWS", 50)
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>, label int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embed_dedup.near_duplicates(df, scale=6.0).collect()}
    want = union_find(range(150), np.argwhere(true))
    assert 150 < true.sum() < 150 * 50 and got == {i: (int(true[i].sum()), want[i]) for i in range(150)}


# op8


def test_image_copies_find_edits(spark):
    vectors = table(spark, "/root/testdata/sf0.01", "embeddings")
    images = image_copies.frames_of_vectors(vectors)
    queries = image_copies.frames_of_vectors(vectors.where("vec_id % 20 = 0"), edit_step=20)
    found = {(r["query"], r["image"]) for r in image_copies.copies(queries, images).collect()}
    x = {r["vec_id"]: np.array(r["embedding"]) for r in vectors.collect()}
    assert sum((q, q) in found for q in range(0, 500, 20)) >= 24
    assert all(x[a] @ x[b] >= 0.8 * np.linalg.norm(x[a]) * np.linalg.norm(x[b]) for a, b in found)


def consensus(match, least_votes, seed_tolerance):
    """(query, image, votes) of matched corners, with DataFrame functions: votes in overlapping bins, counted by place."""
    match = match.select(*[F.col(c).cast("double").alias(c) if k == "float" else F.col(c) for c, k in match.dtypes])
    turn = F.col("i_angle") - F.col("q_angle")
    ratio = F.col("i_scale") / F.col("q_scale")
    c, s = F.cos(turn) * ratio, F.sin(turn) * ratio
    step = turn / (3.141592653589793 / 8)
    turns = F.array(F.pmod(F.floor(step), F.lit(16)) * 2, F.pmod(F.floor(step + 0.5), F.lit(16)) * 2 - 1)
    shift_x, shift_y = F.col("i_x") - (c * F.col("q_x") - s * F.col("q_y")), F.col("i_y") - (s * F.col("q_x") + c * F.col("q_y"))
    size = F.lit(4 * seed_tolerance)
    votes = match.select(F.col("q_image").alias("query"), F.col("i_image").alias("image"), "q_x", "q_y", F.round(F.log2(ratio) * 2).alias("zoom"), turns.alias("turns"), shift_x.alias("sx"), shift_y.alias("sy"))
    both = lambda v: F.array(F.floor(v / size), F.floor(v / size + 0.5) + 0.5)
    votes = votes.withColumn("turn", F.explode("turns")).withColumn("bx", F.explode(both(F.col("sx")))).withColumn("by", F.explode(both(F.col("sy"))))
    counted = votes.groupBy("query", "image", "zoom", "turn", "bx", "by").agg(F.count_distinct(F.round("q_x"), F.round("q_y")).alias("votes"))
    return counted.groupBy("query", "image").agg(F.max("votes").alias("votes")).where(F.col("votes") >= least_votes)


def test_image_tables_against_all_descriptor_pairs(spark):
    """Recall over all copies, those of near images included, against comparing every descriptor with every other."""
    rng = np.random.default_rng(6)
    base = rng.normal(size=(30, 64))
    rows = [(10 * i + k, (base[i] + rng.normal(size=64) * 0.12 * k).tolist()) for i in range(30) for k in range(8)]
    vectors = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    images = image_copies.frames_of_vectors(vectors)
    queries = image_copies.frames_of_vectors(vectors.where("vec_id % 10 = 0"), edit_step=10)
    index, probe = image_copies.descriptors(images).cache(), image_copies.descriptors(queries).cache()
    every = image_copies.close(image_copies.sided(probe, "q").crossJoin(image_copies.sided(index, "i")), 24)
    want = {(r["query"], r["image"]) for r in consensus(every, 4, 3.0).collect()}
    got = {(r["query"], r["image"]) for r in image_copies.copies(queries, images).collect()}
    assert len(want) > 60 and got <= want and len(got) >= 0.9 * len(want)
    counts = {r["query"]: (r["n_copies"], r["best_image"]) for r in image_copies.copy_counts(queries, images.union(images.withColumn("image", F.col("image") + 1000))).collect()}
    assert counts.keys() == set(range(0, 300, 10))
    assert all(counts[q][0] == 2 * sum(a == q for a, _ in got) and (counts[q][1] is None or (q, counts[q][1]) in got) for q in counts)


def test_image_copies_defined_cases(spark):
    kind = "image bigint, width int, height int, data binary, extra string"
    flat, bad = bytes(64 * 64), bytes(10)
    odd = spark.createDataFrame([(1, 64, 64, flat, "a"), (2, 64, 64, None, "b"), (3, 64, 64, bad, "c"), (None, 64, 64, flat, "d"), (4, 0, 0, b"", "e"), (5, 3, 3, bytes(9), "f")], kind)
    assert image_copies.descriptors(odd).count() == 0 and image_copies.copies(odd, odd).count() == 0
    assert sorted(map(tuple, image_copies.copy_counts(odd, odd).collect())) == [(i, 0, None, None) for i in range(1, 6)]
    vectors = table(spark, "/root/testdata/sf0.001", "embeddings").where("vec_id < 3")
    images = image_copies.frames_of_vectors(vectors)
    doubled = images.union(images.withColumn("image", F.col("image") + 100)).union(images)
    assert sorted((r["query"], r["image"]) for r in image_copies.copies(images, doubled).collect()) == [(i, i + k) for i in range(3) for k in (0, 100)]


def test_image_joins_are_never_broadcast(spark, monkeypatch):
    """Every side grows with the images or the queries, so none goes through the driver, however small its file is."""
    plans = []
    written = image_copies.written
    monkeypatch.setattr(image_copies, "written", lambda df, name: plans.append(df) or written(df, name))
    vectors = table(spark, "/root/testdata/sf0.001", "embeddings")
    images = image_copies.frames_of_vectors(vectors)
    queries = image_copies.frames_of_vectors(vectors.where("vec_id % 20 = 0"), edit_step=20)
    plans += [image_copies.copies(queries, images), image_copies.copy_counts(queries, images)]
    texts = [df._jdf.queryExecution().executedPlan().toString() for df in plans]
    assert sum("SortMergeJoin" in t for t in texts) >= 4 and not any("Broadcast" in t for t in texts)


# op9


def test_warc_round_trip(spark, tmp_path):
    text = "päge " * 50
    rows = [(1, "u", text), (2, None, text), (3, "u", "short"), (4, "u", "short"), (5, "u\r\nx: y", None), (6, "u", "a\r\n\r\nWARC/1.1\r\n" * 40), (7, "u", "é" * 100_000), (8, "u", "z" * 99), (9, "u", "z" * 99), (10, "u", "q" * 100), (11, "u", "q" * 100), (12, "u", "same"), (12, "u", "same"), (None, "u", "no id"), (13, "u", "y" * 10), (13, "u", "y" * 3000), (14, "v", "y" * 3000), (13, "u", "v" * 120)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id bigint, url string, html string, record_id string")
    got = sorted(map(tuple, warc.archive_round_trip(pages.drop("record_id"), f"file://{tmp_path}/w", chunk_bytes=1000).collect()))
    first = {}
    want = []
    for i, _, t in rows:
        if i is not None:
            body = (t or "").encode()
            d = hashlib.sha256(body).hexdigest()
            of = first.setdefault(d, i) if len(body) >= 100 else i
            want.append((i, len(body), d, "response" if of == i else "revisit", None if of == i else of))
    assert got == sorted(want)
    chunks = warc.read_archives(spark, f"file://{tmp_path}/w")
    assert chunks.where("not intact").count() == 0 and chunks.agg(F.max("payload_bytes")).first()[0] == 1000
    long = chunks.where("record_id = 7").orderBy("chunk_no").collect()
    assert len(long) == 200 and b"".join(r["payload"] for r in long).decode() == "é" * 100_000
    assert long[3]["running_digest"] == hashlib.sha256(("é" * 2000).encode()).hexdigest()


def test_warc_reader_digests_what_it_reads(spark, tmp_path):
    texts = {1: "long text " * 900, 2: "other", 3: "long text " * 900, 4: "z" * 2500}
    pages = spark.createDataFrame([(i, "u", t) for i, t in texts.items()], "page_id bigint, url string, html string").coalesce(1)
    path = f"file://{tmp_path}/w"
    warc.write_archives(warc.record_chunks(pages, warc.record_plan(pages, "page_id", "html", 100), chunk_bytes=1000), path, records_per_file=4)
    got = {r["page_id"]: (r["payload_bytes"], r["payload_digest"], r["record_type"]) for r in warc.read_pages(spark, path).collect()}
    assert got == {i: (len(t), hashlib.sha256(t.encode()).hexdigest(), "revisit" if i == 3 else "response") for i, t in texts.items()}
    assert warc.read_archives(spark, path).where("running_digest is null").count() > 0  # a record runs on in other files
    for f in (tmp_path / "w").glob("*.gz"):
        data = gzip.decompress(f.read_bytes())
        if b"zzz" in data:
            f.write_bytes(gzip.compress(data.replace(b"zzz", b"zzy", 1)))
            (tmp_path / "w" / f".{f.name}.crc").unlink(missing_ok=True)
            break
    with pytest.raises(Exception, match="damaged record 4"):
        warc.read_pages(spark, path).collect()


def test_warc_reader_refuses_cut_and_missing_archives(spark, tmp_path):
    pages = spark.createDataFrame([(i, "u", f"{i} text " * 300) for i in range(20)], "page_id bigint, url string, html string").coalesce(1)
    warc.archive_round_trip(pages, f"file://{tmp_path}/w")
    (file,) = (tmp_path / "w").glob("*.gz")
    whole = file.read_bytes()
    plain = gzip.decompress(whole)
    assert plain.count(b"\r\nWARC-Date: ") == 20 and plain.count(b"\r\nContent-Type: application/http; msgtype=response\r\n") == 20
    (tmp_path / "w" / f".{file.name}.crc").unlink(missing_ok=True)
    unfinished = gzip.zlib.compressobj(9, gzip.zlib.DEFLATED, 31)
    at_edge = unfinished.compress(plain[: plain.index(b"WARC/1.1", 5000)]) + unfinished.flush(gzip.zlib.Z_SYNC_FLUSH)
    for data in (whole[: len(whole) // 2], at_edge):
        file.write_bytes(data)
        with pytest.raises(Exception, match="cut short"):
            warc.read_pages(spark, f"file://{tmp_path}/w").collect()


def test_warc_revisits_have_a_profile(spark, tmp_path):
    pages = spark.createDataFrame([(i, "u", "z" * 200) for i in range(3)], "page_id bigint, url string, html string").coalesce(1)
    warc.archive_round_trip(pages, f"file://{tmp_path}/w")
    plain = b"".join(gzip.decompress(f.read_bytes()) for f in (tmp_path / "w").glob("*.gz"))
    assert plain.count(f"\r\nWARC-Profile: {warc.REVISIT_PROFILE}\r\n".encode()) == 2 and plain.count(b"\r\nWARC-Refers-To: <urn:record:0:") == 2


def test_warc_of_nothing(spark):
    assert warc.archive_round_trip(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0


# op10


def test_mixing_matches_poisson_and_weights(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 15_000, "big").when(F.col("id") < 19_000, "mid").otherwise(None).alias("source"), F.lit(3).alias("copy_no"))
    weights = {"big": 0.3, "mid": 0.4, None: 0.3}
    out = mixing.mix_sources(docs, weights=weights)
    got = {r["source"]: r["n"] for r in out.groupBy("source").agg(F.count("*").alias("n")).collect()}
    assert all(abs(got[s] / 20_000 - w) < 0.03 for s, w in weights.items())
    counts = [r["n"] for r in docs.where("source = 'mid'").select("doc_id").join(out.groupBy("doc_id").agg(F.count("*").alias("n")), "doc_id", "left").select(F.coalesce("n", F.lit(0)).alias("n")).collect()]
    for k in range(5):
        assert abs(counts.count(k) / len(counts) - math.exp(-2) * 2**k / math.factorial(k)) < 0.03
    assert out.exceptAll(mixing.mix_sources(docs.repartition(7), weights=weights)).count() == 0
    keys = [r[0] for r in out.select("shuffle_key").collect()]
    assert keys == sorted(keys)


def test_mixing_defined_cases(spark):
    docs = spark.createDataFrame([(1, "a", "x"), (1, "a", "x"), (None, None, "y"), (2, "b", None)], "doc_id bigint, source string, text string")
    out = mixing.mix_sources(docs, weights={"a": 1.0, "b": 0.0}, epochs=3.0)
    assert {r["source"] for r in out.select("source").distinct().collect()} <= {"a"}
    assert mixing.mix_sources(docs.limit(0)).count() == 0
    assert mixing.mix_sources(docs, weights={}).count() == 0
    names = ["mix_cdf", "mix_source", "mix_u", "mix_draws", "c0", "cdf", "u", "draws", "Rate"]
    clashing = docs.select("*", *[F.lit(i).alias(c) for i, c in enumerate(names)])
    out = mixing.mix_sources(clashing, weights={"a": 1.0}, epochs=3.0)
    assert out.columns == [*clashing.columns, "n_copies", "copy_no", "shuffle_key"] and out.count() > 0
    assert {tuple(r[c] for c in names) for r in out.collect()} == {tuple(range(len(names)))}


def poisson_below(rate, top):
    k = np.arange(top)
    return np.cumsum(np.exp(k * math.log(rate) - rate - np.array([math.lgamma(x + 1) for x in k])))


@pytest.mark.parametrize("rate", [700, 1000, 5000])
def test_mixing_large_rates_match_exact_quantiles(spark, rate):
    n = 400 if rate < 5000 else 100
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.lit("a").alias("source"))
    out = mixing.mix_sources(docs, weights={"a": 1.0}, epochs=float(rate)).groupBy("doc_id").agg(F.max("copy_no").alias("k"), F.count("*").alias("n"), F.max("n_copies").alias("c")).collect()
    assert len(out) == n and all(r["k"] == r["n"] == r["c"] for r in out)

    # every count is the sum of exact quantiles at the hashed numbers
    draws = -(-rate // 700)
    below = poisson_below(rate / draws, 1400)

    def u(i, key):
        return (int(hashlib.md5(f"7+{i}:{key}".encode() if i > 1 else f"7:{key}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52

    assert {r["doc_id"]: r["n"] for r in out} == {d: sum(int(np.searchsorted(below, u(i, d))) for i in range(1, draws + 1)) for d in range(n)}

    # and the counts follow the Poisson distribution of the whole rate (Kolmogorov's bound at 0.1%)
    whole = poisson_below(rate, 2 * rate)
    counts = np.sort([r["n"] for r in out])
    ranks = np.searchsorted(counts, np.arange(len(whole)), side="right") / n
    assert np.abs(ranks - whole).max() < 1.95 / math.sqrt(n)


def test_mixing_one_row_beside_a_large_source(spark):
    docs = spark.range(1_000_001).select(F.col("id").alias("doc_id"), F.when(F.col("id") > 0, "big").alias("source"))
    rate = 1_000_001 / (1 + 1000)
    assert abs(mixing.mix_sources(docs).where("source is null").count() - rate) < 6 * math.sqrt(rate)


def test_mixing_is_native(spark, sf):
    plan = registry.QUERIES["op10_poisson_mixing"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# pipeline


def test_pipeline_stages(spark, sf):
    docs = table(spark, sf, "documents")
    last = len(corpus_pipeline.STAGES) - 1
    seen = {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        docs = stage(spark, docs, sf).cache()
        seen[name] = docs.count()
        if i < last:
            assert docs.columns == before.columns
        if name == "near_copies":
            assert ngram_join.similar_documents(docs).where("doc_id <> component_id").count() == 0
        if name == "pii":
            assert docs.where("text rlike '[a-z0-9.]+@[a-z0-9]+[.]example'").count() == 0
    assert seen["quality"] >= seen["near_copies"] == seen["pii"] > 0
    assert seen["pieces"] >= seen["mixing"]
