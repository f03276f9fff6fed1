"""The opN_<name> queries, the pipeline query and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelspark.session import table, tidy

from . import embed_dedup, image_copies, lexical_search, mixing, ngram_join, pii, piece_sampling, prefix_trie, quality, repetition, toxicity, warc, wordpiece_count

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = tidy(f)
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


@query(
    "op9_warc_chunks",
    """
    with p as (select page_id, encode(coalesce(html, '')) as body from pages where page_id is not null),
    d as (select page_id, octet_length(body) as n, sha256(body) as h from p),
    f as (select *, min(page_id) over (partition by h) as first_id from d)
    select page_id, cast(n as bigint) as payload_bytes, h as payload_digest,
        case when n >= 100 and first_id <> page_id then 'revisit' else 'response' end as record_type,
        case when n >= 100 and first_id <> page_id then first_id end as refers_to
    from f
    """,
)
def op9_warc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(table(spark, sf_dir, "pages"))


@query(
    "op10_poisson_mixing",
    """
    with recursive s as (select source, count(*) as n from documents group by source),
    t as (select sum(pow(cast(n as double), 0.5)) as all_w, sum(n) as all_n from s),
    r as (select source, pow(cast(n as double), 0.5) / all_w * all_n / n as rate from s, t),
    c(source, rate, k, p, cdf) as (
        select source, rate, 0, exp(-rate), exp(-rate) from r where rate > 0
        union all
        select source, rate, k + 1, p * rate / (k + 1), cdf + p * rate / (k + 1) from c where k < ceil(rate + 12 * sqrt(rate) + 16)
    ),
    u as (
        select d.*, (cast('0x' || substr(md5('7:' || coalesce(cast(doc_id as varchar), '')), 1, 13) as bigint) + 0.5) / 4503599627370496.0 as u
        from documents d
    ),
    m as (
        select u.doc_id, u.source, u.text, count(*) as n_copies
        from u join c on u.source is not distinct from c.source and c.cdf < u.u group by all
    )
    select doc_id, source, text, cast(n_copies as bigint) as n_copies, cast(x.copy_no as bigint) as copy_no,
        md5('order7:' || coalesce(cast(doc_id as varchar), '') || ':' || x.copy_no) as shuffle_key
    from m, lateral (select unnest(range(1, n_copies + 1)) as copy_no) x
    """,
)
def op10_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mixing.mix_sources(docs).select("doc_id", "source", "text", "n_copies", "copy_no", "shuffle_key")


@query("op2_toxicity")
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op5_quality")
def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op6_pii")
def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(table(spark, sf_dir, "documents")).drop("found")


@query(
    "op3_ngram_jaccard",
    """
    with recursive w as (
        select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as ws
        from documents
    ),
    s as (
        select distinct doc_id, unnest(case when len(ws) >= 5 then list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' '))
            when len(ws) > 0 then [array_to_string(ws, ' ')] else [] end) as sh
        from w
    ),
    n as (select doc_id, count(*) as n from s group by doc_id),
    o as (select a.doc_id as a, b.doc_id as b, count(*) as k from s a join s b on a.sh = b.sh and a.doc_id < b.doc_id group by a.doc_id, b.doc_id),
    l as (select a, b from o join n x on x.doc_id = a join n y on y.doc_id = b where 100 * k >= 75 * (x.n + y.n - k)),
    e as (select a, b from l union all select b, a from l),
    r(doc_id, other) as (select a, b from e union select r.doc_id, e.b from r join e on r.other = e.a)
    select d.doc_id, cast(coalesce(n.n, 0) as bigint) as n_shingles, least(d.doc_id, coalesce(m.least_id, d.doc_id)) as component_id
    from documents d left join n using (doc_id) left join (select doc_id, min(other) as least_id from r group by doc_id) m using (doc_id)
    """,
)
def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_documents(table(spark, sf_dir, "documents"))


@query(
    "op7_embedding_dedup",
    """
    with recursive v as (
        select vec_id, label, list_transform(embedding, lambda x: cast(x as double)) as e from embeddings
        where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0
    ),
    l as (select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e) where list_cosine_similarity(a.e, b.e) >= 0.98),
    r(a, b) as (select a, b from l union select r.a, l.b from r join l on r.b = l.a),
    c as (select a, min(b) as least_id from r group by a),
    n as (select a, count(*) as n from l group by a)
    select vec_id, cast(coalesce(n.n, 0) as bigint) as n_links, least(vec_id, coalesce(c.least_id, vec_id)) as component_id, vec_id <= coalesce(c.least_id, vec_id) as kept
    from embeddings d left join n on n.a = d.vec_id left join c on c.a = d.vec_id
    """,
)
def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


@query("op4_token_counts")
def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordpiece_count.count_tokens(table(spark, sf_dir, "documents"))


@query("op1_piece_sampling")
def op1_piece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("text_hash", F.xxhash64(F.replace(F.coalesce("text", F.lit("")), F.lit(piece_sampling.META), F.lit(" "))))
    encoded = piece_sampling.encode_samples(docs, carry=("text_hash",)).withColumn("ids_hash", F.xxhash64("ids"))
    decoded = piece_sampling.decode_ids(encoded, keep_ids=False)
    return decoded.select("doc_id", "sample_no", "n_pieces", "log_prob", "perturbed", "inclusion", "ids_hash", (F.xxhash64("decoded") == F.col("text_hash")).alias("round_trip"))


@query("op8_image_copies")
def op8_image_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edited copies of the images of every hundredth vector, searched among the images of all vectors: how many hold a copy, and the best."""
    vectors = table(spark, sf_dir, "embeddings")
    images = image_copies.frames_of_vectors(vectors)
    queries = image_copies.frames_of_vectors(vectors.where("vec_id % 100 = 0"), edit_step=100)
    return image_copies.copy_counts(queries, images).select(F.col("query").alias("query_id"), "n_copies", F.col("best_image").alias("vec_id"), "votes")


SQL_TERMS = r"""regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"""


@query(
    "op12_lexical_search",
    f"""
    with t as (select doc_id, unnest({SQL_TERMS}) as term from documents),
    n as (select doc_id, count(*) as n from t group by doc_id),
    s as (select count(*) as all_docs, cast(sum(n) as bigint) as all_terms from n),
    f as (select doc_id, term, count(*) as tf from t group by doc_id, term),
    d as (select term, count(*) as df from f group by term),
    q as (select distinct item_id, term from (select item_id, unnest({SQL_TERMS}) as term from benchmark where item_id is not null)),
    r as (
        select item_id, doc_id, sum(cast(floor(1000 * ln((2 * all_docs + 2) / (2 * df + 1))) as bigint) * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * all_docs) // all_terms)))) as score
        from q join f using (term) join d using (term) join n using (doc_id), s group by item_id, doc_id
    )
    select item_id, cast(rank as int) as rank, doc_id, cast(score as bigint) as score
    from (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from r where score > 0) where rank <= 10
    """,
)
def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query(
    "op13_repetition_rules",
    r"""
    with w as (select doc_id, coalesce(text, '') as text, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from documents),
    p as (select doc_id, unnest(range(1, len(ws) + 1)) as i, unnest(ws) as word from w),
    lines as (select doc_id, unnest(string_split(text, chr(10))) as line from w),
    l as (select doc_id, count(*) - count(distinct line) as n_dup_lines from lines where regexp_matches(line, '[^\x20\x09-\x0D]') group by doc_id),
    g as (select doc_id, i, array_to_string(ws[i:i+7], ' ') as g from (select doc_id, ws, unnest(range(1, len(ws) - 6)) as i from w)),
    twice as (select doc_id, i from g qualify count(*) over (partition by doc_id, g) > 1),
    c as (select distinct doc_id, unnest(range(i, i + 8)) as i from twice),
    r as (select doc_id, count(*) as n_repeat_words, sum(length(word)) as covered_chars from c join p using (doc_id, i) group by doc_id),
    h as (select distinct doc_id from (select doc_id, md5(array_to_string(ws[i:i+50], ' ')) as g from (select doc_id, ws, unnest(range(1, len(ws) - 49)) as i from w)) group by doc_id, g having count(*) > 1),
    m as (
        select w.doc_id, len(ws) as n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) as word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as n_symbols,
            coalesce(n_dup_lines, 0) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words, coalesce(covered_chars, 0) as covered_chars, h.doc_id is not null as long_repeat
        from w left join l using (doc_id) left join r using (doc_id) left join h using (doc_id)
    ),
    b as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from m)
    select doc_id, cast(n_words as bigint) as n_words, cast(word_chars as bigint) as word_chars, cast(n_symbols as bigint) as n_symbols, cast(n_dup_lines as bigint) as n_dup_lines,
        cast(n_repeat_words as bigint) as n_repeat_words, base_failed, not base_failed and not long_repeat and 100 * covered_chars <= 40 * word_chars as kept, cast(covered_chars as bigint) as covered_chars
    from b
    """,
)
def op13_repetition_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.repetition_rules(table(spark, sf_dir, "documents")).drop("n_repeats", "longest_repeat", "spans")


#: CRC-32 of the decimal digits of c, bit by bit.
SQL_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(cast(c as varchar), ''), lambda s: cast(ascii(s) as bigint))),
    lambda a, b: list_reduce(list_prepend(xor(a, b), [cast(-1 as bigint) for i in range(8)]), lambda x, i: case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end)))"""


@query(
    "op11_prefix_trie",
    f"""
    with t as (
        select conv_id as c, md5(octet_length(encode(r)) || ':' || r || x) as code, length(x) as n_chars, row_number() over (partition by conv_id order by turn nulls first, md5(octet_length(encode(r)) || ':' || r || x)) as pos
        from (select conv_id, turn, coalesce(role, '') as r, coalesce(text, '') as x from conversations where conv_id is not null)
    ),
    h as (select c, {SQL_CRC} % 6 as h from (select distinct c from t)),
    k as (select h.c, h, count(t.c) as k from h left join t on t.c = h.c - h.c % 100 and pos <= h group by h.c, h),
    own as (
        select k.c, pos as d, code, n_chars from k join t on t.c = k.c - k.c % 100 and pos <= h
        union all select k.c, pos - h + k, code, n_chars from k join t on t.c = k.c and pos > h
    ),
    p as (select c, d, n_chars, string_agg(code, '' order by d) over (partition by c order by d) as path from own union all select c, 0, 0, '' from k),
    e as (select c, max(d) as d from p group by c),
    n as (select path, d, min(c) as conv_id, count(*) as n_convs, any_value(n_chars) as n_chars from p group by path, d),
    f as (select left(path, cast(32 * d - 32 as bigint)) as path, count(*) as n_children from n where d > 0 group by all),
    s as (select n.*, coalesce(n_children, 0) as n_children from n left join f using (path)),
    r as (select left(path, cast(32 * i as bigint)) as path, sum((n_convs - 1) * n_chars) as saved_tokens, count(*) filter (n_children = 0) as n_leaves from (select *, unnest(range(0, d + 1)) as i from s) group by all),
    z as (select path, string_agg(cast(c as varchar), ',' order by c) as ids from e join p using (c, d) group by path)
    select s.conv_id, cast(s.d as bigint) as depth, u.conv_id as parent_conv_id, cast(s.n_convs as bigint) as n_convs, cast(s.n_children as bigint) as n_children,
        cast(r.n_leaves as bigint) as n_leaves, cast(r.saved_tokens as bigint) as saved_tokens, sha256(coalesce(ids, '')) as ends_sha256
    from s left join s u on s.d > 0 and u.d = s.d - 1 and u.path = left(s.path, cast(32 * s.d - 32 as bigint)) join r on r.path = s.path left join z on z.path = s.path
    """,
)
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.conversation_trie(table(spark, sf_dir, "conversations"))
