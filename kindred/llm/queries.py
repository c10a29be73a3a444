"""The registered queries of this package: each applies its operator to a whole table, with its answer in SQL where SQL has one."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.llm import alignment, bpe, exact_dedup, line_dedup, minhash, packing, prefix_trie, quality, secrets, topk, toxicity, url_filter, warc
from kindred.llm.common import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return register


BYTE_VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
WORD_VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")


@query("op3_bpe_automaton")
def op3_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), BYTE_VOCABULARY)


URL_RULES = [
    ("block", "net/"),
    ("allow", "example.net/en/"),
    ("block", "example.com/de/"),
    ("allow", "org/fr/"),
]


# A linked group is walked from every member, so the SQL is meant for small tables.
LINKED_GROUPS = r"""
    words AS (
      SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
      FROM {source}
    ), sets AS (
      SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN []
        ELSE list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s
      FROM words
    ), items AS (
      SELECT doc_id, unnest(s) AS x FROM sets
    ), met AS (
      SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM items a JOIN items b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2
    ), links AS (
      SELECT a, b FROM met JOIN sets l ON l.doc_id = a JOIN sets r ON r.doc_id = b WHERE 100 * n >= 85 * (len(l.s) + len(r.s) - n)
    ), reach AS (
      SELECT doc_id AS a, doc_id AS b FROM sets UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
    ), named AS (
      SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id
      FROM sets JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY 1) USING (doc_id)
    )"""


@query(
    "op1_tensored_minhash",
    f"""
    WITH RECURSIVE {LINKED_GROUPS.format(source="documents")}
    SELECT doc_id, n_shingles, component_id, doc_id = component_id AS kept FROM named
    """,
)
def op1_tensored_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


@query(
    "op2_pivot_top_k",
    """
    WITH ok AS (
      SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
      FROM embeddings
      WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ), scored AS (
      SELECT q.vec_id AS query_id, o.vec_id,
             CAST(list_sum(list_transform(list_zip(q.v, o.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM ok q JOIN ok o ON q.vec_id <> o.vec_id WHERE q.vec_id % 20 = 0
    ), ranked AS (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM scored
    )
    SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM ranked WHERE n <= 20
    """,
)
def op2_pivot_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.quantised(table(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors, F.col("vec_id") % 20 == 0, k=20)


@query(
    "op4_warc_segments",
    """
    WITH p AS (
      SELECT page_id, coalesce(html, '') AS html, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS n FROM pages
    ), k AS (
      SELECT *, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY html) ELSE page_id END AS keeper FROM p
    )
    SELECT page_id, n AS payload_bytes, sha1(html) AS payload_digest,
           CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
           CASE WHEN page_id <> keeper THEN keeper END AS refers_to
    FROM k
    """,
)
def op4_warc_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


@query(
    "op5_block_naming",
    r"""
    WITH d AS (
      SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
    )
    SELECT doc_id, min(doc_id) OVER w AS keep_id, CAST(count(*) OVER w AS BIGINT) AS group_size,
           doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
    FROM d WINDOW w AS (PARTITION BY t)
    """,
)
def op5_block_naming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


@query("op6_neighbour_quality")
def op6_neighbour_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.classify(docs, quality.train(docs, table(spark, sf_dir, "labels")))


@query("op7_secret_network")
def op7_secret_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secrets.scan(docs, secrets.train(docs))


@query("op8_noisy_or_toxicity")
def op8_noisy_or_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score_documents(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))
    spans = F.array_join(F.transform("offending", lambda s: F.concat_ws(":", s["start"], s["end"])), ",")
    return scored.withColumn("n_offending", F.size("offending")).withColumn("offending", spans)


@query("op9_residual_packing")
def op9_residual_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), WORD_VOCABULARY)


@query(
    "op10_url_filters",
    r"""
    WITH cut AS (
      SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
    ), parts AS (
      SELECT page_id,
             translate(regexp_extract(rest, '(?s)^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1) AS path
      FROM cut
    ), rules(rule, verdict, rhost, rpath) AS (
      VALUES ('net/', 'block', 'net', '/'), ('example.net/en/', 'allow', 'example.net', '/en/'),
             ('example.com/de/', 'block', 'example.com', '/de/'), ('org/fr/', 'allow', 'org', '/fr/')
    ), fits AS (
      SELECT page_id, rule, verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(rhost) DESC, length(rpath) DESC) AS n
      FROM parts JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
    )
    SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
    FROM parts p LEFT JOIN fits f ON p.page_id = f.page_id AND f.n = 1
    """,
)
def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.filter_urls(pages, URL_RULES).drop("url")


@query(
    "op11_line_runs",
    r"""
    WITH d AS (
      SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
    ), l AS (
      SELECT r, doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM d
    ), k AS (
      SELECT r, doc_id, line, pos, trim(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                        ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS key
      FROM l
    ), f AS (
      SELECT key, max(doc_id) AS holder FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
    ), m AS (
      SELECT r, k.doc_id, line, pos, f.key IS NOT NULL AND k.doc_id IS DISTINCT FROM holder AS dropped FROM k LEFT JOIN f USING (key)
    )
    SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
    FROM m GROUP BY r
    """,
)
def op11_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


@query(
    "op12_prefix_trie",
    """
    WITH o AS (
      SELECT conv_id AS c, list(struct_pack(role := role, text := text) ORDER BY turn NULLS FIRST, name) AS ts
      FROM (
        SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
               sha256(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, '')) AS name
        FROM conversations WHERE conv_id IS NOT NULL
      ) GROUP BY conv_id
    ), h AS (
      SELECT c, ts, xor(4294967295, list_reduce(
        list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
        lambda crc, b: list_reduce(list_prepend(xor(crc, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
          lambda v, z: CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END))) % 9 AS h
      FROM o
    ), r AS (
      SELECT h.c, list_concat(coalesce(b.ts, [])[1:h.h], h.ts[h.h + 1:]) AS ts FROM h LEFT JOIN o b ON b.c = h.c - h.c % 5
    ), p AS (
      SELECT c, d, ts[1:d] AS pre, d = len(ts) AS ends, CASE WHEN d = 0 THEN 0 ELSE octet_length(encode(ts[d].text)) END AS bytes
      FROM (SELECT c, ts, unnest(range(len(ts) + 1)) AS d FROM r)
    ), n AS (
      SELECT pre, d, min(c) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes,
             sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ends), '')) AS ends_sha256
      FROM p GROUP BY pre, d
    ), m AS (
      SELECT p.c, p.d, n.conv_id FROM p JOIN n USING (pre, d)
    ), k AS (
      SELECT n.conv_id, n.d, n.n_convs, n.bytes, n.ends_sha256, m.conv_id AS parent_conv_id
      FROM n LEFT JOIN m ON m.c = n.conv_id AND m.d = n.d - 1
    ), s AS (
      SELECT a.conv_id, a.d, a.n_convs, a.bytes, count(b.conv_id) AS n_children
      FROM k a LEFT JOIN k b ON b.parent_conv_id = a.conv_id AND b.d = a.d + 1 GROUP BY ALL
    ), u AS (
      SELECT m.conv_id, m.d, count(*) FILTER (s.n_children = 0) AS n_leaves, sum((s.n_convs - 1) * s.bytes) AS saved_tokens
      FROM s JOIN m ON m.c = s.conv_id AND m.d <= s.d GROUP BY ALL
    )
    SELECT k.conv_id, CAST(k.d AS BIGINT) AS depth, k.parent_conv_id, k.n_convs, s.n_children, u.n_leaves,
           CAST(u.saved_tokens AS BIGINT) AS saved_tokens, k.ends_sha256
    FROM k JOIN s USING (conv_id, d) JOIN u USING (conv_id, d)
    """,
)
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return prefix_trie.trie_nodes(prefix_trie.rebuilt(prefix_trie.conversations_of(turns)))


@query("op13_merge_path")
def op13_merge_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"), BYTE_VOCABULARY, PIECE_MODEL)
