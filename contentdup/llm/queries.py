"""The text operators applied to the given tables, and SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from contentdup.llm.chat import format_chats
from contentdup.llm.common import read_table
from contentdup.llm.divergence import audit_sources
from contentdup.llm.licenses import scan_licenses
from contentdup.llm.merkle import merkle_manifest
from contentdup.llm.ngram_join import ngram_components
from contentdup.llm.oracles import divergence_sql, licenses_sql, manifest_sql
from contentdup.llm.packing import BATCH_TOKENS, BUCKETS, pack_documents
from contentdup.llm.pii import find_personal_data
from contentdup.llm.quality import score_quality
from contentdup.llm.rules import apply_rules, train_rule_model
from contentdup.llm.token_files import read_token_files, write_token_files
from contentdup.llm.top_products import top_products
from contentdup.llm.url_trees import Rule, judge_urls
from contentdup.llm.word_bpe import encode_words


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learnt from; they measure accuracy."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def training_labels(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "labels").where(~held_out(F.col("doc_id")))


def op1_skip_chain(spark: SparkSession, folder: str) -> DataFrame:
    return find_personal_data(read_table(spark, folder, "documents"))


def op2_quality_kernel(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents")
    scored = score_quality(docs, training_labels(spark, folder), threshold=0.7)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op3_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_components(read_table(spark, folder, "documents"), n=4, num=85, den=100)


OP3_SQL = """
WITH RECURSIVE texts AS (
    SELECT doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS words
    FROM documents
), shingles AS (
    SELECT DISTINCT doc_id, unnest(CASE
        WHEN len(words) = 0 THEN []
        WHEN len(words) < 4 THEN [array_to_string(words, ' ')]
        ELSE list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i:i + 3], ' ')) END) AS shingle
    FROM texts
), sizes AS (
    SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), shared AS (
    SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k
    FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
    GROUP BY ALL
), links AS (
    SELECT x, y FROM shared JOIN sizes s ON s.doc_id = x JOIN sizes t ON t.doc_id = y
    WHERE 100 * k >= 85 * (s.n + t.n - k)
), reached AS (
    SELECT doc_id, doc_id AS other FROM documents
    UNION SELECT r.doc_id, l.y FROM reached r JOIN links l ON l.x = r.other
)
SELECT doc_id, coalesce(any_value(n), 0)::BIGINT AS n_shingles, min(other) AS component_id
FROM reached LEFT JOIN sizes USING (doc_id)
GROUP BY doc_id
"""


def op4_top_products(spark: SparkSession, folder: str) -> DataFrame:
    return top_products(read_table(spark, folder, "embeddings"), every=50, k=5, scale=256)


OP4_SQL = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS w
    FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.w, c.w) AS BIGINT) AS score
    FROM v q JOIN v c ON c.vec_id <> q.vec_id
    WHERE q.vec_id % 50 = 0
), ranked AS (
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
           vec_id, score
    FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


def op5_length_buckets(spark: SparkSession, folder: str) -> DataFrame:
    return pack_documents(read_table(spark, folder, "documents"))


def _bucket_sql(buckets: int, batch_tokens: int) -> str:
    """The same dynamic program, one level after the other."""
    levels = ["d1 AS (SELECT j, length * cum AS cost, 0::BIGINT AS i FROM p)"]
    for k in range(2, buckets + 1):
        levels.append(f"""
            d{k} AS (
                SELECT j, best[1] AS cost, best[2] AS i FROM (
                    SELECT b.j, min([a.cost + b.length * (b.cum - c.cum), a.j]) AS best
                    FROM p b JOIN d{k - 1} a ON a.j < b.j JOIN p c ON c.j = a.j GROUP BY b.j)
                UNION ALL SELECT 0, 0, 0)""")
    totals = " UNION ALL ".join(f"SELECT {k} AS k, cost FROM d{k} WHERE j = (SELECT max(j) FROM p)" for k in range(1, buckets + 1))
    start = "SELECT max(j) AS j FROM p WHERE (SELECT k FROM used) = {}"
    traces = [f"t{buckets} AS ({start.format(buckets)} HAVING max(j) IS NOT NULL)"]
    for k in range(buckets - 1, 0, -1):
        traces.append(
            f"t{k} AS ({start.format(k)} HAVING max(j) IS NOT NULL UNION ALL SELECT i FROM t{k + 1} JOIN d{k + 1} USING (j))"
        )
    edges = " UNION ".join(f"SELECT j FROM t{k} WHERE j > 0" for k in range(1, buckets + 1))
    return f"""
        WITH sized AS (
            SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS n_tokens FROM documents
        ), lengths AS (
            SELECT n_tokens AS length, count(*) AS n
            FROM sized GROUP BY 1
        ), p AS (
            SELECT 0::BIGINT AS j, 0::BIGINT AS length, 0::BIGINT AS cum
            UNION ALL
            SELECT row_number() OVER (ORDER BY length), length, sum(n) OVER (ORDER BY length)::BIGINT FROM lengths
        ), {", ".join(levels)}, used AS (
            SELECT k FROM ({totals}) ORDER BY cost, k LIMIT 1
        ), {", ".join(traces)}, edges AS (
            SELECT (row_number() OVER (ORDER BY length) - 1)::INTEGER AS bucket, length AS padded_to,
                   coalesce(lag(length) OVER (ORDER BY length), -1) AS above
            FROM p WHERE j IN ({edges})
        ), placed AS (
            SELECT doc_id, n_tokens, bucket, padded_to,
                   row_number() OVER (PARTITION BY bucket ORDER BY doc_id NULLS FIRST, n_tokens) - 1 AS pos,
                   greatest({batch_tokens} // greatest(padded_to, 1), 1) AS size
            FROM sized JOIN edges ON n_tokens > above AND n_tokens <= padded_to
        )
        SELECT doc_id, n_tokens, bucket, padded_to, (pos // size)::BIGINT AS batch, (pos % size)::BIGINT AS place FROM placed
    """


OP5_SQL = _bucket_sql(BUCKETS, BATCH_TOKENS)


def op6_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    return format_chats(read_table(spark, folder, "conversations"))


OP6_SQL = """
WITH t AS (
    SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
           row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
    FROM conversations WHERE conv_id IS NOT NULL
), c AS (
    SELECT conv_id, count(*) AS n, list([role, text] ORDER BY pos) AS turns FROM t GROUP BY conv_id
), kept AS (
    SELECT conv_id, n FROM c
    WHERE NOT EXISTS (
        SELECT 1 FROM c b
        WHERE b.turns[1] = c.turns[1] AND b.conv_id <> c.conv_id AND b.turns[1:c.n] = c.turns
          AND (b.n > c.n OR b.conv_id < c.conv_id)
    )
)
SELECT t.conv_id, CAST((t.pos - 1) // 256 AS BIGINT) AS part, k.n AS n_turns,
       string_agg('<|' || t.role || '|>' || chr(10) || t.text || '<|end|>' || chr(10), '' ORDER BY t.pos) AS rendered
FROM t JOIN kept k USING (conv_id)
GROUP BY t.conv_id, part, k.n
"""

# Hosts and paths to block and to allow.
URL_RULES = [
    Rule("block", "net/"),
    Rule("allow", "example.net/en/"),
    Rule("block", "example.com/de/"),
    Rule("allow", "org/fr/"),
]


def op7_url_trees(spark: SparkSession, folder: str) -> DataFrame:
    return judge_urls(read_table(spark, folder, "pages"), URL_RULES)


def op8_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents")
    return apply_rules(docs, train_rule_model(docs, training_labels(spark, folder)))


def op9_bit_planes(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    docs = read_table(spark, folder, "documents")
    written = write_token_files(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=0)
    return read_token_files(written.df)


def op10_word_bpe(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    docs = read_table(spark, folder, "documents")
    return encode_words(docs, public_tokenizers.path("word_bpe_49k.json"), digests=True)


def op11_license_templates(spark: SparkSession, folder: str) -> DataFrame:
    found = scan_licenses(read_table(spark, folder, "documents"))
    base = F.filter("found", lambda f: f["base"])
    starts = F.transform(base, lambda f: f["first_word"])
    labels = lambda places: F.array_join(F.sort_array(F.array_distinct(F.transform(places, lambda f: f["label"]))), ",")
    return found.select(
        "doc_id",
        "n_words",
        F.size(base).cast("bigint").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        labels(base).alias("base_labels"),
        labels(F.col("found")).alias("labels"),
        F.coalesce(F.array_max(F.transform("found", lambda f: f["score"])), F.lit(0.0)).alias("score"),
    )


def op12_slot_pivot(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents")
    manifest = merkle_manifest(docs, tampered=F.crc32(F.col("doc_id").cast("string")) % 3 == 0)
    return manifest.drop("siblings", "n_levels")


def op13_pair_merge(spark: SparkSession, folder: str) -> DataFrame:
    return audit_sources(read_table(spark, folder, "documents"))


LLM_QUERIES = {
    "op1_skip_chain": op1_skip_chain,
    "op2_quality_kernel": op2_quality_kernel,
    "op8_quality_rules": op8_quality_rules,
    "op3_ngram_join": op3_ngram_join,
    "op4_top_products": op4_top_products,
    "op5_length_buckets": op5_length_buckets,
    "op6_chat_format": op6_chat_format,
    "op7_url_trees": op7_url_trees,
    "op9_bit_planes": op9_bit_planes,
    "op10_word_bpe": op10_word_bpe,
    "op11_license_templates": op11_license_templates,
    "op12_slot_pivot": op12_slot_pivot,
    "op13_pair_merge": op13_pair_merge,
}

LLM_ORACLES = {
    "op3_ngram_join": OP3_SQL,
    "op4_top_products": OP4_SQL,
    "op5_length_buckets": OP5_SQL,
    "op6_chat_format": OP6_SQL,
    "op11_license_templates": licenses_sql(),
    "op12_slot_pivot": manifest_sql(),
    "op13_pair_merge": divergence_sql(),
}
