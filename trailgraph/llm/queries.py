"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from trailgraph.llm import (
    bottom_k, collocations, decontamination, html_text, lexical_search, line_dedup, near_duplicates, packing, quality, sharding, token_files,
    toxicity, vector_search,
)
from trailgraph.llm.common import text_only, workspace

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op1_decontamination(spark, sf_dir):
    """Words of each document that lie in windows of benchmark items."""
    docs = text_only(table(spark, sf_dir, "documents"), "doc_id", "text")
    found, name = decontamination.find_contamination(docs, table(spark, sf_dir, "benchmark"))
    items = F.col(f"{name}.items")
    return found.select(
        "doc_id",
        F.col(f"{name}.n_words").alias("n_words"),
        F.col(f"{name}.n_hit").alias("n_hit"),
        F.size(items).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"),
        decontamination.contaminated(found, name).alias("contaminated"),
    )


ORACLES["op1_decontamination"] = r"""
WITH folded AS (
  SELECT 'd' AS kind, doc_id AS id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents
  UNION ALL
  SELECT 'b', item_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')
  FROM benchmark WHERE item_id IS NOT NULL
), worded AS MATERIALIZED (
  SELECT kind, id, coalesce(regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM folded
), windows AS MATERIALIZED (
  SELECT DISTINCT id AS item_id, least(len(w), 13) AS n,
    array_to_string(w[i : i + least(len(w), 13) - 1], ' ') AS gram
  FROM worded, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS u(i)
  WHERE kind = 'b' AND len(w) > 0
), grams AS (
  SELECT id AS doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS gram
  FROM worded, (SELECT DISTINCT n FROM windows) AS lengths, unnest(range(1, len(w) - n + 2)) AS u(i)
  WHERE kind = 'd'
), hits AS MATERIALIZED (
  SELECT doc_id, i, n, item_id FROM grams JOIN windows USING (n, gram)
), covered AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT DISTINCT doc_id, i, n FROM hits), unnest(range(i, i + n)) AS u(p) GROUP BY doc_id
), named AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items,
    string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items
  FROM hits GROUP BY doc_id
)
SELECT id AS doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM worded LEFT JOIN covered ON id = covered.doc_id LEFT JOIN named ON id = named.doc_id
WHERE kind = 'd'
"""


@query
def op4_token_files(spark, sf_dir):
    """Where each document's ids are in the token files, as read back."""
    docs = text_only(table(spark, sf_dir, "documents"), "doc_id", "text")
    folder = f"{workspace(spark, 'op4').path}/files"
    manifest = token_files.write_token_files(docs, tokenizer_path("word_bpe_49k.json"), 2, folder)
    return token_files.read_token_files(manifest).select(
        "doc_id",
        "start",
        (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.crc32("ids").alias("ids_crc32"),
    )


@query
def op6_best_fit_packing(spark, sf_dir):
    """Where each piece of each document stands in sequences of 2048 tokens."""
    docs = text_only(table(spark, sf_dir, "documents"), "doc_id", "text")
    return packing.pack_documents(docs, tokenizer_path("byte_bpe_50k.json"), 0)


@query
def op7_simhash_near_duplicates(spark, sf_dir):
    """Fingerprint and group of near-duplicates of each document."""
    docs = text_only(table(spark, sf_dir, "documents"), "doc_id", "text")
    found = near_duplicates.near_duplicates(docs)
    return found.select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


@query
def op9_histogram_sharding(spark, sf_dir):
    """Shard and slot of each document, shards of equal bytes."""
    docs = text_only(table(spark, sf_dir, "documents"), "doc_id", "text")
    found, names = sharding.shard_documents(docs)
    return found.select(
        "doc_id",
        F.col(names["size"]).alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("bytes").alias("law"),
        F.col(names["shard"]).alias("shard"),
        F.col(names["slot"]).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query
def op10_line_dedup(spark, sf_dir):
    """Lines deleted from each document, and the text that is left."""
    docs = text_only(table(spark, sf_dir, "documents"), "doc_id", "text")
    found = line_dedup.dedup_lines(docs, deleted="deleted")
    return found.select(
        "doc_id",
        F.coalesce(F.size("deleted"), F.lit(0)).cast("bigint").alias("n_deleted"),
        F.coalesce(F.array_join("deleted", ","), F.lit("")).alias("deleted_lines"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.coalesce(F.col("deleted").isNotNull() & ~F.col("text").rlike(r"\S"), F.lit(False)).alias("emptied"),
    )


def _judged(found: DataFrame, score, held_out) -> DataFrame:
    return found.select(
        "doc_id",
        held_out("doc_id").alias("held_out"),
        score.alias("score"),
        F.when(score >= 0.5, 1).otherwise(0).alias("predicted"),
    )


@query
def op2_toxicity(spark, sf_dir):
    """Score of each document, learned without the held-out fifth."""
    docs = text_only(table(spark, sf_dir, "documents"), "doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), toxicity.held_out)
    found, name = toxicity.score(docs, model)
    return _judged(found, F.col(f"{name}.score"), toxicity.held_out)


@query
def op3_quality(spark, sf_dir):
    """Score of each document, learned without the held-out third."""
    docs = text_only(table(spark, sf_dir, "documents"), "doc_id", "text")
    found = quality.score_quality(docs, table(spark, sf_dir, "labels"))
    return _judged(found, F.col("score"), quality.held_out)


@query
def op5_exact_top_k(spark, sf_dir):
    """The ten largest inner products of every hundredth vector."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return vector_search.exact_top_k(rows, lambda column: F.col(column) % 100 == 0)


ORACLES["op5_exact_top_k"] = """
WITH usable AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM usable AS q JOIN usable AS c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM scored
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 10
"""


@query
def op8_html_extraction(spark, sf_dir):
    """The visible text of each page."""
    pages = text_only(table(spark, sf_dir, "pages"), "page_id", "html")
    found, name = html_text.extract_text(pages)
    return found.select("page_id", F.col(f"{name}.text").alias("text"))


@query
def op11_collocations(spark, sf_dir):
    """The 2000 best-scoring phrases of each language."""
    return collocations.collocations(table(spark, sf_dir, "documents"))


ORACLES["op11_collocations"] = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), worded AS MATERIALIZED (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), f AS MATERIALIZED (
  SELECT lang, k, phrase, count(*)::HUGEINT AS f FROM (
    SELECT lang, 1 AS k, unnest(w) AS phrase FROM worded
    UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM worded
    UNION ALL SELECT lang, 3, unnest(list_transform(range(1, len(w) - 1),
      lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM worded
  ) GROUP BY ALL
), candidates AS MATERIALIZED (
  SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 10
), cuts AS (
  SELECT lang, phrase, a, 1 AS j, w[1] AS head, array_to_string(w[2:], ' ') AS rest FROM candidates
  UNION ALL SELECT lang, phrase, a, 2, array_to_string(w[1:2], ' '), w[3] FROM candidates WHERE k = 3
), scored AS (
  SELECT c.*, h.f AS l, t.f AS r, (1000000 * c.a * c.a) // (h.f * t.f) AS score
  FROM cuts AS c JOIN f AS h ON h.lang = c.lang AND h.phrase = c.head
  JOIN f AS t ON t.lang = c.lang AND t.phrase = c.rest
  QUALIFY row_number() OVER (PARTITION BY c.lang, c.phrase ORDER BY (1000000 * c.a * c.a) // (h.f * t.f), j) = 1
), longer AS (
  SELECT lang, phrase, max(a) AS a FROM (
    SELECT lang, array_to_string(w[1:2], ' ') AS phrase, a FROM candidates WHERE k = 3
    UNION ALL SELECT lang, array_to_string(w[2:3], ' '), a FROM candidates WHERE k = 3
  ) GROUP BY ALL
), counted AS (SELECT lang, sum(f) AS n FROM f WHERE k = 1 GROUP BY lang)
SELECT s.lang, row_number() OVER (PARTITION BY s.lang ORDER BY s.score DESC, s.a DESC, s.phrase)::BIGINT AS rank, s.phrase,
  s.a::BIGINT AS a, s.l::BIGINT AS l, s.r::BIGINT AS r, n::BIGINT AS n, s.score::BIGINT AS score
FROM scored AS s JOIN counted USING (lang) LEFT JOIN longer AS x ON x.lang = s.lang AND x.phrase = s.phrase
WHERE x.a IS NULL OR 100 * x.a < 50 * s.a
QUALIFY row_number() OVER (PARTITION BY s.lang ORDER BY s.score DESC, s.a DESC, s.phrase) <= 2000
"""


@query
def op13_minhash_near_duplicates(spark, sf_dir):
    """Number of shingles and group of near-duplicates of each document."""
    return bottom_k.near_duplicates(table(spark, sf_dir, "documents"))


ORACLES["op13_minhash_near_duplicates"] = r"""
WITH RECURSIVE worded AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), sets AS MATERIALIZED (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s
  FROM worded
), shingles AS MATERIALIZED (
  SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets
), pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b
  FROM shingles AS a JOIN shingles AS b ON a.shingle = b.shingle AND a.doc_id < b.doc_id
  GROUP BY ALL HAVING 100 * count(*) >= 85 * (any_value(a.n) + any_value(b.n) - count(*))
), edges AS MATERIALIZED (
  SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs
), reached AS (
  SELECT a AS doc_id, a AS other FROM edges UNION SELECT r.doc_id, e.b FROM reached AS r JOIN edges AS e ON e.a = r.other
), least AS (SELECT doc_id, min(other) AS other FROM reached GROUP BY doc_id)
SELECT doc_id, len(s) AS n_shingles, coalesce(other, doc_id) AS component_id, coalesce(other, doc_id) = doc_id AS kept
FROM sets LEFT JOIN least USING (doc_id)
"""


@query
def op12_lexical_search(spark, sf_dir):
    """The 20 best documents of each benchmark item."""
    return lexical_search.ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLES["op12_lexical_search"] = r"""
WITH folded AS (
  SELECT 'd' AS kind, doc_id AS id, text FROM documents
  UNION ALL SELECT 'b', item_id, text FROM benchmark WHERE item_id IS NOT NULL
), terms AS MATERIALIZED (
  SELECT kind, id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM folded
), tf AS MATERIALIZED (
  SELECT id AS doc_id, term, count(*) AS tf FROM terms WHERE kind = 'd' GROUP BY ALL
), sizes AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY doc_id),
totals AS (SELECT count(*) AS docs, sum(n)::BIGINT AS l FROM sizes),
lengths AS (SELECT doc_id, 75 + (25 * n * docs) // l AS m FROM sizes, totals),
weights AS (
  SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, totals GROUP BY term, docs
), asked AS (SELECT id AS item_id, term, count(*) AS times FROM terms WHERE kind = 'b' GROUP BY ALL),
scored AS (
  SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
  FROM asked JOIN weights USING (term) JOIN tf USING (term) JOIN lengths USING (doc_id) GROUP BY ALL
)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
FROM scored WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 20
"""
