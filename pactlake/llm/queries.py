"""The registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pactlake.llm import audio, byte_bpe, embedding_dedup, hard_negatives, jaccard_join, language_id, line_dedup, mixing, quality_crf, substring_dedup, token_alignment, token_counts, url_filters
from pactlake.llm.common import table


def _held_out(modulus: int, remainder: int):
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == remainder


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language_id.identify(docs, docs.filter(~_held_out(5, 0)))
    return found.select("doc_id", _held_out(5, 0).alias("held_out"), "lang_pred", "score")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_removed").alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return byte_bpe.encode_decode(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN, with_ids=False)


def op4_audio_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio.audio_columns(table(spark, sf_dir, "documents"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents"))


#: Distinct sets, pairs that share a shingle, and labels spread to the smallest document.
OP5_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
      ELSE list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))) END AS x FROM w),
e AS (SELECT doc_id, len(x) AS n, unnest(x) AS h FROM s),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n + b.n AS t, count(*) AS c FROM e a JOIN e b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n),
l AS (SELECT a, b FROM i WHERE 100 * c >= 75 * (t - c)),
r(node, low) AS (SELECT doc_id, doc_id FROM s UNION SELECT l.b, r.low FROM r JOIN l ON l.a = r.node WHERE r.low < l.b)
SELECT s.doc_id, CAST(len(x) AS BIGINT) AS n_shingles, CAST(m.low AS BIGINT) AS component_id
FROM s JOIN (SELECT node, min(low) AS low FROM r GROUP BY node) m ON m.node = s.doc_id
"""


def op6_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality_crf.fit(docs, table(spark, sf_dir, "labels").filter(~_held_out(3, 1)))
    found = quality_crf.score_documents(docs, model)
    return found.select("doc_id", _held_out(3, 1).alias("held_out"), "score", "predicted")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mix of three quarters of the corpus' tokens: how often each document stands in it, and where."""
    found = mixing.copies(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), budget_share=0.75)
    return found.select("doc_id", "source", F.col("_n_tokens").alias("n_tokens"), F.col("_copies").alias("copies"), F.col("_weight").alias("weight"), F.col("_places").alias("places"))


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


#: All pairs of a label by cosine, and labels spread to the smallest vector.
OP8_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
      WHERE list_dot_product(a.x, b.x) / (sqrt(list_dot_product(a.x, a.x)) * sqrt(list_dot_product(b.x, b.x))) >= 0.98),
r(node, low) AS (SELECT vec_id, vec_id FROM v UNION SELECT l.b, r.low FROM r JOIN l ON l.a = r.node WHERE r.low < l.b),
m AS (SELECT node, min(low) AS low FROM r GROUP BY node),
n AS (SELECT a, count(*) AS c FROM l GROUP BY a)
SELECT vec_id, CAST(coalesce(c, 0) AS BIGINT) AS n_links, CAST(low AS BIGINT) AS component_id, vec_id = low AS kept
FROM v JOIN m ON m.node = vec_id LEFT JOIN n ON n.a = vec_id
"""


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    return token_counts.token_counts(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup_substrings(table(spark, sf_dir, "documents"))


#: Windows by their words; the smallest document of each; the words that removed windows cover.
OP10_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
p AS (SELECT doc_id, len(words) AS n, unnest(range(1, greatest(len(words) - 12, 0) + 1)) AS i, words FROM w),
k AS (SELECT doc_id, i, md5(array_to_string(words[i:i + 12], ' ')) AS h FROM p),
m AS (SELECT h, min(doc_id) AS low FROM k GROUP BY h),
g AS (SELECT DISTINCT doc_id, i FROM k JOIN m USING (h) WHERE low < doc_id),
c AS (SELECT DISTINCT doc_id, i + j AS i FROM g, range(0, 13) t(j)),
r AS (SELECT doc_id, list(i) AS gone FROM c GROUP BY doc_id)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
       sha256(coalesce(array_to_string(list_filter(words, lambda x, i: NOT coalesce(list_contains(gone, i), false)), ' '), '')) AS kept_sha256
FROM w LEFT JOIN r USING (doc_id)
"""


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return token_alignment.align_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.PATTERN)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), noise=7)


#: All products of anchors and rows.
OP12_SQL = """
WITH v AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(CAST(embedding AS DOUBLE[]), lambda x: floor(256 * x)) AS x
           FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(CAST(embedding AS DOUBLE[]), lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.id AS a, b.id AS b, a.label = b.label AS same, CAST(list_dot_product(a.x, b.x) AS BIGINT) AS s FROM v a JOIN v b ON a.id <> b.id WHERE a.id % 50 = 0),
p AS (SELECT a, b, s FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 5),
n AS (SELECT p.a, p.b AS p, p.s AS ps, s.b AS n, s.s AS ns, row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.s DESC, s.b) AS r
      FROM p JOIN s ON s.a = p.a AND NOT s.same AND 50 * p.s <= 100 * s.s AND 100 * s.s <= 95 * p.s)
SELECT a AS anchor_id, p AS positive_id, CAST(r AS INTEGER) AS rank, n AS negative_id, ps AS positive_score, ns AS negative_score FROM n WHERE r <= 3
"""


#: Rules of the pages table: hosts and paths first, then patterns of URLs that name another page again, a list of pages or a form.
OP13_HOSTS = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
OP13_PATTERNS = [
    ("block", r"[?&]utm_source="),
    ("block", r"[?&]page=[0-9]"),
    ("block", r"[?&]sessionid="),
    ("block", r"/(tag|category)/"),
    ("block", r"/wp-login[.]php"),
    ("block", r"[.](jpg|png|gif|zip)([?#]|$)"),
    ("block", r"^[a-z]+://ads?[.]"),
]


def op13_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [url_filters.host_rule(*r) for r in OP13_HOSTS] + [url_filters.pattern_rule(*r) for r in OP13_PATTERNS]
    return url_filters.filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules).drop("url")


#: Every rule against every URL.
OP13_SQL = rf"""
WITH u AS (SELECT page_id, url, regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', ['host', 'path']) AS x FROM pages),
p AS (SELECT page_id, url, translate(x.host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, x.path AS path, row_number() OVER () AS i FROM u),
r(verdict, host, path) AS (VALUES {", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in OP13_HOSTS)}),
k(verdict, pattern) AS (VALUES {", ".join(f"('{v}', '{p}')" for v, p in OP13_PATTERNS)}),
w AS (SELECT i, arg_max({{'name': r.host || r.path, 'verdict': r.verdict}}, length(r.host || r.path)) AS x FROM p
      JOIN r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path) GROUP BY i),
m AS (SELECT i, first({{'name': k.pattern, 'verdict': k.verdict}} ORDER BY length(k.pattern) DESC, k.pattern) AS x FROM p
      JOIN k ON regexp_matches(p.url, k.pattern) GROUP BY i)
SELECT page_id, host, path, w.x.name AS rule, CASE WHEN w.x IS NULL THEN m.x.name END AS pattern, coalesce(w.x.verdict, m.x.verdict, 'allow') AS verdict
FROM p LEFT JOIN w USING (i) LEFT JOIN m USING (i)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_language_id, op2_line_dedup, op3_byte_bpe, op4_audio_columns, op5_jaccard_join, op6_quality_crf, op7_mixing, op8_embedding_dedup, op9_token_counts, op10_substring_dedup, op11_token_alignment, op12_hard_negatives, op13_url_filters)}


def oracle_sql() -> dict[str, str]:
    return {"op5_jaccard_join": OP5_SQL, "op8_embedding_dedup": OP8_SQL, "op10_substring_dedup": OP10_SQL, "op12_hard_negatives": OP12_SQL, "op13_url_filters": OP13_SQL}
