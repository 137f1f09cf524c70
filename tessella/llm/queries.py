"""The queries of this subpackage, with production parameters, and SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tessella.llm.embedding_dedup import embedding_dedup
from tessella.llm.exact_dedup import exact_dedup
from tessella.llm.ngram_join import ngram_links
from tessella.llm.packing import Capacity, pack_documents
from tessella.llm.pii import pii_scan
from tessella.llm.quality import quality
from tessella.llm.secret_scan import secret_scan
from tessella.llm.sentencepieces import encode_digest
from tessella.llm.span_dedup import span_dedup
from tessella.llm.url_filter import Rule, url_filter

URL_RULES = [
    Rule("block", "com", "/en/"),
    Rule("allow", "example.com", "/en/7"),
    Rule("allow", "net", "/de/"),
    Rule("block", "example.net", "/de/8"),
    Rule("block", "org", "/es/"),
]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup(_table(spark, sf_dir, "embeddings"), threshold=0.98)


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), threshold=0.7)


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_links(_table(spark, sf_dir, "documents"), width=5, percent=80)


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), Capacity(tokens=2048))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digest(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(_table(spark, sf_dir, "pages"), URL_RULES)


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_table(spark, sf_dir, "documents"))


def op8_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(_table(spark, sf_dir, "documents"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_dedup(_table(spark, sf_dir, "documents"), run=4).drop("text")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_scan(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_embedding_near_dedup,
        op2_quality_classifier,
        op3_ngram_jaccard_join,
        op4_best_fit_packing,
        op5_sentencepiece,
        op6_url_filters,
        op7_exact_dedup,
        op8_secret_scans,
        op9_substring_dedup,
        op10_pii,
    )
}

_RULE_ROWS = ", ".join(f"('{r.action}', '{r.host}', '{r.path}')" for r in URL_RULES)

ORACLE: dict[str, str] = {
    "op1_embedding_near_dedup": """
WITH RECURSIVE v AS (
  SELECT CAST(vec_id AS BIGINT) AS id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS (
  SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(e, e) > 0),
l AS (
  SELECT a.id AS x, b.id AS y FROM ok a JOIN ok b ON a.label = b.label AND a.id <> b.id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)) >= 0.98),
r AS (SELECT id, id AS root FROM v UNION SELECT l.y, r.root FROM r JOIN l ON l.x = r.id),
c AS (SELECT id, min(root) AS component_id FROM r GROUP BY id)
SELECT c.id AS vec_id, (SELECT count(*) FROM l WHERE l.x = c.id) AS n_links, c.component_id, c.id = c.component_id AS kept FROM c
""",
    "op3_ngram_jaccard_join": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS sh FROM w),
n AS (SELECT doc_id, len(sh) AS n FROM s),
u AS (SELECT doc_id, unnest(sh) AS g FROM s),
e AS (SELECT doc_id, g FROM u WHERE g IN (SELECT g FROM u GROUP BY g HAVING count(*) > 1)),
p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (
  SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 80 * (nx.n + ny.n - c)),
r AS (SELECT doc_id AS id, doc_id AS root FROM n UNION SELECT l.y, r.root FROM r JOIN l ON l.x = r.id)
SELECT n.doc_id, CAST(n.n AS BIGINT) AS n_shingles, CAST(min(r.root) AS BIGINT) AS component_id
FROM n JOIN r ON r.id = n.doc_id GROUP BY n.doc_id, n.n
""",
    "op6_url_filters": f"""
WITH rules(action, host, path) AS (VALUES {_RULE_ROWS}),
u AS (SELECT row_number() OVER () AS rid, page_id, CASE WHEN url IS NULL OR strpos(url, '://') = 0 THEN '' ELSE substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
h AS (SELECT rid, page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
m AS (SELECT h.rid, h.page_id, h.host, h.path, r.action, r.host || r.path AS rule,
    row_number() OVER (PARTITION BY h.rid ORDER BY length(r.host || r.path) DESC NULLS LAST) AS k
  FROM h LEFT JOIN rules r ON (h.host = r.host OR ends_with(h.host, '.' || r.host)) AND starts_with(h.path, r.path))
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM m WHERE k = 1
""",
    "op7_exact_dedup": """
WITH d AS (SELECT CAST(doc_id AS BIGINT) AS doc_id, coalesce(text, '') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, CAST(g.group_size AS BIGINT) AS group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256
FROM d JOIN g USING (t)
""",
}
