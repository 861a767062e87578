"""The queries of this subpackage and their SQL, by name. Each takes (spark, sf_dir)."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import clusters, lexical, licenses, mixing, near_dup, packing, pii, quality, topk, toxicity, url_filter, vector_dup, warc
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


#: Target entropy (above that of the tables' own shares) and repetition limit of the mixing query; its budget is the least
#: that leaves no document out.
MIX = mixing.Mix(entropy=0.9999, max_passes=4.0)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix_sources(docs, MIX).drop("text")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op4_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "kept")


def op5_vector_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dup.linked_vectors(table(spark, sf_dir, "embeddings"))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_digest(table(spark, sf_dir, "documents"))


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return topk.top_k(rows, rows.where("vec_id % 100 = 0"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.cluster_vectors(table(spark, sf_dir, "embeddings"))


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"))


def queries() -> dict[str, Query]:
    return {"op1_toxicity": op1_toxicity, "op2_mixing": op2_mixing, "op3_packing": op3_packing, "op4_near_dup": op4_near_dup, "op5_vector_dup": op5_vector_dup, "op6_licenses": op6_licenses, "op7_warc": op7_warc, "op8_pii": op8_pii, "op9_topk": op9_topk, "op10_quality": op10_quality, "op11_lexical": op11_lexical, "op12_clusters": op12_clusters, "op13_url_filter": op13_url_filter}


WARC_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)
"""

TOPK_SQL = """
WITH v AS (
  SELECT vec_id, [floor(1024 * x::DOUBLE)::BIGINT for x in embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_sum([q.v[i] * c.v[i] for i in range(1, len(q.v) + 1)])::BIGINT AS score
  FROM (SELECT * FROM v WHERE vec_id % 100 = 0) q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 10
"""

LEXICAL_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS i, doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
t AS (SELECT i, doc_id, unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
c AS (SELECT i, doc_id, term, count(*) AS tf FROM t GROUP BY i, doc_id, term),
l AS (SELECT i, sum(tf)::BIGINT AS n FROM c GROUP BY i),
g AS (SELECT count(*) AS docs, sum(n)::BIGINT AS total FROM l),
m AS (SELECT i, 100 - 25 + ((25 * n * docs) // total) AS m FROM l, g),
w AS (SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM c, g GROUP BY term),
b AS (SELECT item_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM benchmark),
q AS (
  SELECT item_id, term, count(*) AS times
  FROM (SELECT item_id, unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM b)
  GROUP BY item_id, term
), s AS (
  SELECT item_id, i, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
  FROM q JOIN w USING (term) JOIN c USING (term) JOIN m USING (i) GROUP BY item_id, i, doc_id
), r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM r WHERE rank <= 20
"""


def cluster_sql(k: int = 40, rounds: int = 5, seed: int = 2, dim: int = 64) -> str:
    """Rounds one after another: the assignment, then the new centroids."""
    parts = [f"""x AS MATERIALIZED (
  SELECT row_number() OVER () AS row, vec_id, [floor(256 * c::DOUBLE)::BIGINT for c in embedding] AS v FROM embeddings
  WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id), v) - 1 AS cluster, v FROM x
  QUALIFY row_number() OVER (ORDER BY sha256('{seed}:' || vec_id), v) <= {k}
)"""]
    for r in range(rounds + 1):
        parts.append(f"""a{r} AS MATERIALIZED (
  SELECT row, vec_id, x.v, min(struct_pack(d := list_sum([(x.v[i] - c.v[i]) * (x.v[i] - c.v[i]) for i in range(1, {dim + 1})])::BIGINT, cluster := c.cluster)) AS best
  FROM x CROSS JOIN c{r} AS c GROUP BY row, vec_id, x.v
)""")
        if r < rounds:
            parts.append(f"""c{r + 1} AS MATERIALIZED (
  SELECT cluster, coalesce(m.v, c.v) AS v FROM c{r} AS c LEFT JOIN (
    SELECT cluster, list(m ORDER BY i) AS v FROM (
      SELECT best.cluster AS cluster, i, (sum(v[i]) - ((sum(v[i]) % count(*)) + count(*)) % count(*))::BIGINT // count(*) AS m
      FROM a{r}, range(1, {dim + 1}) AS t(i) GROUP BY best.cluster, i
    ) GROUP BY cluster
  ) AS m USING (cluster)
)""")
    return f"""WITH {", ".join(parts)}
SELECT vec_id, best.cluster::INTEGER AS cluster, best.d AS distance, sum(best.d) OVER (PARTITION BY best.cluster)::BIGINT AS cluster_inertia,
       sum(best.d) OVER ()::BIGINT AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} AS c ON c.cluster = best.cluster
"""


def oracle_sql() -> dict[str, str]:
    return {"op7_warc": WARC_SQL, "op9_topk": TOPK_SQL, "op11_lexical": LEXICAL_SQL, "op12_clusters": cluster_sql()}
