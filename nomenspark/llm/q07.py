"""Query op7_lm_scores and its DuckDB form."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read
from .lm_scores import score

#: The longest n-gram.
ORDER = 3


def op7_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By trigrams, with two steps of backoff."""
    scored = score(read(spark, sf_dir, "documents"), ORDER)
    return scored.select("doc_id", "n_words", "n_top", F.round("log_score", 3).alias("log_score"), F.round("mean_log", 5).alias("mean_log"))


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
  FROM documents
), t AS (
  SELECT rid, unnest(words) AS w, unnest(range(len(words))) AS i FROM d
), b AS (
  SELECT rid, i, w, lag(w) OVER (PARTITION BY rid ORDER BY i) AS v, lag(w, 2) OVER (PARTITION BY rid ORDER BY i) AS u FROM t
), n AS (SELECT count(*) AS n FROM t),
own AS (SELECT rid, count(*) AS n FROM t GROUP BY rid),
c1 AS (SELECT w, count(*) AS c FROM t GROUP BY w),
d1 AS (SELECT rid, w, count(*) AS c FROM t GROUP BY rid, w),
c2 AS (SELECT v, w, count(*) AS c FROM b WHERE v IS NOT NULL GROUP BY v, w),
d2 AS (SELECT rid, v, w, count(*) AS c FROM b WHERE v IS NOT NULL GROUP BY rid, v, w),
c3 AS (SELECT u, v, w, count(*) AS c FROM b WHERE u IS NOT NULL GROUP BY u, v, w),
d3 AS (SELECT rid, u, v, w, count(*) AS c FROM b WHERE u IS NOT NULL GROUP BY rid, u, v, w),
x AS (
  SELECT b.rid, b.u, b.v, c3.c - d3.c AS triples, cp.c - dp.c AS pair, c2.c - d2.c AS pairs, cv.c - dv.c AS context, cw.c - dw.c AS single, greatest(n.n - own.n, 1) AS rest
  FROM b CROSS JOIN n JOIN own USING (rid) JOIN c1 cw ON cw.w = b.w JOIN d1 dw ON dw.rid = b.rid AND dw.w = b.w
  LEFT JOIN c1 cv ON cv.w = b.v LEFT JOIN d1 dv ON dv.rid = b.rid AND dv.w = b.v
  LEFT JOIN c2 ON c2.v = b.v AND c2.w = b.w LEFT JOIN d2 ON d2.rid = b.rid AND d2.v = b.v AND d2.w = b.w
  LEFT JOIN c2 cp ON cp.v = b.u AND cp.w = b.v LEFT JOIN d2 dp ON dp.rid = b.rid AND dp.v = b.u AND dp.w = b.v
  LEFT JOIN c3 ON c3.u = b.u AND c3.v = b.v AND c3.w = b.w LEFT JOIN d3 ON d3.rid = b.rid AND d3.u = b.u AND d3.v = b.v AND d3.w = b.w
), y AS (
  SELECT rid, triples, CASE WHEN v IS NULL THEN greatest(single, 1) / rest WHEN pairs > 0 THEN pairs / context ELSE 0.4::DOUBLE * (greatest(single, 1) / rest) END AS two, u, pair
  FROM x
), s AS (
  SELECT rid, count(*) AS n_words, count(*) FILTER (triples > 0) AS n_top,
    sum(ln(CASE WHEN u IS NULL THEN two WHEN triples > 0 THEN triples / pair ELSE 0.4::DOUBLE * two END)) AS log_score
  FROM y GROUP BY rid
)
SELECT doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_top, 0)::BIGINT AS n_top,
  round(coalesce(log_score, 0), 3) AS log_score, round(log_score / n_words, 5) AS mean_log
FROM d LEFT JOIN s USING (rid)
"""
