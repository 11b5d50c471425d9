"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from llm.byte_bpe import op9_byte_bpe
from llm.cross_polytope import op4_cross_polytope
from llm.html_extract import op7_html_extract
from llm.kd_search import op2_exact_topk
from llm.language_id import op1_language_id
from llm.mixing import op3_mixing
from llm.near_dup import op10_near_dup
from llm.secret_scan import op5_secret_scan
from llm.toxicity import op8_toxicity
from llm.warc_index import op6_warc

QUERIES = {f.__name__: f for f in (op1_language_id, op2_exact_topk, op3_mixing, op4_cross_polytope, op5_secret_scan, op6_warc, op7_html_extract, op8_toxicity, op9_byte_bpe, op10_near_dup)}

ORACLE_SQL = {
    "op2_exact_topk": """
WITH usable AS (
  SELECT DISTINCT vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM usable q JOIN usable c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 100 = 0
), placed AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM scored)
SELECT query_id, rank, vec_id, score FROM placed WHERE rank <= 10
""",
    "op6_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), keepers AS (SELECT h, max(page_id) AS keeper FROM p GROUP BY h),
hashed AS (SELECT page_id, keeper, h, sha1(h) AS x FROM p JOIN keepers USING (h))
SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes,
  -- 5 hexadecimal digits are 20 bits, that is 4 letters of base 32
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(x, CAST(5 * (j // 4) + 1 AS BIGINT), 5) AS BIGINT) >> (15 - 5 * (j % 4))) & 31 AS BIGINT) + 1, 1) for j in range(32)], '') AS payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM keeper THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id IS DISTINCT FROM keeper THEN keeper END AS refers_to
FROM hashed
""",
    "op10_near_dup": """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN coalesce(len(w), 0) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] for i in range(1, len(w) - 1)]) END AS s FROM w
), n AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n FROM sets), g AS (SELECT doc_id, unnest(s) AS g FROM sets),
links AS (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM g x JOIN g y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2)
  JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * i >= 85 * (na.n + nb.n - i)
), reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b)
SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept FROM n JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY 1) USING (doc_id)
""",
}
