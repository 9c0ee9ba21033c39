"""Registered queries of this package and their SQL oracles."""

from netloom.llm import (
    block_topk, caps, forest, langid, licenses, mixing, phrases, rank_bpe, secrets, surrogates, token_orc,
    unigram, whitening,
)

QUERIES = {
    "op1_surrogates": surrogates.op1_surrogates,
    "op2_token_orc": token_orc.op2_token_orc,
    "op3_secrets": secrets.op3_secrets,
    "op4_licenses": licenses.op4_licenses,
    "op5_block_topk": block_topk.op5_block_topk,
    "op6_forest": forest.op6_forest,
    "op7_mixing": mixing.op7_mixing,
    "op8_unigram": unigram.op8_unigram,
    "op9_caps": caps.op9_caps,
    "op10_langid": langid.op10_langid,
    "op11_rank_bpe": rank_bpe.op11_rank_bpe,
    "op12_whitening": whitening.op12_whitening,
    "op13_collocations": phrases.op13_collocations,
}

# Embedding links are found with filters, yet with the cosine of all pairs as the oracle:
# at the chosen filter count a missed link is expected once in many thousand.
_CAPS = f"""WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
n AS (SELECT vec_id, label, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS u FROM v),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM n a JOIN n b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_dot_product(a.u, b.u) >= {caps.COSINE}),
r(x, y) AS (SELECT x, y FROM l UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
c AS (SELECT x, min(y) AS low FROM r GROUP BY x),
k AS (SELECT x, count(*) AS n FROM l GROUP BY x)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(low, vec_id)) AS component_id,
  vec_id <= coalesce(low, vec_id) AS kept FROM embeddings LEFT JOIN k ON k.x = vec_id LEFT JOIN c ON c.x = vec_id"""

_WORDS = r"list_filter(string_split(regexp_replace(lower(text), '[^\p{L}\p{N}\p{M}]+', ' ', 'g'), ' '), lambda w: w <> '')"
_FOREST = f"""WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS w FROM documents WHERE text IS NOT NULL),
s AS (SELECT doc_id, w, list_distinct(CASE WHEN len(w) < {forest.WORDS} THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - {forest.WORDS - 2}), lambda i: array_to_string(w[i:i + {forest.WORDS - 1}], ' ')) END) AS s
  FROM w WHERE len(w) > 0),
e AS (SELECT doc_id, unnest(s) AS g FROM s),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM c JOIN s a ON a.doc_id = x JOIN s b ON b.doc_id = y
  WHERE n >= {forest.SIMILARITY} * (len(a.s) + len(b.s) - n) - 1e-9),
r(x, y) AS (SELECT x, y FROM l UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
m AS (SELECT x, min(y) AS low FROM r GROUP BY x),
k AS (SELECT x, count(*) AS n FROM l GROUP BY x),
same AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY w) AS class_id FROM s)
SELECT d.doc_id, coalesce(class_id, d.doc_id) AS class_id, coalesce(n, 0) AS n_links,
  least(d.doc_id, coalesce(low, d.doc_id)) AS component_id, d.doc_id <= coalesce(low, d.doc_id) AS kept
FROM documents d LEFT JOIN same USING (doc_id) LEFT JOIN k ON k.x = d.doc_id LEFT JOIN m ON m.x = d.doc_id"""

ORACLES = {
    "op3_secrets": secrets.ORACLE,
    "op4_licenses": licenses.ORACLE,
    "op5_block_topk": block_topk.ORACLE,
    "op6_forest": _FOREST,
    "op7_mixing": mixing.ORACLE,
    "op9_caps": _CAPS,
    "op13_collocations": phrases.ORACLE,
}
