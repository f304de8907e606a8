"""The registered queries of the corpus operators: each applies one operator to its whole
table and derives the columns of its contract."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocations, graph, html_text, kdtree, merkle, mixing, packing, parity, pii, shards, toxicity, warc, wavelet
from .common import table


def op1_weak_supervision_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(table(spark, sf_dir, "documents"))


def op2_parity_sketch_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parity.join(table(spark, sf_dir, "documents"))


def op3_wavelet_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet.read_documents(wavelet.write_shards(table(spark, sf_dir, "documents"), end_id=2))


def op4_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op5_kd_tree_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kdtree.top_k(table(spark, sf_dir, "embeddings"), every=50, k=5)


def op6_pruned_graph_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.nearest(table(spark, sf_dir, "embeddings"), every=20, k=20)


def op7_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), end_id=0)


def op8_block_rules_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op9_pattern_grammar_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op10_label_propagation_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.assign(table(spark, sf_dir, "documents"))


def op11_toivonen_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12_warc_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read_pages(spark, warc.write_pages(table(spark, sf_dir, "pages")))


def op13_merkle_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


_ALL = (
    op1_weak_supervision_pii, op2_parity_sketch_join, op3_wavelet_ids, op4_pareto_mix, op5_kd_tree_top_k,
    op6_pruned_graph_search, op7_harmonic_packing, op8_block_rules_text, op9_pattern_grammar_toxicity,
    op10_label_propagation_shards, op11_toivonen_collocations, op12_warc_source, op13_merkle_rollup, pipeline,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _ALL}


#: DuckDB SQL where it can express an operator and finishes on a whole table.
_ORACLES = {
    "op2_parity_sketch_join": r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ 	-
]+'), lambda w: w <> '') AS w
  FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], chr(10)) AS s
  FROM words, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS t(i) WHERE len(w) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c
  FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM common JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b
  WHERE 100 * c >= 75 * (p.n + q.n - c)),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, min(r.b) AS component_id
FROM documents d LEFT JOIN sizes s USING (doc_id) JOIN reach r ON r.a = d.doc_id GROUP BY d.doc_id, s.n""",
    "op5_kd_tree_top_k": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id, list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= 5""",
    "op11_toivonen_collocations": r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
words AS (
  SELECT lang, piece_id, unnest(w) AS x, generate_subscripts(w, 1) AS i
  FROM (SELECT lang, row_number() OVER () AS piece_id, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda x: x <> '') AS w FROM pieces)),
runs AS (SELECT lang, x, lead(x, 1) OVER o AS y, lead(x, 2) OVER o AS z FROM words WINDOW o AS (PARTITION BY piece_id ORDER BY i)),
f AS (
  SELECT lang, k, phrase, count(*) AS a FROM (
    SELECT lang, 1 AS k, x AS phrase FROM runs UNION ALL
    SELECT lang, 2, x || ' ' || y FROM runs WHERE y IS NOT NULL UNION ALL
    SELECT lang, 3, x || ' ' || y || ' ' || z FROM runs WHERE z IS NOT NULL) GROUP BY ALL),
totals AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
cand AS (SELECT lang, k, phrase, a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND a >= 10),
parts AS (
  SELECT lang, phrase, a, 1 AS h, w[1] AS p, array_to_string(w[2 : k], ' ') AS q FROM cand UNION ALL
  SELECT lang, phrase, a, 2, array_to_string(w[1 : 2], ' '), w[3] FROM cand WHERE k = 3),
cuts AS (
  SELECT c.lang, c.phrase, c.a, h, x.a AS l, y.a AS r, (1000000::HUGEINT * c.a * c.a) // (x.a::HUGEINT * y.a) AS score
  FROM parts c JOIN f x ON x.lang = c.lang AND x.phrase = p JOIN f y ON y.lang = c.lang AND y.phrase = q),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, h) = 1),
held AS (
  SELECT lang, inner_phrase, max(a) AS b FROM (
    SELECT lang, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS inner_phrase, a FROM cand WHERE k = 3) GROUP BY ALL),
kept AS (
  SELECT best.* FROM best LEFT JOIN held ON held.lang = best.lang AND held.inner_phrase = best.phrase WHERE NOT coalesce(100 * b >= 50 * a, false)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000""",
    "op12_warc_source": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS size FROM pages),
t AS (SELECT *, CASE WHEN size >= 1000 THEN max(page_id) OVER (PARTITION BY html) ELSE page_id END AS top FROM p)
SELECT page_id, size::BIGINT AS payload_bytes, sha1(html) AS payload_digest,
  CASE WHEN top = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN top <> page_id THEN top END AS refers_to
FROM t""",
    "op13_merkle_rollup": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, replace(text, chr(10), '') AS bare, text,
    concat_ws('', strlen(doc_id::VARCHAR) || ':' || doc_id, coalesce(strlen(source) || ':' || source, '-'), coalesce(strlen(lang) || ':' || lang, '-'),
      coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-')) AS head,
    list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ord(c)::BIGINT), lambda crc, byte:
      list_reduce([xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, (x & 1) * 3988292384)), 4294967295) AS crc
  FROM documents),
leaves AS (
  SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    CASE WHEN xor(crc, 4294967295) % 2 = 0 THEN sha256(head || coalesce(strlen(bare) || ':' || bare, '-')) ELSE sha256(head || coalesce(strlen(text) || ':' || text, '-')) END AS now,
    row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i FROM d),
ranks AS (SELECT source, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS s FROM (SELECT DISTINCT source FROM leaves)),
nodes(s, level, i, h) AS (
  SELECT s, 0, i, leaf FROM leaves JOIN ranks ON ranks.source IS NOT DISTINCT FROM leaves.source
  UNION ALL
  SELECT s, level + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)) FROM (SELECT *, count(*) OVER (PARTITION BY s) AS c FROM nodes) WHERE c > 1 GROUP BY s, level, i // 3),
subroots AS (SELECT s, arg_max(h, level) AS subroot, max(level) AS depth FROM nodes GROUP BY s),
tops(level, i, h) AS (
  SELECT 0, s, subroot FROM subroots
  UNION ALL
  SELECT level + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)) FROM (SELECT *, count(*) OVER () AS c FROM tops) WHERE c > 1 GROUP BY level, i // 3),
root AS (SELECT arg_max(h, level) AS root, max(level) AS depth FROM tops),
tree AS (
  SELECT s, level, i, h FROM nodes JOIN subroots USING (s) WHERE level < depth UNION ALL
  SELECT s, depth + level, i, h FROM tops, subroots),
beside AS (
  SELECT s, level, parent, child, coalesce(string_agg(h, '' ORDER BY i) FILTER (i < child), '') AS l, coalesce(string_agg(h, '' ORDER BY i) FILTER (i > child), '') AS r
  FROM (SELECT t.s, t.level, t.i // 3 AS parent, u.i AS child, t.i, t.h FROM tree t JOIN tree u ON t.s = u.s AND t.level = u.level AND t.i // 3 = u.i // 3)
  GROUP BY s, level, parent, child),
climb(doc_id, s, level, i, steps, h) AS (
  SELECT doc_id, s, 0, CASE WHEN depth = 0 THEN s ELSE i END, '', now FROM leaves JOIN ranks ON ranks.source IS NOT DISTINCT FROM leaves.source JOIN subroots USING (s)
  UNION ALL
  SELECT c.doc_id, c.s, c.level + 1, CASE WHEN c.level + 1 = p.depth THEN c.s ELSE c.i // 3 END, steps || l || r, sha256(l || c.h || r)
  FROM climb c JOIN subroots p ON p.s = c.s, root
  JOIN beside b ON b.s = c.s AND b.level = c.level AND b.child = c.i WHERE c.level < p.depth + root.depth)
SELECT e.doc_id, leaf, subroot, root, sha256(steps) AS proof_sha256, c.h AS folded_root, c.h = root AS verified
FROM leaves e JOIN ranks ON ranks.source IS NOT DISTINCT FROM e.source JOIN subroots USING (s), root JOIN climb c ON c.doc_id = e.doc_id AND c.level = (SELECT p.depth FROM subroots p WHERE p.s = c.s) + root.depth""",
}


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)
