"""The queries of this subpackage: name -> (spark, sf_dir) -> DataFrame, and SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bpe import bpe_digest
from .chat import chat_digest
from .clusters import cluster
from .common import table
from .fingerprint import neighbour_digest
from .languages import language_predictions
from .neardup import near_duplicates
from .negatives import embedding_negatives
from .packing import pack_digest
from .quality import quality_scores
from .secrets import secret_digest
from .substrings import substring_digest
from .tokencount import token_counts
from .topk import embedding_topk


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_digest(table(spark, sf_dir, "documents"))


def op2_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbour_digest(table(spark, sf_dir, "documents"))


def op3_bpe_distinct_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digest(table(spark, sf_dir, "documents"))


def op4_minmax_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


OP4_SQL = """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \\t-\\r]+') AS words FROM documents),
p AS (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 4, 1) + 1)) AS pos FROM w WHERE len(words) > 0),
s AS (SELECT DISTINCT doc_id, array_to_string(words[pos:pos + 4], ' ') AS shingle FROM p),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM i JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * shared >= 75 * (nx.n + ny.n - shared)),
b AS (SELECT x, y FROM e UNION SELECT y, x FROM e),
r AS (SELECT doc_id AS node, doc_id AS reach FROM documents UNION SELECT r.node, b.y FROM r JOIN b ON b.x = r.reach),
c AS (SELECT node, min(reach) AS component_id FROM r GROUP BY node)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN c ON c.node = d.doc_id
"""


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_digest(table(spark, sf_dir, "documents"))


OP6_SQL = """
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^ \\t-\\r]+') AS words FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(words) - 11)) AS pos, words FROM w WHERE len(words) >= 13),
h AS (SELECT doc_id, pos, array_to_string(words[pos:pos + 12], ' ') AS win FROM p),
m AS (SELECT win, min(doc_id) AS least FROM h GROUP BY win HAVING min(doc_id) < max(doc_id)),
c AS (SELECT DISTINCT doc_id, unnest(range(pos, pos + 13)) AS pos FROM h JOIN m USING (win) WHERE doc_id > least),
g AS (SELECT doc_id, list(pos) AS gone FROM c GROUP BY doc_id)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
  sha256(coalesce(CASE WHEN gone IS NULL THEN array_to_string(words, ' ')
    ELSE array_to_string([words[i] FOR i IN range(1, len(words) + 1) IF NOT list_contains(gone, i)], ' ') END, '')) AS kept_sha256
FROM w LEFT JOIN g USING (doc_id)
"""


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_topk(table(spark, sf_dir, "embeddings"))


OP8_SQL = """
WITH e AS (SELECT row_number() OVER () AS n, vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT q.n AS query, q.vec_id AS query_id, x.n, x.vec_id AS vec_id, CAST(list_sum([p[1] * p[2] FOR p IN list_zip(q.v, x.v)]) AS BIGINT) AS score
  FROM e q, e x WHERE q.vec_id % 100 = 0 AND q.n <> x.n AND len(q.v) = len(x.v)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id, n) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], turns.schema)
    return chat_digest(turns.unionByName(extra))


OP9_SQL = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
f AS (SELECT *, length(regexp_replace(regexp_replace(role, '<(\\*)(/?s>)', '<\\\1\2', 'g'), '\[(\\*)(/?(ROLE|INST)\])', '[\\\1\2', 'g'))
  + length(regexp_replace(regexp_replace(text, '<(\\*)(/?s>)', '<\\\1\2', 'g'), '\[(\\*)(/?(ROLE|INST)\])', '[\\\1\2', 'g'))
  + length('<s>[ROLE][/ROLE]</s>') + CASE WHEN role = 'assistant' THEN 0 ELSE length('[INST][/INST]') END AS n FROM t)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(n) AS BIGINT) AS formatted_chars
FROM f GROUP BY conv_id
"""


def op10_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_digest(table(spark, sf_dir, "documents"))


def op11_block_norm_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(table(spark, sf_dir, "embeddings"))


def _op11_sql(rounds: int = 5) -> str:
    """Each round is two steps: the nearest centroid of every vector, and the floors of the means."""
    steps = [
        """WITH e AS (SELECT row_number() OVER () AS n, vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
  WHERE len(embedding) = 64 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
c0 AS (SELECT CAST(row_number() OVER (ORDER BY sha256('2:' || vec_id), v) - 1 AS INTEGER) AS c, v FROM e WHERE vec_id IS NOT NULL QUALIFY c < 40)"""
    ]
    for r in range(rounds + 1):
        steps.append(f"""d{r} AS (SELECT n, c, CAST(list_sum([(p[1] - p[2]) * (p[1] - p[2]) FOR p IN list_zip(e.v, c{r}.v)]) AS BIGINT) AS d FROM e, c{r}),
a{r} AS (SELECT n, c, d FROM d{r} QUALIFY row_number() OVER (PARTITION BY n ORDER BY d, c) = 1)""")
        if r < rounds:
            steps.append(f"""u{r} AS (SELECT c, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS k FROM (SELECT a{r}.c, unnest(e.v) AS x, generate_subscripts(e.v, 1) AS i FROM a{r} JOIN e USING (n)) GROUP BY c, i),
m{r} AS (SELECT c, list((s - ((s % k) + k) % k) // k ORDER BY i) AS v FROM u{r} GROUP BY c),
c{r + 1} AS (SELECT c{r}.c, coalesce(m{r}.v, c{r}.v) AS v FROM c{r} LEFT JOIN m{r} USING (c))""")
    return ",\n".join(steps) + f"""
SELECT e.vec_id, a{rounds}.c AS cluster, a{rounds}.d AS distance, CAST(sum(a{rounds}.d) OVER (PARTITION BY a{rounds}.c) AS BIGINT) AS cluster_inertia,
  CAST(sum(a{rounds}.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c{rounds}.v, ',')) AS centroid_sha256
FROM a{rounds} JOIN e USING (n) JOIN c{rounds} ON c{rounds}.c = a{rounds}.c"""


OP11_SQL = _op11_sql()


def op12_kneser_ney_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_predictions(table(spark, sf_dir, "documents"))


def op13_ball_tree_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_negatives(table(spark, sf_dir, "embeddings"))


OP13_SQL = """
WITH e AS (SELECT row_number() OVER () AS n, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT q.n AS anchor, q.vec_id AS anchor_id, x.n AS other, x.vec_id AS other_id, q.label = x.label AS alike,
    CAST(list_sum([p[1] * p[2] FOR p IN list_zip(q.v, x.v)]) AS BIGINT) AS score
  FROM e q, e x WHERE q.vec_id % 100 = 0 AND q.n <> x.n AND len(q.v) = len(x.v)),
p AS (SELECT anchor, other_id AS positive_id, other AS positive, score AS positive_score FROM s WHERE alike
  QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, other_id, other) <= 5)
SELECT s.anchor_id, p.positive_id, CAST(row_number() OVER (PARTITION BY s.anchor, p.positive ORDER BY s.score DESC, s.other_id, s.other) AS INTEGER) AS rank,
  s.other_id AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor = p.anchor AND NOT s.alike AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score
QUALIFY rank <= 10
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_scan": op1_secret_scan,
    "op2_order_minhash": op2_order_minhash,
    "op3_bpe_distinct_words": op3_bpe_distinct_words,
    "op4_minmax_neardup": op4_minmax_neardup,
    "op5_token_counts": op5_token_counts,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_exact_topk": op8_exact_topk,
    "op9_chat_format": op9_chat_format,
    "op10_best_two_fit": op10_best_two_fit,
    "op11_block_norm_clusters": op11_block_norm_clusters,
    "op12_kneser_ney_language": op12_kneser_ney_language,
    "op13_ball_tree_negatives": op13_ball_tree_negatives,
}

ORACLE_SQL: dict[str, str] = {
    "op4_minmax_neardup": OP4_SQL,
    "op6_substring_dedup": OP6_SQL,
    "op8_exact_topk": OP8_SQL,
    "op9_chat_format": OP9_SQL,
    "op11_block_norm_clusters": OP11_SQL,
    "op13_ball_tree_negatives": OP13_SQL,
}
