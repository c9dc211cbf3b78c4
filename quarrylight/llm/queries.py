"""The queries of the corpus operators, with production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import language_id, quality_rules
from .chat import rotate_perspectives
from .mixing import mix_sources
from .ngram_join import ngram_jaccard_join
from .nn_descent import near_duplicate_classes
from .packing import pack_documents
from .substring_dedup import repeated_spans
from .toxicity import fit, score_toxicity
from .warc import capture_index


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: DuckDB: the words of a text as the operators see them.
WORDS = r"list_filter(regexp_split_to_array(lower(text), '[^0-9a-z\x{80}-\x{10FFFF}]+'), lambda x: x <> '')"


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(_table(spark, sf_dir, "documents"), n=3, threshold=0.5)


OP2 = f"""
WITH RECURSIVE w AS (SELECT doc_id, {WORDS} AS ws FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
        ELSE list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i + 2], ' ')) END) AS gram FROM w),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*)::DOUBLE AS c FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY 1, 2),
p AS MATERIALIZED (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE c / (x.n + y.n - c) >= 5e-1),
r(doc, root) AS (SELECT DISTINCT doc_id, doc_id FROM documents WHERE doc_id IS NOT NULL UNION SELECT b, root FROM r JOIN p ON a = doc WHERE root < b),
d AS (SELECT a, count(*) AS n FROM p GROUP BY a)
SELECT doc AS doc_id, min(root) AS class_id, coalesce(any_value(d.n), 0)::BIGINT AS n_links FROM r LEFT JOIN d ON d.a = doc GROUP BY doc
"""


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans(_table(spark, sf_dir, "documents"), least=50)


OP3 = f"""
WITH w AS (SELECT doc_id, {WORDS} AS ws FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
i AS (SELECT doc_id, ws, unnest(range(0, len(ws) - 49)) AS i FROM w WHERE len(ws) >= 50),
g AS (SELECT doc_id, i, md5(array_to_string(ws[i + 1:i + 50], ' ')) AS gram FROM i),
c AS (SELECT gram, min(doc_id * 1000000000 + i) AS least FROM g GROUP BY gram HAVING count(*) > 1),
r AS (SELECT doc_id, i, false AS earlier FROM g JOIN c USING (gram)
      UNION ALL SELECT doc_id, i, true FROM g JOIN c USING (gram) WHERE doc_id * 1000000000 + i > least),
n AS (SELECT *, CASE WHEN i <= lag(i) OVER w + 50 THEN 0 ELSE 1 END AS new FROM r WINDOW w AS (PARTITION BY doc_id, earlier ORDER BY i)),
s AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, earlier ORDER BY i) AS island FROM n)
SELECT doc_id, earlier, min(i)::INT AS start_word, max(i)::INT + 50 AS end_word, (max(i) - min(i))::INT + 50 AS n_words
FROM s GROUP BY doc_id, earlier, island
"""

def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_table(spark, sf_dir, "documents"), capacity=2048)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    scored = score_toxicity(docs, fit(docs, _table(spark, sf_dir, "labels")))
    return scored.select("doc_id", "toxic_score", "toxic_word", "toxic")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_table(spark, sf_dir, "documents"), alpha=0.5, epochs=1.0, seed=7)


OP10 = """
WITH d AS (SELECT *, coalesce(source, '') AS s, coalesce(length(text), 0) AS c FROM documents),
z AS (SELECT s, sum(c)::DOUBLE AS c, CASE WHEN sum(c) > 0 THEN floor(pow(sum(c)::DOUBLE, 5e-1)) ELSE 0 END AS wish FROM d GROUP BY s),
e AS (SELECT s, CASE WHEN c > 0 THEN round(1e6 * wish / (SELECT sum(wish) FROM z) * (SELECT sum(c) FROM z) / c) ELSE 0 END::BIGINT AS e,
      ('0x' || substr(md5('7:' || s), 1, 8))::BIGINT % 1000000 AS u FROM z),
p AS (SELECT d.*, e, u + sum(e) OVER (PARTITION BY s ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS reach FROM d JOIN e USING (s)),
k AS (SELECT *, (reach // 1000000 - (reach - e) // 1000000)::INT AS n FROM p)
SELECT doc_id, text, lang, source, n_chars, unnest(range(1, n + 1))::INT AS copy FROM k WHERE n > 0
"""

def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return language_id.language_spans(docs, language_id.fit(docs))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return capture_index(_table(spark, sf_dir, "pages"))


OP5 = r"""
WITH u AS (SELECT page_id, url, 1704067200 + page_id * 37 AS ts, sha1(coalesce(html, '')) AS digest, strlen(coalesce(html, ''))::BIGINT AS length,
             regexp_replace(regexp_replace(lower(trim(url)), '#.*$', ''), '^[a-z][a-z0-9+.-]*://', '') AS u FROM pages WHERE trim(coalesce(url, '')) <> ''),
k AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_extract(u, '^([^/?]*)', 1), '^.*@', ''), ':[0-9]*$', ''), '^www[0-9]*\.', '') AS host,
        regexp_replace(regexp_extract(u, '^[^/?]*([^?]*)', 1), '/+$', '') AS path,
        array_to_string(list_sort(list_filter(string_split(regexp_extract(u, '\?(.*)$', 1), '&'), lambda x: x <> '' AND NOT starts_with(x, 'utm_'))), '&') AS q FROM u),
c AS (SELECT *, array_to_string(list_reverse(string_split(host, '.')), ',') || ')' || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN q = '' THEN '' ELSE '?' || q END AS urlkey FROM k)
SELECT row_number() OVER (ORDER BY urlkey, ts, page_id) - 1 AS position, urlkey, ts, page_id, url, digest, length,
       (row_number() OVER h)::INT AS capture, coalesce(lag(digest) OVER h = digest, false) AS revisit
FROM c WINDOW h AS (PARTITION BY urlkey ORDER BY ts, page_id)
"""


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    rules = quality_rules.fit(docs, _table(spark, sf_dir, "labels"))
    return quality_rules.apply_rules(docs, rules).select("doc_id", "rule", "reason", "keep")


def op8_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_classes(_table(spark, sf_dir, "embeddings"), threshold=0.9)


def nn_descent_planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole table and two variants of each vector, so that every vector has neighbours: op8 where few are near."""
    e = _table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<float>").alias("embedding"))
    for step in (3, 5):
        changed = F.transform("embedding", lambda x, i: (x * (1 + F.pmod(F.col("vec_id") * 31 + i * step, F.lit(7)) / 16)).cast("float"))
        e = e.unionByName(_table(spark, sf_dir, "embeddings").select((F.col("vec_id") + step * 1_000_000_000).alias("vec_id"), changed.alias("embedding")))
    return near_duplicate_classes(e, threshold=0.9)


_OP8 = """,
c AS (SELECT a.vec_id AS a, b.vec_id AS b, list_dot_product(a.v, b.v) / (a.size * b.size) AS c FROM e a JOIN e b ON a.vec_id <> b.vec_id),
p AS MATERIALIZED (SELECT a, b FROM c WHERE c >= 9e-1),
r(vec, root) AS (SELECT vec_id, vec_id FROM e UNION SELECT b, root FROM r JOIN p ON a = vec WHERE root < b),
d AS (SELECT a, count(*) AS n FROM p GROUP BY a)
SELECT vec AS vec_id, min(root) AS class_id, coalesce(any_value(d.n), 0)::BIGINT AS n_links FROM r LEFT JOIN d ON d.a = vec GROUP BY vec
"""
OP8 = """
WITH RECURSIVE e AS (SELECT vec_id, v, sqrt(list_dot_product(v, v)) AS size FROM (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings))""" + _OP8
PLANTED = """
WITH RECURSIVE o AS (SELECT vec_id, embedding FROM embeddings
  UNION ALL SELECT vec_id + 3000000000, list_transform(embedding, lambda x, i: (x * (1 + ((vec_id * 31 + (i - 1) * 3) % 7) / 16e0))::FLOAT) FROM embeddings
  UNION ALL SELECT vec_id + 5000000000, list_transform(embedding, lambda x, i: (x * (1 + ((vec_id * 31 + (i - 1) * 5) % 7) / 16e0))::FLOAT) FROM embeddings),
e AS (SELECT vec_id, v, sqrt(list_dot_product(v, v)) AS size FROM (SELECT vec_id, embedding::DOUBLE[] AS v FROM o))""" + _OP8


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotate_perspectives(_table(spark, sf_dir, "conversations"))


OP9 = r"""
WITH t AS (SELECT conv_id, turn, coalesce(nullif(role, ''), 'unknown') AS role, replace(coalesce(text, ''), '<|', '< |') AS said FROM conversations WHERE conv_id IS NOT NULL),
s AS (SELECT DISTINCT conv_id, role AS speaker FROM t WHERE role <> 'system'),
p AS (SELECT conv_id, speaker, turn, role, said, CASE WHEN role = 'system' THEN '<|system|>' WHEN role = speaker THEN '<|assistant|>'
        ELSE '<|user name=' || regexp_replace(role, '[^0-9A-Za-z_-]', '_', 'g') || '|>' END || chr(10) AS head FROM s JOIN t USING (conv_id)),
o AS (SELECT *, head || said || '<|end|>' || chr(10) AS part, sum(length(head || said) + 8) OVER (PARTITION BY conv_id, speaker ORDER BY turn, role, said ROWS UNBOUNDED PRECEDING) AS stop FROM p)
SELECT conv_id, speaker, string_agg(part, '' ORDER BY turn, role, said) AS text,
       list([(stop - length(said) - 8)::INT, stop::INT] ORDER BY turn, role, said) FILTER (role = speaker) AS mask,
       count(*)::INT AS n_turns, (count(*) FILTER (role = speaker))::INT AS n_learned
FROM o GROUP BY conv_id, speaker
"""

QUERIES = {
    "op1_packing": op1_packing,
    "op2_ngram_jaccard_join": op2_ngram_jaccard_join,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_language_id": op4_language_id,
    "op5_warc": op5_warc,
    "op6_quality_rules": op6_quality_rules,
    "op7_toxicity": op7_toxicity,
    "op8_nn_descent": op8_nn_descent,
    "nn_descent_planted": nn_descent_planted,
    "op9_chat": op9_chat,
    "op10_mixing": op10_mixing,
}
ORACLE_SQL = {
    "op2_ngram_jaccard_join": OP2,
    "op3_substring_dedup": OP3,
    "op5_warc": OP5,
    "op8_nn_descent": OP8,
    "nn_descent_planted": PLANTED,
    "op9_chat": OP9,
    "op10_mixing": OP10,
}
