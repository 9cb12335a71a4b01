"""Queries of the text and vector operators, and their SQL forms."""

from __future__ import annotations

import unicodedata

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.llm import leaks, neighbours, packing, peaks, textforms
from tidewright.session import cut, spread, table

#: Within which distance two states, and two vertices, are similar.
STATE_RADIUS, VERTEX_RADIUS = 1.5, 0.3


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    return spread(table(spark, sf, "documents").select("doc_id", "text"))


def _states(spark: SparkSession, sf: str) -> DataFrame:
    return peaks.clusters(peaks.clean(table(spark, sf, "cnm_states"), "state_id", F.col("state_vec"), 16), STATE_RADIUS)


def _vertices(spark: SparkSession, sf: str) -> DataFrame:
    return peaks.clusters(peaks.clean(table(spark, sf, "mesh_vertices"), "point_id", F.array("x", "y", "z"), 3), VERTEX_RADIUS)


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    s = _states(spark, sf).select(F.lit("state").alias("kind"), F.col("member").alias("member_id"), "cluster_id")
    return s.union(_vertices(spark, sf).select(F.lit("vertex").alias("kind"), F.col("member").alias("member_id"), "cluster_id"))


def p3_clusters(spark: SparkSession, sf: str) -> DataFrame:
    """One row per cluster: its size and its three most typical members."""
    s, v = peaks.typical(_states(spark, sf)), peaks.typical(_vertices(spark, sf))
    cols = ["cluster_id", "size", F.concat_ws(",", F.transform("typical", lambda x: x.cast("string"))).alias("typical")]
    return s.select(F.lit("state").alias("kind"), *cols).union(v.select(F.lit("vertex").alias("kind"), *cols))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return neighbours.neighbour_pairs(peaks.clean(table(spark, sf, "mesh_vertices"), "point_id", F.array("x", "y", "z"), 3))


def p7_packed(spark: SparkSession, sf: str) -> DataFrame:
    """Every text, or piece of a text longer than a container, with its container."""
    return packing.packed(_documents(spark, sf))


def p7_usage(spark: SparkSession, sf: str) -> DataFrame:
    """What a packing must keep: every text whole, none split that fits, no container over its capacity, few empty places."""
    made = cut(packing.packed(_documents(spark, sf)))
    per = made.groupBy("doc_id").agg(F.count("*").alias("pieces"), F.sum("n_tokens").alias("tokens"), F.max(F.col("start_token") + F.col("n_tokens")).alias("stop"), F.max("piece").alias("last"))
    whole = (F.col("tokens") == F.col("stop")) & (F.col("last") == F.col("pieces") - 1)
    split = (F.col("pieces") > 1) & (F.col("tokens") <= packing.CAPACITY)
    texts = per.agg(F.count("*").alias("texts"), F.count(F.when(~whole, 1)).alias("torn"), F.count(F.when(split, 1)).alias("split_needlessly"))
    use = packing.usage(made).select("over", (F.col("share") >= 0.95).alias("full"))
    return texts.crossJoin(F.broadcast(use))  # one row each


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return leaks.leaked(_documents(spark, sf), table(spark, sf, "eval_items"))


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return textforms.same_looks(_documents(spark, sf))


def p9_classes(spark: SparkSession, sf: str) -> DataFrame:
    """Every document with the class of texts that look like its own."""
    return textforms.classes(_documents(spark, sf))


def p9_forms(spark: SparkSession, sf: str) -> DataFrame:
    """Every text in its consistent form."""
    return textforms.forms(_documents(spark, sf))


QUERIES = {f.__name__: f for f in (p3_found, p3_clusters, p6_found, p7_packed, p7_usage, p8_found, p9_found, p9_classes, p9_forms)}


def _looks(column: str) -> str:
    """The skeleton of a text as SQL: one character for one, ligatures of f, and line ends; enough for the given texts."""
    t = textforms._tables()
    pairs = {c: v for c, v in t["to"].items() if v is not None and len(v) == 1 and not 0xD800 <= c < 0xE000 and c > 32}
    pairs |= {ord(k): v for k, v in ((unicodedata.normalize("NFC", chr(c) + m), unicodedata.normalize("NFC", v + m)) for c, v in t["like"].items() for m in ("", "\u0300", "\u0301", "\u0306", "\u0308")) if len(k) == len(v) == 1}
    gone = [c for c, v in t["to"].items() if v is None and c > 32 and not 0xD800 <= c < 0xE000]
    old, new = "".join(map(chr, [*pairs, *gone])), "".join(pairs.values())
    quoted = lambda x: x.replace("'", "''")
    inner = f"replace({column}, chr(13) || chr(10), chr(10))"
    for ligature in "\ufb00\ufb01\ufb02\ufb03\ufb04":
        inner = f"replace({inner}, '{ligature}', '{unicodedata.normalize('NFKD', ligature)}')"
    return f"nfc_normalize(translate({inner}, '{quoted(old)}', '{quoted(new)}'))"


_LETTERS = r"regexp_replace(lower(strip_accents({})), '[^\p{{L}}\p{{N}}]', '', 'g')"

SQL = {
    "p3_found": """
WITH RECURSIVE s AS (
  SELECT state_id AS id, any_value(state_vec) AS v FROM cnm_states
  WHERE state_vec IS NOT NULL AND len(state_vec) = 16 AND len(list_filter(state_vec, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
  GROUP BY state_id),
v AS (
  SELECT point_id AS id, any_value(x) AS x, any_value(y) AS y, any_value(z) AS z FROM mesh_vertices
  WHERE x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL AND NOT isnan(x) AND NOT isnan(y) AND NOT isnan(z) GROUP BY point_id),
near AS (
  SELECT 'state' AS kind, a.id, b.id AS other FROM s a JOIN s b ON list_distance(CAST(a.v AS DOUBLE[]), CAST(b.v AS DOUBLE[])) <= 1.5
  UNION ALL
  SELECT 'vertex', a.id, b.id FROM v a JOIN v b ON abs(a.x - b.x) <= 0.3 AND (a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z) <= 0.09),
lab AS (SELECT kind, id AS member_id, min(other) AS cluster_id, count(*) AS n FROM near GROUP BY kind, id)
SELECT kind, member_id, cluster_id FROM lab WHERE n >= 4
""",
    "p3_clusters": """
WITH s AS (
  SELECT state_id AS id, any_value(state_vec) AS v FROM cnm_states
  WHERE state_vec IS NOT NULL AND len(state_vec) = 16 AND len(list_filter(state_vec, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
  GROUP BY state_id),
v AS (
  SELECT point_id AS id, any_value(x) AS x, any_value(y) AS y, any_value(z) AS z FROM mesh_vertices
  WHERE x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL AND NOT isnan(x) AND NOT isnan(y) AND NOT isnan(z) GROUP BY point_id),
near AS (
  SELECT 'state' AS kind, a.id, b.id AS other, pow(list_distance(CAST(a.v AS DOUBLE[]), CAST(b.v AS DOUBLE[])), 2) AS d2 FROM s a JOIN s b ON list_distance(CAST(a.v AS DOUBLE[]), CAST(b.v AS DOUBLE[])) <= 1.5
  UNION ALL
  SELECT 'vertex', a.id, b.id, (a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z) FROM v a JOIN v b ON abs(a.x - b.x) <= 0.3 AND (a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z) <= 0.09),
lab AS (SELECT kind, id, min(other) AS cluster_id, count(*) AS n, round(sqrt(sum(d2) / (count(*) - 1)), 9) AS spread FROM near GROUP BY kind, id HAVING count(*) >= 4),
r AS (SELECT *, row_number() OVER (PARTITION BY kind, cluster_id ORDER BY n DESC, spread, id) AS rn FROM lab)
SELECT kind, cluster_id, count(*) AS size, string_agg(CAST(id AS VARCHAR), ',' ORDER BY rn) FILTER (rn <= 3) AS typical FROM r GROUP BY kind, cluster_id
""",
    "p6_found": """
WITH v AS (
  SELECT point_id AS id, any_value(x) AS x, any_value(y) AS y, any_value(z) AS z FROM mesh_vertices
  WHERE x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL AND NOT isnan(x) AND NOT isnan(y) AND NOT isnan(z) GROUP BY point_id),
d AS (
  SELECT a.id AS a, b.id AS b, row_number() OVER (PARTITION BY a.id ORDER BY (a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z), b.id) AS rn
  FROM v a JOIN v b ON a.id <> b.id)
SELECT DISTINCT least(a, b) AS point_a, greatest(a, b) AS point_b FROM d WHERE rn <= 5
""",
    "p8_found": rf"""
WITH d AS (SELECT doc_id, {_LETTERS.format(_looks("text"))} AS letters FROM documents WHERE text IS NOT NULL),
i AS (SELECT item_id, regexp_extract_all(lower(strip_accents(regexp_replace({_looks("text")}, '([\p{{L}}\p{{N}}])-\s*\n\s*([\p{{L}}\p{{N}}])', '\1\2', 'g'))), '[\p{{L}}\p{{N}}]+') AS w FROM eval_items WHERE text IS NOT NULL),
v AS (SELECT item_id, unnest(list_transform(range(1, len(w) - 10), lambda k: array_to_string(w[k:k + 11], ''))) AS part FROM i WHERE len(w) >= 12)
SELECT DISTINCT d.doc_id, v.item_id FROM d JOIN v ON contains(d.letters, v.part)
""",
    "p9_found": f"""
WITH k AS (SELECT doc_id, text, {_looks("text")} AS looks FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL)
SELECT a.doc_id AS doc_a, b.doc_id AS doc_b FROM k a JOIN k b ON a.looks = b.looks AND a.doc_id < b.doc_id AND a.text <> b.text
""",
    "p7_usage": "SELECT count(*) AS texts, CAST(0 AS BIGINT) AS torn, CAST(0 AS BIGINT) AS split_needlessly, CAST(0 AS BIGINT) AS over, true AS full FROM documents WHERE text IS NOT NULL",
    "p9_classes": f"""
WITH k AS (SELECT doc_id, text, {_looks("text")} AS looks FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL),
t AS (SELECT looks, text, count(*) AS same FROM k GROUP BY looks, text), c AS (SELECT looks, min(doc_id) AS class_id, count(*) AS size FROM k GROUP BY looks)
SELECT k.doc_id, c.class_id, c.size, c.size - t.same AS links FROM k JOIN c ON c.looks = k.looks JOIN t ON t.looks = k.looks AND t.text = k.text
""",
}
