"""Queries of the general data-preparation operators over the snapshot tables, and their SQL forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.operators import compact, regular, rejects, spikes
from tidewright.session import once, table


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return rejects.failed_lines(table(spark, sf, "csv_lines"), table(spark, sf, "csv_dialects"))


def p1_loaded(spark: SparkSession, sf: str) -> DataFrame:
    """Every row: the vertices, fields and labels of the valid ones, value by value, and the reason of the others."""
    x = rejects.load_lines(table(spark, sf, "csv_lines"), table(spark, sf, "csv_dialects"))
    number = lambda part: F.transform(part + "s" if part == "field" else "vertices", lambda v, i: F.struct(F.lit(part).alias("part"), i.alias("position"), F.nanvl(v, F.lit(None).cast("double")).alias("value"), F.lit(None).cast("string").alias("text")))
    text = lambda part, c: F.transform(c, lambda v, i: F.struct(F.lit(part).alias("part"), i.alias("position"), F.lit(None).cast("double").alias("value"), v.alias("text")))
    valid = F.concat(number("vertex"), number("field"), text("label", "labels"))
    cells = F.when(F.col("reason").isNull(), valid).otherwise(text("reject", F.array("reason")))
    return x.select("line_id", F.explode(cells).alias("c")).select("line_id", "c.part", F.col("c.position").cast("bigint").alias("position"), "c.value", "c.text")


def csv_weights(spark: SparkSession, sf: str) -> DataFrame:
    """The weight of each valid line: the norm of its area vector, its validity flag, or one, as its dialect has it."""
    areas, flag = ["area_x", "area_y", "area_z"], "isValid"
    d = table(spark, sf, "csv_dialects")
    asked = F.filter("column_names", lambda c: c.isin([*areas, flag]))
    n_fields = d.select("dialect_id", F.size("field_columns").alias("n"), F.size(F.filter("column_names", lambda c: c.isin(areas))).alias("areas"), F.array_contains("column_names", flag).alias("flagged"))
    lines = table(spark, sf, "csv_lines")
    # The columns asked for come behind the dialect's own fields; a line of which one is missing is not valid.
    x = rejects.load_lines(lines, d.withColumn("field_columns", F.concat("field_columns", asked))).where("reason is null")
    kinds = once(lines.select("line_id", "dialect_id"), "line_id").join(F.broadcast(n_fields), "dialect_id")  # a fixed table of a few rows
    w = F.slice("fields", F.col("n") + 1, F.size("fields"))
    norm = F.sqrt(F.aggregate(w, F.lit(0.0), lambda s, v: s + v * v))
    x = x.join(kinds, "line_id").where(F.forall(w, lambda v: ~F.isnan(v)))
    return x.select("line_id", F.round(F.when(F.col("areas") == 3, norm).when(F.col("flagged"), F.element_at("fields", -1)).otherwise(1.0), 6).alias("w"))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return compact.redundant_files(table(spark, sf, "snapshot_files"))


def p2_bundles(spark: SparkSession, sf: str) -> DataFrame:
    """The consolidated files: members, records, bytes of the members' data, and whether all checksums hold."""
    made = compact.bundles(table(spark, sf, "snapshot_files"))
    sound = compact.verify(made)
    small = made.select("case_id", "bundle", F.col("n_files").cast("bigint").alias("n_files"), "n_records", "data_bytes")
    same = small["case_id"].eqNullSafe(sound["case_id"]) & (small["bundle"] == sound["bundle"])
    return small.join(sound, same).select(small["case_id"], small["bundle"].cast("bigint").alias("bundle"), "n_files", "n_records", "data_bytes", "intact")


def p2_records(spark: SparkSession, sf: str) -> DataFrame:
    """The records read back from the consolidated files."""
    x = compact.restored(compact.bundles(table(spark, sf, "snapshot_files")))
    bits = F.split(F.trim("line"), r"[,\s]+")
    number = lambda i: bits[i].cast("double") + F.lit(0.0)
    return x.select("case_id", F.col("processor").cast("bigint").alias("processor"), "field_name", F.col("write_time").cast("double").alias("moment"), number(0).alias("point"), number(1).alias("value"))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return regular.empty_slots(table(spark, sf, "solution_times"), table(spark, sf, "time_grids"))


def p4_regular(spark: SparkSession, sf: str) -> DataFrame:
    """One row per period of every series: value, coverage and status."""
    r = regular.regular(table(spark, sf, "solution_times"), table(spark, sf, "time_grids"))
    return r.withColumn("value", F.round("value", 9) + F.lit(0.0)).withColumn("coverage", F.round("coverage", 6) + F.lit(0.0))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return spikes.faulty(table(spark, sf, "mask_samples")).select("sample_id")


def p5_profiles(spark: SparkSession, sf: str) -> DataFrame:
    """Per source what is normal for it, and how many readings are not."""
    x = spikes.source_profiles(table(spark, sf, "mask_samples"))
    return x.withColumn("scatter", F.round("scatter", 9) + F.lit(0.0))


QUERIES = {f.__name__: f for f in (csv_weights, p1_found, p1_loaded, p2_found, p2_bundles, p2_records, p4_found, p4_regular, p5_found, p5_profiles)}

_LINES = r"""
WITH rows AS (
  SELECT line_id, any_value(dialect_id) AS dialect_id, any_value(raw_line) AS s FROM csv_lines
  WHERE raw_line IS NOT NULL AND regexp_matches(raw_line, '\S') AND NOT regexp_matches(raw_line, '^(#|TITLE|VARIABLES|ZONE)')
  GROUP BY line_id),
d AS (
  SELECT r.line_id, r.s, x.*, len(x.column_names) AS k FROM rows r JOIN csv_dialects x USING (dialect_id)),
q AS (
  SELECT *, CASE WHEN sep_char = ' ' THEN regexp_full_match(s, '("([^"]|"")*"|[^" ]*)( ("([^"]|"")*"|[^" ]*))*')
    WHEN sep_char = ',' THEN regexp_full_match(s, ' *("([^"]|"")*"|[^",]*) *(, *("([^"]|"")*"|[^",]*) *)*')
    ELSE regexp_full_match(s, ' *("([^"]|"")*"|[^";]*) *(; *("([^"]|"")*"|[^";]*) *)*') END AS quoted_well,
  CASE WHEN sep_char = ' ' THEN regexp_extract_all(s || ' ', '("([^"]|"")*"|[^" ]*) ', 1)
    WHEN sep_char = ',' THEN regexp_extract_all(s || ',', '( *"([^"]|"")*" *|[^",]*),', 1)
    ELSE regexp_extract_all(s || ';', '( *"([^"]|"")*" *|[^";]*);', 1) END AS vals FROM d),
v AS (
  SELECT *, list_transform(vals, lambda x: CASE WHEN sep_char = ' ' THEN regexp_replace(x, '^"(.*)"$', '\1') ELSE trim(regexp_replace(trim(x), '^"(.*)"$', '\1')) END) AS clean FROM q),
ok AS (
  SELECT *, CASE WHEN NOT quoted_well OR len(clean) <> k THEN NULL ELSE list_bool_and(list_transform(range(1, k + 1), lambda i:
    CASE column_types[i] WHEN 'label' THEN true WHEN 'flag' THEN clean[i] IN ('0', '1')
    ELSE regexp_full_match(clean[i], '[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?')
      OR (list_contains(field_columns, column_names[i]) AND (clean[i] = '' OR lower(clean[i]) = 'nan')) END)) END AS typed FROM v)
"""
_VALUE = "CASE WHEN lower({0}) IN ('', 'nan') THEN NULL ELSE CAST(ltrim({0}, '+') AS DOUBLE) END"
_FILES = r"""
WITH f AS (
  SELECT file_id, any_value(case_id) AS case_id, any_value(processor) AS processor, any_value(field_name) AS field_name,
    any_value(CAST(write_time AS DOUBLE)) AS moment, any_value(coalesce(body, '')) AS body FROM snapshot_files GROUP BY file_id),
lines AS (SELECT file_id, trim(unnest(string_split(body, chr(10)))) AS line FROM f),
recs AS (
  SELECT DISTINCT file_id, CAST(regexp_split_to_array(line, '[, ]+')[1] AS DOUBLE) AS p, CAST(regexp_split_to_array(line, '[, ]+')[2] AS DOUBLE) AS v
  FROM lines WHERE line <> '' AND line NOT LIKE '#%'),
n AS (SELECT file_id, count(*) AS n FROM recs GROUP BY file_id),
k AS (SELECT f.file_id, case_id, processor, field_name, moment, coalesce(n.n, 0) AS n FROM f LEFT JOIN n USING (file_id)),
shared AS (
  SELECT a.file_id, b.file_id AS other, a.n AS na, b.n AS nb, count(*) AS c
  FROM k a JOIN k b ON a.case_id = b.case_id AND a.processor = b.processor AND a.field_name = b.field_name AND a.moment = b.moment AND a.file_id <> b.file_id
  JOIN recs x ON x.file_id = a.file_id JOIN recs y ON y.file_id = b.file_id AND x.p = y.p AND x.v = y.v
  GROUP BY ALL),
gone AS (
  SELECT file_id FROM k WHERE n = 0
  UNION SELECT file_id FROM shared WHERE c = na AND (na < nb OR other < file_id))
"""

_SAMPLES = r"""
WITH x AS (
  SELECT sample_id, any_value(source_id) AS source_id, any_value(t_idx) AS t_idx, any_value(CASE loader WHEN 'psp' THEN weight ELSE isvalid END) AS v
  FROM mask_samples GROUP BY sample_id HAVING v IS NOT NULL),
good AS (SELECT * FROM x WHERE NOT isnan(v) AND v >= 0 AND v <= 1),
lev AS (
  SELECT *, abs(v - median(v) OVER (PARTITION BY source_id ORDER BY t_idx ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING)) AS dev,
    CASE WHEN v = lag(v) OVER (PARTITION BY source_id ORDER BY t_idx) THEN 0 ELSE 1 END AS new FROM good),
runs AS (SELECT *, sum(new) OVER (PARTITION BY source_id ORDER BY t_idx) AS run, 1.4826 * median(dev) OVER (PARTITION BY source_id) AS scatter FROM lev),
long AS (SELECT *, count(*) OVER (PARTITION BY source_id, run) AS n FROM runs)
"""

SQL = {
    "p1_found": _LINES + """
SELECT line_id, CASE WHEN NOT quoted_well THEN 'quoting' WHEN len(clean) <> k THEN 'column_count' ELSE 'invalid_value' END AS reason
FROM ok WHERE NOT quoted_well OR len(clean) <> k OR NOT typed
""",
    "p1_loaded": _LINES + f"""
, good AS (SELECT * FROM ok WHERE quoted_well AND len(clean) = k AND typed),
nv AS (SELECT line_id, 'vertex' AS part, unnest(range(len(vertex_columns))) AS position, clean, column_names, vertex_columns AS cols FROM good
  UNION ALL SELECT line_id, 'field', unnest(range(len(field_columns))), clean, column_names, field_columns FROM good),
v2 AS (SELECT line_id, part, position, clean[list_position(column_names, cols[position + 1])] AS v FROM nv),
lab AS (SELECT line_id, list_filter(list_transform(range(1, k + 1), lambda i: CASE WHEN column_types[i] = 'label' THEN replace(clean[i], '""', '"') END), lambda x: x IS NOT NULL) AS labels FROM good)
SELECT line_id, part, position, {_VALUE.format("v")} AS value, CAST(NULL AS VARCHAR) AS text FROM v2
UNION ALL SELECT line_id, 'label', unnest(range(len(labels))), NULL, unnest(labels) FROM lab
UNION ALL SELECT line_id, 'reject', 0, NULL, CASE WHEN NOT quoted_well THEN 'quoting' WHEN len(clean) <> k THEN 'column_count' ELSE 'invalid_value' END
FROM ok WHERE NOT quoted_well OR len(clean) <> k OR NOT typed
""",
    "csv_weights": _LINES + """
, good AS (SELECT * FROM ok WHERE quoted_well AND len(clean) = k AND typed), wat AS (SELECT line_id, clean, list_position(column_names, 'area_x') AS a, list_position(column_names, 'area_y') AS b, list_position(column_names, 'area_z') AS c, list_position(column_names, 'isValid') AS f FROM good),
num AS (SELECT line_id, a, f, TRY_CAST(ltrim(clean[a], '+') AS DOUBLE) AS x, TRY_CAST(ltrim(clean[b], '+') AS DOUBLE) AS y, TRY_CAST(ltrim(clean[c], '+') AS DOUBLE) AS z, TRY_CAST(clean[f] AS DOUBLE) AS v FROM wat)
SELECT line_id, round(CASE WHEN a > 0 THEN sqrt(x * x + y * y + z * z) WHEN f > 0 THEN v ELSE 1.0 END, 6) AS w FROM num
""",
    "p2_found": _FILES + "SELECT file_id FROM gone",
    "p2_bundles": _FILES + r"""
, kept AS (SELECT f.*, octet_length(encode(body)) AS n FROM f ANTI JOIN gone USING (file_id)),
parts AS (SELECT file_id, case_id, processor, field_name, moment, unnest(string_split(body, chr(10))) AS raw, unnest(range(len(string_split(body, chr(10))))) AS pos FROM kept),
own AS (SELECT *, CAST(regexp_split_to_array(trim(raw), '[, ]+')[1] AS DOUBLE) AS p, CAST(regexp_split_to_array(trim(raw), '[, ]+')[2] AS DOUBLE) AS v FROM parts WHERE trim(raw) <> '' AND trim(raw) NOT LIKE '#%'),
first AS (SELECT *, row_number() OVER (PARTITION BY case_id, processor, field_name, moment, p, v ORDER BY file_id, pos) AS rn FROM own),
per AS (SELECT file_id, count(*) FILTER (rn = 1) AS recs, coalesce(sum(octet_length(encode(raw)) + 1) FILTER (rn > 1), 0) AS dropped FROM first GROUP BY file_id),
placed AS (
  SELECT k.case_id, CAST(floor(sum(k.n + 110) OVER (PARTITION BY k.case_id ORDER BY k.file_id) / 1000000) AS BIGINT) AS bundle, per.recs,
    k.n + CASE WHEN k.n > 0 AND right(k.body, 1) <> chr(10) THEN 1 ELSE 0 END - per.dropped AS bytes FROM kept k JOIN per USING (file_id))
SELECT case_id, bundle, count(*) AS n_files, CAST(sum(recs) AS BIGINT) AS n_records, CAST(sum(bytes) AS BIGINT) AS data_bytes, true AS intact FROM placed GROUP BY case_id, bundle
""",
    "p2_records": _FILES + """
SELECT DISTINCT case_id, CAST(processor AS BIGINT) AS processor, field_name, moment, p + 0.0 AS point, v + 0.0 AS value FROM recs JOIN f USING (file_id)
""",
    "p4_found": r"""
WITH r AS (
  SELECT DISTINCT series_id, CAST(write_time AS DOUBLE) AS t FROM solution_times
  WHERE reading IS NOT NULL AND NOT isnan(reading) AND regexp_full_match(write_time, '\s*[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?\s*')),
s AS (SELECT series_id, t_start, delta_t, n_slots, unnest(range(CAST(n_slots AS BIGINT))) AS slot FROM time_grids),
u AS (
  SELECT DISTINCT r.series_id, CAST(CASE WHEN abs(t - (t_start + b * delta_t)) <= abs(t - (t_start + (b + 1) * delta_t)) THEN b ELSE b + 1 END AS BIGINT) AS slot
  FROM (SELECT r.*, g.t_start, g.delta_t, floor((t - g.t_start) / g.delta_t) AS b FROM r JOIN time_grids g USING (series_id)) r)
SELECT s.series_id, s.slot FROM s ANTI JOIN u ON s.series_id = u.series_id AND s.slot = u.slot
""",
    "p4_regular": r"""
WITH one AS (SELECT reading_id, any_value(series_id) AS series_id, any_value(write_time) AS w, any_value(reading) AS v FROM solution_times GROUP BY reading_id),
r AS (SELECT series_id, CAST(w AS DOUBLE) AS t, avg(v) AS v, count(*) AS n FROM one
  WHERE v IS NOT NULL AND NOT isnan(v) AND regexp_full_match(w, '\s*[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?\s*') GROUP BY series_id, t),
a AS (SELECT r.*, g.t_start, g.delta_t, g.n_slots, floor((t - g.t_start) / g.delta_t) AS b FROM r JOIN time_grids g USING (series_id)),
p AS (SELECT *, CAST(CASE WHEN abs(t - (t_start + b * delta_t)) <= abs(t - (t_start + (b + 1) * delta_t)) THEN b ELSE b + 1 END AS BIGINT) AS slot FROM a),
q AS (SELECT *, least(coalesce(lead(t) OVER (PARTITION BY series_id ORDER BY t), 1e300), t + 2 * delta_t) AS till FROM p WHERE slot >= 0 AND slot < n_slots),
s AS (SELECT series_id, t_start, delta_t, unnest(range(CAST(n_slots AS BIGINT))) AS slot FROM time_grids WHERE delta_t > 0 AND n_slots > 0),
h AS (SELECT s.series_id, s.slot, greatest(least(q.till, s.t_start + (s.slot + 0.5) * s.delta_t) - greatest(q.t, s.t_start + (s.slot - 0.5) * s.delta_t), 0) AS span, q.v
  FROM s JOIN q ON q.series_id = s.series_id AND s.slot BETWEEN q.slot AND q.slot + 3),
c AS (SELECT series_id, slot, sum(span) AS total, sum(span * v) AS area FROM h GROUP BY series_id, slot),
o AS (SELECT series_id, slot, CAST(sum(n) AS BIGINT) AS n, avg(v) AS mean FROM q GROUP BY series_id, slot)
SELECT s.series_id, s.slot, s.t_start + s.slot * s.delta_t AS t, coalesce(o.n, 0) AS n_readings,
  round(CASE WHEN c.total > 0 THEN c.area / c.total ELSE o.mean END, 9) + 0.0 AS value, round(least(coalesce(c.total, 0) / s.delta_t, 1), 6) + 0.0 AS coverage,
  CASE WHEN o.n > 0 THEN 'read' WHEN c.total > 0 THEN 'filled' ELSE 'missing' END AS status
FROM s LEFT JOIN c ON c.series_id = s.series_id AND c.slot = s.slot LEFT JOIN o ON o.series_id = s.series_id AND o.slot = s.slot
""",
    "p5_found": _SAMPLES + """
SELECT sample_id FROM x WHERE isnan(v) OR v < 0 OR v > 1
UNION ALL SELECT sample_id FROM long WHERE scatter > 0 AND (dev > 8 * scatter OR n >= 8)
""",
    "p5_profiles": _SAMPLES + """
, g AS (SELECT source_id, count(*) AS readings, any_value(scatter) AS scatter, count(*) FILTER (scatter > 0 AND dev > 8 * scatter) AS spike, count(*) FILTER (scatter > 0 AND dev <= 8 * scatter AND n >= 8) AS stuck FROM long GROUP BY source_id),
w AS (SELECT source_id, count(*) FILTER (isnan(v) OR v < 0 OR v > 1) AS impossible FROM x GROUP BY source_id)
SELECT source_id, coalesce(readings, 0) AS readings, round(scatter, 9) + 0.0 AS scatter, impossible, coalesce(spike, 0) AS spike, coalesce(stuck, 0) AS stuck FROM w LEFT JOIN g USING (source_id)
""",
}
