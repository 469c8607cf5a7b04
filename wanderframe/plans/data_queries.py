"""Queries of the general data operators over the walk engine's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wanderframe.operators import error_parse, keyed
from wanderframe.session import table

SHARE = 0.01


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    hot = lambda name, df, key: keyed.frequent_keys(df, key, SHARE).select(F.lit(name).alias("field_name"), "vertex")
    return hot("edge_src", table(spark, d, "edges"), "src").unionByName(hot("adj_neighbour", table(spark, d, "adjunits"), "neighbour"))


def p1_edge_src(spark: SparkSession, d: str) -> DataFrame:
    return keyed.key_totals(table(spark, d, "edges"), "src", "weight")


def p1_adj_neighbour(spark: SparkSession, d: str) -> DataFrame:
    return keyed.key_totals(table(spark, d, "adjunits"), "neighbour", "weight")


def _parsed(spark: SparkSession, d: str) -> DataFrame:
    return error_parse.parse_lines(table(spark, d, "edge_lines"), table(spark, d, "edge_files"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Lines of a file without a layout don't load either; their reason is `layout`."""
    return _parsed(spark, d).where("reason IS NOT NULL").select("line_id", "reason")


def p2_loaded(spark: SparkSession, d: str) -> DataFrame:
    return _parsed(spark, d).where("reason IS NULL").select("line_id", "file_id", "src", "dst", "weight", "etype")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p1_found, p1_edge_src, p1_adj_neighbour, p2_found, p2_loaded)}

TOTALS = """
SELECT {key} AS vertex, count(*) AS degree, CAST(coalesce(sum(CAST(weight AS DECIMAL(20,6))), 0) AS DOUBLE) AS sum_weight
FROM {table} WHERE {key} IS NOT NULL GROUP BY {key}"""

# Splits a line by its layout as the README defines it: fields are cut by a list expression over the parts between
# quotation marks, so separators inside an enclosed field never count.
LINES = r"""
WITH l AS (
  SELECT line_id, file_id, n_columns, column_names, v_num, separator AS sep, quote_char AS q,
         regexp_replace(line, '\r$', '') AS line
  FROM edge_lines LEFT JOIN edge_files USING (file_id)
  WHERE NOT regexp_full_match(regexp_replace(line, '\r$', ''), '[ \t]*(#(.|\n)*)?')),
m AS (
  SELECT *, CASE sep WHEN '|' THEN '\|' ELSE sep END AS s,
         CASE WHEN sep = chr(9) THEN '[ ]*' ELSE '[ \t]*' END AS b FROM l),
g AS (
  SELECT *, CASE WHEN q IS NULL THEN NULL ELSE b || '("([^"]|"")*"|([^" \t' || s || '][^"' || s || ']*)?)' || b END AS f FROM m),
p AS (
  SELECT *, q IS NOT NULL AND NOT regexp_full_match(line, '(' || f || s || ')*' || f, 's') AS broken,
         CASE WHEN sep = ' ' THEN regexp_split_to_array(trim(line, ' ' || chr(9)), '[ \t]+')
              WHEN q IS NULL THEN list_transform(string_split(line, sep), lambda x: trim(x, ' ' || chr(9)))
              ELSE list_transform(regexp_extract_all(line || sep, f || s), lambda x: trim(left(x, length(x) - 1), ' ' || chr(9))) END AS raw FROM g),
c AS (
  SELECT *, string_split(column_names, ',') AS names,
         list_transform(raw, lambda x: CASE WHEN q IS NOT NULL AND left(x, 1) = '"' THEN replace(x[2:length(x) - 1], '""', '"') ELSE x END) AS v FROM p),
o AS (
  SELECT *, len(v) = n_columns AS fits, v[list_position(names, 'src')] AS s1, v[list_position(names, 'dst')] AS s2,
         v[list_position(names, 'weight')] AS s3, v[list_position(names, 'etype')] AS s4 FROM c),
r AS (
  SELECT *, CASE WHEN n_columns IS NULL THEN 'layout' WHEN broken THEN 'quoting' WHEN NOT fits THEN 'column_count'
    WHEN NOT coalesce(regexp_full_match(s1, '[0-9]+') AND try_cast(s1 AS HUGEINT) < v_num, false) THEN 'src'
    WHEN NOT coalesce(regexp_full_match(s2, '[0-9]+') AND try_cast(s2 AS HUGEINT) < v_num, false) THEN 'dst'
    WHEN list_contains(names, 'weight') AND NOT coalesce(regexp_full_match(s3, '\+?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?') AND isfinite(try_cast(s3 AS DOUBLE)), false) THEN 'data'
    WHEN list_contains(names, 'etype') AND NOT regexp_full_match(s4, '[0-4]') THEN 'data' END AS reason FROM o)
"""

ORACLES = {
    "p1_found": """
SELECT 'edge_src' AS field_name, src AS vertex FROM edges WHERE src IS NOT NULL GROUP BY src
HAVING count(*) >= 0.01 * (SELECT count(src) FROM edges)
UNION ALL
SELECT 'adj_neighbour', neighbour FROM adjunits WHERE neighbour IS NOT NULL GROUP BY neighbour
HAVING count(*) >= 0.01 * (SELECT count(neighbour) FROM adjunits)""",
    "p1_edge_src": TOTALS.format(key="src", table="edges"),
    "p1_adj_neighbour": TOTALS.format(key="neighbour", table="adjunits"),
    "p2_found": LINES + "SELECT line_id, reason FROM r WHERE reason IS NOT NULL",
    "p2_loaded": LINES
    + """SELECT line_id, file_id, CAST(s1 AS BIGINT) AS src, CAST(s2 AS BIGINT) AS dst,
       CASE WHEN list_contains(names, 'weight') THEN CAST(s3 AS DOUBLE) END AS weight,
       CASE WHEN list_contains(names, 'etype') THEN CAST(s4 AS INTEGER) END AS etype FROM r WHERE reason IS NULL""",
}
