"""Queries of the training-data operators and, where SQL can say them, their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wanderframe.llm import bpe, cooccur, dedup_format, frequent, packing, sentences
from wanderframe.session import table

CAPACITY = 2048
LEAST, LIFT = 10, 20
SHARE = 0.005


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = cooccur.common_baskets(table(spark, d, "footprints"), "walker", "vertex", LEAST, LIFT)
    return pairs.select(F.col("item_a").alias("vertex_a"), F.col("item_b").alias("vertex_b"))


def p3_lift(spark: SparkSession, d: str) -> DataFrame:
    pairs = cooccur.common_baskets(table(spark, d, "footprints"), "walker", "vertex", LEAST, LIFT)
    return pairs.select(F.col("item_a").alias("vertex_a"), F.col("item_b").alias("vertex_b"), "n_ab", "n_a", "n_b", "lift")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return frequent.above_share(table(spark, d, "footprints"), "vertex", SHARE, "vertex").select("vertex")


def p4_top100(spark: SparkSession, d: str) -> DataFrame:
    return frequent.top_values(table(spark, d, "footprints"), "vertex", 100, "vertex").select("vertex", F.col("n").alias("visits"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return dedup_format.copies(table(spark, d, "edge_records"))


def p5_records(spark: SparkSession, d: str) -> DataFrame:
    found = dedup_format.collapse(table(spark, d, "edge_records"))
    named = lambda n: F.nullif(F.regexp_extract("canon", rf"(?:^|\|){n}=([^|]*)", 1), F.lit(""))
    plain = lambda n: F.translate(named(n), dedup_format.DOT, ".")
    return found.select("keep_id", *(plain(n).alias(n) for n in ("src", "dst", "weight")), "n_copies")


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode_corpus(table(spark, d, "documents"))


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    sizes = bpe.token_counts(table(spark, d, "documents"))
    return packing.pack(sizes, "doc_id", "n_tokens", CAPACITY)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    prose = table(spark, d, "documents").where(F.col("kind") == "prose")
    return sentences.split_sentences(prose)


def p8_sentences(spark: SparkSession, d: str) -> DataFrame:
    return sentences.split_sentences(table(spark, d, "documents"), kind=F.col("kind"), language=F.col("prog_lang"), path=F.col("path"), levels=True)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p3_found, p3_lift, p4_found, p4_top100, p5_found, p5_records, p6_ids, p7_containers, p8_found, p8_sentences)
}

PAIRS = """
WITH v AS (SELECT DISTINCT walker, vertex FROM footprints WHERE walker IS NOT NULL AND vertex IS NOT NULL),
     t AS (SELECT count(DISTINCT walker) AS n FROM footprints),
     s AS (SELECT vertex, count(*) AS n FROM v GROUP BY vertex),
     w AS (SELECT v.walker, v.vertex FROM v JOIN s USING (vertex) WHERE s.n >= 10),
     p AS (SELECT a.vertex AS vertex_a, b.vertex AS vertex_b, count(*) AS n_ab
           FROM w a JOIN w b ON a.walker = b.walker AND a.vertex < b.vertex GROUP BY 1, 2 HAVING count(*) >= 10)
SELECT {columns} FROM p JOIN s a ON a.vertex = p.vertex_a JOIN s b ON b.vertex = p.vertex_b, t
WHERE p.n_ab * t.n >= 20 * a.n * b.n
"""

# The canonical form again, in an expression language without lookaround.
CANON = r"""
WITH a AS (SELECT rec_id, lower(record) AS s FROM edge_records WHERE record IS NOT NULL),
b AS (SELECT rec_id, regexp_replace(regexp_replace(s, '([0-9])\.([0-9])', '\1' || chr(57344) || '\2', 'g'), '([0-9])\.([0-9])', '\1' || chr(57344) || '\2', 'g') AS s FROM a),
c AS (SELECT rec_id, '  ' || regexp_replace(s, '[^\p{L}\p{M}\p{N}' || chr(57344) || ']+', '  ', 'g') || '  ' AS s FROM b),
d AS (SELECT rec_id, s, replace(regexp_replace(s, ' (src|dst|weight) ', chr(57345) || '\1=', 'g'), ' ', '') AS f FROM c),
e AS (SELECT rec_id, s, list_sort(list_filter(string_split(f, chr(57345))[2:], lambda x: NOT ends_with(x, '='))) AS f FROM d),
canon AS (SELECT rec_id, CASE WHEN len(f) > 0 THEN array_to_string(f, '|') ELSE '?' || replace(s, ' ', '') END AS c FROM e)
"""


def field_sql(name: str) -> str:
    return f"nullif(replace(regexp_extract(c, '(?:^|\\|){name}=([^|]*)', 1), chr(57344), '.'), '') AS {name}"


ORACLES = {
    "p5_found": CANON + "SELECT keep_id, rec_id AS copy_id FROM (SELECT rec_id, min(rec_id) OVER (PARTITION BY c) AS keep_id FROM canon) WHERE rec_id <> keep_id",
    "p5_records": CANON + f"SELECT min(rec_id) AS keep_id, {field_sql('src')}, {field_sql('dst')}, {field_sql('weight')}, count(*) AS n_copies FROM canon GROUP BY c",
    "p3_found": PAIRS.format(columns="vertex_a, vertex_b"),
    "p3_lift": PAIRS.format(columns="vertex_a, vertex_b, n_ab, a.n AS n_a, b.n AS n_b, CAST(n_ab * t.n AS DOUBLE) / (a.n * b.n) AS lift"),
    "p4_found": """
SELECT vertex FROM footprints WHERE vertex IS NOT NULL GROUP BY vertex
HAVING count(*) >= 0.005 * (SELECT count(vertex) FROM footprints)""",
    "p4_top100": """
SELECT vertex, count(*) AS visits FROM footprints WHERE vertex IS NOT NULL
GROUP BY vertex ORDER BY visits DESC, vertex LIMIT 100""",
}
