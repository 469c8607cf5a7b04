"""Queries that pass tables through the engine's files in the shared folder and read them again."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wanderframe.operators import paths
from wanderframe.operators.graph import Graph
from wanderframe.plans import walk_queries as wq
from wanderframe.session import qualified, shared_dir, table
from wanderframe.sources import edges as io

TYPED = "SELECT src, dst, CAST(weight AS FLOAT) AS weight, etype FROM edges WHERE src IS NOT NULL AND dst IS NOT NULL AND weight IS NOT NULL AND etype IS NOT NULL"


def place(spark: SparkSession) -> str:
    """A fresh folder in the shared file system."""
    return f"{qualified(spark, shared_dir(spark))}/files-{uuid.uuid4().hex}"


def typed(spark: SparkSession, d: str) -> DataFrame:
    """The edges that these formats can hold: they have no sign for a null."""
    return table(spark, d, "edges").select("src", "dst", "weight", "etype").dropna()


def binary_edges(spark: SparkSession, d: str) -> DataFrame:
    to = place(spark)
    io.write_edges(typed(spark, d), to, "binary")
    return io.read_edges(spark, to, "binary", typed=True)


def text_edges(spark: SparkSession, d: str) -> DataFrame:
    to = place(spark)
    io.write_edges(typed(spark, d), to, "text")
    return io.read_edges(spark, to, "text", typed=True)


def converted_edges(spark: SparkSession, d: str) -> DataFrame:
    to = place(spark)
    io.write_edges(table(spark, d, "edges").select("src", "dst").dropna(), f"{to}/text", "text")
    io.convert(spark, f"{to}/text", f"{to}/binary", weighted=False)
    return io.read_edges(spark, f"{to}/binary", "binary", weighted=False)


def graph_load(spark: SparkSession, d: str) -> DataFrame:
    """A typed, weighted graph from its binary file, both directions of each edge, negative weights left out before."""
    to = place(spark)
    io.write_edges(typed(spark, d).where("weight >= 0"), to, "binary")
    return Graph.load(spark, to, 1 << 32, undirected=True, typed=True).edges


def scheme_file(spark: SparkSession, d: str) -> DataFrame:
    """The schemes by way of their text format; the file is written and read by the driver, as the reader is."""
    to = place(spark)
    io.write_schemes(io.scheme_rows(table(spark, d, "schemes")), to)
    return spark.createDataFrame(io.read_schemes(to), "scheme_id int, pos int, etype int, allowed boolean")


def path_files(spark: SparkSession, d: str) -> DataFrame:
    to = place(spark)
    paths.write_paths(wq.biased_walk(spark, d), to, with_head=True)
    return spark.read.text(to).select(F.col("value").alias("line"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (binary_edges, text_edges, converted_edges, graph_load, scheme_file, path_files)}

ORACLES = {
    "binary_edges": TYPED,
    "text_edges": TYPED,
    "converted_edges": "SELECT src, dst FROM edges WHERE src IS NOT NULL AND dst IS NOT NULL",
    "graph_load": f"WITH e AS ({TYPED} AND weight >= 0) SELECT src, dst, weight, etype FROM e UNION ALL SELECT dst, src, weight, etype FROM e",
    "scheme_file": "SELECT scheme_id, pos, etype, allowed FROM schemes",
    "path_files": wq.WALKED + "SELECT wid || ' ' || count(*) || ' ' || string_agg(v, ' ' ORDER BY step) AS line FROM t GROUP BY wid",
}
