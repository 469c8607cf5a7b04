"""Seeded random graphs without loops and parallel edges, for tests and trials; every row follows from its number."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wanderframe.functions import rng
from wanderframe.operators.graph import symmetrise


def random_edges(spark: SparkSession, v_num: int, e_num: int, undirected: bool = True, seed: int = 1, types: int = 5, continuous: bool = False) -> DataFrame:
    """(src, dst, weight, etype).  e_num counts directed rows; undirected graphs hold both directions of e_num / 2 pairs.

    Weights are the integers 1 to 5, or with continuous=True spread over [1, 5).
    """
    wanted = e_num // 2 if undirected else e_num
    possible = v_num * (v_num - 1) // (2 if undirected else 1)
    if wanted > possible:
        raise ValueError(f"{wanted} of {possible} possible pairs")
    dense = wanted > possible // 2  # draws would repeat too often: all pairs are numbered, and the first by their draw are taken
    rows = rng.with_walker_hash(spark.range(v_num * v_num if dense else 4 * wanted + 64).select(F.col("id").alias("wid")))
    rows = rng.with_draws(rows, {"a": 21, "b": 22, "w": 23, "t": 24}, step=F.lit(seed))
    if dense:
        ends = rows.select(F.expr(f"wid DIV {v_num}").alias("src"), (F.col("wid") % v_num).alias("dst"), "w", "t", F.col("a").alias("k")).where("src < dst" if undirected else "src <> dst")
    else:
        ends = rows.select((F.col("a") % v_num).alias("src"), (F.col("b") % v_num).alias("dst"), "w", "t", F.col("wid").alias("k")).where("src <> dst")
    if undirected:
        ends = ends.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "w", "t", "k")
    once = ends.groupBy("src", "dst").agg(F.min(F.struct("k", "w", "t")).alias("x"))
    chosen = once.orderBy("x.k").limit(wanted)
    weight = 1 + F.col("x.w") * 4 / rng.P if continuous else (1 + F.col("x.w") % 5).cast("double")
    edges = chosen.select("src", "dst", weight.alias("weight"), (F.col("x.t") % types).cast("int").alias("etype"))
    return symmetrise(edges) if undirected else edges
