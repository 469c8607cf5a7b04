"""Exact transition matrices, what walks did in fact, and the comparison of both."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wanderframe.operators.graph import Graph
from wanderframe.operators.keyed import sum_of, sum_parts
from wanderframe.session import cut

PARTS = ("_places", "_beyond", "_large")


def weighed(edges: DataFrame, weight: str | None) -> DataFrame:
    """The edges that can be drawn, with their weight as _w."""
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    return edges.withColumn("_w", w).where((F.col("_w") > 0) & (F.col("_w") < F.lit(float("inf"))))


def shares(rows: DataFrame, keys: list[str], dst: str = "dst") -> DataFrame:
    """(keys…, dst, w, prob) of rows with _w: parallel edges add up; sums of partial sums, so their order doesn't matter."""
    n = rows.groupBy(*keys, dst).agg(*[x.alias(c) for c, x in sum_parts(F.col("_w")).items()])
    total = n.groupBy(*keys).agg(*[F.sum(c).alias(f"t{c}") for c in PARTS])
    both = n.join(total, keys).withColumns({"w": sum_of(*map(F.col, PARTS)), "t": sum_of(*[F.col(f"t{c}") for c in PARTS])})
    return both.select(*keys, dst, "w", (F.col("w") / F.col("t")).alias("prob"))


def transition_matrix(edges: DataFrame, weight: str | None = "weight") -> DataFrame:
    """(src, dst, prob): weight over the weight of src; parallel edges add up."""
    return shares(weighed(edges, weight), ["src"]).drop("w")


def node2vec_matrix(edges: DataFrame, p: float, q: float, weight: str | None = "weight") -> DataFrame:
    """(prev, cur, dst, prob): the second-order matrix, one row for each pair of consecutive edges."""
    n = shares(weighed(edges, weight), ["src"]).drop("prob")
    first = n.select(F.col("src").alias("prev"), F.col("dst").alias("cur"))
    second = n.select(F.col("src").alias("cur"), "dst", "w")
    known = n.select(F.col("src").alias("prev"), "dst", F.lit(True).alias("linked"))
    rows = first.join(second, "cur").join(known, ["prev", "dst"], "left")
    d = F.when(F.col("dst") == F.col("prev"), 1 / p).when(F.col("linked"), 1.0).otherwise(1 / q)
    rows = rows.select("prev", "cur", "dst", (F.col("w") * d).alias("m"))
    total = rows.groupBy("prev", "cur").agg(F.sum("m").alias("t"))
    return rows.join(total, ["prev", "cur"]).select("prev", "cur", "dst", (F.col("m") / F.col("t")).alias("prob"))


def reachable_states(edges: DataFrame, seeds: DataFrame, condition: str, following: dict[str, str], most: int = 10_000) -> DataFrame:
    """All (v, state…) that walks from `seeds` can reach over edges that meet `condition`; a fixpoint of joins.

    condition and following may name v, dst, the edge's columns and the state's columns.
    """
    names = seeds.columns
    deltas = [cut(seeds.distinct())]
    for _ in range(most):
        moves = deltas[-1].join(edges, deltas[-1].v == edges.src).where(condition)
        steps = moves.select(F.col("dst").alias("v"), *[F.expr(following.get(c, c)).alias(c) for c in names if c != "v"]).distinct()
        # each round writes what is new; what was found before is read, not written again
        fresh = cut(steps.join(union_of(deltas), names, "left_anti"))
        if fresh.isEmpty():
            return union_of(deltas)
        deltas.append(fresh)
    raise RuntimeError("no fixpoint")


def union_of(parts: list[DataFrame]) -> DataFrame:
    """A balanced union, so that the plan's depth is the logarithm of the number of parts."""
    while len(parts) > 1:
        parts = [parts[k].unionByName(parts[k + 1]) if k + 1 < len(parts) else parts[k] for k in range(0, len(parts), 2)]
    return parts[0]


def typed_matrix(states: DataFrame, edges: DataFrame, condition: str, weight: str | None, dynamic: str = "1.0D") -> DataFrame:
    """(v, state…, dst, prob) over the edges that a walker in each state may take, in proportion to weight * dynamic.

    condition and dynamic may name v, dst, the edge's columns and the state's columns.
    """
    rows = weighed(edges, weight).join(states, F.col("src") == F.col("v")).where(condition).withColumn("_w", F.col("_w") * F.expr(dynamic))
    return shares(rows.where("_w > 0"), states.columns).drop("w")


def hops(walks: DataFrame) -> DataFrame:
    """(wid, step, src, dst) of every move.  One walker's visits are one window."""
    w = Window.partitionBy("wid").orderBy("step")
    rows = walks.select("wid", "step", F.col("v").alias("src"), F.lead("v").over(w).alias("dst"), F.lead("step").over(w).alias("_n"))
    return rows.where(F.col("_n") == F.col("step") + 1).drop("_n")


def empirical_matrix(walks: DataFrame) -> DataFrame:
    n = hops(walks).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))
    total = n.groupBy("src").agg(F.sum("n").alias("t"))
    return n.join(total, "src").select("src", "dst", "n", (F.col("n") / F.col("t")).alias("prob"))


def empirical_second_order(walks: DataFrame) -> DataFrame:
    w = Window.partitionBy("wid").orderBy("step")
    rows = hops(walks).select("wid", F.col("src").alias("prev"), F.col("dst").alias("cur"), F.lead("dst").over(w).alias("dst")).where("dst IS NOT NULL")
    n = rows.groupBy("prev", "cur", "dst").agg(F.count(F.lit(1)).alias("n"))
    total = n.groupBy("prev", "cur").agg(F.sum("n").alias("t"))
    return n.join(total, ["prev", "cur"]).select("prev", "cur", "dst", "n", (F.col("n") / F.col("t")).alias("prob"))


def compare_matrices(exact: DataFrame, seen: DataFrame, keys: list[str]) -> DataFrame:
    """One row: (entries, only_exact, only_seen, sum_sq).  Rows that no walk visited are not compared."""
    rows = keys[:-1]
    exact = exact.join(seen.select(*rows).distinct(), rows, "left_semi")
    both = exact.select(*keys, F.col("prob").alias("a")).join(seen.select(*keys, F.col("prob").alias("b")), keys, "full")
    diff = F.coalesce("a", F.lit(0.0)) - F.coalesce("b", F.lit(0.0))
    return both.agg(F.count(F.lit(1)).alias("entries"), F.count_if(F.col("b").isNull()).alias("only_exact"), F.count_if(F.col("a").isNull()).alias("only_seen"), F.sum(diff * diff).alias("sum_sq"))


def illegal_hops(walks: DataFrame, graph: Graph) -> DataFrame:
    """Moves that are no edge."""
    return hops(walks).join(graph.edges.select("src", "dst").distinct(), ["src", "dst"], "left_anti")


def visit_counts(walks: DataFrame) -> DataFrame:
    return walks.groupBy("v").agg(F.count(F.lit(1)).alias("visits"), F.count_distinct("wid").alias("walkers"))


def ppr_scores(walks: DataFrame) -> DataFrame:
    """Share of the walks that end at each vertex: the Monte Carlo estimate of personalized PageRank."""
    ends = walks.groupBy("wid").agg(F.max_by("v", "step").alias("v"))
    n = ends.groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    total = n.agg(F.sum("n").alias("t"))
    return n.join(F.broadcast(total)).select("v", "n", (F.col("n") / F.col("t")).alias("score"))
