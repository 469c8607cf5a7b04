"""Tables from which an edge is drawn in proportion to its static weight.

Weights become integers, so running sums are exact and every engine agrees on
them.  The scale is each vertex's own: a power of two that brings its total
near 2^TOTAL_BITS, so weights of any magnitude keep their proportions, and an
edge with a positive weight counts at least 1.  `intervals` gives each edge
its part [lo, hi) of its vertex's total.  `cells` cuts the same total into as
many equal cells as the vertex has edges and lists the edges that reach into
each cell: a draw falls into one cell, and a cell holds two entries on
average.  A move is thus an equi-join on (vertex, cell), which spreads the
walkers of a hub over all partitions and costs the same whatever its degree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wanderframe.operators.graph import Graph, bounds_of, part_of, running_sums
from wanderframe.session import kept

#: Bits of a vertex's total: far below those of a draw (62), so draws are even, and within a double's 53.
TOTAL_BITS = 50
#: Moves the powers of two, where the scale doubles, off the sums that weights usually have.
OFF = 1.0000001
#: Cells that one row unfolds to at once.
UNFOLD = 4096


def cell_of(r: Column, deg: Column, tot: Column) -> Column:
    """Monotone in r for a fixed vertex, which is all that the join needs."""
    return F.floor(r.cast("double") * (deg.cast("double") / tot.cast("double"))).cast("long")


def drawable(weight: Column) -> Column:
    return (weight > 0) & (weight < F.lit(float("inf")))


def scaled(weight: Column, best: Column, total: Column, n: Column) -> Column:
    """weight as an integer, by the largest weight, the sum and the number of the vertex's drawable weights.

    All factors are powers of two, so weights of few digits stay exact.
    """
    unit = F.pow(F.lit(2.0), F.floor(F.log2(best * F.lit(OFF))).cast("double"))
    spread = F.least(total / unit, n * F.lit(2.0))  # a sum beyond the range of doubles is infinite
    scale = F.pow(F.lit(2.0), F.lit(TOTAL_BITS - 1.0) - F.floor(F.log2(spread * F.lit(OFF))))
    return F.greatest(F.floor(weight / unit * scale + F.lit(0.5)).cast("long"), F.lit(1).cast("long"))


def scaled_sql(edges: str, weight: str) -> str:
    """The same as a SELECT for another engine: the edges with w, 0 for those that can't be drawn."""
    ok = f"({weight}) > 0 AND ({weight}) < CAST('Infinity' AS DOUBLE)"
    of = f"FILTER (WHERE {ok}) OVER (PARTITION BY src)"
    inner = f"SELECT *, max({weight}) {of} AS _best, sum({weight}) {of} AS _sum, count(*) {of} AS _n FROM ({edges})"
    inner = f"SELECT *, pow(2.0, floor(log2(_best * CAST({OFF} AS DOUBLE)))) AS _unit FROM ({inner})"
    scale = f"pow(2.0, {TOTAL_BITS - 1} - floor(log2(least(_sum / _unit, _n * CAST(2.0 AS DOUBLE)) * CAST({OFF} AS DOUBLE))))"
    return f"SELECT * EXCLUDE (_best, _sum, _n, _unit), CASE WHEN {ok} THEN greatest(CAST(floor(({weight}) / _unit * {scale} + 0.5) AS BIGINT), 1) ELSE 0 END AS w FROM ({inner})"


def intervals(graph: Graph, static: str | None, uniform_if_zero: bool = True, buckets: int = 64) -> DataFrame:
    """The edges with w, lo, hi, tot, deg.  static None: every edge weighs the same.

    Edges that can't be drawn (weight null, not finite, zero or below) are left out; a vertex without any positive
    weight draws uniformly if uniform_if_zero, else it has no edge to draw.
    """
    edges = graph.edges.where(graph.valid())
    payload = [c for c in edges.columns if c not in ("src", "dst")]
    edges = edges.withColumn("_b", part_of(F.col("dst"), bounds_of(edges, "dst", buckets)))
    if static is None:
        weighed = edges.withColumn("w", F.lit(1).cast("long"))
    else:
        # what a vertex's scale needs comes by way of its parts, so that a hub's edges stay spread over them
        edges = edges.withColumn("_x", F.expr(static).cast("double"))
        own = F.when(drawable(F.col("_x")), F.col("_x"))
        parts = edges.groupBy("src", "_b").agg(F.max(own).alias("m"), F.sum(own).alias("s"), F.count(own).alias("n"))
        whole = Window.partitionBy("src")
        parts = parts.select("src", "_b", F.max("m").over(whole).alias("_m"), F.sum("s").over(whole).alias("_s"), F.sum("n").over(whole).alias("_n"))
        value = F.when(drawable(F.col("_x")), scaled(F.col("_x"), F.col("_m"), F.col("_s"), F.col("_n"))).otherwise(F.lit(0).cast("long"))
        if uniform_if_zero:
            value = F.when(F.col("_n") == 0, F.lit(1).cast("long")).otherwise(value)
        weighed = edges.join(parts, ["src", "_b"]).withColumn("w", value).drop("_x", "_m", "_s", "_n").where("w > 0")
    out = running_sums(weighed, ["src"], ["dst", *payload], "w", part="_b")
    return out.withColumn("lo", F.col("hi") - F.col("w")).select("src", "dst", *payload, "w", "lo", "hi", "tot", "deg")


def vertex_totals(cdf: DataFrame) -> DataFrame:
    return cdf.groupBy(F.col("src").alias("v")).agg(F.max("tot").alias("tot"), F.max("deg").alias("deg"))


def unfolded(df: DataFrame, first: Column, last: Column) -> DataFrame:
    """One row for each cell from first to last, in two steps, so that no array holds more than UNFOLD."""
    df = df.withColumn("_f", first).withColumn("_l", last)
    df = df.withColumn("_k", F.explode(F.sequence(F.floor(F.col("_f") / UNFOLD), F.floor(F.col("_l") / UNFOLD))))
    inside = F.sequence(F.greatest("_f", F.col("_k") * UNFOLD), F.least("_l", F.col("_k") * UNFOLD + (UNFOLD - 1)))
    return df.withColumn("cell", F.explode(inside)).drop("_f", "_l", "_k")


def cells(cdf: DataFrame, vertices: DataFrame) -> DataFrame:
    """(src, cell) -> edge, with what the walker needs at dst: its totals and attributes.

    vertices: (v, tot, deg, at_…) of every vertex with out-edges or attributes.
    """
    deg, tot = F.col("deg"), F.col("tot")
    cut = unfolded(cdf, cell_of(F.col("lo"), deg, tot), cell_of(F.col("hi") - 1, deg, tot)).drop("tot", "deg", "w")
    there = vertices.select(F.col("v").alias("dst"), *[F.col(c).alias(f"to_{c.removeprefix('at_')}") for c in vertices.columns if c != "v"])
    return cut.join(there, "dst", "left").withColumn("to_tot", F.coalesce("to_tot", F.lit(0))).withColumn("to_deg", F.coalesce("to_deg", F.lit(0)))


def alias_table(graph: Graph, static: str | None) -> DataFrame:
    """An explicit alias table (src, first, p, second): a bucket gives `first` with probability p, else `second`.

    Every vertex has as many buckets as edges.  Edges below the average open their own bucket and take what is
    missing from heavier ones, one after another; a heavy edge that is overdrawn takes the difference from the
    next.  What the light edges lack and what the heavy ones have over are two divisions of one length, so prefix
    sums place both, and the edge on the other side is found by an equi-join on (src, cell) as in a walk's move.
    No step holds a vertex's edges in one task.  Walks draw from `cells`; this table serves inspection.
    """
    cdf = kept(intervals(graph, static))
    wide = "decimal(38,0)"
    mass, tot = F.col("deg").cast(wide) * F.col("w").cast("decimal(19,0)"), F.col("tot").cast(wide)  # a bucket holds tot, an edge deg * w
    edges = cdf.select("src", "dst", "deg", tot.alias("bucket"), mass.cast(wide).alias("m"), F.col("hi").alias("at"), (mass >= tot).alias("heavy"))
    edges = edges.withColumn("gap", F.abs(F.col("m") - F.col("bucket")).cast("decimal(28,0)"))
    edges = running_sums(edges, ["src", "heavy"], ["at"], "gap", names=("end", "length", "_rows")).withColumn("begin", F.col("end") - F.col("gap"))
    edges = kept(edges)  # each of its sides is read several times
    light, heavy = edges.where("NOT heavy"), edges.where("heavy")
    place = lambda x: cell_of(x, F.col("deg"), F.greatest("length", F.lit(1)))

    def pieces(df: DataFrame, *columns: str) -> DataFrame:
        own = unfolded(df.where("gap > 0"), place(F.col("begin")), place(F.col("end") - 1))
        return own.select("src", "cell", F.col("begin").alias("b"), F.col("end").alias("e"), *[F.col(c).alias(f"of_{c}") for c in columns])

    supply = pieces(heavy, "dst")
    inside = lambda at: (F.col("b") <= at) & (F.col("e") > at)
    small = light.withColumn("cell", place(F.col("begin"))).join(supply, ["src", "cell"]).where(inside(F.col("begin")))
    small = small.select("src", F.col("dst").alias("first"), (F.col("m").cast("double") / F.col("bucket").cast("double")).alias("p"), F.col("of_dst").alias("second"))
    # a heavy edge is overdrawn by the light one whose debt lies on both sides of its end
    debt = pieces(light).withColumnRenamed("src", "of")
    ends = heavy.withColumn("_cell", F.when(F.col("gap") > 0, place(F.col("end") - 1)))
    across = (F.col("src") == F.col("of")) & (F.col("_cell") == F.col("cell")) & inside(F.col("end") - 1) & (F.col("e") > F.col("end"))
    drawn = ends.join(debt, across, "left").withColumn("short", F.coalesce(F.col("e") - F.col("end"), F.lit(0).cast(wide)))
    after = heavy.where("gap > 0").select("src", F.col("begin").alias("end"), F.col("dst").alias("following"))
    drawn = drawn.select("src", "dst", "end", "short", "bucket").join(after, ["src", "end"], "left")
    big = drawn.select("src", F.col("dst").alias("first"), (1 - F.col("short").cast("double") / F.col("bucket").cast("double")).alias("p"), F.when(F.col("short") > 0, F.col("following")).alias("second"))
    return small.unionByName(big)
