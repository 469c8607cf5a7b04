"""The graph: a table of directed edges, parallel ones included, and what can be derived from it.

Vertices are the ids below v_num, or with v_num None those that occur; there
is no vertex table unless attributes are given.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wanderframe.session import kept


class GraphError(ValueError):
    """The edges contradict what the graph declares."""


def symmetrise(edges: DataFrame) -> DataFrame:
    """Both directions of every edge with the same payload; nothing is deduplicated."""
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    ends = F.explode(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"))))
    return edges.select(ends.alias("_e"), *rest).select("_e.src", "_e.dst", *rest)


def transpose(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *[c for c in edges.columns if c not in ("src", "dst")])


def bounds_of(df: DataFrame, column: str, parts: int) -> list:
    """Values that cut the rows of df into about equal parts by the column; one pass with a mergeable sketch."""
    shares = F.array(*[F.lit(k / parts) for k in range(1, parts)])
    found = df.agg(F.percentile_approx(column, shares, F.lit(20 * parts)).alias("b")).first().b
    return sorted(set(found or []))


def part_of(x: Column, bounds: list) -> Column:
    """How many of the bounds are below x, as a binary search that the compiler unrolls."""

    def search(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(x > F.lit(bounds[mid]), search(mid + 1, hi)).otherwise(search(lo, mid))

    return search(0, len(bounds))


def running_sums(df: DataFrame, group: list[str], order: list[str], value: str, buckets: int = 64, names: tuple[str, str, str] = ("hi", "tot", "deg"), part: str | None = None) -> DataFrame:
    """Adds the running sum of `value` within the group, and the sum and the rows of the group.

    The sums are taken in two levels.  Rows are first divided by ranges of the first order column that hold about
    as many rows each, so the window of one group with most of the rows works on `buckets` parts at once however
    its values lie; the parts' totals then give the offsets.  part names a column that divides the rows already.
    """
    hi, tot, deg = names
    own_part = part or "_b"
    if part is None:
        df = df.withColumn("_b", part_of(F.col(order[0]), bounds_of(df, order[0], buckets)))
    parts = df.groupBy(*group, own_part).agg(F.sum(value).alias("_n"), F.count(F.lit(1)).alias("_c"))
    whole = Window.partitionBy(*group)
    before = whole.orderBy(own_part).rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(*group, own_part, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(whole).alias(tot), F.sum("_c").over(whole).alias(deg))
    own = Window.partitionBy(*group, own_part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = df.withColumn("_run", F.sum(value).over(own)).join(parts, [*group, own_part])
    return out.withColumn(hi, F.col("_before") + F.col("_run")).drop(own_part, "_run", "_before")


@dataclass
class Graph:
    """edges: src, dst and payload columns; vertices: optional attributes keyed by v."""

    edges: DataFrame
    v_num: int | None = None
    attributes: DataFrame | None = None
    _kept: dict = field(default_factory=dict, repr=False)

    @classmethod
    def load(cls, spark: SparkSession, path: str, v_num: int, undirected: bool = False, fmt: str = "binary", weighted: bool = True, typed: bool = False) -> Graph:
        from wanderframe.sources import edges as io

        df = io.read_edges(spark, path, fmt, weighted, typed)
        return cls(symmetrise(df) if undirected else df, v_num).validated()

    @property
    def spark(self) -> SparkSession:
        return self.edges.sparkSession

    def undirected(self) -> Graph:
        return replace(self, edges=symmetrise(self.edges), _kept={})

    def valid(self) -> Column:
        ok = F.col("src").isNotNull() & F.col("dst").isNotNull() & (F.col("src") >= 0) & (F.col("dst") >= 0)
        return ok if self.v_num is None else ok & (F.col("src") < self.v_num) & (F.col("dst") < self.v_num)

    def validated(self) -> Graph:
        """Raises for endpoints outside the graph and negative weights; one scan."""
        bad = ~F.coalesce(self.valid(), F.lit(False))
        negative = F.coalesce(F.col("weight") < 0, F.lit(False)) if "weight" in self.edges.columns else F.lit(False)
        found = self.edges.agg(F.count_if(bad).alias("ends"), F.count_if(negative).alias("weights")).first()
        if found.ends or found.weights:
            raise GraphError(f"{found.ends} edges with an end outside the graph, {found.weights} with a negative weight")
        return self

    def vertices(self) -> DataFrame:
        if self.v_num is not None:
            return self.spark.range(self.v_num).select(F.col("id").alias("v"))
        return self.edges.select(F.explode(F.array("src", "dst")).alias("v")).distinct()

    def counts(self) -> DataFrame:
        return self.edges.agg(F.count(F.lit(1)).alias("e_num")).crossJoin(self.vertices().agg(F.count(F.lit(1)).alias("v_num")))

    def _degree(self, end: str, name: str) -> DataFrame:
        n = self.edges.groupBy(F.col(end).alias("v")).agg(F.count(F.lit(1)).alias(name))
        return self.vertices().join(n, "v", "left").select("v", F.coalesce(name, F.lit(0)).cast("long").alias(name))

    def out_degree(self) -> DataFrame:
        return self._degree("src", "out_degree")

    def in_degree(self) -> DataFrame:
        return self._degree("dst", "in_degree")

    def adjacency(self, *payload: str, segment: int = 4096) -> DataFrame:
        """(v, segment, neighbours): out-edges in order of dst, in lists of at most `segment` entries.

        A vertex with very many out-edges has many segments, so no list grows with the data.
        """
        one = self.edges.withColumn("_one", F.lit(1).cast("long"))
        ranked = running_sums(one, ["src"], ["dst", *payload], "_one").withColumn("segment", F.floor((F.col("hi") - 1) / segment).cast("int"))
        entry = F.struct(F.col("hi"), F.struct("dst", *payload).alias("e"))
        lists = ranked.groupBy(F.col("src").alias("v"), "segment").agg(F.array_sort(F.collect_list(entry)).alias("l"))
        return lists.select("v", "segment", F.transform("l", lambda x: x["e"]).alias("neighbours"))

    def type_masks(self, etype: str = "etype") -> DataFrame:
        """Bit k says that the vertex has an out-edge of type k; 63 types fit."""
        typed = self.edges.where(F.col(etype).between(0, 62))
        bit = F.expr(f"shiftleft(CAST(1 AS BIGINT), {etype})")
        return typed.groupBy(F.col("src").alias("v")).agg(F.bit_or(bit).alias("mask"))

    def tag_ranges(self, tag: str = "etype") -> DataFrame:
        """With adjacency in order of (tag, dst): first and last position of each tag at each vertex."""
        n = self.edges.groupBy(F.col("src").alias("v"), F.col(tag).alias("tag")).agg(F.count(F.lit(1)).alias("n"))
        w = Window.partitionBy("v").orderBy("tag").rowsBetween(Window.unboundedPreceding, 0)
        return n.withColumn("last", F.sum("n").over(w) - 1).select("v", "tag", (F.col("last") - F.col("n") + 1).alias("first"), "last")

    def map_vertices(self, **values: Column) -> DataFrame:
        """(v, values…) of every vertex; they may name v, out_degree, in_degree and the attributes (null where a vertex has none)."""
        rows = self.out_degree().join(self.in_degree(), "v")
        if self.attributes is not None:
            rows = rows.join(self.attributes, "v", "left")
        return rows.select("v", *[x.alias(name) for name, x in values.items()])

    def vertex_sum(self, value: Column, name: str = "total") -> DataFrame:
        """Maps every vertex, as map_vertices does, and adds up the results."""
        return self.map_vertices(**{name: value}).agg(F.sum(name).alias(name))

    def has_edges(self, pairs: DataFrame) -> DataFrame:
        """Adds `linked` to pairs (src, dst)."""
        known = self.edges.select("src", "dst").distinct().withColumn("_yes", F.lit(True))
        return pairs.join(known, ["src", "dst"], "left").withColumn("linked", F.col("_yes").isNotNull()).drop("_yes")

    def find_edges(self, pairs: DataFrame) -> DataFrame:
        """All edges, parallel ones included, between the given ends."""
        return pairs.select("src", "dst").distinct().join(self.edges, ["src", "dst"])

    def partition_plan(self, parts: int, alpha: int = 5) -> DataFrame:
        """Contiguous vertex ranges with alpha + out-degree as workload: (part, first_v, end_v, workload).

        A range is closed as soon as it reaches ceil(total / parts).  One window of prefix sums gives every vertex its
        place, and the table of places is kept in their order.  The cuts follow one another; each is found between two
        places, so its scan reads the row group that holds them.
        """
        load = self.out_degree().select("v", (F.col("out_degree") + alpha).alias("n"))
        sums = running_sums(load.withColumn("_all", F.lit(0)), ["_all"], ["v"], "n", buckets=256).select("v", "n", "hi", "tot")
        sums = kept(sums.repartitionByRange("hi").sortWithinPartitions("hi"))
        whole = sums.agg(F.max("tot").alias("tot"), F.max("n").alias("most")).first()
        total, most = whole.tot or 0, whole.most or 0
        target = -(-total // parts)
        at, begin, rows = 0, 0, []
        for p in range(parts):
            row = sums.where(F.col("hi").between(at + target, at + target + most)).agg(F.min("v"), F.min("hi")).first() if p < parts - 1 else (None, None)
            end, done = (row[0] + 1, row[1]) if row[0] is not None else (self.v_num, total)
            rows.append((p, begin, end, done - at))
            begin, at = end, done
        return self.spark.createDataFrame(rows, "part int, first_v long, end_v long, workload long")
