"""Queries of the walk engine over the given tables, and their oracles."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wanderframe.operators import analytics, apps, paths
from wanderframe.operators.graph import Graph
from wanderframe.plans import engine, static
from wanderframe.plans.oracles import walk_sql
from wanderframe.plans.spec import Component, Query, Transition, WalkConfig, WalkerConfig
from wanderframe.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
N = 25


def query(sql: str | None = None):  # noqa: ANN201
    def register(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


# ---------------------------------------------------------------- graphs


def nations(spark: SparkSession, d: str) -> Graph:
    """From the supplier's nation to the customer's; weight is the quantity sold."""
    line = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity")
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    supplier = table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").cast("long").alias("src"))
    customer = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").cast("long").alias("dst"))
    rows = line.join(orders, line.l_orderkey == orders.o_orderkey).join(customer, F.col("o_custkey") == F.col("c_custkey")).join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    edges = rows.groupBy("src", "dst").agg(F.sum("l_quantity").cast("double").alias("weight"))
    return Graph(edges, N)


NATIONS = """SELECT CAST(s_nationkey AS BIGINT) AS src, CAST(c_nationkey AS BIGINT) AS dst, CAST(sum(l_quantity) AS DOUBLE) AS weight
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
GROUP BY 1, 2"""


def busy(graph: Graph) -> Graph:
    """The nation edges of at least average weight, so that not every pair of nations is linked."""
    mean = graph.edges.agg((F.sum("weight") / F.count(F.lit(1))).alias("m"))
    return Graph(graph.edges.join(F.broadcast(mean), F.col("weight") >= F.col("m")).drop("m"), graph.v_num)


BUSY = f"SELECT src, dst, weight FROM ({NATIONS}) WHERE weight >= (SELECT sum(weight) / count(*) FROM ({NATIONS}))"


def loaded(spark: SparkSession, d: str) -> Graph:
    """The loaded edges that have both ends."""
    return Graph(table(spark, d, "edges").select("src", "dst", "weight", "etype").where("src IS NOT NULL AND dst IS NOT NULL"))


LOADED = "SELECT src, dst, weight, etype FROM edges WHERE src IS NOT NULL AND dst IS NOT NULL"


def heavy(spark: SparkSession, d: str) -> Graph:
    """Those with a weight to draw by."""
    g = loaded(spark, d)
    return Graph(g.edges.where("weight > 0"))


HEAVY = LOADED + " AND weight > 0"


def own_walkers(spark: SparkSession, d: str, app: str, *more: str) -> DataFrame:
    rows = table(spark, d, "walkers").where(F.col("app") == app)
    return rows.select(F.col("walker").alias("wid"), F.col("start_vertex").alias("start"), F.col("steps").alias("len"), *more)


def walkers_sql(app: str, more: str = "") -> str:
    return f"SELECT walker AS wid, start_vertex AS v, steps AS len{more} FROM walkers WHERE app = '{app}' AND start_vertex IS NOT NULL"


def equal(n: int) -> str:
    return f"SELECT range AS wid, range % {N} AS v FROM range({n})"


# ---------------------------------------------------------------- graph operators


@query(f"WITH e AS ({LOADED}), v AS (SELECT src AS v FROM e UNION SELECT dst FROM e) SELECT v, count(e.src) AS out_degree FROM v LEFT JOIN e ON e.src = v.v GROUP BY v")
def out_degree(spark: SparkSession, d: str) -> DataFrame:
    return loaded(spark, d).out_degree()


@query(f"WITH e AS ({LOADED}), v AS (SELECT src AS v FROM e UNION SELECT dst FROM e) SELECT v, count(e.dst) AS in_degree FROM v LEFT JOIN e ON e.dst = v.v GROUP BY v")
def in_degree(spark: SparkSession, d: str) -> DataFrame:
    return loaded(spark, d).in_degree()


@query(f"WITH e AS ({LOADED}) SELECT (SELECT count(*) FROM e) AS e_num, (SELECT count(*) FROM (SELECT src FROM e UNION SELECT dst FROM e)) AS v_num")
def graph_counts(spark: SparkSession, d: str) -> DataFrame:
    return loaded(spark, d).counts()


@query(f"WITH e AS ({LOADED}) SELECT src, dst, weight, etype FROM e UNION ALL SELECT dst, src, weight, etype FROM e")
def symmetrize(spark: SparkSession, d: str) -> DataFrame:
    return loaded(spark, d).undirected().edges


@query(f"SELECT dst AS src, src AS dst, weight, etype FROM ({LOADED})")
def transpose(spark: SparkSession, d: str) -> DataFrame:
    from wanderframe.operators.graph import transpose as turned

    return turned(loaded(spark, d).edges)


@query("SELECT count(*) AS valid_edges FROM edges WHERE src IS NOT NULL AND dst IS NOT NULL AND src < 1000000 AND dst < 1000000")
def valid_edges(spark: SparkSession, d: str) -> DataFrame:
    g = Graph(table(spark, d, "edges").select("src", "dst"), 1_000_000)
    return g.edges.where(g.valid()).agg(F.count(F.lit(1)).alias("valid_edges"))


@query(f"""WITH r AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY dst) - 1 AS k FROM ({LOADED}))
SELECT src AS v, CAST(k // 4096 AS INTEGER) AS segment, count(*) AS entries, min(dst) AS first_dst, max(dst) AS last_dst, sum(CAST(dst AS DOUBLE) * (k % 4096 + 1)) AS mix FROM r GROUP BY 1, 2""")
def adjacency(spark: SparkSession, d: str) -> DataFrame:
    """Sorted adjacency lists, reported by length, ends and a sum that depends on the order."""
    lists = loaded(spark, d).adjacency()
    mix = F.aggregate(F.transform("neighbours", lambda x, i: x["dst"].cast("double") * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return lists.select("v", "segment", F.size("neighbours").cast("long").alias("entries"), F.col("neighbours")[0]["dst"].alias("first_dst"), F.element_at("neighbours", -1)["dst"].alias("last_dst"), mix.alias("mix"))


@query(f"SELECT src AS v, bit_or(CAST(1 AS BIGINT) << etype) AS mask FROM ({LOADED}) WHERE etype IS NOT NULL GROUP BY src")
def edge_type_mask(spark: SparkSession, d: str) -> DataFrame:
    return loaded(spark, d).type_masks()


@query("SELECT scheme_id, pos, CAST(sum(CASE WHEN allowed THEN CAST(1 AS BIGINT) << etype ELSE 0 END) AS BIGINT) AS mask FROM schemes GROUP BY 1, 2")
def scheme_mask(spark: SparkSession, d: str) -> DataFrame:
    s = apps.Schemes.of(table(spark, d, "schemes"))
    rows = [(k, j, s.masks[s.offsets[k] + j]) for k, n in enumerate(s.lengths) for j in range(n)]
    return spark.createDataFrame(rows, "scheme_id int, pos int, mask long")


@query(f"""WITH n AS (SELECT src AS v, etype AS tag, count(*) AS n FROM ({LOADED}) WHERE etype IS NOT NULL GROUP BY 1, 2),
c AS (SELECT *, sum(n) OVER (PARTITION BY v ORDER BY tag ROWS UNBOUNDED PRECEDING) AS s FROM n)
SELECT v, tag, CAST(s - n AS BIGINT) AS first, CAST(s - 1 AS BIGINT) AS last FROM c""")
def tag_ranges(spark: SparkSession, d: str) -> DataFrame:
    g = loaded(spark, d)
    return Graph(g.edges.where("etype IS NOT NULL")).tag_ranges()


@query(f"WITH e AS ({NATIONS}), o AS (SELECT src AS v, count(*) AS o FROM e GROUP BY 1), i AS (SELECT dst AS v, count(*) AS i FROM e GROUP BY 1) SELECT CAST(sum(range * coalesce(o, 0) + coalesce(i, 0)) AS BIGINT) AS total FROM range({N}) LEFT JOIN o ON o.v = range LEFT JOIN i ON i.v = range")
def vertex_sum(spark: SparkSession, d: str) -> DataFrame:
    return nations(spark, d).vertex_sum(F.col("v") * F.col("out_degree") + F.col("in_degree"))


@query(f"WITH e AS ({LOADED}), p AS (SELECT DISTINCT dst AS src, src AS dst FROM e) SELECT p.src, p.dst, k.src IS NOT NULL AS linked FROM p LEFT JOIN (SELECT DISTINCT src, dst FROM e) k ON k.src = p.src AND k.dst = p.dst")
def neighbour_exists(spark: SparkSession, d: str) -> DataFrame:
    """Whether each edge has its way back."""
    g = loaded(spark, d)
    return g.has_edges(g.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")).distinct())


@query(f"WITH e AS ({LOADED}), p AS (SELECT DISTINCT vertex AS src, neighbour AS dst FROM adjunits) SELECT e.src, e.dst, count(*) AS edges FROM p JOIN e ON e.src = p.src AND e.dst = p.dst GROUP BY 1, 2")
def edge_lookup(spark: SparkSession, d: str) -> DataFrame:
    """The loaded edges behind the listed neighbours."""
    pairs = table(spark, d, "adjunits").select(F.col("vertex").alias("src"), F.col("neighbour").alias("dst"))
    return loaded(spark, d).find_edges(pairs).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("edges"))


@query(f"""WITH RECURSIVE l AS (SELECT range AS v, 5 + coalesce(o, 0) AS n FROM range({N}) LEFT JOIN (SELECT src, count(*) AS o FROM ({NATIONS}) GROUP BY 1) ON src = range),
c AS (SELECT v, n, sum(n) OVER (ORDER BY v) AS hi, sum(n) OVER () AS tot FROM l),
p AS (
  SELECT 0 AS part, CAST(0 AS BIGINT) AS first_v, (SELECT min(v) + 1 FROM c WHERE hi >= ceil(tot / 4.0)) AS end_v, (SELECT min(hi) FROM c WHERE hi >= ceil(tot / 4.0)) AS done, (SELECT min(hi) FROM c WHERE hi >= ceil(tot / 4.0)) AS workload
  UNION ALL
  SELECT part + 1, end_v, CASE WHEN part = 2 THEN {N} ELSE (SELECT min(v) + 1 FROM c WHERE hi >= done + ceil(tot / 4.0)) END,
         CASE WHEN part = 2 THEN (SELECT max(tot) FROM c) ELSE (SELECT min(hi) FROM c WHERE hi >= done + ceil(tot / 4.0)) END,
         CASE WHEN part = 2 THEN (SELECT max(tot) FROM c) ELSE (SELECT min(hi) FROM c WHERE hi >= done + ceil(tot / 4.0)) END - done
  FROM p WHERE part < 3)
SELECT part, first_v, CAST(end_v AS BIGINT) AS end_v, CAST(workload AS BIGINT) AS workload FROM p""")
def partition_plan(spark: SparkSession, d: str) -> DataFrame:
    return nations(spark, d).partition_plan(4)


CDF = """WITH e AS ({edges})
SELECT src, dst, CAST(sum(w) OVER (PARTITION BY src ORDER BY dst, weight, etype NULLS FIRST ROWS UNBOUNDED PRECEDING) AS BIGINT) - w AS lo,
       CAST(sum(w) OVER (PARTITION BY src ORDER BY dst, weight, etype NULLS FIRST ROWS UNBOUNDED PRECEDING) AS BIGINT) AS hi,
       CAST(sum(w) OVER (PARTITION BY src) AS BIGINT) AS tot FROM e"""


@query(CDF.format(edges=static.scaled_sql(HEAVY, "weight")))
def static_cdf(spark: SparkSession, d: str) -> DataFrame:
    return static.intervals(heavy(spark, d), "weight").select("src", "dst", "lo", "hi", "tot")


@query(f"SELECT src, dst, round(prob, 6) AS prob FROM (SELECT src, dst, sum(weight) / any_value(t) AS prob FROM (SELECT *, sum(weight) OVER (PARTITION BY src) AS t FROM ({NATIONS})) GROUP BY 1, 2)")
def alias_mass(spark: SparkSession, d: str) -> DataFrame:
    """The probabilities that the alias table stands for."""
    t = static.alias_table(nations(spark, d), "weight")
    ends = F.explode(F.array(F.struct(F.col("first").alias("dst"), F.col("p").alias("m")), F.struct(F.col("second").alias("dst"), (1 - F.col("p")).alias("m"))))
    n = t.groupBy("src").agg(F.count(F.lit(1)).alias("n"))
    mass = t.select("src", ends.alias("x")).select("src", "x.dst", "x.m").where("dst IS NOT NULL").groupBy("src", "dst").agg(F.sum("m").alias("m"))
    return mass.join(n, "src").select("src", "dst", F.round(F.col("m") / F.col("n"), 6).alias("prob"))


# ---------------------------------------------------------------- matrices


@query(f"WITH n AS (SELECT src, dst, sum(CAST(weight AS DECIMAL(20,6))) AS w FROM ({HEAVY}) GROUP BY 1, 2) SELECT src, dst, CAST(w AS DOUBLE) / CAST(sum(w) OVER (PARTITION BY src) AS DOUBLE) AS prob FROM n")
def static_transition(spark: SparkSession, d: str) -> DataFrame:
    return analytics.transition_matrix(heavy(spark, d).edges)


EXTREMES = f"SELECT src, dst, weight * CASE src % 3 WHEN 0 THEN 1e-8 WHEN 1 THEN 1e13 ELSE 1e300 END AS weight FROM ({HEAVY})"


def extremes(spark: SparkSession, d: str) -> Graph:
    """The edges with weights that are tiny, huge, or beyond the range of doubles in sum, by vertex."""
    factor = F.when(F.col("src") % 3 == 0, 1e-8).when(F.col("src") % 3 == 1, 1e13).otherwise(1e300)
    return Graph(heavy(spark, d).edges.select("src", "dst", (F.col("weight") * factor).alias("weight")))


#: To six places; the small addend keeps shares that lie between two places from going either way.
PLACES = 3.1e-8
OWN_SHARES = "SELECT src, dst, round(sum(weight / m) / any_value(t) + 3.1e-8, 6) AS prob FROM (SELECT *, sum(weight / m) OVER (PARTITION BY src) AS t FROM (SELECT *, max(weight) OVER (PARTITION BY src) AS m FROM ({edges}))) GROUP BY 1, 2"


@query(OWN_SHARES.format(edges=EXTREMES))
def extreme_transition(spark: SparkSession, d: str) -> DataFrame:
    """The exact matrix of extreme weights; the oracle divides doubles."""
    return analytics.transition_matrix(extremes(spark, d).edges).withColumn("prob", F.round(F.col("prob") + PLACES, 6))


@query(OWN_SHARES.format(edges=EXTREMES))
def extreme_intervals(spark: SparkSession, d: str) -> DataFrame:
    """The shares that the walks draw by, for extreme weights."""
    n = static.intervals(extremes(spark, d), "weight").groupBy("src", "dst").agg((F.sum("w") / F.max("tot")).alias("prob"))
    return n.withColumn("prob", F.round(F.col("prob") + PLACES, 6))


@query(f"""WITH n AS ({BUSY}), r AS (
  SELECT a.src AS prev, a.dst AS cur, b.dst, b.weight * CASE WHEN b.dst = a.src THEN 0.5 WHEN k.src IS NOT NULL THEN 1.0 ELSE 2.0 END AS m
  FROM n a JOIN n b ON b.src = a.dst LEFT JOIN n k ON k.src = a.src AND k.dst = b.dst)
SELECT prev, cur, dst, m / sum(m) OVER (PARTITION BY prev, cur) AS prob FROM r""")
def node2vec_transition(spark: SparkSession, d: str) -> DataFrame:
    return analytics.node2vec_matrix(busy(nations(spark, d)).edges, 2.0, 0.5)


def _typed_states(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, str]:
    g = heavy(spark, d)
    schemes = table(spark, d, "schemes")
    s = apps.Schemes.of(schemes)
    starts = own_walkers(spark, d, "metapath", F.col("scheme_id").cast("long").alias("scheme")).where("start IS NOT NULL")
    seeds = starts.select(F.col("start").alias("v"), "scheme", F.lit(0).cast("long").alias("step")).distinct()
    ok = f"etype IS NOT NULL AND (shiftright({s.mask_sql}, etype) & 1L) = 1"
    lens = "array(" + ", ".join(f"{n}L" for n in s.lengths) + ")"
    states = analytics.reachable_states(g.edges, seeds, ok, {"step": f"(step + 1) % element_at({lens}, CAST(scheme AS INT) + 1)"})
    return g.edges, states, ok


REACH = f"""WITH RECURSIVE e AS ({HEAVY}), n AS (SELECT scheme_id, max(pos) + 1 AS n FROM schemes GROUP BY 1),
t AS (SELECT DISTINCT src, dst, etype FROM e WHERE etype IS NOT NULL),
r(v, scheme, state) AS (
  SELECT start_vertex, CAST(scheme_id AS BIGINT), CAST(0 AS BIGINT) FROM walkers WHERE app = 'metapath' AND start_vertex IS NOT NULL
  UNION
  SELECT t.dst, r.scheme, (r.state + 1) % n.n FROM r JOIN n ON n.scheme_id = r.scheme JOIN schemes s ON s.scheme_id = r.scheme AND s.pos = r.state AND s.allowed
  JOIN t ON t.src = r.v AND t.etype = s.etype)"""


@query(REACH + " SELECT v, scheme, state FROM r")
def metapath_reachable(spark: SparkSession, d: str) -> DataFrame:
    return _typed_states(spark, d)[1].withColumnRenamed("step", "state")


@query(REACH + """, m AS (SELECT r.v, r.scheme, r.state, e.dst, sum(CAST(e.weight AS DECIMAL(20,6))) AS w FROM r JOIN schemes s ON s.scheme_id = r.scheme AND s.pos = r.state AND s.allowed
  JOIN e ON e.src = r.v AND e.etype = s.etype GROUP BY 1, 2, 3, 4)
SELECT v, scheme, state, dst, CAST(w AS DOUBLE) / CAST(sum(w) OVER (PARTITION BY v, scheme, state) AS DOUBLE) AS prob FROM m""")
def metapath_transition(spark: SparkSession, d: str) -> DataFrame:
    edges, states, ok = _typed_states(spark, d)
    m = analytics.typed_matrix(states, edges, ok, "weight")
    return m.select("v", "scheme", F.col("step").alias("state"), "dst", "prob")


TAGGED = f"SELECT src, dst, weight, CAST((src + 2 * dst) % 4 AS INTEGER) AS etype FROM ({BUSY})"


def tagged(spark: SparkSession, d: str) -> Graph:
    """Tags on edges and vertices, derived from the ids."""
    edges = busy(nations(spark, d)).edges.withColumn("etype", ((F.col("src") + 2 * F.col("dst")) % 4).cast("int"))
    return Graph(edges, N, spark.range(N).select(F.col("id").alias("v"), (F.col("id") % 4).alias("tag")))


@query(f"""WITH RECURSIVE e AS ({TAGGED}), r(v, tag, last_tag) AS (
  SELECT range, t, CAST(0 AS BIGINT) FROM range({N}), (SELECT range AS t FROM range(4))
  UNION SELECT e.dst, (r.tag + 1) % 4, r.v % 4 FROM r JOIN e ON e.src = r.v)
SELECT v, tag, last_tag FROM r""")
def tag_reachable(spark: SparkSession, d: str) -> DataFrame:
    g = tagged(spark, d)
    seeds = spark.range(N).select(F.col("id").alias("v"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))).alias("tag"), F.lit(0).cast("long").alias("last_tag"))
    return analytics.reachable_states(g.edges, seeds, "true", {"tag": "(tag + 1) % 4", "last_tag": "v % 4"})


@query(f"""WITH RECURSIVE e AS ({TAGGED}), r(v, tag, last_tag) AS (
  SELECT range, t, CAST(0 AS BIGINT) FROM range({N}), (SELECT range AS t FROM range(4))
  UNION SELECT e.dst, (r.tag + 1) % 4, r.v % 4 FROM r JOIN e ON e.src = r.v),
m AS (SELECT r.*, e.dst, sum(e.weight * (1 + (last_tag + tag + etype) % 4 + (r.v % 4) * 0.5)) AS m FROM r JOIN e ON e.src = r.v GROUP BY ALL)
SELECT v, tag, last_tag, dst, CAST(m AS DOUBLE) / CAST(sum(m) OVER (PARTITION BY v, tag, last_tag) AS DOUBLE) AS prob FROM m""")
def tag_transition(spark: SparkSession, d: str) -> DataFrame:
    """The exact matrix of the tag walk, one row for each state and neighbour."""
    g = tagged(spark, d)
    return analytics.typed_matrix(tag_reachable(spark, d), g.edges, "true", "weight", "1 + (last_tag + tag + etype) % 4 + (v % 4) * 0.5D")


@query(f"WITH e AS ({TAGGED}), o AS (SELECT src AS v, count(*) AS o FROM e GROUP BY 1) SELECT CAST(sum((range % 4) * coalesce(o, 0)) AS BIGINT) AS total FROM range({N}) LEFT JOIN o ON o.v = range")
def vertex_attribute_sum(spark: SparkSession, d: str) -> DataFrame:
    return tagged(spark, d).vertex_sum(F.col("tag") * F.col("out_degree"))


# ---------------------------------------------------------------- walks over the loaded edges

LEN = "CASE WHEN step < len THEN 1.0 ELSE 0.0 END"


@query(walk_sql(LOADED, walkers_sql("deepwalk"), LEN, payload="weight, etype"))
def deepwalk_unweighted(spark: SparkSession, d: str) -> DataFrame:
    return engine.random_walk(loaded(spark, d), WalkerConfig(table=own_walkers(spark, d, "deepwalk")), apps.deepwalk("len"))


@query(walk_sql(HEAVY, walkers_sql("deepwalk"), LEN, "weight", payload="weight, etype"))
def deepwalk_weighted(spark: SparkSession, d: str) -> DataFrame:
    return engine.random_walk(heavy(spark, d), WalkerConfig(table=own_walkers(spark, d, "deepwalk")), apps.deepwalk("len", True))


@query(walk_sql(HEAVY, walkers_sql("deepwalk"), LEN, "weight", payload="weight, etype"))
def deepwalk_supersteps(spark: SparkSession, d: str) -> DataFrame:
    return engine.random_walk(heavy(spark, d), WalkerConfig(table=own_walkers(spark, d, "deepwalk")), apps.deepwalk("len", True), WalkConfig(strategy="supersteps"))


@query(walk_sql(HEAVY, walkers_sql("ppr"), str(1 - 1 / 80), "weight", payload="weight, etype"))
def ppr_walk(spark: SparkSession, d: str) -> DataFrame:
    return engine.random_walk(heavy(spark, d), WalkerConfig(table=own_walkers(spark, d, "ppr")), apps.ppr(1 / 80, True))


N2V_FAR = "greatest(CAST(1.0 AS DOUBLE), 1.0 / CAST(q AS DOUBLE))"
N2V = {
    "dynamic": f"CASE WHEN prev < 0 THEN {N2V_FAR} WHEN dst = prev THEN 1.0 / CAST(p AS DOUBLE) WHEN linked THEN 1.0 ELSE 1.0 / CAST(q AS DOUBLE) END",
    "bound": N2V_FAR,
    "apart": ("dst", "prev", "1.0 / CAST(p AS DOUBLE)"),
    "init": {"prev": "CAST(-1 AS BIGINT)"},
    "update": {"prev": "v"},
    "second_order": True,
}


@query(walk_sql(HEAVY, walkers_sql("node2vec", ", param_p AS p, param_q AS q"), LEN, "weight", payload="weight, etype", **N2V))
def node2vec_walk(spark: SparkSession, d: str, strategy: str = "auto") -> DataFrame:
    """Second order, with each walker's own p and q."""
    state, spec = apps.node2vec("len", "p", "q")
    rows = own_walkers(spark, d, "node2vec", F.col("param_p").alias("p"), F.col("param_q").alias("q"))
    return engine.random_walk(heavy(spark, d), WalkerConfig(table=rows, **state), spec, WalkConfig(strategy=strategy))


@query(ORACLES["node2vec_walk"])
def node2vec_edges_supersteps(spark: SparkSession, d: str) -> DataFrame:
    """All walkers over all edges by rejection supersteps, the path of larger graphs."""
    return node2vec_walk(spark, d, "supersteps")


@query(walk_sql(LOADED, walkers_sql("node2vec", ", param_p AS p, param_q AS q"), LEN, payload="weight, etype", **N2V))
def node2vec_unweighted(spark: SparkSession, d: str) -> DataFrame:
    state, spec = apps.node2vec("len", "p", "q", weighted=False)
    rows = own_walkers(spark, d, "node2vec", F.col("param_p").alias("p"), F.col("param_q").alias("q"))
    return engine.random_walk(loaded(spark, d), WalkerConfig(table=rows, **state), spec)


def metapath_oracle(edges: str, weight: str | None) -> str:
    ctes = f"""lens AS (SELECT scheme_id, max(pos) + 1 AS n FROM schemes GROUP BY 1),
allowed AS (SELECT scheme_id, pos, sum(CASE WHEN allowed THEN CAST(1 AS BIGINT) << etype ELSE 0 END) AS m FROM schemes GROUP BY 1, 2),
masks AS (SELECT src, bit_or(CAST(1 AS BIGINT) << etype) AS types FROM ({edges}) WHERE etype IS NOT NULL GROUP BY 1),"""
    extra = "JOIN lens l ON l.scheme_id = d.scheme JOIN allowed g ON g.scheme_id = d.scheme AND g.pos = d.step % l.n LEFT JOIN masks k ON k.src = d.v"
    text = walk_sql(edges, walkers_sql("metapath", ", CAST(scheme_id AS BIGINT) AS scheme"), f"CASE WHEN step < len AND (coalesce(k.types, 0) & CAST(g.m AS BIGINT)) <> 0 THEN 1.0 ELSE 0.0 END", weight, dynamic="CASE WHEN etype IS NOT NULL AND ((gm >> etype) & 1) = 1 THEN 1.0 ELSE 0.0 END", ctes=ctes, extra=extra, payload="weight, etype")
    return text.replace("SELECT d.*, c.dst", "SELECT d.*, CAST(g.m AS BIGINT) AS gm, c.dst").replace("EXCLUDE (x, y1", "EXCLUDE (gm, x, y1")


@query(metapath_oracle(HEAVY, "weight"))
def metapath_walk(spark: SparkSession, d: str, strategy: str = "auto") -> DataFrame:
    g, state, spec = apps.metapath(heavy(spark, d), apps.Schemes.of(table(spark, d, "schemes")), "len", True, "scheme_id")
    rows = own_walkers(spark, d, "metapath", "scheme_id")
    return engine.random_walk(g, WalkerConfig(table=rows, **state), spec, WalkConfig(strategy=strategy))


@query(ORACLES["metapath_walk"])
def metapath_edges_supersteps(spark: SparkSession, d: str) -> DataFrame:
    """All walkers over all edges by rejection supersteps."""
    return metapath_walk(spark, d, "supersteps")


@query(metapath_oracle(LOADED, None))
def metapath_unweighted(spark: SparkSession, d: str) -> DataFrame:
    g, state, spec = apps.metapath(loaded(spark, d), apps.Schemes.of(table(spark, d, "schemes")), "len", False, "scheme_id")
    rows = own_walkers(spark, d, "metapath", "scheme_id")
    return engine.random_walk(g, WalkerConfig(table=rows, **state), spec)


# ---------------------------------------------------------------- walks over the nations


def to(length: int) -> str:
    return f"CASE WHEN step < {length} THEN 1.0 ELSE 0.0 END"


@query(walk_sql(NATIONS, equal(500), to(10), "weight"))
def biased_walk(spark: SparkSession, d: str) -> DataFrame:
    return engine.random_walk(nations(spark, d), WalkerConfig(500), apps.biased_walk(10, True))


@query(walk_sql(NATIONS, equal(500), to(10), "weight"))
def biased_walk_recursive(spark: SparkSession, d: str) -> DataFrame:
    return engine.random_walk(nations(spark, d), WalkerConfig(500), apps.biased_walk(10, True), WalkConfig(strategy="recursive"), levels=10)


@query(walk_sql(NATIONS, equal(500), "0.875"))
def simple_walk(spark: SparkSession, d: str) -> DataFrame:
    return engine.random_walk(nations(spark, d), WalkerConfig(500), apps.simple_walk())


DYNAMIC = {"dynamic": "CASE WHEN step > 0 AND dst = prev THEN 2.0 ELSE 1.0 END", "bound": "2.0", "init": {"prev": "CAST(-1 AS BIGINT)"}, "update": {"prev": "v"}}


@query(walk_sql(NATIONS, equal(34), to(10), "weight", **DYNAMIC))
def dynamic_walk(spark: SparkSession, d: str) -> DataFrame:
    state, spec = apps.dynamic_walk(10)
    return engine.random_walk(nations(spark, d), WalkerConfig(34, **state), spec)


@query(walk_sql(BUSY, equal(200).replace("AS v FROM", "AS v, 2.0 AS p, 0.5 AS q FROM"), to(4), "weight", **N2V))
def node2vec_supersteps(spark: SparkSession, d: str) -> DataFrame:
    state, spec = apps.node2vec(4, 2.0, 0.5)
    return engine.random_walk(busy(nations(spark, d)), WalkerConfig(200, **state), spec, WalkConfig(strategy="supersteps"))


def tag_oracle(dynamic: str, bound: str, apart: tuple[str, str, str] | None = None, edges: str = TAGGED, seeds: str = equal(200), length: str = to(6)) -> str:
    text = walk_sql(edges, seeds, length, "weight", dynamic, bound, {"prev": "CAST(-1 AS BIGINT)", "tag": "wid % 4", "last_tag": "CAST(0 AS BIGINT)"}, {"prev": "v", "tag": "(tag + 1) % 4", "last_tag": "v % 4"}, payload="weight, etype", apart=apart)
    return text


TAG_BOUND = ("CASE WHEN step = 0 THEN 4.0 ELSE CAST(1 + (last_tag + tag + etype) % 4 AS DOUBLE) + (v % 4) * CAST(0.5 AS DOUBLE) END", "4 + (v % 4) * CAST(0.5 AS DOUBLE)")


@query(tag_oracle(*TAG_BOUND))
def tag_walk_bound(spark: SparkSession, d: str) -> DataFrame:
    state, spec = apps.tag_walk(6, 0.5)
    return engine.random_walk(tagged(spark, d), WalkerConfig(200, **state), spec)


TAG_OUTLIER = ("CASE WHEN step = 0 THEN 4.0 ELSE CAST(1 + (last_tag + tag + etype) % 4 AS DOUBLE) * CASE WHEN tag = etype THEN 3.5 ELSE 1.0 END END", "4.0", ("etype", "CASE WHEN step > 0 THEN tag END", "14.0"))


@query(tag_oracle(*TAG_OUTLIER))
def tag_walk_outlier(spark: SparkSession, d: str) -> DataFrame:
    state, spec = apps.tag_walk(6, amplifier=3.5)
    return engine.random_walk(tagged(spark, d), WalkerConfig(200, **state), spec)


def hash_oracle(edges: str, seeds: str, length: str, payload: str = "") -> str:
    return walk_sql(edges, seeds, length, "weight", "CASE WHEN step = 0 THEN 3.0 ELSE CAST(1 + ((high % 3 + low % 3) % 3 + xor(prev, dst)) % 2 AS DOUBLE) END", "3.0",
        {"prev": "CAST(-1 AS BIGINT)", "low": "(wid * 10000007 + v) % 4294967296", "high": "(wid * 10000007 + v) // 4294967296 % 4294967296"},
        {"prev": "v", "low": "xor((low * 10000007 + wid) % 4294967296, dst)", "high": "(high * 10000007 + (low * 10000007 + wid) // 4294967296) % 4294967296"}, payload=payload)


@query(hash_oracle(NATIONS, equal(300), to(8)))
def hash_walk(spark: SparkSession, d: str) -> DataFrame:
    state, spec = apps.hash_walk(8)
    return engine.random_walk(nations(spark, d), WalkerConfig(300, **state), spec)


# second order: the last vertex is asked for what the first-order walks carry along; the oracles are those of first order


@query(ORACLES["tag_walk_bound"])
def tag_walk_bound_2nd(spark: SparkSession, d: str) -> DataFrame:
    state, spec = apps.tag_walk(6, 0.5, order=2)
    return engine.random_walk(tagged(spark, d), WalkerConfig(200, **state), spec)


@query(ORACLES["tag_walk_outlier"])
def tag_walk_outlier_2nd(spark: SparkSession, d: str) -> DataFrame:
    state, spec = apps.tag_walk(6, amplifier=3.5, order=2)
    return engine.random_walk(tagged(spark, d), WalkerConfig(200, **state), spec)


@query(ORACLES["hash_walk"])
def hash_walk_2nd(spark: SparkSession, d: str) -> DataFrame:
    state, spec = apps.hash_walk(8, order=2)
    return engine.random_walk(nations(spark, d), WalkerConfig(300, **state), spec)


# ---------------------------------------------------------------- supersteps over the loaded edges and walkers

SUPERSTEPS = WalkConfig(strategy="supersteps")


@query(ORACLES["ppr_walk"])
def ppr_supersteps(spark: SparkSession, d: str) -> DataFrame:
    return engine.random_walk(heavy(spark, d), WalkerConfig(table=own_walkers(spark, d, "ppr")), apps.ppr(1 / 80, True), SUPERSTEPS)


@query(walk_sql(HEAVY, walkers_sql("deepwalk"), LEN, "weight", payload="weight, etype", **DYNAMIC))
def dynamic_supersteps(spark: SparkSession, d: str) -> DataFrame:
    state, spec = apps.dynamic_walk("len")
    return engine.random_walk(heavy(spark, d), WalkerConfig(table=own_walkers(spark, d, "deepwalk"), **state), spec, SUPERSTEPS)


TYPED = HEAVY + " AND etype IS NOT NULL"


def with_tags(spark: SparkSession, d: str) -> Graph:
    """The loaded edges with a type, which is their tag; a vertex's tag follows from its id."""
    g = Graph(heavy(spark, d).edges.where("etype IS NOT NULL"))
    return Graph(g.edges, attributes=g.vertices().select("v", (F.col("v") % 4).alias("tag")))


def tag_supersteps(spark: SparkSession, d: str, **form: object) -> DataFrame:
    state, spec = apps.tag_walk("len", **form)
    return engine.random_walk(with_tags(spark, d), WalkerConfig(table=own_walkers(spark, d, "deepwalk"), **state), spec, SUPERSTEPS)


ON_TYPED = {"edges": TYPED, "seeds": walkers_sql("deepwalk"), "length": LEN}


@query(tag_oracle(*TAG_BOUND, **ON_TYPED))
def tag_bound_supersteps(spark: SparkSession, d: str) -> DataFrame:
    return tag_supersteps(spark, d, vertex_weight=0.5)


@query(ORACLES["tag_bound_supersteps"])
def tag_bound_2nd_supersteps(spark: SparkSession, d: str) -> DataFrame:
    return tag_supersteps(spark, d, vertex_weight=0.5, order=2)


@query(tag_oracle(*TAG_OUTLIER, **ON_TYPED))
def tag_outlier_supersteps(spark: SparkSession, d: str) -> DataFrame:
    return tag_supersteps(spark, d, amplifier=3.5)


@query(ORACLES["tag_outlier_supersteps"])
def tag_outlier_2nd_supersteps(spark: SparkSession, d: str) -> DataFrame:
    return tag_supersteps(spark, d, amplifier=3.5, order=2)


@query(hash_oracle(HEAVY, walkers_sql("deepwalk"), LEN, "weight, etype"))
def hash_supersteps(spark: SparkSession, d: str) -> DataFrame:
    state, spec = apps.hash_walk("len")
    return engine.random_walk(heavy(spark, d), WalkerConfig(table=own_walkers(spark, d, "deepwalk"), **state), spec, SUPERSTEPS)


def reply_oracle() -> str:
    text = walk_sql(TYPED, walkers_sql("deepwalk"), LEN, "weight", "1.0 + least(re_n, 3)", "4.0", {"prev": "CAST(-1 AS BIGINT)"}, {"prev": "v"}, payload="weight, etype",
                    ctes=f"counts AS (SELECT src, etype, count(*) AS n FROM ({TYPED}) GROUP BY 1, 2),", extra="LEFT JOIN counts n ON n.src = d.prev AND n.etype = c.etype AND d.step > 0")
    return text.replace("SELECT d.*, c.dst", "SELECT d.*, coalesce(n.n, 0) AS re_n, c.dst").replace("EXCLUDE (x, y1", "EXCLUDE (re_n, x, y1")


@query(reply_oracle())
def reply_walk(spark: SparkSession, d: str, strategy: str = "auto") -> DataFrame:
    """Asks the last vertex how many out-edges of the candidate's type it has: an answer from a table with a key."""
    g = Graph(heavy(spark, d).edges.where("etype IS NOT NULL"))
    counts = g.edges.groupBy(F.col("src").alias("v"), F.col("etype").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    query = Query(Component("prev", lambda **k: k["prev"]), Component("step > 0", lambda **k: k["step"] > 0), counts, Component("etype", lambda **k: k["etype"]))
    more = Component("1.0D + least(coalesce(re_n, 0), 3)", lambda **k: 1.0 + np.minimum(np.nan_to_num(k["re_n"].astype(float)), 3))
    spec = Transition(apps.up_to("len"), "weight", more, 4.0, 1.0, query=query)
    return engine.random_walk(g, WalkerConfig(table=own_walkers(spark, d, "deepwalk"), **apps.previous()), spec, WalkConfig(strategy=strategy))


@query(ORACLES["reply_walk"])
def reply_supersteps(spark: SparkSession, d: str) -> DataFrame:
    return reply_walk(spark, d, "supersteps")


@query(f"SELECT range AS wid, range % {N} AS v FROM range(1000)")
def start_equal(spark: SparkSession, d: str) -> DataFrame:
    return engine.seeds(spark, nations(spark, d), WalkerConfig(1000)).select("wid", "v")


@query(walk_sql(NATIONS, "SELECT range AS wid, CAST(0 AS BIGINT) AS v FROM range(1000)", "0.0", finish=f"SELECT wid, u_start % {N} AS v FROM start_rows"))
def start_uniform(spark: SparkSession, d: str) -> DataFrame:
    return engine.seeds(spark, nations(spark, d), WalkerConfig(1000, starts="uniform")).select("wid", "v")


@query(walk_sql(NATIONS, "SELECT range AS wid, CAST(([3, 7, 11])[range % 3 + 1] AS BIGINT) AS v FROM range(300)", "0.9", "weight"))
def ppr_start_list(spark: SparkSession, d: str) -> DataFrame:
    return engine.random_walk(nations(spark, d), WalkerConfig(300, starts=[3, 7, 11]), apps.ppr(0.1, True))


@query(walk_sql(NATIONS, equal(100), to(5), "weight"))
def epoch_equivalence(spark: SparkSession, d: str) -> DataFrame:
    """In four epochs; the walks are those of one."""
    return engine.random_walk(nations(spark, d), WalkerConfig(100), apps.deepwalk(5, True), WalkConfig(rate=0.3))


@query(ORACLES["ppr_walk"])
def epochs_of_a_table(spark: SparkSession, d: str) -> DataFrame:
    """The walkers of a table in four epochs."""
    return engine.random_walk(heavy(spark, d), WalkerConfig(table=own_walkers(spark, d, "ppr")), apps.ppr(1 / 80, True), WalkConfig(rate=0.3))


# ---------------------------------------------------------------- what walks give

FOUND = walk_sql(NATIONS, equal(500), to(10), "weight", finish="")
WALKED = FOUND.rstrip().removesuffix("SELECT wid, step, v FROM walk WHERE a = 0") + ", t AS (SELECT wid, step, v FROM walk)\n"


@query(WALKED + "SELECT wid, ' ' || string_agg(v, ' ' ORDER BY step) AS line FROM t GROUP BY wid")
def walk_paths(spark: SparkSession, d: str) -> DataFrame:
    return paths.path_lines(biased_walk(spark, d))


@query(WALKED + "SELECT wid, wid || ' ' || count(*) || ' ' || string_agg(v, ' ' ORDER BY step) AS line FROM t GROUP BY wid")
def walk_paths_headed(spark: SparkSession, d: str) -> DataFrame:
    return paths.path_lines(biased_walk(spark, d), with_head=True)


@query("SELECT walker AS wid, list(vertex ORDER BY step, vertex) AS path FROM (SELECT DISTINCT walker, step, vertex FROM footprints WHERE walker IS NOT NULL AND vertex IS NOT NULL) GROUP BY walker")
def logged_paths(spark: SparkSession, d: str) -> DataFrame:
    """Assembles the logged footprints to paths."""
    visits = table(spark, d, "footprints").where("walker IS NOT NULL AND vertex IS NOT NULL").select(F.col("walker").alias("wid"), "step", F.col("vertex").alias("v")).distinct()
    return paths.to_paths(visits).select("wid", "path")


@query(WALKED + f"SELECT count(*) AS moves, count(*) FILTER (WHERE e.src IS NULL) AS illegal FROM t a JOIN t b ON b.wid = a.wid AND b.step = a.step + 1 LEFT JOIN (SELECT DISTINCT src, dst FROM ({NATIONS})) e ON e.src = a.v AND e.dst = b.v")
def walk_legality(spark: SparkSession, d: str) -> DataFrame:
    w = biased_walk(spark, d)
    moves, bad = analytics.hops(w).agg(F.count(F.lit(1)).alias("moves")), analytics.illegal_hops(w, nations(spark, d)).agg(F.count(F.lit(1)).alias("illegal"))
    return moves.crossJoin(bad)


@query(WALKED + "SELECT src, dst, n, n / sum(n) OVER (PARTITION BY src) AS prob FROM (SELECT a.v AS src, b.v AS dst, count(*) AS n FROM t a JOIN t b ON b.wid = a.wid AND b.step = a.step + 1 GROUP BY 1, 2)")
def empirical_transition(spark: SparkSession, d: str) -> DataFrame:
    return analytics.empirical_matrix(biased_walk(spark, d))


@query(WALKED + "SELECT prev, cur, dst, n, n / sum(n) OVER (PARTITION BY prev, cur) AS prob FROM (SELECT a.v AS prev, b.v AS cur, c.v AS dst, count(*) AS n FROM t a JOIN t b ON b.wid = a.wid AND b.step = a.step + 1 JOIN t c ON c.wid = a.wid AND c.step = a.step + 2 GROUP BY 1, 2, 3)")
def empirical_second_order(spark: SparkSession, d: str) -> DataFrame:
    return analytics.empirical_second_order(biased_walk(spark, d))


@query(WALKED + f"""SELECT count(*) AS entries, count(*) FILTER (WHERE s.p IS NULL) AS only_exact, count(*) FILTER (WHERE x.p IS NULL) AS only_seen,
round(sum((coalesce(x.p, 0) - coalesce(s.p, 0)) ** 2), 6) AS sum_sq
FROM (SELECT src, dst, weight / sum(weight) OVER (PARTITION BY src) AS p FROM ({NATIONS})) x
FULL JOIN (SELECT src, dst, n / sum(n) OVER (PARTITION BY src) AS p FROM (SELECT a.v AS src, b.v AS dst, count(*) AS n FROM t a JOIN t b ON b.wid = a.wid AND b.step = a.step + 1 GROUP BY 1, 2)) s ON s.src = x.src AND s.dst = x.dst""")
def matrix_compare(spark: SparkSession, d: str) -> DataFrame:
    g = nations(spark, d)
    return analytics.compare_matrices(analytics.transition_matrix(g.edges), analytics.empirical_matrix(biased_walk(spark, d)), ["src", "dst"]).withColumn("sum_sq", F.round("sum_sq", 6))


@query("SELECT vertex AS v, count(*) AS visits, count(DISTINCT walker) AS walkers FROM footprints WHERE walker IS NOT NULL AND vertex IS NOT NULL GROUP BY 1")
def visit_frequency(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "footprints").where("walker IS NOT NULL AND vertex IS NOT NULL")
    return analytics.visit_counts(rows.select(F.col("walker").alias("wid"), F.col("vertex").alias("v")))


@query(walk_sql(NATIONS, "SELECT range AS wid, CAST(([3, 7, 11])[range % 3 + 1] AS BIGINT) AS v FROM range(300)", "0.9", "weight", finish=", t AS (SELECT wid, arg_max(v, step) AS v FROM walk WHERE a = 0 GROUP BY 1) SELECT v, count(*) AS n, count(*) / 300 AS score FROM t GROUP BY 1"))
def ppr_scores(spark: SparkSession, d: str) -> DataFrame:
    return analytics.ppr_scores(ppr_start_list(spark, d))
