"""Runs a walk by one of three strategies that give the same rows.

supersteps   The walkers' table meets the cell table in joins on (vertex, cell).
             Several moves form one job; what a job found is written to the
             shared folder, which is both the walk's output and the point where
             lineage ends, so a lost executor costs one job's tasks at most.
tasks        A graph of checked size goes to all executors as arrays, and every
             task walks its walkers to their end in NumPy.
recursive    One recursive SQL query, for short walks without a dynamic component.

Edges with a dynamic component are drawn by rejection: a candidate from the
static cells is accepted with probability dynamic / upper.  A move then costs
a few joins for a hub as for any vertex, where weighing all edges of the
current vertices would cost the sum of their degrees.  What outlier edges have
above the bound of all others is an area of its own, with cells of its own.
"""

from __future__ import annotations

import copy
import math
import uuid
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wanderframe.functions import rng
from wanderframe.operators.analytics import union_of
from wanderframe.operators.graph import Graph, running_sums
from wanderframe.plans import static as st
from wanderframe.plans.spec import Query, Transition, WalkConfig, WalkerConfig
from wanderframe.session import kept, removed, shared_dir, short_plan_texts

#: Edges up to which a graph may be sent to all executors, and bytes of all that is sent.
MOST_SENT_EDGES = 4_000_000
MOST_SENT_BYTES = 256 << 20
#: Moves of a static walk in one job.
MOVES = 6
#: Candidates of a dynamic walk that one job tries for each walker, and how many for one that waits after `a` of them.
TRIES = 4
TRIED = f"greatest(a, {TRIES})"
#: The key of cells that hold all edges of a vertex.
ALL = -(1 << 62)
#: Rejections after which a walker's vertex is searched for any edge that can be taken.
PATIENCE = 64
#: The recursive strategy stays below Spark's own limit on recursion depth.
MOST_LEVELS = 90
INNER = ("wid", "h", "step", "v", "tot", "deg", "a")
#: Names that columns of edges can't have in a walk, besides those with _, to_, at_ or re_ in front.
RESERVED = {*INNER, "w", "lo", "hi", "cell", "key", "linked"}


class BoundError(ValueError):
    """A dynamic component left the bounds that the walk declares."""


def placed(df: DataFrame, *keys: str) -> DataFrame:
    """Cached in partitions by the keys and in their order, as joins on them want it.

    The cache is filled at once: only then is its plan final, and joins rely on its partitions.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    df = df.repartition(n, *keys).sortWithinPartitions(*keys).persist()
    df.count()
    return df


class Prepared:
    """What depends on the graph and the static component only, so that several walks can share it.

    Each table is made when a strategy first needs it and written to the shared folder.  Plans that join it
    many times then hold a scan instead of its whole history, and what an executor loses is read again.
    """

    def __init__(self, graph: Graph, static: str | None, dynamic: bool) -> None:
        self.graph = graph
        self.queries: dict[int, tuple[Query, DataFrame]] = {}  # holds the query, so that its id stays its own
        self.placed: dict[str, DataFrame] = {}
        self.attributes = [c for c in graph.attributes.columns if c != "v"] if graph.attributes is not None else []
        self.payload = [c for c in graph.edges.columns if c not in ("src", "dst")]
        if clash := [c for c in self.payload if c.lower() in RESERVED or c.lower().startswith(("_", "to_", "at_", "re_"))]:
            raise ValueError(f"columns of edges with names that a walk needs: {clash}")
        self.cdf = kept(st.intervals(graph, static, uniform_if_zero=not dynamic))
        self.n_edges = self.cdf.count()
        self.sent: dict = {}
        self.views: dict[str, str] = {}

    @cached_property
    def vertices(self) -> DataFrame:
        """(v, tot, deg, at_…) of every vertex with out-edges or attributes."""
        totals = st.vertex_totals(self.cdf)
        if self.attributes:
            named = self.graph.attributes.select("v", *[F.col(c).alias(f"at_{c}") for c in self.attributes])
            totals = totals.join(named, "v", "full")
        return kept(totals.select("v", F.coalesce("tot", F.lit(0)).alias("tot"), F.coalesce("deg", F.lit(0)).alias("deg"), *[f"at_{c}" for c in self.attributes]))

    @cached_property
    def cells(self) -> DataFrame:
        """Stays partitioned and sorted by (src, cell), so that in a superstep only the walkers move and are sorted."""
        return placed(kept(st.cells(self.cdf, self.vertices)), "src", "cell")

    @cached_property
    def pairs(self) -> DataFrame:
        return placed(kept(self.cdf.select(F.col("src").alias("prev"), "dst").distinct()), "prev", "dst")

    def outliers(self, edge: str) -> tuple[str, str]:
        """Views of (src, key, tot, deg) of the edges whose expression `edge` is key, and of the cells with theirs.

        The second holds the cells of all edges, with the key ALL, and those of each group: one join draws from either.
        """
        names = f"groups of {edge}", f"cells of {edge}"
        if names[0] not in self.placed:
            rows = self.cdf.withColumn("key", F.expr(edge).cast("long")).where("key IS NOT NULL").drop("lo", "hi", "tot", "deg")
            rows = running_sums(rows, ["src", "key"], ["dst", *self.payload], "w").withColumn("lo", F.col("hi") - F.col("w"))
            rows = kept(rows)
            groups = rows.groupBy("src", "key").agg(F.max("tot").alias("tot"), F.max("deg").alias("deg"))
            whole = st.cells(self.cdf, self.vertices).withColumn("key", F.lit(ALL))
            self.placed[names[0]] = placed(kept(groups), "src", "key")
            self.placed[names[1]] = placed(kept(whole.unionByName(st.cells(rows, self.vertices))), "src", "key", "cell")
            for name in names:
                self.views[name] = f"table_{uuid.uuid4().hex[:12]}"
                self.placed[name].createOrReplaceTempView(self.views[name])
        return self.views[names[0]], self.views[names[1]]

    def answers(self, query: Query) -> DataFrame:
        """(v, [key,] re_…) of all that may be asked."""
        if id(query) not in self.queries:
            if query.table is None:
                own = self.vertices.select("v", F.col("v").alias("re_v"), F.col("tot").alias("re_tot"), F.col("deg").alias("re_deg"), *[F.col(f"at_{a}").alias(f"re_{a}") for a in self.attributes])
            else:
                names = ["v", *["key"] * (query.key is not None)]
                own = query.table.select(*names, *[F.col(c).alias(f"re_{c}") for c in query.table.columns if c not in names])
            self.queries[id(query)] = query, kept(own)
        return self.queries[id(query)][1]

    def sent_bytes(self, spec: Transition) -> int:
        """About what the arrays of `send` take, from the numbers of rows."""
        n = self.n_edges * 8 * (4 + len(self.payload))
        if spec.second_order:
            n += self.n_edges * 16
        if spec.outlier_key is not None:
            n += self.n_edges * 8 * (4 + len(self.payload))
        if self.attributes:
            n += self.vertices.count() * 8 * (1 + 4 * len(self.attributes))
        if spec.query is not None:
            own = self.answers(spec.query)
            n += own.count() * 16 * len(own.columns)
        return n

    def view(self, name: str) -> str:
        """Name of a view of one of the tables.  It stays until release: dropping a view would drop the cached data too."""
        if name not in self.views:
            self.views[name] = f"{name}_{uuid.uuid4().hex[:12]}"
            getattr(self, name).createOrReplaceTempView(self.views[name])
        return self.views[name]

    def release(self) -> None:
        for v in self.views.values():
            self.graph.spark.catalog.dropTempView(v)
        self.views.clear()
        for df in self.placed.values():
            df.unpersist()
        self.placed.clear()
        for name in ("cells", "pairs"):
            if name in self.__dict__:
                self.__dict__.pop(name).unpersist()
        for b in self.sent.values():
            b.unpersist()
        self.sent.clear()
        self.queries.clear()


def prepare(graph: Graph, static: str | None, dynamic: bool) -> Prepared:
    return Prepared(graph, static, dynamic)


#: Walkers of one epoch: ids from lo on and below hi, or of a table the part k of n.
Epoch = tuple[int, int] | None


def seeds(spark: SparkSession, graph: Graph, walkers: WalkerConfig, epoch: Epoch = None) -> DataFrame:
    """(wid, h, step 0, v, state…, columns of the start row); walkers without a start vertex don't exist."""
    if walkers.table is not None:
        df = walkers.table.withColumnRenamed("start", "v").where("wid IS NOT NULL AND v IS NOT NULL").withColumn("wid", F.col("wid").cast("long"))
        if epoch is not None:
            df = df.where(F.pmod(F.xxhash64("wid"), F.lit(epoch[1])) == epoch[0])
    else:
        df = spark.range(*(epoch or (0, walkers.num))).select(F.col("id").alias("wid"))
    df = rng.with_walker_hash(df)
    df = df.withColumn("step", F.lit(0).cast("long"))
    if walkers.table is None:
        if isinstance(walkers.starts, list):
            starts = F.array(*[F.lit(int(x)) for x in walkers.starts]) if len(walkers.starts) <= 1000 else None
            if starts is None:
                table = spark.createDataFrame(list(enumerate(walkers.starts)), "_i long, v long")
                df = df.withColumn("_i", F.col("wid") % len(walkers.starts)).join(table, "_i").drop("_i")
            else:
                df = df.withColumn("v", F.element_at(starts, (F.col("wid") % len(walkers.starts) + 1).cast("int")).cast("long"))
        elif graph.v_num is None:
            raise ValueError("equal and uniform starts need v_num")
        elif walkers.starts == "equal":
            df = df.withColumn("v", F.col("wid") % graph.v_num)
        else:
            df = rng.with_draws(df, {"_u": rng.START}, step=F.lit(0)).withColumn("v", F.col("_u") % graph.v_num).drop("_u")
    if "scheme" in walkers.init and walkers.init["scheme"].sql.startswith("RANDOM "):
        raise ValueError("draw random state from the column u_scheme")
    df = rng.with_draws(df, {"u_scheme": rng.SCHEME}, step=F.lit(0))
    for name, c in walkers.init.items():
        df = df.withColumn(name, F.expr(c.sql))
    return df.drop("u_scheme")


def edge_salts(attempt: str) -> dict[str, str]:
    return {"_r1": f"({attempt}) * {rng.PER_ATTEMPT} + {rng.EDGE}", "_r2": f"({attempt}) * {rng.PER_ATTEMPT} + {rng.EDGE + 1}"}


def with_cell(inner: str, can: str) -> str:
    """Adds the place _r in the vertex's total that two draws give (below P^2, so large totals are drawn evenly) and its cell.

    Rows that can't move get a cell of their own, or they would all meet in one partition.
    """
    place = f"SELECT * EXCEPT (_r1, _r2), CASE WHEN {can} THEN (_r1 * {rng.P} + _r2) % greatest(tot, 1) END AS _r FROM ({inner})"
    return f"SELECT *, CASE WHEN {can} THEN CAST(floor(CAST(_r AS DOUBLE) * (CAST(deg AS DOUBLE) / CAST(tot AS DOUBLE))) AS BIGINT) ELSE -1 - h END AS _cell FROM ({place})"


def with_edge(inner: str, how: str) -> str:
    """Joins the edge of each row's cell: dst, payload, to_…"""
    return f"SELECT w.* EXCEPT (_r, _cell), c.* EXCEPT (src, cell, lo, hi) FROM ({inner}) w {how} JOIN {{cells}} c ON w.v = c.src AND w._cell = c.cell AND w._r >= c.lo AND w._r < c.hi"


class Supersteps:
    def __init__(self, spark: SparkSession, graph: Graph, ready: Prepared, walkers: WalkerConfig, spec: Transition, config: WalkConfig) -> None:
        self.spark, self.graph, self.ready, self.walkers, self.spec, self.config = spark, graph, ready, walkers, spec, config
        self.root = f"{shared_dir(spark)}/walk-{uuid.uuid4().hex}"
        self.parts, self.most_tries = 0, 0

    def keep(self, df: DataFrame) -> DataFrame:
        """Like kept, with the walk's parts side by side."""
        path = f"{self.root}/{self.parts:06d}"
        self.parts += 1
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def start(self, epoch: Epoch) -> DataFrame:
        own = seeds(self.spark, self.graph, self.walkers, epoch)
        df = own.join(self.ready.vertices, "v", "left")
        df = df.withColumns({"tot": F.coalesce("tot", F.lit(0)), "deg": F.coalesce("deg", F.lit(0)), "a": F.lit(0).cast("long")})
        self.carried = [*INNER, *[c for c in own.columns if c not in INNER], *[f"at_{a}" for a in self.ready.attributes]]
        return df.select(*self.carried)

    def run(self, epoch: Epoch = None) -> DataFrame:
        """(wid, step, v) of the walkers of one epoch."""
        with short_plan_texts(self.spark):
            return self.walked(epoch)

    def walked(self, epoch: Epoch) -> DataFrame:
        first = self.keep(self.start(epoch))
        visits = [first.select("wid", "step", "v")]
        step = self.static_job if self.spec.dynamic is None else self.dynamic_job
        state = first
        for _ in range(self.config.max_steps):
            state, found = step(state)
            visits.append(found)
            left = state.agg(F.count(F.lit(1)).alias("n"), F.max("a").alias("a")).first()
            self.most_tries = left.a or 0
            if not left.n:
                return union_of(visits)
        raise RuntimeError(f"walkers are left after {self.config.max_steps} jobs")

    def sql(self, text: str, state: DataFrame) -> DataFrame:
        for name in ("cells", "pairs", "cdf", "vertices"):
            if f"{{{name}}}" in text:
                text = text.replace(f"{{{name}}}", self.ready.view(name))
        return self.spark.sql(text, state=state)

    @property
    def extends(self) -> str:
        """Whether the walker takes another step, by its draw _x; one draw for each step."""
        return f"coalesce(_x < CAST({self.spec.extend.sql} AS DOUBLE) * {rng.P}, false)"

    def moved(self, inner: str, took: str, *more: str) -> str:
        """The walkers behind their move: step, state and vertex are those of dst where `took`."""
        place = {"v": "dst", "tot": "to_tot", "deg": "to_deg"} | {f"at_{a}": f"to_{a}" for a in self.ready.attributes} | {k: c.sql for k, c in self.walkers.update.items()}
        columns = [f"CASE WHEN {took} THEN {place[c]} ELSE {c} END AS {c}" if c in place else f"`{c}`" for c in self.carried]
        return f"SELECT {', '.join([*columns, *more])} FROM (SELECT * EXCEPT (step), CASE WHEN {took} THEN step + 1 ELSE step END AS step FROM ({inner}))"

    def static_plan(self, state: DataFrame) -> DataFrame:
        """MOVES moves; rows carry the vertices they found since the job began."""
        df = state.selectExpr("*", "CAST(array() AS ARRAY<BIGINT>) AS hops", "true AS on_way")
        text = rng.sql_draws("SELECT * FROM {state}", {"_x": str(rng.EXTEND)} | edge_salts("0"), drop="EXCEPT")
        text = f"SELECT * EXCEPT (_x, on_way), on_way AND tot > 0 AND {self.extends} AS on_way FROM ({text})"
        text = with_edge(with_cell(text, "on_way"), "LEFT")
        text = self.moved(text, "dst IS NOT NULL", "CASE WHEN dst IS NOT NULL THEN concat(hops, array(dst)) ELSE hops END AS hops", "dst IS NOT NULL AS on_way")
        for _ in range(MOVES):  # one statement for each move, so that the analyzer never meets a deep tree
            df = self.sql(text, df)
        return df

    def static_job(self, state: DataFrame) -> tuple[DataFrame, DataFrame]:
        done = self.keep(self.static_plan(state))
        found = done.selectExpr("wid", "step - size(hops) AS base", "posexplode(hops) AS (i, v)").selectExpr("wid", "base + i + 1 AS step", "v")
        return done.where("on_way").drop("hops", "on_way"), found

    def candidates(self, going: str) -> str:
        """Candidate edges for every walker, with their dart _dart, _over (what acceptance takes off the dynamic component) and _sure.

        The dart falls below the regular bound over all edges, or below what the outliers have above it.
        """
        spec = self.spec
        salts = edge_salts("_t") | {"_y": f"_t * {rng.PER_ATTEMPT} + {rng.DART}"}
        sure = "false"
        if spec.lower is not None and not self.config.check_bounds:
            sure = f"coalesce(_y * _ub < CAST({spec.lower.sql} AS DOUBLE) * {rng.P}, false)"
        bound = f"CAST({spec.bound.sql} AS DOUBLE) AS _ub"
        attempts = f"explode(sequence(a, a + {TRIED} - 1)) AS _t"
        if spec.outlier_key is None:
            text = rng.sql_draws(f"SELECT *, {attempts} FROM ({going})", salts, drop="EXCEPT")
            text = with_edge(with_cell(text, "true"), "INNER")
            return f"SELECT *, {sure} AS _sure FROM (SELECT *, _y * _ub AS _dart, 0.0D AS _over FROM (SELECT *, {bound} FROM ({text})))"
        groups, cells = self.ready.outliers(spec.outlier_key[0])
        # walkers without outliers get keys of their own, or they would all meet in one partition
        key = f"coalesce(CAST({spec.outlier_key[1].sql} AS BIGINT), {ALL} + 1 + h)"
        text = f"SELECT w.*, coalesce(o.tot, 0) AS _otot, coalesce(o.deg, 0) AS _odeg FROM (SELECT *, {key} AS _key FROM ({going})) w LEFT JOIN {groups} o ON w.v = o.src AND w._key = o.key"
        text = f"SELECT *, {bound}, CAST({spec.outlier_upper.sql} AS DOUBLE) AS _high FROM ({text})"
        text = f"SELECT * EXCEPT (_high), greatest(coalesce(_high, 0.0D) - _ub, 0.0D) AS _rise, {attempts} FROM ({text})"
        text = rng.sql_draws(text, salts | {"_u": f"_t * {rng.PER_ATTEMPT} + {rng.REGION}"}, drop="EXCEPT")
        text = f"SELECT * EXCEPT (_u), {in_rise('_u', 'tot', '_ub', '_otot', '_rise')} AS _apart FROM ({text})"
        total, entries = "CASE WHEN _apart THEN _otot ELSE tot END", "CASE WHEN _apart THEN _odeg ELSE deg END"
        text = f"SELECT * EXCEPT (_r1, _r2, _key), CASE WHEN _apart THEN _key ELSE {ALL} END AS _key, (_r1 * {rng.P} + _r2) % ({total}) AS _r FROM ({text})"
        text = f"SELECT *, CAST(floor(CAST(_r AS DOUBLE) * (CAST({entries} AS DOUBLE) / CAST({total} AS DOUBLE))) AS BIGINT) AS _cell FROM ({text})"
        text = f"SELECT w.* EXCEPT (_r, _cell, _key), c.* EXCEPT (src, key, cell, lo, hi) FROM ({text}) w JOIN {cells} c ON w.v = c.src AND w._key = c.key AND w._cell = c.cell AND w._r >= c.lo AND w._r < c.hi"
        text = f"SELECT *, _y * (CASE WHEN _apart THEN _rise ELSE _ub END) AS _dart, CASE WHEN _apart THEN _ub ELSE 0.0D END AS _over FROM ({text})"
        return f"SELECT *, NOT _apart AND {sure} AS _sure FROM ({text})"

    def dynamic_job(self, state: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Some candidates for every walker; the first accepted one is its move.  Who waits tries twice as many in each job."""
        spec, ready = self.spec, self.ready
        going = rng.sql_draws("SELECT * FROM {state}", {"_x": str(rng.EXTEND)}, drop="EXCEPT")
        going = self.without_stuck(f"SELECT * EXCEPT (_x) FROM ({going}) WHERE tot > 0 AND (a > 0 OR {self.extends})")
        text = self.candidates(going)
        if spec.second_order:
            needed = "NOT _sure" + (f" AND ({spec.asks.sql})" if spec.asks is not None else "")
            text = with_link(f"SELECT *, CASE WHEN {needed} THEN prev END AS _ask FROM ({text})", "_ask")
        if spec.query is not None:
            text = self.with_answers(text, "NOT _sure")
        text = f"SELECT *, coalesce(CAST({spec.dynamic.sql} AS DOUBLE), 0.0D) AS _d FROM ({text})"
        if self.config.check_bounds:
            low = f"CAST({spec.lower.sql} AS DOUBLE)" if spec.lower is not None else "0.0D"
            text = f"SELECT * EXCEPT (_d), CASE WHEN _d > CAST({spec.most.sql} AS DOUBLE) OR _d < {low} THEN raise_error('dynamic component outside its bounds') ELSE _d END AS _d FROM ({text})"
        edge = ["dst", *ready.payload, "to_tot", "to_deg", *[f"to_{a}" for a in ready.attributes]]
        own = [c for c in self.carried if c != "wid"]
        best = f"min(CASE WHEN _sure OR _dart < (_d - _over) * {rng.P} THEN struct(_t, {', '.join(edge)}) END) AS _e, first(struct({', '.join(own)})) AS _w"
        text = f"SELECT wid, {best} FROM ({text}) GROUP BY wid"
        tried = ", ".join(f"CASE WHEN _e IS NULL THEN _w.a + {TRIED.replace('(a', '(_w.a')} ELSE 0 END AS a" if c == "a" else f"_w.{c}" for c in own)
        text = f"SELECT wid, {tried}, {', '.join(f'_e.{c}' for c in edge)}, _e IS NOT NULL AS took FROM ({text})"
        done = self.keep(self.sql(self.moved(text, "took", "took"), state))
        return done.drop("took"), done.where("took").select("wid", "step", "v")

    def with_answers(self, inner: str, needed: str) -> str:
        """Adds re_…; walkers that ask nothing get keys of their own, or they would all meet in one partition."""
        query = self.spec.query
        name = f"answers{id(query)}"
        if name not in self.ready.views:
            self.ready.views[name] = f"answers_{uuid.uuid4().hex[:12]}"
            self.ready.answers(query).createOrReplaceTempView(self.ready.views[name])
        columns = [c for c in self.ready.answers(query).columns if c not in ("v", "key")]
        to = f"CASE WHEN {needed} AND ({query.when.sql}) THEN ({query.vertex.sql}) ELSE -1 - h END AS _to"
        key = f", ({query.key.sql}) AS _about" if query.key is not None else ""
        match = " AND w._about = r.key" if query.key is not None else ""
        return f"SELECT w.* EXCEPT (_to{', _about' if key else ''}), {', '.join(f'r.{c}' for c in columns)} FROM (SELECT *, {to}{key} FROM ({inner})) w LEFT JOIN {self.ready.views[name]} r ON w._to = r.v{match}"

    def without_stuck(self, going: str) -> str:
        """Ends walkers whose vertex has no edge with a positive dynamic component, after PATIENCE rejections.

        Few walkers get here; those that do have all their vertex's edges looked at, one row each, and none is collected.
        """
        if self.most_tries < PATIENCE:
            return going
        spec, ready = self.spec, self.ready
        waiting = f"SELECT * FROM ({going}) WHERE a > 0 AND a % {PATIENCE} = 0"
        payload = "".join(f", e.{c}" for c in ready.payload)
        there = "".join(f", t.at_{a} AS to_{a}" for a in ready.attributes)
        rows = f"SELECT w.*, e.dst{payload}{there} FROM ({waiting}) w JOIN {{cdf}} e ON e.src = w.v LEFT JOIN {{vertices}} t ON t.v = e.dst"
        if spec.second_order:
            rows = with_link(rows, "prev")
        if spec.query is not None:
            rows = self.with_answers(rows, "true")
        free = f"SELECT wid FROM ({rows}) WHERE {spec.dynamic.sql} > 0"
        stuck = f"SELECT wid FROM ({waiting}) s LEFT ANTI JOIN ({free}) f USING (wid)"
        return f"SELECT g.* FROM ({going}) g LEFT ANTI JOIN ({stuck}) s ON g.wid = s.wid"


def in_rise(u: str, tot: str, bound: str, apart_tot: str, rise: str) -> str:
    """Whether a draw falls among what the outliers have above the bound, in proportion to the areas."""
    area = f"CAST({apart_tot} AS DOUBLE) * {rise}"
    return f"({u} * (CAST({tot} AS DOUBLE) * {bound} + {area}) < {area} * {rng.P})"


def with_link(inner: str, prev: str) -> str:
    """Adds linked: whether (prev, dst) is an edge."""
    return f"SELECT w.*, p.prev IS NOT NULL AS linked FROM ({inner}) w LEFT JOIN {{pairs}} p ON w.{prev} = p.prev AND w.dst = p.dst"


def send(spark: SparkSession, ready: Prepared, spec: Transition) -> object:
    """The graph as arrays, to all executors; its size has been checked."""
    key = (spec.second_order, spec.outlier_key[0] if spec.outlier_key is not None else None, id(spec.query))
    if key in ready.sent:
        return ready.sent[key]
    columns = ["src", "dst", "hi", "tot", *ready.payload]
    sent = ready.cdf.select(*columns, "w", *([F.expr(spec.outlier_key[0]).cast("long").alias("_key")] if spec.outlier_key is not None else []))
    t = sent.orderBy("src", "hi").toArrow()
    x = {c: t[c].to_numpy() for c in ("src", "dst", "hi", "tot")}
    names, first, counts = np.unique(x["src"], return_index=True, return_counts=True)
    arrays = {
        "names": names, "tot": x["tot"][first].astype(np.int64), "hi": x["hi"], "dst": x["dst"], "first": first, "n": counts,
        "payload": {c: t[c].to_pandas().to_numpy() for c in ready.payload},
    }
    if spec.second_order:
        arrays["pairs"] = Pairs(x["src"], x["dst"])
    if spec.outlier_key is not None:
        keys, at = t["_key"].to_pandas().to_numpy(), np.repeat(np.arange(len(first)), counts)
        rows = np.flatnonzero(~np.isnan(keys.astype(float)))
        rows = rows[np.lexsort((rows, keys[rows].astype(np.int64), at[rows]))]
        groups = Pairs(at[rows], keys[rows].astype(np.int64))
        new = np.flatnonzero(np.diff(groups.codes_of(at[rows], keys[rows].astype(np.int64)), prepend=-1))
        w = t["w"].to_numpy()[rows].astype(np.int64)
        run = np.cumsum(w)
        before = (run - w)[new]
        sizes = np.diff(np.append(new, len(rows)))
        arrays["apart"] = {"groups": groups, "rows": rows, "hi": run - np.repeat(before, sizes), "first": new, "n": sizes, "tot": np.add.reduceat(w, new) if len(new) else np.zeros(0, np.int64)}
    if ready.attributes:
        a = ready.vertices.orderBy("v").toArrow()
        arrays["a_names"] = a["v"].to_numpy()
        arrays["a"] = {c: a[f"at_{c}"].to_pandas().to_numpy() for c in ready.attributes}
    if spec.query is not None:
        a = ready.answers(spec.query).toArrow()
        keys = a["key"].to_numpy() if spec.query.key is not None else np.zeros(len(a), np.int64)
        pairs = Pairs(a["v"].to_numpy(), keys)
        order = np.argsort(pairs.codes_of(a["v"].to_numpy(), keys), kind="stable")
        arrays["answers"] = {"pairs": pairs, "columns": {c: a[c].to_pandas().to_numpy()[order] for c in a.column_names if c not in ("v", "key")}}
    ready.sent[key] = spark.sparkContext.broadcast(arrays)
    return ready.sent[key]


class Pairs:
    """A set of pairs of numbers; find gives the place of each pair among those that are there, in order, or -1."""

    def __init__(self, a: np.ndarray, b: np.ndarray) -> None:
        self.a, self.b = np.unique(a), np.unique(b)
        self.codes = np.unique(self.codes_of(a, b))

    def codes_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.a, a) * len(self.b) + np.searchsorted(self.b, b)

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        if not len(self.codes):
            return np.full(len(a), -1)
        i, j = (np.minimum(np.searchsorted(x, y), len(x) - 1) for x, y in ((self.a, a), (self.b, b)))
        code = i * len(self.b) + j
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        return np.where((self.a[i] == a) & (self.b[j] == b) & (self.codes[at] == code), at, -1)


def edge_at(hi: np.ndarray, first: np.ndarray, n: np.ndarray, r: np.ndarray) -> np.ndarray:
    """For each row the first place from `first` on, of n, whose hi is above r; a binary search of all rows at once."""
    lo, end = first.copy(), first + n - 1
    while (lo < end).any():
        mid = (lo + end) // 2
        right = hi[mid] <= r
        lo, end = np.where(right, mid + 1, lo), np.where(right, end, mid)
    return lo


class Tasks:
    """Whole walks inside tasks, vectorised over the walkers of a batch."""

    def __init__(self, spark: SparkSession, graph: Graph, ready: Prepared, walkers: WalkerConfig, spec: Transition, config: WalkConfig) -> None:
        self.spark, self.graph, self.ready, self.walkers, self.spec, self.config = spark, graph, ready, walkers, spec, config

    def run(self, epoch: Epoch = None) -> DataFrame:
        sent = send(self.spark, self.ready, self.spec)
        own = seeds(self.spark, self.graph, self.walkers, epoch)
        own = own.repartition(self.spark.sparkContext.defaultParallelism) if self.walkers.table is not None else own
        spec, update, most, check = without_tables(self.spec), dict(self.walkers.update), self.config.max_steps, self.config.check_bounds

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            g = sent.value
            for b in batches:
                columns = {f: b.column(k).to_pandas().to_numpy() for k, f in enumerate(b.schema.names)}
                for wid, step, v in walk_batch(g, columns, spec, update, most, check):
                    yield pa.RecordBatch.from_arrays([pa.array(wid), pa.array(step), pa.array(v)], ["wid", "step", "v"])

        return own.mapInArrow(run, "wid long, step long, v long")


def walk_batch(g: dict, w: dict[str, np.ndarray], spec: Transition, update: dict, most: int, check: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    n = len(w["wid"])
    w = {k: x.copy() for k, x in w.items()}
    w["a"] = np.zeros(n, np.int64)
    w["step"] = w["step"].astype(np.int64)
    yield w["wid"], w["step"], w["v"]
    last = max(len(g["names"]) - 1, 0)

    def attributes(v: np.ndarray, prefix: str) -> dict[str, np.ndarray]:
        if "a" not in g:
            return {}
        if not len(g["a_names"]):
            return {f"{prefix}{k}": np.full(len(v), np.nan) for k in g["a"]}
        at = np.minimum(np.searchsorted(g["a_names"], v), len(g["a_names"]) - 1)
        there = g["a_names"][at] == v
        if there.all():
            return {f"{prefix}{k}": x[at] for k, x in g["a"].items()}
        return {f"{prefix}{k}": np.where(there, x[at], np.nan if x.dtype.kind in "biuf" else None) for k, x in g["a"].items()}

    def linked(p: np.ndarray, x: np.ndarray) -> np.ndarray:
        return g["pairs"].find(p, x) >= 0

    def asked(names: dict[str, np.ndarray], rows: int) -> dict[str, np.ndarray]:
        """What the asked vertices answer; NaN, or None for what is no number, where nothing is asked or known."""
        if spec.query is None:
            return {}
        when = np.broadcast_to(np.asarray(spec.query.when.vector(**names), bool), (rows,))
        to = np.broadcast_to(spec.query.vertex.vector(**names), (rows,))
        key = np.broadcast_to(spec.query.key.vector(**names), (rows,)) if spec.query.key is not None else np.zeros(rows, np.int64)
        at = np.where(when, g["answers"]["pairs"].find(to, key), -1)
        known = at >= 0
        if known.all():
            return {c: x[at] for c, x in g["answers"]["columns"].items()}
        return {c: np.where(known, x[at], np.nan if x.dtype.kind in "biuf" else None) if len(x) else np.full(rows, np.nan) for c, x in g["answers"]["columns"].items()}

    def full(x: object, rows: int) -> np.ndarray:
        return np.broadcast_to(np.asarray(x, np.float64), (rows,))

    def dynamic(names: dict[str, np.ndarray], rows: int) -> np.ndarray:
        """A component without a value, as where it reads an attribute that is not there, is 0."""
        d = full(spec.dynamic.vector(**names), rows)
        return np.where(np.isnan(d), 0.0, d)

    for _ in range(most * PATIENCE):
        if not len(w["wid"]) or not len(g["names"]):
            return
        i = np.minimum(np.searchsorted(g["names"], w["v"]), last)
        now = attributes(w["v"], "at_")
        ext = full(spec.extend.vector(**w, **now), len(i))
        go = (w["a"] > 0) | (rng.np_draw(w["h"], w["step"], rng.EXTEND) < ext * rng.P)
        live = np.flatnonzero((g["names"][i] == w["v"]) & go)
        w, i, now = {k: x[live] for k, x in w.items()}, i[live], {k: x[live] for k, x in now.items()}
        if not len(i):
            return
        if spec.dynamic is not None and (wait := np.flatnonzero((w["a"] > 0) & (w["a"] % PATIENCE == 0))).size:
            keep = np.ones(len(i), bool)
            for k in wait:
                e = slice(g["first"][i[k]], g["first"][i[k]] + g["n"][i[k]])
                one = {c: np.repeat(x[k : k + 1], e.stop - e.start) for c, x in (w | now).items()}
                more = {"linked": linked(one["prev"], g["dst"][e])} if spec.second_order else {}
                one |= {"dst": g["dst"][e]} | {c: x[e] for c, x in g["payload"].items()} | attributes(g["dst"][e], "to_") | more
                d = dynamic(one | asked(one, e.stop - e.start), e.stop - e.start)
                keep[k] = (d > 0).any()
            w, i, now = {k: x[keep] for k, x in w.items()}, i[keep], {k: x[keep] for k, x in now.items()}
        salt = w["a"] * rng.PER_ATTEMPT + rng.EDGE
        r = rng.np_draw(w["h"], w["step"], salt) * rng.P + rng.np_draw(w["h"], w["step"], salt + 1)
        e = edge_at(g["hi"], g["first"][i], g["n"][i], r % g["tot"][i])
        took = np.ones(len(i), bool)
        over, apart = 0.0, None
        if spec.outlier_key is not None:
            own = g["apart"]
            names = w | now
            at = own["groups"].find(i, np.broadcast_to(spec.outlier_key[1].vector(**names), (len(i),)))
            tot = np.where(at >= 0, own["tot"][at], 0) if len(own["tot"]) else np.zeros(len(i), np.int64)
            ub = full(spec.bound.vector(**names), len(i))
            rise = np.maximum(np.nan_to_num(full(spec.outlier_upper.vector(**names), len(i))) - ub, 0.0)
            area = tot.astype(np.float64) * rise
            apart = rng.np_draw(w["h"], w["step"], salt + rng.REGION - rng.EDGE) * (g["tot"][i].astype(np.float64) * ub + area) < area * rng.P
            k = np.flatnonzero(apart)
            e[k] = own["rows"][edge_at(own["hi"], own["first"][at[k]], own["n"][at[k]], r[k] % tot[k])]
            over = np.where(apart, ub, 0.0)
        edge = {"dst": g["dst"][e], **{c: x[e] for c, x in g["payload"].items()}}
        if spec.dynamic is not None:
            names = w | now | edge | attributes(edge["dst"], "to_")
            if spec.second_order:
                names["linked"] = linked(w["prev"], edge["dst"])
            names |= asked(names, len(i))
            ub, d = full(spec.bound.vector(**names), len(i)), dynamic(names, len(i))
            if check and ((d > full(spec.most.vector(**names), len(i))).any() or (spec.lower is not None and (d < full(spec.lower.vector(**names), len(i))).any())):
                raise BoundError("dynamic component outside its bounds")
            dart = rng.np_draw(w["h"], w["step"], salt + 2)
            height = ub if apart is None else np.where(apart, rise, ub)
            took = dart * height < (d - over) * rng.P
            if spec.lower is not None:
                sure = dart * ub < full(spec.lower.vector(**names), len(i)) * rng.P
                took |= sure if apart is None else sure & ~apart
        w["step"] = w["step"] + took
        fresh = {k: np.where(took, c.vector(**w, **now, **edge), w[k]) for k, c in update.items()}
        w |= fresh
        w["v"] = np.where(took, edge["dst"], w["v"])
        w["a"] = np.where(took, 0, w["a"] + 1)
        yield w["wid"][took], w["step"][took], w["v"][took]
    raise RuntimeError(f"walkers are left after {most} steps")


def without_tables(spec: Transition) -> Transition:
    """The specification as it goes to the tasks, where the answers are arrays."""
    if spec.query is None or spec.query.table is None:
        return spec
    query = copy.copy(spec.query)
    query.table = None
    out = copy.copy(spec)
    out.query = query
    return out


def recursive(spark: SparkSession, graph: Graph, ready: Prepared, walkers: WalkerConfig, spec: Transition, levels: int, epoch: Epoch = None) -> DataFrame:
    """One WITH RECURSIVE query over the cell table; static components only."""
    if spec.dynamic is not None or walkers.init:
        raise ValueError("the recursive strategy takes stateless walks without a dynamic component")
    if levels > MOST_LEVELS:
        raise ValueError(f"the recursive strategy takes at most {MOST_LEVELS} steps")
    begin = f"seeds_{uuid.uuid4().hex[:12]}"
    seeds(spark, graph, walkers, epoch).select("wid", "h", "step", "v").join(ready.vertices.select("v", "tot", "deg"), "v", "left").createOrReplaceTempView(begin)
    text = rng.sql_draws("SELECT * FROM walk WHERE tot > 0", {"x": str(rng.EXTEND)} | edge_salts("0"), drop="EXCEPT")
    text = with_cell(text, "true")
    out = spark.sql(f"""
        WITH RECURSIVE walk(wid, h, step, v, tot, deg) MAX RECURSION LEVEL {MOST_LEVELS + 2} AS (
            SELECT wid, h, step, v, tot, deg FROM {begin}
            UNION ALL
            SELECT d.wid, d.h, d.step + 1, c.dst, c.to_tot, c.to_deg FROM ({text}) d JOIN {ready.view("cells")} c
            ON c.src = d.v AND c.cell = d._cell AND d._r >= c.lo AND d._r < c.hi
            WHERE d.x < CAST({spec.extend.sql} AS DOUBLE) * {rng.P})
        SELECT wid, step, v FROM walk""")
    spark.catalog.dropTempView(begin)
    return out


def vectorised(walkers: WalkerConfig, spec: Transition) -> bool:
    used = [spec.extend, spec.dynamic, spec.bound, spec.lower, spec.outlier_upper, *walkers.update.values()]
    if spec.outlier_key is not None:
        used.append(spec.outlier_key[1])
    if spec.query is not None:
        used += [spec.query.vertex, spec.query.when, spec.query.key]
    return all(c.vector is not None for c in used if c is not None)


def choose(ready: Prepared, walkers: WalkerConfig, spec: Transition, config: WalkConfig) -> str:
    """Tasks for graphs of a checked size whose components have NumPy twins, else supersteps."""
    small = ready.n_edges <= MOST_SENT_EDGES and ready.sent_bytes(spec) <= MOST_SENT_BYTES
    if config.strategy != "auto":
        if config.strategy == "tasks" and not small:
            raise ValueError(f"a graph of {ready.n_edges} edges and {ready.sent_bytes(spec)} bytes is not sent to all executors")
        return config.strategy
    return "tasks" if small and vectorised(walkers, spec) else "supersteps"


def epochs(walkers: WalkerConfig, rate: float) -> Iterator[Epoch]:
    """Ranges of about rate * num ids; the walkers of a table go in hashed parts, whose number follows from the rate."""
    if rate >= 1:
        yield None
    elif walkers.table is not None:
        n = math.ceil(1 / rate)
        yield from ((k, n) for k in range(n))
    else:
        per = min(max(int(walkers.num * rate), 1), max(walkers.num, 1))
        yield from ((lo, min(walkers.num, lo + per)) for lo in range(0, walkers.num, per))


def random_walk(graph: Graph, walkers: WalkerConfig, spec: Transition, config: WalkConfig | None = None, ready: Prepared | None = None, levels: int = MOST_LEVELS) -> DataFrame:
    """The walk table (wid, step, v).  With a rate below 1 the walkers go in epochs; the walks are the same."""
    from wanderframe.operators import paths

    config = config or WalkConfig()
    spec.validate(walkers)
    spark = graph.spark
    own = ready is None
    ready = ready or prepare(graph, spec.static, spec.dynamic is not None)
    how = choose(ready, walkers, spec, config)
    taken = config.output or config.consumer
    parts = []
    for k, epoch in enumerate(epochs(walkers, config.rate)):
        folder = None
        if how == "supersteps":
            run = Supersteps(spark, graph, ready, walkers, spec, config)
            part, folder = run.run(epoch), run.root
        elif how == "tasks":
            part = Tasks(spark, graph, ready, walkers, spec, config).run(epoch)
        else:
            part = recursive(spark, graph, ready, walkers, spec, levels, epoch)
        if how == "recursive" or how == "tasks" and (taken or config.rate < 1):
            folder = f"{shared_dir(spark)}/walk-{uuid.uuid4().hex}"
            part.write.parquet(folder)  # walked once, whoever reads it
            part = spark.read.schema(part.schema).parquet(folder)
        if config.output:
            paths.write_paths(part, f"{config.output}/epoch={k}", config.with_head)
        if config.consumer:
            config.consumer(part, k)
        if config.discard and folder:
            removed(spark, folder)
        elif not config.discard:
            parts.append(part)
    if own and how != "tasks":
        ready.release()  # all rows are in the shared folder
    return union_of(parts) if parts else spark.createDataFrame([], "wid long, step long, v long")
