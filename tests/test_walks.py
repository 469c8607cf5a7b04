"""Walks: equal under every strategy, legal, and distributed as their exact matrices say."""

from __future__ import annotations

import os
import random
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest

from wanderframe.functions import rng
from wanderframe.operators import analytics, apps, paths
from wanderframe.operators.graph import Graph, symmetrise
from wanderframe.plans import engine
from wanderframe.plans.spec import Component, Query, Transition, WalkConfig, WalkerConfig, opaque
from wanderframe.session import shared_dir


def ring(spark, v=34, extra=44, seed=2):
    """An undirected connected graph without parallel edges."""
    rnd = random.Random(seed)
    pairs = {(k, (k + 1) % v) for k in range(v)}
    while len(pairs) < v + extra:
        a, b = sorted(rnd.sample(range(v), 2))
        if (b, a) not in pairs:
            pairs.add((a, b))
    rows = [(a, b, float(rnd.randint(1, 5)), rnd.randrange(5)) for a, b in sorted(pairs)]
    return Graph(symmetrise(spark.createDataFrame(rows, "src long, dst long, weight double, etype int")).cache(), v)


def rows_of(walks):
    return sorted(map(tuple, walks.collect()))


def test_generator_forms_agree(spark):
    df = rng.with_draws(rng.with_walker_hash(spark.range(500).selectExpr("id * 7919 AS wid", "id % 13 AS step")), {"x": 3, "y": 11})
    t = df.toPandas()
    h = rng.np_walker_hash(t.wid.to_numpy())
    assert (h == t.h).all()
    for name, salt in (("x", 3), ("y", 11)):
        assert (rng.np_draw(h, t.step.to_numpy(), salt) == t[name]).all()
    import duckdb

    got = duckdb.sql(rng.sql_draws(rng.sql_walker_hash("SELECT range * 7919 AS wid, range % 13 AS step FROM range(500)"), {"x": "3", "y": "11"}) + " ORDER BY wid").df()
    assert (got.x == t.x).all() and (got.y == t.y).all()


def test_large_walker_ids_differ(spark):
    """Ids beyond 2^31 - 1 are folded with their high part, alike in all forms."""
    import duckdb

    ids = [w + k * rng.P for w in (0, 1, 77) for k in (0, 1, 2, 2**20, 2**30)] + [2**63 - 1, -1, -rng.P]
    h = rng.np_walker_hash(np.array(ids))
    assert len(set(h[:15].tolist())) == 15 and ((h >= 0) & (h < rng.P)).all()
    df = rng.with_walker_hash(spark.createDataFrame([(i,) for i in ids], "wid long"))
    assert {r.wid: r.h for r in df.collect()} == dict(zip(ids, h.tolist(), strict=True))
    rows = ", ".join(f"({i})" for i in ids)
    assert dict(duckdb.sql(f"SELECT wid, h FROM ({rng.sql_walker_hash(f'SELECT * FROM (VALUES {rows}) t(wid)')})").fetchall()) == dict(zip(ids, h.tolist(), strict=True))


def test_generator_is_even():
    h = rng.np_walker_hash(np.arange(20_000))
    draws = np.stack([rng.np_draw(h, np.full(20_000, s), 10) for s in range(20)])
    cells = np.bincount((draws * 256 // rng.P).ravel(), minlength=256)
    expected = draws.size / 256
    assert ((cells - expected) ** 2 / expected).sum() < 360
    pairs = np.bincount(((draws[:-1] * 16 // rng.P) * 16 + draws[1:] * 16 // rng.P).ravel(), minlength=256)
    expected = pairs.sum() / 256
    assert ((pairs - expected) ** 2 / expected).sum() < 360


def strategies(graph, walkers, spec, names):
    return [rows_of(engine.random_walk(graph, walkers, spec, WalkConfig(strategy=s))) for s in names]


def test_static_strategies_agree(spark):
    g = ring(spark)
    three = strategies(g, WalkerConfig(60), apps.deepwalk(8, True), ["tasks", "supersteps", "recursive"])
    assert three[0] == three[1] == three[2]
    assert len(three[0]) == 60 * 9
    a, b = strategies(g, WalkerConfig(60), apps.ppr(0.2), ["tasks", "supersteps"])
    assert a == b
    moved = rows_of(engine.random_walk(Graph(g.edges.repartition(7), 34), WalkerConfig(60), apps.deepwalk(8, True)))
    assert moved == three[0]


def test_only_walkers_shuffle(spark):
    g = ring(spark)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        run = engine.Supersteps(spark, g, engine.prepare(g, "weight", False), WalkerConfig(10), apps.deepwalk(8, True), WalkConfig())
        df = run.static_plan(run.keep(run.start(None)))
        plan = df._jdf.queryExecution().executedPlan().toString()
        lines = [x.strip(" :+-") for x in plan.split("\n")]
        assert sum(x.startswith("SortMergeJoin") for x in lines) == engine.MOVES
        scans = [k for k, x in enumerate(lines) if x.startswith("InMemoryTableScan")]
        assert len(scans) == engine.MOVES
        # above each scan of the cells stands neither an exchange nor a sort
        assert all(not lines[k - 1].startswith(("Exchange", "Sort ")) and not lines[k - 2].startswith(("Exchange", "Sort ")) for k in scans)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


@pytest.mark.parametrize("name", ["dynamic", "node2vec", "metapath", "tag", "outlier", "hash"])
def test_dynamic_strategies_agree(spark, name):
    g = ring(spark)
    if name == "dynamic":
        state, spec = apps.dynamic_walk(3)
    elif name == "node2vec":
        state, spec = apps.node2vec(3, 4.0, 0.25)
    elif name == "metapath":
        g, state, spec = apps.metapath(g, apps.Schemes([(s, j, k, (s + j + k) % 3 > 0) for s in range(3) for j in range(3) for k in range(5)]), 3)
    elif name == "hash":
        state, spec = apps.hash_walk(3)
    else:
        g = Graph(g.edges, 34, spark.range(34).selectExpr("id AS v", "id % 4 AS tag"))
        state, spec = apps.tag_walk(3, 0.5, 3.0 if name == "outlier" else None)
    a, b = strategies(g, WalkerConfig(40, **state), spec, ["tasks", "supersteps"])
    assert a == b
    assert Counter(s for _, s, _ in a)[0] == 40


@pytest.mark.parametrize("name", ["node2vec_edges_supersteps", "metapath_edges_supersteps"])
def test_rejection_supersteps_over_tables(spark, tmp_path, monkeypatch, name):
    """The registered queries take the rejection supersteps and give their oracle's rows."""
    import duckdb

    from wanderframe.plans import walk_queries as wq

    rnd = random.Random(5)
    edges = [(rnd.randrange(9), rnd.choice([None, *range(12)]), rnd.choice([None, 0.0, 1.0, 2.5]), rnd.choice([None, 0, 1])) for _ in range(120)]
    walkers = [(k, "node2vec" if k % 2 else "metapath", rnd.choice([None, *range(9)]), 3, 0 if k % 2 == 0 else None, 2.0, 0.5) for k in range(30)]
    tables = {
        "edges": (edges, "src long, dst long, weight double, etype int"),
        "walkers": (walkers, "walker long, app string, start_vertex long, steps long, scheme_id int, param_p double, param_q double"),
        "schemes": ([(0, pos, t, t != pos) for pos in range(2) for t in range(2)], "scheme_id int, pos int, etype int, allowed boolean"),
    }
    db = duckdb.connect()
    for table, (rows, columns) in tables.items():
        spark.createDataFrame(rows, columns).write.parquet(f"{tmp_path}/{table}.parquet")
        db.execute(f"CREATE VIEW {table} AS FROM '{tmp_path}/{table}.parquet/*.parquet'")
    jobs = []
    job = engine.Supersteps.dynamic_job
    monkeypatch.setattr(engine.Supersteps, "dynamic_job", lambda self, state: jobs.append(1) or job(self, state))
    got = rows_of(wq.QUERIES[name](spark, str(tmp_path)).select("wid", "step", "v"))
    assert jobs and got == sorted(db.execute(wq.ORACLES[name]).fetchall())
    assert max(step for _, step, _ in got) == 3


@pytest.mark.parametrize("name", ["bound", "outlier", "hash"])
def test_second_order_forms_equal_the_first(spark, name):
    """What the walker asks the last vertex for is what it carries along in the first-order form."""
    g = ring(spark)
    g = Graph(g.edges, 34, spark.range(34).selectExpr("id AS v", "id % 4 AS tag"))
    form = lambda order: apps.hash_walk(4, order=order) if name == "hash" else apps.tag_walk(4, 0.5, 3.0 if name == "outlier" else None, order=order)
    (state, first), (asked, second) = form(1), form(2)
    one = rows_of(engine.random_walk(g, WalkerConfig(40, **state), first))
    assert "last_tag" not in asked["init"]
    assert strategies(g, WalkerConfig(40, **asked), second, ["tasks", "supersteps"]) == [one, one]


@pytest.mark.parametrize("keyed", [True, False])
def test_answers_from_a_table(spark, keyed):
    """Vertices that the table lacks answer with null; the walker may ask about its candidate."""
    g = ring(spark)
    rows = [(v, k, 1.0 + (v + k) % 3) for v in range(0, 34, 2) for k in range(5)] if keyed else [(v, float(v % 3)) for v in range(0, 34, 2)]
    table = spark.createDataFrame(rows, "v long, key long, n double" if keyed else "v long, n double")
    query = Query(Component("prev", lambda **k: k["prev"]), Component("step > 0", lambda **k: k["step"] > 0), table, Component("etype", lambda **k: k["etype"]) if keyed else None)
    d = Component("1.0D + coalesce(re_n, 0.5D)", lambda **k: 1.0 + np.where(np.isnan(k["re_n"].astype(float)), 0.5, k["re_n"].astype(float)))
    spec = Transition(apps.up_to(4), "weight", d, 4.0, 1.0, query=query)
    a, b = strategies(g, WalkerConfig(60, **apps.previous()), spec, ["tasks", "supersteps"])
    assert a == b and len(a) == 60 * 5


@pytest.mark.parametrize(("p", "q"), [(0.05, 1.0), (0.25, 4.0)])
def test_outliers_are_drawn_by_their_area(spark, p, q):
    g = ring(spark)
    state, spec = apps.node2vec(20, p, q)
    assert spec.outlier_key is not None
    walks = engine.random_walk(g, WalkerConfig(40_000, **state), spec).cache()
    r = analytics.compare_matrices(analytics.node2vec_matrix(g.edges, p, q), analytics.empirical_second_order(walks), ["prev", "cur", "dst"]).first()
    assert r.only_seen == 0 and r.only_exact < r.entries / 20 and r.sum_sq < 2.0
    a, b = strategies(g, WalkerConfig(40, **apps.node2vec(3, p, q)[0]), apps.node2vec(3, p, q)[1], ["tasks", "supersteps"])
    assert a == b


def test_rare_returns_at_a_hub_of_100_000_edges(spark, monkeypatch):
    """With p = 0.01 the way back weighs a hundred times another edge; no walker waits for it, none looks at the hub's list."""
    leaves = spark.range(1, 100_001)
    edges = leaves.selectExpr("0L AS src", "id AS dst", "1.0D AS weight").union(leaves.selectExpr("id AS src", "0L AS dst", "1.0D AS weight"))
    state, spec = apps.node2vec(4, 0.01, 1.0)
    jobs = []
    job = engine.Supersteps.dynamic_job
    monkeypatch.setattr(engine.Supersteps, "dynamic_job", lambda self, x: jobs.append(self.most_tries) or job(self, x))
    got = rows_of(engine.random_walk(Graph(edges, 100_001), WalkerConfig(3000, starts=list(range(1, 501)), **state), spec, WalkConfig(strategy="supersteps")))
    assert len(got) == 3000 * 5 and len(jobs) <= 7 and max(jobs) < 12
    back = sum(a[2] == b[2] for a, b in zip(got[0::5], got[2::5], strict=True))
    assert back < 3000 * 0.005  # 100 of 100,099
    few = leaves.limit(20)
    edges = few.selectExpr("0L AS src", "id AS dst", "1.0D AS weight").union(few.selectExpr("id AS src", "0L AS dst", "1.0D AS weight"))
    got = rows_of(engine.random_walk(Graph(edges, 100_001), WalkerConfig(3000, starts=[1, 2, 3], **state), spec))
    back = sum(a[2] == b[2] for a, b in zip(got[0::5], got[2::5], strict=True))
    assert abs(back / 3000 - 100 / 119) < 0.03


def test_walkers_of_a_table_go_in_epochs(spark):
    g = ring(spark)
    table = spark.range(50).selectExpr("id * 3 AS wid", "id % 34 AS start")
    seen = []
    got = rows_of(engine.random_walk(g, WalkerConfig(table=table), apps.deepwalk(3), WalkConfig(rate=0.3, consumer=lambda df, k: seen.append({r.wid for r in df.collect()}))))
    assert got == rows_of(engine.random_walk(g, WalkerConfig(table=table), apps.deepwalk(3)))
    assert len(seen) == 4 and set.union(*seen) == {3 * k for k in range(50)} and sum(map(len, seen)) == 50


@pytest.mark.parametrize("strategy", ["tasks", "supersteps"])
def test_epochs_run_and_are_freed_in_turn(spark, tmp_path, strategy, monkeypatch):
    """The second epoch begins after the first was handed over; discarded rows leave no files, and caches are released."""
    g, events = ring(spark), []
    kind = engine.Tasks if strategy == "tasks" else engine.Supersteps
    run = kind.run
    monkeypatch.setattr(kind, "run", lambda self, epoch=None: events.append(("run", epoch)) or run(self, epoch))
    config = WalkConfig(rate=0.5, strategy=strategy, output=str(tmp_path / "p"), consumer=lambda df, k: events.append(("took", k, df.count())), discard=True)
    before, views = set(os.listdir(shared_dir(spark))), {v.name for v in spark.catalog.listTables()}
    assert engine.random_walk(g, WalkerConfig(10), apps.deepwalk(4), config).count() == 0
    assert events == [("run", (0, 5)), ("took", 0, 25), ("run", (5, 10)), ("took", 1, 25)]
    assert not [x for x in set(os.listdir(shared_dir(spark))) - before if x.startswith("walk-")]
    assert spark.read.option("recursiveFileLookup", True).text(str(tmp_path / "p")).count() == 10
    assert {v.name for v in spark.catalog.listTables()} <= views


def test_what_is_sent_is_bounded_in_bytes(spark, monkeypatch):
    """Attributed vertices count as edges do."""
    g = ring(spark)
    many = Graph(g.edges, 34, spark.range(34).selectExpr("id AS v", "id % 4 AS tag"))
    state, spec = apps.tag_walk(2)
    ready = engine.prepare(many, spec.static, True)
    assert engine.choose(ready, WalkerConfig(3, **state), spec, WalkConfig()) == "tasks"
    monkeypatch.setattr(engine, "MOST_SENT_BYTES", ready.sent_bytes(spec) - 1)
    assert engine.choose(ready, WalkerConfig(3, **state), spec, WalkConfig()) == "supersteps"
    with pytest.raises(ValueError, match="bytes"):
        engine.choose(ready, WalkerConfig(3, **state), spec, WalkConfig(strategy="tasks"))


def test_epochs_do_not_change_walks(spark, tmp_path):
    g = ring(spark)
    seen = []
    config = WalkConfig(rate=0.3, output=str(tmp_path / "p"), with_head=True, consumer=lambda df, k: seen.append((k, df.select("wid").distinct().count())))
    got = rows_of(engine.random_walk(g, WalkerConfig(10), apps.deepwalk(4), config))
    assert got == rows_of(engine.random_walk(g, WalkerConfig(10), apps.deepwalk(4)))
    assert seen == [(0, 3), (1, 3), (2, 3), (3, 1)]
    assert got == rows_of(engine.random_walk(g, WalkerConfig(10), apps.deepwalk(4), WalkConfig(rate=0.5, strategy="recursive")))
    lines = sorted(r.value for r in spark.read.option("recursiveFileLookup", True).text(str(tmp_path / "p")).collect())
    by = defaultdict(list)
    for w, _, v in got:
        by[w].append(str(v))
    assert lines == sorted(f"{w} {len(p)} {' '.join(p)}" for w, p in by.items())


def test_first_order_distribution(spark):
    g = ring(spark)
    walks = engine.random_walk(g, WalkerConfig(6000), apps.deepwalk(20, True)).cache()
    r = analytics.compare_matrices(analytics.transition_matrix(g.edges), analytics.empirical_matrix(walks), ["src", "dst"]).first()
    assert r.only_exact == r.only_seen == 0 and r.sum_sq < 0.1
    assert analytics.illegal_hops(walks, g).count() == 0


def test_second_order_distribution(spark):
    g = ring(spark)
    state, spec = apps.node2vec(20, 2.0, 0.5)
    walks = engine.random_walk(g, WalkerConfig(40_000, **state), spec).cache()
    r = analytics.compare_matrices(analytics.node2vec_matrix(g.edges, 2.0, 0.5), analytics.empirical_second_order(walks), ["prev", "cur", "dst"]).first()
    assert r.only_seen == 0 and r.only_exact == 0 and r.sum_sq < 1.0


def test_visits_and_paths_are_inverse(spark):
    walks = engine.random_walk(ring(spark), WalkerConfig(20), apps.ppr(0.3))
    assert rows_of(paths.to_visits(paths.to_paths(walks))) == rows_of(walks)


def test_ppr_lengths_are_geometric(spark):
    walks = engine.random_walk(ring(spark), WalkerConfig(8000), apps.ppr(0.25))
    n = Counter(r.path_length for r in paths.to_paths(walks).collect())
    for k in range(1, 6):
        assert abs(n[k] / 8000 - 0.75 ** (k - 1) * 0.25) < 0.02


def test_edge_cases(spark):
    kind = "src long, dst long, weight double, etype int"
    none = Graph(spark.createDataFrame([], kind), 3)
    for how in ("tasks", "supersteps"):
        assert rows_of(engine.random_walk(none, WalkerConfig(4), apps.deepwalk(5), WalkConfig(strategy=how))) == [(k, 0, k % 3) for k in range(4)]
    line = Graph(spark.createDataFrame([(0, 1, 1.0, 0), (1, 2, 1.0, 0)], kind), 3)
    for how in ("tasks", "supersteps", "recursive"):
        got = rows_of(engine.random_walk(line, WalkerConfig(1), apps.deepwalk(9), WalkConfig(strategy=how)))
        assert got == [(0, 0, 0), (0, 1, 1), (0, 2, 2)]
    zero = Graph(spark.createDataFrame([(0, 1, 0.0, 0), (0, 2, 0.0, 0)], kind), 3)
    ends = Counter(v for _, s, v in rows_of(engine.random_walk(zero, WalkerConfig(2000, starts=[0]), apps.deepwalk(1, True))) if s == 1)
    assert set(ends) == {1, 2} and abs(ends[1] - 1000) < 150
    parallel = Graph(spark.createDataFrame([(0, 1, 1.0, 0), (0, 1, 3.0, 0), (0, 2, 4.0, 0)], kind), 3)
    ends = Counter(v for _, s, v in rows_of(engine.random_walk(parallel, WalkerConfig(2000, starts=[0]), apps.deepwalk(1, True))) if s == 1)
    assert abs(ends[1] - 1000) < 150
    assert rows_of(engine.random_walk(line, WalkerConfig(0), apps.deepwalk(3))) == []


def test_walkers_that_cannot_move_end(spark):
    g = Graph(spark.createDataFrame([(0, 1, 1.0, 9), (1, 0, 1.0, 0)], "src long, dst long, weight double, etype int"), 2)
    never = Component("CASE WHEN etype = 9 THEN 0.0 ELSE 1.0 END", lambda **k: np.where(k["etype"] == 9, 0.0, 1.0))
    spec = Transition(apps.up_to(3), None, never, 1.0)
    for how in ("tasks", "supersteps"):
        assert rows_of(engine.random_walk(g, WalkerConfig(2), spec, WalkConfig(strategy=how))) == [(0, 0, 0), (1, 0, 1), (1, 1, 0)]


def test_bounds_are_checked_on_demand(spark):
    spec = Transition(apps.up_to(2), None, Component("3.0", lambda **_: 3.0), 2.0)
    with pytest.raises(Exception, match="bounds"):
        rows_of(engine.random_walk(ring(spark), WalkerConfig(5), spec, WalkConfig(check_bounds=True)))


def test_components_from_opaque_functions(spark):
    """Functions that SQL can't say, as dynamic component, bound and update of the state."""
    g = ring(spark)
    d = opaque(spark, lambda dst, prev, weight: 1.0 + np.abs(np.sin(dst * 0.7 + prev)) * (weight > 2), "dst", "prev", "weight")
    state = apps.previous(sum=(Component("CAST(0 AS BIGINT)"), opaque(spark, lambda total, dst: (total * 31 + dst) % 997, "sum", "dst", returns="long")))
    spec = Transition(apps.up_to(4), "weight", d, opaque(spark, lambda v: 2.0 + 0 * v, "v"), 1.0)
    a, b = strategies(g, WalkerConfig(40, **state), spec, ["tasks", "supersteps"])
    assert a == b and len(a) == 40 * 5


@pytest.mark.parametrize("named", [[(0, 1.0), (1, 2.0), (9, 3.0)], [(0, 1.0), (9, None)], []])
def test_vertices_without_attributes(spark, named):
    """Vertices 5 and 7 have no out-edges, and no attributes: their neighbours' attributes must not stand in."""
    edges = spark.createDataFrame([(0, 1), (0, 5), (1, 0), (1, 7), (1, 1)], "src long, dst long")
    graph = Graph(edges, 10, spark.createDataFrame(named, "v long, rank double"))
    read = Transition(Component("CASE WHEN step < 6 THEN 1.0 ELSE 0.0 END", lambda step, **_: (step < 6) * 1.0), dynamic=Component("to_rank", lambda to_rank, **_: to_rank), upper=3.0)
    a, b = strategies(graph, WalkerConfig(60), read, ("supersteps", "tasks"))
    assert a == b
    assert not {v for _, step, v in a if step} & {5, 7}


@pytest.mark.parametrize("name", ["key", "TOT", "to_x", "_t", "a"])
def test_columns_with_names_of_the_walk_are_refused(spark, name):
    edges = spark.createDataFrame([(0, 1, 2)], f"src long, dst long, `{name}` int")
    with pytest.raises(ValueError, match="names that a walk needs"):
        engine.random_walk(Graph(edges, 2), WalkerConfig(1), apps.deepwalk(1))


def test_null_and_repeated_walkers(spark):
    table = spark.createDataFrame([(1, 0, 2), (2, None, 2), (None, 1, 2), (3, 77, 2)], "wid long, start long, len int")
    got = rows_of(engine.random_walk(ring(spark), WalkerConfig(table=table), apps.deepwalk("len")))
    assert [r[:2] for r in got] == [(1, 0), (1, 1), (1, 2), (3, 0)]


def test_specifications_are_validated():
    ok = apps.up_to(3)
    for bad in (
        {"extend": None}, {"extend": ok, "dynamic": "1.0"}, {"extend": ok, "upper": 1.0}, {"extend": ok, "lower": 1.0}, {"extend": ok, "dynamic": "1.0", "upper": 1, "outlier": "true"},
        {"extend": ok, "dynamic": "1.0", "upper": 1, "outlier_upper": 2.0}, {"extend": ok, "second_order": True}, {"extend": ok, "asks": "true"},
    ):
        with pytest.raises(ValueError):
            Transition(**bad)
    for bad in ({}, {"num": 1, "table": object()}, {"num": -1}, {"num": 1, "starts": "odd"}, {"num": 1, "starts": []}, {"num": 1, "update": {"x": "1"}}):
        with pytest.raises(ValueError):
            WalkerConfig(**bad)
    for bad in ({"rate": 0}, {"rate": 1.5}, {"strategy": "magic"}):
        with pytest.raises(ValueError):
            WalkConfig(**bad)
    for bad in ({"key": "etype"}, {"table": pd.DataFrame({"x": [1]})}, {"table": pd.DataFrame({"v": [1]}), "key": "etype"}):
        with pytest.raises(ValueError):
            Query(**bad)
    for bad in ({"extend": ok, "query": Query()}, {"extend": ok, "dynamic": "1.0", "upper": 1, "outlier_key": ("dst", "prev")}):
        with pytest.raises(ValueError):
            Transition(**bad)
    with pytest.raises(ValueError, match="prev"):
        apps.node2vec(3, 2, 1)[1].validate(WalkerConfig(3))
    with pytest.raises(ValueError):
        WalkConfig(discard=True)
    with pytest.raises(ValueError):
        apps.ppr(2)
    with pytest.raises(ValueError):
        apps.node2vec(3, 0, 1)


def test_command_line(spark, tmp_path):
    from wanderframe import cli

    (tmp_path / "e.txt").write_text("".join(f"{a} {b} {w}\n" for a, b, w in [(0, 1, 1.5), (1, 2, 2.0), (2, 0, 1.0)]))
    assert cli.main(["convert", "-i", str(tmp_path / "e.txt"), "-o", str(tmp_path / "e.bin"), "-s", "weighted"], spark) == 0
    for args in (["deepwalk", "-l", "4"], ["ppr", "-t", "0.5", "--starts", "1", "2"], ["node2vec", "-l", "3", "-p", "2", "-q", "0.5"], ["simple"]):
        out = str(tmp_path / args[0])
        assert cli.main([args[0], "-v", "3", "-g", str(tmp_path / "e.bin"), "-w", "5", "-s", "weighted", "--make-undirected", "-o", out, *args[1:]], spark) == 0
        assert spark.read.option("recursiveFileLookup", True).text(out).count() == 5


def test_stream_of_footprints(spark, tmp_path):
    from wanderframe.streaming import visits

    rows = [(w, v, s, 0, f"2025-01-01 00:0{s}:00") for w, v, s in [(1, 5, 0), (1, 5, 0), (2, 5, 1), (2, None, 2), (3, 6, 3)]]
    spark.createDataFrame(rows, "walker long, vertex long, step long, epoch int, t string").selectExpr("walker", "vertex", "step", "epoch", "CAST(t AS timestamp) AS logged_at").write.parquet(str(tmp_path / "in"))
    q = visits.windowed_visits(visits.read_footprints(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("windowed").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.vertex, r.visits) for r in spark.sql("SELECT * FROM windowed").collect()) == [(5, 2), (6, 1)]
    got = []
    visits.each_epoch(visits.read_footprints(spark, str(tmp_path / "in")), lambda df, k: got.append((k, df.count())), str(tmp_path / "c")).awaitTermination()
    assert got == [(0, 5)]
