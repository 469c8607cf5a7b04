from __future__ import annotations

import random
from collections import Counter, defaultdict

import pytest

from wanderframe.operators.graph import Graph, GraphError, running_sums, symmetrise
from wanderframe.plans import static
from wanderframe.sources import edges as io


def some_edges(seed=1, n=300, v=20):
    rnd = random.Random(seed)
    return [(rnd.choice([0, rnd.randrange(v)]), rnd.randrange(v), float(rnd.randint(1, 5)), rnd.randrange(4)) for _ in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "src long, dst long, weight double, etype int")


@pytest.mark.parametrize("n", [0, 2, 64, 645])
@pytest.mark.parametrize("weighted", [True, False])
def test_binary_round_trip(spark, tmp_path, n, weighted):
    rows = [(s, d, w) if weighted else (s, d) for s, d, w, _ in some_edges(n, n)]
    df = spark.createDataFrame(rows, "src long, dst long" + ", weight double" * weighted).repartition(3)
    io.write_edges(df, str(tmp_path / "g"))
    back = io.read_edges(spark, str(tmp_path / "g"), weighted=weighted)
    assert Counter(map(tuple, back.collect())) == Counter(rows)
    io.register(spark)
    split = spark.read.format("binary_edges").option("weighted", weighted).option("split", 100).load(str(tmp_path / "g"))
    assert split.count() == n


def test_paths_with_a_scheme(spark, tmp_path):
    """Files behind a URI, appended and overwritten; a missing path is an error."""
    where = f"file://{tmp_path}/g"
    for mode in ("overwrite", "append", "append"):
        io.register(spark)
        spark.range(5).selectExpr("id AS src", "id + 1 AS dst").write.format("binary_edges").mode(mode).save(where)
    assert io.read_edges(spark, where, weighted=False).count() == 15 == io.read_edges(spark, str(tmp_path / "g"), weighted=False).count()
    io.write_edges(spark.range(3).selectExpr("id AS src", "id AS dst"), where)
    assert io.read_edges(spark, where, weighted=False).count() == 3
    assert io.uri_of("s3a://bucket/x") == "s3://bucket/x" and io.placed("file:/tmp/x")[1] == "/tmp/x" and io.uri_of("/tmp/x") is None
    with pytest.raises(Exception, match="does not exist"):
        io.read_edges(spark, f"{where}-none", weighted=False).count()


def test_scheme_tables_beyond_the_limit_are_refused(spark):
    df = spark.range(11).selectExpr("0 AS scheme_id", "CAST(id AS INT) AS pos", "0 AS etype", "true AS allowed")
    assert len(io.scheme_rows(df, 11)) == 11
    with pytest.raises(io.EdgeFileError):
        io.scheme_rows(df, 10)


def test_typed_graphs_load(spark, tmp_path):
    rows = some_edges(3, 50)
    io.write_edges(frame(spark, rows), str(tmp_path / "g"))
    g = Graph.load(spark, str(tmp_path / "g"), 20, typed=True)
    assert Counter(map(tuple, g.edges.collect())) == Counter(rows)


def test_vertex_maps_read_attributes(spark):
    from pyspark.sql import functions as F

    g = Graph(frame(spark, [(0, 1, 1.0, 0), (0, 2, 1.0, 0)]), 4, spark.createDataFrame([(0, 5), (3, 7)], "v long, tag int"))
    got = {r.v: (r.x, r.y) for r in g.map_vertices(x=F.col("tag") + F.col("out_degree"), y=F.col("in_degree")).collect()}
    assert got == {0: (7, 0), 1: (None, 1), 2: (None, 1), 3: (7, 0)}
    assert g.vertex_sum(F.col("tag")).first().total == 12


def test_binary_refuses_what_does_not_fit(spark, tmp_path):
    for rows, kind in (([(1 << 32, 1)], "src long, dst long"), ([(None, 1)], "src long, dst long")):
        with pytest.raises(Exception, match="32 bits|null"):
            io.write_edges(spark.createDataFrame(rows, kind), str(tmp_path / "bad"))
    (tmp_path / "odd.bin").write_bytes(b"123")
    with pytest.raises(Exception, match="whole records"):
        io.read_edges(spark, str(tmp_path / "odd.bin"), weighted=False).count()


def test_text_and_conversion(spark, tmp_path):
    (tmp_path / "e.txt").write_text("0 1 1.5\n1\t2   2.25\r\n\n 2 0 3\n")
    want = [(0, 1, 1.5), (1, 2, 2.25), (2, 0, 3.0)]
    assert sorted(map(tuple, io.read_text(spark, str(tmp_path / "e.txt")).collect())) == want
    io.convert(spark, str(tmp_path / "e.txt"), str(tmp_path / "e.bin"))
    assert sorted(map(tuple, io.read_edges(spark, str(tmp_path / "e.bin")).collect())) == want
    io.write_edges(io.read_edges(spark, str(tmp_path / "e.bin")), str(tmp_path / "t"), "text")
    assert sorted(map(tuple, io.read_text(spark, str(tmp_path / "t")).collect())) == want
    (tmp_path / "bad.txt").write_text("0 1 1.5\nnonsense\n")
    with pytest.raises(Exception, match="not an edge"):
        io.read_text(spark, str(tmp_path / "bad.txt")).collect()


def test_schemes_round_trip(tmp_path):
    rows = [(s, j, k, (s + j + k) % 2 == 0) for s in range(2) for j in range(3 + s) for k in range(5)]
    io.write_schemes(rows, str(tmp_path / "s"))
    assert io.read_schemes(str(tmp_path / "s")) == rows
    (tmp_path / "s").write_text("2 3\n1\n1 0 1\n")
    with pytest.raises(io.EdgeFileError):
        io.read_schemes(str(tmp_path / "s"))


def test_load_and_validate(spark, tmp_path):
    rows = some_edges(3, 100)
    io.write_edges(frame(spark, rows).drop("etype"), str(tmp_path / "g"))
    both = Graph.load(spark, str(tmp_path / "g"), 20, undirected=True)
    assert both.edges.count() == 200
    with pytest.raises(GraphError):
        Graph.load(spark, str(tmp_path / "g"), 5)
    with pytest.raises(GraphError):
        Graph(frame(spark, [(0, 1, -1.0, 0)]), 3).validated()
    assert Counter(map(tuple, symmetrise(frame(spark, [(1, 1, 2.0, 0)])).collect())) == {(1, 1, 2.0, 0): 2}


def test_degrees_and_lists(spark):
    rows = some_edges(5)
    g = Graph(frame(spark, rows), 25)
    out = Counter(s for s, *_ in rows)
    assert {r.v: r.out_degree for r in g.out_degree().collect()} == {v: out[v] for v in range(25)}
    lists = defaultdict(list)
    for r in sorted(g.adjacency(segment=7).collect(), key=lambda r: (r.v, r.segment)):
        assert len(r.neighbours) <= 7
        lists[r.v] += [x.dst for x in r.neighbours]
    assert lists == {v: sorted(d for s, d, *_ in rows if s == v) for v in out}
    assert g.counts().first().asDict() == {"e_num": 300, "v_num": 25}
    empty = Graph(frame(spark, []), 3)
    assert {r.v: r.out_degree for r in empty.out_degree().collect()} == {0: 0, 1: 0, 2: 0}
    assert empty.adjacency().count() == 0


@pytest.mark.parametrize("parts", [1, 3, 4, 7])
def test_partition_plan(spark, parts):
    rows = some_edges(7)
    load = [5 + sum(s == v for s, *_ in rows) for v in range(25)]
    target = -(-sum(load) // parts)
    want, begin = [], 0
    for p in range(parts):
        end, n = begin, 0
        while end < 25 and (p == parts - 1 or n < target):
            n += load[end]
            end += 1
        want.append((p, begin, end, n))
        begin = end
    assert sorted(map(tuple, Graph(frame(spark, rows), 25).partition_plan(parts).collect())) == want


def test_running_sums(spark):
    rows = some_edges(8)
    got = running_sums(frame(spark, rows).selectExpr("*", "CAST(weight AS BIGINT) AS w"), ["src"], ["dst", "weight"], "w", buckets=3).collect()
    by = defaultdict(list)
    for s, d, w, _ in rows:
        by[s].append((d, int(w)))
    want = Counter()
    for s, own in by.items():
        n = 0
        for d, w in sorted(own):
            n += w
            want[s, d, w, n, sum(w for _, w in own), len(own)] += 1
    assert Counter((r.src, r.dst, r.w, r.hi, r.tot, r.deg) for r in got) == want


def test_cells_cover_every_draw_once(spark):
    g = Graph(frame(spark, [(0, 1, 0.00001, 0), (0, 2, 1000.0, 0), (0, 3, 0.5, 0), (1, 0, 3.0, 0), (1, 0, 1.0, 0)]), 4)
    cdf = static.intervals(g, "weight").cache()
    cells = [r.asDict() for r in static.cells(cdf, static.vertex_totals(cdf)).collect()]
    tot = {r.v: (r.tot, r.deg) for r in static.vertex_totals(cdf).collect()}
    rnd = random.Random(1)
    for v, (t, deg) in tot.items():
        for r in [0, t - 1, *[rnd.randrange(t) for _ in range(300)]]:
            k = int(float(r) * (float(deg) / float(t)))
            assert len([c for c in cells if c["src"] == v and c["cell"] == k and c["lo"] <= r < c["hi"]]) == 1
    assert len(cells) <= 2 * 5


@pytest.mark.parametrize("undirected", [True, False])
def test_random_graphs(spark, undirected):
    from wanderframe.sources.random_graphs import random_edges

    rows = [tuple(r) for r in random_edges(spark, 30, 100, undirected).collect()]
    assert len(rows) == 100 and len({r[:2] for r in rows}) == 100
    assert all(a != b and 0 <= a < 30 and 0 <= b < 30 and w in (1, 2, 3, 4, 5) and 0 <= t < 5 for a, b, w, t in rows)
    assert sorted(rows) == sorted(tuple(r) for r in random_edges(spark, 30, 100, undirected).repartition(3).collect())
    if undirected:
        assert {r[:2] for r in rows} == {(b, a) for a, b, *_ in rows}
    full = [tuple(r) for r in random_edges(spark, 5, 20, undirected).collect()]
    assert {r[:2] for r in full} == {(a, b) for a in range(5) for b in range(5) if a != b} and len(full) == 20
    with pytest.raises(ValueError):
        random_edges(spark, 5, 22, undirected)


@pytest.mark.parametrize("weights", [[1e-7, 3e-7, 1e-6], [1e-300, 2e-300], [1e308, 1e308, 5e307], [5e-324, 5e-324], [1.0, 1e-20], [1e13, 2.5e13, 1.0], [3.0] * 8])
def test_weights_of_any_magnitude_keep_their_shares(spark, weights):
    from wanderframe.operators import analytics

    rows = [(0, k, w, 0) for k, w in enumerate(weights)] + [(0, 90, None, 0), (0, 91, 0.0, 0), (0, 92, float("nan"), 0), (0, 93, float("inf"), 0)]
    g = Graph(frame(spark, rows), 100)
    got = {r.dst: (r.w, r.tot) for r in static.intervals(g, "weight").collect()}
    assert set(got) == set(range(len(weights))) and all(w >= 1 for w, _ in got.values())
    assert sum(w for w, _ in got.values()) == got[0][1] < 1 << 51
    exact = {r.dst: r.prob for r in analytics.transition_matrix(g.edges).collect()}
    biggest = max(weights)
    for k, w in enumerate(weights):
        share = (w / biggest) / sum(x / biggest for x in weights)
        assert abs(got[k][0] / got[k][1] - share) < 1e-14
        assert biggest < 1e-9 or biggest > 1e300 or abs(exact[k] - share) < 1e-14


def test_scaled_weights_are_the_same_in_sql(spark, tmp_path):
    import duckdb

    rnd = random.Random(4)
    rows = [(rnd.randrange(6), k, rnd.choice([rnd.random() * 10.0 ** rnd.randint(-9, 12), float(rnd.randint(1, 64)), 0.0, -1.0, None]), 0) for k in range(400)]
    df = frame(spark, rows).repartition(3)
    df.write.parquet(str(tmp_path / "e"))
    want = Counter(duckdb.sql(f"SELECT src, dst, w FROM ({static.scaled_sql(f"SELECT * FROM '{tmp_path}/e/*.parquet'", 'weight')}) WHERE w > 0").fetchall())
    assert Counter((r.src, r.dst, r.w) for r in static.intervals(Graph(df), "weight").collect()) == want


def test_hub_with_close_neighbours_is_divided(spark):
    """The ranges follow the rows, so a hub's neighbours are spread over them however close their ids lie."""
    from wanderframe.operators.graph import bounds_of, part_of
    from pyspark.sql import functions as F

    df = spark.range(3000).selectExpr("CASE WHEN id < 1000 THEN 10000000 + id ELSE id * 1000000000 END AS dst")
    sizes = [r["count"] for r in df.groupBy(part_of(F.col("dst"), bounds_of(df, "dst", 64)).alias("b")).count().collect()]
    assert len(sizes) == 64 and max(sizes) < 2 * 3000 / 64


def test_alias_table_stands_for_the_weights(spark):
    rnd = random.Random(9)
    rows = [(s, d, rnd.choice([0.001, 1.0, 2.0, 1000.0]) * rnd.random(), 0) for s in range(4) for d in rnd.sample(range(200), 1 + s * 40)] + [(7, d, 1.0, 0) for d in range(5)]
    table = static.alias_table(Graph(frame(spark, rows), 200), "weight").collect()
    buckets, mass, total = Counter(), defaultdict(float), defaultdict(float)
    for s, _, w, _ in rows:
        total[s] += w
    for r in table:
        buckets[r.src] += 1
        assert 0 <= r.p <= 1 + 1e-12
        mass[r.src, r.first] += r.p
        if r.second is not None:
            mass[r.src, r.second] += 1 - r.p
    assert buckets == Counter(s for s, *_ in rows)
    assert all(abs(mass[s, d] / buckets[s] - w / total[s]) < 1e-12 for s, d, w, _ in rows)
