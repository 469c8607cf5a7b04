"""Co-occurrence, frequent values, format duplicates and packing against brute force on small tables."""

from __future__ import annotations

import itertools
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from wanderframe.llm import cooccur, dedup_format, frequent, packing


def brute_pairs(rows, least, lift):
    baskets, names = defaultdict(set), set()
    for b, i in rows:
        if b is not None:
            names.add(b)
            if i is not None:
                baskets[b].add(i)
    n, both = Counter(), Counter()
    for items in baskets.values():
        n.update(items)
        both.update(itertools.combinations(sorted(items), 2))
    return {(a, b, k) for (a, b), k in both.items() if k >= least and k * len(names) >= lift * n[a] * n[b]}


@pytest.mark.parametrize(("heavy", "least"), [(1000, 3), (6, 3), (3, 2)])
def test_pairs(spark, heavy, least):
    rnd = random.Random(heavy)
    rows = [(rnd.randrange(60), rnd.choice([rnd.randrange(4), rnd.randrange(30)])) for _ in range(500)]
    rows += [(b, 100 + k) for b in range(60, 66) for k in range(12)] + rows[:50] + [(None, 3), (5, None), (99, None)]
    df = spark.createDataFrame([(b, i, 1) for b, i in rows], "walker long, vertex long, n int")
    got = cooccur.common_baskets(df, "walker", "vertex", least, 2.0, heavy, block=40, held=50, tile=7).collect()
    assert {(r.item_a, r.item_b, r.n_ab) for r in got} == brute_pairs(rows, least, 2.0)
    assert len(got) == len({(r.item_a, r.item_b) for r in got})


@pytest.mark.parametrize("held", [1, 7, 10_000])
def test_gram_is_the_product_of_the_block(held):
    x = np.random.default_rng(held).random((40, 15)) < 0.3
    x[3], x[4] = False, True
    basket, item = np.nonzero(x)
    names = np.arange(15) * 10**17 - 5
    got = np.zeros((15, 15), int)
    for a, b, n in cooccur.transpose_products(basket, names[item], held):
        np.add.at(got, (np.searchsorted(names, a), np.searchsorted(names, b)), n)
    assert (got == np.triu(x.T.astype(int) @ x, 1)).all()
    assert not list(cooccur.transpose_products(basket[:0], item[:0]))


@pytest.mark.parametrize("size", [1, 3, 1000])
def test_distinct_cells(size):
    import pyarrow as pa

    rnd = random.Random(size)
    rows = sorted(((rnd.randrange(20), rnd.choice([None, *range(6)])) for _ in range(200)), key=lambda r: (r[0], r[1] is not None, r[1] or 0)) + [(30, None), (30, None), (31, 5)]
    cut = [rows[k : k + size] for k in range(0, len(rows), size)]
    got = [r for b in cooccur.distinct_cells(pa.RecordBatch.from_arrays([pa.array([x for x, _ in own], pa.int64()), pa.array([y for _, y in own], pa.int64())], ["b", "i"]) for own in cut) for r in zip(*b.to_pydict().values(), strict=True)]
    assert sorted((b, i) for b, i, *_ in got if i is not None) == sorted({r for r in rows if r[1] is not None})
    assert sum(fresh for *_, fresh in got) == len({b for b, _ in rows})
    for b in {b for b, _ in rows}:
        assert [nth for x, i, nth, _ in got if x == b and i is not None] == list(range(len({i for x, i in rows if x == b and i is not None})))


def test_baskets_of_5000_items(spark):
    """Twelve baskets hold 5,000 items each, and all their pairs come out."""
    rows = spark.range(12 * 5000).selectExpr("id DIV 5000 AS walker", "id % 5000 + id DIV 15000 AS vertex").union(spark.range(1000, 1400).selectExpr("id", "id % 2"))
    names = {b: set(range(b // 3, b // 3 + 5000)) for b in range(12)}
    got = cooccur.common_baskets(rows, "walker", "vertex", 10, 20.0, heavy=2000)
    n = got.selectExpr("count(*) AS pairs", "sum(n_ab) AS common").first()
    held = Counter(i for own in names.values() for i in own)
    often = sorted(i for i, k in held.items() if k + (i < 2) * 200 <= 412 / 20 and k >= 10)
    inside = np.array([[i in own for i in often] for own in names.values()], np.int32)
    product = np.triu(inside.T @ inside, 1)
    assert (n.pairs, n.common) == (int((product >= 10).sum()), int(product[product >= 10].sum())) and n.pairs > 12_000_000


def test_tiles_take_fixed_memory():
    import tracemalloc

    import pyarrow as pa

    tile, names = 100, np.arange(100)

    def batch(kind, basket, item, side):
        n = len(item)
        own = [np.zeros(n, np.int64), np.zeros(n, np.int64), np.full(n, kind), np.full(n, basket), item, np.full(n, side), item, np.zeros(n, np.int64), np.zeros(n, np.int64)]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in own], list("pqabcdefg"))

    def stream(baskets):
        for side in (0, 1):
            yield batch(0, 0, names, side)
        for k in range(baskets):
            for side in (0, 1):
                yield batch(1, k, names[k % 2 :: 2], side)

    peaks = []
    for baskets in (200, 4000):
        tracemalloc.start()
        found = list(cooccur.tile_products(10, tile)(stream(baskets)))
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        assert {n for b in found for n in b.column(2).to_pylist()} == {baskets // 2} and sum(b.num_rows for b in found) == 2 * 50 * 49 // 2
    assert peaks[1] < peaks[0] * 1.1


def test_pairs_of_nothing(spark):
    df = spark.createDataFrame([], "walker long, vertex long")
    assert cooccur.common_baskets(df, "walker", "vertex").count() == 0


def test_frequent(spark):
    rnd = random.Random(2)
    values = [rnd.choice([7, 7, 7, rnd.randrange(50), rnd.randrange(10_000)]) for _ in range(5000)] + [None] * 40
    df = spark.createDataFrame([(v, "x") for v in values], "vertex long, n string").repartition(5)
    n = Counter(v for v in values if v is not None)
    want = sorted(n.items(), key=lambda x: (-x[1], x[0]))
    assert [(r.value, r.n) for r in frequent.top_values(df, "vertex", 20, run=300).collect()] == want[:20]
    share = {r.value for r in frequent.above_share(df, "vertex", 0.005, run=300).collect()}
    assert share == {v for v, k in n.items() if k >= 0.005 * sum(n.values())}
    assert frequent.above_share(df.limit(0), "vertex", 0.01).count() == 0
    assert frequent.top_values(df.where("vertex IS NULL"), "vertex", 3).count() == 0


@pytest.mark.parametrize("kind", ["string", "timestamp", "date", "int"])
def test_frequent_values_of_other_types(spark, kind):
    df = spark.range(0, 3000, 1, 3).selectExpr(f"CAST({'id % 7' if kind == 'int' else {'string': chr(34) + 'v' + chr(34) + ' || id % 7', 'timestamp': 'timestamp_seconds(id % 7)', 'date': 'date_add(DATE ' + chr(34) + '2025-01-01' + chr(34) + ', CAST(id % 7 AS INT))'}[kind]} AS {kind}) AS x").union(spark.sql(f"SELECT CAST(NULL AS {kind})"))
    want = [tuple(r) for r in df.where("x IS NOT NULL").groupBy("x").count().orderBy("count", "x").collect()]
    want.sort(key=lambda r: (-r[1], r[0]))
    assert [(r.value, r.n) for r in frequent.top_values(df, "x", 5, run=100).collect()] == want[:5]
    with pytest.raises(TypeError):
        frequent.top_values(df.selectExpr("1.5D AS x"), "x", 3)


RECORDS = [
    (1, "src=ab12 dst=cd34 weight=4.5"),
    (2, '{"DST": "CD-34","Src": "a b 12", "Weight": "4.5"}'),
    (3, "[Weight] 4.5. [SRC] AB'12 [dst] cd::34"),
    (4, "src=ab12 dst=cd34 weight=45"),
    (5, "src=ab12 dst=cd34"),
    (6, "dst=ab12 src=cd34"),
    (7, "Src AB.12\tDST\tcd–34"),
    (8, None),
    (9, ""),
    (10, "src,ab1.2,dst,cd34"),
    (11, "src,ab12,dst,cd34,,"),
    (12, "“src” -> “AB12” <dsT>cd34</> "),
]


def test_format_duplicates(spark):
    df = spark.createDataFrame([(i, r, "x") for i, r in RECORDS], "rec_id long, record string, canon string")
    got = {(r.keep_id, r.copy_id) for r in dedup_format.copies(df).collect()}
    assert got == {(1, 2), (1, 3), (5, 7), (5, 11), (5, 12)}
    kept = {r.keep_id: r.n_copies for r in dedup_format.collapse(df).collect()}
    assert kept == {1: 3, 4: 1, 5: 4, 6: 1, 9: 1, 10: 1}
    assert dedup_format.copies(df.limit(0)).count() == 0 and dedup_format.collapse(df.limit(0)).count() == 0


def test_hot_group(spark, monkeypatch):
    monkeypatch.setattr(dedup_format, "RUN", 700)
    rows = [(k, "src=a1 dst=b2" if k % 3 == 0 else f"src=x{k // 4} dst=y") for k in range(3000)]
    df = spark.createDataFrame(rows, "rec_id long, record string")
    groups = defaultdict(list)
    for k, r in rows:
        groups[r].append(k)
    want = {(min(g), k) for g in groups.values() for k in g if k != min(g)}
    assert {tuple(r) for r in dedup_format.copies(df).collect()} == want


@pytest.mark.parametrize(("parts", "segments"), [(1, 1), (7, 1), (7, 3)])
def test_filter_has_no_false_negatives(spark, parts, segments):
    """One task sends bits, seven send hashes; both forms merge to a filter that holds what is there twice."""
    rnd = random.Random(1)
    values = [rnd.randrange(-(2**63), 2**63) for _ in range(60_000)]
    values += values[:9000]
    df = spark.createDataFrame([(v,) for v in values], "h long").repartition(parts)
    field = np.zeros(segments * dedup_format.SEGMENT // 8, np.uint8)
    for r in dedup_format.repeats_filter(df, "h", segments).collect():
        at = r.segment * dedup_format.SEGMENT // 8
        field[at : at + dedup_format.SEGMENT // 8] = np.frombuffer(r.again, np.uint8)
    h = np.array(values)
    hit = dedup_format.may_hold(field, h, dedup_format.place(h, segments) * dedup_format.SEGMENT)
    assert hit[:9000].all() and hit[60_000:].all() and hit[9000:60_000].mean() < 0.2


def test_shards(spark, monkeypatch):
    """Filters of several shards, with records written by shard, find the same copies."""
    monkeypatch.setattr(dedup_format, "SHARD", 1)
    df = spark.range(0, 240_000, 1, 4).selectExpr("id AS rec_id", "CASE WHEN id % 3 = 0 THEN 'SRC: a1; dst=b2' WHEN id % 10 = 1 THEN concat('dst ', id - 1, ' src') ELSE concat('dst=', id) END AS record")
    copies = dedup_format.copies(df)
    got = copies.selectExpr("count(*) AS n", "count(DISTINCT copy_id) AS d", "count_if(keep_id = 0) AS hot", "count_if(keep_id <> 0 AND copy_id - keep_id <> 1) AS odd").first()
    rest = [k for k in range(240_000) if k % 3 and k % 10 == 1 and (k - 1) % 3]
    assert tuple(got) == (79_999 + len(rest), 79_999 + len(rest), 79_999, 0)
    assert dedup_format.collapse(df).selectExpr("count(*)", "sum(n_copies)").first()[:] == (240_000 - 79_999 - len(rest), 240_000)


FORMATS = [
    ("[Weight] 4.5. [SRC] AB'12 [dst] cd::34", "dst=cd34|src=ab12|weight=4\ue0005"),
    ("src src a src b src", "src=a|src=b"),
    ("src b src a1 src a dst", "src=a|src=a1|src=b"),
    ("dst=.5 src=1.2.3. weight=5.", "dst=5|src=1\ue0002\ue0003|weight=5"),
    ("weightsrc 3.x", "?weightsrc3x"),
    ("src=٣.٥ dst=ΣΑΣ", "dst=σασ|src=٣\ue000٥"),
    ("src - dst -", "?srcdst"),
    ("", "?"),
    (".", "?"),
    ("\ue000src \ue0001", "src=1"),
    ("é" * 100_000 + " dst \U0001d7d8.1", "dst=\U0001d7d8\ue0001"),
]


def test_canonical_forms(monkeypatch):
    import pyarrow as pa

    records = pa.array([r for r, _ in FORMATS])
    for chunk in (1, 100, 1 << 22):
        monkeypatch.setattr(dedup_format, "CHUNK", chunk)
        assert dedup_format.canonical(records).to_pylist() == [c for _, c in FORMATS]
    assert dedup_format.canonical(records.slice(3, 2)).to_pylist() == [c for _, c in FORMATS[3:5]]
    assert len(dedup_format.canonical(records.slice(0, 0))) == 0


def test_fullest_is_the_best_sum():
    rnd = random.Random(4)
    for _ in range(200):
        counts = {rnd.randint(1, 30): rnd.randint(1, 3) for _ in range(6)}
        free = rnd.randint(0, 60)
        chosen = packing.fullest(free, counts, sorted(counts))
        sums = {0}
        for n, c in counts.items():
            sums = {s + n * k for s in sums for k in range(c + 1) if s + n * k <= free}
        assert sum(chosen) == max(sums)
        assert all(chosen.count(n) <= c for n, c in counts.items())


def test_packing(spark, monkeypatch):
    monkeypatch.setattr(packing, "BUCKET", 50)
    rnd = random.Random(6)
    sizes = {k: rnd.choice([0, rnd.randint(1, 99), 20, 30, rnd.randint(100, 450)]) for k in range(600)}
    df = spark.createDataFrame([(k, n, 5) for k, n in sizes.items()], "doc_id long, n_tokens long, part int")
    rows = packing.pack(df, "doc_id", "n_tokens", 100).collect()
    parts, fill = defaultdict(list), Counter()
    for r in rows:
        parts[r.doc_id].append((r.part_start, r.n_tokens))
        fill[r.container] += r.n_tokens
    assert all(sum(n for _, n in parts[k]) == size for k, size in sizes.items())
    assert all(len(parts[k]) == max(1, -(-size // 100)) for k, size in sizes.items())
    assert max(fill.values()) <= 100 and min(fill) >= 0
    assert sum(1 for n in fill.values() if n) <= -(-sum(sizes.values()) // 100) * 1.02 + 1
    assert packing.pack(df.limit(0), "doc_id", "n_tokens", 100).count() == 0
    only_empty = packing.pack(df.where("n_tokens = 0"), "doc_id", "n_tokens", 100)
    assert {r.container for r in only_empty.collect()} == {0}
