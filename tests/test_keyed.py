from __future__ import annotations

import math
import random
from collections import defaultdict

from wanderframe.operators import keyed


def test_totals_and_frequent(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice([1, 1, rnd.randrange(40)]), rnd.choice([None, 1.25, -0.5, 3.0, math.nan, math.inf])) for _ in range(3000)] + [(None, 2.0)] * 9 + [(999, None)]
    df = spark.createDataFrame([(k, w, 1, 2) for k, w in rows], "src long, weight double, vertex int, n int").repartition(5)
    degree, total = defaultdict(int), defaultdict(float)
    for k, w in rows:
        if k is not None:
            degree[k] += 1
            total[k] += w if w is not None and math.isfinite(w) else 0
    got = {r.vertex: (r.degree, r.sum_weight) for r in keyed.key_totals(df, "src", "weight").collect()}
    assert got == {k: (degree[k], round(total[k], 6)) for k in degree}
    hot = {r.vertex: r.n for r in keyed.frequent_keys(df, "src", 0.02).collect()}
    assert hot == {k: n for k, n in degree.items() if n >= 0.02 * sum(degree.values())}
    assert keyed.key_totals(df.limit(0), "src", "weight").count() == 0
    assert keyed.frequent_keys(df.limit(0), "src", 0.5).count() == 0


def test_plan_combines_before_the_shuffle(spark):
    df = spark.createDataFrame([(1, 1.0)], "src long, weight double")
    plan = keyed.key_totals(df, "src", "weight")._jdf.queryExecution().executedPlan().toString()
    assert "partial_count" in plan and "partial_sum" in plan


def test_sums_hold_every_finite_weight(spark):
    weights = {1: [1e15, 2.5], 2: [3e-7] * 10, 3: [1e308, 1e308, -1e308, None], 4: [5e-324], 5: [1e20, 1.0, -1e20, math.inf, -math.inf, math.nan], 6: [1e12, -1e12, 0.1234567], 7: [0.1, 0.2], 8: [math.nan, None]}
    df = spark.createDataFrame([(k, w) for k, own in weights.items() for w in own], "src long, weight double").repartition(3)
    got = {r.vertex: (r.degree, r.sum_weight) for r in keyed.key_totals(df, "src", "weight").collect()}
    want = {1: 1e15 + 2.5, 2: 3e-6, 3: 1e308, 4: 5e-324, 5: 1.0, 6: 0.1234567, 7: 0.3, 8: 0.0}
    assert {k: n for k, (n, _) in got.items()} == {k: len(own) for k, own in weights.items()}
    assert all(math.isclose(got[k][1], x, rel_tol=1e-12) for k, x in want.items())
