"""SQL text of the walks for an independent engine: one recursive query each, with the same generator."""

from __future__ import annotations

from wanderframe.functions import rng
from wanderframe.plans.static import scaled_sql


def walk_sql(
    edges: str,
    seeds: str,
    extend: str,
    static: str | None = None,
    dynamic: str | None = None,
    bound: str = "1.0",
    init: dict[str, str] | None = None,
    update: dict[str, str] | None = None,
    second_order: bool = False,
    extra: str = "",
    columns: str = "wid, step, v",
    payload: str = "",
    ctes: str = "",
    finish: str | None = None,
    apart: tuple[str, str, str] | None = None,
) -> str:
    """edges: SELECT src, dst[, payload]; seeds: SELECT wid, v[, columns].

    Each level of the recursion is one attempt of every walker that is still on its way: an accepted
    candidate is a move (attempt 0 of the next step), a rejected one counts the attempt up.
    extra joins more tables to the walkers (alias d) before the candidate is drawn.
    apart: (expression of the outlier edges, of the walkers they belong to, their bound); what outliers have above
    `bound` is drawn from their own intervals.
    """
    if apart is not None:
        return apart_sql(edges, seeds, extend, static, dynamic, bound, init, update, second_order, payload, apart)
    init, update = init or {}, update or {}
    weighed = f"SELECT *, CAST(1 AS BIGINT) AS w FROM ({edges})" if static is None else scaled_sql(edges, static)
    order = "dst" + "".join(f", {c} NULLS FIRST" for c in payload.split(",") if c.strip())
    begin = "".join(f", {x} AS {k}" for k, x in init.items())
    seed = rng.sql_draws(rng.sql_walker_hash(f"SELECT *, CAST(0 AS BIGINT) AS step FROM ({seeds})"), {"u_scheme": str(rng.SCHEME), "u_start": str(rng.START)})
    draws = rng.sql_draws("SELECT * FROM walk", {"x": str(rng.EXTEND), "y1": f"(a * {rng.PER_ATTEMPT} + {rng.EDGE})", "y2": f"(a * {rng.PER_ATTEMPT} + {rng.EDGE + 1})", "y3": f"(a * {rng.PER_ATTEMPT} + {rng.EDGE + 2})"})
    accept = "true" if dynamic is None else f"y3 * ({bound}) < ({dynamic}) * CAST({rng.P} AS DOUBLE)"
    link = "LEFT JOIN pairs ON pairs.p = d.prev AND pairs.x = c.dst" if second_order else ""
    linked = ", pairs.p IS NOT NULL AS linked" if second_order else ""
    more = "".join(f", c.{c.strip()}" for c in payload.split(",") if c.strip())
    gone = (", linked" if second_order else "") + more.replace(" c.", " ")
    after = "".join(f", CASE WHEN took THEN {x} ELSE {k} END AS {k}" for k, x in update.items())
    return f"""
WITH RECURSIVE {ctes}
e AS ({weighed}),
pairs AS (SELECT DISTINCT src AS p, dst AS x FROM e WHERE w > 0),
cdf AS MATERIALIZED (
  SELECT * EXCLUDE (w), CAST(sum(w) OVER (PARTITION BY src ORDER BY {order} ROWS UNBOUNDED PRECEDING) AS BIGINT) AS hi,
         CAST(sum(w) OVER (PARTITION BY src ORDER BY {order} ROWS UNBOUNDED PRECEDING) AS BIGINT) - w AS lo,
         CAST(sum(w) OVER (PARTITION BY src) AS BIGINT) AS tot FROM e WHERE w > 0),
start_rows AS MATERIALIZED (SELECT * FROM ({seed})),
walk AS (
  SELECT * EXCLUDE (u_scheme, u_start), CAST(0 AS BIGINT) AS a{begin} FROM start_rows
  UNION ALL
  SELECT * EXCLUDE (x, y1, y2, y3, dst, took{gone})
         REPLACE (CASE WHEN took THEN step + 1 ELSE step END AS step, CASE WHEN took THEN dst ELSE v END AS v, CASE WHEN took THEN 0 ELSE a + 1 END AS a{after})
  FROM (SELECT *, {accept} AS took FROM (
    SELECT d.*, c.dst{more}{linked} FROM ({draws}) d JOIN cdf c ON c.src = d.v
      AND (d.y1 * {rng.P} + d.y2) % c.tot >= c.lo AND (d.y1 * {rng.P} + d.y2) % c.tot < c.hi {link} {extra}
    WHERE d.a > 0 OR d.x < ({extend}) * CAST({rng.P} AS DOUBLE)) z) zz
)
{finish or f'SELECT {columns} FROM walk WHERE a = 0'}"""


def apart_sql(edges: str, seeds: str, extend: str, static: str | None, dynamic: str, bound: str, init: dict[str, str], update: dict[str, str], second_order: bool, payload: str, apart: tuple[str, str, str]) -> str:
    """The walk with two kinds of candidates: kind 0 from all of a vertex's edges, kind 1 from its outliers."""
    weighed = f"SELECT *, CAST(1 AS BIGINT) AS w FROM ({edges})" if static is None else scaled_sql(edges, static)
    own = [c.strip() for c in payload.split(",") if c.strip()]
    order = "dst" + "".join(f", {c} NULLS FIRST" for c in own)
    begin = "".join(f", {x} AS {k}" for k, x in init.items())
    seed = rng.sql_draws(rng.sql_walker_hash(f"SELECT *, CAST(0 AS BIGINT) AS step FROM ({seeds})"), {"u_scheme": str(rng.SCHEME)})
    salts = {"y1": rng.EDGE, "y2": rng.EDGE + 1, "y3": rng.DART, "y4": rng.REGION}
    draws = rng.sql_draws("SELECT * FROM walk", {"x": str(rng.EXTEND)} | {n: f"(a * {rng.PER_ATTEMPT} + {k})" for n, k in salts.items()})
    gone = "x, y1, y2, y3, y4, key, tot, area_tot, ub, rise, kind, dst, took" + "".join(f", {c}" for c in own) + (", linked" if second_order else "")
    after = "".join(f", CASE WHEN took THEN {x} ELSE {k} END AS {k}" for k, x in update.items())
    intervals = "CAST(sum(w) OVER (PARTITION BY {by} ORDER BY {order} ROWS UNBOUNDED PRECEDING) AS BIGINT) AS hi, CAST(sum(w) OVER (PARTITION BY {by}) AS BIGINT) AS tot"
    area = "(area_tot * rise)"
    return f"""
WITH RECURSIVE e AS ({weighed}),
k AS (SELECT *, CAST({apart[0]} AS BIGINT) AS key FROM e WHERE w > 0),
pairs AS (SELECT DISTINCT src AS p, dst AS x FROM k),
cdf AS MATERIALIZED (
  SELECT 0 AS kind, CAST(-1 AS BIGINT) AS grp, * EXCLUDE (key), {intervals.format(by="src", order=order)} FROM k
  UNION ALL SELECT 1, key, * EXCLUDE (key), {intervals.format(by="src, key", order=order)} FROM k WHERE key IS NOT NULL),
tots AS (SELECT kind, src, grp, max(tot) AS tot FROM cdf GROUP BY 1, 2, 3),
start_rows AS MATERIALIZED (SELECT * FROM ({seed})),
walk AS (
  SELECT * EXCLUDE (u_scheme), CAST(0 AS BIGINT) AS a{begin} FROM start_rows
  UNION ALL
  SELECT * EXCLUDE ({gone})
         REPLACE (CASE WHEN took THEN step + 1 ELSE step END AS step, CASE WHEN took THEN dst ELSE v END AS v, CASE WHEN took THEN 0 ELSE a + 1 END AS a{after})
  FROM (SELECT *, CASE WHEN kind = 1 THEN y3 * rise < (CAST({dynamic} AS DOUBLE) - ub) * {rng.P} ELSE y3 * ub < CAST({dynamic} AS DOUBLE) * {rng.P} END AS took FROM (
    SELECT d.*, c.dst{"".join(f", c.{x}" for x in own)}{", pairs.p IS NOT NULL AS linked" if second_order else ""} FROM (
      SELECT *, CASE WHEN y4 * (CAST(tot AS DOUBLE) * ub + {area}) < {area} * {rng.P} THEN 1 ELSE 0 END AS kind FROM (
        SELECT d.*, t.tot, CAST(coalesce(o.tot, 0) AS DOUBLE) AS area_tot, greatest(CAST({apart[2]} AS DOUBLE) - ub, 0) AS rise FROM (
          SELECT *, CAST({apart[1]} AS BIGINT) AS key, CAST({bound} AS DOUBLE) AS ub FROM ({draws}) WHERE a > 0 OR x < ({extend}) * CAST({rng.P} AS DOUBLE)) d
        JOIN tots t ON t.kind = 0 AND t.src = d.v LEFT JOIN tots o ON o.kind = 1 AND o.src = d.v AND o.grp = d.key)) d
    JOIN cdf c ON c.src = d.v AND c.kind = d.kind AND c.grp = CASE WHEN d.kind = 1 THEN d.key ELSE -1 END
      AND (d.y1 * {rng.P} + d.y2) % c.tot >= c.hi - c.w AND (d.y1 * {rng.P} + d.y2) % c.tot < c.hi
    {"LEFT JOIN pairs ON pairs.p = d.prev AND pairs.x = c.dst" if second_order else ""}))
)
SELECT wid, step, v FROM walk WHERE a = 0"""
