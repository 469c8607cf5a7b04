"""The walks that come ready: each function gives a walk's specification, to be run by plans.engine.random_walk."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame

from wanderframe.operators.graph import Graph
from wanderframe.plans.spec import Component, Query, Transition
from wanderframe.sources.edges import scheme_rows

TAGS = 4
NO_VERTEX = -1


def up_to(length: int | str) -> Component:
    """Goes on while fewer than `length` moves were made; a string names a column of the walkers."""
    if isinstance(length, str):
        return Component(f"CASE WHEN step < {length} THEN 1.0 ELSE 0.0 END", lambda **k: np.where(k["step"] < k[length], 1.0, 0.0))
    return Component(f"CASE WHEN step < {length} THEN 1.0 ELSE 0.0 END", lambda **k: np.where(k["step"] < length, 1.0, 0.0))


def weight_of(weighted: bool) -> str | None:
    return "weight" if weighted else None


def deepwalk(length: int | str, weighted: bool = False) -> Transition:
    return Transition(up_to(length), weight_of(weighted))


biased_walk = deepwalk


def ppr(stop: float, weighted: bool = False) -> Transition:
    """Stops with probability `stop` before every move."""
    if not 0 <= stop <= 1:
        raise ValueError("the probability to stop must be between 0 and 1")
    return Transition(1.0 - stop, weight_of(weighted))


def simple_walk() -> Transition:
    return ppr(0.125)


def previous(**more: Component) -> dict:
    """State that remembers the last vertex."""
    return {
        "init": {"prev": Component(f"CAST({NO_VERTEX} AS BIGINT)"), **{k: c for k, (c, _) in more.items()}},
        "update": {"prev": Component("v", lambda **k: k["v"]), **{k: c for k, (_, c) in more.items()}},
    }


def dynamic_walk(length: int | str, weighted: bool = True) -> tuple[dict, Transition]:
    """Returning to the last vertex is twice as likely."""
    d = Component("CASE WHEN step > 0 AND dst = prev THEN 2.0 ELSE 1.0 END", lambda **k: np.where((k["step"] > 0) & (k["dst"] == k["prev"]), 2.0, 1.0))
    return previous(), Transition(up_to(length), weight_of(weighted), d, 2.0, 1.0)


def node2vec(length: int | str, p: float | str, q: float | str, weighted: bool = True) -> tuple[dict, Transition]:
    """Second order: 1/p back to the last vertex, 1 to its out-neighbours, 1/q elsewhere.  p and q may name walker columns."""
    if not isinstance(p, str) and not isinstance(q, str) and (p <= 0 or q <= 0):
        raise ValueError("p and q must be positive")
    back, far = (f"(CAST(1.0 AS DOUBLE) / CAST({x} AS DOUBLE))" for x in (p, q))

    def value(x: float | str, k: dict) -> object:
        return 1.0 / (k[x] if isinstance(x, str) else float(x))

    ub = Component(f"greatest(CAST(1.0 AS DOUBLE), {far})", lambda **k: np.maximum(1.0, value(q, k)))
    lb = Component(f"CASE WHEN prev < 0 THEN greatest(CAST(1.0 AS DOUBLE), {far}) ELSE least(CAST(1.0 AS DOUBLE), {back}, {far}) END", lambda **k: np.where(k["prev"] < 0, np.maximum(1.0, value(q, k)), np.minimum(1.0, np.minimum(value(p, k), value(q, k)))))
    d = Component(
        f"CASE WHEN prev < 0 THEN greatest(CAST(1.0 AS DOUBLE), {far}) WHEN dst = prev THEN {back} WHEN linked THEN CAST(1.0 AS DOUBLE) ELSE {far} END",
        lambda **k: np.where(k["prev"] < 0, np.maximum(1.0, value(q, k)), np.where(k["dst"] == k["prev"], value(p, k), np.where(k["linked"], 1.0, value(q, k)))),
    )
    asks = Component("prev >= 0 AND dst <> prev")
    rising: dict = {}
    if isinstance(p, str) or isinstance(q, str) or 1 / p > max(1.0, 1 / q):  # the way back may exceed the bound
        rising = {
            "outlier": Component("dst = prev", lambda **k: k["dst"] == k["prev"]),
            "outlier_upper": Component(back, lambda **k: value(p, k)),
            "outlier_key": ("dst", Component("prev", lambda **k: k["prev"])),
        }
    return previous(), Transition(up_to(length), weight_of(weighted), d, ub, lb, second_order=True, asks=asks, **rising)


class Schemes:
    """Metapath schemes: which edge types are allowed at each position of each scheme."""

    def __init__(self, rows: Iterable[tuple[int, int, int, bool]]) -> None:
        masks: dict[tuple[int, int], int] = {}
        for scheme, pos, etype, allowed in rows:
            if not 0 <= etype <= 62:
                raise ValueError(f"edge type {etype} does not fit a mask of 63 types")
            masks[scheme, pos] = masks.get((scheme, pos), 0) | (1 << etype if allowed else 0)
        self.lengths = [0] * (1 + max((s for s, _ in masks), default=-1))
        for s, pos in masks:
            self.lengths[s] = max(self.lengths[s], pos + 1)
        if not self.lengths or 0 in self.lengths:
            raise ValueError("schemes must be numbered from 0 on and have at least one position each")
        self.offsets = [sum(self.lengths[:s]) for s in range(len(self.lengths))]
        self.masks = [masks.get((s, j), 0) for s, n in enumerate(self.lengths) for j in range(n)]

    @classmethod
    def of(cls, df: DataFrame, most: int = 100_000) -> Schemes:
        """Schemes are given by the caller and compiled into the plan; a table beyond `most` rows is refused."""
        return cls(scheme_rows(df, most))

    @property
    def mask_sql(self) -> str:
        """The mask at the walker's position: masks[offset[scheme] + step % length[scheme]]."""
        arr = lambda xs: "array(" + ", ".join(f"{x}L" for x in xs) + ")"
        of = lambda xs: f"element_at({arr(xs)}, CAST(scheme AS INT) + 1)"
        return f"element_at({arr(self.masks)}, CAST({of(self.offsets)} + step % {of(self.lengths)} AS INT) + 1)"

    def mask(self, **k: np.ndarray) -> np.ndarray:
        scheme = k["scheme"].astype(np.int64)
        return np.array(self.masks, np.int64)[np.array(self.offsets)[scheme] + k["step"] % np.array(self.lengths)[scheme]]


def metapath(graph: Graph, schemes: Schemes, length: int | str, weighted: bool = True, scheme: str | None = None) -> tuple[Graph, dict, Transition]:
    """Edges of the types that the walker's scheme allows at its position; stops where there are none.

    scheme names a column of the walkers; without it each walker draws one.  The graph comes back with the
    mask of each vertex's out-edge types that can be drawn, which the extension component reads.
    """
    usable = Graph(graph.edges.where("weight > 0") if weighted else graph.edges, graph.v_num)
    masks = usable.type_masks().withColumnRenamed("mask", "types")
    at = schemes.mask_sql
    stop = up_to(length)
    n = len(schemes.lengths)
    ext = Component(
        f"CASE WHEN ({stop.sql}) > 0 AND (coalesce(at_types, 0L) & {at}) <> 0 THEN 1.0 ELSE 0.0 END",
        lambda **k: np.where((stop.vector(**k) > 0) & ((np.nan_to_num(k["at_types"].astype(float)).astype(np.int64) & schemes.mask(**k)) != 0), 1.0, 0.0),
    )

    def allowed(**k: np.ndarray) -> np.ndarray:
        etype = k["etype"].astype(float)
        known = (etype >= 0) & (etype <= 62)
        return np.where(known & ((schemes.mask(**k) >> np.where(known, etype, 0).astype(np.int64)) & 1 == 1), 1.0, 0.0)

    d = Component(f"CASE WHEN etype BETWEEN 0 AND 62 AND (shiftright({at}, etype) & 1L) = 1 THEN 1.0 ELSE 0.0 END", allowed)
    init = {"scheme": Component(f"CAST({scheme} AS BIGINT)" if scheme else f"u_scheme % {n}")}
    return Graph(graph.edges, graph.v_num, masks), {"init": init}, Transition(ext, weight_of(weighted), d, 1.0)


def asked_when_moved() -> Query:
    """Asks the last vertex for itself and its attributes, from the second move on."""
    return Query(Component("prev", lambda **k: k["prev"]), Component("step > 0", lambda **k: k["step"] > 0))


def tag_walk(length: int, vertex_weight: float = 1.0, amplifier: float | None = None, weighted: bool = True, order: int = 1) -> tuple[dict, Transition]:
    """Tags of the last vertex, the walker and the edge decide; needs the vertex attribute `tag` and edges with `etype` as tag.

    Without an amplifier the bounds depend on the vertex; with one, edges of the walker's tag are outliers.  Of first
    order the walker carries the last vertex's tag, of second order it asks for it.
    """
    c = float(vertex_weight)
    last = "last_tag" if order == 1 else "re_tag"
    query = None if order == 1 else asked_when_moved()
    more = {
        "tag": (Component(f"wid % {TAGS}"), Component(f"(tag + 1) % {TAGS}", lambda **k: (k["tag"] + 1) % TAGS)),
        "last_tag": (Component("CAST(0 AS BIGINT)"), Component("at_tag", lambda **k: k["at_tag"])),
    }
    if order != 1:
        del more["last_tag"]
    mixed = f"CAST(1 + ({last} + tag + etype) % {TAGS} AS DOUBLE)"
    base = lambda k: 1.0 + (k[last] + k["tag"] + k["etype"]) % TAGS
    if amplifier is None:
        d = Component(f"CASE WHEN step = 0 THEN CAST({TAGS} AS DOUBLE) ELSE {mixed} + at_tag * CAST({c!r} AS DOUBLE) END", lambda **k: np.where(k["step"] == 0, float(TAGS), base(k) + k["at_tag"] * c))
        ub = Component(f"{TAGS} + at_tag * CAST({c!r} AS DOUBLE)", lambda **k: TAGS + k["at_tag"] * c)
        lb = Component(f"at_tag * CAST({c!r} AS DOUBLE)", lambda **k: k["at_tag"] * c)
        return previous(**more), Transition(up_to(length), weight_of(weighted), d, ub, lb, query=query)
    a = float(amplifier)
    d = Component(
        f"CASE WHEN step = 0 THEN CAST({TAGS} AS DOUBLE) ELSE {mixed} * CASE WHEN tag = etype THEN CAST({a!r} AS DOUBLE) ELSE CAST(1.0 AS DOUBLE) END END",
        lambda **k: np.where(k["step"] == 0, float(TAGS), base(k) * np.where(k["tag"] == k["etype"], a, 1.0)),
    )
    outlier = Component("step > 0 AND tag = etype", lambda **k: (k["step"] > 0) & (k["tag"] == k["etype"]))
    key = ("etype", Component("CASE WHEN step > 0 THEN tag END", lambda **k: np.where(k["step"] > 0, k["tag"], -1)))
    return previous(**more), Transition(up_to(length), weight_of(weighted), d, float(TAGS), 1.0, TAGS * a, outlier, key, query)


MAGIC = 10_000_007
LIMB = 1 << 32


def hash_walk(length: int, weighted: bool = True, order: int = 1) -> tuple[dict, Transition]:
    """Carries a 64-bit hash of its path, held in two 32-bit limbs so that nothing overflows; the hash steers the choice.

    Of second order the last vertex is asked for its id.
    """
    last = "prev" if order == 1 else "re_v"
    first_low, first_high = f"(wid * {MAGIC} + v) % {LIMB}", f"CAST(floor((wid * {MAGIC} + v) / CAST({LIMB} AS DOUBLE)) AS BIGINT) % {LIMB}"
    low = f"((low * {MAGIC} + wid) % {LIMB})"
    more = {
        "low": (Component(first_low), Component(f"{low} ^ dst", lambda **k: ((k["low"] * MAGIC + k["wid"]) % LIMB) ^ k["dst"])),
        "high": (
            Component(first_high),
            Component(f"(high * {MAGIC} + shiftright(low * {MAGIC} + wid, 32)) % {LIMB}", lambda **k: (k["high"] * MAGIC + ((k["low"] * MAGIC + k["wid"]) >> 32)) % LIMB),
        ),
    }
    d = Component(
        f"CASE WHEN step = 0 THEN CAST(3.0 AS DOUBLE) ELSE CAST(1 + ((high % 3 + low % 3) % 3 + ({last} ^ dst)) % 2 AS DOUBLE) END",
        lambda **k: np.where(k["step"] == 0, 3.0, 1.0 + ((k["high"] % 3 + k["low"] % 3) % 3 + (np.nan_to_num(k[last]).astype(np.int64) ^ k["dst"])) % 2),
    )
    return previous(**more), Transition(up_to(length), weight_of(weighted), d, 3.0, 1.0, query=None if order == 1 else asked_when_moved())
