"""What a walk is: starts, state, and the three components of its transitions.

Components are SQL expressions, so Catalyst compiles them.  They may name
    wid, step, v      the walker, its number of moves so far, its vertex
    dst, weight, …    the candidate edge and its columns
    linked            second order: whether (prev, dst) is an edge
    re_<c>            second order: what the asked vertex answers (see Query)
    at_<a>, to_<a>    attributes of the current vertex and of dst
    <state>, <column> the walker's state and the columns of its start row
A component may also bring a NumPy twin (`vector`), called with the same names
as keyword arguments in arrays; with twins for all its components a walk can
run inside tasks over a broadcast graph.  `opaque` makes both from one function.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Component:
    sql: str
    vector: Callable | None = None


def component(x: Component | str | float | None) -> Component | None:
    if x is None or isinstance(x, Component):
        return x
    if isinstance(x, str):
        return Component(x)
    value = float(x)
    return Component(f"CAST({value!r} AS DOUBLE)", lambda **_: value)


def opaque(spark: SparkSession, function: Callable, *columns: str, returns: str = "double") -> Component:
    """A component that SQL can't say: `function` gets the named columns as NumPy arrays and gives an array.

    One function serves both ways a walk runs: as a pandas UDF in its plans, and as the NumPy twin in its tasks.
    """
    name = f"opaque_{uuid.uuid4().hex[:12]}"

    @F.pandas_udf(returns)
    def called(*series: pd.Series) -> pd.Series:
        return pd.Series(np.broadcast_to(function(*[x.to_numpy() for x in series]), (len(series[0]),)))

    spark.udf.register(name, called)
    return Component(f"{name}({', '.join(columns)})", lambda **k: function(*[k[c] for c in columns]))


@dataclass
class Query:
    """Second order: what a walker asks another vertex before it weighs a candidate.

    vertex names the vertex that is asked, such as `prev`, and when says whether there is anything to ask.  Without
    a table the answer is the vertex itself: re_v, re_tot, re_deg and its attributes as re_<a>.  A table (v, …) has
    one row of answers for each vertex, with a key (v, key, …) one for each vertex and value of `key`, which may
    name the walker's and the candidate's columns; its other columns are the answers.  Where nothing was asked or
    nothing is known, the answers are null.
    """

    vertex: Component | str = "prev"
    when: Component | str = "prev >= 0"
    table: DataFrame | None = None
    key: Component | str | None = None

    def __post_init__(self) -> None:
        self.vertex, self.when, self.key = component(self.vertex), component(self.when), component(self.key)
        if self.key is not None and self.table is None:
            raise ValueError("a key asks for an entry of a table")
        if self.table is not None and (missing := {"v", *["key"] * (self.key is not None)} - set(self.table.columns)):
            raise ValueError(f"the table of answers lacks {sorted(missing)}")


@dataclass
class WalkerConfig:
    """Walkers are `num` ids from 0 on, or the rows (wid, start, …) of a table.

    starts: "equal" (wid % v_num), "uniform", or a list (list[wid % its length]).
    init and update give the state: name -> component.  update sees the old
    vertex as v, the new one as dst, and step already counted up.
    """

    num: int | None = None
    table: DataFrame | None = None
    starts: str | list[int] = "equal"
    init: dict[str, Component | str] = field(default_factory=dict)
    update: dict[str, Component | str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if (self.num is None) == (self.table is None):
            raise ValueError("give either a number of walkers or a table of them")
        if self.num is not None and self.num < 0:
            raise ValueError("the number of walkers must not be negative")
        if isinstance(self.starts, str) and self.starts not in ("equal", "uniform"):
            raise ValueError(f"unknown start distribution {self.starts!r}")
        if not isinstance(self.starts, str) and not self.starts:
            raise ValueError("the list of starts is empty")
        self.init = {k: component(x) for k, x in self.init.items()}
        self.update = {k: component(x) for k, x in self.update.items()}
        if unknown := set(self.update) - set(self.init):
            raise ValueError(f"state without an initial value: {sorted(unknown)}")


@dataclass
class Transition:
    """P(edge) is proportional to static * dynamic; a walker goes on with probability `extend`.

    upper bounds dynamic at a vertex and is required with it; lower lets a
    candidate be accepted without the second-order lookup.  outlier_upper and
    outlier belong together: the edges that `outlier` selects may exceed
    `upper` and are bounded by outlier_upper.  With outlier_key, which says the
    same as an equation (of the edge's columns, of the walker's), what they
    exceed is drawn apart: a candidate comes from all edges under `upper`, or
    from the outliers under the rest, in proportion to both areas, so few
    candidates are rejected however far the outliers rise.
    """

    extend: Component | str | float | None = None
    static: str | None = None
    dynamic: Component | str | None = None
    upper: Component | str | float | None = None
    lower: Component | str | float | None = None
    outlier_upper: Component | str | float | None = None
    outlier: Component | str | None = None
    outlier_key: tuple[str, Component | str] | None = None
    query: Query | None = None
    second_order: bool = False
    #: Second order: when the lookup is needed at all, such as `prev >= 0`.
    asks: Component | str | None = None

    def __post_init__(self) -> None:
        for name in ("extend", "dynamic", "upper", "lower", "outlier_upper", "outlier", "asks"):
            setattr(self, name, component(getattr(self, name)))
        if self.extend is None:
            raise ValueError("a transition needs an extension component")
        if self.dynamic is not None and self.upper is None:
            raise ValueError("a dynamic component needs an upper bound")
        if self.dynamic is None and any(x is not None for x in (self.upper, self.lower, self.outlier_upper, self.outlier)):
            raise ValueError("bounds and outliers mean nothing without a dynamic component")
        if (self.outlier_upper is None) != (self.outlier is None):
            raise ValueError("an outlier bound and the outlier search belong together")
        if self.outlier_key is not None:
            if self.outlier is None:
                raise ValueError("a key of outliers needs their bound and their condition")
            self.outlier_key = (self.outlier_key[0], component(self.outlier_key[1]))
        if (self.second_order or self.query is not None) and self.dynamic is None:
            raise ValueError("a second-order walk needs a dynamic component")
        if self.asks is not None and not self.second_order:
            raise ValueError("only a second-order walk asks another vertex")

    def validate(self, walkers: WalkerConfig) -> None:
        """What only shows with the walkers: whose edges a second-order walk looks up."""
        known = {*walkers.init, *(walkers.table.columns if walkers.table is not None else [])}
        if self.second_order and "prev" not in known:
            raise ValueError("a second-order walk needs the state `prev`")

    @property
    def bound(self) -> Component | None:
        """The bound under which candidates are drawn from all edges: of outliers too, unless these are drawn apart."""
        return self.upper if self.outlier_key is not None else self.most

    @property
    def most(self) -> Component | None:
        """The bound of every edge, outliers included."""
        if self.outlier_upper is None:
            return self.upper
        a, b = self.upper, self.outlier_upper
        both = None if a.vector is None or b.vector is None else lambda **k: np.maximum(a.vector(**k), b.vector(**k))
        return Component(f"greatest({a.sql}, {b.sql})", both)


@dataclass
class WalkConfig:
    """How a walk runs and where it goes.

    With a rate below 1 the walkers go in epochs, one after another: each is walked, written to `output`, and handed
    to `consumer` before the next begins.  discard then frees its rows, and the walk gives none back.
    """

    rate: float = 1.0
    strategy: str = "auto"
    output: str | None = None
    with_head: bool = False
    consumer: Callable[[DataFrame, int], None] | None = None
    discard: bool = False
    check_bounds: bool = False
    max_steps: int = 100_000

    def __post_init__(self) -> None:
        if not 0 < self.rate <= 1:
            raise ValueError("the rate must be above 0 and at most 1")
        if self.discard and not (self.output or self.consumer):
            raise ValueError("rows that nobody takes are not discarded")
        if self.strategy not in ("auto", "tasks", "supersteps", "recursive"):
            raise ValueError(f"unknown strategy {self.strategy!r}")
