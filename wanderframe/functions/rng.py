"""A counter-based generator: pure integer arithmetic modulo 2^31 - 1.

A draw depends only on (walker, step, salt), so a walk is the same for every
partitioning, retry, epoch and strategy, and any SQL engine can repeat it.
x -> x^5 is a bijection modulo P because gcd(5, P - 1) = 1, and every product
stays below 2^62.  The three forms here (Spark columns, NumPy, SQL text) give
equal numbers.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

P = (1 << 31) - 1
# salts of the draws
EXTEND, START, SCHEME, EDGE, DART, REGION = 1, 2, 3, 10, 12, 13
#: Salts that one attempt uses: two for the edge, one for the dart, one for the region it falls into.
PER_ATTEMPT = 4


def fold(x: Column) -> Column:
    """A walker's id below P; what is above comes in as well, so ids that differ by P differ here."""
    low = F.pmod(x, F.lit(P))
    high = F.pmod(F.call_function("div", x - low, F.lit(P)), F.lit(P))
    return (low * 48271 + high * 40014 + 1013904223) % P


def by_step(h: Column, step: Column) -> Column:
    return (h + step * 69621 + 40692) % P


def by_salt(s: Column, salt: Column | int) -> Column:
    return (s + (F.lit(salt) if isinstance(salt, int) else salt).cast("long") * 16807 + 65539) % P


def fifth(df: DataFrame, *names: str) -> DataFrame:
    """Replaces the columns by their fifth powers; one projection, so the text doesn't multiply."""

    def power(x: Column) -> Column:
        square = (x * x) % P
        return (((square * square) % P) * x) % P

    return df.withColumns({n: power(F.col(n)) for n in names})


def with_walker_hash(df: DataFrame, wid: str = "wid", name: str = "h") -> DataFrame:
    """The first round, which a walker carries along."""
    return fifth(df.withColumn(name, fold(F.col(wid).cast("long"))), name)


def with_draws(df: DataFrame, draws: dict[str, Column | int], h: str = "h", step: str | Column = "step") -> DataFrame:
    """Adds a column in [0, P) for each (name, salt) of `draws`."""
    df = fifth(df.withColumn("_s", by_step(F.col(h), (F.col(step) if isinstance(step, str) else step).cast("long"))), "_s")
    return fifth(df.withColumns({name: by_salt(F.col("_s"), salt) for name, salt in draws.items()}), *draws).drop("_s")


def np_fifth(x: np.ndarray) -> np.ndarray:
    square = x * x % P
    return square * square % P * x % P


def np_walker_hash(wid: np.ndarray) -> np.ndarray:
    wid = wid.astype(np.int64)
    return np_fifth((wid % P * 48271 + wid // P % P * 40014 + 1013904223) % P)


def np_draw(h: np.ndarray, step: np.ndarray, salt: np.ndarray | int) -> np.ndarray:
    s = np_fifth((h + step.astype(np.int64) * 69621 + 40692) % P)
    return np_fifth((s + np.asarray(salt, np.int64) * 16807 + 65539) % P)


def sql_fifth(inner: str, names: list[str], drop: str) -> str:
    """Wraps a SELECT so that its columns `names` become their fifth powers."""
    squares = ", ".join(f"{n} * {n} % {P} AS {n}_q" for n in names)
    gone = ", ".join(f"{n}, {n}_q" for n in names)
    powers = ", ".join(f"(({n}_q * {n}_q) % {P}) * {n} % {P} AS {n}" for n in names)
    return f"SELECT * {drop} ({gone}), {powers} FROM (SELECT *, {squares} FROM ({inner}))"


def sql_walker_hash(inner: str, wid: str = "wid", drop: str = "EXCLUDE") -> str:
    """Adds h to a SELECT that has the walker's id.  drop is the dialect's word for `all columns but`."""
    low = f"((CAST({wid} AS BIGINT) % {P} + {P}) % {P})"
    high = f"(((CAST({wid} AS BIGINT) - {low}) // {P} % {P} + {P}) % {P})"
    return sql_fifth(f"SELECT *, ({low} * 48271 + {high} * 40014 + 1013904223) % {P} AS h FROM ({inner})", ["h"], drop)


def sql_draws(inner: str, draws: dict[str, str], step: str = "step", drop: str = "EXCLUDE") -> str:
    """Adds a column for each (name, salt expression)."""
    seed = sql_fifth(f"SELECT *, (h + CAST({step} AS BIGINT) * 69621 + 40692) % {P} AS _s FROM ({inner})", ["_s"], drop)
    salted = ", ".join(f"(_s + CAST({salt} AS BIGINT) * 16807 + 65539) % {P} AS {n}" for n, salt in draws.items())
    return sql_fifth(f"SELECT * {drop} (_s), {salted} FROM ({seed})", list(draws), drop)
