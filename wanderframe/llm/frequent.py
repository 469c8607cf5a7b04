"""The most frequent values of a huge column, in bounded memory.

External sort and run-length counting: each task sorts buffers of RUN values
and gives out runs (value, count), so a hot value leaves a buffer as one row.
The runs are kept in the shared folder, so every value is sorted once; they
are range-partitioned by value and sorted (Spark's sort spills), then a
streaming pass merges equal neighbours, adds their counts and keeps the k
largest of its range in a heap.  Counts are exact, and memory is RUN values
or k heap entries however many distinct values there are.

Results by case: null values are left out and do not count in the total; on
equal counts the smaller value comes first; repeated rows count each; values
are whole numbers, strings, dates or timestamps, other types are refused; an
empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wanderframe.session import kept

#: Values that a task sorts at once.
RUN = 1_000_000


def changes(values: pa.Array) -> np.ndarray:
    """Places at which a sorted array goes on to another value, the first included."""
    if pa.types.is_integer(values.type):
        v = values.to_numpy()
        return np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
    new = pc.not_equal(values[1:], values[:-1]).to_numpy(zero_copy_only=False)
    return np.flatnonzero(np.concatenate([[True], new]))


def in_order(values: pa.Array) -> pa.Array:
    if pa.types.is_integer(values.type):
        return pa.array(np.sort(values.to_numpy()))
    return values.take(pc.sort_indices(values))


def sorted_runs(size: int):  # noqa: ANN201
    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buffer: list[pa.Array] = []
        held = 0

        def run() -> pa.RecordBatch:
            v = in_order(pa.concat_arrays(buffer))
            at = changes(v)
            return pa.RecordBatch.from_arrays([v.take(pa.array(at)), pa.array(np.diff(np.append(at, len(v))))], ["value", "n"])

        for b in batches:
            if b.num_rows:
                buffer.append(b.column(0))
                held += b.num_rows
            if held >= size:
                yield run()
                buffer.clear()
                held = 0
        if held:
            yield run()

    return runs


@dataclass(frozen=True)
class Ranked:
    """A value with its count; the less frequent and the larger value is the lesser one."""

    n: int
    value: object

    def __lt__(self, other: Ranked) -> bool:
        return self.n < other.n or (self.n == other.n and self.value > other.value)


def merged(k: int):  # noqa: ANN201
    """A pass over one sorted range: its k largest values, and a row with a null value that holds the range's total."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heap: list[Ranked] = []
        total, last, count, kind = 0, None, 0, None

        def offer(values: pa.Array, counts: np.ndarray) -> None:
            if len(heap) == k:
                good = counts >= heap[0].n
                values, counts = values.filter(pa.array(good)), counts[good]
            for v, n in zip(values.to_pylist(), counts.tolist(), strict=True):
                if len(heap) < k:
                    heapq.heappush(heap, Ranked(n, v))
                elif heap[0] < (own := Ranked(n, v)):
                    heapq.heapreplace(heap, own)

        for b in batches:
            if not b.num_rows:
                continue
            v, n = b.column(0), b.column(1).to_numpy()
            kind = v.type
            total += int(n.sum())
            at = changes(v)
            v, n = v.take(pa.array(at)), np.add.reduceat(n, at)
            if last is not None:
                if v[0] == last:
                    n[0] += count
                else:
                    offer(pa.array([last.as_py()], kind), np.array([count]))
            last, count = v[-1], int(n[-1])
            offer(v[:-1], n[:-1])
        if last is not None:
            offer(pa.array([last.as_py()], kind), np.array([count]))
            rows = sorted(heap, reverse=True)
            yield pa.RecordBatch.from_arrays([pa.array([r.value for r in rows] + [None], kind), pa.array([r.n for r in rows] + [total], pa.int64())], ["value", "n"])

    return run


def most_frequent(df: DataFrame, column: str, k: int, run: int = RUN) -> DataFrame:
    """(value, n, total) of the k most frequent values of each range; the whole's k most frequent are among them."""
    kind = df.schema[column].dataType
    if isinstance(kind, T.IntegralType):
        kind = T.LongType()
    elif not isinstance(kind, (T.StringType, T.DateType, T.TimestampType, T.TimestampNTZType)):
        raise TypeError(f"values of type {kind.simpleString()} are not counted")
    values = df.where(F.col(column).isNotNull()).select(F.col(column).cast(kind).alias("value"))
    rows = f"value {kind.simpleString()}, n long"
    # range partitioning reads its input twice, for its bounds and to divide it
    runs = kept(values.mapInArrow(sorted_runs(run), rows))
    ranges = runs.repartitionByRange("value").sortWithinPartitions("value")
    found = ranges.mapInArrow(merged(k), rows)
    # k + 1 rows of each range: bounded by the number of partitions, whatever the data
    total = F.sum(F.when(F.col("value").isNull(), F.col("n"))).over(Window.partitionBy(F.lit(1)))
    return found.withColumn("total", total).where(F.col("value").isNotNull())


def top_values(df: DataFrame, column: str, k: int, name: str = "value", run: int = RUN) -> DataFrame:
    found = most_frequent(df, column, k, run).orderBy(F.desc("n"), "value").limit(k)
    return found.select(F.col("value").alias(name), "n", "total")


def above_share(df: DataFrame, column: str, share: float, name: str = "value", run: int = RUN) -> DataFrame:
    """Values that hold at least `share` of the non-null rows; at most 1/share of them exist."""
    found = most_frequent(df, column, int(1 / share) + 1, run)
    return found.where(F.col("n") >= F.col("total") * F.lit(share)).select(F.col("value").alias(name), "n", "total")
