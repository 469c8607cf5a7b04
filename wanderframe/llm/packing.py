"""Files in containers of fixed capacity, by minimum bin slack.

Items of one length are alike, so the packing is decided on the histogram of
lengths, which has at most `capacity` entries for any number of files.  Each
step takes the longest length left and fills the rest of the container by a
subset-sum over the lengths available: a bitset holds the sums that can be
reached, the fullest one is followed back to its lengths, and the combination
is removed as often as the histogram allows.  The result is a list of
patterns (which lengths, how often, first container) of bounded size.

Items then find their place by rank: the r-th item of a length belongs to the
pattern whose range of ranks holds r.  Ranks are counted in hash buckets of
bounded size, so one frequent length is spread over many tasks.

Only files above the capacity are split, into full containers and a rest that
is packed like any item.

Results by case: files without tokens take no room and go to the container
that the hash of their id gives; ties between combinations go to the longer
lengths; repeated rows are items of their own; an empty table gives an empty
result; other columns are never read.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wanderframe.session import kept

#: Items that one rank bucket holds on average.
BUCKET = 20_000


def fullest(free: int, counts: dict[int, int], lengths: list[int]) -> list[int]:
    """Lengths, with repetition, whose sum is the largest not above `free`; counts bound their use.

    `lengths` is ascending.  Bit s of reach[i] says that sum s can be made of the i longest usable lengths;
    the search ends at the first length that fills the container.
    """
    stop = bisect.bisect_right(lengths, free)
    mask = (1 << (free + 1)) - 1
    reach, used = [1], []
    for n in reversed(lengths[:stop]):
        bits, times, most = reach[-1], 1, min(counts[n], free // n)
        while most > 0:  # binary splitting of the multiplicity
            take = min(times, most)
            bits |= (bits << (n * take)) & mask
            most -= take
            times *= 2
        used.append(n)
        reach.append(bits)
        if bits >> free & 1:
            break
    left = reach[-1].bit_length() - 1
    out: list[int] = []
    for i in range(len(used) - 1, -1, -1):
        n, most = used[i], min(counts[used[i]], free // used[i])
        k = next(k for k in range(most + 1) if left - k * n >= 0 and reach[i] >> (left - k * n) & 1)
        out += [n] * k
        left -= k * n
    return out


def patterns(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, dict[int, int]]]:
    """(first container, containers, {length: items in each}) until the histogram is empty."""
    counts = {n: c for n, c in histogram.items() if c}
    lengths = sorted(counts)
    out, at = [], 0
    while lengths:
        top = lengths[-1]
        counts[top] -= 1
        chosen = [top, *fullest(capacity - top, counts, lengths)]
        counts[top] += 1
        per = {n: chosen.count(n) for n in set(chosen)}
        times = min(counts[n] // k for n, k in per.items())
        for n, k in per.items():
            counts[n] -= k * times
            if not counts[n]:
                del counts[n]
                del lengths[bisect.bisect_left(lengths, n)]
        out.append((at, times, per))
        at += times
    return out


def pack(sizes: DataFrame, key: str, size: str, capacity: int) -> DataFrame:
    """(key, part, part_start, n_tokens, container) of every item of `sizes`."""
    kind = sizes.schema[key].dataType.simpleString()
    whole = F.col(size) / F.lit(capacity)
    numbers = F.sequence(F.lit(0), F.greatest(F.ceil(whole) - 1, F.lit(0)).cast("int"))
    items = sizes.select(F.col(key), F.col(size).alias("_size"), F.explode(numbers).alias("part"))
    start = F.col("part").cast("long") * capacity
    items = items.select(key, "part", start.alias("part_start"), F.least(F.col("_size") - start, F.lit(capacity)).alias("n_tokens"))
    items = kept(items)
    totals = {r["n_tokens"]: r["n"] for r in items.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most capacity + 1 rows
    empties = totals.pop(0, 0)
    plan = patterns(totals, capacity)
    n_containers = plan[-1][0] + plan[-1][1] if plan else 0
    buckets = max(1, (sum(totals.values()) + empties) // BUCKET)
    spread = items.withColumn("b", F.pmod(F.xxhash64(key, "part"), F.lit(buckets)))
    per_bucket = spread.groupBy("n_tokens", "b").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("n_tokens").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_bucket.select("n_tokens", "b", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    local = F.row_number().over(Window.partitionBy("n_tokens", "b").orderBy(key, "part")) - 1
    ranked = spread.withColumn("local", local).join(offsets, ["n_tokens", "b"])
    ranked = ranked.select(key, "part", "part_start", "n_tokens", (F.col("local") + F.col("before")).alias("rank"))

    # ranges of ranks: (length, first rank) -> first container, items in each
    rows, next_rank = [], dict.fromkeys(totals, 0)
    for at, times, per in plan:
        for n, k in per.items():
            rows.append((n, next_rank[n], at, k))
            next_rank[n] += k * times
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 4)
    first = np.searchsorted(table[:, 0], np.arange(capacity + 2))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, rank = b.column(3).to_numpy(), b.column(4).to_numpy()
            out = np.full(len(n), -1, np.int64)
            order = np.argsort(n, kind="stable")
            cuts = np.flatnonzero(np.diff(n[order], prepend=-1)) if len(n) else []
            for lo, hi in zip(cuts, [*cuts[1:], len(n)], strict=True):
                rows, length = order[lo:hi], int(n[order[lo]])
                if length:
                    own = table[first[length] : first[length + 1]]
                    k = np.searchsorted(own[:, 1], rank[rows], "right") - 1
                    out[rows] = own[k, 2] + (rank[rows] - own[k, 1]) // own[k, 3]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(4)), pa.array(out)], [key, "part", "part_start", "n_tokens", "container"])

    placed = ranked.mapInArrow(place, f"`{key}` {kind}, part int, part_start long, n_tokens long, container long")
    anywhere = F.pmod(F.xxhash64(key), F.lit(max(1, n_containers)))
    return placed.withColumn("container", F.when(F.col("n_tokens") == 0, anywhere).otherwise(F.col("container")))
