"""How often items appear together, against chance.

Baskets become rows of a binary sparse matrix X (records x items), and the
counts of common baskets are its Gram matrix X'X.  It is summed over blocks of
records: a task holds a block of whole baskets, cuts its items into blocks,
and multiplies each item block's transpose with the record block, sparse by
sparse.  It adds up the products of its record blocks and gives out one
combined count for each pair, so no pair is sent once for each basket.

Two exact bounds shrink X beforehand: a pair that reaches `least` common
baskets and `lift` times chance has items of at least `least` baskets and of at
most N / lift each, since n(a,b) <= min(n(a), n(b)).  The second drops the hot
items, whose columns would fill the product.

A basket with more than HEAVY items would make its block's product dense.  The
cells of such baskets are multiplied by dense tiles instead: one unit of work
holds the product of two blocks of TILE items, and takes in the heavy baskets
TILE at a time.  Its light counts pass through it and take their heavy ones
along; pairs that only heavy baskets join come out if they reach `least`.  The
memory of a unit is fixed, whatever the number and the size of the baskets.

Results by case: rows with a null basket or item join nothing, but a basket
without items counts in N; repeated rows count once; a pair is given smaller
item first and never pairs an item with itself; an empty table gives an empty
result; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wanderframe.session import kept

#: Items of a basket from which it is heavy.
HEAVY = 2_000
#: Cells in a block of records.
BLOCK = 500_000
#: Products that are formed and pairs that are combined at once.
HELD = 2_000_000
#: Items in a dense tile, and heavy baskets that it takes in at once.
TILE = 2_000


def distinct_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ordered by basket and item, nulls first, become (basket, item, nth, fresh) once each.

    nth numbers the items of a basket from 0 on; fresh marks one row of each basket, which has a null item if
    one of the basket's rows has.
    """
    last_basket, last_item, last_nth = None, None, -1
    for x in batches:
        n = x.num_rows
        if not n:
            continue
        basket = x.column(0).to_numpy()
        there = x.column(1).is_valid().to_numpy(zero_copy_only=False)
        item = x.column(1).fill_null(0).to_numpy()
        fresh, changed = np.ones(n, bool), np.ones(n, bool)
        fresh[1:] = basket[1:] != basket[:-1]
        changed[1:] = (item[1:] != item[:-1]) | ~there[:-1]
        fresh[0] = last_basket is None or basket[0] != last_basket
        changed[0] = last_item is None or item[0] != last_item
        cell = there & (fresh | changed)
        count = np.cumsum(cell)
        begins = np.maximum.accumulate(np.where(fresh, np.arange(n), -1))
        before = np.where(begins >= 0, count[begins] - cell[begins], -1 - last_nth)
        nth = count - before - 1
        out = np.flatnonzero(fresh | cell)
        own = [pa.array(basket[out]), pa.array(item[out], mask=~there[out]), pa.array(nth[out], mask=~there[out]), pa.array(fresh[out])]
        last_basket, last_item, last_nth = basket[-1], item[-1] if there[-1] else None, int(nth[-1])
        yield pa.RecordBatch.from_arrays(own, ["basket", "item", "nth", "fresh"])


def transpose_products(basket: np.ndarray, item: np.ndarray, held: int = HELD) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(a, b, n) with a < b: X'X above its diagonal for one block of records, whose cells are ordered by basket and item.

    X is held by rows, as the columns of each basket, and by columns, which are the rows of X'.  The columns are
    cut into item blocks of about `held` products; the product of a block's part of X' with X gathers, for each
    of its cells, the cells behind it in the basket, and adds up what falls on the same place.
    """
    names, column = np.unique(item, return_inverse=True)
    turned = np.argsort(column, kind="stable")  # the cells in the order of X'
    behind = (np.searchsorted(basket, basket, "right") - np.arange(len(basket)) - 1)[turned]
    upto = np.cumsum(behind)
    lo = 0
    while lo < len(turned):
        done = int(upto[lo - 1]) if lo else 0
        hi = max(lo + 1, int(np.searchsorted(upto, done + held, "right")))
        n = behind[lo:hi]
        own = np.repeat(turned[lo:hi], n)
        other = own + 1 + np.arange(len(own)) - np.repeat(upto[lo:hi] - n - done, n)
        place, times = np.unique(column[own] * len(names) + column[other], return_counts=True)
        if len(place):
            yield names[place // len(names)], names[place % len(names)], times
        lo = hi


def summed(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    a, b, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((b, a))
    a, b, n = a[order], b[order], n[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    at = np.flatnonzero(new)
    return a[at], b[at], np.add.reduceat(n, at)


def pairs_batch(a: np.ndarray, b: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(n, pa.int64())], ["a", "b", "n"])


def block_products(block: int = BLOCK, held: int = HELD):  # noqa: ANN201
    """Sums X'X over a task's blocks of records; rows arrive ordered by basket and item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0

        def add(basket: np.ndarray, item: np.ndarray) -> Iterator[pa.RecordBatch]:
            nonlocal sums, size
            for part in transpose_products(basket, item, held):
                sums.append(part)
                size += len(part[0])
                if size > held:
                    sums = [summed(sums)]
                    size = len(sums[0][0])
                    if size > held // 2:
                        yield pairs_batch(*sums[0])
                        sums, size = [], 0

        rest = (np.zeros(0, np.int64), np.zeros(0, np.int64))
        waiting: list[tuple[np.ndarray, np.ndarray]] = []
        n = 0
        for x in batches:
            waiting.append((x.column(0).to_numpy(), x.column(1).to_numpy()))
            n += x.num_rows
            if n < block:
                continue
            basket, item = (np.concatenate([r, *own]) for r, own in zip(rest, zip(*waiting, strict=True), strict=True))
            cut = int(np.searchsorted(basket, basket[-1]))
            rest, waiting, n = (basket[cut:], item[cut:]), [], 0
            yield from add(basket[:cut], item[:cut])
        if waiting:
            rest = tuple(np.concatenate([r, *own]) for r, own in zip(rest, zip(*waiting, strict=True), strict=True))
        yield from add(*rest)
        if sums:
            yield pairs_batch(*summed(sums))

    return run


def tile_products(least: int, tile: int = TILE):  # noqa: ANN201
    """Adds the heavy baskets' counts to the light ones, for units (p, q) of item blocks.

    Rows arrive ordered by (p, q, kind, basket): items (kind 0: their index k in their block, and whether the block
    is q), cells of heavy baskets (kind 1), light pairs (kind 2: the indices k and l of both items, and n).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit = None
        names, product, tiles, baskets = {}, None, None, []

        def take_in() -> None:
            nonlocal product
            if baskets:
                product += tiles[0][:, : len(baskets)] @ tiles[1][:, : len(baskets)].T
                for t in tiles:
                    t[:, : len(baskets)] = 0
                baskets.clear()

        def finish() -> Iterator[pa.RecordBatch]:
            """Pairs of the unit that only heavy baskets join."""
            if unit is None:
                return
            take_in()
            k, col = np.nonzero(product >= least)
            a, b = names[0][k], names[1][col]
            good = a < b if unit[0] == unit[1] else a != b
            if good.any():
                yield pairs_batch(np.minimum(a, b)[good], np.maximum(a, b)[good], product[k, col][good].astype(np.int64))

        for x in batches:
            p, q, kind, basket, item, side, k, col, n = (x.column(c).to_numpy() for c in range(9))
            cuts = np.flatnonzero(np.diff(p, prepend=-1) | np.diff(q, prepend=-1) | np.diff(kind, prepend=-1))
            for lo, hi in zip(cuts.tolist(), [*cuts[1:].tolist(), len(p)], strict=True):
                if unit != (p[lo], q[lo]):
                    yield from finish()
                    unit = (p[lo], q[lo])
                    names = {s: np.zeros(tile, np.int64) for s in (0, 1)}
                    product = np.zeros((tile, tile), np.float32)
                    tiles = [np.zeros((tile, tile), np.float32) for _ in (0, 1)]
                    baskets.clear()
                if kind[lo] == 0:
                    for s in (0, 1):
                        own = slice(lo, hi)
                        at = side[own] == s
                        names[s][k[own][at]] = item[own][at]
                elif kind[lo] == 1:
                    at = lo
                    while at < hi:
                        stop = int(np.searchsorted(basket[lo:hi], basket[at], "right")) + lo
                        if not baskets or baskets[-1] != basket[at]:
                            if len(baskets) == tile:
                                take_in()
                            baskets.append(basket[at])
                        for s in (0, 1):
                            own = np.flatnonzero(side[at:stop] == s) + at
                            tiles[s][k[own], len(baskets) - 1] = 1
                        at = stop
                else:
                    take_in()
                    own = slice(lo, hi)
                    a, b = names[0][k[own]], names[1][col[own]]
                    heavy = product[k[own], col[own]].astype(np.int64)
                    product[k[own], col[own]] = 0
                    if unit[0] == unit[1]:
                        product[col[own], k[own]] = 0
                    yield pairs_batch(np.minimum(a, b), np.maximum(a, b), n[own] + heavy)
        yield from finish()

    return run


def with_heavy(light: DataFrame, cells: DataFrame, least: int, tile: int = TILE) -> DataFrame:
    """(a, b, n) of all pairs, from those of the light baskets and the cells of the heavy ones; pairs without light baskets only from `least` on."""
    # items of a block have indices without gaps, counted in ranges so that no window holds all items
    names = cells.select("item").distinct()
    ranges = names.repartitionByRange("item").withColumn("part", F.spark_partition_id())
    ranges = kept(ranges)
    sizes = ranges.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(F.lit(1)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("part", before.alias("before"))
    rank = F.row_number().over(Window.partitionBy("part").orderBy("item")) - 1
    ranked = ranges.withColumn("rank", rank).join(F.broadcast(offsets), "part").select("item", (F.col("rank") + F.col("before")).alias("r"))
    ranked = kept(ranked.select("item", F.floor(F.col("r") / tile).alias("i"), (F.col("r") % tile).cast("int").alias("k")))
    blocks = (ranked.agg(F.max("i")).first()[0] or 0) + 1
    units = F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1)), lambda j: F.struct(F.least("i", j).alias("p"), F.greatest("i", j).alias("q"))))
    zero = F.lit(0).cast("long")

    def sides(df: DataFrame, kind: int, basket: str) -> DataFrame:
        df = df.withColumn("u", units).select("u.p", "u.q", "i", "k", "item", F.col(basket).alias("basket"))
        own = F.when(F.col("p") == F.col("q"), F.array(F.lit(0), F.lit(1))).otherwise(F.array((F.col("i") == F.col("q")).cast("int")))
        return df.withColumn("side", F.explode(own)).select("p", "q", F.lit(kind).alias("kind"), "basket", "item", "side", "k", F.lit(0).alias("l"), zero.alias("n"))

    both = light.join(ranked.select(F.col("item").alias("a"), F.col("i").alias("ia"), F.col("k").alias("ka")), "a").join(ranked.select(F.col("item").alias("b"), F.col("i").alias("ib"), F.col("k").alias("kb")), "b")
    turned = F.col("ia") > F.col("ib")
    known = both.select(F.least("ia", "ib").alias("p"), F.greatest("ia", "ib").alias("q"), F.lit(2).alias("kind"), zero.alias("basket"), zero.alias("item"), F.lit(0).alias("side"), F.when(turned, F.col("kb")).otherwise(F.col("ka")).alias("k"), F.when(turned, F.col("ka")).otherwise(F.col("kb")).alias("l"), "n")
    rows = sides(ranked, 0, "k").unionByName(sides(cells.join(ranked, "item"), 1, "basket")).unionByName(known)
    rows = rows.repartition("p", "q").sortWithinPartitions("p", "q", "kind", "basket")
    found = rows.mapInArrow(tile_products(least, tile), "a long, b long, n long")
    items = ranked.select("item")
    apart = light.join(items.withColumnRenamed("item", "a"), "a", "left_anti").unionByName(light.join(items.withColumnRenamed("item", "a"), "a", "left_semi").join(items.withColumnRenamed("item", "b"), "b", "left_anti"))
    return found.unionByName(apart)


def common_baskets(df: DataFrame, basket: str, item: str, least: int = 10, lift: float = 20.0, heavy: int = HEAVY, block: int = BLOCK, held: int = HELD, tile: int = TILE) -> DataFrame:
    """(item_a, item_b, n_ab, n_a, n_b, n_baskets, lift) of pairs with n_ab >= least and n_ab * N >= lift * n_a * n_b."""
    named = df.where(F.col(basket).isNotNull()).select(F.col(basket).cast("long").alias("basket"), F.col(item).cast("long").alias("item"))
    # one pass brings each basket together; it gives the cells, their numbers of items, and N
    named = named.repartition("basket").sortWithinPartitions("basket", F.col("item").asc_nulls_first())
    visits = kept(named.mapInArrow(distinct_cells, "basket long, item long, nth long, fresh boolean"))
    total = visits.agg(F.count_if("fresh").alias("n_baskets"))
    sizes = visits.where("item IS NOT NULL").groupBy("item").agg(F.count(F.lit(1)).alias("n"))
    # both are small beside the input, and several passes read them
    items = kept(sizes.where(F.col("n") >= least).join(F.broadcast(total), F.col("n") * lift <= F.col("n_baskets")))
    cells = kept(visits.join(items.select("item"), "item").select("basket", "item"))
    large = visits.where(F.col("nth") == heavy).select("basket")  # at most one row for each basket
    light = cells
    if any_large := not large.isEmpty():
        sized = cells.join(large, "basket", "left_semi").groupBy("basket").agg(F.count(F.lit(1)).alias("m"))
        large = kept(sized.where(F.col("m") > heavy).select("basket"))
        light = cells.join(large, "basket", "left_anti")
    light = light.repartition("basket").sortWithinPartitions("basket", "item")
    pairs = light.mapInArrow(block_products(block, held), "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))
    if any_large:
        pairs = with_heavy(pairs, cells.join(large, "basket", "left_semi"), least, tile)
    frequent = pairs.where(F.col("n") >= least).withColumnRenamed("n", "n_ab")
    out = frequent.join(items.select(F.col("item").alias("a"), F.col("n").alias("n_a"), "n_baskets"), "a")
    out = out.join(items.select(F.col("item").alias("b"), F.col("n").alias("n_b")), "b")
    out = out.where(F.col("n_ab") * F.col("n_baskets") >= F.lit(lift) * F.col("n_a") * F.col("n_b"))
    ratio = F.col("n_ab") * F.col("n_baskets") / (F.col("n_a") * F.col("n_b"))
    return out.select(F.col("a").alias("item_a"), F.col("b").alias("item_b"), "n_ab", "n_a", "n_b", "n_baskets", ratio.alias("lift"))
