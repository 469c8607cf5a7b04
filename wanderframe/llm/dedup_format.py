"""Records that differ only in formatting.

Canonical form: letter case, white space and punctuation go, a full stop
between two digits stays, fields are told apart by their names and put in
order.  One NumPy pass over the code points of a batch works it out.

Its 64-bit hash feeds two Bloom filters, of hashes seen once and of hashes
seen again.  The filters are cut into segments, and all bits of a hash lie in
one segment.  Each task gives its part of a segment's filters in the smaller
of two forms, as bits or as the hashes that stand for them, so what shuffles
is at most eight bytes for each record however many tasks there are.  Parts
are merged by segment, `again = again1 | again2 | (once1 & once2)`.  Only
records whose hash may be in `again` shuffle and are grouped by their
canonical text; the others are singletons and never move.  A false positive
of the filter costs a shuffled row and no correctness.

The filters have ten bits for each record, however many there are.  Segments
go in shards, and the canonical records are written by shard, so a task needs
the filter of one shard only: SHARD segments (32 MB) until there are MOST_SHARDS
of them, which is at about 27 billion records.

Groups of copies may be huge: the smallest id and the number of copies are
partial aggregates, and the list of members takes its group's smallest id by
a broadcast join for the groups above 1/SHARE of the records, of which fewer
than SHARE can exist, and by a shuffle join for the rest.

Results by case: a null record is no case and gives no row; a record without
any named field is compared by its whole text; an empty field is a missing
field; equal records collapse; an empty table gives an empty result; other
columns are never read.
"""

from __future__ import annotations

import sys
import unicodedata
import uuid
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wanderframe.session import kept, shared_dir

BITS_PER_RECORD = 10
#: Bits of a segment.
SEGMENT = 1 << 20
#: Segments of a shard, whose filter a task holds.
SHARD = 256
MOST_SHARDS = 1000
PROBES = 4
#: Hashes that a task collects before it gives out its parts of the filters.
RUN = 1_000_000
SHARE = 1000
NAMES = ("src", "dst", "weight")
DOT = "\ue000"
BREAK, WORD, DIGIT = range(3)
#: Code points that are worked on at once.
CHUNK = 1 << 22


@lru_cache(maxsize=1)
def character_table() -> tuple[np.ndarray, np.ndarray]:
    """(class, lower-case form) of every code point; letters, marks and numbers form words."""
    kind, lower = np.zeros(sys.maxunicode + 1, np.uint8), np.arange(sys.maxunicode + 1, dtype=np.uint32)
    for c in range(sys.maxunicode + 1):
        name = unicodedata.category(chr(c))
        if name[0] in "LMN":
            kind[c] = DIGIT if name == "Nd" else WORD
            if name[0] == "L":
                lower[c] = ord(chr(c).lower()[0])
    lower[ord("ς")] = ord("σ")
    return kind, lower


def runs_of(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, … size[0] of them, then those of the next."""
    ends = np.cumsum(size)
    return np.repeat(begin - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)


def canonical_chunk(points: np.ndarray, size: np.ndarray, names: tuple[str, ...]) -> pa.Array:
    """Canonical forms of records that stand one after another in `points`, with `size` code points each."""
    kind, lower = character_table()
    begin = np.cumsum(size) - size
    cls, low = kind[points], lower[points]
    inside = np.ones(len(points), bool)  # the character in front belongs to the same record
    inside[begin[begin < len(points)]] = False
    stop = np.flatnonzero(points == ord("."))
    stop = stop[(stop > 0) & (stop + 1 < len(points))]
    stop = stop[(cls[stop - 1] == DIGIT) & (cls[stop + 1] == DIGIT) & inside[stop] & inside[stop + 1]]
    cls[stop], low[stop] = WORD, ord(DOT)
    word = cls != BREAK
    opens = word.copy()
    opens[1:] &= ~(word[:-1] & inside[1:])
    at = np.flatnonzero(opens)
    shuts = word.copy()
    shuts[:-1] &= ~(word[1:] & inside[1:])
    length = np.flatnonzero(shuts) + 1 - at
    owner = np.searchsorted(begin + size, at, "right")
    # the rank of the name that a word is, by alphabet; -1 for other words
    order = sorted(names)
    rank = np.full(len(at), -1)
    for k, name in enumerate(order):
        fits = np.flatnonzero(length == len(name))
        for j, ch in enumerate(name):
            fits = fits[low[at[fits] + j] == ord(ch)]
        rank[fits] = k
    # a field begins at each name and runs to the next name or the record's end
    heads = np.flatnonzero(rank >= 0)
    n_words = np.diff(np.append(heads, len(at)))
    last_word = np.searchsorted(owner, owner[heads], "right")
    n_words = np.minimum(n_words, last_word - heads)
    heads = heads[n_words > 1]
    n_words = n_words[np.flatnonzero(n_words > 1)]
    field_owner, field_rank = owner[heads], rank[heads]
    by = np.lexsort((np.arange(len(heads)), field_rank, field_owner))
    twice = np.flatnonzero((np.diff(field_owner[by]) == 0) & (np.diff(field_rank[by]) == 0))
    if len(twice):  # fields of one name stand in order of their values

        def text_of(f: int) -> str:
            w = slice(heads[f] + 1, heads[f] + n_words[f])
            return low[runs_of(at[w], length[w])].tobytes().decode("utf-32-le")

        for r in np.unique(field_owner[by[twice]]):
            own = slice(*np.searchsorted(field_owner[by], [r, r + 1]))
            by[own] = sorted(by[own], key=lambda f: (field_rank[f], text_of(f)))
    # pieces of the output: a record's mark or a field's name, then words
    bare = np.setdiff1d(np.arange(len(size)), field_owner)
    marks = ["?", *(f"{sign}{name}=" for name in order for sign in ("", "|"))]
    mark_points = np.frombuffer("".join(marks).encode("utf-32-le"), np.uint32)
    mark_size = np.array([len(m) for m in marks])
    mark_at = np.cumsum(mark_size) - mark_size + len(low)
    first_word, behind = np.searchsorted(owner, bare), np.searchsorted(owner, bare, "right")
    fresh = np.ones(len(by), bool)
    fresh[1:] = np.diff(field_owner[by]) != 0
    group_owner = np.concatenate([bare, field_owner[by]])
    group_mark = np.concatenate([np.zeros(len(bare), np.int64), 1 + 2 * field_rank[by] + ~fresh])
    group_word = np.concatenate([first_word, heads[by] + 1])
    group_words = np.concatenate([behind - first_word, n_words[by] - 1])
    in_order = np.argsort(group_owner, kind="stable")
    group_owner, group_mark, group_word, group_words = (x[in_order] for x in (group_owner, group_mark, group_word, group_words))
    words = runs_of(group_word, group_words)
    n_pieces = group_words + 1
    piece_at = np.empty(int(n_pieces.sum()), np.int64)
    piece_size = np.empty_like(piece_at)
    is_mark = np.zeros(len(piece_at), bool)
    is_mark[np.cumsum(n_pieces) - n_pieces] = True
    piece_at[is_mark], piece_size[is_mark] = mark_at[group_mark], mark_size[group_mark]
    piece_at[~is_mark], piece_size[~is_mark] = at[words], length[words]
    out = np.concatenate([low, mark_points])[runs_of(piece_at, piece_size)]
    width = 1 + (out >= 0x80).astype(np.int64) + (out >= 0x800) + (out >= 0x10000)
    ends = np.concatenate([[0], np.cumsum(width)])
    piece_owner = np.repeat(group_owner, n_pieces)
    per_record = np.bincount(piece_owner, weights=piece_size, minlength=len(size)).astype(np.int64)
    offsets = ends[np.concatenate([[0], np.cumsum(per_record)])]
    data = out.tobytes().decode("utf-32-le").encode()
    return pa.Array.from_buffers(pa.large_string(), len(size), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)])


def canonical(records: pa.Array, names: tuple[str, ...] = NAMES) -> pa.Array:
    """`dst=…|src=…|weight=…` with the fields that are there, in order of name, for each record (none is null)."""
    size = pa.compute.utf8_length(records).to_numpy().astype(np.int64)
    ends = np.cumsum(size)
    parts, k = [], 0
    while k < len(records):
        done = ends[k] - size[k]
        upto = max(k + 1, int(np.searchsorted(ends, done + CHUNK, "right")))
        text = "".join(records.slice(k, upto - k).to_pylist())
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        parts.append(canonical_chunk(points, size[k:upto], names))
        k = upto
    return pa.concat_arrays(parts) if parts else pa.array([], pa.large_string())


def place(hashes: np.ndarray, segments: int) -> np.ndarray:
    """The segment that holds a hash's bits."""
    return ((hashes.view(np.uint64) >> np.uint64(20)) % np.uint64(segments)).astype(np.int64)


def probes(hashes: np.ndarray) -> list[np.ndarray]:
    """Bits within the segment."""
    h = hashes.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    step = (h >> np.uint64(40)) | np.uint64(1)
    return [((h + np.uint64(k) * step) % np.uint64(SEGMENT)).astype(np.int64) for k in range(PROBES)]


def set_bits(field: np.ndarray, at: np.ndarray) -> None:
    on = np.zeros(len(field) * 8, bool)
    on[at] = True
    field |= np.packbits(on, bitorder="little")


def may_hold(field: np.ndarray, hashes: np.ndarray, base: np.ndarray | int = 0) -> np.ndarray:
    """Whether all bits of each hash are set; base is the first bit of its segment in the field."""
    return reduce(np.logical_and, ((field[(base + p) >> 3] >> (p & 7).astype(np.uint8)) & 1 == 1 for p in probes(hashes)))


def bits_of(hashes: np.ndarray) -> np.ndarray:
    field = np.zeros(SEGMENT // 8, np.uint8)
    for p in probes(hashes):
        set_bits(field, p)
    return field


def repeats_filter(df: DataFrame, column: str, segments: int) -> DataFrame:
    """(segment, again): the merged Bloom filter of hashes that occur more than once."""

    def parts(h: np.ndarray) -> pa.RecordBatch:
        h, n = np.unique(h, return_counts=True)
        seg = place(h, segments)
        order = np.argsort(seg, kind="stable")
        h, n, seg = h[order], n[order], seg[order]
        cuts = np.flatnonzero(np.diff(seg, prepend=-1))
        once, again, dense = [], [], []
        for lo, hi in zip(cuts.tolist(), [*cuts[1:].tolist(), len(h)], strict=True):
            own, more = h[lo:hi], h[lo:hi][n[lo:hi] > 1]
            dense.append((len(own) + len(more)) * 8 > SEGMENT // 4)
            once.append((bits_of(own) if dense[-1] else own).tobytes())
            again.append((bits_of(more) if dense[-1] else more).tobytes())
        return pa.RecordBatch.from_arrays([pa.array(seg[cuts]), pa.array(dense), pa.array(once, pa.binary()), pa.array(again, pa.binary())], ["segment", "dense", "once", "again"])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            held.append(b.column(0).to_numpy())
            size += b.num_rows
            if size >= RUN:
                yield parts(np.concatenate(held))
                held, size = [], 0
        if size:
            yield parts(np.concatenate(held))

    def merge(key: tuple, pieces: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        once, again = np.zeros(SEGMENT // 8, np.uint8), np.zeros(SEGMENT // 8, np.uint8)
        for pdf in pieces:
            for dense, o, a in zip(pdf["dense"], pdf["once"], pdf["again"], strict=True):
                if dense:
                    o, a = np.frombuffer(o, np.uint8), np.frombuffer(a, np.uint8)
                else:
                    h = np.frombuffer(o, np.int64)
                    o = bits_of(h)
                    a = bits_of(np.concatenate([np.frombuffer(a, np.int64), h[may_hold(once, h)]]))
                again |= a | (once & o) if dense else a
                once |= o
        yield pd.DataFrame({"segment": [key[0]], "again": [again.tobytes()]})

    filled = df.select(column).mapInArrow(fill, "segment long, dense boolean, once binary, again binary")
    return filled.groupBy("segment").applyInPandas(merge, "segment long, again binary")


def hashed(df: DataFrame, key: str, record: str) -> DataFrame:
    """(rec_id, canon, h) of the records that are not null."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), canonical(b.column(1)).cast(pa.string())], ["rec_id", "canon"])

    rows = df.where(F.col(record).isNotNull()).select(F.col(key), F.col(record)).mapInArrow(run, f"rec_id {kind}, canon string")
    return rows.withColumn("h", F.xxhash64("canon"))


def split_repeats(df: DataFrame, key: str, record: str) -> tuple[DataFrame, DataFrame, int]:
    """(records that may repeat, certain singletons, number of records)"""
    spark = df.sparkSession
    n = df.count()
    segments = max(1, -(-BITS_PER_RECORD * n // SEGMENT))
    per_shard = max(SHARD, -(-segments // MOST_SHARDS))
    shards = -(-segments // per_shard)

    @F.pandas_udf("int")
    def shard_of(h: pd.Series) -> pd.Series:
        return pd.Series(place(h.to_numpy(), segments) // per_shard)

    # the canonical form is worked out once; three passes read it
    where = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    rows = hashed(df, key, record)
    schema = rows.schema
    if shards > 1:
        rows.withColumn("shard", shard_of("h")).write.partitionBy("shard").parquet(where)
        rows = spark.read.schema(f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in schema)}, shard int").parquet(where)
    else:
        rows.write.parquet(where)
        rows = spark.read.schema(schema).parquet(where)
    merged = repeats_filter(rows, "h", segments)
    merged = kept(merged) if shards > 1 else merged
    marked = []
    for k in range(shards):
        lo = k * per_shard
        size = min(per_shard, segments - lo)
        field = np.zeros(size * SEGMENT // 8, np.uint8)
        own = merged.where(F.col("segment").between(lo, lo + size - 1)) if shards > 1 else merged
        for r in own.toLocalIterator():
            at = (r["segment"] - lo) * (SEGMENT // 8)
            field[at : at + SEGMENT // 8] = np.frombuffer(r["again"], np.uint8)
        own = rows.where(F.col("shard") == k) if shards > 1 else rows
        marked.append(own.select("rec_id", "canon", "h").withColumn("maybe", probe(spark, field, lo, segments)("h")))
    both = reduce(DataFrame.unionByName, marked)
    return both.where("maybe").drop("maybe"), both.where("NOT maybe").drop("maybe"), n


def probe(spark: SparkSession, field: np.ndarray, lo: int, segments: int):  # noqa: ANN201
    """Whether a hash may be repeated, by a shard's filter; executors fetch it when they first read a part of the shard."""
    sent = spark.sparkContext.broadcast(field.tobytes())

    @F.pandas_udf("boolean")
    def maybe(h: pd.Series) -> pd.Series:
        h = h.to_numpy()
        return pd.Series(may_hold(np.frombuffer(sent.value, np.uint8), h, (place(h, segments) - lo) * SEGMENT))

    return maybe


def groups_of(repeats: DataFrame) -> DataFrame:
    return repeats.groupBy("canon").agg(F.min("rec_id").alias("keep_id"), F.count(F.lit(1)).alias("n_copies"))


def collapse(df: DataFrame, key: str = "rec_id", record: str = "record") -> DataFrame:
    """One row for each distinct record: (keep_id, canon, n_copies)."""
    repeats, singles, _ = split_repeats(df, key, record)
    alone = singles.select(F.col("rec_id").alias("keep_id"), "canon", F.lit(1).cast("long").alias("n_copies"))
    return groups_of(repeats).select("keep_id", "canon", "n_copies").unionByName(alone)


def copies(df: DataFrame, key: str = "rec_id", record: str = "record") -> DataFrame:
    """(keep_id, copy_id) of every member but the smallest of each group of equal records."""
    repeats, _, n = split_repeats(df, key, record)
    groups = groups_of(repeats).where("n_copies > 1")
    edge = max(1, n // SHARE)
    hot = groups.where(F.col("n_copies") > edge).select("canon", "keep_id")
    cool = groups.where(F.col("n_copies") <= edge).select("canon", "keep_id")
    members = repeats.select("canon", "rec_id").join(F.broadcast(hot.withColumnRenamed("keep_id", "hot_keep")), "canon", "left")
    of_hot = members.where("hot_keep IS NOT NULL").select(F.col("hot_keep").alias("keep_id"), "rec_id")
    of_cool = members.where("hot_keep IS NULL").select("canon", "rec_id").join(cool, "canon").select("keep_id", "rec_id")
    return of_hot.unionByName(of_cool).where("rec_id <> keep_id").select("keep_id", F.col("rec_id").alias("copy_id"))
