"""Edge files: packed binary records, text lists and Parquet, and the conversions between them.

Binary files have no header; a record is two little-endian u32 (src, dst),
then a f32 weight if weighted, then an i32 type if typed.  They are read and
written by a Python Data Source whose partitions are byte ranges on record
boundaries, decoded by NumPy into Arrow batches.  Paths may have a scheme:
local files, and the distributed file systems and object stores that Arrow
knows (hdfs, s3, gs, abfs, …).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

#: Bytes of a binary file that one task reads.
SPLIT = 64 << 20
FIELDS = {"src": ("<u4", T.LongType()), "dst": ("<u4", T.LongType()), "weight": ("<f4", T.FloatType()), "etype": ("<i4", T.IntegerType())}


def columns_of(weighted: bool, typed: bool) -> list[str]:
    return ["src", "dst", *["weight"] * weighted, *["etype"] * typed]


def record_type(columns: list[str]) -> np.dtype:
    return np.dtype([(c, FIELDS[c][0]) for c in columns])


def schema_of(columns: list[str]) -> T.StructType:
    return T.StructType([T.StructField(c, FIELDS[c][1]) for c in columns])


def flag(options: dict, name: str) -> bool:
    return str(options.get(name, "false")).lower() == "true"


class EdgeFileError(ValueError):
    """A file does not hold what it should."""


def uri_of(path: str) -> str | None:
    """The path as Arrow writes it; None for one without a scheme."""
    if "://" not in path and not path.startswith("file:"):
        return None
    return re.sub(r"^file:/+", "file:///", re.sub(r"^s3[an]:", "s3:", path))


def placed(path: str):  # noqa: ANN201
    """The file system of a path, and the path within it."""
    from pyarrow import fs

    uri = uri_of(path)
    return (fs.LocalFileSystem(), path) if uri is None else fs.FileSystem.from_uri(uri)


def files_in(fs, path: str) -> list:  # noqa: ANN001
    """The file at a path, or the files of the folder there that are not hidden."""
    from pyarrow.fs import FileSelector, FileType

    own = fs.get_file_info(path)
    if own.type == FileType.NotFound:
        raise EdgeFileError(f"{path} does not exist")
    if own.is_file:
        return [own]
    return sorted((f for f in fs.get_file_info(FileSelector(path)) if f.is_file and f.base_name[0] not in "._"), key=lambda f: f.path)


@dataclass
class ByteRange(InputPartition):
    path: str
    begin: int
    end: int


class BinaryReader(DataSourceReader):
    def __init__(self, path: str, columns: list[str], split: int) -> None:
        self.path, self.columns, self.split = path, columns, split

    def partitions(self) -> list[InputPartition]:
        fs, root = placed(self.path)
        size = record_type(self.columns).itemsize
        out: list[InputPartition] = []
        for f in files_in(fs, root):
            if f.size % size:
                raise EdgeFileError(f"{f.path} has {f.size} bytes, which are no whole records of {size}")
            step = max(size, self.split // size * size)
            out += [ByteRange(f.path, k, min(f.size, k + step)) for k in range(0, f.size, step)]
        return out or [ByteRange("", 0, 0)]

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        kind = record_type(self.columns)
        rows = 1 << 20
        with placed(self.path)[0].open_input_file(partition.path) as f:
            f.seek(partition.begin)
            left = partition.end - partition.begin
            while left > 0:
                part = f.read(min(left, rows * kind.itemsize))
                if not part:
                    raise EdgeFileError(f"{partition.path} ends too early")
                left -= len(part)
                x = np.frombuffer(part, kind)
                own = [pa.array(x[c].astype(np.int64)) if c in ("src", "dst") else pa.array(np.ascontiguousarray(x[c])) for c in self.columns]
                yield pa.RecordBatch.from_arrays(own, self.columns)


@dataclass
class Wrote(WriterCommitMessage):
    part: str


class BinaryWriter(DataSourceArrowWriter):
    """Each task writes a hidden file; the commit gives them their names, an abort removes them."""

    def __init__(self, path: str, columns: list[str], overwrite: bool) -> None:
        self.path, self.columns, self.overwrite = path, columns, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Wrote:
        import uuid

        fs, root = placed(self.path)
        fs.create_dir(root, recursive=True)
        name = f".part-{uuid.uuid4().hex}"
        kind = record_type(self.columns)
        with fs.open_output_stream(f"{root}/{name}") as f:
            for b in iterator:
                x = np.zeros(b.num_rows, kind)
                for c in self.columns:
                    column = b.column(b.schema.get_field_index(c))
                    if column.null_count:
                        raise EdgeFileError(f"binary records have no room for a null {c}")
                    values = column.to_numpy()
                    if c in ("src", "dst") and len(values) and (values.min() < 0 or values.max() >= 1 << 32):
                        raise EdgeFileError(f"{c} does not fit 32 bits")
                    x[c] = values
                f.write(x.tobytes())
        return Wrote(name)

    def commit(self, messages: list[Wrote | None]) -> None:
        fs, root = placed(self.path)
        fs.create_dir(root, recursive=True)
        fresh = [m.part for m in messages if m]
        from pyarrow.fs import FileSelector

        there = [f for f in fs.get_file_info(FileSelector(root)) if f.is_file and f.base_name not in fresh]
        if self.overwrite:
            for f in there:
                fs.delete_file(f.path)
            there = []
        at = sum(f.base_name.startswith("part-") for f in there)
        for k, name in enumerate(fresh):
            fs.move(f"{root}/{name}", f"{root}/part-{at + k:05d}.bin")

    def abort(self, messages: list[Wrote | None]) -> None:
        fs, root = placed(self.path)
        for m in messages:
            if m and fs.get_file_info(f"{root}/{m.part}").is_file:
                fs.delete_file(f"{root}/{m.part}")


class BinaryEdges(DataSource):
    """spark.read.format("binary_edges").option("weighted", True).load(path)"""

    @classmethod
    def name(cls) -> str:
        return "binary_edges"

    def _columns(self) -> list[str]:
        return columns_of(flag(self.options, "weighted"), flag(self.options, "typed"))

    def schema(self) -> T.StructType:
        return schema_of(self._columns())

    def reader(self, schema: T.StructType) -> BinaryReader:
        return BinaryReader(self.options["path"], self._columns(), int(self.options.get("split", SPLIT)))

    def writer(self, schema: T.StructType, overwrite: bool) -> BinaryWriter:
        columns = self._columns()
        if missing := set(columns) - set(schema.names):
            raise EdgeFileError(f"columns are missing: {sorted(missing)}")
        return BinaryWriter(self.options["path"], columns, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(BinaryEdges)


def read_text(spark: SparkSession, path: str, weighted: bool = True, typed: bool = False) -> DataFrame:
    """Edge list with any white space between fields; a line that does not fit raises."""
    columns = columns_of(weighted, typed)
    rows = spark.read.text(path).where(F.trim(F.translate("value", "\t\r", "  ")) != "")
    f = F.split(F.trim(F.translate("value", "\t\r", "  ")), " +")
    bad = F.raise_error(F.concat(F.lit("not an edge: "), F.col("value")))
    checked = rows.select(F.when(F.size(f) == len(columns), f).otherwise(bad).alias("f"))
    return checked.select(*[F.col("f")[k].cast(schema_of(columns)[k].dataType).alias(c) for k, c in enumerate(columns)])


def read_edges(spark: SparkSession, path: str, fmt: str = "binary", weighted: bool = True, typed: bool = False) -> DataFrame:
    if fmt == "binary":
        register(spark)
        return spark.read.format("binary_edges").option("weighted", weighted).option("typed", typed).load(path)
    if fmt == "text":
        return read_text(spark, path, weighted, typed)
    if fmt == "parquet":
        return spark.read.parquet(path)
    raise EdgeFileError(f"unknown format {fmt!r}")


def write_edges(df: DataFrame, path: str, fmt: str = "binary") -> None:
    columns = columns_of("weight" in df.columns, "etype" in df.columns)
    rows = df.select(*[F.col(c).cast(FIELDS[c][1]).alias(c) for c in columns])
    if fmt == "binary":
        register(df.sparkSession)
        rows.write.format("binary_edges").option("weighted", "weight" in columns).option("typed", "etype" in columns).mode("overwrite").save(path)
    elif fmt == "text":
        rows.select(F.concat_ws(" ", *[F.format_string("%f", F.col(c)) if c == "weight" else F.col(c).cast("string") for c in columns]).alias("value")).write.mode("overwrite").text(path)
    elif fmt == "parquet":
        rows.write.mode("overwrite").parquet(path)
    else:
        raise EdgeFileError(f"unknown format {fmt!r}")


def convert(spark: SparkSession, source: str, target: str, weighted: bool = True, typed: bool = False, source_fmt: str = "text", target_fmt: str = "binary") -> None:
    write_edges(read_edges(spark, source, source_fmt, weighted, typed), target, target_fmt)


def read_schemes(path: str) -> list[tuple[int, int, int, bool]]:
    """Text: `schemes types`, then for each scheme its length and as many rows of 0 and 1; gives (scheme, pos, etype, allowed)."""
    fs, where = placed(path)
    with fs.open_input_stream(where) as f:
        words = iter(re.findall(r"\S+", f.read().decode()))
    try:
        n, types = int(next(words)), int(next(words))
        out = [(s, j, k, int(next(words)) != 0) for s in range(n) for j in range(int(next(words))) for k in range(types)]
    except StopIteration:
        raise EdgeFileError(f"{path} ends too early") from None
    except ValueError as e:
        raise EdgeFileError(f"{path}: {e}") from None
    if next(words, None) is not None:
        raise EdgeFileError(f"{path} has more than it declares")
    return out


def write_schemes(rows: list[tuple[int, int, int, bool]], path: str) -> None:
    allowed = {(s, j, k): a for s, j, k, a in rows}
    n, types = 1 + max(s for s, *_ in rows), 1 + max(k for *_, k, _ in rows)
    lines = [f"{n} {types}"]
    for s in range(n):
        length = 1 + max(j for t, j, *_ in rows if t == s)
        lines += [str(length), *(" ".join(str(int(allowed.get((s, j, k), False))) for k in range(types)) for j in range(length))]
    fs, where = placed(path)
    with fs.open_output_stream(where) as f:
        f.write(("\n".join(lines) + "\n").encode())


def scheme_rows(df: DataFrame, most: int = 100_000) -> list[tuple[int, int, int, bool]]:
    """Schemes (scheme_id, pos, etype, allowed) as rows; a scheme file is one file, and a table of more rows is refused."""
    rows = list(islice(df.select("scheme_id", "pos", "etype", "allowed").limit(most + 1).toLocalIterator(), most + 1))
    if len(rows) > most:
        raise EdgeFileError(f"more than {most} rows of schemes")
    return [tuple(r) for r in rows]
