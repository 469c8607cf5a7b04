"""Walk tables as paths, and back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def to_paths(walks: DataFrame) -> DataFrame:
    """(wid, path, path_length): the vertices of each walker in order of step."""
    rows = walks.groupBy("wid").agg(F.array_sort(F.collect_list(F.struct("step", "v"))).alias("_p"))
    return rows.select("wid", F.transform("_p", lambda x: x["v"]).alias("path"), F.size("_p").cast("long").alias("path_length"))


def to_visits(paths: DataFrame) -> DataFrame:
    return paths.select("wid", F.posexplode("path").alias("_i", "v")).select("wid", F.col("_i").cast("long").alias("step"), "v")


def path_lines(walks: DataFrame, with_head: bool = False) -> DataFrame:
    """(wid, line): a blank and the vertex for each step, with `wid length` in front if with_head."""
    body = F.concat(F.lit(" "), F.array_join(F.col("path").cast("array<string>"), " "))
    head = F.concat_ws(" ", F.col("wid").cast("string"), F.col("path_length").cast("string"))
    return to_paths(walks).select("wid", (F.concat(head, body) if with_head else body).alias("line"))


def write_paths(walks: DataFrame, where: str, with_head: bool = False) -> None:
    path_lines(walks, with_head).select("line").write.mode("overwrite").text(where)
