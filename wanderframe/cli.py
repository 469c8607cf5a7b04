"""Command line: one subcommand for each walk, and the converter.

    python -m wanderframe.cli deepwalk -g edges.bin -v 34 -w 34 -l 80 -s weighted -o walks
    python -m wanderframe.cli node2vec -g edges.bin -v 34 -w 34 -l 80 -p 2 -q 0.5 -s weighted -o walks
    python -m wanderframe.cli convert -i edges.txt -o edges.bin -s weighted
"""

from __future__ import annotations

import argparse
import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession

from wanderframe.operators import apps
from wanderframe.operators.graph import Graph
from wanderframe.plans.engine import random_walk
from wanderframe.plans.spec import WalkConfig, WalkerConfig
from wanderframe.sources import edges as io


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="wanderframe", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = top.add_subparsers(dest="app", required=True)

    def walk(name: str) -> argparse.ArgumentParser:
        p = sub.add_parser(name)
        p.add_argument("-v", type=int, required=True, help="number of vertices")
        p.add_argument("-g", required=True, help="graph file or folder")
        p.add_argument("--format", choices=("binary", "text", "parquet"), default="binary")
        p.add_argument("--make-undirected", action="store_true")
        p.add_argument("-w", type=int, required=True, help="number of walkers")
        p.add_argument("-o", help="folder for the paths; without it the walk is only run")
        p.add_argument("--head", action="store_true", help="begin each line with the walker and the length of its path")
        p.add_argument("-r", type=float, default=1.0, help="share of the walkers in each epoch")
        p.add_argument("-s", choices=("weighted", "unweighted"), required=True)
        p.add_argument("--strategy", choices=("auto", "tasks", "supersteps", "recursive"), default="auto")
        return p

    for name in ("deepwalk", "node2vec", "metapath", "biased", "dynamic"):
        p = walk(name)
        p.add_argument("-l", type=int, required=True, help="number of moves")
        if name == "node2vec":
            p.add_argument("-p", type=float, required=True)
            p.add_argument("-q", type=float, required=True)
        if name == "metapath":
            p.add_argument("--schemes", required=True, help="scheme file")
    p = walk("ppr")
    p.add_argument("-t", type=float, required=True, help="probability to stop")
    p.add_argument("--starts", type=int, nargs="+", help="start vertices")
    walk("simple")
    p = sub.add_parser("convert")
    p.add_argument("-i", required=True)
    p.add_argument("-o", required=True)
    p.add_argument("-s", choices=("weighted", "unweighted"), required=True)
    return top


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(args)
    spark = spark or SparkSession.builder.getOrCreate()
    weighted = a.s == "weighted"
    if a.app == "convert":
        io.convert(spark, a.i, a.o, weighted)
        return 0
    df = io.read_edges(spark, a.g, a.format, weighted or a.app == "biased", typed=a.app == "metapath")
    graph = Graph(df, a.v)
    graph = (graph.undirected() if a.make_undirected else graph).validated()
    state: dict = {}
    starts: str | list[int] = "equal"
    if a.app == "ppr":
        spec = apps.ppr(a.t, weighted)
        starts = a.starts or "equal"
    elif a.app == "simple":
        spec = apps.simple_walk()
    elif a.app == "node2vec":
        state, spec = apps.node2vec(a.l, a.p, a.q, weighted)
    elif a.app == "dynamic":
        state, spec = apps.dynamic_walk(a.l, weighted)
    elif a.app == "metapath":
        graph, state, spec = apps.metapath(graph, apps.Schemes(io.read_schemes(a.schemes)), a.l, weighted)
    else:
        spec = apps.deepwalk(a.l, weighted or a.app == "biased")
    began = time.perf_counter()
    walks = random_walk(graph, WalkerConfig(a.w, starts=starts, **state), spec, WalkConfig(rate=a.r, strategy=a.strategy, output=str(Path(a.o)) if a.o else None, with_head=a.head, discard=bool(a.o)))
    if not a.o:
        walks.write.format("noop").mode("overwrite").save()
    print(f"{a.app}: {time.perf_counter() - began:.2f} s", file=sys.stderr)
    return 0


if __name__ == "__main__":
    sys.exit(main())
