"""Command line: `python -m meshloom cut SOURCE TARGET --np 8 --nx 2 --ny 2 --nz 2`."""

from __future__ import annotations

import argparse
import sys


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="meshloom")
    cut = top.add_subparsers(dest="command", required=True).add_parser("cut", help="cut a mesh into parts and write them")
    cut.add_argument("source")
    cut.add_argument("target")
    cut.add_argument("--method", choices=("cartesian", "graph"), default="cartesian")
    cut.add_argument("--np", type=int, required=True, help="number of parts")
    for axis in ("nx", "ny", "nz"):
        cut.add_argument(f"--{axis}", type=int, default=0, help="boxes along this axis")
    cut.add_argument("--multizone", action="store_true", help="fluid sections are written first, and every part must have some")
    cut.add_argument("--fluid", default="", help="patterns of fluid section names, separated by commas")
    cut.add_argument("--interior", help="pattern of interior section names")
    cut.add_argument("--weight", help="weight file")
    cut.add_argument("--overwrite", action="store_true")
    return top


def main(args: list[str] | None = None) -> int:
    from pyspark.sql import SparkSession

    from .plans.cut import cut_files
    from .sources.mesh import MeshError

    o = parser().parse_args(args)
    spark = SparkSession.builder.appName("meshloom").getOrCreate()
    try:
        fluid = tuple(x for x in o.fluid.split(",") if x)
        cut_files(spark, o.source, o.target, o.np, o.method, o.nx, o.ny, o.nz, o.multizone, fluid, o.interior, o.weight, "overwrite" if o.overwrite else "errorifexists")
    except MeshError as e:
        print(e, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
