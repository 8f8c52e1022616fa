"""Weighted Cartesian boxes: weights, cuts, box assignment, grid neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.elements import constant_table

AXES = ("x", "y", "z")


def uniform_weights(spark: SparkSession, n: tuple[int, int, int]) -> DataFrame:
    rows = [(a, i, 1.0 / k) for a, k in zip(AXES, n, strict=True) for i in range(k)]
    return constant_table(spark, rows, "axis string, idx int, w double")


def normalized(weights: DataFrame) -> DataFrame:
    return weights.withColumn("w", F.col("w") / F.sum("w").over(Window.partitionBy("axis").orderBy("idx").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))


def prefixed(weights: DataFrame) -> DataFrame:
    """Adds lo_cum, the sum of the weights before."""
    before = Window.partitionBy("axis").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    return weights.withColumn("lo_cum", F.coalesce(F.sum("w").over(before), F.lit(0.0)))


def bounding_box(nodes: DataFrame) -> DataFrame:
    return nodes.agg(*[f(a).alias(f"{n}_{a}") for a in AXES for n, f in (("min", F.min), ("max", F.max))])


def location(rank: Column, nx: int, ny: int) -> tuple[Column, Column, Column]:
    """(i, j, k) of a rank: j runs fastest, then i, then k."""
    k = F.floor(rank / (nx * ny))
    return F.floor((rank - k * nx * ny) / ny).cast("int"), (rank % ny).cast("int"), k.cast("int")


def rank_of(i: Column, j: Column, k: Column, nx: int, ny: int) -> Column:
    return (k * nx * ny + i * ny + j).cast("int")


def part_boxes(nodes: DataFrame, weights: DataFrame, nx: int, ny: int) -> DataFrame:
    """(part_id, min_x, max_x, ...) of every part; weights(axis, idx, w, lo_cum)."""
    box = bounding_box(nodes)
    one = {a: weights.where(F.col("axis") == a).select(F.col("idx").alias(f"i_{a}"), F.col("w").alias(f"w_{a}"), F.col("lo_cum").alias(f"c_{a}")) for a in AXES}
    grid = F.broadcast(box).crossJoin(one["x"]).crossJoin(one["y"]).crossJoin(one["z"])  # np rows: the grid itself
    low = {a: F.col(f"min_{a}") + (F.col(f"max_{a}") - F.col(f"min_{a}")) * F.col(f"c_{a}") for a in AXES}
    cols = [c for a in AXES for c in (low[a].alias(f"min_{a}"), (low[a] + (F.col(f"max_{a}") - F.col(f"min_{a}")) * F.col(f"w_{a}")).alias(f"max_{a}"))]
    return grid.select(rank_of(F.col("i_x"), F.col("i_y"), F.col("i_z"), nx, ny).alias("part_id"), *cols)


def cuts(nodes: DataFrame, weights: DataFrame) -> DataFrame:
    """One row: arrays cut_x, cut_y, cut_z of inner cut planes, ascending."""
    box = bounding_box(nodes)
    inner = weights.where("idx > 0").groupBy().pivot("axis", list(AXES)).agg(F.sort_array(F.collect_list("lo_cum")).alias("c"))
    plane = lambda a: F.transform(F.coalesce(F.col(a), F.array().cast("array<double>")), lambda c: F.col(f"min_{a}") + (F.col(f"max_{a}") - F.col(f"min_{a}")) * c)
    return box.crossJoin(inner).select(*[plane(a).alias(f"cut_{a}") for a in AXES])


def assign(centers: DataFrame, nodes: DataFrame, weights: DataFrame, nx: int, ny: int) -> DataFrame:
    """Adds part_id: along each axis the number of cuts at or below the centre (half-open boxes, so
    every cell is in one part).  A projection: the one-row cut table is the only thing joined."""
    idx = {a: F.size(F.filter(F.col(f"cut_{a}"), lambda c: c <= F.col(a))) for a in AXES}
    joined = centers.crossJoin(F.broadcast(cuts(nodes, weights)))
    return joined.withColumn("part_id", rank_of(idx["x"], idx["y"], idx["z"], nx, ny)).drop(*[f"cut_{a}" for a in AXES])


def in_box(box: dict[str, Column]) -> Column:
    """Centre in a box, both ends inclusive."""
    out = F.lit(True)
    for a in AXES:
        out = out & F.col(a).between(box[f"min_{a}"], box[f"max_{a}"])
    return out


def held(centers: DataFrame) -> DataFrame:
    """centers with x, y, z as finished values: what filters by them doesn't repeat how they are computed, which
    would make generated code too large to compile."""
    keep = [c for c in centers.columns if c not in AXES]
    return centers.select(*keep, F.explode(F.array(F.struct(*AXES))).alias("__at")).select(*keep, *[F.col(f"__at.{a}").alias(a) for a in AXES])


def box_pick(centers: DataFrame, boxes: DataFrame) -> DataFrame:
    """Inclusive boxes, as a range join: a centre on a cut is in both parts.  boxes has one row a part."""
    return held(centers).join(F.broadcast(boxes), in_box({c: F.col(c) for c in boxes.columns}))


def neighbours(spark: SparkSession, nx: int, ny: int, nz: int) -> DataFrame:
    """(part_id, nbr_id) of the 26-neighbourhood in the grid."""
    n = nx * ny * nz
    a = spark.range(n).select(F.col("id").alias("r"))
    i, j, k = location(F.col("r"), nx, ny)
    a = a.select(F.col("r").cast("int").alias("part_id"), i.alias("i"), j.alias("j"), k.alias("k"))
    step = F.explode(F.array(*[F.lit(v) for v in (-1, 0, 1)]))
    near = a.withColumn("di", step).withColumn("dj", step).withColumn("dk", step).where("di != 0 OR dj != 0 OR dk != 0")
    near = near.select("part_id", (F.col("i") + F.col("di")).alias("i"), (F.col("j") + F.col("dj")).alias("j"), (F.col("k") + F.col("dk")).alias("k"))
    near = near.where(F.col("i").between(0, nx - 1) & F.col("j").between(0, ny - 1) & F.col("k").between(0, nz - 1))
    return near.select("part_id", rank_of(F.col("i"), F.col("j"), F.col("k"), nx, ny).alias("nbr_id"))
