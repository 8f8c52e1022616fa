"""Dual graph, space-filling-curve and refined partitions, quality."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import elements as E


def cell_node_csr(cells: DataFrame) -> DataFrame:
    """(elem_id, pos, node0): the CSR rows with 0-based nodes."""
    return cells.select("elem_id", F.posexplode("nodes").alias("pos", "n")).select("elem_id", "pos", (F.col("n") - 1).alias("node0"))


def dual_graph(cells: DataFrame, common: int = 4) -> DataFrame:
    """(a, b, n_shared), a < b: cells sharing at least min(common, fewer nodes - 1) nodes.

    A node's cells are few and bounded by the mesh, so pairs per node are local; the counts are
    aggregated before they move.  Sizes of exploded rows are estimated far too low, so the join is
    told to merge: a broadcast would hold all nodes of all cells in the driver."""
    each = cells.select("elem_id", F.size("nodes").alias("n"), F.explode("nodes").alias("node_id"))
    other = each.select(F.col("elem_id").alias("b"), F.col("n").alias("nb"), "node_id")
    pairs = each.withColumnRenamed("elem_id", "a").join(other.hint("merge"), "node_id").where("a < b").groupBy("a", "b", "n", "nb").agg(F.count("*").alias("n_shared"))
    return pairs.where(F.col("n_shared") >= F.least(F.lit(common), F.col("n") - 1, F.col("nb") - 1)).select("a", "b", "n_shared")


def face_graph(cells: DataFrame) -> DataFrame:
    """(a, b), a < b: cells sharing a face; for conforming meshes, one equi-join on the face key."""
    from .topology import cell_faces

    f = cell_faces(cells).select("elem_id", "face_key")
    return f.groupBy("face_key").agg(F.min("elem_id").alias("a"), F.max("elem_id").alias("b")).where("a < b").select("a", "b")


#: Masks and shifts that move the bits of a 21-bit number three places apart, a step each.
SPREAD = ((32, 0x1F00000000FFFF), (16, 0x1F0000FF0000FF), (8, 0x100F00F00F00F00F), (4, 0x10C30C30C30C30C3), (2, 0x1249249249249249))
AXIS_BITS = 21


def morton(x: Column, y: Column, z: Column) -> Column:
    """Interleaved bits of three integers from 0 to 2**21 - 1, by shifts and masks in generated code."""

    def spread(v: Column) -> Column:
        for by, mask in SPREAD:
            v = v.bitwiseOR(F.shiftleft(v, by)).bitwiseAND(F.lit(mask))
        return v

    return spread(x).bitwiseOR(F.shiftleft(spread(y), 1)).bitwiseOR(F.shiftleft(spread(z), 2))


def curve_codes(centers: DataFrame) -> DataFrame:
    """(elem_id, code): Morton codes of the centres, scaled to their bounding box (one row, broadcast)."""
    top = (1 << AXIS_BITS) - 1
    box = centers.agg(*[f(a).alias(f"{n}_{a}") for a in "xyz" for n, f in (("lo", F.min), ("hi", F.max))])

    def scaled(a: str) -> Column:
        size = F.col(f"hi_{a}") - F.col(f"lo_{a}")
        return F.when(size > 0, F.floor((F.col(a) - F.col(f"lo_{a}")) / size * top)).otherwise(0).cast("long")

    return centers.crossJoin(F.broadcast(box)).select("elem_id", morton(*[scaled(a) for a in "xyz"]).alias("code"))


def sfc_partition(centers: DataFrame, parts: int) -> DataFrame:
    """(elem_id, part_id): equal runs along the Morton curve of the centres.

    Ranks add up over three levels of the curve: at most 2**15 coarse cubes, at most 2**15 finer ones in each, and
    the cells of a finer cube; each level counts what the next one holds, so no window holds more."""
    fine, coarse = 3 * AXIS_BITS - 30, 3 * AXIS_BITS - 15
    coded = curve_codes(centers).withColumn("fine", F.shiftright("code", fine)).withColumn("coarse", F.shiftright("code", coarse))
    counts = coded.groupBy("coarse", "fine").agg(F.count("*").alias("n"))
    earlier = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    tops = counts.groupBy("coarse").agg(F.sum("n").alias("n")).select("coarse", earlier(Window.orderBy("coarse")).alias("outer"), F.sum("n").over(Window.partitionBy()).alias("total"))
    inner = counts.select("coarse", "fine", earlier(Window.partitionBy("coarse").orderBy("fine")).alias("inner"))
    start = inner.join(F.broadcast(tops), "coarse").select("fine", (F.col("outer") + F.col("inner")).alias("before"), "total")
    rank = F.row_number().over(Window.partitionBy("fine").orderBy("code", "elem_id")) - 1
    at = coded.select("elem_id", "code", "fine").withColumn("rank", rank).join(start, "fine").withColumn("at", F.col("before") + F.col("rank"))
    # Runs as ntile makes them: the first total % parts runs are one longer.
    q_, r_ = F.floor(F.col("total") / parts), F.col("total") % parts
    long_ = r_ * (q_ + 1)
    part = F.when(F.col("at") < long_, F.floor(F.col("at") / (q_ + 1))).otherwise(r_ + F.floor((F.col("at") - long_) / q_))
    return at.select("elem_id", part.cast("int").alias("part_id"))


def _written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder (spark.checkpoint.dir); only a local session gets one of its own where it is unset."""
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='meshloom-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/meshloom/graph-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Moves of one gain into a part are admitted in this many steps, by a hash of the cell.
STEPS = 1024


def refine(parts: DataFrame, edges: DataFrame, n_parts: int, rounds: int = 2, imbalance: float = 1.05) -> DataFrame:
    """Label propagation that lowers the edge cut: a cell moves to the part most of its neighbours are in
    if that gains edges and the part stays within `imbalance` of the mean; moves of even and odd rounds
    go up and down in part number, so two neighbours never swap.

    What a part admits is a threshold: moves are counted by gain and STEPS hash steps (at most a few
    thousand counts a part), and the levels that fit from the highest gain on are admitted.  Each round is written
    to the shared folder, which cuts lineage."""
    both = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a")))
    parts, both = _written(parts), _written(both)
    most = F.floor(parts.agg(F.count("*")).first()[0] * F.lit(imbalance) / n_parts)
    for k in range(rounds):
        around = both.join(parts.select(F.col("elem_id").alias("b"), F.col("part_id").alias("to")), "b").groupBy("a", "to").agg(F.count("*").alias("n"))
        mine = around.join(parts.withColumnRenamed("elem_id", "a"), "a").groupBy("a", "part_id").agg(
            F.coalesce(F.max(F.when(F.col("to") == F.col("part_id"), F.col("n"))), F.lit(0)).alias("own"),
            F.max(F.when(F.col("to") > F.col("part_id") if k % 2 == 0 else F.col("to") < F.col("part_id"), F.struct("n", (-F.col("to")).alias("m")))).alias("x"),
        )
        gain = F.col("x.n") - F.col("own")
        best = mine.where(gain > 0).select(F.col("a").alias("elem_id"), (-F.col("x.m")).cast("int").alias("to"), (gain * STEPS + F.col("a") * 40503 % STEPS).alias("level"))
        sizes = parts.groupBy(F.col("part_id").alias("to")).agg(F.count("*").alias("size"))
        levels = best.groupBy("to", "level").agg(F.count("*").alias("n"))
        upto = F.sum("n").over(Window.partitionBy("to").orderBy(F.desc("level")).rowsBetween(Window.unboundedPreceding, 0))
        admitted = levels.select("to", "level", upto.alias("upto")).join(sizes, "to").where(F.col("upto") + F.col("size") <= most).groupBy("to").agg(F.min("level").alias("least"))
        moves = best.join(F.broadcast(admitted), "to").where("level >= least").select("elem_id", "to")  # one row a part
        parts = _written(parts.join(moves, "elem_id", "left").select("elem_id", F.coalesce("to", "part_id").alias("part_id")))
    return parts


def edge_cut(edges: DataFrame, parts: DataFrame) -> DataFrame:
    a = parts.select(F.col("elem_id").alias("a"), F.col("part_id").alias("pa"))
    b = parts.select(F.col("elem_id").alias("b"), F.col("part_id").alias("pb"))
    return edges.join(a, "a").join(b, "b").agg(F.count(F.when(F.col("pa") != F.col("pb"), 1)).alias("edge_cut"), F.count("*").alias("n_edges"))


def balance(parts: DataFrame) -> DataFrame:
    return parts.groupBy("part_id").agg(F.count("*").alias("n")).agg(F.min("n").alias("min_cells"), F.max("n").alias("max_cells"), F.round(F.max("n") / F.avg("n"), 6).alias("imbalance"))
