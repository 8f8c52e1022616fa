"""Faces: expansion, parity, boundary, interior and interfaces between parts.

part_id is a column throughout; joins and groups hash on the face key, so neither a large part nor
a small number of parts limits parallelism.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import elements as E
from ..functions import geometry as G


def cell_faces(cells: DataFrame) -> DataFrame:
    """cells(..., elem_id, elem_type, nodes) -> a row per face: face_no, face_nodes, face_key."""
    keep = [c for c in cells.columns if c not in ("nodes",)]
    out = cells.select(*keep, F.posexplode(E.faces(F.col("nodes"), F.col("elem_type"))).alias("face_no", "face_nodes"))
    return out.withColumn("face_key", E.face_key(F.col("face_nodes")))


def outer_faces(cells: DataFrame) -> DataFrame:
    """cells(part_id, elem_id, elem_type, nodes) -> (part_id, face_key, face_nodes) of the keys met an odd
    number of times in a part; the winding is that of the last cell (greatest id).

    Only a count and one packed number are aggregated (fixed width, hashed); windings come back from
    the cells of the survivors."""
    faces = cell_faces(cells).select("part_id", "face_key", (F.col("elem_id") * 8 + F.col("face_no")).alias("packed"))
    odd = faces.groupBy("part_id", "face_key").agg(F.count("*").alias("n"), F.max("packed").alias("packed")).where("n % 2 = 1")
    odd = odd.select("part_id", "face_key", F.shiftright("packed", 3).alias("elem_id"), (F.col("packed") % 8).cast("int").alias("face_no"))
    wound = odd.join(cells.select("part_id", "elem_id", "elem_type", "nodes"), ["part_id", "elem_id"])
    return wound.select("part_id", "face_key", E.faces(F.col("nodes"), F.col("elem_type"))[F.col("face_no")].alias("face_nodes"))


def boundary_faces(outer: DataFrame, boundary: DataFrame) -> DataFrame:
    """Outer faces listed in boundary sections; of several entries the first (section, element) counts."""
    listed = boundary.select("section_id", "elem_id", E.face_key(F.col("nodes")).alias("face_key"), F.col("nodes").alias("listed_nodes"))
    first = F.row_number().over(Window.partitionBy("part_id", "face_key").orderBy("section_id", "elem_id"))
    return outer.select("part_id", "face_key").join(listed, "face_key").withColumn("rank", first).where("rank = 1").select("part_id", "section_id", "elem_id", "face_key", F.col("listed_nodes").alias("face_nodes"))


def open_faces(outer: DataFrame, bounded: DataFrame) -> DataFrame:
    return outer.join(bounded.select("part_id", "face_key"), ["part_id", "face_key"], "left_anti")


def interfaces(open_: DataFrame) -> DataFrame:
    """(part_id, nbr_id, face_key, face_nodes): open faces that another part has too; both sides."""
    other = open_.select(F.col("part_id").alias("nbr_id"), "face_key")
    return open_.join(other, "face_key").where("part_id != nbr_id").select("part_id", "nbr_id", "face_key", "face_nodes")


def unmatched_faces(open_: DataFrame, met: DataFrame) -> DataFrame:
    return open_.join(met.select("part_id", "face_key").distinct(), ["part_id", "face_key"], "left_anti")


def interior_faces(interior: DataFrame, part_nodes: DataFrame) -> DataFrame:
    """Interior faces all of whose nodes a part has: (part_id, section_id, elem_id)."""
    each = interior.select("section_id", "elem_id", F.size("nodes").alias("n"), F.explode("nodes").alias("node_id"))
    met = each.join(part_nodes.select("part_id", "node_id"), "node_id").groupBy("part_id", "section_id", "elem_id", "n").agg(F.count_distinct("node_id").alias("have"))
    return met.where("have = n").select("part_id", "section_id", "elem_id")


def with_points(cells: DataFrame, nodes: DataFrame, id_cols: tuple[str, ...] = ("elem_id",)) -> DataFrame:
    """Cells with `points`, eight structs of their nodes' coordinates in order, null where a cell has no such node:
    a join on node id and one grouping by cell.  Each place has the largest of each coordinate, so cells or nodes
    that are listed twice count once, and a missing node moves no other."""
    each = cells.select(*id_cols, "elem_type", F.posexplode("nodes").alias("pos", "node_id"))
    placed = [F.max(F.when(F.col("pos") == i, F.col(a))).alias(f"{a}{i}") for i in range(8) for a in G.AXES]
    met = each.join(nodes.hint("merge"), "node_id").groupBy(*id_cols, "elem_type").agg(*placed)
    return met.select(*id_cols, "elem_type", F.array(*[F.struct(*[F.col(f"{a}{i}").alias(a) for a in G.AXES]) for i in range(8)]).alias("points"))


def centers(cells: DataFrame, nodes: DataFrame, id_cols: tuple[str, ...] = ("elem_id",)) -> DataFrame:
    """(ids, elem_type, x, y, z) of the centroids."""
    return G.add_centroid(with_points(cells, nodes, id_cols))
