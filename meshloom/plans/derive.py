"""Meshes derived from the driver's tables, by integer arithmetic.

A dense 0-based key p is cell p + 1 of a lattice 10 wide and 10 deep: i = p % 10, j = p / 10 % 10,
k = p / 100.  Nodes lie on the lattice points with a dyadic jitter.  All of it is narrow: each row
emits its own cell and faces, and nodes are a range, so a mesh costs no shuffle, whatever its length.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.elements import constant_table

WIDE = 10


@dataclass
class Mesh:
    """nodes(node_id, x, y, z); elements(section_id, elem_id, elem_type, nodes);
    sections(section_id, name, elem_type, start, end, n_bdy, n_elem)."""

    nodes: DataFrame
    elements: DataFrame
    sections: DataFrame
    layers: int


NAMES = {1: "FLUID_a", 2: "SOLID_b", 3: "INLET", 4: "OUTLET", 5: "WALL", 6: "INTERIOR_mid"}
BODY = (1, 2)
BOUNDARY = (3, 4, 5)
INTERIOR = (6,)


def node_at(i: Column, j: Column, k: Column) -> Column:
    return (1 + i + 11 * (j + 11 * k)).cast("long")


def coordinates(node: Column, i: Column, j: Column, k: Column) -> list[Column]:
    return [(v + ((node * 7919 + s) % 16) / 256.0).cast("double").alias(a) for a, v, s in (("x", i, 0), ("y", j, 5), ("z", k, 11))]


def lattice(keys: DataFrame, key: str) -> DataFrame:
    p = F.col(key)
    return keys.select(p.cast("long").alias("p"), (p % 10).cast("long").alias("i"), (F.floor(p / 10) % 10).alias("j"), F.floor(p / 100).cast("long").alias("k"), *[F.col(c) for c in keys.columns if c != key])


def corners(i: Column, j: Column, k: Column) -> list[Column]:
    return [node_at(i + a, j + b, k + c) for a, b, c in ((0, 0, 0), (1, 0, 0), (1, 1, 0), (0, 1, 0), (0, 0, 1), (1, 0, 1), (1, 1, 1), (0, 1, 1))]


def _emit(rows: list[tuple[Column, Column, Column, Column]]) -> Column:
    """Array of (section, elem, nodes) structs of the rows whose condition holds."""
    made = F.array(*[F.when(cond, F.struct(sec.cast("int").alias("section_id"), elem.cast("long").alias("elem_id"), nodes.alias("nodes"))) for cond, sec, elem, nodes in rows])
    return F.filter(made, lambda x: x.isNotNull())


def hex_mesh(keys: DataFrame, key: str, solid: Column) -> Mesh:
    """Hexahedra with body, boundary and interior sections.  solid: flag of rows in the solid section."""
    spark = keys.sparkSession
    cells = lattice(keys.withColumn("solid", solid).select(key, "solid"), key)
    last = keys.agg(F.max(key)).first()[0]
    n = 0 if last is None else last + 1
    layers = n // (WIDE * WIDE)
    planes = 0 if last is None else layers + 1  # of nodes; as in the SQL, none without a key
    i, j, k = F.col("i"), F.col("j"), F.col("k")
    c = corners(i, j, k)
    lit = F.lit
    base = n + 200
    rows = [(lit(True), F.when(F.col("solid"), lit(2)).otherwise(lit(1)), F.col("p") + 1, F.array(*c))]
    flat = i + 10 * j
    rows += [(k == 0, lit(3), n + 1 + flat, F.array(c[0], c[3], c[2], c[1])), (k == layers - 1, lit(4), n + 101 + flat, F.array(*c[4:]))]
    sides = ((j == 0, 0, i, (0, 1, 5, 4)), (i == 9, 1, j, (1, 2, 6, 5)), (j == 9, 2, i, (2, 3, 7, 6)), (i == 0, 3, j, (0, 4, 7, 3)))
    rows += [(cond, lit(5), base + 1 + (k * 4 + s) * 10 + t, F.array(*[c[x] for x in f])) for cond, s, t, f in sides]
    rows += [(i == 5, lit(6), base + 40 * layers + 1 + j + 10 * k, F.array(c[0], c[4], c[7], c[3]))]
    elements = cells.select(F.explode(_emit(rows)).alias("e")).select("e.section_id", "e.elem_id", F.when(F.size("e.nodes") == 8, 17).otherwise(7).alias("elem_type"), "e.nodes")
    # Every point of the lattice up to the last key's layer, as in the SQL: cells on either side of a gap keep theirs.
    at = F.col("node_id") - 1
    points = spark.range(1, 121 * planes + 1).select(F.col("id").alias("node_id")).select("node_id", (at % 11).alias("i"), (F.floor(at / 11) % 11).alias("j"), F.floor(at / 121).alias("k"))
    nodes = points.select("node_id", *coordinates(F.col("node_id"), i, j, k))
    # Sections are a handful of rows; their ranges follow from the lattice, without a scan of the elements.
    head = elements.groupBy("section_id").agg(F.min("elem_type").alias("elem_type"), F.min("elem_id").alias("start"), F.max("elem_id").alias("end"), F.count("*").alias("n_elem"))
    named = constant_table(spark, NAMES.items(), "section_id int, name string")
    sections = head.join(F.broadcast(named), "section_id").select("section_id", "name", "elem_type", "start", "end", lit(0).alias("n_bdy"), "n_elem")
    return Mesh(nodes, elements, sections, layers)


def mixed_elements(keys: DataFrame, key: str) -> DataFrame:
    """(elem_id, elem_type, nodes): columns with (i + 10 j) % 7 = 3 as two prisms a cell, cells with
    p % 5 = 1 as six pyramids round a node 100000 + p, the others hexahedra."""
    cells = lattice(keys.select(key), key)
    p = F.col("p")
    c = corners(F.col("i"), F.col("j"), F.col("k"))
    apex = (100000 + p).cast("long")
    prism = F.array(*[F.array(*[c[x] for x in f]) for f in ((0, 1, 2, 4, 5, 6), (0, 2, 3, 4, 6, 7))])
    pyramid = F.array(*[F.array(*[c[x] for x in f], apex) for f in ((0, 3, 2, 1), (0, 1, 5, 4), (1, 2, 6, 5), (2, 3, 7, 6), (0, 4, 7, 3), (4, 5, 6, 7))])
    pieces = F.when((F.col("i") + 10 * F.col("j")) % 7 == 3, prism).when(p % 5 == 1, pyramid).otherwise(F.array(F.array(*c)))
    out = cells.select("p", F.posexplode(pieces).alias("pos", "nodes"))
    size = F.size("nodes")
    return out.select((p * 6 + F.col("pos") + 1).cast("long").alias("elem_id"), F.when(size == 8, 17).when(size == 6, 14).otherwise(12).alias("elem_type"), "nodes")


def mixed_nodes(mesh: Mesh, keys: DataFrame, key: str) -> DataFrame:
    """The lattice's nodes and the pyramids' apexes (cell centres, not jittered).

    On lattices of 100001 nodes or more an apex can have a lattice node's id: they are one node then, and of each
    coordinate the larger counts, as in the SQL.  So cells keep a point a node.  Joins with them merge: exploded
    cells are estimated below the nodes, and would be broadcast."""
    cells = lattice(keys.select(key), key).where("p % 5 = 1 AND (i + 10 * j) % 7 != 3")
    apex = cells.select((100000 + F.col("p")).cast("long").alias("node_id"), *[(F.col(s) + 0.5).cast("double").alias(a) for a, s in (("x", "i"), ("y", "j"), ("z", "k"))])
    return mesh.nodes.union(apex).groupBy("node_id").agg(*[F.max(a).alias(a) for a in "xyz"]).hint("merge")


#: Kuhn's six tetrahedra: the corners met on the six monotone walks from corner 0 to corner 6.
KUHN = ((0, 1, 2, 6), (0, 1, 5, 6), (0, 3, 2, 6), (0, 3, 7, 6), (0, 4, 5, 6), (0, 4, 7, 6))


def tetra_elements(keys: DataFrame, key: str) -> DataFrame:
    cells = lattice(keys.select(key), key)
    c = corners(F.col("i"), F.col("j"), F.col("k"))
    out = cells.select("p", F.posexplode(F.array(*[F.array(*[c[x] for x in t]) for t in KUHN])).alias("pos", "nodes"))
    return out.select((F.col("p") * 6 + F.col("pos") + 1).cast("long").alias("elem_id"), F.lit(10).alias("elem_type"), "nodes")
