"""The whole partitioning dataflow as one logical plan."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import elements as E
from ..functions import strings as S

from ..operators import cartesian as C
from ..operators import graph as Gr
from ..operators import numbering as N
from ..operators import topology as T
from .derive import BODY, BOUNDARY, INTERIOR, Mesh


@dataclass
class Cut:
    """cells(part_id, section_id, elem_id, elem_type, nodes) and what follows from them.

    What several steps read (the assigned cells, outer and open faces) is persisted, on disk where
    memory ends; lost blocks are computed again.  release() gives it back."""

    mesh: Mesh
    cells: DataFrame
    boundary_ids: tuple[int, ...] = BOUNDARY
    interior_ids: tuple[int, ...] = INTERIOR

    def __post_init__(self) -> None:
        self.cells = self.cells.persist()

    def release(self) -> None:
        for name in ("cells", "outer", "open", "bounded"):
            if name == "cells" or name in self.__dict__:
                getattr(self, name).unpersist()

    @cached_property
    def boundary_list(self) -> DataFrame:
        return self.mesh.elements.where(F.col("section_id").isin(*self.boundary_ids))

    @cached_property
    def interior_list(self) -> DataFrame:
        return self.mesh.elements.where(F.col("section_id").isin(*self.interior_ids))

    @cached_property
    def outer(self) -> DataFrame:
        return T.outer_faces(self.cells).persist()

    @cached_property
    def bounded(self) -> DataFrame:
        return T.boundary_faces(self.outer, self.boundary_list).persist()

    @cached_property
    def open(self) -> DataFrame:
        return T.open_faces(self.outer, self.bounded).persist()

    @cached_property
    def interfaces(self) -> DataFrame:
        return T.interfaces(self.open)

    @cached_property
    def nodes(self) -> DataFrame:
        return N.part_nodes(self.cells)

    @cached_property
    def local(self) -> DataFrame:
        return N.local_ids(self.nodes)

    @cached_property
    def interior(self) -> DataFrame:
        return T.interior_faces(self.interior_list, self.nodes)

    @cached_property
    def section_sizes(self) -> DataFrame:
        """(part_id, write_seq, section_id, n) in write order: body, boundary, interior, interface (1000 + neighbour)."""
        body = self.cells.groupBy("part_id", "section_id").agg(F.count("*").alias("n")).select("part_id", "section_id", "n")
        bdy = self.bounded.groupBy("part_id", "section_id").agg(F.count("*").alias("n"))
        inner = self.interior.groupBy("part_id", "section_id").agg(F.count("*").alias("n"))
        met = self.interfaces.groupBy("part_id", (F.col("nbr_id") + 1000).alias("section_id")).agg(F.count("*").alias("n"))
        return body.union(bdy).union(inner).union(met).select("part_id", F.col("section_id").alias("write_seq"), "section_id", "n")

    def summary(self) -> DataFrame:
        """(part_id, n_cell, n_node, n_outer, n_boundary, n_interface): one grouping of all counted rows."""
        kinds = {"n_cell": self.cells, "n_node": self.nodes, "n_outer": self.outer, "n_boundary": self.bounded, "n_interface": self.interfaces}
        rows = reduce(DataFrame.union, [df.select("part_id", F.lit(name).alias("kind")) for name, df in kinds.items()])
        return rows.groupBy("part_id").agg(*[F.count(F.when(F.col("kind") == name, 1)).alias(name) for name in kinds])

    def written_rows(self, fluid: tuple[str, ...] = ()) -> DataFrame:
        """(part_id, rank, section, name, elem_id, elem_type, nodes) of everything a part's file has.  rank is the
        write order of kinds: fluid sections (names that match), other body sections, boundary, interior, interfaces."""
        names = self.mesh.sections.select("section_id", "name", reduce(lambda x, p: x | S.matches(F.col("name"), p), fluid, F.lit(False)).alias("fluid"))
        face = lambda c: F.when(F.size(c) == 3, 5).otherwise(7)
        body = self.cells.join(F.broadcast(names), "section_id").select("part_id", F.when(F.col("fluid"), 0).otherwise(1).alias("rank"), F.col("section_id").alias("section"), "name", "elem_id", "elem_type", "nodes")
        bounded = self.bounded.join(F.broadcast(names), "section_id").select("part_id", F.lit(2).alias("rank"), F.col("section_id").alias("section"), "name", "elem_id", face(F.col("face_nodes")).alias("elem_type"), F.col("face_nodes").alias("nodes"))
        inner = self.interior.join(self.interior_list.select("elem_id", "elem_type", "nodes"), "elem_id").join(F.broadcast(names), "section_id")
        inner = inner.select("part_id", F.lit(3).alias("rank"), F.col("section_id").alias("section"), "name", "elem_id", "elem_type", "nodes")
        order = F.row_number().over(Window.partitionBy("part_id", "nbr_id").orderBy("key"))  # of one interface's faces
        met = self.interfaces.withColumn("key", E.key_text(F.col("face_key"))).withColumn("elem_id", order.cast("long"))
        met = met.select("part_id", F.lit(4).alias("rank"), F.col("nbr_id").alias("section"), F.concat(F.lit("Interface_"), F.col("nbr_id").cast("string")).alias("name"), "elem_id", face(F.col("face_nodes")).alias("elem_type"), F.col("face_nodes").alias("nodes"))
        return body.union(bounded).union(inner).union(met)

    def tables(self, fluid: tuple[str, ...] = ()) -> dict[str, DataFrame]:
        """The output tables of all parts: nodes, elements (local node ids, ids in write order), sections and
        each body section's place in the whole mesh."""
        rows = self.written_rows(fluid).withColumn("seq", (F.col("rank") * (1 << 20) + F.col("section")).cast("long"))
        sizes = rows.groupBy("part_id", "seq", "rank", "section", "name").agg(F.count("*").alias("n"), F.count_distinct("elem_type").alias("k"), F.min("elem_type").alias("t"))
        ranged = N.id_ranges(sizes.withColumnRenamed("seq", "write_seq"))
        sections = ranged.select("part_id", "write_seq", "name", F.when(F.col("k") > 1, E.MIXED).otherwise(F.col("t")).alias("elem_type"), "start", "end")
        numbered = N.ordinals(rows, "part_id", "seq", "elem_id", "out_id")
        local = N.localized(numbered.select("part_id", "seq", "out_id", "elem_type", "nodes"), self.local, ("part_id", "seq", "out_id", "elem_type"))
        offsets = N.global_offsets(self.cells.groupBy("part_id", "section_id").agg(F.count("*").alias("n")))
        return {
            "nodes": self.local.join(self.mesh.nodes, "node_id").select("part_id", "local_id", "node_id", "x", "y", "z"),
            "elements": local.select("part_id", F.col("seq").alias("write_seq"), F.col("out_id").alias("elem_id"), "elem_type", "nodes"),
            "sections": sections,
            "global": offsets,
        }


def body(mesh: Mesh) -> DataFrame:
    return mesh.elements.where(F.col("section_id").isin(*BODY))


def cut_cartesian(mesh: Mesh, nx: int, ny: int, nz: int, weights: DataFrame | None = None, cells: DataFrame | None = None) -> Cut:
    """Weighted boxes over the body cells, or those given (elem_id, elem_type, section_id, nodes)."""
    w = C.prefixed(C.normalized(weights if weights is not None else C.uniform_weights(mesh.nodes.sparkSession, (nx, ny, nz))))
    cells = body(mesh) if cells is None else cells
    parts = C.assign(T.centers(cells, mesh.nodes), mesh.nodes, w, nx, ny).select("elem_id", "part_id")
    return Cut(mesh, cells.join(parts, "elem_id").select("part_id", "section_id", "elem_id", "elem_type", "nodes"))


def cut_graph(mesh: Mesh, parts: int, rounds: int = 2, cells: DataFrame | None = None) -> Cut:
    cells = body(mesh) if cells is None else cells
    first = Gr.sfc_partition(T.centers(cells, mesh.nodes), parts)
    got = Gr.refine(first, Gr.face_graph(cells), parts, rounds) if rounds else first
    return Cut(mesh, cells.join(got, "elem_id").select("part_id", "section_id", "elem_id", "elem_type", "nodes"))


def cut_files(
    spark: SparkSession, source: str, target: str, np: int, method: str = "cartesian", nx: int = 0, ny: int = 0, nz: int = 0,
    multizone: bool = False, fluid: tuple[str, ...] = (), interior: str | None = None, weight: str | None = None, mode: str = "errorifexists",
) -> None:
    """The whole tool: reads a mesh, checks the options, cuts it and writes all parts, one folder a part in each table."""
    from ..sources import mesh as Src

    if method not in ("cartesian", "graph"):
        raise Src.MeshError(f"unknown method {method}")
    Src.check_options(np, *((nx, ny, nz) if method == "cartesian" else ()), multizone=multizone, fluid=fluid)
    mesh = Src.read_mesh(spark, source)
    Src.check_names(mesh, fluid, interior)
    roles = {r.section_id: r.role for r in Src.classify(mesh, interior).select("section_id", "role").collect()}  # a few rows
    ids = lambda role: tuple(k for k, v in roles.items() if v == role)
    cells = mesh.elements.where(F.col("section_id").isin(*ids("body")))
    if method == "cartesian":
        cut = cut_cartesian(mesh, nx, ny, nz, Src.read_weights(spark, weight) if weight else None, cells)
    else:
        cut = cut_graph(mesh, np, cells=cells)
    cut.boundary_ids, cut.interior_ids = ids("boundary"), ids("interior")
    try:
        if multizone:  # every part must have fluid cells
            named = reduce(lambda x, p: x | S.matches(F.col("name"), p), fluid, F.lit(False))
            wet = cut.cells.join(F.broadcast(mesh.sections.where(named).select("section_id")), "section_id").select("part_id").distinct().count()
            if wet < np:
                raise Src.MeshError(f"only {wet} of {np} parts have fluid cells")
        Src.write_parts(cut.tables(fluid if multizone else ()), target, mode)
    finally:
        cut.release()
