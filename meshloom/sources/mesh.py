"""Mesh tables on disk, text inputs of the mesh tools, and their decoders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import elements as E
from ..functions import strings as S
from ..plans.derive import Mesh

NODES = T.StructType([T.StructField("node_id", T.LongType()), *[T.StructField(a, T.DoubleType()) for a in ("x", "y", "z")]])
ELEMENTS = T.StructType([T.StructField("section_id", T.IntegerType()), T.StructField("elem_id", T.LongType()), T.StructField("elem_type", T.IntegerType()), T.StructField("nodes", T.ArrayType(T.LongType()))])
SECTIONS = T.StructType([T.StructField("section_id", T.IntegerType()), T.StructField("name", T.StringType()), T.StructField("elem_type", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("n_bdy", T.IntegerType()), T.StructField("n_elem", T.LongType())])


class MeshError(ValueError):
    """A mesh that the operators don't take."""


def write_mesh(mesh: Mesh, path: str, mode: str = "errorifexists") -> None:
    """Parquet tables sorted by id, elements split by section: range reads prune by statistics, section reads by folder.
    mode "append" adds sections to a mesh that is there; their element ids go on after the largest one there."""
    if mode == "append":
        spark = mesh.nodes.sparkSession
        have = read_mesh(spark, path, validate=False).sections.agg((F.max("end") + 1).alias("next")).first()["next"] or 1
        by = F.lit(have) - F.lit(mesh.sections.agg(F.min("start")).first()[0] or 1)
        moved = mesh.sections.withColumn("start", F.col("start") + by).withColumn("end", F.col("end") + by)
        mesh = Mesh(mesh.nodes, mesh.elements.withColumn("elem_id", F.col("elem_id") + by), moved, mesh.layers)
    mesh.nodes.repartitionByRange("node_id").sortWithinPartitions("node_id").write.mode(mode).parquet(f"{path}/nodes")
    mesh.elements.repartitionByRange("section_id", "elem_id").sortWithinPartitions("section_id", "elem_id").write.mode(mode).partitionBy("section_id").parquet(f"{path}/elements")
    mesh.sections.write.mode(mode).parquet(f"{path}/sections")


def _table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A mesh table; coordinates of either precision are read as they are."""
    from pyspark.errors import AnalysisException

    try:
        found = spark.read.parquet(path)
    except AnalysisException as e:
        raise MeshError(f"{path} is no table of a mesh") from e
    have = {f.name: f.dataType for f in found.schema.fields}
    if missing := [f.name for f in schema.fields if f.name not in have]:
        raise MeshError(f"{path} has no column {', '.join(missing)}")
    return found.select(*[f.name if f.name in ("x", "y", "z") and isinstance(have[f.name], (T.FloatType, T.DoubleType)) else F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


def read_mesh(spark: SparkSession, path: str, validate: bool = True) -> Mesh:
    mesh = Mesh(_table(spark, f"{path}/nodes", NODES), _table(spark, f"{path}/elements", ELEMENTS), _table(spark, f"{path}/sections", SECTIONS), 0)
    if validate:
        check(mesh)
    return mesh


def precision(mesh: Mesh) -> int:
    """Bits of a coordinate: 32 or 64."""
    kinds = {mesh.nodes.schema[a].dataType.typeName() for a in ("x", "y", "z")}
    if kinds <= {"float", "double"} and len(kinds) == 1:
        return 32 if kinds == {"float"} else 64
    raise MeshError(f"coordinates of types {sorted(kinds)}")


def checks(mesh: Mesh) -> DataFrame:
    """(n_sections, n_nodes, contiguous, n_body, valid): node ids are 1..n, there is a section, body
    sections are three-dimensional, section ranges hold their elements."""
    nodes = mesh.nodes.agg(F.count("*").alias("n_nodes"), F.min("node_id").alias("lo"), F.max("node_id").alias("hi"))
    sections = mesh.sections.agg(F.count("*").alias("n_sections"), F.count(F.when(E.type_dim(F.col("elem_type")) == 3, 1)).alias("n_body"), F.coalesce(F.bool_and(F.col("end") - F.col("start") + 1 >= F.col("n_elem")), F.lit(True)).alias("ranged"))
    both = nodes.crossJoin(sections)  # one row each
    contiguous = F.coalesce((F.col("lo") == 1) & (F.col("hi") == F.col("n_nodes")), F.lit(False))
    return both.select("n_sections", "n_nodes", contiguous.alias("contiguous"), "n_body", (contiguous & F.col("ranged") & (F.col("n_sections") > 0) & (F.col("n_body") > 0)).alias("valid"))


def check(mesh: Mesh) -> None:
    row = checks(mesh).first()
    if not row.valid:
        raise MeshError(f"not a mesh of one 3-D zone: {row.asDict()}")


def check_options(np: int, nx: int = 0, ny: int = 0, nz: int = 0, multizone: bool = False, fluid: tuple[str, ...] = ()) -> None:
    if np < 2:
        raise MeshError("at least two parts are needed")
    if nx and np != nx * ny * nz:
        raise MeshError("np must be nx * ny * nz")
    if multizone and not fluid:
        raise MeshError("a mesh of several zones needs the names of its fluid sections")


def check_names(mesh: Mesh, fluid: tuple[str, ...] = (), interior: str | None = None) -> None:
    """Sections that the options name must be there."""
    for what, pattern in [("fluid", p) for p in fluid] + ([("interior", interior)] if interior else []):
        if mesh.sections.where(S.matches(F.col("name"), pattern)).isEmpty():
            raise MeshError(f"no {what} section matches {pattern}")


def node_range(mesh: Mesh, low: int, high: int) -> DataFrame:
    return mesh.nodes.where(F.col("node_id").between(low, high))


def section(mesh: Mesh, section_id: int, low: int | None = None, high: int | None = None) -> DataFrame:
    out = mesh.elements.where(F.col("section_id") == section_id)
    return out if low is None else out.where(F.col("elem_id").between(low, high))


def union_sections(mesh: Mesh, ids: tuple[int, ...], low: int | None = None, high: int | None = None) -> DataFrame:
    """Elements of several sections; with a range, sections whose header doesn't overlap it aren't read."""
    if low is not None:  # headers are a few rows
        ids = tuple(r.section_id for r in mesh.sections.where(F.col("section_id").isin(*ids) & (F.col("start") <= high) & (F.col("end") >= low)).select("section_id").collect())
    out = mesh.elements.where(F.col("section_id").isin(*ids))
    return out if low is None else out.where(F.col("elem_id").between(low, high))


def renumbered(elements: DataFrame, start: int) -> DataFrame:
    """Elements of a union with ids from `start` on, in the order of section and id."""
    from ..operators.numbering import ordinals

    numbered = ordinals(elements.withColumn("__all", F.lit(0)), "__all", "section_id", "elem_id", "__rank")
    return numbered.select(*[(F.col("__rank") + (start - 1)).alias("elem_id") if c == "elem_id" else F.col(c) for c in elements.columns])


def union_header(sections: DataFrame, ids: tuple[int, ...]) -> DataFrame:
    """(name, elem_type, start, end) of a union: MIXED if types differ."""
    s = sections.where(F.col("section_id").isin(*ids))
    out = s.agg(F.sort_array(F.collect_list(F.struct("section_id", "name"))).alias("x"), F.count_distinct("elem_type").alias("k"), F.min("elem_type").alias("t"), F.min("start").alias("start"), F.max("end").alias("end"))
    return out.select(S.composed_name(F.transform("x", lambda v: v["name"])).alias("name"), F.when(F.col("k") > 1, E.MIXED).otherwise(F.col("t")).alias("elem_type"), "start", "end")


def classify(mesh: Mesh, interior: str | None = None) -> DataFrame:
    """sections with role interior (name matches, looked at first), body (3-D) or boundary (2-D); a MIXED
    section goes by its first element."""
    first = mesh.elements.groupBy("section_id").agg(F.min_by("elem_type", "elem_id").alias("first_type"))
    dim = E.type_dim(F.when(F.col("elem_type") == E.MIXED, F.col("first_type")).otherwise(F.col("elem_type")))
    role = F.when(dim == 3, "body").when(dim == 2, "boundary").otherwise("other")
    if interior:
        role = F.when(S.matches(F.col("name"), interior), "interior").otherwise(role)
    return mesh.sections.join(first, "section_id", "left").select(*mesh.sections.columns, role.alias("role"))


def parse_weights(lines: DataFrame) -> DataFrame:
    """lines(value, line_no) of a weight file -> (axis, idx, w): its first three non-blank lines are x, y
    and z, numbers separated by spaces."""
    full = lines.where(S.trim(F.col("value")) != "").withColumn("r", F.row_number().over(Window.orderBy("line_no"))).where("r <= 3")
    out = full.select(F.element_at(F.array(F.lit("x"), F.lit("y"), F.lit("z")), F.col("r")).alias("axis"), F.posexplode(S.split(S.trim(F.col("value")), " ")).alias("idx", "s"))
    return out.select("axis", "idx", F.col("s").cast("double").alias("w"))


def read_weights(spark: SparkSession, path: str) -> DataFrame:
    text = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("line_no", "value"))
    out = parse_weights(text)
    if out.select("axis").distinct().count() != 3:
        raise MeshError("a weight file has three lines of numbers")
    return out


def mixed_decode(streams: DataFrame, key: str, data: str) -> DataFrame:
    """(key, pos, elem_type, nodes) of MIXED streams (type, nodes, type, nodes, ...); null or empty streams have
    no rows, an unknown type or a stream that ends early raises.

    Where a cell starts depends on all cells before it, so each stream is walked once, cell by cell, over Arrow
    batches; nodes are slices of the stream."""
    import pyarrow as pa

    arity = {code: n for code, _, dim, n in E.TYPES if dim >= 2}
    kind = streams.schema[key].dataType.simpleString()

    def walk(batches):
        for batch in batches:
            rows, pos, types, at, size = [], [], [], [], []
            column = batch.column(1)
            values, offsets = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
            for r in range(batch.num_rows):
                i, end, k = int(offsets[r]), int(offsets[r + 1]), 0
                while i < end and column[r].is_valid:
                    n = arity.get(int(values[i]))
                    if n is None or i + 1 + n > end:
                        raise ValueError(f"unknown element type {values[i]}" if n is None else "stream ends inside a cell")
                    rows.append(r)
                    pos.append(k)
                    types.append(int(values[i]))
                    at.append(i + 1)
                    size.append(n)
                    i, k = i + 1 + n, k + 1
            nodes = pa.array([values[a : a + n] for a, n in zip(at, size, strict=True)], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(pos, pa.int32()), pa.array(types, pa.int32()), nodes], [key, "pos", "elem_type", "nodes"])

    return streams.select(key, F.col(data).cast("array<bigint>").alias(data)).mapInArrow(walk, f"`{key}` {kind}, pos int, elem_type int, nodes array<bigint>")


def _value(text):
    """A number of a log; "inf" is legal, anything else that is no number is null."""
    return F.when(F.lower(text).isin("inf", "+inf"), F.lit(float("inf"))).otherwise(text.try_cast("double"))


def parse_residuals(lines: DataFrame, width: int = 5, block: int = 1 << 16) -> DataFrame:
    """lines(value, line_no) of a residual log -> (step, metric, value): comment and blank lines go, then come
    records of `width` lines (step, then values); a record cut short at the end goes.  Lines are numbered in
    blocks, so a log spreads over tasks."""
    body = lines.where(~F.col("value").startswith("#") & (S.trim(F.col("value")) != "")).withColumn("b", F.floor(F.col("line_no") / block))
    size = body.groupBy("b").agg(F.count("*").alias("n"))
    before = size.select("b", F.coalesce(F.sum("n").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))  # a row for 65,536 lines
    r = F.col("before") + F.row_number().over(Window.partitionBy("b").orderBy("line_no")) - 1
    body = body.join(before, "b").withColumn("r", r)
    record = body.groupBy(F.floor(F.col("r") / width).alias("rec")).agg(F.sort_array(F.collect_list(F.struct("r", S.trim(F.col("value")).alias("v")))).alias("x")).where(F.size("x") == width)
    return record.select(F.col("x")[0]["v"].cast("long").alias("step"), F.posexplode(F.slice("x", 2, width - 1)).alias("metric", "v")).select("step", "metric", _value(F.col("v.v")).alias("value"))


def residual_records(text: Column) -> Column:
    """Array of (step, metric, value) of a whole residual log as one string: line 2 names the columns, records
    have a line for the step and one for each metric; what is cut short at the end goes."""
    lines = F.filter(F.transform(F.split(text, "\r?\n"), S.trim), lambda x: x != "")
    names = F.filter(F.split(F.get(F.filter(lines, lambda x: x.startswith("#")), F.lit(1)), r"\s+"), lambda x: ~x.isin("#", "Step", "#Step"))
    body = F.filter(lines, lambda x: ~x.startswith("#"))
    width = F.size(names) + 1
    count = F.floor(F.size(body) / F.greatest(width, F.lit(1))).cast("int")

    def record(r):
        at = r * width
        return F.transform(names, lambda name, k: F.struct(F.get(body, at).try_cast("long").alias("step"), name.alias("metric"), _value(F.get(body, at + 1 + k)).alias("value")))

    return F.when(count > 0, F.flatten(F.transform(F.sequence(F.lit(0), count - 1), record)))


def write_parts(part_tables: dict[str, DataFrame], path: str, mode: str = "errorifexists") -> None:
    """Output tables, one folder a part."""
    for name, table in part_tables.items():
        table.write.mode(mode).partitionBy("part_id").parquet(f"{path}/{name}")


def part_file_names(parts: DataFrame, base: str, n: int) -> DataFrame:
    """(part_id, cartesian_name, graph_name): the tools' file names of parts 0..n-1."""
    pad = len(str(n))
    return parts.select("part_id", F.format_string(f"{base}_%0{pad}d.cgns", "part_id").alias("cartesian_name"), F.format_string("decomposed_mesh_%d.cgns", "part_id").alias("graph_name"))


def write_center_dumps(centers: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """centers(part_id, nbr_id, x, y, z) as text, a folder `name=Interface_<part>_<neighbour>` a side: `x y z` lines."""
    name = F.concat_ws("_", F.lit("Interface"), F.col("part_id").cast("string"), F.col("nbr_id").cast("string"))
    centers.select(name.alias("name"), F.concat_ws(" ", *[F.col(a).cast("string") for a in ("x", "y", "z")]).alias("value")).write.mode(mode).partitionBy("name").text(path)


def section_dump(elements: DataFrame) -> DataFrame:
    """Text lines of a section: id, type and nodes."""
    return elements.select("section_id", F.concat_ws(" ", F.col("elem_id").cast("string"), F.col("elem_type").cast("string"), E.key_text(F.col("nodes"))).alias("line"))
