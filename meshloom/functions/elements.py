"""Element types, face templates and face keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Element codes with name, dimension and node count, and the faces of each 3-D type as
# 0-based positions in its node list.
TYPES = ((2, "NODE", 0, 1), (3, "BAR_2", 1, 2), (5, "TRI_3", 2, 3), (7, "QUAD_4", 2, 4), (10, "TETRA_4", 3, 4), (12, "PYRA_5", 3, 5), (14, "PENTA_6", 3, 6), (17, "HEXA_8", 3, 8))
MIXED = 20
FACES = {
    10: ((0, 2, 1), (0, 1, 3), (1, 2, 3), (2, 0, 3)),
    17: ((0, 3, 2, 1), (0, 1, 5, 4), (1, 2, 6, 5), (2, 3, 7, 6), (0, 4, 7, 3), (4, 5, 6, 7)),
    14: ((0, 2, 1), (0, 1, 4, 3), (1, 2, 5, 4), (2, 0, 3, 5), (3, 4, 5)),
    12: ((0, 3, 2, 1), (0, 1, 4), (1, 2, 4), (2, 3, 4), (3, 0, 4)),
}


def constant_table(spark: SparkSession, rows, schema: str) -> DataFrame:
    """A small constant table as a local relation: no job and no Python worker behind it."""
    lit = lambda v: "'" + v.replace("'", "''") + "'" if isinstance(v, str) else f"{v!r}D" if isinstance(v, float) else str(v)
    names, kinds = zip(*[c.split() for c in schema.split(", ")], strict=True)
    values = ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)
    return spark.sql(f"SELECT {', '.join(f'CAST({n} AS {k}) AS {n}' for n, k in zip(names, kinds, strict=True))} FROM VALUES {values} AS t({', '.join(names)})")


def elem_types(spark: SparkSession) -> DataFrame:
    """The constant table (code, name, dim, arity)."""
    return constant_table(spark, TYPES, "code int, name string, dim int, arity int")


def type_from_arity(n: Column, dim: Column) -> Column:
    """Type of an element with n nodes in this dimension; null if there is none."""
    out = F.lit(None).cast("int")
    for code, _, d, arity in TYPES:
        if d >= 2:
            out = F.when((dim == d) & (n == arity), F.lit(code)).otherwise(out)
    return out


def type_name(code: Column) -> Column:
    out = F.lit(None).cast("string")
    for c, name, dim, _ in TYPES:
        if dim >= 2:
            out = F.when(code == c, F.lit(name)).otherwise(out)
    return out


def type_dim(code: Column) -> Column:
    out = F.lit(None).cast("int")
    for c, _, dim, _ in TYPES:
        out = F.when(code == c, F.lit(dim)).otherwise(out)
    return out


def faces(nodes: Column, code: Column) -> Column:
    """Node lists of a cell's faces, wound as in the templates; null for other types."""
    out = F.lit(None).cast("array<array<bigint>>")
    for c, template in FACES.items():
        out = F.when(code == c, F.array(*[F.array(*[nodes[i] for i in f]) for f in template])).otherwise(out)
    return out


def face_key(nodes: Column) -> Column:
    """Canonical key of a face: its node ids ascending."""
    return F.sort_array(nodes)


def key_text(key: Column) -> Column:
    return F.array_join(F.transform(key, lambda x: x.cast("string")), "-")


def same_face(a: Column, b: Column) -> Column:
    """Equally long faces are the same if their node lists are; others if they share three nodes."""
    return F.when(F.size(a) == F.size(b), a == b).otherwise(F.size(F.array_intersect(a, b)) >= 3)
