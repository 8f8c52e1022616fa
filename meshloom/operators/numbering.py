"""Local node numbers, element id ranges, global offsets, localised connectivity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def part_nodes(cells: DataFrame) -> DataFrame:
    """Distinct (part_id, node_id)."""
    return cells.select("part_id", F.explode("nodes").alias("node_id")).distinct()


def local_ids(nodes: DataFrame, block: int = 1 << 20) -> DataFrame:
    """(part_id, node_id, local_id): the 1-based rank of a node in its part.

    Ranks are counted inside blocks of node ids and shifted by the blocks before, so a part spreads
    over as many tasks as it has blocks."""
    blocked = nodes.withColumn("__block", F.floor(F.col("node_id") / block))
    size = blocked.groupBy("part_id", "__block").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy("part_id").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    start = size.select("part_id", "__block", before.alias("__before"))
    rank = F.row_number().over(Window.partitionBy("part_id", "__block").orderBy("node_id"))
    return blocked.withColumn("__rank", rank).join(start, ["part_id", "__block"]).select("part_id", "node_id", (F.col("__before") + F.col("__rank")).alias("local_id"))


def ordinals(rows: DataFrame, key: str, group: str, number: str, name: str, block: int = 1 << 20) -> DataFrame:
    """rows with `name`: the 1-based rank in `key` in the order of (group, number), counted in blocks of
    numbers like local ids."""
    blocked = rows.withColumn("__block", F.floor(F.col(number) / block))
    size = blocked.groupBy(key, group, "__block").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(key).orderBy(group, "__block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    start = size.select(key, group, "__block", before.alias("__before"))
    rank = F.row_number().over(Window.partitionBy(key, group, "__block").orderBy(number))
    return blocked.withColumn("__rank", rank).join(start, [key, group, "__block"]).select(*rows.columns, (F.col("__before") + F.col("__rank")).alias(name))


def localized(cells: DataFrame, local: DataFrame, ids: tuple[str, ...] = ("part_id", "section_id", "elem_id")) -> DataFrame:
    """Cells with node ids replaced by local ids, in order; a node without a local id drops the cell's entry."""
    each = cells.select(*ids, F.posexplode("nodes").alias("pos", "node_id")).join(local, ["part_id", "node_id"])
    back = each.groupBy(*ids).agg(F.sort_array(F.collect_list(F.struct("pos", "local_id"))).alias("x"))
    return back.select(*ids, F.transform("x", lambda v: v["local_id"]).alias("nodes"))


def id_ranges(sizes: DataFrame) -> DataFrame:
    """sizes(part_id, write_seq, n, ...) -> start and end of contiguous element ids in write order.
    One row per part and section, so windows are small."""
    upto = F.sum("n").over(Window.partitionBy("part_id").orderBy("write_seq").rowsBetween(Window.unboundedPreceding, 0))
    return sizes.withColumn("end", upto).withColumn("start", F.col("end") - F.col("n") + 1)


def global_offsets(sizes: DataFrame) -> DataFrame:
    """sizes(part_id, section_id, n) -> global_number, global_start, global_end (exclusive) per section."""
    w = Window.partitionBy("section_id").orderBy("part_id").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("n").over(w), F.lit(0)).cast("long")
    total = F.sum("n").over(Window.partitionBy("section_id"))
    return sizes.select("part_id", "section_id", total.alias("global_number"), start.alias("global_start"), (start + F.col("n")).alias("global_end"))


def running_offsets(sizes: DataFrame) -> DataFrame:
    """sizes(part_id, n) -> global_number, global_start, global_end (exclusive): one counter through all parts.
    One row a part."""
    w = Window.orderBy("part_id").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("n").over(w), F.lit(0)).cast("long")
    return sizes.select("part_id", F.sum("n").over(Window.partitionBy()).alias("global_number"), start.alias("global_start"), (start + F.col("n")).alias("global_end"))


def block_distribution(spark: SparkSession, total: Column | int, n: int) -> DataFrame:
    """(rank, start, end): equal blocks, the remainder to the first ranks."""
    total = total if isinstance(total, Column) else F.lit(total)
    r, q, m = F.col("rank"), F.floor(total / n), total % n
    return spark.range(n).select(F.col("id").cast("int").alias("rank")).select("rank", (r * q + F.least(r, m)).cast("long").alias("start"), ((r + 1) * q + F.least(r + 1, m)).cast("long").alias("end"))


def mixed_offsets(cells: DataFrame, key: str = "section_id") -> DataFrame:
    """Offsets of a MIXED connectivity: the running sum of 1 + nodes, in element order (start offset of each
    cell and the one after it).  Summed in blocks of element ids, so one section spreads over tasks."""
    sized = cells.select(key, "elem_id", (F.size("nodes") + 1).alias("n"), F.floor(F.col("elem_id") / (1 << 20)).alias("__block"))
    size = sized.groupBy(key, "__block").agg(F.sum("n").alias("m"))
    before = F.coalesce(F.sum("m").over(Window.partitionBy(key).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    start = size.select(key, "__block", before.alias("__before"))
    upto = F.sum("n").over(Window.partitionBy(key, "__block").orderBy("elem_id").rowsBetween(Window.unboundedPreceding, 0))
    out = sized.withColumn("upto", upto).join(start, [key, "__block"])
    return out.select(key, "elem_id", (F.col("__before") + F.col("upto") - F.col("n")).alias("offset"), (F.col("__before") + F.col("upto")).alias("next_offset"))
