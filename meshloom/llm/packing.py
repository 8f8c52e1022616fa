"""Packing into optimal length buckets.

The global histogram has each length that occurs, so it grows with the lengths that differ, not with
the documents.  Dynamic programming (by divide and conquer, as the best last boundary never moves back
when lengths grow) picks the bucket boundaries that minimise padding when every document is padded to
its bucket's boundary.  Inside a bucket, documents fill
batches of `budget` tokens in a global order: rows are counted in blocks by hash of id and row number,
block offsets are prefix sums, so no task ever holds a bucket.

Defined results: null or blank text has length 0 and is packed like any other (padded to the
first boundary); a document longer than the budget gets a batch of its own; null ids and rows that
repeat an id are packed row by row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, count_words

def optimal_bounds(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Boundaries (the largest length last) with the least sum of counts * boundary."""
    m = len(lengths)
    if not m:
        return []
    k = min(buckets, m)
    upto = np.concatenate([[0], np.cumsum(counts)]).astype(float)
    best = upto[1:] * lengths  # one bucket for the first i+1 cells
    back = []
    for _ in range(1, k):
        new, arg = best.copy(), np.full(m, -1)
        todo = [(1, m, 0, m - 1)]
        while todo:
            lo, hi, first, last = todo.pop()
            i = (lo + hi) // 2
            end = min(i, last + 1)
            cost = best[first:end] + (upto[i + 1] - upto[first + 1 : end + 1]) * lengths[i]
            j = first + int(cost.argmin())
            if cost[j - first] < new[i]:
                new[i], arg[i] = cost[j - first], j
            if lo < i:
                todo.append((lo, i, first, j))
            if i + 1 < hi:
                todo.append((i + 1, hi, j, last))
        back.append(arg)
        best = new
    bounds, i = [int(lengths[m - 1])], m - 1
    for arg in reversed(back):
        if arg[i] >= 0:
            i = int(arg[i])
            bounds.append(int(lengths[i]))
    return bounds[::-1]


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = 8, budget: int = 16384, length: Column | None = None, rows_per_block: int = 65536) -> DataFrame:
    """(id, n_tokens, bucket, bucket_len, batch, slot, n_pad) of each row.  length: a column of docs
    that counts tokens; words by default.  batch numbers are unique within their bucket."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "pack")
    n = (count_words(F.col(text_col)) if length is None else F.coalesce(length, F.lit(0)).cast("long")).alias("__n")
    # Row numbers are fixed by writing them; they spread rows that share an id over the blocks.
    sized = scratch.cut(docs.select(F.col(id_col).alias("__id"), n, F.monotonically_increasing_id().alias("__row")), "lengths")
    histogram = sized.groupBy("__n").agg(F.count("*").alias("c")).orderBy("__n").collect()  # a row for each length that occurs
    lengths, counts = np.array([r[0] for r in histogram], np.int64), np.array([r[1] for r in histogram], np.int64)
    bounds = optimal_bounds(lengths, counts, buckets) or [0]
    blocks = max(256, -(-int(counts.sum()) // rows_per_block))
    bucket, size = F.lit(0), F.lit(bounds[0])
    for i, b in enumerate(bounds[:-1]):
        bucket = F.when(F.col("__n") > b, F.lit(i + 1)).otherwise(bucket)
        size = F.when(F.col("__n") > b, F.lit(bounds[i + 1])).otherwise(size)
    rows = sized.select("__id", "__n", "__row", bucket.alias("bucket"), size.cast("long").alias("bucket_len"), F.pmod(F.xxhash64("__id", "__row"), F.lit(blocks)).alias("__block"))
    counted = rows.groupBy("bucket", "__block").agg(F.count("*").alias("c"))
    before = F.coalesce(F.sum("c").over(Window.partitionBy("bucket").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counted.select("bucket", "__block", before.alias("__before"))
    rank = F.row_number().over(Window.partitionBy("bucket", "__block").orderBy("__id", "__n", "__row")) - 1
    placed = rows.withColumn("__rank", rank).join(offsets, ["bucket", "__block"])
    at = F.col("__before") + F.col("__rank")
    room = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest(F.col("bucket_len"), F.lit(1)))).cast("long")
    return placed.select(
        F.col("__id").alias(id_col), F.col("__n").alias("n_tokens"), "bucket", "bucket_len",
        F.floor(at / room).cast("long").alias("batch"), F.pmod(at, room).cast("long").alias("slot"), (F.col("bucket_len") - F.col("__n")).alias("n_pad"),
    )
