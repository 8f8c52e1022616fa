"""What several operators share: text as byte arrays, word and window hashes, written
intermediate tables, and connected components.

A *slice* is a run of rows of one Arrow batch whose texts, joined, have about SLICE_BYTES
bytes; array work is done slice by slice, so memory follows SLICE_BYTES or the longest
single text, never the batch.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_BYTES = 1 << 19

U = np.uint64
_SEED = np.random.default_rng(20240607)
#: A random odd-multiplier table makes each byte a 64-bit symbol before the polynomial hash.
SYMBOL = _SEED.integers(1, 1 << 63, 256, dtype=np.uint64)
SYMBOL_LOWER = SYMBOL.copy()
SYMBOL_LOWER[65:91] = SYMBOL[97:123]
BASE = U(0xD6E8FEB86659FD93)
BASE_INV = U(pow(int(BASE), -1, 1 << 64))
LANES = _SEED.integers(1, 1 << 63, 64, dtype=np.uint64) | U(1)
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True

_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i, modulo 2**64, for i < n (kept per worker, grown as needed)."""
    if len(_powers[0]) < n:
        size = max(n, SLICE_BYTES + 1)
        for k, b in enumerate((BASE, BASE_INV)):
            x = np.full(size, b, np.uint64)
            x[0] = 1
            _powers[k] = np.multiply.accumulate(x)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and row offsets into them; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8), offsets


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of each slice; one row at least."""
    data, offs = texts(column)
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
        j = min(j, n)
        yield i, j, data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


class Hashes:
    """Prefix sums of a polynomial hash; of(s, e) is the hash of bytes s..e-1, wherever they stand."""

    def __init__(self, data: np.ndarray, symbols: np.ndarray = SYMBOL):
        up, self.down = powers(len(data) + 1)
        self.sum = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(symbols[data] * up[: len(data)], out=self.sum[1:])

    def of(self, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        return mix((self.sum[e] - self.sum[s]) * self.down[s] + (e - s).astype(np.uint64) * LANES[63])


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words (runs without ASCII white space), and for each row the index
    of its first word (one more entry than rows).  Words don't cross rows."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    solid = ~SPACE[data]
    edge = np.zeros(len(data), bool)
    edge[offs[:-1][offs[:-1] < len(data)]] = True
    first = solid.copy()
    first[1:] &= ~solid[:-1] | edge[1:]
    last = solid.copy()
    last[:-1] &= ~solid[1:] | edge[1:]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offs)


# -- written intermediate tables ---------------------------------------------------------


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster shares (spark.checkpoint.dir); only a local session gets one of its own where it is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        have = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = have.get() if have.isDefined() else None
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='meshloom-')}"
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


class Scratch:
    """Tables written to the shared folder: they cut lineage and outlive lost executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.base, self.made = spark, f"{shared_dir(spark)}/meshloom/{name}-{uuid.uuid4().hex}", 0

    def path(self, label: str) -> str:
        self.made += 1
        return f"{self.base}/{self.made:03d}-{label}"

    def cut(self, df: DataFrame, label: str) -> DataFrame:
        path = self.path(label)
        free = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"  # shuffle files go when the table is written
        before = self.spark.conf.get(free, None)
        self.spark.conf.set(free, "true")
        try:
            df.write.parquet(path)
        finally:
            self.spark.conf.unset(free) if before is None else self.spark.conf.set(free, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def release(self, *tables: DataFrame) -> None:
        """Deletes written tables that nothing reads any more."""
        jvm = self.spark.sparkContext._jvm
        for t in tables:
            where = jvm.org.apache.hadoop.fs.Path(t._scratch_path)
            where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)

    def clear(self) -> None:
        """Deletes all written tables."""
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.base)
        where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def hidden(name: str, df: DataFrame) -> str:
    """A column name that clashes with none of df's (case-insensitively)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


# -- connected components ----------------------------------------------------------------


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of one task reduced to stars around their least node."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        path = []
        while (p := up.get(x, x)) != x:
            path.append(x)
            x = p
        for y in path:
            up[y] = x
        return x

    def flush() -> pa.RecordBatch:
        ends = list(up)
        out = pa.RecordBatch.from_arrays([pa.array(ends, pa.int64()), pa.array([root(x) for x in ends], pa.int64())], ["u", "v"])
        up.clear()
        return out

    for batch in batches:
        for a, b in zip(batch["u"].to_pylist(), batch["v"].to_pylist(), strict=True):
            ra, rb = root(a), root(b)
            if ra != rb:
                up[max(ra, rb)] = min(ra, rb)
        if len(up) > 500_000:  # bounded memory: stars of what has been seen
            yield flush()
    if up:
        yield flush()


def components(edges: DataFrame, scratch: Scratch, a: str = "u", b: str = "v") -> DataFrame:
    """(node, component): for each node of an edge the least node it is connected with.

    Task-local union-find, then large-star and small-star rounds until all trees are
    stars.  All state stays in written tables; the driver sees one flag a round.  The joins are plain
    equi-joins that AQE splits where a hub is hot.
    """
    star = "u long, v long"
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u != v").mapInArrow(_forest, star).distinct()
    e = scratch.cut(e, "edges")

    def stars(e: DataFrame) -> bool:
        """Whether no node has two parents, or a parent and a child."""
        ends = F.array(F.struct(F.col("u").alias("x"), F.lit(1).alias("c"), F.lit(0).alias("r")), F.struct(F.col("v").alias("x"), F.lit(0).alias("c"), F.lit(1).alias("r")))
        seen = e.select(F.inline(ends)).groupBy("x").agg(F.sum("c").alias("c"), F.max("r").alias("r"))
        return seen.agg(F.max(F.expr("c > 1 OR (c = 1 AND r = 1)"))).first()[0] is not True

    while not stars(e):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
        small = small.where("u != v").mapInArrow(_forest, star).distinct()
        new = scratch.cut(small, "stars")
        scratch.release(e)
        e = new
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select("v", "v").distinct())


def count_words(text: Column) -> Column:
    """Words of a text, null as none; stays in the JVM."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
