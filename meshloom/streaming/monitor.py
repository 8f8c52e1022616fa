"""Monitoring of running solvers: residual and memory series, in batch and as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.mesh import residual_records


def convergence(series: DataFrame) -> DataFrame:
    """series(step, metric, value) -> per metric: first and last value, least value, drop (first / last)."""
    out = series.groupBy("metric").agg(F.min_by("value", "step").alias("first_value"), F.max_by("value", "step").alias("last_value"), F.min("value").alias("least_value"), F.count("*").alias("n_steps"))
    return out.withColumn("drop", F.try_divide(F.col("first_value"), F.col("last_value")))


def watch(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of (step, metric, value) from residual logs appearing in a folder, in the solvers' layout: a title,
    the column names, then a line for the step and one for each value."""
    logs = spark.readStream.text(folder, wholetext=True)
    return logs.select(F.explode(residual_records(F.col("value"))).alias("r")).select("r.*").where("step IS NOT NULL")


def watch_until_idle(stream: DataFrame, name: str, checkpoint: str, refresh: str = "1 second", idle_rounds: int = 3):
    """Writes a stream's latest aggregates to an in-memory table, refreshed on a trigger, and stops after
    idle_rounds polls without new rows."""
    import time

    seconds = float(refresh.split()[0])
    q = convergence(stream).writeStream.outputMode("complete").format("memory").queryName(name).trigger(processingTime=refresh).option("checkpointLocation", checkpoint).start()
    idle = 0
    last = None
    while q.isActive and idle < idle_rounds:
        time.sleep(seconds)
        p = q.lastProgress
        now = p["batchId"] if p else None
        idle = idle + 1 if now == last else 0
        last = now
    q.processAllAvailable()
    q.stop()
    return q


def memory_log(lines: DataFrame) -> DataFrame:
    """lines(value) of a memory log -> (step, gb): header lines start with #, then come `step gigabytes`."""
    p = F.split(F.trim("value"), r"\s+")
    rows = lines.where(~F.col("value").startswith("#") & (F.trim("value") != ""))
    return rows.select(p[0].try_cast("long").alias("step"), F.get(p, 1).try_cast("double").alias("gb")).where("step IS NOT NULL")


def resident_gb(pid: int) -> float | None:
    """Resident memory of a process in GB; None once it has ended."""
    try:
        with open(f"/proc/{pid}/status") as f:
            return next((int(line.split()[1]) / 1e6 for line in f if line.startswith("VmRSS:")), None)
    except OSError:
        return None


def sample_memory(pid: int, path: str, every: float = 1.0, most: int | None = None) -> int:
    """Writes a memory log of a process on this machine, a line each `every` seconds, until it ends; lines written."""
    import time

    step = 0
    with open(path, "w") as f:
        f.write("#Residual\n# Step Mem(Gb)\n")
        while (most is None or step < most) and (gb := resident_gb(pid)) is not None:
            step += 1
            f.write(f"{step} {gb:.6f}\n")
            f.flush()
            time.sleep(every)
    return step
