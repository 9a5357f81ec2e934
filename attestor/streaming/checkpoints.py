"""Progress of runs: what is done of each session, kept up by a stream, and what is left for a run that begins again.

A run reports (session, control, status, at). The newest report of a control counts, the later in the table of equal times by
`status`; `DONE` ends it. Each micro-batch writes the newest report of the controls it has to a folder of its own number, so
running it again after a failure changes nothing, and reading takes the newest of all folders. Rows without session or
control are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

KEYS = ("session", "control")
DONE = ("COMPLETED", "FAILED")


def newest(reports: DataFrame) -> DataFrame:
    """(session, control, status, at, reports): the newest report of each control and how many there are."""
    rows = reports.filter(F.col("session").isNotNull() & F.col("control").isNotNull())
    n = F.sum("reports") if "reports" in reports.columns else F.count("*")
    best = rows.groupBy(*KEYS).agg(F.max(F.struct("at", "status")).alias("x"), n.alias("reports"))
    return best.select(*KEYS, "x.status", "x.at", "reports")


def follow(spark: SparkSession, folder: str, schema, checkpoint: str, out: str, files: int = 1) -> StreamingQuery:
    """Keep `out` up with the reports in a folder of parquet files."""
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)

    def put(rows: DataFrame, batch: int) -> None:
        newest(rows).write.mode("overwrite").parquet(f"{out}/batch={batch:09d}")

    return source.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def state(spark: SparkSession, out: str) -> DataFrame:
    """The newest report of each control in what `follow` has written."""
    return newest(spark.read.parquet(out).drop("batch"))


def remaining(work: DataFrame, progress: DataFrame) -> DataFrame:
    """The (session, control) of `work` that no run has ended."""
    ended = progress.filter(F.col("status").isin(*DONE)).select(*KEYS)
    return work.select(*KEYS).distinct().join(ended, list(KEYS), "left_anti")


def sessions(work: DataFrame, progress: DataFrame) -> DataFrame:
    """(session, total, done, failed, state, at) of each session of `work`: COMPLETED if all is ended, STARTED if some is."""
    all_ = work.select(*KEYS).distinct()
    ended = progress.filter(F.col("status").isin(*DONE))
    rows = all_.join(ended, list(KEYS), "left").groupBy("session").agg(
        F.count("*").alias("total"), F.count("status").alias("done"), F.count_if(F.col("status") == "FAILED").alias("failed"), F.max("at").alias("at"),
    )
    state_ = F.when(F.col("done") == F.col("total"), "COMPLETED").when(F.col("done") > 0, "STARTED").otherwise("WAITING")
    return rows.select("session", "total", "done", "failed", state_.alias("state"), "at")
