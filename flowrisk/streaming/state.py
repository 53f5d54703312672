"""State between micro-batches, kept as small tables in the shared folder.

A batch reads the table its predecessor wrote and writes its own into another slot. Running a batch
again after a failure therefore gives the same result, and a lost executor costs nothing but the
recomputation of the batch. Because the state is a table, a batch can use the ordinary batch
operators, which split hot keys over many tasks; per-key state would pin a hot key to one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from flowrisk.sources.jsonl import path_exists

SLOTS = 3


class StateTable:
    def __init__(self, path: str):
        self.path = path.rstrip("/")

    def _slot(self, epoch: int) -> str:
        return f"{self.path}/slot{epoch % SLOTS}"

    def before(self, spark: SparkSession, epoch: int) -> DataFrame | None:
        """What the previous batch left, or None for the first one."""
        if epoch == 0:
            return None
        if not path_exists(spark, self._slot(epoch - 1)):
            raise ValueError(f"the state before batch {epoch} is missing: {self._slot(epoch - 1)}")
        return spark.read.parquet(self._slot(epoch - 1))

    def save(self, df: DataFrame, epoch: int) -> None:
        df.write.mode("overwrite").parquet(self._slot(epoch))


def staged(df: DataFrame, path: str, epoch: int) -> DataFrame:
    """Rows that several steps of a batch read; the batch after the next one takes the place."""
    slot = f"{path.rstrip('/')}/slot{epoch % 2}"
    df.write.mode("overwrite").parquet(slot)
    return df.sparkSession.read.parquet(slot)


def write_epoch(df: DataFrame, path: str, epoch: int) -> None:
    """Idempotent sink: a repeated batch replaces its own output."""
    df.write.mode("overwrite").parquet(f"{path.rstrip('/')}/epoch={epoch}")


def epochs(spark: SparkSession, path: str) -> list[int]:
    """The epochs that a sink holds, oldest first."""
    if not path_exists(spark, path):
        return []
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder)
    names = [status.getPath().getName() for status in found]
    return sorted(int(n.removeprefix("epoch=")) for n in names if n.startswith("epoch="))


def last_epoch(spark: SparkSession, path: str) -> int:
    return max(epochs(spark, path), default=-1)


def newest_epochs(spark: SparkSession, path: str, enough, first: int = 8) -> DataFrame:
    """The newest epochs of a sink, as many as it takes until ``enough`` says so of the rows: 8, then 16, 32 ..."""
    found = epochs(spark, path)
    while True:
        some = [f"{path.rstrip('/')}/epoch={e}" for e in found[-first:]]
        rows = spark.read.option("basePath", path).parquet(*some)
        if first >= len(found) or enough(rows):
            return rows
        first *= 2


def compact_epochs(spark: SparkSession, path: str, keep: int = 16) -> None:
    """Puts all epochs but the newest ``keep`` into the folder of the last of them, in few files.

    The merged table is complete before anything is deleted, and a run that was cut short is finished by the next one.
    Their rows then stand in time order under that epoch's number.
    """
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    folder = hadoop(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())

    def finish() -> None:
        for status in files.listStatus(folder):
            name = status.getPath().getName()
            if not name.startswith("_merged-"):
                continue
            if not files.exists(hadoop(f"{path}/{name}/_SUCCESS")):
                files.delete(status.getPath(), True)
                continue
            first, last = map(int, name.split("-")[1:])
            for e in epochs(spark, path):
                if first <= e <= last:
                    files.delete(hadoop(f"{path}/epoch={e}"), True)
            if not files.rename(status.getPath(), hadoop(f"{path}/epoch={last}")):
                raise OSError(f"{path}/{name} is complete but could not be renamed")

    path = path.rstrip("/")
    finish()
    old = epochs(spark, path)[:-keep]
    if len(old) > 1:
        rows = spark.read.parquet(*[f"{path}/epoch={e}" for e in old])
        size = sum(files.getContentSummary(hadoop(f"{path}/epoch={e}")).getLength() for e in old)
        rows.coalesce(max(1, int(size >> 28))).write.mode("overwrite").parquet(f"{path}/_merged-{old[0]}-{old[-1]}")
        finish()


def run(stream: DataFrame, process, checkpoint: str, interval: str | None = None):
    """Start the query; without an interval it takes what is there and stops."""
    writer = stream.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval
            else writer.trigger(availableNow=True)).start()
