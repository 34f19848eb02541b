"""Work that is polled or repeated: chunks as they arrive, and checks until nothing fails."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from narrata.operators.chunks import chunks
from narrata.operators.state import KEY


DONE = "chapter_key string, sentence_hash string, status string"


class Log:
    """What was done, appended batch by batch below a path; a batch that runs again replaces its own rows.

    A batch's cost is that of its own rows: nothing that was written is rewritten. ``compact`` puts all finished batches into one folder, apart from the stream.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str = DONE):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def _batches(self) -> list[str]:
        jvm = self.spark._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return []
        names = [f.getPath().getName() for f in fs.listStatus(root)]
        return [n for n in names if n.startswith("batch=") and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}/_SUCCESS"))]

    def read(self, but: int | None = None) -> DataFrame:
        """The rows of all finished batches, or of all but one."""
        names = [n for n in self._batches() if n != f"batch={but}"]
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{n}" for n in names]) if names else self.spark.createDataFrame([], self.schema)

    def append(self, batch: int, rows: DataFrame) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/batch={batch}")

    def compact(self) -> None:
        """All finished batches as batch -1. Not while a stream writes."""
        names = self._batches()
        if len(names) < 2:
            return
        jvm = self.spark._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        whole = jvm.org.apache.hadoop.fs.Path(f"{self.path}/whole")
        self.read().write.mode("overwrite").parquet(f"{self.path}/whole")
        for n in names:
            fs.delete(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}"), True)
        fs.rename(whole, jvm.org.apache.hadoop.fs.Path(f"{self.path}/batch=-1"))


def follow_chapters(spark: SparkSession, source: str, schema: str, done: Log, synthesize: Callable[[DataFrame], DataFrame], checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Chapters that appear in a folder become chunks; those that have no audio yet are synthesized once.

    ``synthesize`` gets (chapter_key, sentence_hash, text, voice) and returns them with ``status``. Each batch appends its own rows under its number, so
    that one that runs again replaces them; what other batches did with success is left out. ``every`` (e.g. "30 seconds") polls;
    without it what is there is done and the query ends.
    """
    def batch(df: DataFrame, number: int) -> None:
        have = done.read(but=number).where("status = 'success'").select(*KEY)
        todo = chunks(df).dropDuplicates(KEY).join(have, KEY, "left_anti")
        done.append(number, synthesize(todo.select(*KEY, "text", "voice")).select(*KEY, "status"))

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 100).parquet(source).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (stream.trigger(processingTime=every) if every else stream.trigger(availableNow=True)).start()


def retry_until_good(run: Callable[[int], DataFrame], record: Callable[[DataFrame], None], most_retries: int = 5) -> dict:
    """Synthesize and check, delete and record what failed, and again, at most ``most_retries`` times more.

    ``run(round)`` returns the chunks that failed and have a file; ``record`` deletes their files and logs them. Returns the rounds and what is left.
    """
    for i in range(most_retries + 1):
        bad = run(i)
        n = bad.count()
        if n == 0 or i == most_retries:
            return {"rounds": i + 1, "left": n}
        record(bad)
    raise AssertionError


def attempts_by_window(events: DataFrame, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Attempts counted by day and type, for a log read as a stream or as a table."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("day"), "event_type", "n")
