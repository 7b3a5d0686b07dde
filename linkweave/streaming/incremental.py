"""New papers as they come: file streams that process every file once, and keep one row per key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from linkweave.functions import paper_ids
from linkweave.functions.text import normalize_chars


def markdown_stream(spark: SparkSession, folder: str, per_batch: int = 1000) -> DataFrame:
    """``paper_id, file, text`` of Markdown files as they appear in a folder."""
    raw = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", "*.md").option("recursiveFileLookup", True).option("maxFilesPerTrigger", per_batch).load(folder)
    return raw.select(paper_ids.from_file(F.col("path")).alias("paper_id"), F.col("path").alias("file"), normalize_chars(F.decode(F.col("content"), "UTF-8")).alias("text"))


def ingest(stream: DataFrame, extract: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """What there is now extracted and appended to ``out``; files of an earlier run aren't read again, as the checkpoint knows them.

    A batch overwrites its own folder, so that one repeated after a failure writes nothing twice.
    """

    def write(batch: DataFrame, n: int) -> None:
        extract(batch).write.mode("overwrite").parquet(f"{out}/batch={n}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_stream(stream: DataFrame, keys: list[str], time: str, delay: str = "30 days") -> DataFrame:
    """The first row of each key within the watermark: deliveries repeated later are dropped; state older than ``delay`` too."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def pending(inputs: DataFrame, done: DataFrame, key: str = "file") -> DataFrame:
    """The inputs without a row in ``done``: the batch way to resume."""
    return inputs.join(done.select(key).distinct(), key, "left_anti")


def latest(df: DataFrame, keys: list[str], time: str) -> DataFrame:
    """The last delivery of each key, of equal times the largest row; the batch counterpart of the stream."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max(F.struct(F.col(time).alias("_t"), *[F.col(c) for c in rest])).alias("r"))
    return best.select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest])
