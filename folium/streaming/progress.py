"""Streams: documents arriving as files, progress of their chunks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


# Percent and stage of the steps of a document, with a provider and with rules alone.
MILESTONES = [(2, "extract"), (12, "extract"), (18, "chunk"), (20, "llm"), (85, "llm"), (88, "merge"), (92, "verify"), (97, "finish"), (100, "finish")]
RULE_MILESTONES = [(2, "extract"), (12, "extract"), (18, "chunk"), (25, "llm"), (70, "llm"), (75, "verify"), (90, "finish"), (100, "finish")]


def reached(at: Column, *, rules: bool = False) -> Column:
    """array of struct(percent, stage): the milestones at or below a percentage, which is held within 0 and 100."""
    every = F.array(*[F.struct(F.lit(p).alias("percent"), F.lit(s).alias("stage")) for p, s in (RULE_MILESTONES if rules else MILESTONES)])
    return F.filter(every, lambda m: m["percent"] <= F.greatest(F.lit(0), F.least(F.lit(100), at)))


def percent(done: Column, total: Column) -> Column:
    """20 to 85 in proportion to the chunks that are done."""
    return F.when(total > 0, F.lit(20) + F.floor(F.lit(65) * F.least(done, total) / total)).otherwise(20).cast("int")


def progress(events: DataFrame, totals: DataFrame | None = None, *, key: str = "doc_id") -> DataFrame:
    """Running count of finished chunks per document (update mode on a stream); with totals also the percentage."""
    done = events.groupBy(key).agg(F.count("*").alias("done"))
    return done if totals is None else done.join(totals, key).withColumn("percent", percent(F.col("done"), F.col("total")))


def arriving(spark: SparkSession, path: str, schema: StructType | str, *, max_files: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def run_batches(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, *, late_after: str | None = None, time: str | None = None, key: list[str] | None = None, available_now: bool = True):
    """Starts a stateless per-batch job; with `key` and `time`, rows delivered again within `late_after` are dropped."""
    if key and time and late_after:
        stream = stream.withWatermark(time, late_after).dropDuplicatesWithinWatermark(key)
    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(each)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
