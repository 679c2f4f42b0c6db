"""Helpers shared by the text operators of this subpackage."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from folium.plans.ship import cut_lineage, ensure_shipped  # noqa: F401


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ensure_shipped(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """Applies fn to each Arrow batch on the executors; None adds no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := fn(batch)) is not None:
                yield out

    return df.mapInArrow(run, schema)


def tokenizer_dir(spark: SparkSession | None = None) -> str:
    """Folder of the public tokenizers: the setting folium.tokenizers, else FOLIUM_TOKENIZERS, else the usual place."""
    set_ = spark.conf.get("folium.tokenizers", None) if spark is not None else None
    return set_ or os.environ.get("FOLIUM_TOKENIZERS", "/opt/tokenizers")
