"""Incremental build of the cell store with Structured Streaming.

Each run picks up the band files that arrived since the last one, turns them
into index cells and appends them. The checkpoint remembers what is done, so an
interrupted run goes on where it stopped and finished scenes are skipped. The
store is the one that ``write_cells`` keeps; both may add to it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from canopygrid.model import INDICES, Sensor
from canopygrid.operators.pixels import index_cells
from canopygrid.sources.writers import merge_cells

STORE_KEYS = ("aoi", "scene_id", "year", "month", "row", "col")


def band_stream(spark: SparkSession, path: str, *, files_per_batch: int = 1000) -> DataFrame:
    """New Parquet files of raw bands under ``path``, whose schema is read once from those present."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def append_cells(
    bands: DataFrame,
    sensor: Sensor,
    store: str,
    checkpoint: str,
    indices: Sequence[str] = INDICES,
    keys: Sequence[str] = STORE_KEYS,
) -> StreamingQuery:
    """Merges the index cells of all files not yet processed into the store, then stops.

    Stateless: each batch is merged by scene and position, so a batch that is
    repeated after a failure leaves the same store.
    """
    cells = index_cells(bands, sensor, keys, indices).withColumn("sensor", F.lit(sensor.name))
    return (
        cells.writeStream.foreachBatch(lambda batch, _: merge_cells(batch, store))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
