"""A table of scenes beside the bands, so that an analysis that needs their list reads no bands."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

from canopygrid.session import shared_folder
from canopygrid.sources import versions

SCENE = ("aoi", "scene_id", "year", "month")


def add_scenes(bands: DataFrame, path: str, keys: Sequence[str] = SCENE) -> None:
    """Enter the scenes of some bands into the table at ``path``, each once."""
    new = bands.select(*keys).distinct()
    known = read_scenes(bands.sparkSession, path)
    both = new if known is None else known.unionByName(new).distinct()
    versions.publish(bands.sparkSession, path, both.coalesce(1).write.parquet)


def read_scenes(spark: SparkSession, path: str) -> DataFrame | None:
    folder = versions.current(spark, path)
    return spark.read.parquet(folder) if folder else None


_places: dict[tuple[str, str], str] = {}


def of_bands(spark: SparkSession, source: str, bands: Callable[[], DataFrame]) -> DataFrame:
    """The scene table of the bands at ``source``, entered once a session and read from then on."""
    at = (spark.sparkContext.applicationId, source)
    if at not in _places or versions.current(spark, _places[at]) is None:
        path = shared_folder(spark, "scenes")
        add_scenes(bands(), path)
        _places[at] = path
    return read_scenes(spark, _places[at])
