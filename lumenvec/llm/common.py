"""Helpers shared by the corpus operators, on top of the library's scratch tables and Arrow maps."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import arrow
from ..arrow import slices
from ..shared import Scratch, fresh_path, scratch_scope, settings, shared_dir

__all__ = ["Scratch", "arrow_map", "fresh_path", "pick", "runtime_filters", "scratch_scope", "shared_dir", "slices", "table", "utf8"]

#: Bits of a runtime Bloom filter: 4 MB, whatever the size of the tables.
FILTER_BITS = 1 << 25


def runtime_filters(spark: SparkSession):
    """Within it, Spark puts its own Bloom filters before shuffle joins of large rows.

    The filter has FILTER_BITS bits whatever it is built from.  With more rows it
    lets more through, which costs shuffled bytes but never changes a result.
    """
    at = "spark.sql.optimizer.runtime.bloomFilter."
    return settings(spark, {
        "spark.sql.autoBroadcastJoinThreshold": "-1", f"{at}enabled": "true", f"{at}applicationSideScanSizeThreshold": "0", f"{at}creationSideThreshold": str(1 << 50),
        f"{at}numBits": str(FILTER_BITS), f"{at}expectedNumItems": str(FILTER_BITS >> 3),
    })


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns under fixed names, so that others cannot clash."""
    return df.select(*[df[f"`{old}`"].alias(new) for new, old in columns.items()])


def arrow_map(df: DataFrame, rows_of: Callable[[dict[str, list]], dict[str, list]], schema: str) -> DataFrame:
    """mapInArrow over column lists: bounded slices in, equally named lists out."""
    return arrow.arrow_map(df, lambda batch: rows_of(batch.to_pydict()), schema)


def utf8(column: str):
    """The UTF-8 bytes of a text column; null counts as empty."""
    return F.encode(F.coalesce(F.col(column), F.lit("")), "UTF-8")
