"""Input size of datasets from a file manifest (one row per file)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BYTES_IN_GB = 1024.0 ** 3


def dataset_sizes(file_manifest: DataFrame) -> DataFrame:
    """Files and GB per dataset: a grouped sum, pre-aggregated on every mapper."""
    return (file_manifest.groupBy("dataset")
            .agg(F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("bytes"))
            .withColumn("data_size_gb", F.col("bytes") / F.lit(BYTES_IN_GB)))
