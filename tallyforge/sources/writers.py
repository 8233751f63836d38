"""Sinks: cleaned data as CSV, analysis sections as partitioned Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True, timestampFormat="yyyy-MM-dd HH:mm:ss")


def as_json_rows(df: DataFrame, section: str, dataset_id: str) -> DataFrame:
    """(dataset_id, section, payload): each row of a section as one JSON document."""
    return df.select(
        F.lit(dataset_id).alias("dataset_id"), F.lit(section).alias("section"),
        F.to_json(F.struct(*df.columns)).alias("payload"),
    )


def persist_sections(sections: dict[str, DataFrame], path: str, dataset_id: str) -> None:
    """One Parquet table per section below ``path``, partitioned by data set.

    Dynamic partition overwrite: saving a data set again replaces only its own rows.
    """
    for name, df in sections.items():
        df.withColumn("dataset_id", F.lit(dataset_id)).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic"
        ).partitionBy("dataset_id").parquet(f"{path}/{name}")


def read_section(spark, path: str, name: str, dataset_id: str | None = None) -> DataFrame:
    df = spark.read.parquet(f"{path}/{name}")
    return df if dataset_id is None else df.where(F.col("dataset_id") == dataset_id)
