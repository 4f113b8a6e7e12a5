"""Readers and writers of array files, colour tables, images and cards."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ResourceError
from .catalog import Card
from .npy import read_npy


def to_long(wide: DataFrame, keys: list[str], values: str = "values", unit: str = "unit") -> DataFrame:
    """One row per element of an array column."""
    return wide.select(*keys, F.posexplode(values).alias(unit, "value"))


def to_wide(long: DataFrame, keys: list[str], unit: str = "unit", value: str = "value", out: str = "values") -> DataFrame:
    """An array per key, in the order of the units."""
    pairs = F.array_sort(F.collect_list(F.struct(unit, value)))
    return long.groupBy(*keys).agg(F.transform(pairs, lambda p: p[value]).alias(out))


def read_colour_table(spark: SparkSession, path: str) -> DataFrame:
    """Lines of an id and a name, split at white space: roi_id, roi_name; shorter lines are left out."""
    parts = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).where(F.size(parts) >= 2).select(F.try_to_number(parts[0], F.lit("999999999")).cast("long").alias("roi_id"), parts[1].alias("roi_name")).where("roi_id IS NOT NULL")


def list_images(spark: SparkSession, folder: str, pattern: str = "*.{jpg,JPEG,png}") -> DataFrame:
    """Image files below a folder, by path: path, length, content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    return files.select("path", "length", "content").orderBy("path")


def read_by_extension(spark: SparkSession, path: str) -> DataFrame:
    """A path or glob by its extension: .npy, .parquet, .csv, .json, .ctab, and images; others are an error."""
    extension = os.path.splitext(path)[1][1:].lower()
    if extension == "npy":
        return read_npy(spark, path)
    if extension == "parquet":
        return spark.read.parquet(path)
    if extension == "csv":
        return spark.read.csv(path, header=True, inferSchema=True)
    if extension == "json":
        return spark.read.json(path)
    if extension == "ctab":
        return read_colour_table(spark, path)
    if extension in ("jpg", "jpeg", "png"):
        return spark.read.format("binaryFile").load(path).select("path", "length", "content")
    raise ResourceError(f"no reader for {path!r}")


def read_sessions(spark: SparkSession, paths: list[str], up_to: int | None = None) -> DataFrame:
    """Parquet files of sessions, the first ``up_to`` by name, with their 1-based session number."""
    chosen = sorted(paths)[:up_to]
    if not chosen:
        raise ResourceError("there are no session files")
    parts = [spark.read.parquet(p).withColumn("session", F.lit(i)) for i, p in enumerate(chosen, 1)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def write_responses(df: DataFrame, path: str, keys: tuple[str, ...] = ("subject", "roi")) -> None:
    """Responses as Parquet, partitioned so that a subject or a region is read alone; keys that aren't there are left out."""
    df.write.mode("errorifexists").partitionBy(*[k for k in keys if k in df.columns]).parquet(path)


def read_card(text: str) -> Card:
    """A model card in YAML."""
    try:
        import yaml
    except ImportError as e:
        raise ResourceError("cards need PyYAML") from e
    d = yaml.safe_load(text)
    parameters = d.get("parameters") or {}
    selection = (parameters.get("selection") or {}).get("properties") or {}
    return Card(d["model_id"], d["modality"], d["training_dataset"], {k: v for k, v in parameters.items() if k != "selection"}, tuple(selection))
