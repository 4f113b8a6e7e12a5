"""Selections of units, channels and time points: checked on the driver, applied as filters and joins."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, NumericType

from ..errors import InvalidParameterError, StimulusError


def check_member(value: object, allowed: Iterable, what: str) -> None:
    if value not in (allowed := list(allowed)):
        raise InvalidParameterError(f"{what} must be one of {allowed}, not {value!r}")


def check_keys(selection: dict, allowed: Iterable[str]) -> None:
    if unknown := sorted(set(selection) - set(allowed)):
        raise InvalidParameterError(f"unknown selection keys {unknown}")


def check_channels(channels: object, allowed: Sequence) -> list:
    """A list of known channels; all unknown ones are named, order and repeats stay."""
    if not isinstance(channels, list):
        raise InvalidParameterError("channels must be a list")
    if unknown := [c for c in channels if c not in allowed]:
        raise InvalidParameterError(f"unknown channels {unknown}")
    return channels


def mask_indices(mask: object, length: int) -> list[int]:
    """Positions of the ones; the mask must be a list, of the length, of 0 and 1, with a 1: checked in that order."""
    if not isinstance(mask, (list, tuple)):
        raise InvalidParameterError("a mask must be a list")
    if len(mask) != length:
        raise InvalidParameterError(f"a mask of {length} values is needed, not {len(mask)}")
    if any(x not in (0, 1) for x in mask):
        raise InvalidParameterError("a mask holds 0 and 1 only")
    if not any(mask):
        raise InvalidParameterError("a mask must select something")
    return [i for i, x in enumerate(mask) if x]


def check_rank(df: DataFrame, column: str, rank: int) -> DataFrame:
    """The rows, if the column is numbers nested ``rank`` arrays deep: a batch of images has a row an image and rank 3."""
    kind, depth = df.schema[column].dataType, 0
    while isinstance(kind, ArrayType):
        kind, depth = kind.elementType, depth + 1
    if depth != rank or not isinstance(kind, NumericType):
        raise StimulusError(f"{column!r} must be numbers in {rank} nested arrays, not {df.schema[column].dataType.simpleString()}")
    return df


def label_contains(label: Column, what: str) -> Column:
    """Case-sensitive: any of the letters of ``what``; ``all`` takes every row."""
    if what == "all":
        return F.lit(True)
    out = F.lit(False)
    for c in what:
        out = out | label.contains(c)
    return out


def positions(spark: SparkSession, values: list, name: str) -> DataFrame:
    """(value, pos): one row per asked value, repeats kept."""
    return spark.createDataFrame([(v, i) for i, v in enumerate(values)], [name, "pos"])


def select_units(units: DataFrame, roi: str | None = None, mask: Sequence[int] | Column | None = None, rois: Iterable[str] | None = None) -> DataFrame:
    """Units of a region of interest; only without one does a mask by unit number count; else all.

    A region must be one of ``rois``, by default those that the units have (a list of names, whatever the number of units). A mask is
    a condition on the units, or a list of 0 and 1 for a short axis.
    """
    if roi is not None:
        check_member(roi, rois if rois is not None else sorted(r[0] for r in units.select("roi").distinct().dropna().collect()), "roi")
        return units.where(F.col("roi") == roi)
    if isinstance(mask, Column):
        return units.where(mask)
    if mask is not None:
        chosen = units.sparkSession.createDataFrame([(i,) for i in mask_indices(list(mask), len(mask))], "unit long")
        return units.join(chosen, "unit", "left_semi")
    return units
