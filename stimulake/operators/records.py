"""Nested records as rows of paths, and back."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _leaves(value: object, path: str = "") -> Iterator[tuple[str, str]]:
    """(path, JSON of the leaf): ``a.b`` for a key in an object, ``a@0`` for a place in a list; empty ones are leaves."""
    if isinstance(value, dict) and value:
        for k, v in value.items():
            yield from _leaves(v, f"{path}.{k}" if path else k)
    elif isinstance(value, list) and value:
        for i, v in enumerate(value):
            yield from _leaves(v, f"{path}@{i}")
    else:
        yield path, json.dumps(value, ensure_ascii=False)


def _assemble(paths: list[str], values: list[str]) -> str:
    """The record of some leaves; places of lists that no path names are null. Keys come in the order of their paths."""
    root: dict = {}
    for path, value in sorted(zip(paths, values)):
        steps = [int(s[1:]) if s[0] == "@" else s.removeprefix(".") for s in re.findall(r"@\d+|\.?[^.@]+", path)]
        at = root
        for step, following in zip(steps, [*steps[1:], None]):
            if isinstance(step, int):
                at.extend([None] * (step + 1 - len(at)))
            if following is None:
                at[step] = json.loads(value)
            else:
                held = at[step] if isinstance(step, int) else at.get(step)
                if held is None:
                    at[step] = held = [] if isinstance(following, int) else {}
                at = held
    return json.dumps(root, ensure_ascii=False)


def flatten(df: DataFrame, key: str, record: str) -> DataFrame:
    """(key, path, value): one row a leaf of the JSON objects in ``record``, at any depth; value is the leaf's JSON.

    Null records and empty objects have no rows. Keys with ``.`` or ``@`` in them make paths that can't be told apart from nested ones.
    """

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [(k, *leaf) for k, r in zip(b[key], b[record]) if r is not None for leaf in _leaves(json.loads(r)) if leaf[0]]
            yield pd.DataFrame(found, columns=[key, "path", "value"])

    return df.select(key, record).mapInPandas(rows, f"`{key}` {df.schema[key].dataType.simpleString()}, path string, value string")


def rebuild(flat: DataFrame, key: str, out: str = "record") -> DataFrame:
    """(key, record): the inverse of flatten. A group is the leaves of one record."""

    @F.pandas_udf("string")
    def assembled(paths: pd.Series, values: pd.Series) -> pd.Series:
        return pd.Series([_assemble(list(p), list(v)) for p, v in zip(paths, values)], dtype=object)

    pairs = flat.groupBy(key).agg(F.collect_list(F.struct("path", "value")).alias("p"))
    return pairs.select(key, assembled("p.path", "p.value").alias(out))
